"""The vector index as a table that follows the store: replacing documents, logging what changed, replaying it, and the checks before a search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import day_number
from quillspark.operators.ranking import usable
from quillspark.operators.store import latest, once

INDEX = "chunk_id bigint, company string, category string, text_hash string, publication_day int"
#: Batches of a replay.
LEAST_BATCH, MOST_BATCH = 1, 256
#: Texts, and their characters, that one call of an embedding model takes; and of one text.
CALL_TEXTS, CALL_CHARS = 64, 60_000


def insert_absent(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Stored rows, and those of new whose key isn't there; of several new ones with a key, one. A null key is never inserted."""
    fresh = new.where(F.col(key).isNotNull()).dropDuplicates([key]).join(stored.select(key), key, "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def replaced(documents: DataFrame, chunks: DataFrame, arriving: DataFrame, arriving_chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, chunks, changed chunk ids) after documents (by id) and all their chunks give way to arriving ones. What goes and what comes is logged."""
    ids = arriving.where("id is not null").select("id").distinct()
    of = ids.withColumnRenamed("id", "document_id")
    kept, gone = once(chunks, "id").join(of, "document_id", "left_anti"), once(chunks, "id").join(of, "document_id", "left_semi")
    come = once(arriving_chunks, "id").join(of, "document_id", "left_semi")
    docs = documents.join(ids, "id", "left_anti").unionByName(latest(arriving))
    return docs, kept.unionByName(come.select(*chunks.columns)), gone.select("id").union(come.select("id")).distinct().withColumnRenamed("id", "chunk_id")


def points(chunks: DataFrame, documents: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """Index rows of the chunks that have a usable vector; an unknown day stays null."""
    docs = latest(documents).select(F.col("id").alias("document_id"), "company", "category", day_number(F.col("publication_date")).alias("publication_day"))
    own = once(chunks, "id").select(F.col("id").alias("chunk_id"), "document_id", "text_hash").join(usable(vectors, dimension).select("text_hash"), "text_hash", "left_semi")
    return own.join(docs, "document_id", "left").select("chunk_id", "company", "category", "text_hash", "publication_day")


def replayed(index: DataFrame, pending: DataFrame, chunks: DataFrame, documents: DataFrame, vectors: DataFrame, dimension: int = 64) -> tuple[DataFrame, DataFrame]:
    """(index, pending) after all pending changes are replayed: chunks that are gone leave, those with a vector are written anew, the others keep waiting.

    What is acknowledged is what was written, so a replay that is broken off is done again with the same result.
    """
    wait = pending.where("chunk_id is not null").select("chunk_id").distinct()
    gone = wait.join(once(chunks, "id").select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti")
    fresh = points(chunks, documents, vectors, dimension).join(wait, "chunk_id", "left_semi")
    done = gone.unionByName(fresh.select("chunk_id"))
    return index.join(done, "chunk_id", "left_anti").unionByName(fresh), wait.join(done, "chunk_id", "left_anti")


def stale(index: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id) of index rows whose text isn't that of the chunk any more, or whose chunk is gone: they have to be queued for repair."""
    own = once(chunks, "id").select(F.col("id").alias("chunk_id"), F.col("text_hash").alias("now"))
    return index.select("chunk_id", "text_hash").join(own, "chunk_id", "left").where("now is null or not (now <=> text_hash)").select("chunk_id").distinct()


def gate(index: DataFrame, chunks: DataFrame, pending: DataFrame, target: str | None, metadata: DataFrame) -> DataFrame:
    """One row: chunks, points, pending, same_target, and whether a search by vector may run: nothing waits, every chunk has its point, and the index is that of the target."""
    n = once(chunks, "id").agg(F.count("*").alias("chunks"))
    p = index.agg(F.countDistinct("chunk_id").alias("points"))
    w = pending.where("chunk_id is not null").agg(F.countDistinct("chunk_id").alias("pending"))
    held = metadata.agg(F.max(F.when(F.col("meta_key") == "qdrant_target", F.col("meta_value"))).alias("held"))
    one = n.join(p).join(w).join(held).withColumn("same_target", F.col("held").eqNullSafe(F.lit(target)))
    fine = (F.col("chunks") == 0) | ((F.col("pending") == 0) & (F.col("chunks") == F.col("points")) & F.col("same_target"))
    return one.select("chunks", F.when(F.col("same_target"), F.col("points")).otherwise(0).alias("points"), "pending", "same_target", fine.alias("complete"))


def identity_allows(metadata: DataFrame, vectors: DataFrame, identity: str) -> DataFrame:
    """One row, whether vectors of a model may be added: there are none yet, or they are of the same model."""
    held = metadata.agg(F.max(F.when(F.col("meta_key") == "embedding_identity", F.col("meta_value"))).alias("held"))
    some = vectors.where("vector is not null").select("text_hash").limit(1).agg((F.count("*") > 0).alias("some"))
    return held.join(some).select(F.col("held").isNotNull().alias("known"), "some", (~F.col("some") | F.col("held").eqNullSafe(F.lit(identity))).alias("allowed"))


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], dimension: int | None = None) -> DataFrame:
    """(text_hash, dimension, vector) of texts (text_hash, text), each text once, in calls of bounded size; vectors come back with length 1.

    Blank and oversized texts, and answers that are short, of another dimension, not finite or zero, are errors.
    """
    import numpy as np
    import pandas as pd

    def run(batches):
        for pdf in batches:
            calls, size = [[]], 0
            for i, t in enumerate(pdf.text):
                if not t or not t.strip() or len(t) > CALL_CHARS:
                    raise ValueError(f"a text to embed has 1 to {CALL_CHARS} characters")
                if calls[-1] and (len(calls[-1]) >= CALL_TEXTS or size + len(t) > CALL_CHARS):
                    calls.append([])
                    size = 0
                calls[-1].append(i)
                size += len(t)
            rows = []
            for call in calls:
                if call:
                    x = np.array(embed([pdf.text.iloc[i] for i in call]), np.float64)
                    length = np.linalg.norm(x, axis=1, keepdims=True) if x.ndim == 2 else np.zeros(1)
                    if x.ndim != 2 or len(x) != len(call) or (dimension and x.shape[1] != dimension) or not np.isfinite(x).all() or not (length > 0).all():
                        raise ValueError("vectors have to be finite, not zero, one a text and of one dimension")
                    rows += [(pdf.text_hash.iloc[i], x.shape[1], v) for i, v in zip(call, (x / length).astype(np.float32).tolist())]
            yield pd.DataFrame(rows, columns=["text_hash", "dimension", "vector"])

    once_each = texts.where("text_hash is not null").groupBy("text_hash").agg(F.first("text").alias("text"))
    return once_each.mapInPandas(run, "text_hash string, dimension int, vector array<float>")


class Versions:
    """A table in a folder, written as whole versions; a reader sees the last one that was finished."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def numbers(self) -> list[int]:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in files.listStatus(where)] if files.exists(where) else []
        done = [n for n in names if n.startswith("v") and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))]
        return sorted(int(n[1:]) for n in done)

    def read(self) -> DataFrame | None:
        have = self.numbers()
        return self.spark.read.parquet(f"{self.path}/v{have[-1]}") if have else None

    def write(self, df: DataFrame, keep: int = 2) -> None:
        have = self.numbers()
        df.write.option("compression", "zstd").mode("overwrite").parquet(f"{self.path}/v{(have[-1] if have else 0) + 1}")
        for n in self.numbers()[:-keep]:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{n}")
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def exported(tables: dict[str, DataFrame], path: str, keys: dict[str, list[str]]) -> DataFrame:
    """Writes a bundle of tables and returns its manifest (table, rows, digest): the digest is of the sorted keys' hashes, whatever the order of rows."""
    spark = next(iter(tables.values())).sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(where):
        raise FileExistsError(path)
    try:
        for name, df in tables.items():
            df.write.option("compression", "zstd").parquet(f"{path}/{name}.parquet")
        out = manifest({n: spark.read.parquet(f"{path}/{n}.parquet") for n in tables}, keys)
        out.coalesce(1).write.json(f"{path}/manifest")
    except Exception:
        files.delete(where, True)
        raise
    return spark.read.schema(out.schema).json(f"{path}/manifest")


def manifest(tables: dict[str, DataFrame], keys: dict[str, list[str]]) -> DataFrame:
    """(table, rows, digest) of tables: the digest adds up parts of the hashes of all rows' keys, so that nothing has to be sorted or gathered."""
    out = None
    for name, df in tables.items():
        h = F.md5(F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("-")) for k in keys[name])))
        part = df.select(F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint").alias("h")).agg(F.lit(name).alias("table"), F.count("*").alias("rows"), F.coalesce(F.sum("h"), F.lit(0)).alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out
