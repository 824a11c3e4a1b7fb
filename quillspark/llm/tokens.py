"""Encoding a corpus with a byte-level BPE vocabulary, in parallel within long texts (problem 7).

A long text is cut into overlapping chunks that are pre-tokenised independently. Two scanners that stand at the same boundary go on
identically, because a pre-token depends only on what follows its start; so the first boundary that both chunks of an overlap report is a safe
seam. Pieces between seams are encoded on their own and their ids are strung together.

Defined results: null and empty texts give an empty list (count 0); a null id is kept as a row; columns other than the two named ones are
dropped, so clashing names cannot occur; repeated rows are repeated, whatever their length, unless ``unique_ids`` is false, which drops repeats by id
first. A long text is encoded once, however many rows have it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.staging import stage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published pre-token pattern of this vocabulary.
PRETOKEN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK_CHARS = 16_384
OVERLAP_CHARS = 512
#: A boundary this close to a chunk's end may rest on a token that the end cut.
UNSURE_CHARS = 4


@lru_cache(maxsize=4)
def encoder(vocabulary: str = VOCABULARY):
    """The tiktoken encoding of a vocabulary file, loaded once per process."""
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={})


def decode(ids, vocabulary: str = VOCABULARY) -> str:
    """The text of ids: their raw bytes, strung together."""
    return encoder(vocabulary).decode_bytes(list(ids)).decode("utf-8")


_scan = regex.compile(PRETOKEN)


def boundaries(text: str, base: int) -> list[int]:
    """Offsets (plus base) at which pre-tokens of text start."""
    return [base + m.start() for m in _scan.finditer(text)]


def _ids(texts: list[str | None], vocabulary: str) -> list[np.ndarray]:
    enc = encoder(vocabulary)
    return [enc.encode_to_numpy(t, disallowed_special=()) if t else np.empty(0, np.uint32) for t in texts]


def _encoded(df: DataFrame, keys: list[str], text: str, vocabulary: str, count: bool) -> DataFrame:
    """df's keys with the ids (or their number) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _ids(batch.column(batch.schema.get_field_index(text)).to_pylist(), vocabulary)
            sizes = np.array([len(x) for x in found], np.int64)
            if count:
                out = pa.array(sizes)
            else:
                flat = np.concatenate([*found, np.empty(0, np.uint32)]).astype(np.int32)
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(k)) for k in keys), out], names=[*keys, "ids"])

    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("ids", T.LongType() if count else T.ArrayType(T.IntegerType()))])
    return df.select(*keys, text).mapInArrow(run, schema)


def _pieces(long: DataFrame, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """(doc, piece, text) of long texts (doc, text), cut where two overlapping scanners agree."""

    def slice_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist()):
                n = len(text)
                rows = []
                for k in range(-(-n // chunk_chars)):
                    base = max(0, k * chunk_chars - overlap_chars)
                    rows.append({"doc": doc, "k": k, "n": n, "base": base, "part": text[base : (k + 1) * chunk_chars + overlap_chars]})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("doc", pa.string()), ("k", pa.int32()), ("n", pa.int32()), ("base", pa.int32()), ("part", pa.string())]))

    chunks = stage(long.mapInArrow(slice_all, "doc string, k int, n int, base int, part string").repartition("doc", "k"), "slices")

    def scan(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for doc, k, n, base, part in pdf.itertuples(index=False):
                at, stop = boundaries(part, base), base + len(part)
                sure = stop if stop == n else stop - UNSURE_CHARS
                at = [p for p in at if p < sure]
                lead = [p for p in at if k and p <= k * chunk_chars + overlap_chars]
                trail = [p for p in at if p >= (k + 1) * chunk_chars - overlap_chars] if stop < n else []
                rows.append((doc, k, lead, trail))
            yield pd.DataFrame(rows, columns=["doc", "k", "lead", "trail"])

    doc = chunks.schema["doc"].dataType.simpleString()
    scanned = chunks.mapInPandas(scan, f"doc {doc}, k int, lead array<int>, trail array<int>")
    before = scanned.select("doc", (F.col("k") + 1).alias("k"), F.col("trail").alias("earlier"))
    seam = F.array_min(F.array_intersect("earlier", "lead"))
    seams = scanned.join(before, ["doc", "k"], "left").select("doc", "k", F.when(F.col("k") == 0, 0).otherwise(seam).alias("seam"))
    # A border without a seam gives its two chunks to one piece; cut marks where chunk k's own characters begin.
    cut = F.coalesce("seam", F.col("k") * chunk_chars)
    after = seams.select("doc", (F.col("k") - 1).alias("k"), cut.alias("stop"))
    placed = chunks.join(seams, ["doc", "k"]).join(after, ["doc", "k"], "left")
    stop = F.coalesce("stop", "n")
    from pyspark.sql import Window

    piece = F.last(F.when(F.col("seam").isNotNull(), F.col("k")), ignorenulls=True)
    owner = seams.select("doc", "k", piece.over(Window.partitionBy("doc").orderBy("k")).alias("piece"))
    own = placed.select("doc", "k", F.expr("substring(part, {0} - base + 1, {1} - {0})".format("coalesce(seam, k * %d)" % chunk_chars, "coalesce(stop, n)")).alias("own"))
    return own.join(owner, ["doc", "k"]).groupBy("doc", "piece").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "own"))), lambda x: x["own"]), "").alias("text"))


def encode_corpus(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    count: bool = False,
    chunk_chars: int = CHUNK_CHARS,
    overlap_chars: int = OVERLAP_CHARS,
    unique_ids: bool = True,
) -> DataFrame:
    """(id, ids) of every row of docs; with ``count``, (id, ids) where ids is the number of tokens."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    if not unique_ids:
        rows = rows.dropDuplicates(["doc"])
    is_long = F.coalesce(F.char_length("text"), F.lit(0)) > chunk_chars
    short = _encoded(rows.where(~is_long), ["doc"], "text", vocabulary, count)
    # Long texts go by their hashes: rows of one text, or of one id, don't mix.
    named = rows.where(is_long).select("doc", F.sha2("text", 256).alias("key"), "text")
    once = named.groupBy(F.col("key").alias("text_key")).agg(F.first("text").alias("text")).withColumnRenamed("text_key", "doc")
    pieces = _encoded(_pieces(once, chunk_chars, overlap_chars), ["doc", "piece"], "text", vocabulary, count)
    if count:
        whole = pieces.groupBy("doc").agg(F.sum("ids").alias("ids"))
    else:
        whole = pieces.groupBy("doc").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    long = named.select("doc", "key").join(whole.withColumnRenamed("doc", "key"), "key").select("doc", "ids")
    return short.unionByName(long).select(F.col("doc").alias(id_col), "ids")
