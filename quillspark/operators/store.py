"""The tables of an evidence store: statistics, pending work, synchronisation, replacement and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ALIAS = "array<struct<source_url:string,title:string,publication_date:string,publication_period:string,date_basis:string,scope:string,role:string>>"


def once(df: DataFrame, key: str) -> DataFrame:
    """Rows delivered twice count once."""
    return df.where(F.col(key).isNotNull()).dropDuplicates([key])


def overview(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, pending: DataFrame) -> DataFrame:
    """One row: documents, chunks, embedded, pending, indexed (embedded and not pending)."""
    own = once(chunks, "id").select("id", "text_hash")
    have = vectors.where("text_hash is not null and vector is not null").select("text_hash").distinct()
    wait = pending.select(F.col("chunk_id").alias("id")).distinct()
    embedded = own.join(have, "text_hash", "left_semi")
    one = documents.agg(F.countDistinct("id").alias("documents"))
    two = own.agg(F.count("*").alias("chunks"))
    three = embedded.agg(F.count("*").alias("embedded"))
    four = wait.agg(F.count("*").alias("pending"))
    five = embedded.join(wait, "id", "left_anti").agg(F.count("*").alias("indexed"))
    return one.join(two).join(three).join(four).join(five)


def by_company(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents and chunks a company; companies without chunks have 0."""
    docs = documents.select("id", "company").distinct()
    # Counting before joining keeps one company's share of the chunks out of one task.
    per = once(chunks, "id").groupBy("document_id").agg(F.count("*").alias("n"))
    return docs.join(per, docs["id"] == per["document_id"], "left").groupBy("company").agg(F.countDistinct("id").alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


def unembedded(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """(text_hash, chunk_id): texts without a vector, each once, with its least chunk."""
    texts = chunks.where("text_hash is not null").groupBy("text_hash").agg(F.min("id").alias("chunk_id"))
    return texts.join(vectors.where("vector is not null").select("text_hash").distinct(), "text_hash", "left_anti")


def sync_batch(pending: DataFrame, chunks: DataFrame, vectors: DataFrame, most: int = 128) -> DataFrame:
    """The next most pending ids: deletions of chunks that are gone, and upserts of those that have a vector."""
    wait = pending.where("chunk_id is not null").distinct()
    own = once(chunks, "id").select(F.col("id").alias("chunk_id"), "text_hash")
    have = vectors.where("vector is not null and text_hash is not null").select(F.col("text_hash").alias("has")).distinct()
    both = wait.join(own.withColumn("here", F.lit(True)), "chunk_id", "left").join(have, F.col("text_hash") == F.col("has"), "left")
    return both.where("here is null or has is not null").select("chunk_id", F.when(F.col("here").isNull(), "delete").otherwise("upsert").alias("action")).orderBy("chunk_id").limit(most)


def still_pending(pending: DataFrame, done: DataFrame) -> DataFrame:
    return pending.distinct().join(done.select("chunk_id"), "chunk_id", "left_anti")


def representatives(documents: DataFrame, most: int = 2) -> DataFrame:
    """(company, title, place): titles that stand for a company, filings first."""
    order = Window.partitionBy("company").orderBy(F.when(F.col("category").like("sec_%"), 0).otherwise(1), "doc_id")
    return latest(documents).select("company", "title", "category", "doc_id").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("company", "title", "place")


def latest(documents: DataFrame, key: str = "id", newest: str = "doc_id") -> DataFrame:
    """Last write wins: the newest delivery of each document. Only keys move; no partition holds a whole key's rows."""
    last = documents.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(newest).alias(newest))
    return documents.join(last, [key, newest], "left_semi")


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): how each document of two snapshots (id, fingerprint) fares: unchanged, changed, new or removed."""
    a, b = old.select("id", F.col("fingerprint").alias("was")).withColumn("in_old", F.lit(1)), new.select("id", F.col("fingerprint").alias("now")).withColumn("in_new", F.lit(1))
    kind = F.when(F.col("in_old").isNull(), "new").when(F.col("in_new").isNull(), "removed").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("changed")
    return a.join(b, "id", "full").select("id", kind.alias("change"))


def pruned(stored: DataFrame, kept: DataFrame, errors: bool = False, excluded: DataFrame | None = None) -> DataFrame:
    """The keys to remove from a root: those not kept; after discovery errors only those explicitly excluded."""
    gone = stored.select("id").distinct().join(kept.select("id"), "id", "left_anti")
    return gone.join(excluded.select("id"), "id", "left_semi") if errors and excluded is not None else gone.where("false") if errors else gone


def aliases_of(documents: DataFrame, aliases: DataFrame) -> DataFrame:
    """(company, aliases): every company's aliases, white space put right, distinct and sorted; none is an empty list."""
    tidy = F.trim(F.regexp_replace("alias", r"(?U)\s+", " "))
    docs = documents.select(F.col("id").alias("document_id"), "company").distinct()
    own = docs.join(aliases.select("document_id", tidy.alias("alias")).where("alias <> ''").distinct(), "document_id", "left").select("company", "alias").distinct()
    return own.groupBy("company").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))


def sources(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Each chunk with its document, the release aliases parsed."""
    docs = latest(documents)
    own = once(chunks, "id").withColumnRenamed("id", "chunk_id")
    d = docs.select(F.col("id").alias("document_id"), "company", "title", "category", "publication_date", "source_url", F.from_json("aliases", ALIAS).alias("aliases"))
    return own.join(d, "document_id")


def faults(documents: DataFrame, chunks: DataFrame, vectors: DataFrame, dimension: int = 64) -> DataFrame:
    """(fault, n): integrity checks of a snapshot; a fault that doesn't occur has 0."""
    own = once(chunks, "id")
    orphans = own.join(documents.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti").agg(F.lit("orphan_chunks").alias("fault"), F.count("*").alias("n"))
    twice = own.groupBy("document_id", "ordinal").count().where("count > 1").agg(F.lit("repeated_ordinals").alias("fault"), F.count("*").alias("n"))
    bad = vectors.where((F.col("dimension").isNull()) | (F.col("dimension") != dimension) | F.col("vector").isNull() | (F.size("vector") != dimension)).agg(F.lit("bad_vectors").alias("fault"), F.count("*").alias("n"))
    wrong = own.where("text is not null and sha2(text, 256) <> text_hash").agg(F.lit("wrong_hashes").alias("fault"), F.count("*").alias("n"))
    return orphans.unionAll(twice).unionAll(bad).unionAll(wrong)
