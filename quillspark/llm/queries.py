"""The pN_ queries. Each takes (spark, sf_dir)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_repaired(spark, d):
    from .scans import repair

    found = repair(_t(spark, d, "chunks"), _t(spark, d, "page_proofs"))
    return found.where("lines_deleted + hyphens_deleted + words_changed > 0").dropDuplicates(["chunk_id"])


def p1_found(spark, d):
    from .scans import repair

    found = repair(_t(spark, d, "chunks"), _t(spark, d, "page_proofs"))
    return found.where("lines_deleted + hyphens_deleted + words_changed > 0").select("chunk_id").distinct()


def p2_found(spark, d):
    from .neardups import near_pairs

    return near_pairs(_t(spark, d, "chunks")).select("text_hash_a", "text_hash_b")


def p2_groups(spark, d):
    from .neardups import near_groups

    return near_groups(_t(spark, d, "chunks"))


def p3_found(spark, d):
    from .history import repeats

    return repeats(_t(spark, d, "documents"), _t(spark, d, "chunks"))


def p3_batches(spark, d):
    from .history import repeats_by_batch

    return repeats_by_batch(_t(spark, d, "documents"), _t(spark, d, "chunks"))


def p4_found(spark, d):
    from .splitting import split_chunks

    return split_chunks(_t(spark, d, "chunks")).where("parts > 1").select("chunk_id").distinct()


def p4_pieces(spark, d):
    from .splitting import split_chunks

    return split_chunks(_t(spark, d, "chunks"))


def p5_found(spark, d):
    from .neighbours import mutual, nearest

    return mutual(nearest(_t(spark, d, "vector_cache")))


def p5_neighbours(spark, d):
    from .neighbours import nearest

    return nearest(_t(spark, d, "vector_cache")).select("text_hash", "neighbour", F.round("cosine", 5).alias("cosine"), "rank")


def p6_found(spark, d):
    from .languages import unnamed

    return unnamed(_t(spark, d, "documents"), _t(spark, d, "chunks"), _t(spark, d, "lang_labels"))


def p6_passages(spark, d):
    from .languages import label_passages

    return label_passages(_t(spark, d, "documents"), _t(spark, d, "chunks"), _t(spark, d, "lang_labels"))


def p6_documents(spark, d):
    from .languages import label_documents

    return label_documents(_t(spark, d, "documents"), _t(spark, d, "chunks"), _t(spark, d, "lang_labels"))


def p7_ids(spark, d):
    from .tokens import encode_corpus

    return encode_corpus(_t(spark, d, "documents"))


def p8_containers(spark, d):
    from quillspark.staging import stage

    from .packing import fill_containers
    from .tokens import encode_corpus

    sizes = stage(encode_corpus(_t(spark, d, "documents"), count=True).withColumnRenamed("ids", "tokens"), "sizes")
    return fill_containers(sizes, _t(spark, d, "token_budgets"))


def p9_found(spark, d):
    from .encodings import restore

    return restore(_t(spark, d, "documents")).where("lines_restored > 0 or lost > 0").select("doc_id").distinct()


def p9_restored(spark, d):
    from .encodings import restore

    return restore(_t(spark, d, "documents")).where("lines_restored > 0 or lost > 0")


QUERIES = {f.__name__: f for f in (p1_found, p1_repaired, p2_found, p2_groups, p3_found, p3_batches, p4_found, p4_pieces, p5_found, p5_neighbours, p6_found, p6_passages, p6_documents, p7_ids, p8_containers, p9_found, p9_restored)}

_HEX = "right(regexp_replace(regexp_replace(lower({0}), '^\\s*(sha[-_]?[0-9]+[-_:=\\s]+|[a-z][a-z0-9_-]*\\s*[:=]\\s*|0x)', ''), '[^0-9a-f]', '', 'g'), 64)"

SQL = {
    "p3_found": f"""WITH d AS (SELECT DISTINCT doc_id, id, coalesce(batch_no, 0) AS b, nullif({_HEX.format('content_hash')}, '') AS ch, nullif({_HEX.format('fingerprint')}, '') AS fp FROM documents),
s AS (SELECT DISTINCT d.doc_id, d.b, c.text_hash FROM d JOIN chunks c ON c.document_id = d.id), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.text_hash = y.text_hash AND x.doc_id < y.doc_id AND (x.b > 0 OR y.b > 0) GROUP BY 1, 2)
SELECT a AS doc_id_a, b AS doc_id_b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 2 * k > na.n AND 2 * k > nb.n
UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.ch = y.ch AND x.doc_id < y.doc_id AND (x.b > 0 OR y.b > 0)
UNION SELECT x.doc_id, y.doc_id FROM d x JOIN d y ON x.fp = y.fp AND x.doc_id < y.doc_id AND (x.b > 0 OR y.b > 0)""",
    "p4_found": "SELECT DISTINCT id AS chunk_id FROM chunks WHERE length(text) > 2600",
}
