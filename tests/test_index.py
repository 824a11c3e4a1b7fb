import pytest
from pyspark.sql import functions as F

from quillspark.operators import index, limits

DOCS = "doc_id bigint, id string, company string, category string, publication_date string"
CHUNKS = "id bigint, document_id string, text_hash string"


def _store(spark):
    docs = spark.createDataFrame([(1, "a", "A", "x", "2020-01-02"), (2, "b", "B", "y", None), (3, "a", "A2", "x", "2021-02-30")], DOCS)
    chunks = spark.createDataFrame([(1, "a", "h1"), (2, "a", "h2"), (2, "a", "h2"), (3, "b", "h3"), (4, "b", "h4")], CHUNKS)
    vectors = spark.createDataFrame([("h1", [1.0, 2.0]), ("h2", [0.0, 0.0]), ("h3", [3.0, 4.0]), ("h4", None)], "text_hash string, vector array<float>")
    return docs, chunks, vectors


def test_insert_absent(spark):
    old, new = spark.createDataFrame([("a", "1")], "k string, v string"), spark.createDataFrame([("a", "2"), ("b", "3"), ("b", "3"), (None, "4")], "k string, v string")
    assert sorted(map(tuple, index.insert_absent(old, new, "k").collect())) == [("a", "1"), ("b", "3")]


def test_replacing_takes_all_chunks_along(spark):
    docs, chunks, _ = _store(spark)
    arriving = spark.createDataFrame([(9, "b", "B", "y", None), (10, "c", "C", "y", None), (11, None, "D", "y", None)], DOCS)
    d, c, log = index.replaced(docs, chunks, arriving, spark.createDataFrame([(7, "b", "h7"), (8, "c", "h8"), (5, "zz", "h5")], CHUNKS))
    assert sorted(r.doc_id for r in d.collect()) == [1, 3, 9, 10] and sorted(r.id for r in c.collect()) == [1, 2, 7, 8] and sorted(r.chunk_id for r in log.collect()) == [3, 4, 7, 8]


def test_replay_is_repeatable(spark):
    docs, chunks, vectors = _store(spark)
    old = spark.createDataFrame([(1, "OLD", None, "h0", None), (99, "OLD", None, "h9", None)], index.INDEX)
    pending = spark.createDataFrame([(1,), (2,), (3,), (4,), (99,), (None,)], "chunk_id bigint")
    new, left = index.replayed(old, pending, chunks, docs, vectors, 2)
    want = [(1, "A2", "x", "h1", None), (3, "B", "y", "h3", None)]
    assert sorted(map(tuple, new.collect())) == want and sorted(r.chunk_id for r in left.collect()) == [2, 4]
    assert sorted(map(tuple, index.replayed(new, pending, chunks, docs, vectors, 2)[0].collect())) == want
    assert [r.chunk_id for r in index.stale(old, chunks).orderBy("chunk_id").collect()] == [1, 99]


def test_gate(spark):
    docs, chunks, vectors = _store(spark)
    meta = spark.createDataFrame([("qdrant_target", "t"), ("embedding_identity", "m")], "meta_key string, meta_value string")
    full = chunks.select(F.col("id").alias("chunk_id")).distinct()
    none = spark.createDataFrame([], "chunk_id bigint")
    ask = lambda i, w, t: index.gate(i, chunks, w, t, meta).first()
    assert ask(full, none, "t").complete and not ask(full, none, "u").complete and ask(full, none, "u").points == 0
    assert not ask(full, full, "t").complete and not ask(full.where("chunk_id > 1"), none, "t").complete
    assert index.gate(none, chunks.where("false"), none, "u", meta).first().complete
    assert not index.identity_allows(meta, vectors, "n").first().allowed and index.identity_allows(meta, vectors, "m").first().allowed and index.identity_allows(meta, vectors.where("false"), "n").first().allowed


def test_embedding_calls_are_bounded(spark):
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        assert len(texts) <= index.CALL_TEXTS and sum(map(len, texts)) <= index.CALL_CHARS
        seen.add(1)
        return [[3.0, float(len(t))] for t in texts]

    texts = spark.createDataFrame([(str(i), "x" * (1 + i * 30)) for i in range(150)] + [("7", "again")], "text_hash string, text string").coalesce(1)
    out = index.embedded(texts, embed, 2).collect()
    assert len(out) == 150 and all(abs(sum(v * v for v in r.vector) - 1) < 1e-6 for r in out) and seen.value >= 6
    for bad in (lambda t: [[0.0, 0.0]] * len(t), lambda t: [[1.0]] * len(t), lambda t: [[1.0, float("inf")]] * len(t), lambda t: []):
        with pytest.raises(Exception, match="vectors have to be"):
            index.embedded(texts, bad, 2).collect()
    with pytest.raises(Exception, match="a text to embed"):
        index.embedded(spark.createDataFrame([("a", " ")], "text_hash string, text string"), embed).collect()


def test_versions_and_bundles(spark, tmp_path):
    kept = index.Versions(spark, str(tmp_path / "table"))
    assert kept.read() is None
    for n in range(4):
        kept.write(spark.range(n))
    assert kept.numbers() == [3, 4] and kept.read().count() == 3
    (tmp_path / "table/v9").mkdir()
    assert kept.read().count() == 3
    tables, keys = {"a": spark.range(5), "b": spark.range(0)}, {"a": ["id"], "b": ["id"]}
    out = {r.table: (r.rows, r.digest) for r in index.exported(tables, str(tmp_path / "bundle"), keys).collect()}
    again = {r.table: (r.rows, r.digest) for r in index.manifest({"a": spark.range(5).repartition(3), "b": spark.range(0)}, keys).collect()}
    assert out == again and out["a"][0] == 5 and out["b"] == (0, 0)
    with pytest.raises(FileExistsError):
        index.exported(tables, str(tmp_path / "bundle"), keys)
    with pytest.raises(Exception):
        index.exported({"a": spark.range(3).select(F.raise_error(F.lit("no")).alias("id"))}, str(tmp_path / "broken"), keys)
    assert not (tmp_path / "broken").exists()


def test_login_attempts(spark):
    rows = [(i, "ip", float(i)) for i in range(12)] + [(99, "ip", 60.5), (98, None, 1.0)]
    out = {r.id: (r.accepted, r.retry_after) for r in limits.admitted(spark.createDataFrame(rows, "id bigint, client string, asked_at double"), limits.LOGIN).collect()}
    assert all(out[i] == (True, None) for i in range(10)) and out[10] == (False, 50) and out[11] == (False, 49) and out[99] == (True, None) and out[98] == (True, None)


def test_the_stream_decides_as_the_batch(spark, tmp_path):
    from quillspark.streaming.admission import admitted_stream

    schema = "id bigint, client string, asked_at double"
    rows = [(i, "abc"[i % 3] if i % 10 else None, float(i * 7 % 90 + 60 * (i // 20))) for i in range(60)]
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20] + rows[n * 20 : n * 20 + 3] + [(900 + n, "a", None)], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = admitted_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")), ((4, 60.0),))
    stream.writeStream.format("memory").queryName("admitted").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r.id: r.accepted for r in spark.table("admitted").collect()}
    assert spark.table("admitted").count() == 63 and set(got) == {*range(60), 900, 901, 902} and not got[900]
    # Triggers are the files; within one, the fold is that of the batch.
    first = {r.id: r.accepted for r in limits.admitted(spark.createDataFrame(rows[:20], schema), ((4, 60.0),)).collect()}
    assert {i: got[i] for i in range(20)} == first
