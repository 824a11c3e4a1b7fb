import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import chunking, evidence, limits, ranking, store
from quillspark.operators.components import connected_components


def test_quota_window_edges():
    w = limits.Rolling()
    assert [w.offer(t) for t in (0, 1, 2, 3, 4)] == [None] * 5
    assert w.offer(4) == 56 and w.offer(59.5) == 1 and w.offer(60) is None


def test_quota_counts_only_accepted():
    w = limits.Rolling(((1, 10.0),))
    assert [w.offer(t) is None for t in (0, 5, 9, 10, 19, 20)] == [True, False, False, True, False, True]


def test_admitted_nulls_and_repeats(spark):
    rows = [(1, None, 0.0), (1, None, 0.0), (2, "a", None), (3, "a", float("nan")), (4, "a", 1.0)]
    out = {r.id: r.accepted for r in limits.admitted(spark.createDataFrame(rows, "id bigint, client string, asked_at double"), ((1, 10.0),)).collect()}
    assert out == {1: True, 2: False, 3: False, 4: True}


WORDS = st.lists(st.text("abcé中 \n", min_size=1, max_size=60), min_size=1, max_size=60)


@given(WORDS, st.integers(200, 400), st.integers(0, 90))
@settings(max_examples=150, deadline=None)
def test_spans_cover_a_text(parts, room, overlap):
    body = "\n".join(parts)
    for back in (None, overlap):
        own, at = list(chunking.spans(body, room, back)), 0
        for a, b in own:
            assert a < b <= a + room and at - (back or 0) <= a <= at
            at = b
        assert at == len(body)


def test_chunks_of_a_table():
    heading, lines = "Region | FY 1998", [f"site {i:03d} | {i * 7}" for i in range(90)]
    out = chunking.cut(heading + chunking.ROWS + "\n".join(lines), "sheet Q", 300, 40)
    assert len(out) > 3 and {t[: len(heading + chunking.ROWS)] for t, _ in out} == {heading + chunking.ROWS} and max(len(t) for t, _ in out) <= 300
    assert sum((t.removeprefix(heading + chunking.ROWS).split("\n") for t, _ in out), []) == lines and out[2][1] == "sheet Q, part 3"
    wide = "w" * 101 + chunking.ROWS + "a | b"
    assert chunking.cut(wide, "sheet Q", 300, 0) == [("w" * 100 + chunking.ROWS + wide, "sheet Q, part 1")]
    assert chunking.cut("only a heading" + chunking.ROWS + "\n", "table 4") == [("only a heading\n[Rows]", "table 4, part 1")]


def test_chunks_of_a_page_and_of_nothing(spark):
    page = "\n".join(f"line {i}" for i in range(100))
    assert all(t.startswith("line 0\nline 1\n") for t, _ in chunking.cut(page, "page 7", 240, 0)) and chunking.cut("short", "page 7", 240, 0) == [("short", "page 7, part 1")]
    assert chunking.cut(None, "x") == chunking.cut(" \r\n\0", "x") == []
    for size, overlap in ((199, 0), (300, 150), (300, -1)):
        with pytest.raises(ValueError):
            chunking.cut("x", "text", size, overlap)
    rows = [("a", 2, "z " * 150, "text"), ("a", 1, "y", None), ("b", 1, None, "text")]
    out = chunking.chunked(chunking.gathered(spark.createDataFrame(rows, "doc_id string, place int, text string, locator string")), 200, 0).orderBy("ordinal").collect()
    assert [(r.doc_id, r.ordinal, r.locator) for r in out] == [("a", 0, "text, part 1"), ("a", 1, "text, part 1"), ("a", 2, "text, part 2")]


def test_clean_and_terms(spark):
    df = spark.createDataFrame([("a\0\r b\n \n\n\nc  ", "What of its Café, CAFE, cafe\u0301 and snow_Ball as _ ?")], "t string, q string")
    r = df.select(tx.clean(df.t).alias("t"), tx.question_terms(df.q).alias("q")).first()
    assert r.t == "a b\n\nc" and r.q == ["cafe", "cafe", "snow ball"]


def _fts(rows, question):
    """Scores of SQLite's full-text index."""
    db = sqlite3.connect(":memory:")
    db.execute("create virtual table f using fts5(title, text, tokenize='unicode61')")
    for i, title, text in rows:
        db.execute("insert into f(rowid, title, text) values (?, ?, ?)", (i, title, text))
    terms = [t for t in dict.fromkeys(w.lower() for w in re.findall(r"\w+", question)) if t not in tx.STOP_WORDS][:40]
    return {r[0]: round(-r[1], 6) for r in db.execute("select rowid, bm25(f, 2.0, 1.0) from f where f match ?", (" OR ".join(f'"{t}"' for t in terms),))}


@pytest.mark.parametrize("question", ["naïve naive profits", "free_cash flow", "Ürün čeština Ångström ﬁ ự", "mass_mass", "its cafe\u0301 of the CAFÉ", "день ἄλφα ΤΕΛΟΣ 中文 ½"])
def test_ranking_agrees_with_sqlite(spark, question):
    texts = ["naive naïve text", "free cash flow", "flow of free, cash", "free_cash and free cash", "urun cestina angstrom ự u", "mass mass mass", "cafe", "café cafe\u0301", "день αλφα τελος 中文 ½ ﬁ", "other", "words here", "nothing at all"]
    own = [(i, f"t{i % 3}", t) for i, t in enumerate(texts, 1)]
    rows = spark.createDataFrame([(i, "d", "Co", t, "c", None, x, str(i)) for i, t, x in own], "chunk_id bigint, document_id string, company string, title string, category string, publication_date string, text string, text_hash string")
    got = {r.chunk_id: r.score for r in ranking.bm25(spark.createDataFrame([(1, question)], "question_id bigint, question string"), rows).collect()}
    want = _fts([(i, f"Co {t}", x) for i, t, x in own], question)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in got)


def test_mentions(spark):
    names = spark.createDataFrame([("QRX", "QRX"), ("QRX", "Quarex (Holding) S.p.A."), ("ELN", "Élan"), ("ELN", "ELN"), ("HUA", "华远"), ("HUA", None), ("HUA", " ")], "company string, alias string")
    asked = {1: "we saw élan today, ÉLAN!", 2: "eln2 and eln_x", 3: "今年华远与qrx的利润", 4: "QUAREX (HOLDING) S.P.A.: why", 5: "Quarex Holding", 6: "", 7: "Élans"}
    out = {r.question_id: r.companies for r in evidence.mentions(spark.createDataFrame(list(asked.items()), "question_id bigint, question string"), names).collect()}
    assert out == {1: ["ELN"], 2: [], 3: ["HUA", "QRX"], 4: ["QRX"], 5: [], 6: [], 7: []}


def test_dates(spark):
    df = spark.createDataFrame([(x,) for x in ("2024-02-29", "2023-02-29", "2023", "2023-13", "2023-07", "soon", None)], "d string")
    day, period = tx.demoted(df.d)
    assert [(r[0], r[1], r[2]) for r in df.select(day, period, tx.day_number(df.d)).collect()] == [("2024-02-29", None, 20240229), ("2023-02-29", None, None), (None, "2023", None), ("2023-13", None, None), (None, "2023-07", None), ("soon", None, None), (None, None, None)]


def test_fold_differs_from_windows(spark):
    ranked = spark.createDataFrame([(1, i + 1, i) for i in range(6)], "q int, rank int, chunk_id bigint")
    rows = spark.createDataFrame([(i, d, "C", h) for i, (d, h) in enumerate([("A", "1"), ("A", "2"), ("A", "3"), ("A", "4"), ("B", "4"), ("B", "1")])], "chunk_id bigint, document_id string, company string, text_hash string")
    out = ranking.diversified(ranked, rows, ["q"]).orderBy("place").collect()
    assert [r.chunk_id for r in out] == [0, 1, 2, 4]


def test_fusion_score(spark):
    lists = spark.createDataFrame([(1, "l", 1, 2), (1, "d", 1, 2), (1, "l", 7, 1)], "q int, list string, chunk_id bigint, rank int")
    out = ranking.fused(lists, ["q"]).orderBy("rank").collect()
    assert (out[0].chunk_id, out[0].score) == (1, round(2 / 62, 6))


def test_filter_keeps_statistics(spark):
    rows = spark.createDataFrame([(i, "d", "A" if i % 2 else "B", "t", "c", None, f"alpha {'beta ' * i}", str(i)) for i in range(1, 6)], "chunk_id bigint, document_id string, company string, title string, category string, publication_date string, text string, text_hash string")
    q = spark.createDataFrame([(1, "beta")], "question_id bigint, question string")
    every = {r.chunk_id: r.score for r in ranking.bm25(q, rows).collect()}
    some = {r.chunk_id: r.score for r in ranking.bm25(q, rows, ranking.passes(["A"])).collect()}
    assert set(some) == {1, 3, 5} and all(every[k] == v for k, v in some.items())
    assert ranking.bm25(q, rows.where("false")).count() == 0


def test_searches_of_any_number(spark):
    """More questions than one block, and than were once allowed: each gets what it gets alone."""
    n = 10_001
    rows = spark.createDataFrame([(i, "d", "A", "t", "c", None, " ".join(f"w{(i * k) % 23}" for k in range(1, 9)), str(i)) for i in range(60)], "chunk_id bigint, document_id string, company string, title string, category string, publication_date string, text string, text_hash string")
    words = spark.range(n).select(F.col("id").alias("question_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), (F.floor(F.col("id") / 24**k) % 24).cast("string")) for k in range(3)]).alias("question"))
    some = F.col("question_id").isin(0, 5_000, 10_000)
    key = lambda df: sorted((r.question_id, r.rank, r.chunk_id, r.score) for r in df.where(some).collect())
    got = ranking.bm25(words, rows, most=5).cache()
    assert got.select("question_id").distinct().count() == n and key(got) == key(ranking.bm25(words.where(some), rows, most=5))
    vectors = spark.createDataFrame([(str(i), [1.0, i / 10, (i % 7) / 3]) for i in range(60)], "text_hash string, vector array<float>")
    probes = spark.range(n).select(F.col("id").alias("question_id"), F.array(F.lit(1.0), F.col("id") / 1_000, (F.col("id") % 5).cast("double")).cast("array<float>").alias("probe"))
    got = ranking.dense(probes, vectors, rows, most=5).cache()
    assert got.count() == 5 * n and key(got) == key(ranking.dense(probes.where(some), vectors, rows, most=5))


def test_store_changes(spark):
    a, b = spark.createDataFrame([("1", "x"), ("2", None), ("3", "z")], "id string, fingerprint string"), spark.createDataFrame([("1", "y"), ("2", None), ("4", "w")], "id string, fingerprint string")
    assert {r.id: r.change for r in store.changes(a, b).collect()} == {"1": "changed", "2": "unchanged", "3": "removed", "4": "new"}


def test_components(spark):
    e = spark.createDataFrame([("e", "d"), ("d", "c"), ("c", "b"), ("b", "a"), ("x", "y"), (None, "q"), ("z", "z")], "a string, b string")
    assert {r.node: r["class"] for r in connected_components(e, "a", "b").collect()} == {**dict.fromkeys("abcde", "a"), "x": "x", "y": "x"}
    assert connected_components(e.where("false"), "a", "b").count() == 0


def test_citations(spark):
    c = spark.createDataFrame([(1, "S1", "gross  profit rose"), (1, "S2", "gross profit rose"), (1, "S1", "rose")], "answer_id int, label string, quote string")
    s = spark.createDataFrame([(1, "S1", "The gross\nprofit rose.")], "answer_id int, label string, text string")
    assert sorted((r.label, r.valid) for r in evidence.checked_citations(c, s).collect()) == [("S1", False), ("S1", True), ("S2", False)]
