import json

import pytest
from pyspark.sql import functions as F

from quillspark.operators import ranking
from quillspark.plans import search

ROWS = [(1, "d1", "AA", "alpha plan", "sec_x", "2020-01-01", "alpha revenue rose sharply in the north", "h1"), (2, "d1", "AA", "alpha plan", "sec_x", "2020-01-01", "alpha revenue fell", "h2"), (3, "d2", "BB", "beta plan", "news", "2021-01-01", "beta revenue rose and rose", "h3"),
        (4, "d3", "BB", "beta memo", "news", None, "revenue of beta is flat", "h4"), (5, "d4", "CC", "gamma", "news", "2022-01-01", "gamma costs only", "h5"), (6, "d5", "CC", "gamma", "news", "2022-02-01", "revenue gamma revenue", "h6")]


@pytest.fixture(scope="module")
def corpus(spark):
    rows = spark.createDataFrame(ROWS, "chunk_id bigint, document_id string, company string, title string, category string, publication_date string, text string, text_hash string").cache()
    return rows, spark.createDataFrame([(c, c) for c in ("AA", "BB", "CC")] + [("BB", "Beta Works")], "company string, alias string")


def _ask(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)], search.REQUEST)


def test_wrong_requests(spark, corpus):
    good = ("revenue", None, None, None, None, "lexical", 5, "en")
    change = lambda **k: tuple(k.get(n, v) for n, v in zip(("question", "companies", "categories", "date_from", "date_to", "mode", "top_k", "language"), good))
    asked = [good, change(question="  "), change(question="x" * 4_001), change(mode="best"), change(top_k=21), change(top_k=0), change(language="de"), change(date_from="2020-02-30"), change(date_from="2021-01-01", date_to="2020-01-01"), change(companies=["ZZ", "AA"]), change(question=None)]
    out = {r.question_id: r.error for r in search.scoped(_ask(spark, *asked), corpus[1]).collect()}
    assert [out[i] for i in range(1, 12)] == [None, "question", "question", "mode", "top_k", "top_k", "language", "date", "date_order", "unknown company: ZZ", "question"]


def test_scope_and_searches(spark, corpus):
    asked = _ask(spark, ("compare AA with beta works", None, None, None, None, "lexical", 5, "en"), (" costs ", None, None, None, None, "lexical", 5, "en"), ("costs", ["CC", "BB"], None, None, None, "lexical", 5, "en"))
    good = search.scoped(asked, corpus[1])
    assert {r.question_id: r.scope for r in good.collect()} == {1: ["AA", "BB"], 2: None, 3: ["CC", "BB"]}
    later = spark.createDataFrame([(1, ["BB sales", "CC sales", "all", "never"]), (2, ["costs", "costs of CC", "x" * 601]), (3, ["CC alone"])], "question_id bigint, queries array<string>")
    queries = search.query_set(good, later)
    assert {(r.question_id, r.place): r.question for r in queries.collect()} == {(1, 0): "compare AA with beta works", (1, 1): "BB sales", (1, 2): "CC sales", (1, 3): "all", (2, 0): "costs", (2, 1): "costs of CC", (3, 0): "costs", (3, 1): "CC alone"}
    got = sorted((r.question_id, r.place, r.at, r.company) for r in search.searches(good, queries, corpus[1]).collect())
    assert [x for x in got if x[0] == 1] == [(1, 0, 0, "AA"), (1, 0, 1, "BB"), (1, 1, 0, "BB"), (1, 2, 0, "AA"), (1, 2, 1, "BB"), (1, 3, 0, "AA"), (1, 3, 1, "BB")]
    assert [x for x in got if x[0] > 1] == [(2, 0, 0, None), (2, 1, 0, "CC"), (3, 0, 0, "CC"), (3, 0, 1, "BB"), (3, 1, 0, "CC")]


def test_search_reserves_a_place_for_every_search(spark, corpus):
    rows, names = corpus
    asked = _ask(spark, ("revenue rose", ["BB", "AA"], None, None, None, "lexical", 2, "en"), ("revenue", None, ["news"], "2021-01-01", None, "lexical", 5, "zh-CN"), ("revenue", None, None, None, "nope", "lexical", 5, "en"))
    results, about = search.search(asked, rows, names)
    got = [(r.question_id, r.label, r.chunk_id) for r in results.orderBy("question_id", "place").collect()]
    assert got == [(1, "S1", 3), (1, "S2", 1), (2, "S1", 6), (2, "S2", 3)]
    info = {r.question_id: r for r in about.collect()}
    assert info[1].searches == 2 and info[2].warnings == [search.DATES_FILTER] and info[3].error == "date" and info[3].searches == 0
    told = search.messages(about, asked.select("question_id", "language")).collect()
    assert [(r.question_id, r.code) for r in told] == [(2, search.DATES_FILTER)] and "日期" in told[0].message


def test_hybrid_search_uses_both_lists(spark, corpus):
    rows, names = corpus
    cache = spark.createDataFrame([(f"h{i}", [1.0, float(i)]) for i in range(1, 7)], "text_hash string, vector array<float>")
    vectors = lambda q: q.select("question_id", F.array(F.lit(1.0), F.lit(6.0)).cast("array<float>").alias("probe"))
    for mode, first in (("dense", 6), ("hybrid", 5)):
        asked = _ask(spark, ("gamma", None, None, None, None, mode, 3, "en"))
        out = search.search(asked, rows, names, cache, search.Offline(vectors=vectors))[0].orderBy("place").collect()
        assert out[0].chunk_id == first and len(out) == 3
    assert out[0].score == round(1 / 61 + 1 / 62, 6)


def test_comparisons_choose_from_a_pool(spark, corpus):
    rows, names = corpus
    asked = _ask(spark, ("revenue", ["AA", "BB"], None, None, None, "lexical", 1, "en"), ("revenue", None, None, None, None, "lexical", 1, "en"))
    results, _ = search.search(asked, rows, names, pool=True)
    assert {r.question_id: r.n for r in results.groupBy("question_id").agg(F.count("*").alias("n")).collect()} == {1: 4, 2: 1}
    chosen = search.Offline(select=lambda q, sources: [s["label"] for s in sources if s["company"] == "BB"][:1])
    out = {r.question_id: r for r in search.answered(asked, results, rows, chosen).collect()}
    assert out[1].citations[0].label == "S1" and "beta" in out[1].answer and out[1].warnings == []
    wrong = search.Offline(select=lambda q, sources: ["S99"])
    assert {r.question_id: r.warnings for r in search.answered(asked, results, rows, wrong).collect()} == {1: [search.SELECTION_FAILED], 2: []}


def test_answers_are_checked_twice(spark, corpus):
    rows, names = corpus
    asked = _ask(spark, ("alpha revenue", None, None, None, None, "lexical", 3, "en"), ("zebra", None, None, None, None, "lexical", 3, "en"))
    results, _ = search.search(asked, rows, names)
    by = lambda f: {r.question_id: r for r in search.answered(asked, results, rows, search.Offline(answer=f)).collect()}
    fine = '```json\n{"answer": "It rose [S2].", "insufficient_evidence": false, "citations": [{"label": "S2", "quote": "revenue  rose sharply"}]}\n```'
    out = by(lambda q, s, error: fine if error else "not json")
    assert (out[1].attempts, out[1].code, out[1].answer) == (2, None, "It rose [S2].") and out[2].code == search.NO_EVIDENCE
    out = by(lambda q, s, error: fine.replace("sharply", "slowly"))
    assert out[1].code == search.ANSWER_FAILED and out[1].answer is None
    out = by(lambda q, s, error: json.dumps({"answer": "unknown", "insufficient_evidence": True, "citations": []}))
    assert out[1].code == search.INSUFFICIENT
    default = search.answered(asked, results, rows).where("question_id = 1")
    sources = results.join(rows, "chunk_id").select("question_id", "label", "text")
    assert search.quotes_hold(default, sources).first().holds


@pytest.mark.parametrize("bad", ["{", "```json {}", "[]", '{"answer": 1, "insufficient_evidence": false}', '{"answer": "x", "insufficient_evidence": false, "citations": []}', '{"answer": "x [S1]", "insufficient_evidence": false, "citations": []}', '{"answer": "x [S1]", "insufficient_evidence": false, "citations": [{"label": "S1", "quote": "short"}]}', '{"answer": "x [S2]", "insufficient_evidence": false, "citations": [{"label": "S2", "quote": "long enough text"}]}'])
def test_bad_answers(bad):
    with pytest.raises(ValueError):
        search.validated(search.parsed(bad), {"S1": "long enough text"})
    with pytest.raises(ValueError):
        search.selected(["S1", "S3"], ["S1"], 4)
    assert search.selected(["S2", "S1", "S2"], ["S1", "S2"], 1) == ["S2"]


def test_hits_by_mode(spark):
    found = spark.createDataFrame([("a", 1, 1, "X", "2020-01-01", "no"), ("a", 1, 2, "X", "2020-01-01", "big\n profit"), ("b", 1, 1, "Y", None, "big profit")], "mode string, question_id bigint, rank int, company string, publication_date string, text string")
    targets = spark.createDataFrame([(1, 1, "X", ["big profit"])], "question_id bigint, target_id int, company string, terms array<string>")
    assert [tuple(r) for r in search.hits_by_mode(found, targets, "2020-12-31").orderBy("mode").collect()] == [("a", 1, 1.0, 0.5, 0), ("b", 1, 0.0, 0.0, 1)]
    numbers = spark.createDataFrame([(1, "1,250"), (1, "7")], "question_id bigint, number string")
    texts = spark.createDataFrame([(1, 1, "1 2"), (1, 2, "12 50 units")], "question_id bigint, rank int, text string")
    assert {r.number: r.rank for r in search.number_ranks(texts, numbers).collect()} == {"1,250": 2, "7": None}
