"""A batch of search requests, from validation to labelled evidence and checked answers. Models are plugged in; the defaults work offline."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import normalised, real_day
from quillspark.operators import evidence, ranking
from quillspark.staging import stage

# Bounds of a request, of its later queries, and of the pool that a comparison of companies chooses from.
MOST_QUESTION, MOST_RESULTS, MOST_REWRITES, MOST_REWRITE, POOL = 4_000, 20, 3, 600, 48
MODES, LANGUAGES = ("hybrid", "lexical", "dense"), ("en", "zh-CN")
REQUEST = "question_id bigint, question string, companies array<string>, categories array<string>, date_from string, date_to string, mode string, top_k int, language string"
#: Codes of warnings and outcomes.
REWRITE_FAILED, DATES_FILTER, SELECTION_FAILED, ANSWER_FAILED, NO_EVIDENCE, INSUFFICIENT = "query_rewrite_unavailable", "publication_date_filter", "comparison_selection_unavailable", "answer_validation_failed", "no_evidence", "insufficient_evidence"
# Own wording of what the codes say, by language.
MESSAGES = [
    ("en", REWRITE_FAILED, "The question was searched as asked; it could not be rewritten."), ("zh-CN", REWRITE_FAILED, "问题未能改写，已按原文检索。"),
    ("en", DATES_FILTER, "Dates limit when a document was published, not what period it covers; undated documents are left out."), ("zh-CN", DATES_FILTER, "日期限制的是发布日期而非所属期间；日期不明的文件已排除。"),
    ("en", SELECTION_FAILED, "Evidence for the comparison was taken in order of rank."), ("zh-CN", SELECTION_FAILED, "对比所用证据按排名选取。"),
    ("en", ANSWER_FAILED, "The answer did not agree with its sources and is withheld."), ("zh-CN", ANSWER_FAILED, "回答与来源不符，未予展示。"),
    ("en", NO_EVIDENCE, "Nothing was found within these filters."), ("zh-CN", NO_EVIDENCE, "在所选范围内未找到证据。"),
    ("en", INSUFFICIENT, "The evidence found does not answer the question."), ("zh-CN", INSUFFICIENT, "所得证据不足以回答该问题。"),
]


def request_error(question: Column, mode: Column, top_k: Column, first: Column, last: Column, language: Column, most: int = MOST_RESULTS) -> Column:
    """What is wrong with a request, or null."""
    day = lambda d: d.isNull() | (d == "") | real_day(d)
    blank = question.isNull() | (F.length(F.regexp_replace(question, r"(?U)^\s+", "")) == 0)
    return (
        F.when(blank | (F.length(question) > MOST_QUESTION), "question")
        .when(mode.isNull() | ~mode.isin(*MODES), "mode").when(top_k.isNull() | ~top_k.between(1, most), "top_k").when(language.isNull() | ~language.isin(*LANGUAGES), "language")
        .when(~day(first) | ~day(last), "date").when((F.coalesce(first, F.lit("")) != "") & (F.coalesce(last, F.lit("")) != "") & (first > last), "date_order")
    )


def scoped(requests: DataFrame, names: DataFrame) -> DataFrame:
    """Requests with ``scope``: the companies asked for, or else those the question names, or else null for all; and ``error`` where one is unknown or the
    request is wrong. names: (company, alias), tickers among the aliases."""
    given = F.array_distinct(F.filter("companies", lambda c: c.isNotNull()))
    own = requests.withColumn("given", F.when(F.size(given) > 0, given))
    known = names.select("company").distinct()
    asked = own.where("given is not null").select("question_id", F.explode("given").alias("company"))
    unknown = asked.join(known, "company", "left_anti").groupBy("question_id").agg(F.array_sort(F.collect_set("company")).alias("unknown"))
    named = evidence.mentions(own.where("given is null and question is not null").select("question_id", "question"), names)
    both = own.join(unknown, "question_id", "left").join(named.withColumnRenamed("companies", "named"), "question_id", "left")
    wrong = request_error(F.col("question"), F.col("mode"), F.col("top_k"), F.col("date_from"), F.col("date_to"), F.col("language"))
    scope = F.coalesce("given", F.when(F.size("named") > 0, F.col("named")))
    return both.select(*requests.columns, F.when(F.col("unknown").isNull(), scope).alias("scope"), F.coalesce(wrong, F.when(F.col("unknown").isNotNull(), F.concat(F.lit("unknown company: "), F.array_join("unknown", ", ")))).alias("error"))


def query_set(requests: DataFrame, rewrites: DataFrame | None = None) -> DataFrame:
    """(question_id, place, question): the question itself, trimmed, then at most three different later ones of rewrites (question_id, queries)."""
    own = requests.select("question_id", F.regexp_replace("question", r"(?U)^\s+|\s+$", "").alias("q"))
    if rewrites is None:
        return own.select("question_id", F.lit(0).alias("place"), F.col("q").alias("question"))
    later = F.filter(F.slice("queries", 1, MOST_REWRITES), lambda x: x.isNotNull() & F.length(x).between(1, MOST_REWRITE))
    both = own.join(rewrites, "question_id", "left")
    every = F.array_distinct(F.concat(F.array("q"), F.coalesce(later, F.array().cast("array<string>"))))
    return both.select("question_id", F.posexplode(every).alias("place", "question"))


def searches(requests: DataFrame, queries: DataFrame, names: DataFrame) -> DataFrame:
    """(question_id, place, question, at, company): one search a company, in the order given, where several are in scope; later queries that name companies of the scope search those
    alone; a null company searches the whole scope."""
    key = queries.withColumn("key", F.xxhash64("question_id", "place"))
    named = evidence.mentions(key.where("place > 0").select(F.col("key").alias("question_id"), "question"), names).select(F.col("question_id").alias("key"), F.col("companies").alias("named"))
    all_of = key.join(requests.select("question_id", "scope"), "question_id").join(named, "key", "left")
    own = F.when(F.col("scope").isNull(), F.col("named")).otherwise(F.array_intersect("named", "scope"))
    groups = F.when(F.size("scope") > 1, F.col("scope"))
    where = F.when((F.col("place") > 0) & (F.size(own) > 0), own).otherwise(groups)
    return all_of.select("question_id", "place", "question", F.posexplode(F.coalesce(where, F.array(F.lit(None).cast("string")))).alias("at", "company"))


@dataclass
class Offline:
    """What a search needs of models. Each may be replaced: rewrites and vectors are tables, select and answer functions of one request's evidence."""

    rewrites: DataFrame | None = None
    vectors: Callable[[DataFrame], DataFrame] | None = None
    select: Callable[[str, list[dict]], list[str]] | None = None
    answer: Callable[[str, list[dict], str | None], str] = field(default=lambda question, sources, error: quoting(question, sources))


def search(requests: DataFrame, rows: DataFrame, names: DataFrame, cache: DataFrame | None = None, models: Offline | None = None, pool: bool = False) -> tuple[DataFrame, DataFrame]:
    """(results, about). results: (question_id, place, label, chunk_id, score) in order. about: (question_id, error, scope, queries, searches, warnings).

    rows: ranking.corpus(); cache: vectors of texts, for dense and hybrid requests, whose question vectors models.vectors gives. Requests of one filter are
    searched together; statistics are those of all rows.
    """
    models = models or Offline()
    good = stage(scoped(requests, names), "requests")
    fine = good.where("error is null")
    queries = stage(query_set(fine, models.rewrites), "queries")
    plan = stage(searches(fine, queries, names), "searches")
    filters = fine.select("question_id", F.array_sort("scope").alias("scope"), F.array_sort("categories").alias("categories"), F.nullif("date_from", F.lit("")).alias("date_from"), F.nullif("date_to", F.lit("")).alias("date_to"), "mode")
    key = lambda: F.xxhash64("question_id", "place").alias("qp")
    asked = plan.select("question_id", "place", "question", "at", "company", key()).join(filters, "question_id")
    lists = None
    for f in filters.select("scope", "categories", "date_from", "date_to", "mode").distinct().collect():
        same = lambda c: F.col(c).eqNullSafe(F.lit(f[c]) if not isinstance(f[c], list) else F.array(*map(F.lit, f[c])))
        own = asked.where(same("scope") & same("categories") & same("date_from") & same("date_to") & same("mode"))
        keep = ranking.passes(None, f.categories, f.date_from, f.date_to)
        for single in (True, False):
            part = own.where(F.col("company").isNotNull() == single).select("question_id", "place", "at", "qp", "question", "company")
            if part.isEmpty():
                continue
            # A search of one company is the ranking of its own chunks; else that of the whole scope.
            inside = keep if single or not f.scope else keep & F.col("company").isin(f.scope)
            by = ["company"] if single else []
            found = []
            if f.mode != "dense":
                found.append(("lexical", ranking.bm25(part.select(F.col("qp").alias("question_id"), "question").distinct(), rows, inside, group="company" if single else None)))
            if f.mode != "lexical" and cache is not None and models.vectors is not None:
                probes = models.vectors(part.select(F.col("qp").alias("question_id"), "question").distinct())
                for company in [r.company for r in part.select("company").distinct().collect()] if single else [None]:
                    near = ranking.dense(probes, cache, rows, inside & (F.col("company") == company) if single else inside)
                    found.append(("dense", near.withColumn("company", F.lit(company)) if single else near))
            for name, ranked in found:
                one = ranked.withColumnRenamed("question_id", "qp").join(part.select("qp", "question_id", "place", "at", *by), ["qp", *by])
                one = one.select("question_id", "place", "at", F.lit(name).alias("list"), "chunk_id", "rank")
                lists = one if lists is None else lists.unionByName(one)
    if lists is None:
        lists = rows.sparkSession.createDataFrame([], "question_id bigint, place int, at int, list string, chunk_id bigint, rank int")
    lists = stage(lists, "lists")
    total = ranking.fused(lists, ["question_id"])
    group = F.concat_ws("|", F.lpad(F.col("place").cast("string"), 3, "0"), F.lpad(F.col("at").cast("string"), 6, "0"))
    sub = ranking.fused(lists.withColumn("list", group), ["question_id", "list"]).select("question_id", "list", "rank", "chunk_id")
    most = F.when(F.lit(pool) & (F.size("scope") > 1), POOL).otherwise(F.col("top_k"))
    # Whether a document's chunks are limited depends on the request: comparisons choose later.
    picked = None
    for wide in (True, False) if pool else (False,):
        ids = fine.where((F.size("scope") > 1) if wide else (F.coalesce(F.size("scope"), F.lit(0)) <= 1) if pool else F.lit(True)).select("question_id")
        some = ranking.diversified(total.join(ids, "question_id"), rows, ["question_id"], POOL if wide else MOST_RESULTS, 1 << 20 if wide else ranking.PER_DOCUMENT, sub.join(ids, "question_id"), limits=fine.select("question_id", most.cast("int").alias("most")))
        picked = some if picked is None else picked.unionByName(some)
    results = picked.join(total.select("question_id", "chunk_id", "score"), ["question_id", "chunk_id"]).select("question_id", "place", F.concat(F.lit("S"), "place").alias("label"), "chunk_id", "score")
    n = plan.groupBy("question_id").agg(F.count("*").alias("searches"))
    texts = queries.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "question"))), lambda x: x["question"]).alias("queries"))
    dated = (F.coalesce("date_from", F.lit("")) != "") | (F.coalesce("date_to", F.lit("")) != "")
    about = good.join(texts, "question_id", "left").join(n, "question_id", "left").select("question_id", "error", "scope", "queries", F.coalesce("searches", F.lit(0)).alias("searches"), F.when(dated & F.col("error").isNull(), F.array(F.lit(DATES_FILTER))).otherwise(F.array().cast("array<string>")).alias("warnings"))
    return results, about


def messages(about: DataFrame, languages: DataFrame) -> DataFrame:
    """(question_id, code, message) of warnings in the language of each request (question_id, language)."""
    table = about.sparkSession.createDataFrame(MESSAGES, "language string, code string, message string")
    return about.select("question_id", F.explode("warnings").alias("code")).join(languages, "question_id").join(F.broadcast(table), ["language", "code"]).select("question_id", "code", "message")


# --- answers -----------------------------------------------------------------------------------------------------------------------------------


def parsed(text: str) -> dict:
    """JSON, fenced or not. A fence that isn't closed is an error."""
    text = text.strip()
    fenced = re.fullmatch(r"```[^\n]*\n(.*)```", text, re.S)
    if text.startswith("```") and not fenced:
        raise ValueError("the fence is not closed")
    return json.loads(fenced[1] if fenced else text)


def selected(labels, supplied: list[str], most: int) -> list[str]:
    """The labels a selector chose, each once; anything but supplied labels is an error."""
    if not isinstance(labels, list) or not all(isinstance(x, str) and x in supplied for x in labels):
        raise ValueError("labels that were not supplied")
    return list(dict.fromkeys(labels))[:most]


def validated(payload, sources: dict[str, str]) -> dict:
    """An answer whose quotes stand in their sources, white space aside, and whose inline labels are those it cites; else an error.

    An answer without citations has to decline; its wording is then that of the outcome.
    """
    squeeze = lambda s: " ".join(s.split())
    if not isinstance(payload, dict) or not isinstance(payload.get("answer"), str) or not isinstance(payload.get("insufficient_evidence"), bool):
        raise ValueError("an answer has to have a text and say whether evidence is insufficient")
    cited = payload.get("citations") or []
    for c in cited:
        quote = c.get("quote") if isinstance(c, dict) else None
        if not isinstance(quote, str) or c.get("label") not in sources or len(squeeze(quote)) < evidence.LEAST_QUOTE or squeeze(quote) not in squeeze(sources[c["label"]]):
            raise ValueError(f"citation that does not stand in its source: {c}")
    labels = {c["label"] for c in cited}
    if set(re.findall(r"\[(S\d+)\]", payload["answer"])) != labels or not labels and not payload["insufficient_evidence"]:
        raise ValueError("inline labels and citations differ")
    code = None if labels else INSUFFICIENT
    return {"answer": payload["answer"] if labels else None, "code": code, "insufficient": payload["insufficient_evidence"], "citations": [(c["label"], c["quote"]) for c in cited]}


def quoting(question: str, sources: list[dict]) -> str:
    """An offline answer: the first sentence of the best source that shares most words with the question, quoted."""
    words = {w for w in re.findall(r"\w+", question.lower()) if len(w) > 3}
    best = max(((len(words & set(re.findall(r"\w+", s.lower()))), -i, s.strip(), x["label"]) for i, x in enumerate(sources) for s in re.split(r"(?<=[.!?。！？])\s*|\n", x["text"]) if len(" ".join(s.split())) >= evidence.LEAST_QUOTE), default=None)
    if best is None or best[0] == 0:
        return json.dumps({"answer": "", "insufficient_evidence": True, "citations": []})
    return json.dumps({"answer": f"{best[2]} [{best[3]}]", "insufficient_evidence": False, "citations": [{"label": best[3], "quote": best[2]}]})


ANSWER = "question_id bigint, answer string, code string, insufficient boolean, attempts int, citations array<struct<label:string,quote:string>>, warnings array<string>"


def answered(requests: DataFrame, results: DataFrame, rows: DataFrame, models: Offline | None = None) -> DataFrame:
    """One answer a request: from the evidence found, checked, with one more attempt where a check fails. Evidence is gathered a request at a time, of which there are at most the pool's 48."""
    models = models or Offline()
    chosen = results.join(rows.select("chunk_id", "company", "text"), "chunk_id")
    every = chosen.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("place", "label", "company", "text"))).alias("sources"))
    both = requests.select("question_id", "question", "top_k").join(every, "question_id", "left")
    select, answer = models.select, models.answer

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for i, question, most, found in zip(pdf.question_id, pdf.question, pdf.top_k, pdf.sources):
                sources, warned = [dict(label=s["label"], company=s["company"], text=s["text"]) for s in (found if found is not None else ())], []
                if select is not None and len({s["company"] for s in sources}) > 1:
                    try:
                        labels = selected(select(question, sources), [s["label"] for s in sources], int(most))
                        sources = [next(s for s in sources if s["label"] == x) for x in labels]
                    except (ValueError, TypeError, KeyError, RuntimeError):
                        warned.append(SELECTION_FAILED)
                sources = [s | {"label": f"S{n}"} for n, s in enumerate(sources[: int(most)], 1)]
                if not sources:
                    out.append((i, None, NO_EVIDENCE, True, 0, [], warned))
                    continue
                error, done = None, None
                for attempt in (1, 2):
                    try:
                        done = validated(parsed(answer(question, sources, error)), {s["label"]: s["text"] for s in sources})
                        break
                    except (ValueError, TypeError, AttributeError) as e:
                        error = str(e)
                if done is None:
                    out.append((i, None, ANSWER_FAILED, True, attempt, [], [*warned, ANSWER_FAILED]))
                else:
                    out.append((i, done["answer"], done["code"], done["insufficient"], attempt, [{"label": a, "quote": b} for a, b in done["citations"]], warned))
            yield pd.DataFrame(out, columns=["question_id", "answer", "code", "insufficient", "attempts", "citations", "warnings"])

    return both.mapInPandas(run, ANSWER)


def quotes_hold(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """(question_id, holds): the same check as columns, over answers (question_id, answer, insufficient, citations) and sources (question_id, label, text)."""
    one = answers.select("question_id", F.posexplode_outer("citations").alias("at", "c")).select("question_id", "at", "c.label", "c.quote")
    both = one.join(sources, ["question_id", "label"], "left")
    fine = F.col("at").isNull() | ((F.length(normalised(F.col("quote"))) >= evidence.LEAST_QUOTE) & normalised(F.col("text")).contains(normalised(F.col("quote"))))
    each = both.groupBy("question_id").agg(F.every(F.coalesce(fine, F.lit(False))).alias("quotes"))
    labels = F.array_sort(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(S\d+)\]"), F.lit(1))))
    cited = F.array_sort(F.array_distinct(F.transform("citations", lambda c: c["label"])))
    agree = (F.coalesce(labels, F.array().cast("array<string>")) == cited) & (F.col("insufficient") | (F.size(cited) > 0))
    return answers.select("question_id", agree.alias("agree")).join(each, "question_id").select("question_id", (F.col("agree") & F.col("quotes")).alias("holds"))


def hits_by_mode(found: DataFrame, targets: DataFrame, last: str, within: int = 10) -> DataFrame:
    """(mode, cases, hit_rate, mrr, violations): results (mode, question_id, rank, company, publication_date, text) against targets (question_id, target_id, company, terms)."""
    t = targets.select("question_id", "target_id", F.col("company").alias("want"), "terms")
    modes = found.select("mode").distinct()
    body = found.select("mode", "question_id", "rank", "company", "publication_date", normalised(F.col("text")).alias("body"))
    hit = body.join(t, "question_id").where((F.col("company") == F.col("want")) & F.expr("forall(terms, x -> contains(body, x))"))
    best = t.join(modes).join(hit.groupBy("mode", "question_id", "target_id").agg(F.min("rank").alias("rank")), ["mode", "question_id", "target_id"], "left")
    per = best.groupBy("mode", "question_id").agg(F.min(F.coalesce(F.col("rank") <= within, F.lit(False)).cast("int")).alias("hit"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))
    wants = t.select("question_id", "want").distinct().groupBy("question_id").agg(F.collect_set("want").alias("wants"))
    bad = body.join(wants, "question_id").where(~F.array_contains("wants", F.col("company")) | F.col("publication_date").isNull() | (F.col("publication_date") > last)).groupBy("mode").agg(F.count("*").alias("violations"))
    return per.groupBy("mode").agg(F.count("*").alias("cases"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("mrr"), 6).alias("mrr")).join(bad, "mode", "left").select("mode", "cases", "hit_rate", "mrr", F.coalesce("violations", F.lit(0)).alias("violations"))


def number_ranks(found: DataFrame, numbers: DataFrame) -> DataFrame:
    """(question_id, number, rank): the first result (question_id, rank, text) that holds each expected number, white space and commas aside; null for none."""
    from quillspark.functions.text import compact

    both = numbers.join(found, "question_id").where(compact(F.col("text")).contains(compact(F.col("number")))).groupBy("question_id", "number").agg(F.min("rank").alias("rank"))
    return numbers.join(both, ["question_id", "number"], "left").select("question_id", "number", "rank")

