"""Entity recognition, query routing, citation checks and retrieval metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import boundary_pattern, compact, normalised

LEAST_QUOTE = 8


def mentions(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """(question_id, companies): companies whose ticker or alias (company, alias) a question holds as a word of its own, sorted.

    Aliases meet a question by their longest word (a word like "the" would be a hot key), not all with all; the exact pattern then decides.
    """
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9_]+|[^\sa-z0-9_]"), F.lit(0))
    longest = F.array_max(F.transform(words("alias"), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    names = aliases.where("alias is not null and trim(alias) <> ''").select("company", "alias").distinct().withColumn("key", longest).where("key is not null")
    keys = F.array_distinct(words("question"))
    asked = questions.select("question_id", "question", F.explode(keys).alias("key"))
    hit = asked.join(names.withColumn("pattern", boundary_pattern(F.col("alias"))), "key").where("question rlike pattern")
    found = hit.groupBy("question_id").agg(F.array_sort(F.collect_set("company")).alias("companies"))
    return questions.select("question_id").join(found, "question_id", "left").select("question_id", F.coalesce("companies", F.array().cast("array<string>")).alias("companies"))


def routed(queries: DataFrame, groups: DataFrame, named: DataFrame) -> DataFrame:
    """(question_id, place, company): the searches of each sub-query: later ones that name companies search only those, the others every group."""
    q = queries.join(named.withColumnRenamed("companies", "own"), ["question_id", "place"], "left").join(groups, "question_id", "left")
    where = F.when((F.col("place") > 0) & (F.size("own") > 0), F.col("own")).otherwise(F.col("companies"))
    return q.select("question_id", "place", F.explode_outer(where).alias("company"))


def checked_citations(citations: DataFrame, sources: DataFrame) -> DataFrame:
    """(answer_id, label, valid): a citation's label must be known and its quote, white space aside, be long enough and stand in that source."""
    quote = normalised(F.col("quote"))
    both = citations.join(sources.select("answer_id", "label", F.col("text").alias("source_text")), ["answer_id", "label"], "left")
    fine = F.col("source_text").isNotNull() & (F.char_length(quote) >= LEAST_QUOTE) & normalised(F.col("source_text")).contains(quote)
    return both.select("answer_id", "label", F.coalesce(fine, F.lit(False)).alias("valid"))


def label_agreement(answers: DataFrame) -> DataFrame:
    """(answer_id, agrees): whether the labels in an answer's text are exactly those it cites, and at least one unless it declines."""
    inline = F.array_sort(F.array_distinct(F.regexp_extract_all("answer", F.lit(r"\[(S\d+)\]"), F.lit(1))))
    cited = F.array_sort(F.array_distinct("cited"))
    return answers.select("answer_id", ((inline == cited) & (F.col("insufficient_evidence") | (F.size(cited) > 0))).alias("agrees"))


def first_hits(results: DataFrame, targets: DataFrame) -> DataFrame:
    """(question_id, target_id, rank): the first result (question_id, rank, company, text) of the target's company that holds all its terms, or null."""
    t = targets.select("question_id", "target_id", F.col("company").alias("want"), "terms")
    norm = results.select("question_id", "rank", "company", normalised(F.col("text")).alias("body"))
    hit = norm.join(t, "question_id").where((F.col("company") == F.col("want")) & F.expr("forall(terms, x -> contains(body, x))"))
    return t.join(hit.groupBy("question_id", "target_id").agg(F.min("rank").alias("rank")), ["question_id", "target_id"], "left").select("question_id", "target_id", "rank")


def metrics(hits: DataFrame, within: int = 10) -> DataFrame:
    """One row: cases, the share whose targets are all found within the first, and the mean reciprocal rank of targets."""
    per = hits.groupBy("question_id").agg(F.min((F.col("rank").isNotNull() & (F.col("rank") <= within)).cast("int")).alias("hit"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))
    return per.agg(F.count("*").alias("cases"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.round(F.avg("mrr"), 6).alias("mrr"))


def violations(results: DataFrame, company: str, last: str) -> DataFrame:
    """(question_id, wrong): results of another company or without a day up to last."""
    bad = ~F.col("company").eqNullSafe(company) | F.col("publication_date").isNull() | (F.col("publication_date") > last)
    return results.groupBy("question_id").agg(F.sum(bad.cast("int")).alias("wrong"))


def holds_number(text, number):
    return compact(text).contains(compact(number))
