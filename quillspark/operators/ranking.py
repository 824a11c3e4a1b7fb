"""Keyword and vector ranking, fusion and diversified selection of a batch of questions.

Scores are summed in a fixed order and rounded before they rank, so results do not depend on partitioning; ties go to the smaller chunk id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import question_terms, tokens
from quillspark.staging import stage

K1, B = 1.2, 0.75
TITLE_WEIGHT = 2.0
LIST_SIZE = 80
RRF_K = 60
PER_DOCUMENT = 3
#: Different questions that are held against all rows at once.
BLOCK = 2_000
#: Rows, and questions, whose scores are in memory at once.
SLICE, STRIP = 2_048, 256


def corpus(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row a chunk with what ranking needs of its document's last delivery; chunks of no document are left out, repeated ones count once."""
    docs = documents.where("id is not null").groupBy("id").agg(F.max_by(F.struct("company", "title", "category", "publication_date"), "doc_id").alias("d")).select(F.col("id").alias("document_id"), "d.*")
    own = chunks.where("id is not null").dropDuplicates(["id"]).select(F.col("id").alias("chunk_id"), "document_id", "ordinal", "text", "text_hash")
    return own.join(docs, "document_id")


def passes(companies: list[str] | None = None, categories: list[str] | None = None, first: str | None = None, last: str | None = None) -> Column:
    """The conjunction of filters; an unknown day never passes a range."""
    found = F.lit(True)
    if companies:
        found &= F.col("company").isin(companies)
    if categories:
        found &= F.col("category").isin(categories)
    if first:
        found &= F.col("publication_date") >= first
    if last:
        found &= F.col("publication_date") <= last
    return found


class Best:
    """The best rows of each question so far: score descending, then the smaller chunk id."""

    def __init__(self, questions: int, most: int):
        self.most = most
        self.least = np.full(questions, -np.inf)
        self.q, self.score, self.chunk = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.more: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, first: int, scores: np.ndarray, chunk: np.ndarray) -> None:
        """scores: a line for each question from the first on, a column for each chunk; -inf is no hit."""
        least = self.least[first : first + len(scores)]
        if scores.shape[1] > self.most:
            least = np.maximum(least, np.partition(scores, -self.most, axis=1)[:, -self.most])
        q, at = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        self.more.append((q + first, scores[q, at], chunk[at]))
        self.waiting += len(q)
        if self.waiting > 1_000_000:
            self.settle()

    def settle(self) -> None:
        q, score, chunk = (np.concatenate(x) for x in zip((self.q, self.score, self.chunk), *self.more))
        at = np.lexsort((chunk, -score, q))
        q = q[at]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        at, q, place = at[place < self.most], q[place < self.most], place[place < self.most]
        self.q, self.score, self.chunk, self.more, self.waiting = q, score[at], chunk[at], [], 0
        full = place == self.most - 1
        self.least[q[full]] = self.score[full]

    def frame(self, ids: np.ndarray) -> pd.DataFrame:
        self.settle()
        return pd.DataFrame({"question_id": ids[self.q], "chunk_id": self.chunk, "score": self.score})


def in_blocks(questions: DataFrame, what: str, ask) -> DataFrame:
    """The union of ask(block) over blocks of different questions (question_id, what), for every question; equal ones are asked once.

    However many there are, the driver holds one block of them at a time.
    """
    asked = stage(questions.where(F.col(what).isNotNull()).groupBy(what).agg(F.min("question_id").alias("first"), F.collect_set("question_id").alias("all")), "asked")
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for n in range(blocks):
        block = asked.where(F.pmod(F.hash("first"), F.lit(blocks)) == n) if blocks > 1 else asked
        found = ask(block.select(F.col("first").alias("question_id"), what))
        if blocks > 1:
            found = stage(found, "ranked")
        out = found if out is None else out.unionByName(found)
    every = asked.select("first", F.explode("all").alias("question_id"))
    return out.withColumnRenamed("question_id", "first").join(every, "first").drop("first")


def bm25(questions: DataFrame, rows: DataFrame, keep: Column | None = None, most: int = LIST_SIZE, group: str | None = None) -> DataFrame:
    """(question_id, chunk_id, score, rank). Corpus statistics are those of all rows, whatever keep filters.

    Questions are asked in blocks. A chunk's token list is cut to the block's terms; every task keeps its own best. A term of several tokens counts where
    they follow one another in the title or in the text.
    """
    by = [group] if group else []
    title, body = tokens(F.concat_ws(" ", "company", "title")), tokens(F.col("text"))
    sized = rows.select("chunk_id", *by, (keep if keep is not None else F.lit(True)).alias("keep"), title.alias("tt"), body.alias("bt"))
    if questions.limit(BLOCK + 1).count() > BLOCK:
        # Joined and cut into tokens once, not for every block.
        sized = stage(sized, "tokens")

    def ask(block: DataFrame) -> DataFrame:
        asked = {r.question_id: r.terms for r in block.select("question_id", question_terms(F.col("question")).alias("terms")).collect()}
        ids = np.array(sorted(asked), np.int64)
        wanted = sorted({t for terms in asked.values() for t in terms})
        at = {t: i for i, t in enumerate(wanted)}
        # Parts are summed in the order of the terms.
        terms = [sorted(at[t] for t in asked[i]) for i in ids]
        phrases = [t for t in wanted if " " in t]

        def of(c):
            found = [F.filter(c, lambda w: w.isin(wanted))]
            for t in phrases:
                # Tokens between marks of their own, so that phrases may overlap.
                line = F.concat(F.lit("\1"), F.array_join(c, "\1\1"), F.lit("\1"))
                found.append(F.array_repeat(F.lit(t), F.regexp_count(line, F.lit("(?=\1" + t.replace(" ", "\1\1") + "\1)"))))
            return F.concat(*found) if phrases else found[0]

        cut = stage(sized.select("chunk_id", *by, F.coalesce("keep", F.lit(False)).alias("keep"), (F.size("tt") + F.size("bt")).alias("len"), of("tt").alias("tt"), of("bt").alias("bt")), "cut")
        stats = cut.agg(F.count("*").alias("n"), F.avg("len").alias("avg")).first()
        df = {r.term: r.df for r in cut.select(F.explode(F.array_distinct(F.concat("tt", "bt"))).alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()}
        weight = np.array([np.log((stats.n - df[t] + 0.5) / (df[t] + 0.5)) if t in df else 0.0 for t in wanted])
        idf = np.where(weight > 0, weight, 1e-6)

        def score(batches):
            best: dict = {}
            for pdf in batches:
                for name, own in pdf.groupby(group, dropna=False) if group else [(None, pdf)]:
                    name = None if name is None or name != name else name
                    held = best.setdefault(name, Best(len(ids), most))
                    for low in range(0, len(own), SLICE):
                        part = own.iloc[low : low + SLICE]
                        f = np.zeros((len(wanted), len(part)))
                        for c, (tt, bt) in enumerate(zip(part.tt, part.bt)):
                            for w in tt:
                                f[at[w], c] += TITLE_WEIGHT
                            for w in bt:
                                f[at[w], c] += 1.0
                        size = K1 * (1 - B + B * part.len.to_numpy() / stats.avg)
                        f = idf[:, None] * f * (K1 + 1) / (f + size)
                        chunk = part.chunk_id.to_numpy()
                        for q in range(0, len(ids), STRIP):
                            s = np.zeros((min(STRIP, len(ids) - q), len(part)))
                            for line, own_terms in zip(s, terms[q : q + STRIP]):
                                for t in own_terms:
                                    line += f[t]
                            held.add(q, np.where(s > 0, np.round(s, 9), -np.inf), chunk)
            for name, held in best.items():
                out = held.frame(ids)
                yield out.assign(**{group: name}) if group else out

        kind = f", {group} {dict(rows.dtypes)[group]}" if group else ""
        hits = cut.where("keep and size(tt) + size(bt) > 0").drop("keep").mapInPandas(score, f"question_id bigint, chunk_id bigint, score double{kind}")
        return top(hits.select("question_id", "chunk_id", *by, "score"), ["question_id", *by], most)

    return in_blocks(questions, "question", ask)


def top(scored: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def usable(vectors: DataFrame, dimension: int) -> DataFrame:
    """Vectors that can be compared, once a text: right length, finite, not all zero."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.where(v.isNotNull() & (F.size(v) == dimension)).where(fine).groupBy("text_hash").agg(F.max("vector").alias("vector"))


def dense(probes: DataFrame, vectors: DataFrame, rows: DataFrame, keep: Column | None = None, most: int = LIST_SIZE) -> DataFrame:
    """(question_id, chunk_id, score, rank): exact cosine of every probe vector (question_id, probe) with every text; filters come before the limit.

    Probes are sent to the vectors in blocks; products run in numpy, and every task keeps its own best before anything moves.
    """
    first = probes.select(F.size("probe").alias("n")).first()
    if first is None:
        return rows.select(F.lit(0).cast("bigint").alias("question_id"), "chunk_id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where("false")
    own = rows.where(keep) if keep is not None else rows
    # Of the chunks with one text, no more than the first can be among the best.
    copies = own.select("chunk_id", "text_hash").withColumn("copy", F.row_number().over(Window.partitionBy("text_hash").orderBy("chunk_id"))).where(F.col("copy") <= most)
    paired = stage(copies.join(usable(vectors, first.n), "text_hash").select("chunk_id", "vector"), "paired")

    def ask(block: DataFrame) -> DataFrame:
        asked = block.orderBy("question_id").collect()
        q = np.array([r.probe for r in asked], np.float64).reshape(-1, first.n)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        ids = np.array([r.question_id for r in asked], np.int64)

        def score(batches):
            best = Best(len(ids), most)
            for pdf in batches:
                for low in range(0, len(pdf), SLICE):
                    x = np.stack(pdf.vector.to_numpy()[low : low + SLICE]).astype(np.float64)
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    for at in range(0, len(q), STRIP):
                        best.add(at, np.round(q[at : at + STRIP] @ x.T, 6), pdf.chunk_id.to_numpy()[low : low + SLICE])
            yield best.frame(ids)

        return top(paired.mapInPandas(score, "question_id bigint, chunk_id bigint, score double"), ["question_id"], most)

    return in_blocks(probes, "probe", ask)


def fused(lists: DataFrame, by: list[str]) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: (by..., chunk_id, score, rank)."""
    score = F.round(F.aggregate(F.array_sort(F.collect_list(F.lit(1.0) / (RRF_K + F.col("rank")))), F.lit(0.0), lambda a, x: a + x), 6)
    return top(lists.groupBy(*by, "chunk_id").agg(score.alias("score")), by, 1 << 30)


def diversified(ranked: DataFrame, rows: DataFrame, by: list[str], most: int = 10, per_document: int = PER_DOCUMENT, reserved: DataFrame | None = None, limits: DataFrame | None = None) -> DataFrame:
    """The first most chunks of each ranking, one a (company, text) and at most per_document a document.

    A fold, not windows: a chunk refused for its document doesn't mark its text as taken. With reserved (by..., list, rank, chunk_id), the first
    chunk of each list that can be taken comes before the rest. limits (by..., most) may lower the number for single rankings.
    """
    ident = rows.select("chunk_id", "document_id", F.concat_ws("\u0001", "company", "text_hash").alias("ident"))
    final = ranked.select(*by, F.lit(1).alias("phase"), F.lit("").alias("list"), "rank", "chunk_id")
    if reserved is not None:
        final = final.unionByName(reserved.select(*by, F.lit(0).alias("phase"), "list", "rank", "chunk_id"))
    items = final.join(ident, "chunk_id")
    one = F.struct("phase", "list", "rank", "chunk_id", F.col("document_id").alias("doc"), "ident")
    fold = f"""aggregate(array_sort(collect_list({{0}})), cast(array() as array<struct<phase:int,list:string,rank:int,chunk_id:bigint,doc:string,ident:string>>),
        (acc, x) -> case when size(acc) < {most} and not exists(acc, y -> y.ident = x.ident) and size(filter(acc, y -> y.doc = x.doc)) < {per_document}
        and not (x.phase = 0 and exists(acc, y -> y.phase = 0 and y.list = x.list)) then concat(acc, array(x)) else acc end)"""
    picked = items.withColumn("item", one).groupBy(*by).agg(F.expr(fold.format("item")).alias("taken"))
    if limits is not None:
        # A fold's first entries are what the fold would have stopped at.
        picked = picked.join(limits, by).withColumn("taken", F.slice("taken", F.lit(1), F.col("most")))
    return picked.select(*by, F.posexplode("taken").alias("p", "t")).select(*by, (F.col("p") + 1).alias("place"), F.col("t.chunk_id").alias("chunk_id"), F.col("t.phase").alias("phase"))
