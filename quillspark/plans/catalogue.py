"""The queries over the driver's tables, and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as tx
from quillspark.operators import chunking, evidence, limits, ranking, store

# Questions asked of the corpus: id, text.
QUESTIONS = [
    (1, "What was the free cash flow before dividends in coastal markets?"),
    (2, "How did net working capital outside the home market develop?"),
    (3, "Währungsbereinigt der Frachtkostenanteil im Geschäftsfeld"),
    (4, "margen operativo ajustado a la fecha de cierre"),
    (5, "pension deficit partly offset by higher energy surcharges"),
    (6, "forward-looking remarks and assumptions that can prove wrong"),
]
# Later queries of question 1: place, text.
REWRITES = [(1, 0, "free cash flow before dividends"), (1, 1, "dividends of KVR2"), (1, 2, "coastal markets")]
COMPANIES = ["VPF2", "KVR2", "MHS7", "GWH5"]
CATEGORIES = ["results", "press_releases", "quarterly_results"]
FIRST, LAST = "2015-01-01", "2022-12-31"
DIMENSION = 64
EVERY = 20


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "question_id bigint, question string")


def _rows(spark, d):
    return ranking.corpus(_t(spark, d, "chunks"), _t(spark, d, "documents"))


def _probes(spark, d):
    """Five stored vectors serve as question vectors: those of the least text hashes."""
    own = ranking.usable(_t(spark, d, "vector_cache"), DIMENSION).orderBy("text_hash").limit(5)
    from pyspark.sql import Window

    return own.select(F.row_number().over(Window.orderBy("text_hash")).cast("bigint").alias("question_id"), F.col("vector").alias("probe"))


def _batch_questions(spark, d):
    return _rows(spark, d).where(f"chunk_id % {EVERY} = 0 and title is not null").select(F.col("chunk_id").alias("question_id"), F.col("title").alias("question"))


def _batch_probes(spark, d):
    own = _t(spark, d, "chunks").where(f"id % {EVERY} = 0").dropDuplicates(["id"]).select(F.col("id").alias("question_id"), "text_hash")
    return own.join(ranking.usable(_t(spark, d, "vector_cache"), DIMENSION), "text_hash").select("question_id", F.col("vector").alias("probe"))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_C = "c AS (SELECT DISTINCT * FROM chunks WHERE id IS NOT NULL)"
_D = "d AS (SELECT * FROM documents WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) = 1)"
_LATEST = "d AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) = 1)"
_V = "v AS (SELECT text_hash, max(vector) AS vector FROM vector_cache WHERE vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0 GROUP BY 1)"


@_query(f"""WITH {_C}, v AS (SELECT DISTINCT text_hash FROM vector_cache WHERE vector IS NOT NULL), p AS (SELECT DISTINCT chunk_id FROM vector_pending)
SELECT (SELECT count(DISTINCT id) FROM documents) AS documents, (SELECT count(*) FROM c) AS chunks, (SELECT count(*) FROM c WHERE text_hash IN (SELECT text_hash FROM v)) AS embedded,
(SELECT count(*) FROM p) AS pending, (SELECT count(*) FROM c WHERE text_hash IN (SELECT text_hash FROM v) AND id NOT IN (SELECT chunk_id FROM p)) AS indexed""")
def stats_overview(spark, d):
    return store.overview(_t(spark, d, "documents"), _t(spark, d, "chunks"), _t(spark, d, "vector_cache"), _t(spark, d, "vector_pending"))


@_query(f"WITH {_C}, e AS (SELECT DISTINCT id, company FROM documents) SELECT e.company, count(DISTINCT e.id) AS documents, count(c.id) AS chunks FROM e LEFT JOIN c ON c.document_id = e.id GROUP BY 1")
def company_stats(spark, d):
    return store.by_company(_t(spark, d, "documents"), _t(spark, d, "chunks"))


@_query(f"WITH {_C} SELECT c.id AS chunk_id FROM c WHERE text_hash IN (SELECT text_hash FROM vector_cache WHERE vector IS NOT NULL)")
def chunks_embedded(spark, d):
    return store.once(_t(spark, d, "chunks"), "id").join(_t(spark, d, "vector_cache").where("vector is not null").select("text_hash").distinct(), "text_hash", "left_semi").select(F.col("id").alias("chunk_id"))


@_query("SELECT text_hash, min(id) AS chunk_id FROM chunks WHERE text_hash NOT IN (SELECT text_hash FROM vector_cache WHERE vector IS NOT NULL) GROUP BY 1")
def chunks_pending(spark, d):
    return store.unembedded(_t(spark, d, "chunks"), _t(spark, d, "vector_cache"))


@_query("SELECT text_hash, min(id) AS chunk_id, count(DISTINCT id) AS copies FROM chunks GROUP BY 1")
def unique_texts(spark, d):
    return _t(spark, d, "chunks").groupBy("text_hash").agg(F.min("id").alias("chunk_id"), F.countDistinct("id").alias("copies"))


@_query("SELECT DISTINCT id AS chunk_id, sha256(text) AS computed, sha256(text) = text_hash AS agrees FROM chunks")
def text_hashes(spark, d):
    own = F.sha2("text", 256)
    return store.once(_t(spark, d, "chunks"), "id").select(F.col("id").alias("chunk_id"), own.alias("computed"), (own == F.col("text_hash")).alias("agrees"))


@_query(f"WITH {_D} SELECT company, title, place::INT AS place FROM (SELECT company, title, row_number() OVER (PARTITION BY company ORDER BY CASE WHEN category LIKE 'sec_%' THEN 0 ELSE 1 END, doc_id) AS place FROM d) WHERE place <= 2")
def title_representatives(spark, d):
    return store.representatives(_t(spark, d, "documents"))


@_query(f"WITH {_C}, {_D} SELECT c.id AS chunk_id, d.company, d.category, d.publication_date FROM c JOIN d ON d.id = c.document_id WHERE d.company IN {tuple(COMPANIES)} AND d.category IN {tuple(CATEGORIES)} AND d.publication_date >= '{FIRST}' AND d.publication_date <= '{LAST}'")
def filter_company_category_date(spark, d):
    return _rows(spark, d).where(ranking.passes(COMPANIES, CATEGORIES, FIRST, LAST)).select("chunk_id", "company", "category", "publication_date")


@_query(f"""WITH {_C}, p AS (SELECT DISTINCT chunk_id FROM vector_pending), v AS (SELECT DISTINCT text_hash FROM vector_cache WHERE vector IS NOT NULL)
SELECT p.chunk_id, CASE WHEN c.id IS NULL THEN 'delete' ELSE 'upsert' END AS action FROM p LEFT JOIN c ON c.id = p.chunk_id LEFT JOIN v ON v.text_hash = c.text_hash WHERE c.id IS NULL OR v.text_hash IS NOT NULL ORDER BY 1 LIMIT 128""")
def sync_batch(spark, d):
    return store.sync_batch(_t(spark, d, "vector_pending"), _t(spark, d, "chunks"), _t(spark, d, "vector_cache"))


@_query(f"""WITH {_C}, p AS (SELECT DISTINCT chunk_id FROM vector_pending), v AS (SELECT DISTINCT text_hash FROM vector_cache WHERE vector IS NOT NULL),
b AS (SELECT p.chunk_id FROM p LEFT JOIN c ON c.id = p.chunk_id LEFT JOIN v ON v.text_hash = c.text_hash WHERE c.id IS NULL OR v.text_hash IS NOT NULL ORDER BY 1 LIMIT 128)
SELECT chunk_id FROM p WHERE chunk_id NOT IN (SELECT chunk_id FROM b)""")
def pending_after_sync(spark, d):
    return store.still_pending(_t(spark, d, "vector_pending"), sync_batch(spark, d))


@_query("SELECT id AS chunk_id FROM chunks UNION SELECT chunk_id FROM vector_pending")
def pending_union(spark, d):
    return _t(spark, d, "chunks").select(F.col("id").alias("chunk_id")).union(_t(spark, d, "vector_pending").select("chunk_id")).distinct()


#: The whole batch of searches: the titles, and the vectors, of all chunks whose id is divisible by EVERY.
_BATCH_Q = f"SELECT c.id, d.title FROM c JOIN d ON d.id = c.document_id WHERE c.id % {EVERY} = 0 AND d.title IS NOT NULL"
_BATCH_P = f"SELECT c.id AS question_id, vector AS probe FROM c JOIN v ON v.text_hash = c.text_hash WHERE c.id % {EVERY} = 0"


def _bm25_sql(where: str = "true", by: str = "question_id", asked: str | None = None) -> str:
    asked = asked or "VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUESTIONS)
    letters = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżž", "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzz"
    fold = lambda x: f"regexp_replace(translate(lower({x}), '{letters[0]}ς', '{letters[1]}σ'), '[\u0300-\u0362]', '', 'g')"
    token = "[\\p{L}\\p{N}\\p{Co}]+"
    return f"""{_C}, {_D}, q(question_id, question) AS ({asked}),
w0 AS (SELECT question_id, regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}_]+') AS ws FROM q),
w1 AS (SELECT question_id, unnest(list_filter(ws, lambda w, i: list_position(ws, w) = i AND w NOT IN ('the', 'a', 'an', 'of', 'in', 'to', 'for', 'and', 'or', 'is', 'was', 'were', 'what', 'how', 'did', 'does', 'by', 'with', 'on', 'as', 'its', 'it', 'at', 'from'))[1:40]) AS w FROM w0),
terms AS (SELECT question_id::BIGINT AS question_id, array_to_string(regexp_extract_all({fold('w')}, '{token}'), ' ') AS term FROM w1),
r AS (SELECT c.id AS chunk_id, d.company, d.title, d.category, d.publication_date, c.document_id, c.text_hash, c.text, regexp_extract_all({fold("concat_ws(' ', d.company, d.title)")}, '{token}') AS tt, coalesce(regexp_extract_all({fold('c.text')}, '{token}'), []) AS bt FROM c JOIN d ON d.id = c.document_id),
s AS (SELECT count(*) AS rows_n, avg(len(tt) + len(bt)) AS avg_len FROM r),
u AS (SELECT chunk_id, len(tt) + len(bt) AS len, unnest(list_concat(list_transform(tt, lambda x: {{'t': x, 'w': 2.0::DOUBLE}}), list_transform(bt, lambda x: {{'t': x, 'w': 1.0::DOUBLE}}))) AS h FROM r),
ph AS (SELECT DISTINCT term, chr(1) || replace(term, ' ', chr(1) || chr(1)) || chr(1) AS m FROM terms WHERE contains(term, ' ')),
lines AS (SELECT chunk_id, len(tt) + len(bt) AS len, chr(1) || array_to_string(tt, chr(1) || chr(1)) || chr(1) AS lt, chr(1) || array_to_string(bt, chr(1) || chr(1)) || chr(1) AS lb FROM r WHERE EXISTS (FROM ph)),
fp AS (SELECT chunk_id, len, term, (2.0::DOUBLE * (length(lt) - length(replace(lt, m, ''))) + length(lb) - length(replace(lb, m, ''))) / length(m) AS f FROM lines, ph WHERE contains(lt, m) OR contains(lb, m)),
f AS (SELECT chunk_id, len, h.t AS term, sum(h.w) AS f FROM u WHERE h.t IN (SELECT term FROM terms) GROUP BY 1, 2, 3 UNION ALL SELECT * FROM fp),
n AS (SELECT term, count(*) AS df FROM f GROUP BY 1),
i AS (SELECT term, CASE WHEN ln((rows_n - df + 0.5) / (df + 0.5)) > 0 THEN ln((rows_n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END AS idf, avg_len FROM n, s),
b AS (SELECT question_id, f.chunk_id, round(sum(idf * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * len / avg_len)) ORDER BY terms.term), 9) AS score FROM f JOIN i USING (term) JOIN terms USING (term) GROUP BY 1, 2),
lex AS (SELECT b.question_id, b.chunk_id, score, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, b.chunk_id)::INT AS rank FROM b JOIN r ON r.chunk_id = b.chunk_id WHERE {where} QUALIFY rank <= 80)"""


@_query(f"WITH {_bm25_sql()} SELECT * FROM lex")
def bm25_questions(spark, d):
    return ranking.bm25(_questions(spark), _rows(spark, d))


@_query(f"WITH {_bm25_sql(f'''r.company IN {tuple(COMPANIES)} AND r.publication_date <= '{LAST}' ''')} SELECT * FROM lex")
def bm25_filtered(spark, d):
    return ranking.bm25(_questions(spark), _rows(spark, d), ranking.passes(COMPANIES, last=LAST))


# Words that fold to one token, and words that are a phrase of tokens.
PHRASES = [(1, "Prévision prevision annuelle"), (2, "cash_flow outside_the home market"), (3, "The FREE_CASH flow, its été and ete"), (4, "Élan ÉLAN e_lan _ __")]


@_query(f"WITH {_bm25_sql(asked='VALUES ' + ', '.join(f'({i}, {chr(39)}{q}{chr(39)})' for i, q in PHRASES))} SELECT * FROM lex")
def bm25_phrases(spark, d):
    return ranking.bm25(spark.createDataFrame(PHRASES, "question_id bigint, question string"), _rows(spark, d))


def _dense_sql(where: str = "true", asked: str = "SELECT row_number() OVER (ORDER BY text_hash) AS question_id, vector AS probe FROM (SELECT * FROM v ORDER BY text_hash LIMIT 5)") -> str:
    return f"""{_V}, pr AS ({asked}),
den0 AS (SELECT question_id, c.id AS chunk_id, round(list_cosine_similarity(vector::DOUBLE[], probe::DOUBLE[]), 6) AS score FROM c JOIN d ON d.id = c.document_id JOIN v ON v.text_hash = c.text_hash, pr WHERE {where}),
den AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id)::INT AS rank FROM den0 QUALIFY rank <= 80)"""


@_query(f"WITH {_C}, {_D}, {_dense_sql()} SELECT * FROM den")
def dense_topk(spark, d):
    return ranking.dense(_probes(spark, d), _t(spark, d, "vector_cache"), _rows(spark, d))


@_query(f"WITH {_C}, {_D}, {_dense_sql(f'''d.category IN {tuple(CATEGORIES)} AND d.publication_date >= '{FIRST}' ''')} SELECT * FROM den")
def dense_filtered(spark, d):
    return ranking.dense(_probes(spark, d), _t(spark, d, "vector_cache"), _rows(spark, d), ranking.passes(None, CATEGORIES, FIRST))


@_query("SELECT DISTINCT text_hash, coalesce(vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0, false) AS usable FROM vector_cache")
def vector_validity(spark, d):
    v = F.col("vector")
    fine = (F.size(v) == DIMENSION) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return _t(spark, d, "vector_cache").select("text_hash", F.coalesce(fine, F.lit(False)).alias("usable")).distinct()


def _lists(spark, d, batch: bool = False):
    rows = _rows(spark, d)
    lex = ranking.bm25(_batch_questions(spark, d) if batch else _questions(spark), rows).select("question_id", F.lit("lexical").alias("list"), "chunk_id", "rank")
    return rows, lex.unionByName(ranking.dense(_batch_probes(spark, d) if batch else _probes(spark, d), _t(spark, d, "vector_cache"), rows).select("question_id", F.lit("dense").alias("list"), "chunk_id", "rank"))


def _fused_sql(lex: str, den: str) -> str:
    return f"""{lex}, {den}, both_lists AS (SELECT question_id, 'lexical' AS list, chunk_id, rank FROM lex UNION ALL SELECT question_id, 'dense', chunk_id, rank FROM den),
rrf0 AS (SELECT question_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score FROM both_lists GROUP BY 1, 2),
rrf AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id)::INT AS rank FROM rrf0)"""


_FUSED = _fused_sql(_bm25_sql(), _dense_sql())
_BATCH = _fused_sql(_bm25_sql(asked=_BATCH_Q), _dense_sql(asked=_BATCH_P))


@_query(f"WITH {_FUSED} SELECT * FROM rrf")
def rrf_hybrid(spark, d):
    return ranking.fused(_lists(spark, d)[1], ["question_id"])


@_query(f"""WITH {_bm25_sql(f'r.company IN {tuple(COMPANIES)}', 'question_id, r.company')}
SELECT r.company, lex.question_id, lex.chunk_id, round(1.0::DOUBLE / (60 + rank), 6) AS score, row_number() OVER (PARTITION BY r.company, question_id ORDER BY round(1.0::DOUBLE / (60 + rank), 6) DESC, lex.chunk_id)::INT AS rank FROM lex JOIN r ON r.chunk_id = lex.chunk_id""")
def rrf_per_company(spark, d):
    lists = ranking.bm25(_questions(spark), _rows(spark, d), ranking.passes(COMPANIES), group="company")
    return ranking.fused(lists.select("company", "question_id", "chunk_id", "rank"), ["company", "question_id"])


def _greedy_sql(items: str) -> str:
    return f"""items AS ({items}), seq AS (SELECT question_id, list({{'phase': phase, 'list': list, 'rank': rank, 'chunk_id': chunk_id, 'doc': document_id, 'ident': company || chr(1) || text_hash}} ORDER BY phase, list, rank, chunk_id) AS xs FROM items JOIN r USING (chunk_id) GROUP BY 1),
fold AS (SELECT question_id, list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: CASE WHEN len(a) < 10 AND len(list_filter(a, lambda y: y.ident = x[1].ident)) = 0 AND len(list_filter(a, lambda y: y.doc = x[1].doc)) < 3
AND NOT (x[1].phase = 0 AND len(list_filter(a, lambda y: y.phase = 0 AND y.list = x[1].list)) > 0) THEN list_concat(a, x) ELSE a END) AS taken FROM seq)
SELECT question_id, unnest(range(1, len(taken) + 1))::INT AS place, unnest(list_transform(taken, lambda t: t.chunk_id)) AS chunk_id, unnest(list_transform(taken, lambda t: t.phase)) AS phase FROM fold"""


@_query(f"WITH {_FUSED}, {_greedy_sql('''SELECT question_id, 1 AS phase, '' AS list, rank, chunk_id FROM rrf''')}")
def greedy_selection(spark, d):
    rows, lists = _lists(spark, d)
    return ranking.diversified(ranking.fused(lists, ["question_id"]), rows, ["question_id"])


@_query(f"WITH {_FUSED}, {_greedy_sql('''SELECT question_id, 1 AS phase, '' AS list, rank, chunk_id FROM rrf UNION ALL SELECT question_id, 0, list, rank, chunk_id FROM both_lists''')}")
def reserved_selection(spark, d):
    rows, lists = _lists(spark, d)
    return ranking.diversified(ranking.fused(lists, ["question_id"]), rows, ["question_id"], reserved=lists)


@_query(f"WITH {_bm25_sql(asked=_BATCH_Q)} SELECT * FROM lex")
def bm25_questions_batch(spark, d):
    return ranking.bm25(_batch_questions(spark, d), _rows(spark, d))


@_query(f"WITH {_bm25_sql(f'''r.company IN {tuple(COMPANIES)} AND r.publication_date <= '{LAST}' ''', asked=_BATCH_Q)} SELECT * FROM lex")
def bm25_filtered_batch(spark, d):
    return ranking.bm25(_batch_questions(spark, d), _rows(spark, d), ranking.passes(COMPANIES, last=LAST))


@_query(f"WITH {_C}, {_D}, {_dense_sql(asked=_BATCH_P)} SELECT * FROM den")
def dense_topk_batch(spark, d):
    return ranking.dense(_batch_probes(spark, d), _t(spark, d, "vector_cache"), _rows(spark, d))


@_query(f"WITH {_C}, {_D}, {_dense_sql(f'''d.category IN {tuple(CATEGORIES)} AND d.publication_date >= '{FIRST}' ''', _BATCH_P)} SELECT * FROM den")
def dense_filtered_batch(spark, d):
    return ranking.dense(_batch_probes(spark, d), _t(spark, d, "vector_cache"), _rows(spark, d), ranking.passes(None, CATEGORIES, FIRST))


@_query(f"WITH {_BATCH} SELECT * FROM rrf")
def rrf_hybrid_batch(spark, d):
    return ranking.fused(_lists(spark, d, True)[1], ["question_id"])


@_query(f"""WITH {_bm25_sql(f'r.company IN {tuple(COMPANIES)}', 'question_id, r.company', _BATCH_Q)}
SELECT r.company, lex.question_id, lex.chunk_id, round(1.0::DOUBLE / (60 + rank), 6) AS score, row_number() OVER (PARTITION BY r.company, question_id ORDER BY round(1.0::DOUBLE / (60 + rank), 6) DESC, lex.chunk_id)::INT AS rank FROM lex JOIN r ON r.chunk_id = lex.chunk_id""")
def rrf_per_company_batch(spark, d):
    lists = ranking.bm25(_batch_questions(spark, d), _rows(spark, d), ranking.passes(COMPANIES), group="company")
    return ranking.fused(lists.select("company", "question_id", "chunk_id", "rank"), ["company", "question_id"])


@_query(f"WITH {_BATCH}, {_greedy_sql('''SELECT question_id, 1 AS phase, '' AS list, rank, chunk_id FROM rrf''')}")
def greedy_selection_batch(spark, d):
    rows, lists = _lists(spark, d, True)
    return ranking.diversified(ranking.fused(lists, ["question_id"]), rows, ["question_id"])


@_query(f"WITH {_BATCH}, {_greedy_sql('''SELECT question_id, 1 AS phase, '' AS list, rank, chunk_id FROM rrf UNION ALL SELECT question_id, 0, list, rank, chunk_id FROM both_lists''')}")
def reserved_selection_batch(spark, d):
    rows, lists = _lists(spark, d, True)
    return ranking.diversified(ranking.fused(lists, ["question_id"]), rows, ["question_id"], reserved=lists)


def _names(spark, d):
    docs = _t(spark, d, "documents").select(F.col("id").alias("document_id"), "company").distinct()
    alias = _t(spark, d, "company_aliases").select("document_id", F.trim(F.regexp_replace("alias", r"(?U)\s+", " ")).alias("alias"))
    return docs.join(alias, "document_id").select("company", "alias").union(docs.select("company", F.col("company").alias("alias"))).where("alias <> ''").distinct()


_NAMES = "names AS (SELECT DISTINCT company, trim(regexp_replace(alias, '[\\s\\p{Z}]+', ' ', 'g')) AS alias FROM documents JOIN company_aliases ON document_id = id UNION SELECT DISTINCT company, company FROM documents)"


@_query(f"""WITH {_NAMES}, t AS (SELECT doc_id AS question_id, title AS question FROM documents WHERE title IS NOT NULL),
h AS (SELECT DISTINCT question_id, company FROM t JOIN names ON contains(lower(question), lower(alias)) AND regexp_matches(question, '(?i)(^|[^A-Za-z0-9_])' || regexp_escape(alias) || '([^A-Za-z0-9_]|$)') WHERE alias <> '')
SELECT t.question_id, coalesce(list(company ORDER BY company) FILTER (WHERE company IS NOT NULL), []) AS companies FROM t LEFT JOIN h USING (question_id) GROUP BY 1""")
def entity_mentions(spark, d):
    asked = _t(spark, d, "documents").where("title is not null").select(F.col("doc_id").alias("question_id"), F.col("title").alias("question"))
    return evidence.mentions(asked, _names(spark, d))


@_query("SELECT * FROM (VALUES (1::BIGINT, 0, 'VPF2'), (1, 0, 'MHS7'), (1, 1, 'KVR2'), (1, 2, 'VPF2'), (1, 2, 'MHS7')) t(question_id, place, company)")
def subquery_routing(spark, d):
    later = spark.createDataFrame(REWRITES, "question_id bigint, place int, question string")
    names = _t(spark, d, "documents").select("company", F.col("company").alias("alias")).distinct()
    key = later.select((F.col("question_id") * 1000 + F.col("place")).alias("question_id"), "question")
    named = evidence.mentions(key, names).select(F.floor(F.col("question_id") / 1000).alias("question_id"), (F.col("question_id") % 1000).cast("int").alias("place"), "companies")
    groups = spark.createDataFrame([(1, ["VPF2", "MHS7"])], "question_id bigint, companies array<string>")
    return evidence.routed(later, groups, named)


@_query(f"""WITH {_C} SELECT c.id AS answer_id, 'S' || ordinal AS label, length(trim(regexp_replace(substr(text, 11, 60), '[\\s\\p{{Z}}]+', ' ', 'g'))) >= 8
AND contains(trim(regexp_replace(CASE WHEN id % 3 = 0 THEN locator ELSE text END, '[\\s\\p{{Z}}]+', ' ', 'g')), trim(regexp_replace(substr(text, 11, 60), '[\\s\\p{{Z}}]+', ' ', 'g'))) AS valid FROM c WHERE locator IS NOT NULL""")
def citation_check(spark, d):
    own = store.once(_t(spark, d, "chunks"), "id").where("locator is not null").select(F.col("id").alias("answer_id"), F.concat(F.lit("S"), "ordinal").alias("label"), "text", "locator")
    quotes = own.select("answer_id", "label", F.substring("text", 11, 60).alias("quote"))
    # Every third source is the locator instead, which no quote of the text stands in.
    return evidence.checked_citations(quotes, own.select("answer_id", "label", F.when(F.col("answer_id") % 3 == 0, F.col("locator")).otherwise(F.col("text")).alias("text")))


@_query("SELECT doc_id AS answer_id, CASE WHEN doc_id % 4 = 0 THEN false ELSE true END AS agrees FROM documents")
def answer_labels(spark, d):
    a = _t(spark, d, "documents").select(F.col("doc_id").alias("answer_id"))
    cited = F.when(F.col("answer_id") % 4 == 0, F.array(F.lit("S1"))).when(F.col("answer_id") % 4 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("S2"), F.lit("S1")))
    text = F.when(F.col("answer_id") % 4 == 1, F.lit("not in evidence")).otherwise(F.concat(F.lit("grew [S1] then fell [S2], see [S1] for "), F.col("answer_id").cast("string")))
    return evidence.label_agreement(a.select("answer_id", text.alias("answer"), cited.alias("cited"), (F.col("answer_id") % 4 == 1).alias("insufficient_evidence")))


def _found(spark, d):
    rows = _rows(spark, d)
    return ranking.bm25(_questions(spark), rows, most=10).join(rows, "chunk_id").select("question_id", "rank", "chunk_id", "company", "publication_date", "text")


_TERMS = [(1, 1, "free cash flow"), (2, 1, "net working capital"), (3, 1, "Frachtkostenanteil"), (4, 1, "operativo ajustado"), (5, 1, "pension deficit"), (6, 1, "forward-looking")]
_WANT = ", ".join(f"({q}, {t}, '{w}')" for q, t, w in _TERMS)


@_query(f"""WITH {_bm25_sql()}, x AS (SELECT question_id, rank, company, trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')) AS body FROM lex JOIN r USING (chunk_id) WHERE rank <= 10),
t(question_id, target_id, term) AS (VALUES {_WANT}), g AS (SELECT question_id, arg_min(company, r.chunk_id) AS want FROM t JOIN r ON contains(trim(regexp_replace(r.text, '[\\s\\p{{Z}}]+', ' ', 'g')), term) GROUP BY 1),
h AS (SELECT t.question_id, t.target_id, min(rank) AS rank FROM t LEFT JOIN g USING (question_id) LEFT JOIN x ON x.question_id = t.question_id AND x.company = g.want AND contains(body, term) GROUP BY 1, 2),
p AS (SELECT question_id, min(CASE WHEN rank IS NOT NULL THEN 1 ELSE 0 END) AS hit, avg(coalesce(1.0::DOUBLE / rank, 0)) AS mrr FROM h GROUP BY 1)
SELECT count(*) AS cases, round(avg(hit), 6) AS hit_rate, round(avg(mrr), 6) AS mrr FROM p""")
def eval_hit_mrr(spark, d):
    targets = _targets(spark, d)
    return evidence.metrics(evidence.first_hits(_found(spark, d), targets))


def _targets(spark, d):
    """What each question is to find: its term, in a chunk of the company that has the corpus's first chunk with it."""
    want = spark.createDataFrame([(q, t, [w], w) for q, t, w in _TERMS], "question_id bigint, target_id int, terms array<string>, term string")
    # Six terms, written above, are held against every chunk.
    holds = _rows(spark, d).select("chunk_id", "company", tx.normalised(F.col("text")).alias("body")).join(F.broadcast(want), F.expr("contains(body, term)"))
    first = holds.groupBy("question_id").agg(F.min_by("company", "chunk_id").alias("company"))
    return want.drop("term").join(first, "question_id", "left")


_MODES = f"""WITH {_bm25_sql()}, cut AS (SELECT b.question_id, b.chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, b.chunk_id) AS rank FROM b JOIN r USING (chunk_id) WHERE r.publication_date >= '{FIRST}' AND r.publication_date <= '{LAST}'),
m AS (SELECT 'lexical' AS mode, question_id, chunk_id, rank FROM lex WHERE rank <= 10 UNION ALL SELECT 'dated', question_id, chunk_id, rank FROM cut WHERE rank <= 10),
x AS (SELECT mode, question_id, rank, company, publication_date, trim(regexp_replace(text, '[\\s\\p{{Z}}]+', ' ', 'g')) AS body FROM m JOIN r USING (chunk_id)), t(question_id, target_id, term) AS (VALUES {_WANT}),
g AS (SELECT question_id, arg_min(company, r.chunk_id) AS want FROM t JOIN r ON contains(trim(regexp_replace(r.text, '[\\s\\p{{Z}}]+', ' ', 'g')), term) GROUP BY 1),
h AS (SELECT mode, t.question_id, min(rank) FILTER (WHERE x.company = g.want AND contains(body, term)) AS rank, count(*) FILTER (WHERE x.company IS DISTINCT FROM g.want OR publication_date IS NULL OR publication_date > '{LAST}') AS bad FROM t LEFT JOIN g USING (question_id) JOIN x ON x.question_id = t.question_id GROUP BY 1, 2)
SELECT mode, count(*) AS cases, round(avg(CASE WHEN rank IS NOT NULL THEN 1 ELSE 0 END), 6) AS hit_rate, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 6) AS mrr, sum(bad)::BIGINT AS violations FROM h GROUP BY 1"""


@_query(_MODES)
def eval_by_mode(spark, d):
    from quillspark.plans import search

    rows = _rows(spark, d)
    lists = ranking.bm25(_questions(spark), rows, most=10).select(F.lit("lexical").alias("mode"), "question_id", "chunk_id", "rank")
    lists = lists.unionByName(ranking.bm25(_questions(spark), rows, ranking.passes(None, None, FIRST, LAST), most=10).select(F.lit("dated").alias("mode"), "question_id", "chunk_id", "rank"))
    found = lists.join(rows, "chunk_id").select("mode", "question_id", "rank", "company", "publication_date", "text")
    return search.hits_by_mode(found, _targets(spark, d), LAST)


@_query(f"WITH {_bm25_sql()} SELECT question_id, sum(CASE WHEN company IS DISTINCT FROM 'KVR2' OR publication_date IS NULL OR publication_date > '{LAST}' THEN 1 ELSE 0 END)::BIGINT AS wrong FROM lex JOIN r USING (chunk_id) WHERE rank <= 10 GROUP BY 1")
def filter_violations(spark, d):
    return evidence.violations(_found(spark, d), "KVR2", LAST)


@_query(f"WITH {_C} SELECT id AS chunk_id, contains(regexp_replace(text, '[\\s\\p{{Z}},]', '', 'g'), '17.2') AS holds FROM c")
def numeric_evidence(spark, d):
    return store.once(_t(spark, d, "chunks"), "id").select(F.col("id").alias("chunk_id"), evidence.holds_number(F.col("text"), F.lit("17 .2")).alias("holds"))


@_query("SELECT doc_id, sha256(regexp_replace(regexp_replace(replace(replace(replace(text, chr(0), ''), chr(13), ''), chr(160), ' '), '\\n[ \\t]*\\n(?:[ \\t]*\\n)+', chr(10) || chr(10), 'g'), '^[\\s\\x0B\\x1c-\\x1f\\x85\\p{Z}]+|[\\s\\x0B\\x1c-\\x1f\\x85\\p{Z}]+$', '', 'g')) AS cleaned FROM documents")
def clean_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.sha2(tx.clean(F.col("text")), 256).alias("cleaned"))


_SPACE = "[\\s\\x0B\\x1c-\\x1f\\x85\\p{Z}]"


@_query(f"""WITH RECURSIVE t AS (SELECT doc_id, regexp_replace(regexp_replace(replace(replace(replace(text, chr(0), ''), chr(13), ''), chr(160), ' '), '\\n[ \\t]*\\n(?:[ \\t]*\\n)+', chr(10) || chr(10), 'g'), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS x FROM documents),
h AS (SELECT doc_id, x, instr(x, chr(10) || '[Rows]' || chr(10)) AS pos FROM t WHERE x <> ''),
b AS (SELECT doc_id, CASE WHEN pos = 0 THEN '' ELSE substr(x, 1, least(pos - 1, 866)) || chr(10) || '[Rows]' || chr(10) END AS prefix, CASE WHEN pos > 0 AND pos - 1 <= 866 THEN substr(x, pos + 8) ELSE x END AS body FROM h),
z AS (SELECT doc_id, prefix, body, length(body) AS n, 2600 - length(prefix) AS room FROM b),
cuts AS (SELECT doc_id, 0::BIGINT AS start, 0::BIGINT AS stop, 0 AS k FROM z WHERE n > 0
UNION ALL SELECT doc_id, s, e, k + 1 FROM (SELECT doc_id, k, s, CASE WHEN s + room >= n THEN n WHEN contains(half, chr(10)) THEN s + room // 2 + length(regexp_extract(half, '(?s)^(.*)\\n', 1)) WHEN contains(half, ' ') THEN s + room // 2 + length(regexp_extract(half, '(?s)^(.*) ', 1)) ELSE s + room END AS e
FROM (SELECT doc_id, k, n, room, s, substr(body, s + room // 2 + 1, room - room // 2) AS half FROM (SELECT c.doc_id, c.k, z.n, z.room, z.body, CASE WHEN c.k = 0 THEN 0 WHEN z.prefix <> '' THEN c.stop WHEN regexp_matches(substr(z.body, greatest(c.start + 1, c.stop - 250), 1), '{_SPACE}') THEN greatest(c.start + 1, c.stop - 250)
WHEN instr(substr(z.body, greatest(c.start + 1, c.stop - 250) + 1, c.stop - greatest(c.start + 1, c.stop - 250)), ' ') > 0 THEN greatest(c.start + 1, c.stop - 250) + instr(substr(z.body, greatest(c.start + 1, c.stop - 250) + 1, c.stop - greatest(c.start + 1, c.stop - 250)), ' ') ELSE c.stop END AS s
FROM cuts c JOIN z ON z.doc_id = c.doc_id WHERE c.stop < z.n OR c.k = 0) WHERE s < n))),
p AS (SELECT c.doc_id, c.k, z.prefix, regexp_replace(substr(z.body, c.start + 1, c.stop - c.start), '^{_SPACE}+|{_SPACE}+$', '', 'g') AS piece FROM cuts c JOIN z ON z.doc_id = c.doc_id WHERE c.k > 0),
o AS (SELECT doc_id, prefix || piece AS text, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM p WHERE piece <> '')
SELECT doc_id, (i - 1)::INT AS ordinal, text, 'text, part ' || i AS locator, sha256(text) AS text_hash FROM o UNION ALL SELECT doc_id, 0, prefix, 'text', sha256(prefix) FROM z WHERE n = 0""")
def chunk_documents(spark, d):
    return chunking.chunked(_t(spark, d, "documents").select("doc_id", F.array(F.struct("text", F.lit("text").alias("locator"))).alias("segments")))


_OLD_NEW = "o AS (SELECT id, max(fingerprint) AS f FROM documents WHERE batch_no <= 4 GROUP BY 1), n AS (SELECT id, max(fingerprint) AS f FROM documents WHERE batch_no >= 2 GROUP BY 1)"


@_query(f"WITH {_OLD_NEW} SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'new' WHEN n.id IS NULL THEN 'removed' WHEN o.f IS NOT DISTINCT FROM n.f THEN 'unchanged' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.id = n.id")
def fingerprint_diff(spark, d):
    docs = _t(spark, d, "documents").where("id is not null")
    return store.changes(docs.where("batch_no <= 4").groupBy("id").agg(F.max("fingerprint").alias("fingerprint")), docs.where("batch_no >= 2").groupBy("id").agg(F.max("fingerprint").alias("fingerprint")))


@_query("SELECT DISTINCT id FROM documents WHERE id NOT IN (SELECT id FROM documents WHERE batch_no = 0)")
def prune_set(spark, d):
    docs = _t(spark, d, "documents")
    return store.pruned(docs, docs.where("batch_no = 0").select("id"))


@_query(f"WITH {_LATEST} SELECT id, doc_id, fingerprint FROM d")
def upsert_latest(spark, d):
    return store.latest(_t(spark, d, "documents")).select("id", "doc_id", "fingerprint")


@_query("SELECT company, count(DISTINCT id) AS n FROM documents GROUP BY 1 ORDER BY 1")
def documents_by_company(spark, d):
    return _t(spark, d, "documents").groupBy("company").agg(F.countDistinct("id").alias("n")).orderBy("company")


@_query("SELECT list(meta_key || '=' || meta_value ORDER BY meta_key) AS entries FROM index_metadata")
def metadata_map(spark, d):
    m = _t(spark, d, "index_metadata").agg(F.map_from_entries(F.collect_list(F.struct("meta_key", "meta_value"))).alias("m"))
    return m.select(F.array_sort(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))).alias("entries"))


@_query(f"""WITH {_C} SELECT 'orphan_chunks' AS fault, count(*) AS n FROM c WHERE document_id NOT IN (SELECT id FROM documents)
UNION ALL SELECT 'repeated_ordinals', count(*) FROM (SELECT 1 FROM c GROUP BY document_id, ordinal HAVING count(*) > 1)
UNION ALL SELECT 'bad_vectors', count(*) FROM vector_cache WHERE dimension IS NULL OR dimension <> 64 OR vector IS NULL OR len(vector) <> 64
UNION ALL SELECT 'wrong_hashes', count(*) FROM c WHERE sha256(text) <> text_hash""")
def snapshot_integrity(spark, d):
    return store.faults(_t(spark, d, "documents"), _t(spark, d, "chunks"), _t(spark, d, "vector_cache"))


@_query("""WITH a AS (SELECT DISTINCT company, trim(regexp_replace(alias, '[\\s\\p{Z}]+', ' ', 'g')) AS alias FROM documents LEFT JOIN company_aliases ON document_id = id)
SELECT company, coalesce(list(alias ORDER BY alias) FILTER (WHERE alias <> ''), []) AS aliases FROM a GROUP BY 1""")
def alias_lists(spark, d):
    return store.aliases_of(_t(spark, d, "documents"), _t(spark, d, "company_aliases"))


@_query(f"""WITH {_C}, {_LATEST} SELECT c.id AS chunk_id, d.company, d.title, d.source_url, json_array_length(d.aliases)::INT AS n_aliases, json_extract_string(d.aliases, '$[0].role') AS first_role FROM c JOIN d ON d.id = c.document_id""")
def source_lookup(spark, d):
    own = store.sources(_t(spark, d, "chunks"), _t(spark, d, "documents"))
    return own.select("chunk_id", "company", "title", "source_url", F.when(F.col("aliases").isNotNull(), F.size("aliases")).alias("n_aliases"), F.try_element_at("aliases", F.lit(1))["role"].alias("first_role"))


@_query("SELECT doc_id, CASE WHEN regexp_full_match(publication_date, '\\d{4}-\\d{2}-\\d{2}') THEN replace(publication_date, '-', '')::INT END AS publication_day FROM documents")
def publication_days(spark, d):
    return _t(spark, d, "documents").select("doc_id", tx.day_number(F.col("publication_date")).alias("publication_day"))


_PARTIAL = "regexp_full_match({0}, '\\d{{4}}(-\\d{{2}})?') AND try_cast({0} || CASE WHEN length({0}) = 4 THEN '-01-01' ELSE '-01' END AS DATE) IS NOT NULL"


@_query(f"""WITH u AS (SELECT doc_id, 'date' AS kind, publication_date AS p FROM documents UNION ALL SELECT doc_id, 'period', publication_period FROM documents UNION ALL SELECT doc_id, 'month', substr(publication_date, 1, 7) FROM documents
UNION ALL SELECT doc_id, 'broken', substr(publication_date, 1, 5) || '13' FROM documents)
SELECT doc_id, kind, CASE WHEN NOT ({_PARTIAL.format('p')}) THEN p END AS day, CASE WHEN {_PARTIAL.format('p')} THEN p END AS period FROM u""")
def demoted_dates(spark, d):
    docs = _t(spark, d, "documents")
    date = F.col("publication_date")
    kinds = {"date": date, "period": F.col("publication_period"), "month": F.substring(date, 1, 7), "broken": F.concat(F.substring(date, 1, 5), F.lit("13"))}
    long = docs.select("doc_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("p")) for k, v in kinds.items()))).alias("x")).select("doc_id", "x.*")
    day, period = tx.demoted(F.col("p"))
    return long.select("doc_id", "kind", day.alias("day"), period.alias("period"))


@_query("SELECT doc_id, '/bundle/' || lower(company) || '.tar.gz:' || replace(path, root || '/', '') AS path FROM documents")
def path_rewrite(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.concat(F.lit("/bundle/"), F.lower("company"), F.lit(".tar.gz:"), F.replace("path", F.concat("root", F.lit("/")), F.lit(""))).alias("path"))


def _fold_sql(limits_: tuple) -> str:
    wait = " AND ".join(f"len(list_filter(a, lambda t: t.ok AND t.at > x[1].at - {w})) < {n}" for n, w in limits_)
    return f"""WITH l AS (SELECT DISTINCT id, client, asked_at FROM question_log WHERE asked_at IS NOT NULL), s AS (SELECT client, list({{'at': asked_at, 'id': id, 'ok': true}} ORDER BY asked_at, id) AS xs FROM l GROUP BY 1),
f AS (SELECT client, list_reduce(list_transform(xs, lambda x: [x]), lambda a, x: list_concat(a, [{{'at': x[1].at, 'id': x[1].id, 'ok': {wait}}}])) AS ys FROM s),
u AS (SELECT client, unnest(ys) AS y FROM f) SELECT y.id AS id, client, y.ok AS accepted FROM u"""


@_query(_fold_sql(limits.QUOTA))
def quota_admission(spark, d):
    return limits.admitted(_t(spark, d, "question_log")).where("asked_at is not null").select("id", "client", "accepted")


@_query(_fold_sql(((3, 3600.0),)))
def quota_hourly(spark, d):
    return limits.admitted(_t(spark, d, "question_log"), ((3, 3600.0),)).where("asked_at is not null").select("id", "client", "accepted")


@_query(_fold_sql(limits.LOGIN))
def login_throttle(spark, d):
    return limits.admitted(_t(spark, d, "question_log"), limits.LOGIN).where("asked_at is not null").select("id", "client", "accepted")


@_query("SELECT user_id, count(*) AS sessions FROM events WHERE event_type = 'signup' AND ts <= TIMESTAMP '2024-01-15 00:00:00' AND ts + INTERVAL 43200 SECOND > TIMESTAMP '2024-01-15 00:00:00' GROUP BY 1")
def session_active(spark, d):
    return limits.session_active(_t(spark, d, "events"), "2024-01-15 00:00:00")


@_query("SELECT doc_id, a.source_url AS source_url, a.role AS role FROM (SELECT doc_id, unnest(from_json(aliases, '[{\"source_url\":\"VARCHAR\",\"role\":\"VARCHAR\"}]')) AS a FROM documents WHERE aliases IS NOT NULL)")
def release_aliases(spark, d):
    return _t(spark, d, "documents").select("doc_id", F.explode(F.from_json("aliases", store.ALIAS)).alias("a")).select("doc_id", "a.source_url", "a.role")
