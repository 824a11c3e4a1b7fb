"""Queries over store upkeep, discovery, requests and answers, and the SQL each must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import index, ranking, store
from quillspark.plans import search
from quillspark.sources import selection

DIMENSION = 64
QUERIES: dict = {}
SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_C = "c AS (SELECT DISTINCT * FROM chunks WHERE id IS NOT NULL)"
_D = "d AS (SELECT * FROM documents WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) = 1)"
_V = "v AS (SELECT DISTINCT text_hash FROM vector_cache WHERE vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"
_DAY = "CASE WHEN regexp_full_match({0}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast({0} AS DATE) IS NOT NULL THEN replace({0}, '-', '')::INT END"
TARGET = "https://vectors.example|rag_e3b98a4da31a127d4bde6e43033f66ba"


# --- store and index -----------------------------------------------------------------------------------------------------------------------------


@_query("SELECT meta_key, meta_value FROM index_metadata UNION ALL SELECT k, v FROM (VALUES ('embedding_dimension', '128'), ('parser_version', '7')) t(k, v) WHERE k NOT IN (SELECT meta_key FROM index_metadata)")
def metadata_defaults(spark, d):
    return index.insert_absent(_t(spark, d, "index_metadata"), spark.createDataFrame([("embedding_dimension", "128"), ("parser_version", "7")], "meta_key string, meta_value string"), "meta_key")


@_query("SELECT meta_key, meta_value FROM index_metadata WHERE meta_key <> 'qdrant_target'")
def metadata_without_target(spark, d):
    return _t(spark, d, "index_metadata").where(~F.col("meta_key").eqNullSafe("qdrant_target"))


@_query("SELECT (SELECT count(*) FROM vector_pending) > 0 AS waiting, (SELECT meta_value FROM index_metadata WHERE meta_key = 'embedding_dimension')::INT AS dimension")
def pending_probe(spark, d):
    held = _t(spark, d, "index_metadata").where("meta_key = 'embedding_dimension'").agg(F.max("meta_value").cast("int").alias("dimension"))
    return _t(spark, d, "vector_pending").limit(1).agg((F.count("*") > 0).alias("waiting")).join(held)


@_query(f"WITH {_D} SELECT DISTINCT a.doc_id, d.fingerprint FROM documents a JOIN d ON d.id = a.id WHERE a.doc_id % 20 = 0")
def fingerprint_lookup(spark, d):
    docs = _t(spark, d, "documents")
    asked = docs.where("doc_id % 20 = 0").select("doc_id", "id").distinct()
    return asked.join(store.latest(docs).select("id", "fingerprint"), "id").select("doc_id", "fingerprint")


_REPLACE = f"""{_C}, old AS (SELECT * FROM documents WHERE batch_no <= 4 AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) = 1), new AS (SELECT * FROM documents WHERE batch_no > 4 AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY doc_id DESC) = 1),
oc AS (SELECT * FROM c WHERE document_id IN (SELECT id FROM old)), nc AS (SELECT * FROM c WHERE document_id IN (SELECT id FROM new) AND ordinal % 2 = 0)"""


def _replacement(spark, d):
    docs, chunks = _t(spark, d, "documents"), _t(spark, d, "chunks")
    old, new = store.latest(docs.where("batch_no <= 4")), docs.where("batch_no > 4")
    own = chunks.join(old.select(F.col("id").alias("document_id")), "document_id", "left_semi")
    return index.replaced(old, own, new, chunks.where("ordinal % 2 = 0"))


@_query(f"WITH {_REPLACE} SELECT id, doc_id FROM old WHERE id NOT IN (SELECT id FROM new) UNION ALL SELECT id, doc_id FROM new")
def replaced_documents(spark, d):
    return _replacement(spark, d)[0].select("id", "doc_id")


@_query(f"WITH {_REPLACE} SELECT id AS chunk_id, document_id FROM oc WHERE document_id NOT IN (SELECT id FROM new) UNION ALL SELECT id, document_id FROM nc")
def replaced_chunks(spark, d):
    return _replacement(spark, d)[1].select(F.col("id").alias("chunk_id"), "document_id")


@_query(f"WITH {_REPLACE} SELECT id AS chunk_id FROM oc WHERE document_id IN (SELECT id FROM new) UNION SELECT id FROM nc")
def replaced_log(spark, d):
    return _replacement(spark, d)[2]


@_query("SELECT DISTINCT text_hash FROM vector_cache WHERE text_hash IS NOT NULL UNION SELECT text_hash FROM chunks WHERE id % 7 = 0")
def vectors_inserted(spark, d):
    old, new = _t(spark, d, "vector_cache").where("text_hash is not null").dropDuplicates(["text_hash"]), _t(spark, d, "chunks").where("id % 7 = 0")
    return index.insert_absent(old.select("text_hash"), new.select("text_hash"), "text_hash")


_INDEX = f"{_C}, {_D}, {_V}, i AS (SELECT c.id AS chunk_id, 'OLD' AS company, d.category, CASE WHEN c.id % 50 = 0 THEN 'x' ELSE c.text_hash END AS text_hash, NULL::INT AS publication_day FROM c JOIN d ON d.id = c.document_id WHERE c.id % 3 = 0)"


def _index(spark, d):
    rows = index.points(_t(spark, d, "chunks"), _t(spark, d, "documents"), _t(spark, d, "chunks").select("text_hash", F.transform(F.sequence(F.lit(1), F.lit(DIMENSION)), lambda x: x.cast("float")).alias("vector")), DIMENSION)
    return rows.where("chunk_id % 3 = 0 and category is not null or chunk_id % 3 = 0 and company is not null").select("chunk_id", F.lit("OLD").alias("company"), "category", F.when(F.col("chunk_id") % 50 == 0, "x").otherwise(F.col("text_hash")).alias("text_hash"), F.lit(None).cast("int").alias("publication_day"))


@_query(f"""WITH {_INDEX}, p AS (SELECT DISTINCT chunk_id FROM vector_pending), w AS (SELECT p.chunk_id, c.id, v.text_hash AS vh FROM p LEFT JOIN c ON c.id = p.chunk_id LEFT JOIN v ON v.text_hash = c.text_hash)
SELECT * FROM i WHERE chunk_id NOT IN (SELECT chunk_id FROM w WHERE id IS NULL OR vh IS NOT NULL)
UNION ALL SELECT c.id, d.company, d.category, c.text_hash, {_DAY.format('d.publication_date')} FROM w JOIN c ON c.id = w.chunk_id LEFT JOIN d ON d.id = c.document_id WHERE vh IS NOT NULL""")
def synced_index(spark, d):
    return index.replayed(_index(spark, d), _t(spark, d, "vector_pending"), _t(spark, d, "chunks"), _t(spark, d, "documents"), _t(spark, d, "vector_cache"))[0]


@_query(f"WITH {_C}, {_V}, p AS (SELECT DISTINCT chunk_id FROM vector_pending) SELECT p.chunk_id FROM p JOIN c ON c.id = p.chunk_id WHERE c.text_hash NOT IN (SELECT text_hash FROM v)")
def synced_waiting(spark, d):
    return index.replayed(_index(spark, d), _t(spark, d, "vector_pending"), _t(spark, d, "chunks"), _t(spark, d, "documents"), _t(spark, d, "vector_cache"))[1]


@_query(f"WITH {_INDEX} SELECT chunk_id FROM i JOIN c ON c.id = i.chunk_id WHERE c.text_hash <> i.text_hash UNION SELECT chunk_id FROM vector_pending")
def repairs_queued(spark, d):
    return _t(spark, d, "vector_pending").select("chunk_id").union(index.stale(_index(spark, d), _t(spark, d, "chunks"))).distinct()


@_query(f"WITH {_INDEX}, t AS (SELECT (SELECT count(*) FROM c) AS n, (SELECT count(DISTINCT chunk_id) FROM i) AS p, (SELECT count(DISTINCT chunk_id) FROM vector_pending) AS w, (SELECT max(meta_value) = '{TARGET}' FROM index_metadata WHERE meta_key = 'qdrant_target') AS same) SELECT n AS chunks, CASE WHEN same THEN p ELSE 0 END AS points, w AS pending, same AS same_target, n = 0 OR (w = 0 AND n = p AND same) AS complete FROM t")
def index_gate(spark, d):
    return index.gate(_index(spark, d), _t(spark, d, "chunks"), _t(spark, d, "vector_pending"), TARGET, _t(spark, d, "index_metadata"))


@_query("SELECT true AS known, count(*) > 0 AS some, count(*) = 0 OR (SELECT max(meta_value) FROM index_metadata WHERE meta_key = 'embedding_identity') = 'other|model' AS allowed FROM vector_cache WHERE vector IS NOT NULL")
def embedding_identity(spark, d):
    return index.identity_allows(_t(spark, d, "index_metadata"), _t(spark, d, "vector_cache"), "other|model")


@_query(f"WITH {_V}, m AS (SELECT text_hash, max(vector) AS x FROM vector_cache WHERE text_hash IN (SELECT text_hash FROM v) AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NOT NULL AND isfinite(x))) = 64 GROUP BY 1), n AS (SELECT text_hash, x::DOUBLE[] AS x, sqrt(list_sum(list_transform(x::DOUBLE[], lambda y: y * y))) AS l FROM m) SELECT text_hash, round(x[1] / l, 5) AS first, round(x[64] / l, 5) AS last FROM n")
def unit_vectors(spark, d):
    u = ranking.usable(_t(spark, d, "vector_cache"), DIMENSION)
    length = F.sqrt(F.aggregate(F.transform("vector", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x))
    return u.withColumn("l", length).select("text_hash", F.round(F.col("vector")[0].cast("double") / F.col("l"), 5).alias("first"), F.round(F.col("vector")[DIMENSION - 1].cast("double") / F.col("l"), 5).alias("last"))


@_query("SELECT doc_id, min(doc_id) OVER (PARTITION BY content_hash) AS parsed_as FROM documents WHERE content_hash IS NOT NULL")
def parsed_once(spark, d):
    docs = _t(spark, d, "documents").where("content_hash is not null").select("doc_id", "content_hash")
    # The least of each hash is found before rows move, so that a hash with a third of them is no hot key.
    return docs.join(docs.groupBy("content_hash").agg(F.min("doc_id").alias("parsed_as")), "content_hash").select("doc_id", "parsed_as")


_KEYS = {"documents": ["doc_id", "id"], "chunks": ["id", "text_hash"], "company_aliases": ["document_id", "alias"], "vector_pending": ["chunk_id"]}


def _digest(name: str) -> str:
    own = ", ".join(f"coalesce({k}::VARCHAR, '-')" for k in _KEYS[name])
    return f"SELECT '{name}' AS \"table\", count(*) AS rows, coalesce(sum(('0x' || substr(md5(concat_ws('|', {own})), 1, 8))::BIGINT), 0)::BIGINT AS digest FROM {name}"


@_query(" UNION ALL ".join(map(_digest, _KEYS)))
def bundle_manifest(spark, d):
    return index.manifest({n: _t(spark, d, n) for n in _KEYS}, _KEYS)


@_query("SELECT root, count(DISTINCT id) AS documents, regexp_extract(root, '([^/]*)/*$', 1) AS name, count(*) OVER (PARTITION BY regexp_extract(root, '([^/]*)/*$', 1)) > 1 AS repeated FROM documents WHERE root IS NOT NULL GROUP BY 1")
def roots(spark, d):
    from pyspark.sql import Window

    own = _t(spark, d, "documents").where("root is not null").groupBy("root").agg(F.countDistinct("id").alias("documents")).withColumn("name", selection.name_of(F.col("root")))
    return own.withColumn("repeated", F.count("*").over(Window.partitionBy("name")) > 1)


@_query("SELECT doc_id, regexp_extract(source_url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(source_url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) AS path FROM documents WHERE source_url IS NOT NULL AND source_url <> ''")
def url_parts(spark, d):
    own = _t(spark, d, "documents").where("source_url is not null and source_url <> ''")
    return own.select("doc_id", F.try_parse_url("source_url", F.lit("HOST")).alias("host"), F.try_parse_url("source_url", F.lit("PATH")).alias("path"))


# --- discovery -----------------------------------------------------------------------------------------------------------------------------------

#: Files that folders may hold; those of a document's folder are the ones its number picks.
NAMES = (
    "main.htm", "R2.htm", "R17.htm", "filing.html", "html.html", "primary_document.html", "primary_document.pdf", "ir_filing.pdf", "ir_filing.xlsx", "filing_detail.txt", "a-index.html", "complete_submission.txt", "exhibit.pdf", "webcast.txt",
    "unavailable_1.txt", "x.excerpt.txt", "live_streaming.txt", "pic.png", "article.html", "page.html", "page.txt", "source.html", "source.txt", "content.txt", "content_de.txt", "page_de.html", "source_page_2.html", "listing.txt", "ir_page.html",
    "main_site_1.html", "ir_mirror_2.html", "release.pdf", "deck.pptx", "data.XLSX",
)
KINDS = ("attachment", "page_text", None)


def _folder_files(spark, d):
    """Each document's folder with some of NAMES and formats named after it; what a record says of a file depends on both their numbers."""
    docs = _t(spark, d, "documents").where("path is not null").select("doc_id", "category", F.regexp_extract("path", r"([^/]*)/[^/]*$", 1).alias("accession"))
    names = F.filter(F.transform(F.array(*map(F.lit, NAMES)), lambda n, i: F.struct(n.alias("n"), i.alias("i"))), lambda x: (F.col("doc_id") * 7 + x["i"] * 5) % 3 != 0)
    more = [F.struct(F.concat(F.when(F.col("doc_id") % 4 < k, F.col("accession")).otherwise(F.lit(f"other{k}")), F.lit(e)).alias("n"), F.lit(100 + k).alias("i")) for k, e in enumerate((".pdf", ".rtf.docx", ".xls", ".txt"), 1)]
    own = docs.withColumn("have", F.concat(F.transform(names, lambda x: F.struct(x["n"].alias("n"), x["i"].cast("int").alias("i"))), F.array(*more))).withColumn("candidates", F.transform("have", lambda x: x["n"]))
    rows = own.select("doc_id", "category", "accession", "candidates", F.explode("have").alias("f")).withColumn("path", F.col("f.n"))
    k = (F.col("doc_id") + F.col("f.i")) % 3
    return rows.select("doc_id", "category", "accession", "candidates", "path", F.element_at(F.array(*map(F.lit, KINDS)), (k + 1).cast("int")).alias("kind"), F.when(F.col("doc_id") % 5 == 0, "main.htm").alias("primary"), F.concat(F.lit("u"), (F.col("f.i") % 2).cast("string")).alias("file_url"), F.lit("u1").alias("material_url"), (F.col("doc_id") % 2 == 0).alias("attached"))


_LIST = ", ".join(f"'{n}'" for n in NAMES)
_SUFFIX = "lower(regexp_extract({0}, '[^/.][^/]*?(\\.[^./]+)/*$', 1))"


@_query(f"""WITH n AS (SELECT doc_id, coalesce(category, '') AS category, regexp_extract(path, '([^/]*)/[^/]*$', 1) AS acc FROM documents WHERE path IS NOT NULL),
l AS (SELECT unnest([{_LIST}]) AS name, unnest(range(0, {len(NAMES)})) AS i),
f AS (SELECT doc_id, category, acc, name AS path, i FROM n, l WHERE (doc_id * 7 + i * 5) % 3 <> 0
UNION ALL SELECT doc_id, category, acc, CASE WHEN doc_id % 4 < k THEN acc ELSE 'other' || k END || e, 100 + k FROM n, (VALUES (1, '.pdf'), (2, '.rtf.docx'), (3, '.xls'), (4, '.txt')) x(k, e)),
g AS (SELECT doc_id, list(path) AS have FROM f GROUP BY 1),
h AS (SELECT f.*, have, doc_id % 5 = 0 AND list_contains(have, 'main.htm') AS prim, list_filter(have, lambda x: x IN (acc || '.pdf', acc || '.docx', acc || '.rtf.docx', acc || '.xls', acc || '.xlsx')) AS vers, ['attachment', 'page_text', NULL][(doc_id + i) % 3 + 1] AS kind, 'u' || (i % 2) AS url, doc_id % 2 = 0 AS att, category LIKE 'sec\\_%' ESCAPE '\\' AS sec FROM f JOIN g USING (doc_id)),
j AS (SELECT *, CASE WHEN list_contains(have, 'article.html') THEN 'article.html' WHEN category IN ('ir_news', 'press_release') AND list_contains(have, 'page.html') THEN 'page.html' WHEN list_contains(have, 'page.txt') THEN 'page.txt' WHEN list_contains(have, 'page.html') THEN 'page.html' END AS page FROM h)
SELECT doc_id, path, CASE WHEN {_SUFFIX.format('path')} NOT IN ('.html', '.htm', '.txt', '.md', '.pdf', '.docx', '.pptx', '.xlsx', '.xls', '.csv') THEN 'unsupported'
WHEN path IN ('webcast.txt', 'unavailable_1.txt', 'x.excerpt.txt', 'live_streaming.txt') THEN 'notice'
WHEN sec THEN CASE WHEN path IN ('a-index.html', 'page.html', 'page.txt', 'article.html', 'filing_detail.txt') THEN 'wrapper' WHEN path = 'complete_submission.txt' OR path = acc || '.txt' THEN 'bundle' WHEN prim AND path IN ('R2.htm', 'R17.htm') THEN 'generated_view'
WHEN prim AND path IN ('filing.html', 'html.html', 'primary_document.html') THEN 'primary_mirror' WHEN path IN ('ir_filing.pdf', 'ir_filing.xlsx') AND (prim OR list_contains(have, 'primary_document.html') OR list_contains(have, 'primary_document.pdf')) THEN 'primary_format'
WHEN list_contains(vers, path) AND (prim OR path <> CASE WHEN list_contains(vers, acc || '.pdf') THEN acc || '.pdf' WHEN list_contains(vers, acc || '.rtf.docx') THEN acc || '.rtf.docx' ELSE acc || '.xls' END) THEN 'accession_format'
WHEN path IN ('filing.html', 'html.html') AND NOT prim AND list_contains(vers, acc || '.pdf') THEN 'rendered_mirror' END
WHEN category = 'quarterly_results' AND path IN ('source.html', 'source.txt') OR path = 'source_page_2.html' THEN 'collection'
WHEN path IN ('page.html', 'page.txt', 'article.html') AND kind = 'page_text' AND url <> 'u1' AND (att OR category = 'quarterly_results') THEN 'foreign_capture'
WHEN path IN ('page.html', 'page.txt', 'article.html') AND path <> page THEN 'other_page' WHEN path IN ('content.txt', 'source.txt') AND list_contains(have, 'source.html') THEN 'text_of_source'
WHEN path = 'content_de.txt' AND list_contains(have, 'page_de.html') THEN 'text_of_language' WHEN page IS NOT NULL AND path IN ('listing.txt', 'ir_page.html') THEN 'listing' WHEN page IS NOT NULL AND path IN ('main_site_1.html', 'ir_mirror_2.html') THEN 'merged_mirror'
WHEN page IS NOT NULL AND path = 'release.pdf' AND category IN ('ir_news', 'press_releases', 'news') THEN 'release_pdf' END AS reason FROM j""")
def selection_report(spark, d):
    f = _folder_files(spark, d)
    why = selection.left_out(*(F.col(c) for c in ("path", "candidates", "category", "accession", "primary", "kind", "file_url", "material_url", "attached")))
    return f.select("doc_id", "path", why.alias("reason"))


@_query("SELECT doc_id, regexp_extract(path, '([^/]*)/*$', 1) AS name, lower(regexp_extract(path, '(\\.[^./]+)$', 1)) AS suffix, path LIKE '%/audit/%' OR path LIKE '%/.%' AS passed_over FROM documents WHERE path IS NOT NULL")
def archive_inventory(spark, d):
    parts = F.split("path", "/")
    return _t(spark, d, "documents").where("path is not null").select("doc_id", selection.name_of(F.col("path")).alias("name"), selection.suffix_of(F.col("path")).alias("suffix"), F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin("audit", "__pycache__", "node_modules")).alias("passed_over"))


# --- requests, fusion and answers ------------------------------------------------------------------------------------------------------------------


@_query("""SELECT doc_id AS question_id, CASE WHEN title IS NULL OR regexp_full_match(title, '\\s*') OR length(title) > 4000 THEN 'question' WHEN m NOT IN ('hybrid', 'lexical', 'dense') THEN 'mode' WHEN k NOT BETWEEN 1 AND 20 THEN 'top_k'
WHEN NOT (f IS NULL OR f = '' OR (regexp_full_match(f, '\\d{4}-\\d{2}-\\d{2}') AND try_cast(f AS DATE) IS NOT NULL)) OR NOT (u IS NULL OR u = '' OR (regexp_full_match(u, '\\d{4}-\\d{2}-\\d{2}') AND try_cast(u AS DATE) IS NOT NULL)) THEN 'date' WHEN f > u AND f <> '' AND u <> '' THEN 'date_order' END AS error
FROM (SELECT doc_id, title, publication_date AS f, CASE WHEN doc_id % 9 = 0 THEN publication_period ELSE '2020-06-30' END AS u, ['hybrid', 'lexical', 'dense', 'best'][(doc_id % 4 + 1)::INT] AS m, doc_id % 23 AS k FROM documents)""")
def request_checks(spark, d):
    own = _t(spark, d, "documents").select("doc_id", "title", F.col("publication_date").alias("f"), F.when(F.col("doc_id") % 9 == 0, F.col("publication_period")).otherwise("2020-06-30").alias("u"), F.element_at(F.array(*map(F.lit, (*search.MODES, "best"))), (F.col("doc_id") % 4 + 1).cast("int")).alias("m"), (F.col("doc_id") % 23).alias("k"))
    return own.select(F.col("doc_id").alias("question_id"), search.request_error(F.col("title"), F.col("m"), F.col("k"), F.col("f"), F.col("u"), F.lit("en")).alias("error"))


_NAMES = "names AS (SELECT DISTINCT company, trim(regexp_replace(alias, '[\\s\\p{Z}]+', ' ', 'g')) AS alias FROM documents JOIN company_aliases ON document_id = id UNION SELECT DISTINCT company, company FROM documents WHERE company IS NOT NULL)"


def _names(spark, d):
    docs = _t(spark, d, "documents").select(F.col("id").alias("document_id"), "company").distinct()
    alias = _t(spark, d, "company_aliases").select("document_id", F.trim(F.regexp_replace("alias", r"(?U)\s+", " ")).alias("alias"))
    return docs.join(alias, "document_id").select("company", "alias").union(docs.select("company", F.col("company").alias("alias"))).where("alias <> '' and company is not null").distinct()


def _requests(spark, d):
    """A request for every document with a title: it asks by that title, every fifth of two companies, every seventh of one there isn't."""
    k = F.col("doc_id")
    chosen = F.when(k % 7 == 0, F.array(F.lit("NOSUCH"), F.col("company"))).when(k % 5 == 0, F.array(F.col("company"), F.col("least")))
    docs = _t(spark, d, "documents")
    return docs.join(docs.agg(F.min("company").alias("least"))).where("title is not null and company is not null").select(k.alias("question_id"), F.col("title").alias("question"), chosen.alias("companies"), F.lit(None).cast("array<string>").alias("categories"), F.lit(None).cast("string").alias("date_from"), F.lit(None).cast("string").alias("date_to"), F.lit("lexical").alias("mode"), F.lit(5).alias("top_k"), F.lit("en").alias("language"))


_SCOPED = f"""{_NAMES}, t AS (SELECT doc_id AS question_id, title AS question, company FROM documents WHERE title IS NOT NULL AND company IS NOT NULL),
h AS (SELECT DISTINCT question_id, n.company FROM t JOIN names n ON contains(lower(question), lower(alias)) AND regexp_matches(question, '(?i)(^|[^A-Za-z0-9_])' || regexp_escape(alias) || '([^A-Za-z0-9_]|$)') WHERE alias <> ''),
s AS (SELECT question_id, question, company, CASE WHEN question_id % 7 = 0 THEN NULL WHEN question_id % 5 = 0 THEN CASE WHEN company = (SELECT min(company) FROM documents) THEN [company] ELSE [company, (SELECT min(company) FROM documents)] END ELSE (SELECT list(h.company ORDER BY h.company) FROM h WHERE h.question_id = t.question_id) END AS scope, CASE WHEN question_id % 7 = 0 THEN 'unknown company: NOSUCH' END AS error FROM t)"""


@_query(f"WITH {_SCOPED} SELECT question_id, scope, error FROM s")
def request_scopes(spark, d):
    return search.scoped(_requests(spark, d), _names(spark, d)).select("question_id", "scope", "error")


@_query(f"""WITH {_SCOPED}, later AS (SELECT question_id, 1 AS place, company || ' revenue' AS q FROM s WHERE error IS NULL UNION ALL SELECT question_id, 2, 'cash flow' FROM s WHERE error IS NULL),
every AS (SELECT question_id, 0 AS place, scope, CASE WHEN len(scope) > 1 THEN scope ELSE [NULL] END AS w FROM s WHERE error IS NULL
UNION ALL SELECT l.question_id, l.place, scope, CASE WHEN l.place = 1 AND (scope IS NULL OR list_contains(scope, company)) THEN [company] WHEN len(scope) > 1 THEN scope ELSE [NULL] END FROM later l JOIN s USING (question_id))
SELECT question_id, place, unnest(range(0, len(w)))::INT AS at, unnest(w) AS company FROM every""")
def request_searches(spark, d):
    good = search.scoped(_requests(spark, d), _names(spark, d)).where("error is null")
    company = _t(spark, d, "documents").select(F.col("doc_id").alias("question_id"), F.array(F.concat("company", F.lit(" revenue")), F.lit("cash flow")).alias("queries"))
    names = _names(spark, d).where("company = alias")
    return search.searches(good, search.query_set(good, company), names).select("question_id", "place", "at", "company")


@_query("SELECT doc_id, place::INT AS place, q AS question FROM (SELECT doc_id, unnest(range(0, len(qs))) AS place, unnest(qs) AS q FROM (SELECT doc_id, list_filter(x, lambda y, i: y IS NOT NULL AND list_position(x, y) = i AND (i = 1 OR length(y) BETWEEN 1 AND 600)) AS qs FROM (SELECT doc_id, [trim(title), company, title, source] AS x FROM documents WHERE title IS NOT NULL)))")
def query_sets(spark, d):
    docs = _t(spark, d, "documents").where("title is not null")
    return search.query_set(docs.select(F.col("doc_id").alias("question_id"), F.trim("title").alias("question")), docs.select(F.col("doc_id").alias("question_id"), F.array("company", "title", "source").alias("queries"))).withColumnRenamed("question_id", "doc_id")


#: What an answer says of each chunk: a quote of its own text, of another's, too short, or none; declined or not.
def _answers(spark, d):
    c = store.once(_t(spark, d, "chunks"), "id").where("text is not null")
    k = F.col("id") % 6
    quote = F.when(k == 1, F.lit("words that stand in no source at all")).when(k == 2, F.substring("text", 3, 5)).otherwise(F.substring("text", 5, 80))
    cited = F.when(k == 3, F.array().cast("array<struct<label:string,quote:string>>")).otherwise(F.array(F.struct(F.lit("S1").alias("label"), quote.alias("quote"))))
    answer = F.when(k == 4, "see [S1] and [S2]").when(k == 3, "nothing was found").otherwise("see [S1], again [S1]")
    return c.select(F.col("id").alias("question_id"), answer.alias("answer"), ((k == 3) & (F.col("id") % 12 == 3)).alias("insufficient"), cited.alias("citations")), c.select(F.col("id").alias("question_id"), F.lit("S1").alias("label"), F.regexp_replace("text", "\n", "  \n ").alias("text"))


@_query(f"""WITH {_C}, a AS (SELECT id, id % 6 AS k, trim(regexp_replace(text, '[\\s\\x0B\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g')) AS body, trim(regexp_replace(CASE WHEN id % 6 = 2 THEN substr(text, 3, 5) ELSE substr(text, 5, 80) END, '[\\s\\x0B\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g')) AS quote FROM c WHERE text IS NOT NULL)
SELECT id AS question_id, CASE WHEN k IN (1, 4) THEN false WHEN k = 3 THEN id % 12 = 3 ELSE length(quote) >= 8 AND contains(body, quote) END AS holds FROM a""")
def answer_checks(spark, d):
    return search.quotes_hold(*_answers(spark, d))


@_query(f"WITH {_C}, x AS (SELECT id, regexp_extract(text, '[0-9]+[.,][0-9]+', 0) AS number, text FROM c WHERE text IS NOT NULL), y AS (SELECT id, number, replace(number, ',', '') AS n, regexp_replace(text, '[\\s\\x0B\\x1c-\\x1f\\x85\\p{{Z}},]', '', 'g') AS body FROM x WHERE number <> '') SELECT id AS question_id, number, CASE WHEN contains(body, n) THEN 1 END::INT AS rank FROM y")
def number_evidence(spark, d):
    c = store.once(_t(spark, d, "chunks"), "id").where("text is not null")
    found = c.select(F.col("id").alias("question_id"), F.lit(1).alias("rank"), "text")
    return search.number_ranks(found, c.select(F.col("id").alias("question_id"), F.regexp_extract("text", "[0-9]+[.,][0-9]+", 0).alias("number")).where("number <> ''"))


@_query("SELECT doc_id AS question_id, code, CASE WHEN doc_id % 2 = 0 THEN en ELSE zh END AS message FROM documents, (VALUES ('publication_date_filter', 'Dates limit when a document was published, not what period it covers; undated documents are left out.', '日期限制的是发布日期而非所属期间；日期不明的文件已排除。')) m(code, en, zh) WHERE publication_date IS NOT NULL")
def warning_messages(spark, d):
    docs = _t(spark, d, "documents")
    about = docs.where("publication_date is not null").select(F.col("doc_id").alias("question_id"), F.array(F.lit(search.DATES_FILTER)).alias("warnings"))
    return search.messages(about, docs.select(F.col("doc_id").alias("question_id"), F.when(F.col("doc_id") % 2 == 0, "en").otherwise("zh-CN").alias("language")))


@_query("SELECT client, count(*) AS attempts FROM question_log GROUP BY 1")
def attempts_by_client(spark, d):
    return _t(spark, d, "question_log").groupBy("client").agg(F.count("*").alias("attempts"))



