"""Discovery of an archive: its manifest, each folder's metadata, the registered files, and what of them is evidence.

Two tables come out: sources, one row a file to be read, and a report of everything left out, with a kind ``error`` where something is wrong. Nothing
stops at a bad row. JSON stays a variant, as a key that is null says something else than a key that is missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import demoted, real_day
from quillspark.sources.selection import ATTACHMENTS, SUPPORTED, left_out, name_of, suffix_of

# Manifests in the order they are looked for, and folders a plain scan passes over.
MANIFESTS = ("index.json", "inventory.json")
PASSED_OVER = ("audit", "__pycache__", "node_modules")
# Beginnings of categories in which a page's date doesn't date what is attached to it.
UNDATED_ATTACHMENTS = ("blog", "editorial", "corporate_site", "corporate_event", "ir_event", "technology")
ALIAS_ROLE = "release_page"


def text(v: Column, *keys: str) -> Column:
    """The first of a variant's keys that holds a non-empty string."""
    return F.coalesce(*(F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in keys))


def has(v: Column, key: str) -> Column:
    """Whether a key is there, be it null."""
    return F.try_variant_get(v, f"$.{key}", "variant").isNotNull()


def present(*choices: tuple[Column, str]) -> Column:
    """The string of the first key that is there; a null there ends the search."""
    out = F.lit(None).cast("string")
    for v, key in reversed(choices):
        out = F.when(has(v, key), F.try_variant_get(v, f"$.{key}", "string")).otherwise(out)
    return out


def listed(v: Column, key: str) -> Column:
    """A key's list of variants; null where it is no list."""
    return F.try_variant_get(v, f"$.{key}", "array<variant>")


def inside(path: Column, folder: Column) -> Column:
    """A path within its folder: the folder's own name in front is dropped, absolute paths stay as they are."""
    front = F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"))
    return F.when((folder != "") & F.startswith(path, front) & ~F.startswith(path, F.lit("/")), F.substring(path, F.length(front) + 1, F.length(path))).otherwise(path)


def escapes(path: Column) -> Column:
    """Whether a relative path leaves its folder, step by step."""
    depth = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("least")), lambda a, s: F.struct((a["at"] + F.when(s == "..", -1).when(s.isin("", "."), 0).otherwise(1)).alias("at"), F.least(a["least"], a["at"] + F.when(s == "..", -1).otherwise(0)).alias("least")))
    return F.startswith(path, F.lit("/")) | (depth["least"] < 0)


def normalised(records: DataFrame) -> DataFrame:
    """Catalogue rows (root, item, meta: JSON texts) as columns: one row a folder, its registered files as an array of variants."""
    r = records.select("root", F.try_parse_json("item").alias("i"), F.try_parse_json("meta").alias("m"))
    i, m = F.col("i"), F.col("m")
    date = present((i, "publication_date"), (i, "date"), (m, "publication_date"), (m, "date"), (m, "published_date"))
    day, period = demoted(date)
    category, folder = F.coalesce(text(i, "category"), text(m, "category"), F.lit("document")), F.coalesce(text(i, "folder"), F.lit(""))
    truth = lambda v, k: F.coalesce(F.try_variant_get(v, f"$.{k}", "boolean"), F.lit(False))
    scope = F.coalesce(text(i, "scope"), text(m, "scope"), F.when(truth(i, "supplement") | truth(m, "is_supplement"), "supplement"), F.nullif(F.split_part(folder, F.lit("/"), F.lit(1)), F.lit("")), F.lit("local"))
    files = F.when(has(m, "local_files"), listed(m, "local_files")).when(has(m, "files"), listed(m, "files")).otherwise(listed(i, "files"))
    return r.select(
        "root", "i", "m", folder.alias("folder"), F.coalesce(day, F.lit(None)).alias("publication_date"), F.coalesce(period, present((i, "publication_period"), (m, "publication_period"))).alias("publication_period"),
        F.coalesce(text(i, "url", "source_url"), text(m, "url", "source_url"), F.lit("")).alias("url"), F.when(category == "SEC filings", "sec_filings").otherwise(category).alias("category"), scope.alias("scope"),
        F.coalesce(text(i, "title"), text(m, "title")).alias("title"), F.coalesce(text(i, "date_basis"), text(m, "date_basis")).alias("date_basis"), F.coalesce(text(m, "accession"), F.lit("")).alias("accession"),
        F.coalesce(F.try_variant_get(m, "$.sec_submission.primaryDocument", "string"), F.lit("")).alias("primary"), text(m, "ticker").alias("ticker"),
        ((text(i, "status") == "unavailable") | (text(m, "status") == "unavailable")).alias("unavailable"), files.alias("files"), names_of(i, m).alias("company_aliases"),
    )


def names_of(i: Column, m: Column) -> Column:
    """The company's names: distinct, white space put right, sorted."""
    own = [F.coalesce(F.try_variant_get(v, "$.company_aliases", "array<string>"), F.array().cast("array<string>")) for v in (m, i)]
    single = F.array(*(F.try_variant_get(v, f"$.{k}", "string") for v in (m, i) for k in ("company_name", "company")))
    tidy = F.transform(F.concat(*own, single), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_sort(F.array_distinct(F.filter(tidy, lambda x: x.isNotNull() & (x != ""))))


def _details(m: Column, folder: Column) -> Column:
    """What a folder's metadata says of single files besides their record: in files, attachments, and language versions; later ones come later."""
    none = F.array().cast("array<struct<name:string,source_url:string,v:variant>>")
    own = []
    for key in ("files", "attachments"):
        rows = F.transform(F.coalesce(listed(m, key), F.array().cast("array<variant>")), lambda f: F.struct(inside(text(f, "path", "filename"), folder).alias("name"), text(f, "source_url", "url").alias("source_url"), f.alias("v")))
        own.append(rows)
    versions = F.coalesce(listed(m, "language_versions"), F.array().cast("array<variant>"))
    for key in ("html_file", "text_file"):
        own.append(F.transform(versions, lambda f: F.struct(F.when(text(f, "url").isNotNull(), text(f, key)).alias("name"), text(f, "url").alias("source_url"), F.lit(None).cast("variant").alias("v"))))
    return F.filter(F.concat(none, *own), lambda d: d["name"].isNotNull())


def registered(folders: DataFrame) -> DataFrame:
    """One row a registered file, with what is known of it: its record first, then the latest of the details under its name that has it."""
    own = folders.withColumn("details", _details(F.col("m"), F.col("folder"))).withColumn("candidates", F.transform(F.filter("files", lambda f: text(f, "path", "filename").isNotNull()), lambda f: inside(text(f, "path", "filename"), F.col("folder"))))
    attached = F.exists("files", lambda f: (text(f, "source_url", "url").eqNullSafe(F.nullif(F.col("url"), F.lit("")))) & text(f, "kind").isin(*ATTACHMENTS))
    rows = own.withColumn("attached", attached).select("*", F.posexplode("files").alias("at", "f"))
    f = F.col("f")
    path = inside(text(f, "path", "filename"), F.col("folder"))
    rows = rows.withColumn("path", path).withColumn("mine", F.filter("details", lambda d: d["name"] == F.col("path")))

    def known(key: str) -> Column:
        of = F.filter("mine", lambda d: has(d["v"], key))
        return F.when(has(f, key), F.try_variant_get(f, f"$.{key}", "string")).otherwise(F.try_variant_get(F.try_element_at(of, F.lit(-1))["v"], f"$.{key}", "string"))

    def mentioned(key: str) -> Column:
        return has(f, key) | F.exists("mine", lambda d: F.coalesce(has(d["v"], key), F.lit(False)))

    detail_url = F.try_element_at(F.filter("mine", lambda d: d["source_url"].isNotNull()), F.lit(-1))["source_url"]
    day, period = demoted(known("publication_date"))
    return rows.select(
        "root", "folder", "path", "candidates", "category", "accession", "primary", "attached", "url", "scope", "title", "date_basis", "publication_date", "publication_period", "ticker", "unavailable", "company_aliases", "at",
        known("kind").alias("kind"), known("status").alias("status"), F.coalesce(text(f, "source_url"), detail_url, text(f, "url"), F.nullif(F.col("url"), F.lit(""))).alias("file_url"),
        (mentioned("publication_date") | mentioned("publication_period")).alias("own_date"), day.alias("file_date"), F.coalesce(period, known("publication_period")).alias("file_period"), known("date_basis").alias("file_basis"),
    )


def discovered(records: DataFrame, on_disk: DataFrame | None = None, company: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, report) of catalogue rows (root, item, meta). on_disk: (path) of the files that are there; without it, all count as there."""
    folders = normalised(records)
    bad = F.when(F.col("i").isNull() | (F.col("folder") == ""), "no folder").when(escapes(F.col("folder")), "folder escapes the archive").when(F.col("m").isNull(), "no metadata").when(F.col("files").isNull(), "files is no list")
    folders = folders.withColumn("bad", F.when(~F.coalesce("unavailable", F.lit(False)), bad))
    files = registered(folders.where("bad is null and not coalesce(unavailable, false)"))
    whole = F.concat_ws("/", "root", F.rtrim("folder", F.lit("/")), "path")
    files = files.withColumn("whole", whole)
    if on_disk is not None:
        files = files.join(on_disk.select(F.col("path").alias("whole"), F.lit(True).alias("there")), "whole", "left")
    else:
        files = files.withColumn("there", F.lit(True))
    undated = F.exists(F.array(*map(F.lit, UNDATED_ATTACHMENTS)), lambda b: F.startswith(F.col("category"), b)) & F.coalesce(F.col("kind").isin(*ATTACHMENTS), F.lit(False)) & ~F.col("file_url").eqNullSafe(F.nullif(F.col("url"), F.lit("")))
    own = F.col("own_date")
    files = files.select(
        "*", F.when(own, F.col("file_date")).when(~undated, F.col("publication_date")).alias("day"), F.when(own, F.col("file_period")).when(~undated, F.col("publication_period")).alias("period"),
        F.when(own, F.coalesce(F.nullif("file_basis", F.lit("")), F.lit("Attachment date supplied by archive"))).when(undated, "Attachment date unverified").otherwise(F.coalesce(F.nullif("date_basis", F.lit("")), F.lit("Unknown publication date"))).alias("basis"),
    )
    error = (
        F.when(F.col("path").isNull(), "file record has no path").when(escapes(F.col("path")), "path escapes the folder")
        .when(F.coalesce(F.col("status").isin("failed", "unavailable"), F.lit(False)) | F.col("there").isNull(), "file unavailable")
    )
    reason = left_out(F.col("path"), F.col("candidates"), F.col("category"), F.col("accession"), F.col("primary"), F.col("kind"), F.col("file_url"), F.col("url"), F.col("attached"))
    judged = files.withColumn("error", error).withColumn("reason", F.when(F.col("error").isNull(), reason))
    judged = judged.withColumn("error", F.coalesce("error", F.when(F.col("reason").isNull() & F.col("day").isNotNull() & ~real_day(F.col("day")), "publication date is no day")))
    issuer = F.coalesce(F.lit(company), F.col("ticker"), F.split_part(name_of(F.col("root")), F.lit("_"), F.lit(1)))
    stem = F.regexp_replace(name_of(F.col("path")), r"(?<=[^.])\.[^.]+$", "")
    page = (F.col("url") != "") & ~F.col("url").eqNullSafe(F.col("file_url"))
    alias = F.struct(F.col("url").alias("source_url"), F.coalesce("title", stem).alias("title"), "publication_date", "publication_period", F.coalesce("date_basis", F.lit("Unknown publication date")).alias("date_basis"), "scope", F.lit(ALIAS_ROLE).alias("role"))
    sources = judged.where("error is null and reason is null").select(
        F.sha2(F.concat(issuer, F.lit("\0"), F.col("whole")), 256).alias("id"), issuer.alias("company"), F.coalesce("title", stem).alias("title"), "category", F.col("day").alias("publication_date"), F.col("period").alias("publication_period"),
        F.col("basis").alias("date_basis"), "scope", F.coalesce("file_url", F.lit("")).alias("source_url"), F.col("whole").alias("path"), F.when(page, F.array(alias)).otherwise(F.array().cast("array<struct<source_url:string,title:string,publication_date:string,publication_period:string,date_basis:string,scope:string,role:string>>")).alias("aliases"), "company_aliases",
    )
    where = F.concat_ws("/", "root", "folder")
    report = judged.where("error is not null or reason is not null").select(F.coalesce("whole", where).alias("path"), F.coalesce("error", "reason").alias("reason"), F.when(F.col("error").isNotNull(), "error").alias("kind"))
    gone = folders.where("bad is not null or coalesce(unavailable, false)").select(where.alias("path"), F.coalesce("bad", F.lit("unavailable")).alias("reason"), F.when(F.col("bad").isNotNull(), "error").alias("kind"))
    return sources, report.unionByName(gone)


# --- reading an archive from disk ---------------------------------------------------------------------------------------------------------------


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _plain(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/*(?=/)", "")


def read_manifest(spark: SparkSession, root: str) -> DataFrame | None:
    """(root, item, meta) of an archive; None for a folder without a manifest of folders. A list with bad entries beside good ones is an error."""
    root = root.rstrip("/")
    found = next((n for n in MANIFESTS if _exists(spark, f"{root}/{n}")), None)
    if found is None:
        return None
    rows = spark.read.text(f"{root}/{found}", wholetext=True).select(F.from_json("value", "array<string>").alias("all"))
    shape = rows.select(F.size("all").alias("n"), F.size(F.filter("all", lambda x: F.get_json_object(x, "$.folder").isNotNull())).alias("good")).first()
    if shape is None or shape.n < 0 or (shape.n > 0 and shape.good == 0):
        return None
    if shape.good < shape.n:
        raise ValueError("every entry of the manifest needs a folder")
    items = rows.select(F.explode("all").alias("item")).select("item", F.coalesce(F.get_json_object("item", "$.meta_path"), F.concat(F.rtrim(F.get_json_object("item", "$.folder"), F.lit("/")), F.lit("/meta.json"))).alias("meta_path"))
    metas = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root, wholetext=True).select(F.regexp_replace(_plain(F.col("_metadata.file_path")), "^.*?" + root + "/", "").alias("meta_path"), F.col("value").alias("meta"))
    return items.join(metas, "meta_path", "left").select(F.lit(root).alias("root"), "item", "meta")


def files_on_disk(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files under a folder; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(_plain(F.col("path")).alias("path"), "length")


def scanned(files: DataFrame, base: str, company: str) -> tuple[DataFrame, DataFrame]:
    """(sources, report) of a plain folder's files (path): hidden and technical folders are passed over, other formats reported."""
    parts = F.split(F.substring("path", len(base.rstrip("/")) + 2, 1 << 20), "/")
    own = files.where(~F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(*PASSED_OVER)))
    fine = suffix_of(F.col("path")).isin(*SUPPORTED)
    stem = F.regexp_replace(name_of(F.col("path")), r"(?<=[^.])\.[^.]+$", "")
    none = F.lit(None).cast("string")
    sources = own.where(fine).select(F.sha2(F.concat(F.lit(company + "\0"), F.col("path")), 256).alias("id"), F.lit(company).alias("company"), stem.alias("title"), F.lit("document").alias("category"), none.alias("publication_date"), none.alias("publication_period"), F.lit("Unknown publication date").alias("date_basis"), F.lit("local").alias("scope"), F.lit("").alias("source_url"), "path")
    return sources, own.where(~fine).select("path", F.lit("unsupported").alias("reason"), none.alias("kind"))
