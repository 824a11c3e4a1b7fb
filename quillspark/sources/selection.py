"""Which registered files of an archive folder are evidence, and why the others aren't: one expression, first rule wins, null keeps the file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats that can be read, names of files, and categories that the rules name.
SUPPORTED = (".html", ".htm", ".txt", ".md", ".pdf", ".docx", ".pptx", ".xlsx", ".xls", ".csv")
NOTICES = ("streaming_links.txt", "online_viewers.txt", "online_links.txt", "unavailable.txt", "source_url.txt", "webcast.txt")
WRAPPERS = ("page.html", "page.txt", "article.html", "ir_filing.html", "sec_filing_index.html", "filing_detail.html", "filing_detail.txt", "source_listing_row.html")
RENDERED = ("primary_document.html", "primary_document.pdf", "primary_document.txt")
FILING_MIRRORS = ("filing.html", "html.html")
FILING_FORMATS = ("ir_filing.pdf", "ir_filing.docx", "ir_filing.xlsx")
ACCESSION_FORMATS = (".pdf", ".docx", ".rtf.docx", ".xls", ".xlsx")
FORMAT_ORDER = (".pdf", ".docx", ".xls", ".xlsx")
PAGES = ("page.html", "page.txt", "article.html")
COLLECTION_PAGES = ("financial_results", "annual_reports")
COLLECTION_SOURCES = ("quarterly_results", "annual_report", "investor_presentation", "current_governance_document")
CAPTURES = ("source_html", "rendered_html", "readable_text", "original_http_html", "readable_offline_html", "page_text", "original_html", "article_text", "readable_article_html")
ATTACHMENTS = ("attachment", "document_attachment", "pdf_attachment", "alternative_attachment")
PAGE_FIRST, TEXT_FIRST = ("article.html", "page.html", "page.txt"), ("article.html", "page.txt", "page.html")
PAGE_FIRST_CATEGORIES = ("ir_news", "press_release")
LISTINGS = ("source_listing.html", "source_fragment.html", "listing_entry.html", "listing.txt", "ir_page.html", "ir_page.txt", "ir_article.html")
RELEASE_CATEGORIES = ("ir_news", "press_releases", "news")


def name_of(path: Column) -> Column:
    """The last part of a path."""
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def suffix_of(path: Column) -> Column:
    """The ending of a name, in small letters; none where the only dot is the first character or the last."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)/*$", 1))


def _any(candidates: Column, names) -> Column:
    return F.arrays_overlap(candidates, F.array(*map(F.lit, names)))


def left_out(path: Column, candidates: Column, category: Column, accession: Column, primary: Column, kind: Column, file_url: Column, material_url: Column, attached: Column) -> Column:
    """The rule that leaves a file out, or null.

    path: within its folder; candidates: all registered paths of the folder; primary: the primary document's name; kind, file_url: of this file's
    record; material_url: of the folder; attached: whether an attachment of the folder is the material itself.
    """
    blank = lambda c: F.coalesce(c, F.lit(""))
    category, accession, primary, own = blank(category), blank(accession), name_of(blank(primary)), name_of(path)
    have = lambda name: F.array_contains(candidates, name)
    filing = F.startswith(category, F.lit("sec_"))

    found = (primary != "") & (have(primary) | have(F.concat(F.lit("sec_documents/"), primary)))
    as_html = found & suffix_of(primary).isin(".html", ".htm")
    named = lambda x: reduce(lambda a, e: a | (name_of(x) == F.concat(accession, F.lit(e))), ACCESSION_FORMATS, F.lit(False))
    versions = F.filter(candidates, lambda x: (accession != "") & named(x))
    order = lambda x: F.array_position(F.array(*map(F.lit, FORMAT_ORDER)), suffix_of(x))
    best = F.array_min(F.transform(versions, lambda x: F.struct(order(x).alias("o"), x.alias("x"))))["x"]
    version = F.array_contains(versions, path)

    readable = lambda names: F.coalesce(*(F.when(have(F.lit(n)), F.lit(n)) for n in names))
    page = F.when(category.isin(*PAGE_FIRST_CATEGORIES), readable(PAGE_FIRST)).otherwise(readable(TEXT_FIRST))
    language = F.regexp_extract(own, r"^content_([\p{L}\p{N}_-]+)\.txt$", 1)
    foreign = F.coalesce(own.isin(*PAGES) & kind.isin(*CAPTURES) & (file_url != "") & (material_url != "") & (file_url != material_url), F.lit(False))

    any_file = [
        ("unsupported", ~suffix_of(path).isin(*SUPPORTED)),
        ("notice", own.isin(*NOTICES) | F.endswith(own, F.lit(".excerpt.txt")) | F.startswith(own, F.lit("unavailable_")) | F.contains(own, F.lit("streaming")) | F.contains(own, F.lit("online_viewer"))),
    ]
    filings = [
        ("wrapper", F.endswith(own, F.lit("-index.html")) | F.endswith(own, F.lit("-index-headers.html")) | own.isin(*WRAPPERS)),
        ("bundle", (own == "complete_submission.txt") | ((accession != "") & (own == F.concat(accession, F.lit(".txt"))))),
        ("generated_view", own.rlike(r"^R\d+\.htm$") & as_html),
        ("primary_mirror", own.isin(*FILING_MIRRORS, RENDERED[0]) & as_html),
        ("primary_format", own.isin(*FILING_FORMATS) & (found | _any(candidates, RENDERED))),
        ("accession_format", version & (as_html | (path != best))),
        ("rendered_mirror", own.isin(*FILING_MIRRORS) & ~as_html & F.exists(versions, lambda x: suffix_of(x) == ".pdf")),
    ]
    others = [
        ("collection", (category.isin(*COLLECTION_PAGES) & own.isin(*PAGES)) | (category.isin(*COLLECTION_SOURCES) & own.isin("source.html", "source.txt")) | own.rlike(r"^source_page_\d+\.html$")),
        ("foreign_capture", foreign & (F.coalesce(attached, F.lit(False)) | (category == "quarterly_results"))),
        ("other_page", path.isin(*PAGES) & ~path.eqNullSafe(page)),
        ("text_of_source", own.isin("content.txt", "source.txt") & have(F.lit("source.html"))),
        ("text_of_language", (language != "") & have(F.concat(F.lit("page_"), language, F.lit(".html")))),
        ("listing", page.isNotNull() & own.isin(*LISTINGS)),
        ("merged_mirror", page.isNotNull() & (F.startswith(own, F.lit("main_site_")) | F.startswith(own, F.lit("ir_mirror_")))),
        ("release_pdf", page.isNotNull() & (own == "release.pdf") & category.isin(*RELEASE_CATEGORIES)),
    ]
    rules = any_file + [(n, filing & c) for n, c in filings] + [(n, ~filing & c) for n, c in others]
    return F.coalesce(*(F.when(c, F.lit(n)) for n, c in rules))
