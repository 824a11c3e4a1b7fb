"""Column functions on text. All stay in the JVM; patterns use Unicode classes, as Python's do."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words a question's terms leave out, and how many terms count.
STOP_WORDS = "the a an of in to for and or is was were what how did does by with on as its it at from".split()
MOST_TERMS = 40
# Runs of blank lines that become one, and where an alias may stand.
BLANK_LINES = r"\n[ \t]*\n(?:[ \t]*\n)+"
BEFORE_ALIAS, AFTER_ALIAS = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}\p{Co}]+"


def _folding() -> tuple[str, str]:
    """Small letters that are an ASCII letter with one mark, and these ASCII letters. Letters with several marks stay as they are."""
    found = {}
    for code in (*range(0x00E0, 0x0250), *range(0x1E00, 0x1F00)):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) == 2 and parts[0].isascii() and parts[0].islower() and unicodedata.combining(parts[1]):
            found[chr(code)] = parts[0]
    return "".join(found), "".join(found.values())


MARKED, FOLDED = _folding()


def clean(text: Column) -> Column:
    """Without NUL and CR, no-break spaces as blanks, runs of blank lines as one, trimmed. Null stays null."""
    plain = F.replace(F.replace(F.replace(text, F.lit("\0"), F.lit("")), F.lit("\r"), F.lit("")), F.lit("\u00a0"), F.lit(" "))
    return F.regexp_replace(F.regexp_replace(plain, BLANK_LINES, "\n\n"), r"(?U)^\s+|\s+$", "")


def normalised(text: Column) -> Column:
    """White space runs as one blank, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def compact(text: Column) -> Column:
    """Without white space and commas, so that numbers compare."""
    return F.regexp_replace(text, r"(?U)[\s,]", "")


def fold(text: Column) -> Column:
    """Lower case without the marks of Latin letters, composed or not; a final sigma is a sigma."""
    return F.regexp_replace(F.translate(F.lower(text), MARKED + "ς", FOLDED + "σ"), "[\u0300-\u0362]", "")


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits, in order; an empty list for null."""
    return F.coalesce(F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def question_terms(text: Column) -> Column:
    """A question's terms in order: its first MOST_TERMS different words that are no stop words, each as a phrase of tokens with blanks between them.

    Words differ before folding, so that two that fold to one token are two terms; a word with an underscore is a phrase of several tokens.
    """
    words = F.slice(F.filter(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))), lambda w: ~w.isin(STOP_WORDS)), 1, MOST_TERMS)
    return F.filter(F.transform(words, lambda w: F.array_join(tokens(w), " ")), lambda w: w != "")


def day_number(day: Column) -> Column:
    """YYYYMMDD of an ISO day; null for anything else."""
    return F.when(real_day(day), F.replace(day, F.lit("-"), F.lit("")).cast("int"))


def real_day(day: Column) -> Column:
    """Whether a text is a day of the calendar as YYYY-MM-DD."""
    return F.coalesce(day.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(day).isNotNull(), F.lit(False))


def demoted(date: Column) -> tuple[Column, Column]:
    """(day, period): a year or a month of the calendar is no day but a period."""
    partial = date.rlike(r"^\d{4}(-\d{2})?$") & F.try_to_date(F.concat(date, F.when(F.length(date) == 4, "-01-01").otherwise("-01"))).isNotNull()
    return F.when(~partial, date), F.when(partial, date)


def boundary_pattern(alias: Column) -> Column:
    """Matches an alias whatever its case, with no ASCII word character beside it."""
    return F.concat(F.lit("(?iu)" + BEFORE_ALIAS + r"\Q"), alias, F.lit(r"\E" + AFTER_ALIAS))
