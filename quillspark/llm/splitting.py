"""Splitting oversized chunks at natural boundaries (problem 4): balanced targets.

The least number of pieces that can hold a text is found first; equally spaced targets are laid out and each is moved to the strongest boundary
near it. If a piece then exceeds the limit, one more piece is tried. Prose pieces overlap, tables repeat their heading instead.

Defined results: null texts and texts within the limit stay as they are, as one piece with the locator unchanged; a null locator gives
``part N``; repeated rows count once (by id); extra columns are ignored.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LIMIT = 2_600
OVERLAP = 250
ROWS = "\n[Rows]\n"
#: Blocks of ordinals whose totals are added up first, so that one huge document isn't one task.
BLOCK = 1_024

# Kinds of boundary and their strength; a cut lies after the match.
_KINDS = [(re.compile(r"\n[ \t]*\n\s*"), 6.0), (re.compile(r"\n"), 4.0), (re.compile(r"[.!?…][\"”»’)\]]*\s+|[。！？][”」』）]*\s*"), 3.0), (re.compile(r"[;:]\s+|[；：]"), 2.0), (re.compile(r",\s+|[，、]|\s[–—]\s"), 1.3), (re.compile(r" \| "), 1.2), (re.compile(r"\s+"), 1.0)]


def _cuts(text: str) -> dict[int, float]:
    found: dict[int, float] = {}
    for pattern, strength in reversed(_KINDS):
        for m in pattern.finditer(text):
            found[m.end()] = max(strength, found.get(m.end(), 0))
    return found


def _snap(cuts: dict[int, float], target: int, low: int, high: int, reach: int) -> int:
    """The best cut near target: strength less the distance as a share of reach. A hard cut where there is none."""
    near = range(max(low, target - reach), min(high, target + reach) + 1)
    best, at = 0.0, 0
    for p in near:
        if (s := cuts.get(p)) and (score := s * (1 - 0.6 * abs(p - target) / (reach + 1))) > best:
            best, at = score, p
    return at if best else max(low, min(high, target))


def _start(text: str, cuts: dict[int, float], end: int, overlap: int, low: int) -> int:
    """Where the piece after a cut at end starts: a natural boundary at most overlap characters back."""
    best, at = 0.0, end
    for p in range(max(low, end - overlap), end):
        if (s := cuts.get(p)) and min(s, 3.0) > best:
            best, at = min(s, 3.0), p
    return at


def spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of pieces of at most limit characters that cover text, each starting at most overlap before the last one's end."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    cuts = _cuts(text)
    pieces = max(2, -(-n // limit))
    while True:
        step, out, start = n / pieces, [], 0
        reach = int(min(step * 0.3, limit * 0.3))
        for i in range(1, pieces):
            end = _snap(cuts, round(step * i), start + 1 + (overlap if out else 0), min(n - 1, start + limit), reach)
            if not start < end <= start + limit or end >= n:
                break
            out.append((start, end))
            start = _start(text, cuts, end, overlap, start + 1) if overlap else end
        else:
            if n - start <= limit:
                return [*out, (start, n)]
        pieces += 1
        if pieces > n:
            return [(i, min(n, i + limit)) for i in range(0, n, limit)]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, str]]:
    """(start, end, piece) of a text. A table's pieces hold its heading and whole rows where a row fits; start and end are those of the body."""
    if len(text) <= limit:
        return [(0, len(text), text)]
    head, mark, body = text.partition(ROWS)
    if not mark or not body.strip():
        return [(a, b, text[a:b]) for a, b in spans(text, limit, overlap)]
    prefix = head + mark
    if len(prefix) <= limit // 2:
        at = len(prefix)
        return [(at + a, at + b, prefix + body[a:b].rstrip("\n")) for a, b in spans(body, limit - at, 0)]
    # A heading too long to repeat whole is itself split, and its first part is repeated before the rows.
    short = head[: limit // 3] + mark
    first = [(a, b, head[a:b]) for a, b in spans(head, limit, 0)]
    at = len(prefix)
    return [*first, *((at + a, at + b, short + body[a:b].rstrip("\n")) for a, b in spans(body, limit - len(short), 0))]


def split_chunks(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(chunk_id, document_id, ordinal, text, locator, text_hash, part, parts, char_start, char_end) of all chunks, ordinals counted anew."""
    if limit < 50 or not 0 <= overlap < limit // 2:
        raise ValueError("limit must be at least 50 and overlap below half of it")
    rows = chunks.select(F.col("id").alias("chunk_id"), "document_id", F.col("ordinal").alias("old"), "text", "locator", "text_hash")
    big = F.coalesce(F.char_length("text"), F.lit(0)) > limit

    def cut(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                found = split_text(r.text, limit, overlap)
                for i, (a, b, piece) in enumerate(found, 1):
                    out.append((r.chunk_id, r.document_id, r.old, piece, f"{r.locator}, part {i}" if r.locator else f"part {i}", i, len(found), a, b))
            yield pd.DataFrame(out, columns=["chunk_id", "document_id", "old", "text", "locator", "part", "parts", "char_start", "char_end"])

    # The few oversized rows are told apart before repeated ones meet, so that the others needn't move for them.
    pieces = rows.where(big).dropDuplicates(["chunk_id"]).mapInPandas(cut, "chunk_id bigint, document_id string, old int, text string, locator string, part int, parts int, char_start int, char_end int").withColumn("text_hash", F.sha2("text", 256))
    # How far each chunk moves: the pieces added before it in its document, summed by block and then within the block.
    narrow = pieces.where("part = 1").select("document_id", "old", "chunk_id", (F.col("parts") - 1).alias("more"))
    block = F.floor(F.col("old") / BLOCK)
    by_block = narrow.groupBy("document_id", block.alias("block")).agg(F.sum("more").alias("more"), F.array_sort(F.collect_list(F.struct("old", "chunk_id", "more"))).alias("own"))
    earlier = Window.partitionBy("document_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    moved = by_block.select("document_id", "block", F.coalesce(F.sum("more").over(earlier), F.lit(0)).alias("before"), "own")
    # Chunks after the last block with splits of their document get the block's total: the blocks form ranges.
    following = Window.partitionBy("document_id").orderBy("block")
    moved = moved.withColumn("until", F.lead("block").over(following))
    kept = rows.where(~big).dropDuplicates(["chunk_id"]).select("chunk_id", "document_id", "old", "text", "locator", F.lit(1).alias("part"), F.lit(1).alias("parts"), F.lit(0).alias("char_start"), F.coalesce(F.char_length("text"), F.lit(0)).alias("char_end"), "text_hash")
    every = kept.unionByName(pieces)
    shift = F.expr("before + aggregate(filter(own, x -> x.old < o or (x.old = o and x.chunk_id < c)), 0L, (a, x) -> a + x.more)")
    b = moved.select(F.col("document_id").alias("d"), "block", "until", "before", "own")
    joined = every.join(b, (F.col("document_id") == F.col("d")) & (block >= F.col("block")) & (F.col("until").isNull() | (block < F.col("until"))), "left")
    joined = joined.withColumn("o", F.col("old")).withColumn("c", F.col("chunk_id"))
    ordinal = (F.col("old") + F.coalesce(shift, F.lit(0)) + F.col("part") - 1).cast("int")
    return joined.select("chunk_id", "document_id", ordinal.alias("ordinal"), "text", "locator", "text_hash", "part", "parts", "char_start", "char_end")
