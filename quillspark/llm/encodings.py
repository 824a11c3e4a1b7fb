"""Text that was decoded with the wrong character encoding (problem 9): mappings learned from twins.

Twins are two stretches that agree once non-ASCII characters are stripped: clauses with the same ASCII letters, or what follows and precedes the same
ASCII word in text that has few letters of that kind. The more usual of two twins is the clean one; of several that a clause may have, the
one that explains most of it. Their non-ASCII runs are aligned side by side, and each aligned pair is asked which chains of (written in, read as) turn the clean run into the garbled one; so the pairs fill byte maps. A map is learned when
enough aligned characters confirm it that no better confirmed map explains; the published code page it agrees with supplies the bytes that no twin
showed. Pairs that no map explains, because characters were lost, are learned as they are; a character that stands for several others in twins is
learned as a lost mark.

Only what was learned is applied to the rest of the corpus: without twins nothing is flagged or changed. A change is accepted if the words and
characters it brings are far more usual in the corpus than those it takes away.

Defined results: null and empty texts are never garbled and come back as they are; a learned lost mark shows a garbled passage even where nothing can
be restored; a null id keeps its row; repeated rows are repeated; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.staging import stage

# Published code pages that a learned byte map may turn out to be, and encodings text is written in.
PAGES = (
    "cp1252 latin-1 cp1250 cp1251 cp1253 cp1254 cp1257 cp437 cp850 cp852 cp858 cp866 iso8859_2 iso8859_5 iso8859_7 iso8859_9 iso8859_15 koi8_r mac_roman mac_latin2 mac_cyrillic"
).split()
WRITTEN = ("utf-8", "cp1252", "latin-1", "gb18030")
MULTIBYTE = "gb18030"
#: A word counts as usual from this share of the documents on, and from this number.
USUAL_SHARE, USUAL_LEAST = 1e-4, 3
#: Aligned characters that have to confirm a map, and different characters that a lost mark has to stand for.
LEARNED_LEAST, LOST_LEAST = 3, 3
#: Letters a clause has to keep, once stripped, to have twins; letters of a word that anchors the text beside it, and how much of that is aligned.
SKELETON, ANCHOR, BESIDE = 7, 4, 24
#: Characters next to an anchor in which a garbled text and what a chain makes of a clean one have to agree.
AGREE = 4
SALTS = 16
#: How much more usual (as a factor) the words a repair brings must be.
GAIN = 3.0

_WIDE = "⺀-鿿豈-﫿＀-￯-"
_WIDE_JAVA = r"[\x{2E80}-\x{FAFF}\x{FF00}-\x{10FFFF}]"  # as _is_wide
_TOKEN = re.compile(rf"[{_WIDE}]|[A-Za-z]*[^\x00-\x7f{_WIDE}][^\x00-\x40\x5b-\x60\x7b-\x7f{_WIDE}]*")
_RUN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(rf"[A-Za-z]*[^\x00-\x7f{_WIDE}][^\x00-\x40\x5b-\x60\x7b-\x7f{_WIDE}]*")
_CLAUSE = re.compile(r"[.;,。；，\n]")
_NOT_LETTER = bytes(b for b in range(128) if not chr(b).isalpha())
_VARYING = re.compile(r"[0-9%]+")
_ANCHORED = re.compile(rf"([^\x00-\x7f]*)(?<![A-Za-z])([A-Za-z]{{{ANCHOR},}})(?![A-Za-z])(?=([^\x00-\x7f]*))")
_UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")

Step = tuple[str, str]


# --- byte maps ---------------------------------------------------------------------------------------------------------------------------------


@lru_cache(maxsize=None)
def _byte_of(page: str) -> dict[str, int]:
    """Characters of a code page by byte; bytes it leaves undefined stand for themselves, as lenient decoders have it."""
    found = {}
    for b in range(128, 256):
        try:
            found[bytes([b]).decode(page)] = b
        except UnicodeDecodeError:
            found[chr(b)] = b
    return found


@lru_cache(maxsize=None)
def _char_of(page: str) -> tuple[str, ...]:
    own = {b: c for c, b in _byte_of(page).items()}
    return tuple(own.get(b, chr(b)) for b in range(256))


def candidates() -> dict[str, tuple[Step, ...]]:
    """Chains of (written in, read as) by name: what the aligned pairs are asked. None is applied unless it is learned."""
    once = {f"{w} as {p}": ((w, p),) for w in WRITTEN for p in (*PAGES, MULTIBYTE) if w != p and not (p == MULTIBYTE and w != "utf-8")}
    return once | {f"utf-8 as {p} twice": (("utf-8", p), ("utf-8", p)) for p in PAGES}


CANDIDATES = candidates()


def garble(text: str, steps: tuple[Step, ...]) -> str | None:
    """What a chain makes of a text; None where it can't be written so."""
    for written, page in steps:
        try:
            raw = text.encode(written)
        except UnicodeError:
            return None
        text = raw.decode(page, "replace") if page == MULTIBYTE else "".join(map(_char_of(page).__getitem__, raw))
    return text


@lru_cache(maxsize=None)
def _utf8_run(page: str) -> re.Pattern:
    return re.compile("[" + re.escape("".join(_byte_of(page))) + "]{2,}")


def _undo_step(text: str, written: str, page: str) -> str:
    if page == MULTIBYTE:
        return text.encode(MULTIBYTE, "ignore").decode(written, "replace")
    table = _byte_of(page)
    if written == MULTIBYTE:
        if any(ord(c) > 127 and c not in table and c != "�" for c in text):
            return text
        return b"".join(bytes([table.get(c, 0xFF)]) if ord(c) > 127 else c.encode() for c in text).decode(MULTIBYTE, "replace")
    if written != "utf-8":
        return "".join(bytes([table[c]]).decode(written, "ignore") or c if c in table else c for c in text)

    def mend(m: re.Match) -> str:
        # UTF-8 sequences are put together again; whatever forms none stays.
        raw, out, at = bytes(table[c] for c in m[0]), [], 0
        for s in _UTF8.finditer(raw):
            try:
                whole = s[0].decode("utf-8")
            except UnicodeDecodeError:
                continue
            out += [m[0][at : s.start()], whole]
            at = s.end()
        return "".join([*out, m[0][at:]])

    return _utf8_run(page).sub(mend, text)


def undo(text: str, steps: tuple[Step, ...]) -> str:
    for written, page in reversed(steps):
        text = _undo_step(text, written, page)
    return text


# --- twins -------------------------------------------------------------------------------------------------------------------------------------


def words(line: str) -> list[str]:
    """Words with non-ASCII characters, wide characters left out."""
    return [w for part in line.split(" ") if not part.isascii() for w in _WORD.findall(part)]


def tokens(line: str) -> list[str]:
    """Words with non-ASCII characters; wide characters one by one."""
    return _TOKEN.findall(line)


def _is_wide(token: str) -> bool:
    return len(token) == 1 and token >= "⺀" and not "ﬀ" <= token <= "﻿"


def stripped(line: str):
    """(key, form) of the stretches of a line that may have twins."""
    for clause in _CLAUSE.split(_VARYING.sub("", line)):
        if not clause.isascii() and len(key := clause.encode("ascii", "ignore").translate(None, _NOT_LETTER)) >= SKELETON:
            yield key.decode(), clause.strip()
    for m in _ANCHORED.finditer(line):
        if len(m[1]) >= ANCHOR:
            yield "<" + m[2], m[1][-BESIDE:]
        if len(m[3]) >= ANCHOR:
            yield ">" + m[2], m[3][:BESIDE]


def align(garbled: str, clean: str) -> list[tuple[str, str]]:
    """The non-ASCII runs of two texts of equal ASCII skeleton, side by side."""
    a, b = _RUN.findall(garbled), _RUN.findall(clean)
    if len(a) != len(b) or _RUN.sub("\0", garbled).replace(" ", "") != _RUN.sub("\0", clean).replace(" ", ""):
        return []
    return [(x, y) for x, y in zip(a, b) if x != y]


@lru_cache(maxsize=100_000)
def explained(garbled: str, clean: str) -> tuple[str, ...]:
    """The chains that turn a clean run into a garbled one."""
    return tuple(name for name, steps in CANDIDATES.items() if garble(clean, steps) == garbled)


@lru_cache(maxsize=50_000)
def _beside(clean: str, after: bool) -> dict[str, tuple[str, ...]]:
    """Chains with a multi-byte encoding in them, by the characters that they put next to the anchor in place of a wide text's."""
    found: dict[str, tuple[str, ...]] = {}
    for name, steps in CANDIDATES.items():
        if len(steps) > 1 or not (MULTIBYTE in steps[0] or steps[0][0] == "utf-8"):
            continue
        if not after and steps[0][1] == MULTIBYTE:
            continue  # where its characters begin can't be told from the end
        if (made := garble(clean, steps)) is not None and len(made) >= AGREE:
            head = made[:AGREE] if after else made[-AGREE:]
            found[head] = (*found.get(head, ()), name)
    return found


def explained_beside(key: str, garbled: str, clean: str) -> dict[str, int]:
    """Chains that turn the clean text beside an anchor into the garbled one as far as both go, with the number of characters they agree in."""
    found, after = {}, key[0] == ">"
    for name in _beside(clean, after).get(garbled[:AGREE] if after else garbled[-AGREE:], ()):
        made, way = garble(clean, CANDIDATES[name]), 1 if after else -1
        n = next((i for i, (x, y) in enumerate(zip(made[::way], garbled[::way])) if x != y), min(len(made), len(garbled)))
        if "�" not in (made[:n] if after else made[len(made) - n :]):
            found[name] = n
    return found


def _suspect(form: str) -> bool:
    """Whether text beside an anchor may be wide text that was misread: no wide characters, or bytes that are UTF-8."""
    if not any(map(_is_wide, form)):
        return True
    other = form.encode(MULTIBYTE, "ignore").decode("utf-8", "replace")
    return sum(map(_is_wide, other)) >= 2


# --- repair ------------------------------------------------------------------------------------------------------------------------------------


class Mender:
    """Repairs lines with the usual words of a corpus and what its twins taught: chains (with the characters that confirm them), runs, lost marks."""

    def __init__(self, usual: dict[str, int], learned: dict[str, int], runs: dict[str, str], lost: frozenset[str] = frozenset()):
        self.usual, self.learned, self.runs, self.lost = usual, learned, runs, frozenset(lost)
        self.least = math.log(GAIN)
        self.ways = [(n, lambda t, s=CANDIDATES[n]: undo(t, s)) for n in sorted(learned, key=lambda n: (-learned[n], n))]
        if runs:
            self.ways.append(("learned runs", self._from_runs))
        self.multi = next((n for n in learned if CANDIDATES[n][0][1] == MULTIBYTE), None)
        wide = [k for t, k in usual.items() if _is_wide(t)]
        # Wide characters in a hundredth as many documents as the most usual one are rare.
        self.rare = max(wide, default=0) / 100
        self.plain = {chr(c) for c in range(128)} | {t for t, k in usual.items() if _is_wide(t) and k > self.rare}
        self.cache: dict[str, frozenset[str]] = {}
        self.shapes = self._shapes() if self.lost else {}

    def _shapes(self) -> dict[str, str]:
        """Usual words by their form with every non-ASCII run stripped to one mark, where one word is by far the most usual."""
        best: dict[str, tuple[int, int, str]] = {}
        for w, n in self.usual.items():
            if len(w) > 2 and not w.isascii() and (low := _RUN.sub("\0", w)) != "\0":
                top, second, word = best.get(low, (0, 0, ""))
                best[low] = (n, top, w) if n > top else (top, max(second, n), word)
        return {k: w for k, (top, second, w) in best.items() if top >= 5 * max(1, second)}

    def _from_runs(self, text: str) -> str:
        """Puts what twins taught in place of their runs, in words that become more usual ones by it."""

        def mend(m: re.Match) -> str:
            word = m[0]
            other = word if word.isascii() or word in self.usual else _RUN.sub(lambda r: self.runs.get(r[0], r[0]), word)
            return other if other != word and self.gain(Counter([word]), other) >= self.least else word

        return _WORD.sub(mend, text)

    def _from_lost(self, text: str) -> str:
        """Words with a lost mark become the one usual word that is the same without its non-ASCII characters."""

        def mend(m: re.Match) -> str:
            word = m[0]
            return self.shapes.get(_RUN.sub("\0", word), word) if self.lost & set(word) else word

        return _WORD.sub(mend, text)

    def weight(self, token: str) -> float:
        return 0.0 if "�" in token else math.log1p(self.usual.get(token, 0))

    def _mean(self, c: Counter) -> float:
        return sum(self.weight(t) * k for t, k in c.items()) / max(1, sum(c.values()))

    def gain(self, before: Counter, line: str) -> float:
        """How much more usual the words are that a change brings than those it takes away, as a logarithm."""
        after = Counter(tokens(line))
        lost, won = before - after, after - before
        return self._mean(won) - self._mean(lost) if lost and won else -1.0

    def suspected(self, token: str) -> frozenset[str]:
        """The learned chains that, undone, make a more usual word of this one."""
        if (found := self.cache.get(token)) is None:
            before = Counter([token])
            found = frozenset(n for n, way in self.ways if n != self.multi and (t := way(token)) != token and self.gain(before, t) >= self.least)
            if len(self.cache) > 300_000:
                self.cache.clear()
            self.cache[token] = found
        return found

    def mend(self, text: str) -> str:
        """A text as it was written, as far as that can be told, line by line."""
        if not self.ways and not self.lost or self.plain.issuperset(text):
            return text
        return "\n".join(line if line.isascii() else self._line(line) for line in text.split("\n"))

    def _line(self, line: str) -> str:
        # A line with passages misread in several ways takes several rounds; every round brings more usual words, so they end.
        seen = {line}
        while (other := self._once(line)) not in seen:
            seen.add(other)
            line = other
        return self._from_lost(line) if self.lost & set(line) else line

    def _once(self, line: str) -> str:
        rest = set(line) - self.plain
        if not rest:
            return line
        names = set().union(*map(self.suspected, words(line)))
        if self.multi and (rare := [c for c in rest if _is_wide(c)]) and (wide := sum(map(_is_wide, line))) >= 4 and sum(map(line.count, rare)) > 0.2 * wide:
            names.add(self.multi)
        if not names:
            return line
        found = Counter(tokens(line))
        best, gained = line, 0.0
        for name, way in self.ways:
            if name in names and (other := way(line)) != line and (g := self.gain(found, other)) - self.least > gained + 1e-9:
                if name == self.multi and other.count("�") > 0.3 * len(other):
                    continue
                best, gained = other, g - self.least
        if best is not line:
            for t in set(tokens(best)):
                if t not in self.usual:
                    for run, clean in self.runs.items():
                        if run in t and (u := t.replace(run, clean)) in self.usual:
                            best = best.replace(t, u)
                            break
        return best


def confirmed(votes: dict[tuple[str, ...], int]) -> dict[str, int]:
    """Chains that explain enough aligned characters, best confirmed first, each counted for what those before it leave unexplained.

    votes: the numbers of characters in aligned pairs by the chains that explain them.
    """
    left, found = dict(votes), {}
    while left:
        total: Counter = Counter()
        for names, n in left.items():
            for name in names:
                total[name] += n
        best = min(total, key=lambda n: (-total[n], len(CANDIDATES[n]), list(CANDIDATES).index(n)))
        if total[best] < LEARNED_LEAST:
            break
        found[best] = total[best]
        left = {names: n for names, n in left.items() if best not in names}
    return found


def beside_pairs(forms: DataFrame) -> DataFrame:
    """(skeleton, garbled, clean, n): of texts beside anchors (skeleton, own, n), each that may be misread, with all wide ones beside the same anchor."""

    def suspects(batches):
        for pdf in batches:
            yield pdf[np.fromiter(map(_suspect, pdf.own), bool, len(pdf))]

    # Asked once a form, not once a pair; most are suspects, since U+FFFD counts as wide. Salted so that no anchor is one task.
    garbled = forms.select("skeleton", "own", "n").mapInPandas(suspects, "skeleton string, own string, n bigint")
    clean = forms.where(F.col("own").rlike(_WIDE_JAVA)).select("skeleton", F.col("own").alias("clean"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return garbled.withColumn("salt", F.pmod(F.hash("own"), F.lit(SALTS))).join(clean, ["skeleton", "salt"]).where(F.col("own") != F.col("clean")).select("skeleton", F.col("own").alias("garbled"), "clean", "n")


def learn(docs: DataFrame) -> Mender:
    """Reads the corpus once for its usual words and its twins. Taken to the driver: words above a share of the documents, votes by chain, and runs."""
    n = docs.count()

    def count(batches):
        for pdf in batches:
            usual, twins = Counter(), Counter()
            for text in pdf.text:
                if text is None or text.isascii():
                    continue
                own = set(filter(_is_wide, set(text)))
                for line in text.split("\n"):
                    if line.isascii():
                        continue
                    own.update(words(line))
                    twins.update(stripped(line))
                usual.update(own)
            rows = [("", w, c) for w, c in usual.items()] + [(k, v, c) for (k, v), c in twins.items()]
            yield pd.DataFrame(rows, columns=["skeleton", "own", "n"])

    seen = stage(docs.select("text").mapInPandas(count, "skeleton string, own string, n bigint").groupBy("skeleton", "own").agg(F.sum("n").alias("n")), "seen")
    least = max(USUAL_LEAST, math.ceil(USUAL_SHARE * n))
    usual = {r.own: r.n for r in seen.where((F.col("skeleton") == "") & (F.col("n") >= least)).select("own", "n").toLocalIterator()}
    # Every form is held against all that may be its clean one: clauses against those three times as usual of the same ASCII text, what stands beside an
    # anchor against all wide text beside it; salted so that no key is one task.
    anchored = F.col("skeleton").rlike("^[<>]")
    shape = F.regexp_replace(F.regexp_replace("own", r"[^\x00-\x7f]+", "0"), " ", "")
    twin = seen.where(F.col("skeleton") != "").where(~anchored).withColumn("shape", shape)
    clean = twin.where("n > 1").select("skeleton", "shape", F.col("own").alias("clean"), F.col("n").alias("times"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rest = twin.withColumn("salt", F.pmod(F.hash("own"), F.lit(SALTS)))
    pairs = rest.join(clean, ["skeleton", "shape", "salt"]).where((F.col("own") != F.col("clean")) & (F.col("times") >= 3 * F.col("n"))).select("skeleton", F.col("own").alias("garbled"), "clean", "n", "times")

    def told(batches):
        for pdf in batches:
            yield pdf.assign(told=[sum(len(run) for run, was in align(g, c) if explained(run, was)) for g, c in zip(pdf.garbled, pdf.clean)])

    # A clause was one text before: of all it was held against, the one that chains explain most of it from, and then the most usual.
    one = pairs.mapInPandas(told, "skeleton string, garbled string, clean string, n bigint, times bigint, told bigint").groupBy("skeleton", "garbled", "n").agg(F.max(F.struct("told", "times", "clean")).alias("best"))
    pairs = beside_pairs(seen.where(anchored)).unionByName(one.select("skeleton", "garbled", F.col("best.clean").alias("clean"), "n"))

    def infer(batches):
        for pdf in batches:
            out = Counter()
            for key, garbled, clean, k in pdf.itertuples(index=False):
                if key[0] in "<>":
                    if names := explained_beside(key, garbled, clean):
                        most = max(names.values())
                        out["chain", "|".join(x for x in names if names[x] == most), ""] += k * (most // 2)
                    continue
                for run, was in align(garbled, clean):
                    if names := explained(run, was):
                        out["chain", "|".join(names), ""] += k * len(was)
                    else:
                        out["run", run, was] += k
            yield pd.DataFrame([(*key, k) for key, k in out.items()], columns=["kind", "what", "was", "n"])

    taught = pairs.mapInPandas(infer, "kind string, what string, was string, n bigint").groupBy("kind", "what", "was").agg(F.sum("n").alias("n")).where(F.expr(f"kind = 'chain' or n >= {max(2, least // 2)}")).collect()
    learned = confirmed({tuple(r.what.split("|")): r.n for r in taught if r.kind == "chain"})
    by_run: dict[str, Counter] = {}
    for r in taught:
        if r.kind == "run":
            by_run.setdefault(r.what, Counter())[r.was] += r.n
    runs = {run: c.most_common(1)[0][0] for run, c in by_run.items() if c.most_common(1)[0][1] >= 0.8 * sum(c.values())}
    # A lost mark stands for several others and is hardly ever what stands on the clean side.
    clean_side: Counter = Counter()
    for c in by_run.values():
        clean_side.update(c)
    lost = {run for run, c in by_run.items() if len(run) == 1 and not run.isalpha() and len(c) >= LOST_LEAST and run not in runs and sum(c.values()) >= 4 * clean_side[run]}
    return Mender(usual, learned, runs, frozenset(lost))


def restore(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, lines_restored, lost): every document, its text restored as far as it is still there; lost counts the lost marks it came with."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    mender = learn(rows)
    shared = docs.sparkSession.sparkContext.broadcast((mender.usual, mender.learned, mender.runs, mender.lost))

    def run(batches):
        own = Mender(*shared.value)
        for pdf in batches:
            texts, changed, lost = [], [], []
            for text in pdf.text:
                if text is None or text.isascii():
                    texts.append(text)
                    changed.append(0)
                    lost.append(0)
                    continue
                mended = own.mend(text)
                texts.append(mended)
                changed.append(0 if mended == text else sum(a != b for a, b in zip(text.split("\n"), mended.split("\n"))))
                lost.append(sum(map(text.count, own.lost)))
            yield pd.DataFrame({"doc": pdf.doc, "text": texts, "lines_restored": changed, "lost": lost})

    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc {kind}, text string, lines_restored int, lost int").withColumnRenamed("doc", id_col)
