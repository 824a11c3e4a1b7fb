"""Noise in text from scanned pages (problem 1): an averaged-perceptron editor.

The editor walks a text and predicts one operation a site: at a line, keep it or delete it as page furniture (by its position on the page, its
make-up and how its neighbours go on); at a line's end, keep the break, join with a blank, join without, or delete the hyphen mark and join; at
a word, keep its characters, or replace some, delete one or insert one. What may be replaced by what, whether characters get lost or doubled, and all
weights are learned by aligning the characters of proofs with those of their texts; at most ``MOST_PROOFS`` proofs are used. How usual words are is
counted over all chunks; a word is only changed into a more usual one.

Proofs tell which kinds of locator (their letters) belong to pages that were never scanned: those whose proofs all left the text as it was. A bounded
sample of chunks of these kinds serves as further examples of lines to keep.

Defined results: null and empty texts come back as they are; rows of a table (after its ``[Rows]`` line) are never edited, and the lines before them only
where some proof is of a table, as else nothing was learned about such lines; they are never joined; repeated rows count once (by id); a text without a site at which an operation other than keeping or joining lines wins has no residue and comes
back unchanged.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher
from itertools import repeat

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.staging import stage

MOST_PROOFS = 800
#: Proofs of a kind of locator that have to agree that it is never scanned, and chunks of such kinds that serve as examples.
LEAST_AGREEING, MOST_UNSCANNED = 5, 600
EPOCHS = 6
#: A word is counted as usual from this share of all words on, and from this number.
USUAL_SHARE, USUAL_LEAST = 1e-6, 3

_WORD = re.compile(r"[^\W_]+(?:[’'][^\W_]+)?")
_COMPOUND = re.compile(r"[^\W\d_]{2,}-[^\W\d_]{2,}")
_CJK = re.compile(r"[㐀-䶿一-鿿豈-﫿]")
_CJK_RUN = re.compile(r"[㐀-䶿一-鿿豈-﫿]+")
_MARKS = "-‐‑‒–¬\xad"
_TOKEN = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[^\W_㐀-䶿一-鿿]+|\s+|.", re.S)
TABLE = "\n[Rows]\n"
_YEAR, _PARTED, _DIGITS = re.compile(r"\b(?:19|20)\d\d\b"), re.compile(r" [|–—·] "), re.compile(r"[0-9]+")
_NO_LETTER, _NO_CAPITAL, _NO_DIGIT = (bytes(b for b in range(128) if not kind(chr(b))) for kind in (str.isalpha, str.isupper, str.isdigit))
_NUMBER = re.compile(r"[\W_]*(?:[^\W\d_]{1,9}\.?\s*)?\d{1,4}(?:\s*(?:/|of|von|de|di|sur|из|\|)\s*\d{1,4})?[\W_]*|第?\s*\d{1,4}\s*[页頁].*", re.I)


class Perceptron:
    """Averaged weights of (feature, operation)."""

    def __init__(self):
        self.w: dict[tuple[str, str], float] = defaultdict(float)
        self._sum: dict[tuple[str, str], float] = defaultdict(float)
        self._at: dict[tuple[str, str], int] = defaultdict(int)
        self.steps = 0
        self.by: dict[str, dict[str, float]] | None = None

    def fix(self) -> None:
        """Lays the weights out by operation, for applying them only."""
        self.by = {}
        for (f, o), v in self.w.items():
            self.by.setdefault(o, {})[f] = v

    def scores(self, features: list[str], ops: tuple[str, ...]) -> list[float]:
        if self.by is not None:
            return [sum(map(self.by[o].get, features, repeat(0.0))) if o in self.by else 0.0 for o in ops]
        w = self.w
        return [sum(w.get((f, o), 0.0) for f in features) for o in ops]

    def predict(self, features: list[str], ops: tuple[str, ...]) -> str:
        s = self.scores(features, ops)
        return ops[s.index(max(s))]

    def _add(self, key: tuple[str, str], by: float) -> None:
        self._sum[key] += (self.steps - self._at[key]) * self.w[key]
        self._at[key] = self.steps
        self.w[key] += by

    def learn(self, features: list[str], ops: tuple[str, ...], gold: str) -> None:
        self.steps += 1
        if (said := self.predict(features, ops)) != gold:
            for f in features:
                self._add((f, gold), 1.0)
                self._add((f, said), -1.0)

    def average(self) -> dict[tuple[str, str], float]:
        for key in list(self.w):
            self._add(key, 0.0)
        return {k: round(self._sum[k] / max(1, self.steps), 6) for k in self.w if self._sum[k]}


LINE_OPS = ("keep", "delete")
BREAK_OPS = ("blank", "join", "dehyphen", "break", "paragraph")
CHAR_OPS = ("keep", "replace", "delete", "insert")
#: Letters of a word in which a lost or doubled character can be told.
LEAST_WORD = 4


class _Classes(dict):
    """Characters by class, each looked at once."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = k = "9" if c.isdigit() else "x" if c.islower() else "X" if c.isupper() else "字" if _CJK.match(c) else "_" if c.isspace() else c
        return k


_CLASSES, _AGAIN = _Classes(), re.compile(r"(.)\1+", re.S)


def _shape(s: str) -> str:
    return _AGAIN.sub(r"\1", s[:40].translate(_CLASSES))[:14]


Page = tuple[int, int, Counter, list[str]]


def page(lines: list[str]) -> Page:
    """(median length, number) of a page's lines that aren't blank, how often each stands there, digits aside, and the lines so."""
    full = sorted(len(x) for x in lines if x.strip())
    plain = [_DIGITS.sub("#", x.strip()) for x in lines]
    return (full[len(full) // 2] if full else 1), len(full), Counter(plain), plain


def line_features(lines: list[str], i: int, own: Page) -> list[str]:
    """What tells page furniture: place on the page, make-up, length against the others, and whether its neighbours go on without it."""
    line = lines[i].strip()
    width, n, seen, plain = own
    before = next((x for k in range(i - 1, -1, -1) if (x := lines[k].strip())), "")
    after = next((x for k in range(i + 1, len(lines)) if (x := lines[k].strip())), "")
    # Counted in bytes, where deleting is fast; characters beyond ASCII count as small letters.
    raw = line.encode("ascii", "ignore")
    letters = len(line) - len(raw) + len(raw.translate(None, _NO_LETTER))
    upper = len(raw.translate(None, _NO_CAPITAL)) / letters if letters else -1
    digits = len(raw.translate(None, _NO_DIGIT)) / max(1, len(line))
    place = "first" if not before else "last" if not after else "inner"
    open_ = bool(before) and before[-1] not in ".!?。！？:：…" and not before.endswith((".”", ".»"))
    goes_on = "open" if open_ else "closed"
    end = "stop" if line[-1:] in ".!?。！？;；" else "comma" if line[-1:] in ",，、" else "mark" if line[-1:] in _MARKS else "none"
    lower_next = after[:1].islower() or after[:1].isdigit() or bool(_CJK.match(after[:1]))
    alone = (i == 0 or not lines[i - 1].strip()) and (i + 1 == len(lines) or not lines[i + 1].strip())
    size = min(5, int(5 * len(line) / max(1, width)))
    year = digits > 0 and ("19" in line or "20" in line) and bool(_YEAR.search(line))
    number = digits > 0 and bool(_NUMBER.fullmatch(line))
    title = letters > 0 and all(w[:1].isupper() or w[:1].isdigit() or not w[:1].isalpha() for w in line.split())
    caps = "caps" if upper > 0.9 else "some" if upper > 0.15 else "few"
    one = n == 1
    f = [
        "L", f"L place {place}", f"L size {size}", f"L caps {caps}", f"L end {end}", f"L {goes_on}", f"L num {number}", f"L title {title}", f"L year {year} {end} {size}", f"L shape {_shape(line)}",
        f"L {place} {goes_on} {lower_next}", f"L {goes_on} {end} {place} {size}", f"L {goes_on} {end} {year} {lower_next}", f"L num {number} alone {alone}", f"L title {title} {end} {size}", f"L caps {caps} {end} {year}", f"L title {title} {year} {goes_on}", f"L dig {int(digits * 4)} {size}",
        f"L seen {min(seen[plain[i]], 3)}", f"L one {one}", f"L title {title} {lower_next} {place} {end}", f"L title {title} {place} alone {alone}", f"L sep {bool(_PARTED.search(line))} {end} {size}", f"L len {min(len(line) // 8, 6)} {number}",
    ]
    return f


def break_features(left: str, right: str, usual: dict[str, int], parted: bool, short: bool) -> list[str]:
    """What tells how a line goes on in the next."""
    mark = left[-1:] if left[-1:] in _MARKS else "none"
    stem = left[:-1] if mark != "none" else left
    if mark != "none" and stem[-1:].isspace():
        mark = "dash"
    a = (re.search(r"[^\W_]+$", stem) or [""])[0]
    b = (re.match(r"[^\W_]+", right) or [""])[0]
    kind = lambda c: "字" if c and (_CJK.match(c) or c in "，。；：、（）％“”《》") else "9" if c.isdigit() else "x" if c.islower() else "X" if c.isupper() else "_" if not c or c.isspace() else "p"
    whole, compound, apart = usual.get((a + b).lower(), 0), usual.get(f"{a}-{b}".lower(), 0), min(usual.get(a.lower(), 0), usual.get(b.lower(), 0))
    best = "whole" if whole and whole >= compound else "compound" if compound else "none"
    pair = f"{kind(stem[-1:])}{kind(right[:1])}"
    stop = left[-1:] in ".!?。！？:："
    wide = bool(_CJK.search(left[-24:])) + bool(_CJK.search(right[:24]))
    more = [f"B wide {wide} {pair} {mark}", f"B {pair} {parted}", f"B {pair} {mark} {short} {stop}", f"B next {right[:1] if not right[:1].isalnum() else ''} {pair} {wide}", f"B whole {whole > 0} {apart > 0} {pair} {wide}"]
    return [*more, f"B {mark}", f"B {pair}", f"B {mark} {pair}", f"B {mark} {best}", f"B {mark} {pair} {best}", f"B stop {stop} {pair}", f"B apart {apart > 0} {mark} {best}", f"B bullet {right[:1] in '•-*–'}", f"B furniture {parted} {stop}", f"B furniture {parted} {stop} {short}", f"B short {short} {stop} {pair}"]


def char_features(change: tuple[str, str], usual: dict[str, int], word: str, other: str, wrapped: bool, times: int) -> list[str]:
    """What tells a misread word: what was changed, and how much more usual the other word is."""
    now, then = usual.get(word.lower(), 0), usual.get(other.lower(), 0)
    ratio = min(12, int(math.log2((then + 1) / (now + 0.5)))) if then else -1
    digit = any(c.isdigit() for c in word)
    name = f"{change[0]}>{change[1]}"
    op = op_of(change)
    return ["C", f"C {op}", f"C {op} r {ratio}", f"C {name}", f"C r {ratio}", f"C wrapped {wrapped}", f"C {name} r {ratio // 3}", f"C wrapped {wrapped} r {ratio // 2}", f"C then {min(12, int(math.log2(then + 1)))}", f"C len {min(len(word), 6)} r {ratio // 3}", f"C now {now > 0} {digit}", f"C times {min(times, 4)}"]


def op_of(change: tuple[str, str]) -> str:
    return "insert" if not change[0] else "delete" if not change[1] else "replace"


def _garbled(around: str) -> bool:
    """Whether characters beside a word are the kind that wrong decoding leaves."""
    return any(ord(c) > 127 and c not in "“”‘’–—…«»，。；：、（）\u202f\xa0" and not c.isalpha() for c in around)


class Editor:
    def __init__(self, weights: dict, confusions: dict[str, dict[str, int]], usual: dict[str, int], tables: bool = False):
        self.tables = tables
        self.model = Perceptron()
        self.model.w = weights
        if weights:
            self.model.fix()
        self.confusions, self.usual = confusions, usual
        self.wide = {w for w in confusions if _CJK.match(w)}
        self.broken = [w for w in confusions if w and not w.isalnum()]
        # Whether proofs showed characters that got lost, or that are one too many.
        self.lost, self.doubled = bool(confusions.get("")), any("" in r for w, r in confusions.items() if w)
        self.longer: dict[str, tuple[int, tuple[str, str], str] | None] = {}
        self.index = self._index()

    # --- words -----------------------------------------------------------------------------------------------------------------------------

    def _index(self) -> dict[str, tuple[int, tuple[str, str], str]]:
        """For each form that one replacement, or two, or a lost character make of a usual word: how usual that is, the (first) change, and the word."""
        made: dict[str, list[str]] = defaultdict(list)
        for wrong, rights in self.confusions.items():
            for right in rights:
                if wrong and right and not _CJK.match(wrong):
                    made[right.lower()].append(wrong)
        pattern = re.compile("|".join(sorted(map(re.escape, made), key=lambda x: -len(x)))) if made else None
        index: dict[str, tuple[int, tuple[str, str], str]] = {}

        def forms(word: str):
            for right, wrongs in made.items():
                at = word.find(right)
                while at >= 0:
                    for wrong in wrongs:
                        yield (wrong, right), word[:at] + wrong.lower() + word[at + len(right) :]
                    at = word.find(right, at + 1)

        for word, n in self.usual.items():
            if len(word) < 2 or "-" in word or word.isdigit() or _CJK.search(word):
                continue
            if self.lost and len(word) > LEAST_WORD:
                for i, c in enumerate(word):
                    form = word[:i] + word[i + 1 :]
                    if n > index.get(form, (0,))[0]:
                        index[form] = (n, ("", c), word)
            if pattern is None:
                continue
            for change, form in forms(word):
                if n > index.get(form, (0,))[0]:
                    index[form] = (n, change, word)
                if len(word) > LEAST_WORD:
                    for _, more in forms(form):
                        if n > 3 * index.get(more, (0,))[0]:
                            index[more] = (n, change, word)
        return {f: v for f, v in index.items() if v[2] != f and v[0] > 4 * self.usual.get(f, 0)}

    def _doubled(self, low: str) -> tuple[int, tuple[str, str], str] | None:
        """The most usual word that a form is with one character too many."""
        if not self.doubled or len(low) <= LEAST_WORD or not low.isalpha():
            return None
        if low not in self.longer:
            if len(self.longer) > 300_000:
                self.longer.clear()
            best = max(((self.usual.get(low[:i] + low[i + 1 :], 0), i) for i in range(len(low))), default=(0, 0))
            n, i = best
            self.longer[low] = (n, (low[i], ""), low[:i] + low[i + 1 :]) if n > 4 * self.usual.get(low, 0) else None
        return self.longer[low]

    def others(self, word: str) -> list[tuple[tuple[str, str], str]]:
        """The most usual words that replacements or a lost character, and that a doubled one, may have made this one of."""
        low, out = word.lower(), []
        for found in (self.index.get(low), self._doubled(low)):
            if found is not None:
                change, w = found[1], found[2]
                # A first letter that was misread has the case of what it was misread for; else that of the word.
                first = change[1][:1].isupper() if change[1] and low[:1] != w[:1] else word[:1].isupper() and word[1:2] != word[1:2].upper()
                out.append((change, w.upper() if word.isupper() and len(word) > 1 else w[:1].upper() + w[1:] if first else w))
        return out

    def word_sites(self, text: str):
        """(start, end, [(change, other word)]) of the words of a text that may be misread."""
        usual, found = self.usual, []
        every = set(_WORD.findall(text.lower()))
        suspects = self.index.keys() & every
        if self.doubled:
            suspects = suspects | {w for w in every if usual.get(w, 0) == 0 and self._doubled(w) is not None}
        for m in _WORD.finditer(text) if suspects else ():
            w = m[0]
            if w.lower() in suspects and len(w) > 1 and not w.isdigit() and (o := self.others(w)) and not _garbled(text[m.start() - 1 : m.start()] + text[m.end() : m.end() + 1]):
                found.append((m.start(), m.end(), o))
        for wrong in self.broken:
            # Confusions with a mark in them part a word.
            at = text.find(wrong)
            while at >= 0:
                a, b = re.search(r"[^\W\d_]*$", text[max(0, at - 64) : at])[0], re.match(r"[^\W\d_]*", text[at + len(wrong) :])[0]
                w = a + wrong + b
                if b and (o := self.others(w)):
                    found.append((at - len(a), at + len(wrong) + len(b), o))
                at = text.find(wrong, at + 1)
        if self.wide and _CJK.search(text):
            for m in _CJK_RUN.finditer(text):
                run = m[0]
                for i, c in enumerate(run):
                    if c in self.wide:
                        a, b = run[i - 1 : i] if i else "", run[i + 1 : i + 2]
                        now = usual.get(a + c, 0) * bool(a) + usual.get(c + b, 0) * bool(b)
                        right, k = max(((r, usual.get(a + r, 0) * bool(a) + usual.get(r + b, 0) * bool(b)) for r in self.confusions[c] if r), key=lambda x: x[1], default=("", 0))
                        if k > 4 * now:
                            found.append((m.start() + i, m.start() + i + 1, [((c, right), right)]))
        found.sort()
        end = -1
        for x in found:
            if x[0] >= end:
                yield x
                end = x[1]

    def decide(self, text: str, site, wrapped: bool) -> str | None:
        """The word that the best operation at a site makes; None where that is keeping it."""
        best, other = 0.0, None
        for change, word in site[2]:
            op = op_of(change)
            keep, edit = self.model.scores(self.site_features(text, site, change, word, wrapped), ("keep", op))
            if edit - keep > best:
                best, other = edit - keep, word
        return other

    def site_features(self, text: str, site, change: tuple[str, str], other: str, wrapped: bool) -> list[str]:
        return char_features(change, self.usual, text[site[0] : site[1]], other, wrapped, self.confusions.get(change[0], {}).get(change[1], 0))

    # --- whole texts -----------------------------------------------------------------------------------------------------------------------

    def edit(self, text: str | None) -> tuple[str | None, int, int, int]:
        """(text, lines deleted, hyphens deleted, words changed). Without any of these the text is as it was."""
        if not text:
            return text, 0, 0, 0
        own, mark, rows = text.partition(TABLE)
        if mark and not self.tables:
            return text, 0, 0, 0
        lines = own.split("\n")
        wrapped = any(a.strip() and b.strip() for a, b in zip(lines, lines[1:]))
        deleted = hyphens = 0
        out = own
        if len(lines) > 1:
            keep, deleted = self._lines(lines)
            # The lines of a table's heading stay apart.
            out, hyphens = ("\n".join(x for x, _ in keep), 0) if mark else self._joined(keep)
        sites = [(s[0], s[1], w) for s in self.word_sites(out) if (w := self.decide(out, s, wrapped)) is not None]
        for a, b, other in reversed(sites):
            out = out[:a] + other + out[b:]
        return (out + mark + rows, deleted, hyphens, len(sites)) if deleted or hyphens or sites else (text, 0, 0, 0)

    def _lines(self, lines: list[str]) -> tuple[list[str], int]:
        seen = page(lines)
        keep, n, parted = [], 0, False
        for i, x in enumerate(lines):
            if x.strip() and self.model.predict(line_features(lines, i, seen), LINE_OPS) == "delete":
                n, parted = n + 1, True
            else:
                keep.append((x, parted))
                parted = False
        return keep, n

    def _joined(self, lines: list[tuple[str, bool]]) -> tuple[str, int]:
        out, before, hyphens, gap = "", "", 0, False
        width = max((len(x) for x, _ in lines), default=1)
        for x, parted in lines:
            if not x.strip():
                gap = bool(out)
                continue
            if not out:
                out = x
            elif gap:
                out += "\n\n" + x
            else:
                last = out[out.rfind("\n") + 1 :]
                op = self.model.predict(break_features(last.rstrip(" "), x.lstrip(), self.usual, parted, len(before) < 0.7 * width), BREAK_OPS)
                if op == "dehyphen" and last.rstrip(" ")[-1:] not in _MARKS:
                    op = "join"
                elif op == "dehyphen" and last.rstrip(" ")[-2:-1].isspace():
                    op = "blank"
                if op == "dehyphen":
                    out, hyphens = out.rstrip(" ")[:-1] + x.lstrip(), hyphens + 1
                else:
                    out = out + "\n" + x if op == "break" else out + "\n\n" + x if op == "paragraph" else out.rstrip(" ") + ("" if op == "join" else " ") + x.lstrip()
            gap, before = False, x
        return out, hyphens


# --- training ----------------------------------------------------------------------------------------------------------------------------------


def _gold_break(left: str, right: str, clean: str) -> str | None:
    """The operation that the proof shows at a break, by what surrounds it."""
    for k in (14, 8, 5):
        a, b = left[-k:], right[:k]
        found = [op for op, s in (("break", a + "\n" + b), ("paragraph", a + "\n\n" + b), ("blank", a + " " + b), ("join", a + b), ("dehyphen", a[:-1] + b if a[-1:] in _MARKS else "\0")) if s in clean]
        if found:
            return found[0]
    return None


def _gold_lines(lines: list[str], clean: str) -> list[bool]:
    """Which lines the proof has left out: those of whose short stretches hardly any is in it, or whose neighbours meet there."""
    flat = re.sub(r"\s+", "", clean)
    out = []
    for i, x in enumerate(lines):
        s = re.sub(r"\s+", "", x)
        if not s:
            out.append(False)
            continue
        parts = [s[j : j + 7] for j in range(0, max(1, len(s) - 6), 3)]
        share = sum(p in flat for p in parts) / len(parts)
        if len(s) >= 10:
            out.append(share < 0.3)
        else:
            tail = re.sub(r"\s+", "", next((y for y in reversed(lines[:i]) if y.strip()), ""))[-8:].rstrip(_MARKS)
            head = re.sub(r"\s+", "", next((y for y in lines[i + 1 :] if y.strip()), ""))[:8]
            kept = (tail and tail + s in flat) or (head and s + head in flat)
            out.append(not kept)
    return out


def _fixes(raw: str, clean: str) -> list[tuple[str, str]]:
    """Words of raw that the proof has otherwise, side by side."""
    a, b = _TOKEN.findall(raw), _TOKEN.findall(clean)
    out = []
    for op, i, j, k, m in SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "replace" and j - i <= 5 and m - k <= 5:
            out.append(("".join(a[i:j]), "".join(b[k:m])))
    return out


def _core(wrong: str, right: str) -> tuple[str, str] | None:
    """The characters in which two words differ: what is replaced by what; nothing on one side where characters got lost or are one too many."""
    p = 0
    while p < min(len(wrong), len(right)) and wrong[p] == right[p]:
        p += 1
    q = 0
    while q < min(len(wrong), len(right)) - p and wrong[-1 - q] == right[-1 - q]:
        q += 1
    a, b = wrong[p : len(wrong) - q], right[p : len(right) - q]
    # One character is lost or doubled at a time; words that share nothing are no misreading of each other.
    fine = len(a) + len(b) == 1 if not a or not b else p + q > 0 or max(len(wrong), len(right)) <= 2
    return (a, b) if fine and not re.search(r"\s", a + b) else None


def train(proofs: list[tuple[str, str]], usual: dict[str, int]) -> Editor:
    """An editor from (text, corrected text) pairs."""
    model, confusions = Perceptron(), defaultdict(Counter)
    line_cases, break_cases, joined = [], [], []
    for raw, clean in proofs:
        if not raw or not clean:
            continue
        table = TABLE in raw
        raw, clean = raw.partition(TABLE)[0], clean.partition(TABLE)[0]
        lines = raw.split("\n")
        gone = _gold_lines(lines, clean) if raw != clean else [False] * len(lines)
        seen = page(lines)
        if len(lines) > 1:
            line_cases += [(line_features(lines, i, seen), LINE_OPS, "delete" if g else "keep") for i, (x, g) in enumerate(zip(lines, gone)) if x.strip()]
        if table:
            continue
        wrapped = any(a.strip() and b.strip() for a, b in zip(lines, lines[1:]))
        out, before, gap, parted = "", "", False, False
        width = max((len(x) for x, g in zip(lines, gone) if not g), default=1)
        for x, g in zip(lines, gone):
            if g:
                parted = True
                continue
            if not x.strip():
                gap = bool(out)
                continue
            if not out:
                out = x
            elif gap:
                out += "\n\n" + x
            else:
                last = out[out.rfind("\n") + 1 :]
                op = _gold_break(last, x, clean)
                if op and raw != clean:
                    break_cases.append((break_features(last.rstrip(" "), x.lstrip(), usual, parted, len(before) < 0.7 * width), BREAK_OPS, op))
                op = op or ("dehyphen" if last[-1:] in _MARKS else "blank")
                out = out + "\n" + x if op == "break" else out + "\n\n" + x if op == "paragraph" else out[:-1] + x if op == "dehyphen" else out + ("" if op == "join" else " ") + x
            gap, before, parted = False, x, False
        joined.append((out, clean, wrapped))
        if raw != clean:
            for wrong, right in _fixes(out, clean):
                if (c := _core(wrong, right)) is not None:
                    confusions[c[0]][c[1]] += 1
    # A change seen once counts while there are few proofs.
    least = 2 if sum(a != b for a, b in proofs) > 40 else 1
    table = {w: {r: k for r, k in c.items() if k >= least and not (w.isdigit() and r.isdigit())} for w, c in confusions.items()}
    editor = Editor({}, {w: c for w, c in table.items() if c}, usual, any(TABLE in (raw or "") for raw, _ in proofs))
    char_cases = []
    for out, clean, wrapped in joined:
        fixed = _fixes(out, clean) if out != clean else []
        wrong_words = {w for a, _ in fixed for w in _WORD.findall(a)} | {c for a, _ in fixed for c in a if _CJK.match(c)}
        right_words = {w for _, b in fixed for w in _WORD.findall(b)}
        for s in editor.word_sites(out):
            w = out[s[0] : s[1]]
            bad = w in wrong_words or any(p in wrong_words for p in re.split("[’']", w))
            for change, other in s[2]:
                op = op_of(change)
                gold = op if bad and (op == "replace" or other in right_words) else "keep"
                char_cases.append((editor.site_features(out, s, change, other, wrapped), ("keep", op), gold))
    cases = line_cases + break_cases + char_cases
    step = 7_919
    for epoch in range(EPOCHS):
        for k in range(len(cases)):
            # A fixed order that mixes the three kinds; the number of cases may share no factor with the step.
            model.learn(*cases[(k * step + epoch) % len(cases)] if len(cases) % step else cases[k])
    editor.model.w = model.average()
    editor.model.fix()
    return editor


def usual_words(chunks: DataFrame) -> dict[str, int]:
    """Words, compounds and pairs of Chinese characters with their numbers over all chunks. Those taken to the driver have at least USUAL_SHARE of all."""

    def count(batches):
        for pdf in batches:
            parts, own = Counter(), Counter()
            for text in pdf.text:
                if not text:
                    continue
                low = text.lower()
                if not low.isascii() and _CJK.search(low):
                    for run in _CJK_RUN.findall(low):
                        own.update(map(str.__add__, run, run[1:]))
                    parts.update(_CJK_RUN.sub(" ", low).split())
                else:
                    parts.update(low.split())
            for part, n in parts.items():
                if part.isalpha():
                    own[part] += n
                else:
                    for w in _WORD.findall(part):
                        own[w] += n
                    for w in _COMPOUND.findall(part):
                        own[w] += n
            yield pd.DataFrame([(w, n) for w, n in own.items() if not w.isdigit()], columns=["word", "n"])

    counted = chunks.select("text").mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stage(counted, "words")
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(USUAL_LEAST, math.ceil(USUAL_SHARE * total))
    return {r.word: r.n for r in counted.where(F.col("n") >= least).toLocalIterator()}


def repair(chunks: DataFrame, proofs: DataFrame, most_proofs: int = MOST_PROOFS) -> DataFrame:
    """(chunk_id, text, lines_deleted, hyphens_deleted, words_changed) of every chunk; the three numbers are 0 where it has no residue."""
    kind = F.regexp_extract(F.lower("locator"), r"^[\p{L} ]+", 0)
    rows = chunks.where("id is not null").select(F.col("id").alias("chunk_id"), "text", kind.alias("kind"))
    usual = usual_words(chunks)
    # A bounded sample of the proofs, the same at any partitioning: their ids are drawn before any text moves.
    drawn = proofs.where("chunk_id is not null and clean_text is not null").select("chunk_id").distinct().orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(most_proofs)
    chosen = proofs.where("clean_text is not null").join(F.broadcast(drawn), "chunk_id").dropDuplicates(["chunk_id"])
    pairs = rows.join(F.broadcast(chosen), "chunk_id").select("chunk_id", "text", "clean_text", "kind").dropDuplicates(["chunk_id"]).orderBy("chunk_id").collect()
    own: dict[str, list[bool]] = {}
    for r in pairs:
        own.setdefault(r.kind, []).append(r.text == r.clean_text)
    never = [k for k, same in own.items() if k and all(same) and len(same) >= LEAST_AGREEING]
    more = []
    if never:
        kept = chunks.where(r"text like '%\n%' and text not like '%\n[Rows]\n%'").where(kind.isin(never))
        ids = kept.select("id").distinct().orderBy(F.xxhash64("id"), "id").limit(MOST_UNSCANNED)
        more = kept.select("id", "text").join(F.broadcast(ids), "id").dropDuplicates(["id"]).orderBy("id").collect()
    editor = train([(r.text, r.clean_text) for r in pairs] + [(r.text, r.text) for r in more], usual)
    shared = chunks.sparkSession.sparkContext.broadcast((editor.model.w, editor.confusions, usual, editor.tables))

    def run(batches):
        own = Editor(*shared.value)
        for pdf in batches:
            done = [own.edit(t) for t in pdf.text]
            yield pd.DataFrame({"chunk_id": pdf.chunk_id, "text": [d[0] for d in done], "lines_deleted": [d[1] for d in done], "hyphens_deleted": [d[2] for d in done], "words_changed": [d[3] for d in done]})

    edited = rows.select("chunk_id", "text").mapInPandas(run, "chunk_id bigint, text string, lines_deleted int, hyphens_deleted int, words_changed int")
    return edited
