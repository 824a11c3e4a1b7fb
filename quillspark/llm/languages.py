"""Languages of documents and of passages (problem 6): a bidirectional gated recurrent network over bytes, in numpy.

The network reads STRIDE bytes a step, both ways, and gives every position a distribution over the languages. It is trained by backpropagation
through time on a bounded sample of labelled rows (at most MOST_CHECKED checked chunks and MOST_LABELLED labelled documents), spliced into
mixed sequences and partly misread in wrong encodings; documents whose label the half-trained network contradicts are left out of the second
half. Position probabilities are pooled over sentences, neighbouring sentences of one language make a passage, and a document's are pooled over
its whole text.

Defined results: null, empty and blank texts, and texts without letters, have no passage and a null language with confidence 0; rows of tables are no
passages; repeated chunks count once; of several deliveries of a document, any label names its languages; a chunk without a document has no label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LANGUAGES = ("en", "zh", "de", "fr", "es", "pt", "it")
STRIDE, HIDDEN, WINDOW, CONTEXT = 3, 32, 128, 16
MOST_CHECKED, MOST_LABELLED = 1_500, 1_500
STEPS, BATCH, LENGTH = 480, 64, 72
#: Characters a labelled document has at least for the sample, and bytes whose probabilities are in memory at once.
LEAST_LABELLED, AT_ONCE = 300, 1 << 20
LEAST_WORDS, LEAST_CHARS = 12, 20
#: Neighbouring positions say much the same: the share of a position's log probability that counts, and the price of a change of language.
EVIDENCE, SWITCH = 0.3, 6.0

# Usual names and codes of the languages.
NAMES = {
    "en": "en eng english englisch anglais ingles inglés inglese inglês 英文 英语 英語",
    "zh": "zh zho chi cn cmn chinese mandarin chinesisch chinois chino cinese chinês chines 中文 汉语 漢語 华语 普通话 简体中文 繁體中文",
    "de": "de deu ger german deutsch allemand aleman alemán tedesco alemão 德文 德语",
    "fr": "fr fra fre french français francais französisch franzoesisch frances francés francese francês 法文 法语",
    "es": "es spa spanish español espanol castellano castilian spanisch espagnol spagnolo espanhol 西班牙文 西班牙语",
    "pt": "pt por portuguese português portugues portugiesisch portugais portugués portoghese brazilian 葡萄牙文 葡萄牙语",
    "it": "it ita italian italiano italienisch italien italiana 意大利文 意大利语",
}
_NAMED = {w: code for code, all_of in NAMES.items() for w in all_of.split()}


def named(label: str | None) -> list[str]:
    """The languages a label names: codes with or without a region, or names, one or several; a name may have other words before it."""
    found = []
    for part in re.split(r"[,;/+&|]|\band\b", (label or "").casefold()):
        own = re.findall(r"[^\W\d_]+", part)
        # After the first word only whole names count: codes are words of other languages too.
        codes = [c for k, w in enumerate(own) if (c := _NAMED.get(w)) and (k == 0 or len(w) > 3 or not w.isascii())]
        if codes and codes[0] not in found:
            found.append(codes[0])
    return found


# --- the network -------------------------------------------------------------------------------------------------------------------------------


def fresh(seed: int = 3) -> dict[str, np.ndarray]:
    own = np.random.default_rng(seed)
    h, k = HIDDEN, len(LANGUAGES)
    return {
        "x": own.normal(0, 0.15, (2, STRIDE, 256, 3 * h)).astype(np.float32), "b": np.zeros((2, 1, 3 * h), np.float32),
        "u": (own.normal(0, 1, (2, h, 3 * h)) / np.sqrt(h)).astype(np.float32), "o": own.normal(0, 0.2, (2 * h, k)).astype(np.float32), "c": np.zeros(k, np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def forward(p: dict[str, np.ndarray], data: np.ndarray, keep: bool = False):
    """Probabilities (n, steps, languages) of byte windows (n, steps, STRIDE); with keep, also what backpropagation needs."""
    n, steps, _ = data.shape
    h = HIDDEN
    both = np.stack([data, data[:, ::-1]])
    x = np.broadcast_to(p["b"][:, :, None], (2, n, steps, 3 * h)).copy()
    for d in range(2):
        for k in range(STRIDE):
            x[d] += p["x"][d, k][both[d, :, :, k]]
    state = np.zeros((2, n, h), np.float32)
    out = np.empty((2, steps, n, h), np.float32)
    kept = []
    for t in range(steps):
        hu = state @ p["u"]
        zr = _sigmoid(x[:, :, t, : 2 * h] + hu[:, :, : 2 * h])
        z, r = zr[:, :, :h], zr[:, :, h:]
        new = np.tanh(x[:, :, t, 2 * h :] + r * hu[:, :, 2 * h :])
        if keep:
            kept.append((state, z, r, new, hu[:, :, 2 * h :]))
        state = new + z * (state - new)
        out[:, t] = state
    joint = np.concatenate([out[0], out[1, ::-1]], axis=2).transpose(1, 0, 2)
    logits = joint @ p["o"] + p["c"]
    logits -= logits.max(axis=2, keepdims=True)
    prob = np.exp(logits)
    prob /= prob.sum(axis=2, keepdims=True)
    return (prob, joint, kept, both) if keep else prob


def backward(p: dict[str, np.ndarray], kept_all, gold: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy over masked positions."""
    prob, joint, kept, both = kept_all
    n, steps, _ = prob.shape
    h = HIDDEN
    d_logits = prob.copy()
    d_logits[np.arange(n)[:, None], np.arange(steps)[None], gold] -= 1
    d_logits *= (mask / max(1.0, mask.sum()))[:, :, None]
    g = {k: np.zeros_like(v) for k, v in p.items()}
    g["o"] = np.einsum("nth,ntk->hk", joint, d_logits)
    g["c"] = d_logits.sum(axis=(0, 1))
    d_joint = d_logits @ p["o"].T
    d_out = np.stack([d_joint[:, :, :h], d_joint[:, ::-1, h:]])
    d_state = np.zeros((2, n, h), np.float32)
    d_x = np.empty((2, n, steps, 3 * h), np.float32)
    ut = p["u"].transpose(0, 2, 1)
    for t in range(steps - 1, -1, -1):
        state, z, r, new, hn = kept[t]
        d = d_state + d_out[:, :, t]
        dz = d * (state - new) * z * (1 - z)
        dn = d * (1 - z) * (1 - new * new)
        dr = dn * hn * r * (1 - r)
        d_x[:, :, t, :h], d_x[:, :, t, h : 2 * h], d_x[:, :, t, 2 * h :] = dz, dr, dn
        d_hu = np.concatenate([dz, dr, dn * r], axis=2)
        g["u"] += state.transpose(0, 2, 1) @ d_hu
        d_state = d * z + d_hu @ ut
    g["b"] = d_x.sum(axis=(1, 2))[:, None]
    flat = d_x.reshape(2, -1, 3 * h)
    for d in range(2):
        for k in range(STRIDE):
            at = both[d, :, :, k].ravel()
            order = np.argsort(at, kind="stable")
            values, starts = np.unique(at[order], return_index=True)
            g["x"][d, k, values] = np.add.reduceat(flat[d][order], starts, axis=0)
    return g


def train_network(texts: list[tuple[str, int, bool]], steps: int = STEPS, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights learned from (text, language index, whether it was checked) rows. Without rows, the fresh weights."""
    p = fresh()
    own = np.random.default_rng(seed)
    by = [[t.encode() for t, k, _ in texts if k == i] for i in range(len(LANGUAGES))]
    have = [i for i, x in enumerate(by) if x]
    if not have:
        return p
    first, second = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
    for step in range(1, steps + 1):
        if step == steps // 2:
            kept = _agreeing(p, texts)
            again = [[t.encode() for t, k, _ in kept if k == i] for i in range(len(LANGUAGES))]
            by = [b if b else a for a, b in zip(by, again)]
        data, gold, mask = _sequences(by, have, own)
        kept_all = forward(p, data, True)
        g = backward(p, kept_all, gold, mask)
        norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
        rate = 0.012 * min(1, step / 20) * (1 if step < steps * 0.6 else 0.35 if step < steps * 0.85 else 0.12)
        for k in p:
            v = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            first[k] = 0.9 * first[k] + 0.1 * v
            second[k] = 0.99 * second[k] + 0.01 * v * v
            p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return p


def _sequences(by: list[list[bytes]], have: list[int], own: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences spliced of stretches of one to three texts, now and then read in a wrong encoding."""
    size = LENGTH * STRIDE
    data, gold = np.zeros((BATCH, size), np.uint8), np.zeros((BATCH, size), np.int64)
    for i in range(BATCH):
        at = 0
        pieces = int(own.choice([1, 2, 3], p=[0.4, 0.4, 0.2]))
        for k in range(pieces):
            lang = have[int(own.integers(len(have)))]
            text = by[lang][int(own.integers(len(by[lang])))]
            want = size - at if k == pieces - 1 else int(own.integers(size // 5, size // 2))
            s = int(own.integers(0, max(1, len(text) - want)))
            piece = text[s : s + want]
            if own.random() < 0.12:
                piece = _misread(piece, own)[:want]
            elif own.random() < 0.1:
                piece = piece.upper()
            piece = piece[: size - at]
            data[i, at : at + len(piece)] = np.frombuffer(piece, np.uint8)
            gold[i, at : at + len(piece)] = lang
            at += len(piece)
            if k < pieces - 1 and at + 3 < size:
                sep = (b" / ", b"\n\n", b" ", b"\n")[int(own.integers(4))]
                data[i, at : at + len(sep)] = np.frombuffer(sep, np.uint8)
                at += len(sep)
    data, gold = data.reshape(BATCH, LENGTH, STRIDE), gold.reshape(BATCH, LENGTH, STRIDE)[:, :, 1]
    return data, gold, (data.any(axis=2)).astype(np.float32)


def _misread(piece: bytes, own: np.random.Generator) -> bytes:
    page = ("cp1252", "latin-1", "mac_roman", "cp1251", "cp437", "gb18030", "gbk>latin-1")[int(own.integers(7))]
    try:
        if page == "gbk>latin-1":
            return piece.decode("utf-8", "ignore").encode("gb18030").decode("latin-1").encode()
        return piece.decode(page, "replace").encode("utf-8", "ignore")
    except UnicodeError:
        return piece


def _agreeing(p: dict[str, np.ndarray], texts: list[tuple[str, int, bool]]) -> list[tuple[str, int, bool]]:
    """The checked rows, and those others whose label the network finds likely enough."""
    probs = list(pooled(p, [t for t, _, _ in texts]))
    return [row for row, q in zip(texts, probs) if row[2] or q is None or q[row[1]] > 0.4]


# --- applying it -------------------------------------------------------------------------------------------------------------------------------


def positions(p: dict[str, np.ndarray], texts: list[str]) -> Iterator[np.ndarray]:
    """Log probabilities (steps, languages) of whole texts, of as many at a time as have AT_ONCE bytes."""
    some, size = [], 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= AT_ONCE:
            yield from _positions(p, some)
            some, size = [], 0
    yield from _positions(p, some)


def _positions(p: dict[str, np.ndarray], texts: list[str]) -> Iterator[np.ndarray]:
    """Log probabilities of whole texts, computed in windows that see CONTEXT steps on either side."""
    windows, owner = [], []
    for i, t in enumerate(texts):
        raw = t.encode()
        n = -(-len(raw) // STRIDE)
        a = np.zeros((n + 2 * CONTEXT, STRIDE), np.uint8)
        a[CONTEXT : CONTEXT + n].ravel()[: len(raw)] = np.frombuffer(raw, np.uint8)
        for s in range(0, n, WINDOW):
            own = a[s : s + WINDOW + 2 * CONTEXT]
            windows.append(own)
            owner.append((i, min(WINDOW, n - s)))
    order = sorted(range(len(windows)), key=lambda k: len(windows[k]))
    done: list[np.ndarray | None] = [None] * len(windows)
    for at in range(0, len(order), 192):
        some = order[at : at + 192]
        size = len(windows[some[-1]])
        data = np.zeros((len(some), size, STRIDE), np.uint8)
        for j, k in enumerate(some):
            data[j, : len(windows[k])] = windows[k]
        prob = forward(p, data)
        for j, k in enumerate(some):
            done[k] = np.log(prob[j, CONTEXT : CONTEXT + owner[k][1]] + 1e-6)
    parts: list[list[np.ndarray]] = [[] for _ in texts]
    for k, (i, _) in enumerate(owner):
        parts[i].append(done[k])
    for x in parts:
        yield np.concatenate(x) if x else np.zeros((0, len(LANGUAGES)), np.float32)


def pooled(p: dict[str, np.ndarray], texts: list[str]) -> Iterator[np.ndarray | None]:
    """A distribution for each text: the mean probability of its positions."""
    for logs in positions(p, texts):
        yield np.exp(logs).mean(axis=0) if len(logs) else None


_RUNNING = re.compile(r"(?<![^\W_])[^\W\d_]+(?![^\W_])")
_CHINESE = re.compile(r"[㐀-䶿一-鿿]")


def _units(text: str) -> list[tuple[int, int]]:
    """Sentences and lines of a text; numbers such as 1.5 don't part them."""
    cuts = [0, *(m.end() for m in re.finditer(r"\n+|[.!?;:](?:[”\"»’)]*)\s+|[。！？；]|\s/\s", text)), len(text)]
    return [(a, b) for a, b in zip(cuts, cuts[1:]) if b > a]


def _path(scores: np.ndarray) -> list[int]:
    """The best sequence of languages for sentences, changes costing SWITCH."""
    back, total = [], scores[0].copy()
    for s in scores[1:]:
        top = int(total.argmax())
        stay = total >= total[top] - SWITCH
        back.append(np.where(stay, np.arange(len(total)), top))
        total = np.where(stay, total, total[top] - SWITCH) + s
    out = [int(total.argmax())]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def passages(text: str, logs: np.ndarray) -> list[tuple[int, int, int, float]]:
    """(start, end, language index, confidence) of the passages of a text, by the log probabilities of its positions."""
    table = text.find("\n[Rows]\n")
    sizes = np.cumsum([0, *(len(c.encode()) for c in text)]) if not text.isascii() else np.arange(len(text) + 1)
    total = np.concatenate([np.zeros((1, logs.shape[1])), np.cumsum(logs, axis=0)])
    units = []
    for a, b in _units(text):
        piece = text[a:b]
        if (table >= 0 and b > table) or " | " in piece:
            units.append(None)
            continue
        wide = len(_CHINESE.findall(piece))
        words = len(_RUNNING.findall(_CHINESE.sub(" ", piece).replace("’", " "))) if wide < len(piece) else 0
        if wide + words == 0:
            continue
        s, e = int(sizes[a]) // STRIDE, min(len(logs), -(-int(sizes[b]) // STRIDE))
        units.append([a, b, total[e] - total[s], e - s, words, wide])
    # Sentences of one run are judged together: a change of language has to be worth its price.
    best: list[tuple[int, int, int, float]] = []
    run: list[list] = []

    def close():
        if not run:
            return
        kinds = _path(np.stack([u[2] for u in run]) * EVIDENCE)
        i = 0
        while i < len(run):
            j = i
            while j + 1 < len(run) and kinds[j + 1] == kinds[i]:
                j += 1
            own, k = run[i : j + 1], kinds[i]
            words, wide = sum(u[4] for u in own), sum(u[5] for u in own)
            mass, steps = sum(u[2] for u in own), sum(u[3] for u in own)
            if (wide >= LEAST_CHARS) if LANGUAGES[k] == "zh" and wide else words >= LEAST_WORDS:
                mean = np.exp((mass - mass.max()) / max(1, steps))
                best.append((own[0][0], own[-1][1], k, float(mean[k] / mean.sum())))
            i = j + 1
        run.clear()

    for u in units:
        if u is None:
            close()
        else:
            run.append(u)
    close()
    return best


def codes_of(documents: DataFrame) -> DataFrame:
    """(label, codes) of the distinct labels of documents."""

    def read(batches):
        for pdf in batches:
            yield pd.DataFrame({"label": pdf.label, "codes": [named(x) for x in pdf.label]})

    return documents.select(F.col("lang").alias("label")).where("lang is not null").distinct().mapInPandas(read, "label string, codes array<string>")


def fit(documents: DataFrame, chunks: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    """A network trained on a bounded sample of labelled rows, the same at any partitioning."""
    one = labels.where("chunk_id is not null and lang is not null").groupBy("chunk_id").agg(F.collect_set("lang").alias("all")).where(F.size("all") == 1).select(F.col("chunk_id").alias("id"), F.element_at("all", 1).alias("lang"))
    # The ids of a sample are drawn first; only their texts move.
    one = one.orderBy(F.xxhash64("id"), "id").limit(MOST_CHECKED)
    checked = chunks.where("text is not null and text not like '%[Rows]%'").join(F.broadcast(one), "id").select("id", "text", "lang").dropDuplicates(["id"]).orderBy("id").collect()
    known = codes_of(documents).where("size(codes) = 1").select("label", F.element_at("codes", 1).alias("code"))
    drawn = documents.where(f"length(text) >= {LEAST_LABELLED}").select("doc_id", F.col("lang").alias("label")).join(known, "label").select("doc_id", "code").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    sample = documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    rows = [(r.text, LANGUAGES.index(r.lang), True) for r in checked if r.lang in LANGUAGES]
    for r in sample:
        prose = "\n".join(x for x in r.text.split("\n") if " | " not in x and x != "[Rows]")
        if len(prose) > 200:
            rows.append((prose, LANGUAGES.index(r.code), False))
    return train_network(rows)


def label_passages(documents: DataFrame, chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """(chunk_id, document_id, start, end, lang, confidence) of every passage of every chunk."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, chunks, labels))

    def run(batches):
        p, cache = shared.value, {}
        for pdf in batches:
            names, texts = pdf.text_hash.to_list(), pdf.text.to_list()
            new = {}
            for name, t in zip(names, texts):
                if t and (key := name or t) not in cache and key not in new:
                    new[key] = t
            if len(cache) > 100_000:
                cache = {}
                new = {name or t: t for name, t in zip(names, texts) if t}
            keys = list(new)
            for key, logs in zip(keys, positions(p, [new[k] for k in keys])):
                cache[key] = passages(new[key], logs)
            rows = [(i, d, a, b, LANGUAGES[k], c) for i, d, name, t in zip(pdf.id, pdf.document_id, names, texts) if t for a, b, k, c in cache[name or t]]
            yield pd.DataFrame(rows, columns=["chunk_id", "document_id", "start", "end", "lang", "confidence"])

    own = chunks.where("id is not null").select("id", "document_id", "text_hash", "text")
    return own.mapInPandas(run, "chunk_id bigint, document_id string, start int, end int, lang string, confidence double")


def unnamed(documents: DataFrame, chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """(chunk_id, lang): languages of a chunk's passages that no label of its document names."""
    found = label_passages(documents, chunks, labels).select("chunk_id", "document_id", "lang").distinct()
    of = documents.where("id is not null").select(F.col("id").alias("document_id"), F.col("lang").alias("label")).distinct().join(codes_of(documents), "label").select("document_id", F.explode("codes").alias("lang")).distinct()
    return found.join(of, ["document_id", "lang"], "left_anti").select("chunk_id", "lang").distinct()


def label_documents(documents: DataFrame, chunks: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, confidence) of every document: the pooled probabilities of its running text, or of all its text where there is none."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, chunks, labels))

    def run(batches):
        p = shared.value
        for pdf in batches:
            texts = ["\n".join(x for x in (t or "").split("\n") if " | " not in x) for t in pdf.text]
            texts = [x if x.strip() else (t or "") for x, t in zip(texts, pdf.text)]
            texts = [x if _RUNNING.search(x) else "" for x in texts]
            rows = [(d, None, 0.0) if q is None else (d, LANGUAGES[int(q.argmax())], float(q.max())) for d, q in zip(pdf.doc_id, pooled(p, texts))]
            yield pd.DataFrame(rows, columns=["doc_id", "lang", "confidence"])

    return documents.select("doc_id", "text").mapInPandas(run, "doc_id bigint, lang string, confidence double")
