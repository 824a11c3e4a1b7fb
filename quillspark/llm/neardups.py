"""Groups of texts that are near copies (problem 2): pigeonring filtering, then exact triples.

Word triples fall into SEGMENTS segments by their hashes. Two texts of the similarity s or above differ in at most (1 - s) / (1 + s) of their triples, counted
on both sides; so, going round the ring of segments, there is one from which every run of consecutive segments stays within its share of that budget,
shares being proportional to the triples that the two texts have in a segment (were every start overdrawn somewhere, the whole ring would be). In the
segment a chain starts at, the two texts have the similarity s themselves, so they share a triple among the first of both there, rarest first, and early
enough for what follows to hold the others. The index therefore lists each text under the rare triples of each segment; texts that meet in a segment are
a possible start, no other pair is ever looked at, and no pair at the similarity is lost. Triples are ordered by how often they occur in all texts,
counted by cells of their hashes, of which there are the more the more texts there are; what is alone in its cell can't be shared and isn't listed.

From the segment where two texts met, the chain grows by one segment at a time, and stops where its cumulative differences leave its budget. A sketch
gives the differences: the parity of a text's triples in each of 64 cells a segment (twice as many for each doubling of a text beyond 192 triples), which
differ in no more cells than the triples do. Only for pairs whose chain reaches CHAIN segments are the other segments read and the whole Hamming
distance held against the whole budget. What is left is compared exactly, triple by triple.

Triples that many texts have in their prefixes are spread over pairs of blocks of texts, so that none is one task.

Defined results: null texts and texts of fewer than ``least_words`` words have no partner; equal texts (one text_hash) are one; a null text_hash
takes no part; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.staging import stage

#: Segments of the ring (words of 64 cells in the least sketch), the triples up to which a text has that sketch, and segments of a chain.
SEGMENTS, NARROW, CHAIN = 8, 192, 4
#: Texts listed under one triple that one task is to hold against each other.
HOT = 100_000
#: Cells in which triples are counted to order them: at least, at most, a text, and in a block. More triples than cells make the order coarser, no pair is lost.
CELLS, MOST_CELLS, CELLS_A_TEXT, BLOCK = 1 << 20, 1 << 26, 64, 1 << 16
#: The count, as it is kept, of a triple that is alone.
ALONE = 8
#: Places of triples are told apart up to this one, which only makes later ones pass.
FAR_PLACE = 32_767
#: Triples of the texts that are listed and packed together.
TOGETHER = 1 << 18
#: Pairs looked at in one go.
PAIRS = 200_000
#: Texts of one triple that are held against all others of it in one tile, where there are so many others, and the others in a tile.
TILE, MANY, WIDE = 64, 12, 4_096

_WORD = re.compile(r"[㐀-䶿一-鿿豈-﫿]|[^\W_㐀-䶿一-鿿豈-﫿]+")


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case; a Chinese character is a word of its own."""
    return _WORD.findall(text.lower())


class Triples:
    """64-bit hashes of the distinct word triples of texts. Words are hashed once a process, while they fit."""

    def __init__(self):
        self.known: dict[str, bytes] = {}

    def of(self, text: str | None, least: int) -> np.ndarray | None:
        import xxhash

        if text is None:
            return None
        own = words(text)
        if len(own) < max(3, least):
            return None
        known = self.known
        if len(known) > 500_000:
            known.clear()
        try:
            h = np.frombuffer(b"".join([known[w] for w in own]), "<u8")
        except KeyError:
            for w in own:
                if w not in known:
                    known[w] = xxhash.xxh64_intdigest(w).to_bytes(8, "little")
            h = np.frombuffer(b"".join([known[w] for w in own]), "<u8")
        t = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + (h[1:-1] ^ (h[1:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[2:] * np.uint64(0x94D049BB133111EB)
        t ^= t >> np.uint64(31)
        t *= np.uint64(0xD6E8FEB86659FD93)
        t.sort()
        return t[np.concatenate([[True], t[1:] != t[:-1]])]


def rarity(texts: DataFrame, least_words: int, cells: int = CELLS) -> np.ndarray:
    """How often triples occur in the texts, by the upper bits of their hashes, as a logarithm in a byte: ALONE is one, less is none."""

    def rows(total):
        at = np.flatnonzero(total)
        cuts = np.searchsorted(at, np.arange(0, cells + 1, BLOCK))
        own = [(k, at[a:b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        return pd.DataFrame({"block": [k for k, _ in own], "at": [(x % BLOCK).astype(np.uint16).tobytes() for _, x in own], "counts": [total[x].tobytes() for _, x in own]})

    def count(batches):
        triples, total, held, seen = Triples(), np.zeros(cells, np.uint16), 0, set()
        for pdf in batches:
            for i, text in zip(pdf.id, pdf.text):
                if i not in seen and (t := triples.of(text, least_words)) is not None:
                    # Triples of one text that share a cell count once: what another text has there makes two.
                    cell = _cell(t, cells)
                    total[cell] += 1
                    held += 1
                    if held == 65_535:
                        yield rows(total)
                        total[:], held = 0, 0
                seen.add(i)
                if len(seen) > 2_000_000:
                    seen.clear()
        if held:
            yield rows(total)

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(BLOCK, np.int64)
        for at, counts in zip(pdf["at"], pdf["counts"]):
            total[np.frombuffer(at, np.uint16)] += np.frombuffer(counts, np.uint16)
        return pd.DataFrame({"block": [pdf.block.iloc[0]], "counts": [np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8).tobytes()]})

    out = np.zeros((cells // BLOCK, BLOCK), np.uint8)
    for r in texts.mapInPandas(count, "block int, at binary, counts binary").groupBy("block").applyInPandas(add, "block int, counts binary").collect():
        out[r.block] = np.frombuffer(r.counts, np.uint8)
    return out.ravel()


def _cell(t: np.ndarray, cells: int) -> np.ndarray:
    return (t >> np.uint64(64 - cells.bit_length() + 1)).astype(np.int64)


def _segment(t: np.ndarray) -> np.ndarray:
    return ((t >> np.uint64(18)) & np.uint64(SEGMENTS - 1)).astype(np.int64)


def prefixes(sets: list[np.ndarray], order: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted sets, (set, triple, place), (set, segment) sizes: the first triples of each segment of each set, rarest first, as far as the first one shared can stand."""
    n = np.array([len(s) for s in sets])
    flat, own = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
    box = own * SEGMENTS + _segment(flat)
    at = np.argsort(box << 8 | order[_cell(flat, len(order))], kind="stable")  # equally rare ones stay as they are in the set, by hash
    size = np.bincount(box, minlength=len(sets) * SEGMENTS)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    keep = place <= np.repeat(size - np.ceil(similarity * size - 1e-9).astype(np.int64), size)
    return own[at][keep], flat[at][keep], place[keep], size.reshape(-1, SEGMENTS)


def sketches(sets: list[np.ndarray]) -> list[np.ndarray]:
    """The parity of each set's triples in 64 * SEGMENTS cells, or in more for large sets; folding a sketch in halves gives that of half the cells."""
    out = [None] * len(sets)
    n = np.array([len(s) for s in sets])
    fold = np.maximum(0, np.ceil(np.log2(np.maximum(n, 1) / NARROW))).astype(np.int64)
    for k in np.unique(fold):
        own, cells = np.flatnonzero(fold == k), 64 * SEGMENTS << int(k)
        flat = np.concatenate([sets[i] for i in own])
        cell = ((flat >> np.uint64(12)) & np.uint64(cells - 1)).astype(np.int64) + np.repeat(np.arange(len(own)), n[own]) * cells
        odd = (np.bincount(cell, minlength=len(own) * cells) & 1).astype(np.uint8).reshape(len(own), cells)
        for i, x in zip(own, np.packbits(odd, axis=1, bitorder="little").view(np.int64)):
            out[i] = x
    return out


def head(sizes: np.ndarray) -> np.ndarray:
    """The sizes of a set's segments as words that go before its sketch: two bytes each, or four where one is too large for that."""
    return sizes.astype(np.uint16 if sizes.max() < 1 << 16 else np.uint32).view(np.int64)


def sizes_of(words: np.ndarray, starts: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sizes of the segments, and how many words they take. Sketches have a power of two of words, which tells the two kinds of head apart."""
    short = SEGMENTS // 4
    heads = np.where(widths - short & widths - short - 1, 2 * short, short)
    out = np.empty((len(starts), SEGMENTS), np.int64)
    for n, kind in ((short, np.uint16), (2 * short, np.uint32)):
        own = np.flatnonzero(heads == n)
        out[own] = np.ascontiguousarray(words[starts[own][:, None] + np.arange(n)]).view(kind)
    return out, heads


def pack(ids: np.ndarray, counts: np.ndarray, keys: np.ndarray, places: np.ndarray, bits: list[np.ndarray]) -> bytes:
    """Texts of one part, with counts keys and places each, in few bytes: whole columns, small numbers in the least width that holds them all."""
    import pyarrow as pa

    small = [x.astype(f"<u{next(k for k in (1, 2, 4) if x.max() < 1 << 8 * k)}") for x in (counts, np.array([len(x) for x in bits]), places)]
    # Hashes are as good as random. Sketches have few bits set; they compress by themselves only.
    columns = [np.concatenate(bits).tobytes(), b"".join(x.tobytes() for x in small)]
    packed = [pa.compress(x, codec="zstd", asbytes=True) for x in columns]
    sizes = [len(ids), len(keys), *(x.itemsize for x in small), *map(len, columns), *map(len, packed)]
    return b"".join([np.array(sizes, "<u4").tobytes(), ids.astype("<i8").tobytes(), keys.astype("<u4").tobytes(), *packed])


def unpack(packed: list[bytes]) -> list[np.ndarray]:
    """All that was packed, one after the other: ids, counts, keys, places, and the widths and words of what goes with each id."""
    import pyarrow as pa

    columns = []
    for x in packed:
        n, postings, *kinds, words, small, words_packed, small_packed = np.frombuffer(x, "<u4", 9).tolist()
        cuts = np.cumsum([36, 8 * n, 4 * postings, words_packed, small_packed]).tolist()
        words, small = (pa.decompress(x[a:b], size, codec="zstd", asbytes=True) for a, b, size in zip(cuts[2:], cuts[3:], (words, small)))
        at = np.cumsum([0, kinds[0] * n, kinds[1] * n]).tolist()
        counts, widths, places = (np.frombuffer(small, f"<u{kind}", length, k) for kind, length, k in zip(kinds, (n, n, postings), at))
        columns.append((np.frombuffer(x, "<i8", n, cuts[0]), counts, np.frombuffer(x, "<u4", postings, cuts[1]), places, widths, np.frombuffer(words, "<i8")))
    return [np.concatenate(x) for x in zip(*columns)]


class Sketches:
    """Sketches of many texts, by width; differences are those of the widest sketch that both texts have."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, widths: np.ndarray, sizes: np.ndarray):
        self.width, self.sizes, self.folded, self.where = widths, sizes, {}, {}
        width = SEGMENTS
        while len(widths) and width <= widths.max():
            own = np.flatnonzero(widths >= width)
            here = np.empty((len(own), width), np.uint64)
            for w in np.unique(widths[own]):
                same = widths[own] == w
                here[same] = np.bitwise_xor.reduce(words[starts[own[same]][:, None] + np.arange(w)].reshape(-1, w // width, width), axis=1)
            to = np.full(len(widths), -1, np.int32)
            to[own] = np.arange(len(own))
            self.folded[width], self.where[width] = here, to
            width *= 2

    def differences(self, i: np.ndarray, j: np.ndarray, segment: np.ndarray) -> np.ndarray:
        """In how many cells of a segment each pair differs."""
        common, out = np.minimum(self.width[i], self.width[j]), np.empty(len(i), np.int32)
        for w in np.unique(common):
            own = np.flatnonzero(common == w) if len(self.folded) > 1 else slice(None)
            sketch, to, seg = self.folded[int(w)], self.where[int(w)], segment[own]
            x, y = to[i[own]], to[j[own]]
            total = np.bitwise_count(sketch[x, seg] ^ sketch[y, seg]).astype(np.int32)
            for more in range(SEGMENTS, int(w), SEGMENTS):
                total += np.bitwise_count(sketch[x, seg + more] ^ sketch[y, seg + more])
            out[own] = total
        return out


def ring(found: Sketches, i: np.ndarray, j: np.ndarray, start: np.ndarray, similarity: float, chain: int = CHAIN) -> tuple[np.ndarray, list[int]]:
    """Which pairs stay within their budgets on the chain from their start, and then within the whole budget; and how many were alive after each segment."""
    share, alive = (1 - similarity) / (1 + similarity), np.arange(len(i))
    total, budget, left = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), []
    for step in range(SEGMENTS):
        seg = (start[alive] + step) % SEGMENTS
        a, b = i[alive], j[alive]
        total[alive] += found.differences(a, b, seg)
        budget[alive] += found.sizes[a, seg] + found.sizes[b, seg]
        if step < chain or step == SEGMENTS - 1:
            alive = alive[total[alive] <= budget[alive] * share + 1e-6]
            left.append(len(alive))
    return alive, left


def met(ids: np.ndarray, sizes: np.ndarray, row: np.ndarray, key: np.ndarray, place: np.ndarray, similarity: float, found: Sketches | None = None):
    """Blocks (i, j, segment) of indices of ids that meet at a key (32 bits, its segment among them) of both prefixes, at places that allow the similarity there.

    With sketches, texts under a common key are held against each other in tiles, and of those only the ones come out that start a chain.
    """
    ratio = (1 + similarity) / similarity
    segment = _segment(key.astype(np.uint64))
    n, own = sizes.sum(axis=1), sizes[row, segment]
    by = np.lexsort((ids[row], own))
    rank = np.empty(len(by), np.uint64)
    rank[by] = np.arange(len(by))
    joint = (key.astype(np.uint64) << np.uint64(32)) | rank
    at = np.argsort(joint, kind="stable")
    ordered = own[by]
    joint, row, place, own, segment = joint[at], row[at], place[at].astype(np.int64), own[at], segment[at]
    # The smaller segment shares no more than what it has from here on, which bounds the size of the larger.
    most = np.floor((own - place) * ratio - own + 1e-6)
    beyond = np.searchsorted(ordered, most, side="right").astype(np.uint64)
    ends = np.searchsorted(joint, (joint & np.uint64(0xFFFFFFFF00000000)) | beyond)
    count = np.maximum(0, ends - np.arange(len(joint)) - 1)

    def possible(i, j):
        ok = (own[j] - place[j]) * ratio + 1e-6 >= own[i] + own[j]
        i, j = i[ok], j[ok]
        x, y, where = row[i], row[j], segment[i]
        ok = (ids[x] != ids[y]) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-6)
        return x[ok], y[ok], where[ok]

    if found is not None and len(row):
        # The words of a segment's sketch, folded to several widths; none for texts whose own is narrower.
        folds = [[np.where((to := found.where[w][row]) >= 0, found.folded[w][to, segment + m], np.uint64(0)) for m in range(0, w, SEGMENTS)] for w in (SEGMENTS, 2 * SEGMENTS, 4 * SEGMENTS) if w in found.folded]
        cells = folds[0][0]
        # Shares in 128ths, rounded up; two of 255 hold all 256 cells.
        shares = np.minimum(np.ceil(own * ((1 - similarity) / (1 + similarity)) * 128 + 1e-3), 255 * 128).astype(np.uint16)
        for i, j in _tiles(np.flatnonzero(count >= MANY), ends, joint >> np.uint64(32), folds, found.width[row], shares):
            yield possible(i, j)
        count = np.where(count >= MANY, 0, count)
    upto = np.cumsum(count)
    for low in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
        high = min(low + PAIRS, int(upto[-1]))
        a, b = np.searchsorted(upto, low, side="right"), np.searchsorted(upto, high) + 1
        begin = upto[a:b] - count[a:b]
        first = np.maximum(begin, low)
        part = np.minimum(upto[a:b], high) - first
        i = np.repeat(np.arange(a, b), part)
        j = np.arange(high - low) - np.repeat(np.cumsum(part) - part, part) + np.repeat(first - begin, part) + i + 1
        if found is not None:
            near = np.flatnonzero(np.left_shift(np.bitwise_count(cells[i] ^ cells[j]), 7, dtype=np.uint16) <= shares[i] + shares[j])
            i, j = i[near], j[near]
        yield possible(i, j)


def _tiles(rows: np.ndarray, ends: np.ndarray, key: np.ndarray, folds: list[list[np.ndarray]], widths: np.ndarray, shares: np.ndarray):
    """Blocks (i, j): of each of the rows and those after it up to its end, the ones whose cells differ within the shares of both."""
    kept, held = [], 0
    cuts = np.flatnonzero(np.diff(key[rows].astype(np.int64))) + 1
    for of_key in np.split(rows, cuts) if len(rows) else []:
        for k in range(0, len(of_key), TILE):
            a = of_key[k : k + TILE]
            for low in range(int(a[0]) + 1, int(ends[a].max()), WIDE):
                high = min(low + WIDE, int(ends[a].max()))
                # Texts of a key stand by size, so that a tile has about one width; the widest that all of it have tells most.
                width = min(int(widths[a].min()), int(widths[low:high].min())) // SEGMENTS
                fold = folds[min(len(folds), width.bit_length()) - 1]
                apart = np.left_shift(sum(np.bitwise_count(cells[a][:, None] ^ cells[None, low:high]).astype(np.uint16) for cells in fold), 7)
                at = np.flatnonzero(apart <= shares[a][:, None] + shares[None, low:high])
                i, j = a[at // (high - low)], low + at % (high - low)
                ok = (j > i) & (j < ends[i])
                kept.append((i[ok], j[ok]))
                held += len(kept[-1][0])
                if held >= PAIRS:
                    yield tuple(map(np.concatenate, zip(*kept)))
                    kept, held = [], 0
    if kept:
        yield tuple(map(np.concatenate, zip(*kept)))


def spread(part: np.ndarray, often: np.ndarray, block: np.ndarray, parts: int, hot: int) -> tuple[np.ndarray, np.ndarray]:
    """(posting, part): where postings go. A key listed about often > hot texts goes to every pair of blocks that its text's block is in."""
    blocks = np.maximum(1, -(-often // hot))
    at = np.repeat(np.arange(len(part)), blocks)
    other = np.arange(len(at)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    own = block[at] % blocks[at]
    cell = np.minimum(own, other) * blocks[at] + np.maximum(own, other)
    return at, np.where(blocks[at] > 1, (part[at].astype(np.int64) * 1_000_003 + cell * 7_919) % parts, part[at]).astype(np.int32)


def candidates(texts: DataFrame, similarity: float, least_words: int, hot: int = HOT, cells: int = CELLS) -> DataFrame:
    """(a, b): ids (64 bits of the text_hash) of texts with a chain and within the whole budget; all pairs at the similarity are among them."""
    import pyarrow as pa

    spark = texts.sparkSession
    # Most cells are empty or alone: packed, the counts take a fraction of the disk that copies of a broadcast lie on.
    packed = spark.sparkContext.broadcast(pa.compress(rarity(texts, least_words, cells).tobytes(), codec="zstd", asbytes=True))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def rows(ids, sets, order):
        own, flat, place, sizes = prefixes(sets, order, similarity)
        often = order[_cell(flat, cells)]
        shared = often > ALONE
        own, flat, place, often = own[shared], flat[shared], place[shared], np.exp2((often[shared] + 1) / 8).astype(np.int64)
        ids = np.array(ids, np.int64)
        at, part = spread(((flat >> np.uint64(32)) % np.uint64(parts)).astype(np.int32), often, ids[own] & 0xFFFF, parts, hot)
        by = np.lexsort((own[at], part))
        part, at = part[by], at[by]
        own, key, place = own[at], flat[at].astype(np.uint32), np.minimum(place[at], FAR_PLACE)
        starts = np.flatnonzero(np.diff(part, prepend=-1) | np.diff(own, prepend=-1))
        text, counts, of = own[starts], np.diff(starts, append=len(own)), part[starts]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        bits, out = [np.concatenate([head(s), x]) for s, x in zip(sizes, sketches(sets))], []
        for a, b in zip(first, np.append(first[1:], len(of))):
            t, post = text[a:b], slice(starts[a], starts[b] if b < len(of) else None)
            out.append(pack(ids[t], counts[a:b], key[post], place[post], [bits[k] for k in t]))
        return pa.RecordBatch.from_arrays([pa.array(of[first], pa.int32()), pa.array(out, pa.binary())], ["part", "texts"])

    def list_all(batches):
        triples, seen, ids, sets, held = Triples(), set(), [], [], 0
        order = np.frombuffer(pa.decompress(packed.value, cells, codec="zstd"), np.uint8)
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                if i in seen:
                    continue
                if len(seen) > 2_000_000:
                    seen.clear()
                seen.add(i)
                if (t := triples.of(text, least_words)) is not None:
                    ids.append(i)
                    sets.append(t)
                    held += len(t)
                if held >= TOGETHER:
                    yield rows(ids, sets, order)
                    ids, sets, held = [], [], 0
        if ids:
            yield rows(ids, sets, order)

    def pair(batches):
        held = [x for b in batches for x in b.column("texts").to_pylist()]
        if not held:
            return
        ids, counts, key, place, widths, words = unpack(held)
        del held
        row, widths = np.repeat(np.arange(len(ids)), counts), widths.astype(np.int64)
        starts = np.cumsum(widths) - widths
        sizes, heads = sizes_of(words, starts, widths)
        found = Sketches(words.view(np.uint64), starts + heads, widths - heads, sizes)
        for i, j, segment in met(ids, sizes, row, key, place, similarity, found):
            alive, _ = ring(found, i, j, segment, similarity)
            if len(alive):
                i, j = i[alive], j[alive]
                a, b = np.unique(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return texts.mapInArrow(list_all, "part int, texts binary").repartitionById(parts, "part").mapInArrow(pair, "a bigint, b bigint").distinct()


def marked(ids: DataFrame, cells: int) -> np.ndarray:
    """A bit for each of the cells that 60-bit ids fall in, by their upper bits."""
    shift = 60 - cells.bit_length() + 1

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(BLOCK, np.uint8)
        bits[pdf.cell.to_numpy() % BLOCK] = 1
        return pd.DataFrame({"block": [pdf.block.iloc[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    out = np.zeros((cells // BLOCK, BLOCK // 8), np.uint8)
    at = ids.select(F.shiftright("id", shift).alias("cell")).withColumn("block", F.shiftright("cell", BLOCK.bit_length() - 1))
    for r in at.distinct().groupBy("block").applyInPandas(pack, "block bigint, bits binary").collect():
        out[r.block] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def near_pairs(chunks: DataFrame, similarity: float = 0.5, least_words: int = 30, hot: int = HOT) -> DataFrame:
    """(text_hash_a, text_hash_b, similarity), a < b: pairs of different texts that share enough of their distinct word triples."""
    texts = chunks.where("text is not null and text_hash is not null").select(F.conv(F.substring("text_hash", 1, 15), 16, 10).cast("bigint").alias("id"), "text_hash", "text")
    cells = min(MOST_CELLS, max(CELLS, 1 << (CELLS_A_TEXT * chunks.count()).bit_length()))
    pairs = stage(candidates(texts.select("id", "text"), similarity, least_words, hot, cells), "candidates")

    # Only texts that have a candidate are cut into triples again, each once a task; texts that merely share their bit find no pair to join.
    involved = texts.sparkSession.sparkContext.broadcast(marked(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), cells))

    def sets(batches):
        triples, bits, seen, shift = Triples(), involved.value, set(), 60 - cells.bit_length() + 1
        for pdf in batches:
            rows, cell = [], pdf.id.to_numpy() >> shift
            pdf = pdf[(bits[cell >> 3] >> (cell & 7) & 1).astype(bool)]
            for i, name, text in zip(pdf.id, pdf.text_hash, pdf.text):
                if i not in seen and (t := triples.of(text, least_words)) is not None:
                    rows.append((i, name, (t >> np.uint64(32)).astype(np.uint32).tobytes()))
                if len(seen) > 2_000_000:
                    seen.clear()
                seen.add(i)
            yield pd.DataFrame(rows, columns=["id", "text_hash", "triples"])

    own = texts.mapInPandas(sets, "id bigint, text_hash string, triples binary").dropDuplicates(["id"])
    own = stage(own, "triples")
    side = lambda x: own.select(F.col("id").alias(x), F.col("text_hash").alias(f"h_{x}"), F.col("triples").alias(f"t_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("h_a", "h_b", "t_a", "t_b")

    def exact(batches):
        for pdf in batches:
            rows = []
            for ha, hb, ta, tb in pdf.itertuples(index=False):
                x, y = np.frombuffer(ta, np.uint32), np.frombuffer(tb, np.uint32)
                shared = len(np.intersect1d(x, y))
                s = shared / (len(x) + len(y) - shared)
                if s >= similarity and ha != hb:
                    rows.append((min(ha, hb), max(ha, hb), s))
            yield pd.DataFrame(rows, columns=["text_hash_a", "text_hash_b", "similarity"])

    return both.mapInPandas(exact, "text_hash_a string, text_hash_b string, similarity double")


def near_groups(chunks: DataFrame, similarity: float = 0.5, least_words: int = 30) -> DataFrame:
    """(text_hash, group_id, links): every text that has near copies, the group it belongs to (its least text_hash) and its number of partners."""
    from quillspark.operators.components import connected_components

    pairs = stage(near_pairs(chunks, similarity, least_words), "near")
    ends = pairs.select(F.col("text_hash_a").alias("text_hash")).union(pairs.select("text_hash_b")).groupBy("text_hash").agg(F.count("*").alias("links"))
    return connected_components(pairs, "text_hash_a", "text_hash_b").select(F.col("node").alias("text_hash"), F.col("class").alias("group_id")).join(ends, "text_hash")
