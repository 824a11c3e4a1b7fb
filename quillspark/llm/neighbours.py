"""The most similar vectors of every vector (problem 5): shifted space-filling curves.

Each ordering projects the unit vectors to a few dimensions by its own random rotation and shift, and sorts them along a Hilbert curve. Spark partitions
the keys of all orderings by range; within a range every block of neighbouring keys is compared with itself and the blocks before and after it. What
the orderings find is merged and ranked again. A second round compares each vector with those that share a neighbour with it, and at last exact cosines
decide. Vectors move as bytes (one a component) until then.

Bounds that cost recall and nothing else: blocks at the end of a range see no further, of which there is one in RANGE_ROWS / BLOCK; and of those that list
a vector only the k + spare that place it best are linked back to it.

Defined results: vectors that are null, of another length, all zero, or hold null or non-finite numbers take no part; a text_hash delivered twice
counts once; ties in cosine go to the smaller text_hash; with fewer than k other vectors, all others are listed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.staging import stage

DIMENSION = 64
ORDERINGS = 12
BLOCK = 1_024
SPARE = 4
#: Rows of one range, vectors whose lists are merged at a time, and salts of a large group of equal vectors.
RANGE_ROWS, MERGE_ROWS, SALTS = 65_536, 16_384, 16
PROJECTED = 5
BITS = 10


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Position on a Hilbert curve of integer points (rows), by the transpose method of Skilling (2004)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            up = (x[i] & q) != 0
            t = np.where(up, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(up, x[0] ^ p, x[0] ^ t)
            x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def curve(ordering: int, vectors: np.ndarray) -> np.ndarray:
    """Keys of unit vectors in one ordering."""
    own = np.random.default_rng(1_000 + ordering)
    basis = np.linalg.qr(own.standard_normal((vectors.shape[1], PROJECTED)))[0]
    shift = own.uniform(0, 0.5, PROJECTED)
    # Components of a random unit vector lie within a few times 1 / sqrt(dimension).
    scaled = (vectors @ basis) * np.sqrt(vectors.shape[1]) / 8 + 0.25 + shift
    return hilbert(np.clip(scaled * (1 << BITS), 0, (1 << BITS) - 1), BITS)


def _top(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest of each row. In wide rows they lie in the k sixteens whose largest are largest."""
    n, m = s.shape
    k = min(k, m)
    if m >= 64 * k and m % 16 == 0:
        w = m // 16
        best = np.argpartition(-s.reshape(n, 16, w).max(axis=1), k - 1, axis=1)[:, :k]
        at = (best[:, None, :] + (np.arange(16) * w)[None, :, None]).reshape(n, -1)
        few = np.take_along_axis(s, at, axis=1)
        top = np.argpartition(-few, k - 1, axis=1)[:, :k]
        return np.take_along_axis(at, top, axis=1), np.take_along_axis(few, top, axis=1)
    at = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return at, np.take_along_axis(s, at, axis=1)


def packed(x: np.ndarray) -> list[bytes]:
    """Vectors as one signed byte a component, as a share of their largest."""
    return [r.tobytes() for r in np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127).astype(np.int8)]


def unpacked(column, dimension: int) -> np.ndarray:
    x = np.frombuffer(b"".join(column), np.int8).reshape(-1, dimension).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(cache: DataFrame, dimension: int = DIMENSION) -> DataFrame:
    """(text_hash, vector) of the vectors that take part, once each."""
    v = F.col("vector")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return cache.where(F.col("text_hash").isNotNull() & v.isNotNull() & (F.size(v) == dimension)).where(fine).groupBy("text_hash").agg(F.max("vector").alias("vector"))


LIST = "id bigint, ids binary, cos binary"


def _lists(ids: np.ndarray, there: np.ndarray, cos: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"id": ids, "ids": [x.tobytes() for x in there.astype(np.int64)], "cos": [x.tobytes() for x in cos.astype(np.float32)]})


def merged(found: DataFrame, wide: int, parts: int) -> DataFrame:
    """The best of each id's lists, best first, each neighbour once."""

    def run(batches):
        held = [p for p in batches if len(p)]
        if not held:
            return
        ids = np.concatenate([p.id.to_numpy() for p in held])
        size = np.array([len(x) // 8 for p in held for x in p.ids])
        there = np.frombuffer(b"".join(x for p in held for x in p.ids), np.int64)
        cos = np.frombuffer(b"".join(x for p in held for x in p.cos), np.float32)
        own = np.repeat(ids, size)
        at = np.lexsort((-cos, there, own))
        own, there, cos = own[at], there[at], cos[at]
        new = np.concatenate([[True], (own[1:] != own[:-1]) | (there[1:] != there[:-1])])
        own, there, cos = own[new], there[new], cos[new]
        at = np.lexsort((there, -cos, own))
        own, there, cos = own[at], there[at], cos[at]
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        ends = np.minimum(np.append(starts[1:], len(own)), starts + wide)
        for low in range(0, len(starts), 8_192):
            s, e = starts[low : low + 8_192], ends[low : low + 8_192]
            yield pd.DataFrame({"id": own[s], "ids": [there[a:b].tobytes() for a, b in zip(s, e)], "cos": [cos[a:b].tobytes() for a, b in zip(s, e)]})

    return found.repartition(parts, "id").mapInPandas(run, LIST)


def _each(pdf: pd.DataFrame) -> pd.DataFrame:
    """(id, m, p): the neighbours m of each id with their places."""
    size = np.array([len(x) // 8 for x in pdf.ids])
    return pd.DataFrame({"id": np.repeat(pdf.id.to_numpy(), size), "m": np.frombuffer(b"".join(pdf.ids), np.int64), "p": np.concatenate([np.arange(n) for n in size]).astype(np.int32)})


def nearest(cache: DataFrame, k: int = 5, dimension: int = DIMENSION, orderings: int = ORDERINGS, block: int = BLOCK, spare: int = SPARE, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(text_hash, neighbour, cosine, rank) for every usable vector. spare: candidates beyond k that are kept until the exact ranking."""
    keep, wide = k + 1, k + spare

    def normalise(batches):
        import xxhash

        for pdf in batches:
            if len(pdf) == 0:
                continue
            x = np.stack(pdf.vector.to_numpy()).astype(np.float64)
            x /= np.abs(x).max(axis=1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            same = [xxhash.xxh64_intdigest(r.tobytes()) - (1 << 63) for r in np.round(x * 1e5).astype(np.int32)]
            yield pd.DataFrame({"text_hash": pdf.text_hash, "same": same, "unit": [r.tobytes() for r in x.astype(np.float32)]})

    units = stage(usable(cache, dimension).mapInPandas(normalise, "text_hash string, same bigint, unit binary").withColumn("id", F.monotonically_increasing_id()), "units")
    # Of equal vectors only the first k + 1 can be among anyone's neighbours; the neighbours of the others are these.
    many = units.groupBy("same").count().where(F.col("count") > keep).select("same")
    large = units.join(many, "same", "left_semi").withColumn("salt", F.pmod(F.xxhash64("text_hash"), F.lit(SALTS)))
    first = large.withColumn("r", F.row_number().over(Window.partitionBy("same", "salt").orderBy("text_hash"))).where(F.col("r") <= keep)
    few = first.withColumn("r", F.row_number().over(Window.partitionBy("same").orderBy("text_hash"))).where(F.col("r") <= keep).select("same", F.col("text_hash").alias("neighbour"), F.col("unit").alias("there"), F.col("id").alias("few_id"))
    surplus = stage(large.join(few.select(F.col("few_id").alias("id")), "id", "left_anti").select("id", "same", "salt", "text_hash", "unit"), "surplus")
    spread = few.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    def cosines(batches):
        for pdf in batches:
            if len(pdf):
                x, y = (_matrix(c, np.float32, dimension).astype(np.float64) for c in (pdf.unit, pdf.there))
                yield pd.DataFrame({"text_hash": pdf.text_hash, "neighbour": pdf.neighbour, "cosine": np.round(np.einsum("ij,ij->i", x, y), 6)})

    order = Window.partitionBy("text_hash").orderBy(F.desc("cosine"), "neighbour")
    exact = "text_hash string, neighbour string, cosine double"
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    extra = ranked(surplus.join(spread, ["same", "salt"]).select("text_hash", "unit", "neighbour", "there").mapInPandas(cosines, exact))
    members = units.join(surplus.select("id"), "id", "left_anti").select("id", "text_hash", "unit")

    def keyed(batches):
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf.unit, np.float32, dimension)
                yield pd.DataFrame({"id": pdf.id, "bits": packed(x), "keys": list(np.stack([curve(o, x) for o in range(orderings)], axis=1))})

    keys = stage(members.select("id", "unit").mapInPandas(keyed, "id bigint, bits binary, keys array<bigint>"), "keys")
    total = keys.count()
    ranges, parts = max(1, -(-total * orderings // range_rows)), max(1, -(-total // MERGE_ROWS))
    laid = keys.select("id", "bits", F.posexplode("keys").alias("ordering", "key")).repartitionByRange(ranges, "ordering", "key")

    def compare(batches):
        held = [p for p in batches if len(p)]
        if not held:
            return
        pdf = pd.concat(held).sort_values(["ordering", "key", "id"], kind="stable")
        x, ids = unpacked(pdf.bits, dimension), pdf.id.to_numpy()
        for low, high in _runs(pdf.ordering.to_numpy()):
            for at in range(low, high, block):
                stop = min(at + block, high)
                left, right = max(low, at - block), min(high, stop + block)
                if right - left < 2:
                    continue
                s = x[at:stop] @ x[left:right].T
                s[np.arange(stop - at), np.arange(at - left, stop - left)] = -2
                there, cos = _top(s, min(wide, right - left - 1))
                yield _lists(ids[at:stop], ids[left:right][there], cos)

    near = stage(merged(laid.mapInPandas(compare, LIST), wide, parts), "near")
    # Texts that share a neighbour are compared with each other where that neighbour's list, in either direction, brings them together.
    each = stage(near.select("id", "ids").mapInPandas(lambda it: (_each(p) for p in it if len(p)), "id bigint, m bigint, p int"), "each")
    back = each.withColumn("r", F.row_number().over(Window.partitionBy("m").orderBy("p", "id"))).where(F.col("r") <= wide)
    link = each.select(F.col("id").alias("at"), F.col("m").alias("id")).union(back.select(F.col("m").alias("at"), "id")).distinct()
    around = link.join(keys.select("id", "bits"), "id").repartition(parts, "at")

    def meet(batches):
        held = [p for p in batches if len(p)]
        if not held:
            return
        pdf = pd.concat(held).sort_values(["at", "id"], kind="stable")
        x, ids = unpacked(pdf.bits, dimension), pdf.id.to_numpy()
        runs = np.array(list(_runs(pdf["at"].to_numpy())))
        for width in np.unique(runs[:, 1] - runs[:, 0]):
            if width < 2:
                continue
            own = runs[runs[:, 1] - runs[:, 0] == width, 0]
            for low in range(0, len(own), 2_048):
                rows = own[low : low + 2_048, None] + np.arange(width)
                v, who = x[rows], ids[rows]
                s = v @ v.transpose(0, 2, 1)
                s[:, np.arange(width), np.arange(width)] = -2
                most = min(wide, width - 1)
                best = np.argpartition(-s, most - 1, axis=2)[:, :, :most]
                there = np.take_along_axis(np.broadcast_to(who[:, None, :], s.shape), best, axis=2)
                yield _lists(who.ravel(), there.reshape(-1, most), np.take_along_axis(s, best, axis=2).reshape(-1, most))

    near = merged(near.unionByName(around.mapInPandas(meet, LIST)), wide, parts)
    # Exact cosines of what is left.
    pairs = near.select("id", "ids").mapInPandas(lambda it: (_each(p).drop(columns="p") for p in it if len(p)), "id bigint, m bigint")
    full = members.select("id", "unit", "text_hash")
    there = full.select(F.col("id").alias("m"), F.col("unit").alias("there"), F.col("text_hash").alias("neighbour"))
    both = pairs.join(there, "m").join(full, "id").select("text_hash", "unit", "neighbour", "there")
    return ranked(both.mapInPandas(cosines, exact)).unionByName(extra)


def _runs(values: np.ndarray):
    """(start, end) of runs of equal values."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    yield from zip(np.concatenate([[0], cuts]).tolist(), np.append(cuts, len(values)).tolist())


def _matrix(column, kind, dimension: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), kind).reshape(-1, dimension).astype(np.float32)


def mutual(ranked: DataFrame, least: float = 0.9) -> DataFrame:
    """(text_hash_a, text_hash_b): pairs of cosine least or more, each among the other's neighbours."""
    near = ranked.where(F.col("cosine") >= least).select(F.least("text_hash", "neighbour").alias("text_hash_a"), F.greatest("text_hash", "neighbour").alias("text_hash_b"))
    return near.groupBy("text_hash_a", "text_hash_b").count().where("count = 2").select("text_hash_a", "text_hash_b")
