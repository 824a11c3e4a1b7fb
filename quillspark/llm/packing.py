"""Filling fixed-capacity containers (problem 8): bounded-space online best fit.

Every shard keeps at most ``open_bins`` open containers. Their free spaces are the set bits of one integer, so the tightest container that takes an
item is a shift and a lowest-set-bit away. If none takes it and all are in use, the fullest is closed. What a shard still has open at its end is
sparse for want of items, so these containers' items go to a second round over groups of shards.

Defined results: an item larger than the capacity is split into full pieces and a rest; items of size 0 (null and empty texts) are placed like
others and need no space; null sizes count as 0; a null capacity or one below 1 takes no items; repeated budgets count once.
"""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN_BINS = 512
#: Containers' worth of items for a shard: what it leaves open is then a small part.
SHARD_BINS = 6_000
#: Items a shard may hold, whatever their sizes.
SHARD_ITEMS = 250_000
TAIL_SHARDS = 64
#: Budgets that one plan handles; more of them make more plans.
BUDGETS = 200


class OpenBins:
    """Open containers by free space."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.bits, self.held, self.n, self.made = capacity, most, 0, defaultdict(list), 0, 0

    def _take(self, free: int) -> int:
        own = self.held[free]
        found = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        self.n -= 1
        return found

    def _put(self, found: int, free: int) -> None:
        self.held[free].append(found)
        self.bits |= 1 << free
        self.n += 1

    def place(self, size: int) -> int:
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            found = self._take(free)
        else:
            if self.n >= self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            free, found = self.capacity, self.made
            self.made += 1
        if free > size:
            self._put(found, free - size)
        return found

    def still_open(self) -> set[int]:
        return {x for own in self.held.values() for x in own}


def pack(sizes, capacity: int, open_bins: int = OPEN_BINS) -> tuple[list[int], set[int]]:
    """The container of each size, in the order given, and the containers open at the end."""
    bins = OpenBins(capacity, open_bins)
    return [bins.place(int(s)) for s in sizes], bins.still_open()


OUT = "budget_id int, capacity int, item bigint, piece int, token_start bigint, tokens bigint, shard bigint, bin bigint, tail boolean"


def fill_containers(sizes: DataFrame, budgets: DataFrame, id_col: str = "doc_id", size_col: str = "tokens", open_bins: int = OPEN_BINS, shard_bins: int = SHARD_BINS) -> DataFrame:
    """(budget_id, capacity, id, piece, token_start, tokens, container): each item once per budget, whole unless it exceeds the capacity alone."""
    rows = budgets.select("budget_id", "capacity").where("capacity >= 1 and budget_id is not null").distinct().orderBy("budget_id", "capacity").collect()
    items = sizes.select(F.col(id_col).cast("bigint").alias("item"), F.greatest(F.lit(0), F.coalesce(F.col(size_col).cast("bigint"), F.lit(0))).alias("size"))
    if not rows:
        return items.where("false").selectExpr("cast(null as int) budget_id", "cast(null as int) capacity", f"item as {id_col}", "cast(0 as int) piece", "size token_start", "size tokens", "'' container")
    out = None
    for at in range(0, len(rows), BUDGETS):
        found = _filled(items, rows[at : at + BUDGETS], open_bins, shard_bins).withColumnRenamed("item", id_col)
        out = found if out is None else out.unionByName(found)
    return out


def _filled(items: DataFrame, rows: list, open_bins: int, shard_bins: int) -> DataFrame:
    # The totals decide the number of shards: one row per budget.
    rest = lambda c: F.expr(f"case when size > {c} then size % {c} else size end")
    totals = items.agg(F.count("*").alias("n"), *(F.sum(rest(r.capacity)).alias(f"t{i}") for i, r in enumerate(rows))).first()
    shards = [max(1, -(-(totals[f"t{i}"] or 0) // (shard_bins * r.capacity)), -(-totals["n"] // SHARD_ITEMS)) for i, r in enumerate(rows)]
    spread = F.explode(F.array(*(F.struct(F.lit(r.budget_id).alias("budget_id"), F.lit(r.capacity).alias("capacity"), F.lit(s).cast("bigint").alias("shards")) for r, s in zip(rows, shards))))
    placed = items.select("item", "size", spread.alias("b")).select("item", "size", "b.*")
    full = F.when(F.col("size") > F.col("capacity"), F.floor(F.col("size") / F.col("capacity"))).otherwise(0).cast("int")
    placed = placed.withColumn("full", full)
    left = F.col("size") - F.col("full") * F.col("capacity")
    whole = placed.where("full > 0").select("budget_id", "capacity", "item", "shards", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"))
    whole = whole.select(
        "budget_id", "capacity", "item", "piece", (F.col("piece").cast("bigint") * F.col("capacity")).alias("token_start"), F.col("capacity").cast("bigint").alias("tokens"),
        F.concat_ws("-", "budget_id", F.lit("w"), "item", "piece").alias("container"),
    )
    rests = placed.where((F.col("full") == 0) | (left > 0)).select("budget_id", "capacity", "item", F.col("full").alias("piece"), (F.col("full").cast("bigint") * F.col("capacity")).alias("token_start"), left.alias("tokens"), F.pmod(F.xxhash64("item"), F.col("shards")).alias("shard"))

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "piece"], kind="stable")
        capacity = int(pdf.capacity.iloc[0])
        pdf["bin"], still = pack(pdf.tokens, capacity, open_bins)
        used = pdf.groupby("bin").tokens.transform("sum")
        pdf["tail"] = pdf.bin.isin(still) & (used < 0.95 * capacity)
        return pdf

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "item", "piece"], ascending=[False, True, True], kind="stable")
        pdf["bin"], _ = pack(pdf.tokens, int(pdf.capacity.iloc[0]), len(pdf) + 1)
        return pdf

    from quillspark.staging import stage

    one = stage(rests.groupBy("budget_id", "capacity", "shard").applyInPandas(first, OUT), "packed")
    two = one.where("tail").withColumn("shard", F.floor(F.col("shard") / TAIL_SHARDS)).groupBy("budget_id", "capacity", "shard").applyInPandas(second, OUT)
    named = lambda df, kind: df.select("budget_id", "capacity", "item", "piece", "token_start", "tokens", F.concat_ws("-", "budget_id", F.lit(kind), "shard", "bin").alias("container"))
    return whole.unionByName(named(one.where("not tail"), "s")).unionByName(named(two, "t"))
