"""Heavy hitters: exact lists by group-by and rank, Spark's mergeable sketch, and HeavyKeeper as a seeded fold.

Exact lists rank each key's items after a pre-selection in parts, so that a key with very many items isn't ranked in
one task: only the first k of each part reach the final rank.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """TOPK.RESERVE."""

    k: int = 50
    width: int = 2048
    depth: int = 5
    decay: float = 0.9

    def __post_init__(self):
        if self.k < 1 or self.width < 1 or self.depth < 1:
            raise ValueError("k must be a positive integer")
        if not 0 < self.decay < 1:
            raise ValueError("decay must be between 0 and 1")


def build(df: DataFrame, keys: list[str], col: str, k: int, weight: str | None = None, parts: int = 16) -> DataFrame:
    """TOPK.ADD / TOPK.INCRBY for all rows: keys, rank, item, cnt of the k items with the largest counts.

    Ties go to the smaller item. Null items are ignored; without weights each row counts one; items whose weights sum
    to zero don't enter.
    """
    n = F.count("*") if weight is None else F.sum(F.col(weight).cast("bigint"))
    counts = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("item")).agg(n.alias("cnt")).where(F.col("cnt") > 0)
    return _ranked(counts, keys, k, parts)


def _ranked(counts: DataFrame, keys: list[str], k: int, parts: int) -> DataFrame:
    order = (F.desc("cnt"), F.asc("item"))
    part = F.pmod(F.xxhash64("item"), F.lit(parts))
    some = counts.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k).select(*keys, "rank", "item", "cnt")


def merge(keys: list[str], k: int, *lists: DataFrame, parts: int = 16) -> DataFrame:
    """Lists of disjoint inputs into one; exact if the lists hold all items of their inputs."""
    from functools import reduce

    both = reduce(DataFrame.unionByName, lists).groupBy(*keys, "item").agg(F.sum("cnt").alias("cnt"))
    return _ranked(both, keys, k, parts)


def contains(lists: DataFrame, probes: DataFrame, keys: list[str], col: str) -> DataFrame:
    """TOPK.QUERY: keys, item, found (0 or 1) for each distinct probe."""
    asked = probes.select(*keys, F.col(col).alias("item")).distinct()
    listed = lists.select(*keys, "item").withColumn("_in", F.lit(1))
    return asked.join(listed, [*keys, "item"], "left").select(*keys, "item", F.coalesce("_in", F.lit(0)).alias("found"))


def list_items(lists: DataFrame, keys: list[str], with_count: bool = False) -> DataFrame:
    """TOPK.LIST: a row per key with its items in order, as an array (of item and count)."""
    cell = F.struct("rank", "item", "cnt")
    rows = lists.groupBy(*keys).agg(F.sort_array(F.collect_list(cell)).alias("_l"))
    shown = F.transform("_l", lambda x: F.struct(x["item"].alias("item"), x["cnt"].alias("cnt")) if with_count else x["item"])
    return rows.select(*keys, shown.alias("items"))


def native(df: DataFrame, keys: list[str], col: str, k: int, tracked: int = 10_000) -> DataFrame:
    """keys, item, cnt by Spark's mergeable sketch (unweighted, approximate)."""
    rows = df.where(F.col(col).isNotNull()).groupBy(*keys).agg(F.expr(f"approx_top_k(`{col}`, {int(k)}, {int(tracked)})").alias("_t"))
    return rows.select(*keys, F.explode("_t").alias("_e")).select(*keys, F.col("_e.item").alias("item"), F.col("_e.count").cast("bigint").alias("cnt"))


def evictions(df: DataFrame, key: str, col: str, order_by: str, k: int, weight: str | None = None) -> DataFrame:
    """TOPK.ADD's replies with exact counts: seq and the expelled item (null if none) for each row, in order.

    The list is a heap of k by (count, item); a new item that doesn't exceed the smallest is itself expelled. The
    replies depend on the order, so a key's rows are one sequence.
    """
    import pandas as pd

    n = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    rows = df.where(F.col(col).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(order_by).cast("bigint").alias("seq"), F.col(col).cast("string").alias("item"), n.alias("n"))

    def run(batches):
        now, counts, held = None, {}, {}
        for batch in batches:
            gone = []
            for key_, item, w in zip(batch["key"], batch["item"], batch["n"]):
                if key_ != now:
                    now, counts, held = key_, {}, {}
                counts[item] = counts.get(item, 0) + int(w)
                if item in held or len(held) < k and w:
                    held[item] = counts[item]
                    gone.append(None)
                    continue
                least = min(held, key=lambda x: (held[x], x)) if held else None
                if w and least is not None and counts[item] > held[least]:
                    del held[least]
                    held[item] = counts[item]
                    gone.append(least)
                else:
                    gone.append(item)
            yield pd.DataFrame({"key": batch["key"], "seq": batch["seq"], "item": batch["item"], "expelled": gone})

    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, "key string, seq bigint, item string, expelled string")


def heavy_keeper(df: DataFrame, key: str, col: str, order_by: str, config: Config = Config(), weight: str | None = None, seed: int = 0) -> DataFrame:
    """HeavyKeeper as an ordered fold with a seeded generator: key, item, cnt of the list after all rows.

    A bucket holds an item's fingerprint and a count. A hit counts up; another item's bucket counts down with
    probability decay^count, and is taken at zero. An item enters the list with its largest count over the rows.
    A key's rows stream through one task, which keeps the buckets and the list.
    """
    import numpy as np
    import pandas as pd
    import xxhash

    n = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    rows = df.where(F.col(col).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(order_by).alias("seq"), F.col(col).cast("string").alias("item"), n.alias("n"))
    c = config

    def fresh():
        return np.random.default_rng(seed), np.zeros((c.depth, c.width), np.uint64), np.zeros((c.depth, c.width), np.int64), {}

    def add(state, item, w):
        rng, prints, counts, held = state
        h = xxhash.xxh64_intdigest(item)
        step = xxhash.xxh64_intdigest(h.to_bytes(8, "little"))
        best = 0
        for r in range(c.depth):
            at = (h + r * step) % (1 << 64) % c.width
            left = w
            if counts[r, at] and prints[r, at] != h:
                while left and counts[r, at]:
                    # Draws until the count falls: geometric, and no more than the weight.
                    p = c.decay ** int(counts[r, at])
                    draws = int(rng.geometric(p)) if p > 1e-12 else left + 1
                    if draws > left:
                        left = 0
                    else:
                        left -= draws
                        counts[r, at] -= 1
                if not counts[r, at] and (left or w):
                    prints[r, at], counts[r, at] = h, max(left, 1)
            elif left:
                prints[r, at] = h
                counts[r, at] += left
            if counts[r, at] and prints[r, at] == h:
                best = max(best, int(counts[r, at]))
        if not w or not best:
            return
        if item in held:
            held[item] = max(held[item], best)
        elif len(held) < c.k:
            held[item] = best
        else:
            least = min(held, key=lambda x: (held[x], x))
            if best > held[least]:
                del held[least]
                held[item] = best

    def run(batches):
        now, state = None, None
        done = lambda: pd.DataFrame([(now, i, n) for i, n in state[3].items()], columns=["key", "item", "cnt"])
        for batch in batches:
            for key_, item, w in zip(batch["key"], batch["item"], batch["n"]):
                if state is None or key_ != now:
                    if state is not None:
                        yield done()
                    now, state = key_, fresh()
                add(state, item, int(w))
        if state is not None:
            yield done()

    return rows.repartition("key").sortWithinPartitions("key", "seq").select("key", "item", "n").mapInPandas(run, "key string, item string, cnt bigint")
