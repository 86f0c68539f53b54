"""Count-Min sketches: linear ones as relations, and the order-dependent conservative update as a fold.

A linear sketch has a row (keys, row, col, cnt) for each cell that isn't zero. Cells are sums, so sketches merge, build
with map-side combine and give the same result for any partitioning; they bound the conservative sketch from above.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import hashing

#: Cells are unsigned 32-bit counters that stay at their maximum.
MAX_CELL = (1 << 32) - 1


@dataclass(frozen=True)
class Config:
    """CMS.INIT."""

    width: int = 1000
    depth: int = 5

    def __post_init__(self):
        if not 0 < self.width <= MAX_CELL:
            raise ValueError("invalid width")
        if not 0 < self.depth <= MAX_CELL:
            raise ValueError("invalid depth")

    @classmethod
    def from_prob(cls, epsilon: float, delta: float) -> Config:
        """CMS.INITBYPROB: an error of epsilon of the total, with probability 1 - delta."""
        if not 0 < epsilon < 1:
            raise ValueError("invalid epsilon")
        if not 0 < delta < 1:
            raise ValueError("invalid delta")
        return cls(math.ceil(math.e / epsilon), math.ceil(math.log(1 / delta)))


def cells_of(h: Column, config: Config) -> Column:
    """An array of (row, col): (h1 + row * h2) mod width, by residues."""
    a, b = hashing.unsigned_mod(h, config.width), hashing.unsigned_mod(hashing.second(h), config.width)
    return F.transform(F.sequence(F.lit(0), F.lit(config.depth - 1)), lambda i: F.struct(i.alias("row"), ((a + i * b) % config.width).cast("int").alias("col")))


def build(df: DataFrame, keys: list[str], col: str, weight: str | None = None, config: Config = Config(), hashed=hashing.default) -> DataFrame:
    """CMS.INCRBY for all rows. Items are summed before they are spread over the rows of the sketch. Null items are ignored."""
    n = F.count("*") if weight is None else F.sum(F.col(weight).cast("bigint"))
    items = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("_item")).agg(n.alias("_n"))
    spread = items.select(*keys, F.explode(cells_of(hashed(F.col("_item")), config)).alias("_c"), "_n")
    return spread.groupBy(*keys, F.col("_c.row").alias("row"), F.col("_c.col").alias("col")).agg(F.least(F.sum("_n"), F.lit(MAX_CELL)).alias("cnt"))


def merge(*sketches: DataFrame) -> DataFrame:
    from functools import reduce

    both = reduce(DataFrame.unionByName, sketches)
    return both.groupBy(*[c for c in both.columns if c != "cnt"]).agg(F.least(F.sum("cnt"), F.lit(MAX_CELL)).alias("cnt"))


def query(sketch: DataFrame, probes: DataFrame, keys: list[str], col: str, config: Config = Config(), hashed=hashing.default) -> DataFrame:
    """CMS.QUERY: keys, item, estimate for each distinct probe; 0 where the key has no sketch."""
    asked = probes.where(F.col(col).isNotNull()).select(*keys, F.col(col).alias("item")).distinct()
    spread = asked.select(*keys, "item", F.explode(cells_of(hashed(F.col("item")), config)).alias("_c")).select(*keys, "item", F.col("_c.row").alias("row"), F.col("_c.col").alias("col"))
    found = spread.join(sketch, [*keys, "row", "col"], "left")
    return found.groupBy(*keys, "item").agg(F.min(F.coalesce("cnt", F.lit(0))).cast("bigint").alias("estimate"))


def fold_conservative(df: DataFrame, key: str, col: str, order_by: str, weight: str | None = None, config: Config = Config()) -> DataFrame:
    """key, item, estimate, total: the sketch after the conservative update with each row in order.

    The update depends on the order, so a key's rows are one sequence, in one task. The fold keeps the matrix and a
    place for each item, not the rows: they stream through in sorted batches. Cells are those of ``build``.
    """
    import numpy as np
    import pandas as pd

    n = F.lit(1).cast("bigint") if weight is None else F.col(weight).cast("bigint")
    rows = df.where(F.col(col).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(col).cast("string").alias("item"), F.col(order_by).alias("seq"), n.alias("n"), F.transform(cells_of(hashing.default(F.col(col)), config), lambda c: c["col"]).alias("at"))
    width, depth = config.width, config.depth

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cells, total, places = None, None, 0, {}

        def out():
            items = list(places)
            return pd.DataFrame({"key": [now] * len(items), "item": items, "estimate": [int(cells[rows_, places[i]].min()) for i in items], "total": [total] * len(items)})

        rows_ = np.arange(depth)
        for batch in batches:
            for k, item, d, cols in zip(batch["key"], batch["item"], batch["n"], batch["at"]):
                if k != now or cells is None:
                    if cells is not None:
                        yield out()
                    now, cells, total, places = k, np.zeros((depth, width), np.int64), 0, {}
                if item not in places:
                    places[item] = np.asarray(cols, np.int64)
                at = places[item]
                target = min(int(cells[rows_, at].min()) + int(d), MAX_CELL)
                if d and (cells[rows_, at] < target).any():
                    cells[rows_, at] = np.maximum(cells[rows_, at], target)
                    total += int(d)
        if cells is not None:
            yield out()

    ordered = rows.repartition("key").sortWithinPartitions("key", "seq")
    return ordered.select("key", "item", "n", "at").mapInPandas(run, "key string, item string, estimate bigint, total bigint")
