"""HyperLogLog as a relation: a row (keys, idx, rank) for each register that is set.

Registers are a ``max`` aggregate, so adding, merging and rolling up are the same group-by with map-side combine, a key
takes part in as many tasks as it has input partitions, and no task ever holds a whole key's items. The estimate is
computed from the histogram of ranks by plain sums (Ertl's improved estimator). ``native`` functions are the compact
form: one binary DataSketches value per key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import hashing

PRECISION = 14
ALPHA = 0.7213475204444817


def index_and_rank(h: Column, p: int = PRECISION) -> tuple[Column, Column]:
    """The low p bits, and the place of the lowest set bit of the others (a guard bit bounds it)."""
    rest = F.shiftrightunsigned(h, p).bitwiseOR(F.lit(1 << (64 - p)))
    # rest & -rest is the lowest bit; -rest is ~rest + 1, which doesn't overflow since rest is positive.
    low = rest.bitwiseAND(F.bitwise_not(rest) + F.lit(1))
    return h.bitwiseAND(F.lit((1 << p) - 1)).cast("int"), (F.bit_count(low - F.lit(1)) + 1).cast("int")


def registers(df: DataFrame, keys: list[str], col: str | Column, p: int = PRECISION, hashed=hashing.default) -> DataFrame:
    """HLL.ADD for all rows at once; null items are ignored."""
    item = F.col(col) if isinstance(col, str) else col
    idx, rank = index_and_rank(F.col("_h"), p)
    return df.where(item.isNotNull()).select(*keys, hashed(item).alias("_h")).select(*keys, idx.alias("idx"), rank.alias("rank")).groupBy(*keys, "idx").agg(F.max("rank").alias("rank"))


def merge(*sketches: DataFrame) -> DataFrame:
    """HLL.MERGE: the union of sketches over the same keys. Missing keys add nothing."""
    both = reduce(DataFrame.unionByName, sketches)
    keys = [c for c in both.columns if c != "rank"]
    return both.groupBy(*keys).agg(F.max("rank").alias("rank"))


def rollup(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """The union over all keys but the ones named."""
    return sketch.groupBy(*keys, "idx").agg(F.max("rank").alias("rank"))


def merge_as(sketch: DataFrame, key: str, dest: str, sources: list[str]) -> DataFrame:
    """HLL.MERGE dest src…: the table with dest replaced by its union with the sources; the sources stay."""
    part = sketch.where(F.col(key).isin(dest, *sources)).withColumn(key, F.lit(dest))
    return sketch.where(F.col(key) != dest).unionByName(rollup(part, [key]).select(*sketch.columns))


def changed(sketch: DataFrame, more: DataFrame) -> DataFrame:
    """HLL.ADD's reply for each key of ``more``: 1 if any register grows, else 0."""
    keys = [c for c in more.columns if c not in ("idx", "rank")]
    old = sketch.withColumnRenamed("rank", "old")
    return more.join(old, [*keys, "idx"], "left").groupBy(*keys).agg(F.max((F.col("rank") > F.coalesce("old", F.lit(0))).cast("int")).alias("changed"))


def sigma(x: Column, terms: int = 60) -> Column:
    """x + sum of x^(2^i) 2^(i-1)."""
    return x + F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, i: a + F.pow(x, F.pow(F.lit(2.0), i)) * F.pow(F.lit(2.0), i - 1))


def tau(x: Column, terms: int = 60) -> Column:
    """(1 - x - sum of (1 - x^(2^-i))^2 2^-i) / 3; 0 at 0 and 1."""
    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, i: a + F.pow(1 - F.pow(x, F.pow(F.lit(2.0), -i)), F.lit(2.0)) * F.pow(F.lit(2.0), -i))
    return F.when((x == 0) | (x == 1), 0.0).otherwise((1 - x - total) / 3)


def estimate(sketch: DataFrame, keys: list[str], p: int = PRECISION) -> DataFrame:
    """HLL.COUNT of each key: keys, estimate. A key without registers has no row; without keys there is one row."""
    m, q = float(1 << p), 64 - p
    count = lambda rank: F.sum((F.col("rank") == rank).cast("bigint"))
    sums = sketch.groupBy(*keys).agg(
        F.count("rank").alias("_set"),
        F.coalesce(count(q + 1), F.lit(0)).alias("_top"),
        F.coalesce(F.sum(F.when(F.col("rank") <= q, F.pow(F.lit(2.0), -F.col("rank")))), F.lit(0.0)).alias("_mid"),
    )
    zero = F.lit(m) - F.col("_set")
    z = F.col("_mid") + m * sigma(zero / m) + m * tau(1 - F.col("_top") / m) * 2.0**-q
    return sums.select(*keys, F.when(F.col("_set") == 0, 0).otherwise(F.round(F.lit(ALPHA * m * m) / z)).cast("bigint").alias("estimate"))


def union_estimate(sketch: DataFrame, key: str, names: list | None = None, p: int = PRECISION) -> DataFrame:
    """HLL.COUNT key key…: the size of the union of some keys, or of all; missing keys add nothing."""
    part = sketch if names is None else sketch.where(F.col(key).isin(*names))
    return estimate(rollup(part, []), [], p)


def native(df: DataFrame, keys: list[str], col: str, p: int = PRECISION) -> DataFrame:
    """keys, sketch: compact binary sketches by Spark's own aggregate."""
    return df.groupBy(*keys).agg(F.hll_sketch_agg(col, p).alias("sketch"))


def native_estimate(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Union by key, and estimate."""
    return sketch.groupBy(*keys).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))
