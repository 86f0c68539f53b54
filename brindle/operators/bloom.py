"""Blocked Bloom filters as relations: a row (keys, layer, block, word, bits) for each 64-bit word that has a bit.

An item touches one block of 512 bits; bits are combined by ``bit_or``, so a filter is one group-by with map-side
combine. A layered filter grows: each layer has twice the capacity and half the error of the one before.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import hashing

PROBES, BLOCK_BITS = 8, 512


def size_bytes(capacity: int, error: float) -> int:
    """Bytes for the optimal number of bits, in whole blocks."""
    n = capacity or 1
    p = 1e-9 if error <= 0 else 0.99 if error >= 1 else error
    bits = math.ceil(-n * math.log(p) / math.log(2) ** 2)
    return -(-math.ceil(bits / 8) // 64) * 64


@dataclass(frozen=True)
class Config:
    """Capacity and error of the first layer, and what grows."""

    capacity: int = 1000
    error_rate: float = 0.01
    growth: int = 2
    tightening: float = 0.5

    def blocks(self, layer: int = 0) -> int:
        return size_bytes(self.capacity * self.growth**layer, self.error_rate * self.tightening**layer) // 64


def positions(h: Column) -> Column:
    """The eight bits within a block, as an array of (word, mask)."""
    h2 = hashing.second(h)
    low = lambda x: x.bitwiseAND(F.lit(BLOCK_BITS - 1)).cast("int")
    # An odd step of the second hash never repeats a bit.
    start, step = low(h2), low(F.shiftrightunsigned(h2, 32)).bitwiseOR(F.lit(1))
    bit = lambda i: (start + i * step).bitwiseAND(F.lit(BLOCK_BITS - 1))
    return F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: F.struct(F.shiftright(bit(i), 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(i).bitwiseAND(F.lit(63))).alias("mask")))


def _block(h: Column, layer: Column, config: Config, layers: int) -> Column:
    out = hashing.unsigned_mod(h, config.blocks(layers - 1))
    for i in range(layers - 2, -1, -1):
        out = F.when(layer == i, hashing.unsigned_mod(h, config.blocks(i))).otherwise(out)
    return out.cast("bigint")


def _build(hashed: DataFrame, keys: list[str], config: Config, layers: int) -> DataFrame:
    rows = hashed.select(*keys, "layer", _block(F.col("_h"), F.col("layer"), config, layers).alias("block"), F.explode(positions(F.col("_h"))).alias("_p"))
    return rows.groupBy(*keys, "layer", "block", F.col("_p.word").alias("word")).agg(F.bit_or("_p.mask").alias("bits"))


def build(df: DataFrame, keys: list[str], col: str, config: Config = Config()) -> DataFrame:
    """BF.MADD into a filter of one layer; null items are ignored."""
    hashed = df.where(F.col(col).isNotNull()).select(*keys, F.lit(0).alias("layer"), hashing.default(F.col(col)).alias("_h"))
    return _build(hashed, keys, config, 1)


def layer_of(nth: Column, config: Config) -> Column:
    """Layer of the nth distinct item, from 1, for growth by two."""
    return F.floor(F.log2((nth - 1) / config.capacity + 1)).cast("int")


def layers_for(items: int, config: Config) -> int:
    """Layers that so many distinct items fill, for growth by two."""
    layers = 1
    while config.capacity * (2**layers - 1) < items:
        layers += 1
    return layers


def assign_layers(df: DataFrame, keys: list[str], col: str, order_by: str, config: Config = Config(), ranges: int = 64) -> DataFrame:
    """keys, item, first (the least ``order_by``), nth and layer of each distinct item, in order of first arrival.

    Numbers are global by key without one task seeing a key whole: the order is cut into ``ranges`` at approximate
    quantiles, items are numbered within a range, and a range starts after the counts of those before it.
    """
    first = df.where(F.col(col).isNotNull()).groupBy(*keys, F.col(col).alias("item")).agg(F.min(order_by).alias("first"))
    bounds = df.agg(F.percentile_approx(order_by, [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or []
    bounds = sorted(set(bounds))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b < F.col("first"))) if bounds else F.lit(0)
    placed = first.withColumn("_part", part)
    inside = placed.withColumn("_n", F.row_number().over(Window.partitionBy("_part", *keys).orderBy("first", "item")))
    counts = placed.groupBy("_part", *keys).agg(F.count("*").alias("_c"))
    # A row for each range and key: small, whatever the number of items.
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    nth = F.col("_n") + F.col("_before")
    return inside.join(before, ["_part", *keys]).select(*keys, "item", "first", nth.alias("nth"), layer_of(nth, config).alias("layer"))


def build_layered(df: DataFrame, keys: list[str], col: str, order_by: str, config: Config = Config(), layers: int = 32) -> DataFrame:
    """BF.MADD into a filter that grows; an item beyond the last of ``layers`` is an error when the filter is computed."""
    placed = assign_layers(df, keys, col, order_by, config)
    beyond = F.raise_error(F.concat(F.lit(f"an item needs more than {layers} layers: layer "), F.col("layer").cast("string"))).cast("int")
    placed = placed.withColumn("layer", F.when(F.col("layer") < layers, F.col("layer")).otherwise(beyond))
    return _build(placed.select(*keys, "layer", hashing.default(F.col("item")).alias("_h")), keys, config, layers)


def merge(*filters: DataFrame) -> DataFrame:
    """The union of filters of one configuration."""
    from functools import reduce

    both = reduce(DataFrame.unionByName, filters)
    return both.groupBy(*[c for c in both.columns if c != "bits"]).agg(F.bit_or("bits").alias("bits"))


def probe(filters: DataFrame, probes: DataFrame, keys: list[str], col: str, config: Config = Config(), layers: int = 1) -> DataFrame:
    """BF.MEXISTS: keys, item, found (0 or 1) for each distinct probe; 0 where the key has no filter or the item is null."""
    asked = probes.select(*keys, F.col(col).alias("item")).distinct()
    hashed = asked.withColumn("_h", hashing.default(F.col("item"))).withColumn("layer", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))))
    bits = hashed.select(*keys, "item", "layer", _block(F.col("_h"), F.col("layer"), config, layers).alias("block"), F.explode(positions(F.col("_h"))).alias("_p")).select(*keys, "item", "layer", "block", F.col("_p.word").alias("word"), F.col("_p.mask").alias("mask"))
    hit = bits.join(filters, [*keys, "layer", "block", "word"], "left").withColumn("_hit", F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"), F.lit(False)))
    by_layer = hit.groupBy(*keys, "item", "layer").agg(F.min("_hit").alias("_all"))
    return by_layer.groupBy(*keys, "item").agg(F.max((F.col("_all") & F.col("item").isNotNull()).cast("int")).alias("found"))


def add_replies(df: DataFrame, keys: list[str], col: str, order_by: str, prior: DataFrame | None = None) -> DataFrame:
    """BF.ADD / BF.MADD replies by exact first sight: 1 for the first row of an item that ``prior`` hasn't, else 0."""
    out = df.withColumn("_first", F.row_number().over(Window.partitionBy(*keys, col).orderBy(order_by)) == 1)
    if prior is not None:
        seen = prior.select(*keys, col).distinct().withColumn("_seen", F.lit(True))
        out = out.join(seen, [*keys, col], "left").withColumn("_first", F.col("_first") & F.col("_seen").isNull()).drop("_seen")
    return out.withColumn("added", F.col("_first").cast("int")).drop("_first")


def semi_join(left: DataFrame, right: DataFrame, on: str, config: Config | None = None, broadcast_bytes: int = 8 << 20) -> DataFrame:
    """``left_semi`` with a Bloom filter of the right side's keys in front of the shuffle.

    Rows that the filter rejects don't travel. The filter is broadcast only where its size, which the configuration
    tells, is at most ``broadcast_bytes``; otherwise the plain join runs.
    """
    keys = right.select(on).distinct()
    if config is None:
        config = Config(capacity=max(1, keys.count()))
    if config.blocks() * 64 > broadcast_bytes:
        return left.join(keys, on, "left_semi")
    # All words in order, in one row of a size that was checked: a lookup is by place.
    words = left.sparkSession.range(config.blocks() * 8).join(build(keys, [], on, config).select((F.col("block") * 8 + F.col("word")).alias("id"), "bits"), "id", "left")
    row = words.groupBy().agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("_w"))
    table = F.broadcast(row.select(F.transform("_w", lambda w: w["bits"]).alias("_words")))
    h = hashing.default(F.col(on))
    block = hashing.unsigned_mod(h, config.blocks())
    passes = F.forall(positions(h), lambda p: F.get("_words", (block * 8 + p["word"]).cast("int")).bitwiseAND(p["mask"]) == p["mask"])
    return left.join(table).where(passes).drop("_words").join(keys, on, "left_semi")


def anti_candidates(filters: DataFrame, left: DataFrame, on: str, config: Config) -> DataFrame:
    """Items of ``left`` that are certainly not in the filter."""
    return probe(filters, left, [], on, config).where(F.col("found") == 0).select(F.col("item").alias(on))
