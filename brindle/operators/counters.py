"""Strings and counters over a command log: (key, seq, op, value, delta).

A counter's value after each command is a running sum since the last SET or DEL, in DECIMAL(38,0) so that a result
outside of 64 bits is seen. The window partitions by key. A command whose result would be outside, or whose value is no
integer, is an error and changes nothing; keys with such a command are rare and go through an ordered fold instead.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

INT64_MIN, INT64_MAX = -(1 << 63), (1 << 63) - 1
OVERFLOW, NOT_INTEGER = "ERR increment or decrement would overflow", "ERR value is not an integer or out of range"
#: What counts as an integer: an optional sign and decimal digits.
INTEGER = "[+-]?[0-9]+"


def set_last(ops: DataFrame, key: str = "key", seq: str = "seq", value: str = "value") -> DataFrame:
    """SET for all rows, in order: the last value of each key."""
    return ops.groupBy(key).agg(F.max_by(value, seq).alias(value))


def get(state: DataFrame, probes: DataFrame, key: str = "key") -> DataFrame:
    """GET: the value of each probe, null where there is none."""
    return probes.select(key).distinct().join(state, key, "left")


def running_value(ops: DataFrame) -> DataFrame:
    """INCR, DECR, INCRBY, DECRBY, SET, DEL: key, seq, op, result, error for each row.

    ``delta`` is signed (DECRBY n is -n). result is the number after the command, for SET and DEL null; error is null
    or the message. INCR of a key whose SET value is no 64-bit integer is an error.
    """
    w = Window.partitionBy("key").orderBy("seq")
    reset = F.col("op").isin("SET", "DEL")
    wide = "decimal(38,0)"
    rows = ops.select("key", "seq", "op", "value", F.when(reset, None).otherwise(F.coalesce(F.col("delta"), F.lit(1))).cast("bigint").alias("delta"))
    rows = rows.withColumn("_seg", F.sum(reset.cast("int")).over(w))
    inside = Window.partitionBy("key", "_seg").orderBy("seq")
    start = F.first(F.when(F.col("op") == "SET", F.col("value")), ignorenulls=True).over(inside)
    rows = rows.withColumn("_start", start).withColumn("_number", F.when(F.col("_start").isNull(), F.lit(0)).otherwise(F.expr(f"try_cast(_start AS {wide})")))
    rows = rows.withColumn("_total", F.coalesce("_number", F.lit(0)).cast(wide) + F.coalesce(F.sum(F.col("delta").cast(wide)).over(inside), F.lit(0).cast(wide)))
    out_of_range = ~F.col("_total").between(F.lit(INT64_MIN).cast(wide), F.lit(INT64_MAX).cast(wide))
    bad_start = F.col("_start").isNotNull() & (~F.col("_start").rlike(rf"\A{INTEGER}\z") | F.col("_number").isNull() | ~F.col("_number").between(F.lit(INT64_MIN).cast(wide), F.lit(INT64_MAX).cast(wide)))
    rows = rows.withColumn("_odd", ~reset & (bad_start | out_of_range))
    # Once a command of a segment fails, the sums after it are wrong: such segments are folded.
    whole = Window.partitionBy("key", "_seg")
    rows = rows.withColumn("_fold", F.max("_odd").over(whole))
    good = rows.where(~F.col("_fold")).select("key", "seq", "op", F.when(~reset, F.col("_total")).cast("bigint").alias("result"), F.lit(None).cast("string").alias("error"))
    odd = rows.where("_fold").select("key", "_seg", "seq", "op", F.col("_start").alias("start"), "delta")
    return good.unionByName(_fold(odd))


def _fold(rows: DataFrame) -> DataFrame:
    import re

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, total = None, None
        for batch in batches:
            result, error = [], []
            for key, seg, op, start, delta in zip(batch["key"], batch["_seg"], batch["op"], batch["start"], batch["delta"]):
                if (key, seg) != now:
                    now = (key, seg)
                    total = 0 if start is None else int(start) if re.fullmatch(INTEGER, start) and INT64_MIN <= int(start) <= INT64_MAX else None
                if op in ("SET", "DEL"):
                    result.append(None), error.append(None)
                elif total is None:
                    result.append(None), error.append(NOT_INTEGER)
                elif not INT64_MIN <= total + int(delta) <= INT64_MAX:
                    result.append(None), error.append(OVERFLOW)
                else:
                    total += int(delta)
                    result.append(total), error.append(None)
            yield pd.DataFrame({"key": batch["key"], "seq": batch["seq"], "op": batch["op"], "result": pd.array(result, dtype="Int64"), "error": error})

    ordered = rows.withColumn("delta", F.coalesce("delta", F.lit(0))).repartition("key").sortWithinPartitions("key", "seq")
    return ordered.mapInPandas(run, "key string, seq bigint, op string, result bigint, error string")
