"""Durable state: Parquet snapshots and an append-only command log, with compaction.

A store is a folder: ``snapshot/batch=N`` holds the state (key, type, value, expires_at_ms) after the log's batches up
to N, ``log/batch=M`` the commands of batch M. A batch is one commit, so a reader sees whole batches, and compaction
reads a fixed range of them: what is appended meanwhile belongs to later batches and isn't lost.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.operators import counters, ttl

STATE = "key string, type string, value string, expires_at_ms bigint"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def batches(spark: SparkSession, path: str, kind: str) -> list[int]:
    """Numbers of the complete snapshots or log batches."""
    fs, p = _fs(spark, f"{path}/{kind}")
    if not fs.exists(p):
        return []
    found = []
    for status in fs.listStatus(p):
        name = status.getPath().getName()
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("batch=") and fs.exists(done):
            found.append(int(name[6:]))
    return sorted(found)


def save(state: DataFrame, path: str, batch: int = 0) -> None:
    """A snapshot of the state after the log's batches up to ``batch``."""
    state.select("key", "type", "value", "expires_at_ms").write.mode("overwrite").parquet(f"{path}/snapshot/batch={batch}")


def append(log: DataFrame, path: str) -> int:
    """Commands (key, seq, ts_ms, op, value, arg_ms) as the next batch; its number."""
    spark = log.sparkSession
    batch = max([0, *batches(spark, path, "log"), *batches(spark, path, "snapshot")]) + 1
    log.write.parquet(f"{path}/log/batch={batch}")
    return batch


def load(spark: SparkSession, path: str, now: int) -> DataFrame:
    """The last snapshot and the log after it; keys that have expired are left out."""
    snapshots = batches(spark, path, "snapshot")
    base = snapshots[-1] if snapshots else 0
    state = spark.read.schema(STATE).parquet(f"{path}/snapshot/batch={base}") if snapshots else spark.createDataFrame([], STATE)
    later = [b for b in batches(spark, path, "log") if b > base]
    for b in later:
        state = replay(state, spark.read.parquet(f"{path}/log/batch={b}"))
    return ttl.live(state, now)


#: Commands whose effect aggregates tell, those that need the ones before, and those that change nothing.
LAST = ("SET", "DEL", "EXPIREAT", "PERSIST")
FOLDED = ("INCR", "DECR", "INCRBY", "DECRBY", "EXPIRE", "EXPIRENX", "EXPIREXX", "EXPIREATNX", "EXPIREATXX")
READS = ("GET", "TTL", "MEMORY", "PING", "INFO", "COMPACT", "HLL.COUNT", "BF.EXISTS", "BF.MEXISTS", "CMS.QUERY", "TOPK.QUERY", "TOPK.LIST")


def replay(state: DataFrame, log: DataFrame) -> DataFrame:
    """State after a log's commands, in order of seq: value is SET's value or the amount of INCRBY and DECRBY, arg_ms the time of the EXPIRE family.

    Keys with counter, relative or conditional expiry commands are folded in order, the others go by aggregates. A state
    holds strings only: a log with a sketch's or an unknown command is an error, raised at once.
    """
    odd = log.where(~F.coalesce(F.col("op").isin(*LAST, *FOLDED, *READS), F.lit(False))).select("op").first()
    if odd is not None:
        raise ValueError(f"a store can't replay {odd.op}")
    log = log.where(~F.col("op").isin(*READS))
    keys = log.where(F.col("op").isin(*FOLDED)).select("key").distinct()
    rest = _replay_last(state.join(keys, "key", "left_anti"), log.join(keys, "key", "left_anti"))
    return rest.unionByName(_fold(state.join(keys, "key", "left_semi"), log.join(keys, "key", "left_semi")))


def _fold(state: DataFrame, log: DataFrame) -> DataFrame:
    """All of a key's commands in order, from its row of the state on; rows stream through."""
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        now, entry = None, None  # entry: (type, value, expiry) of a key that is there
        number = lambda x: int(x) if x is not None and re.fullmatch(counters.INTEGER, x) and counters.INT64_MIN <= int(x) <= counters.INT64_MAX else None
        for batch in batches:
            done: list = []
            for key, ts, op, kind, value, arg in zip(batch["key"], batch["ts_ms"], batch["op"], batch["type"], batch["value"], batch["arg"]):
                if key != now:
                    if entry is not None:
                        done.append((now, *entry))
                    now, entry = key, None
                value, kind = (None if pd.isna(x) else x for x in (value, kind))
                arg = None if pd.isna(arg) else int(arg)
                if op == "":
                    entry = (kind, value, arg)
                    continue
                ts = int(ts)
                if entry is not None and entry[2] is not None and 0 < entry[2] <= ts:
                    entry = None
                has = entry is not None and entry[2] is not None and entry[2] > 0
                if op == "SET":
                    entry = ("string", value, None)
                elif op == "DEL":
                    entry = None
                elif op == "PERSIST":
                    entry = entry and (*entry[:2], None)
                elif op.startswith("EXPIRE"):
                    at = None if arg is None else arg + (0 if op.startswith("EXPIREAT") else ts)
                    allowed = not has if op.endswith("NX") else has if op.endswith("XX") else True
                    if entry is not None and allowed and at is not None and at <= counters.INT64_MAX:
                        entry = None if at <= ts else (*entry[:2], at)
                else:
                    amount = 1 if op in ("INCR", "DECR") else number(value)
                    old = 0 if entry is None else number(entry[1]) if entry[0] == "string" else None
                    # A failed command changes nothing.
                    if amount is not None and old is not None:
                        total = old - amount if op.startswith("DECR") else old + amount
                        if counters.INT64_MIN <= total <= counters.INT64_MAX:
                            entry = ("string", str(total), entry and entry[2])
            yield _frame(done)
        if entry is not None:
            yield _frame([(now, *entry)])

    def _frame(rows: list) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["key", "type", "value", "expires_at_ms"], dtype=object)
        return out.assign(expires_at_ms=pd.array(list(out["expires_at_ms"]), dtype="Int64"))

    # A time is text on its way, since pandas makes numbers with nulls floating.
    first = state.select("key", F.lit(0).alias("after"), F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("ts_ms"), F.lit("").alias("op"), "type", "value", F.col("expires_at_ms").cast("string").alias("arg"))
    then = log.select("key", F.lit(1).alias("after"), F.col("seq").cast("bigint").alias("seq"), F.col("ts_ms").cast("bigint").alias("ts_ms"), "op", F.lit(None).cast("string").alias("type"), "value", F.col("arg_ms").cast("string").alias("arg"))
    rows = first.unionByName(then).repartition("key").sortWithinPartitions("key", "after", "seq")
    return rows.mapInPandas(run, STATE)


def _replay_last(state: DataFrame, log: DataFrame) -> DataFrame:
    """State after SET (value), DEL, EXPIREAT (arg_ms, an absolute time) and PERSIST commands, in order of seq.

    The last SET or DEL of a key decides what it is, and the last expiry after that what it has; all by aggregates.
    """
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    reset = F.col("op").isin("SET", "DEL")
    rows = log.withColumn("_last", F.coalesce(F.max(F.when(reset, F.col("seq"))).over(w), F.lit(-1)))
    rows = rows.where(F.col("seq") >= F.col("_last"))
    expiry = F.col("op").isin("EXPIREAT", "PERSIST")
    last = rows.groupBy("key").agg(
        F.max(F.when(reset, F.col("op"))).alias("_op"),
        F.max(F.when(F.col("op") == "SET", F.col("value"))).alias("_value"),
        F.max_by(F.when(F.col("op") == "EXPIREAT", F.col("arg_ms")), F.when(expiry, F.col("seq"))).alias("_expires"),
        F.max(expiry.cast("int")).alias("_has"),
    )
    both = state.join(last, "key", "full_outer")
    alive = F.when(F.col("_op").isNotNull(), F.col("_op") == "SET").otherwise(F.col("type").isNotNull())
    is_set = F.coalesce(F.col("_op") == "SET", F.lit(False))
    expires = F.when(F.col("_has") == 1, F.col("_expires")).when(is_set, F.lit(None)).otherwise(F.col("expires_at_ms"))
    return both.where(alive).select("key", F.when(is_set, F.lit("string")).otherwise(F.col("type")).alias("type"), F.when(is_set, F.col("_value")).otherwise(F.col("value")).alias("value"), expires.cast("bigint").alias("expires_at_ms"))


def compact(spark: SparkSession, path: str, now: int) -> int:
    """Fold the log into a new snapshot, then drop what that replaces; the snapshot's batch number."""
    logs, snapshots = batches(spark, path, "log"), batches(spark, path, "snapshot")
    batch = max([0, *logs, *snapshots])
    if batch in snapshots:
        return batch
    save(load(spark, path, now), path, batch)
    for kind, numbers in (("log", logs), ("snapshot", snapshots)):
        for b in numbers:
            fs, p = _fs(spark, f"{path}/{kind}/batch={b}")
            fs.delete(p, True)
    return batch


def needs_compaction(log_bytes: int, base_bytes: int, min_bytes: int = 64 << 20, percent: int = 100) -> bool:
    """Whether the log has grown enough over what the last compaction left."""
    return log_bytes >= min_bytes and log_bytes > base_bytes * (1 + percent / 100)


def describe(state: DataFrame, now: int) -> DataFrame:
    """By type: keys, live keys, keys with an expiry, bytes."""
    return state.groupBy("type").agg(F.count("*").alias("keys"), F.sum(ttl.is_live(F.lit(now)).cast("bigint")).alias("live"), F.count("expires_at_ms").alias("expiring"), F.sum(ttl.memory_usage(F.col("key"), F.coalesce("value", F.lit("")))).alias("bytes"))
