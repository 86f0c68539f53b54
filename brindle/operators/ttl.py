"""Expiring keys: a table (key, value, expires_at_ms) and the commands on it.

``now`` is always an argument. A key is live if it has no expiry or one after now; expired keys count as missing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of bookkeeping that the size of an entry includes.
OVERHEAD = 72
INT64_MAX = (1 << 63) - 1
INVALID = "ERR invalid expire time"


def is_live(now: Column | int, expires: str | Column = "expires_at_ms") -> Column:
    e = F.col(expires) if isinstance(expires, str) else expires
    return e.isNull() | (e <= 0) | (e > now)


def live(state: DataFrame, now: int) -> DataFrame:
    """What hasn't expired."""
    return state.where(is_live(F.lit(now)))


def expire(state: DataFrame, requests: DataFrame, now: int, *, absolute: bool = False, mode: str = "always") -> tuple[DataFrame, DataFrame]:
    """EXPIRE, EXPIREAT and their NX and XX forms, one request (key, ms) for a key, else an error: (new state, replies).

    ``mode`` is always, nx (only keys without an expiry) or xx (only keys with one). Replies have key, reply (1 or 0),
    error. A time that isn't after now deletes the key and replies 1; now + ms beyond 64 bits is an error.
    """
    wide = "decimal(38,0)"
    at = F.col("ms").cast(wide) + (0 if absolute else now)
    # One request for a key: with two, which comes first is not known here (``apply`` takes commands in order).
    once = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("several requests for key "), F.col("key"))).cast(wide)).otherwise(F.max(at))
    asked = requests.groupBy("key").agg(once.alias("_at"))
    joined = live(state, now).join(asked, "key", "left")
    has = F.col("expires_at_ms").isNotNull() & (F.col("expires_at_ms") > 0)
    allowed = {"always": F.lit(True), "nx": ~has, "xx": has}[mode]
    applies = F.col("_at").isNotNull() & (F.col("_at") <= INT64_MAX) & allowed
    new = joined.withColumn("expires_at_ms", F.when(applies, F.greatest(F.col("_at"), F.lit(-INT64_MAX).cast(wide)).cast("bigint")).otherwise(F.col("expires_at_ms")))
    new = new.where(~(applies & (F.col("_at") <= now))).select(*state.columns)
    replies = asked.join(live(state, now).select("key", "expires_at_ms", F.lit(1).alias("_there")), "key", "left")
    error = F.when(F.col("_at") > INT64_MAX, INVALID)
    return new, replies.select("key", F.when(error.isNull(), (F.col("_there").isNotNull() & allowed).cast("int")).alias("reply"), error.alias("error"))


def remaining(state: DataFrame, probes: DataFrame, now: int) -> DataFrame:
    """TTL: key, ttl: -2 missing, -1 no expiry, else milliseconds left."""
    found = live(state, now).select("key", "expires_at_ms", F.lit(1).alias("_there"))
    e = F.col("expires_at_ms")
    ttl = F.when(F.col("_there").isNull(), -2).when(e.isNull() | (e <= 0), -1).otherwise(F.greatest(e - now, F.lit(0)))
    return probes.select("key").distinct().join(found, "key", "left").select("key", ttl.cast("bigint").alias("ttl"))


def persist(state: DataFrame, probes: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """PERSIST: (new state, replies key, reply): 1 where an expiry went."""
    asked = probes.select("key").distinct().withColumn("_ask", F.lit(True))
    here = live(state, now)
    has = F.col("expires_at_ms").isNotNull() & (F.col("expires_at_ms") > 0)
    new = here.join(asked, "key", "left").withColumn("expires_at_ms", F.when(F.col("_ask").isNull(), F.col("expires_at_ms"))).select(*state.columns)
    return new, asked.join(here.where(has).select("key", F.lit(1).alias("_r")), "key", "left").select("key", F.coalesce("_r", F.lit(0)).alias("reply"))


def delete(state: DataFrame, probes: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """DEL: (new state, one row with the number of live keys that went). A key that is named twice counts once."""
    asked = probes.select("key").distinct()
    here = live(state, now)
    return here.join(asked, "key", "left_anti"), here.join(asked, "key", "left_semi").agg(F.count("*").alias("deleted"))


def exists(state: DataFrame, probes: DataFrame, now: int) -> DataFrame:
    """Probes that are live keys."""
    return probes.select("key").distinct().join(live(state, now), "key", "left_semi")


def memory_usage(key: Column, value: Column) -> Column:
    """MEMORY USAGE: bytes of key and value, and the overhead."""
    return (F.octet_length(key) + F.octet_length(value) + OVERHEAD).cast("bigint")


def apply(log: DataFrame) -> DataFrame:
    """Replies of a log (key, seq, ts_ms, op, value, arg_ms) in order: key, seq, op, reply, error.

    Knows SET, GET (reply null; it tells nothing but liveness), DEL, EXPIRE, EXPIREAT, EXPIRENX, EXPIREXX, EXPIREATNX,
    EXPIREATXX, TTL and PERSIST. Whether a key has expired between two commands depends on all before, so each key is
    a fold over its rows, which stream through in order.
    """
    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, there, expires = None, False, None
        for batch in batches:
            replies, errors = [], []
            for key, ts, op, arg in zip(batch["key"], batch["ts_ms"], batch["op"], batch["arg_ms"]):
                if key != now:
                    now, there, expires = key, False, None
                ts = int(ts)
                if there and expires is not None and expires <= ts:
                    there, expires = False, None
                reply, error = None, None
                if op == "SET":
                    there, expires, reply = True, None, 1
                elif op == "GET":
                    reply = int(there)
                elif op == "DEL":
                    reply, there, expires = int(there), False, None
                elif op == "TTL":
                    reply = -2 if not there else -1 if expires is None else max(expires - ts, 0)
                elif op == "PERSIST":
                    reply = int(there and expires is not None)
                    expires = None
                else:
                    at = int(arg) + (0 if op.startswith("EXPIREAT") else ts)
                    ok = there and (not op.endswith("NX") or expires is None) and (not op.endswith("XX") or expires is not None)
                    if at > INT64_MAX:
                        error = INVALID
                    else:
                        reply = int(ok)
                        if ok and at <= ts:
                            there, expires = False, None
                        elif ok:
                            expires = at
                replies.append(reply), errors.append(error)
            yield pd.DataFrame({"key": batch["key"], "seq": batch["seq"], "op": batch["op"], "reply": pd.array(replies, dtype="Int64"), "error": errors})

    rows = log.select("key", "seq", "ts_ms", "op", F.coalesce("arg_ms", F.lit(0)).cast("bigint").alias("arg_ms"))
    return rows.repartition("key").sortWithinPartitions("key", "seq").mapInPandas(run, "key string, seq bigint, op string, reply bigint, error string")
