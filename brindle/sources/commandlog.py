"""Command logs: rows (seq, ts_ms, cmd, key, args) from text, JSON or Parquet, checked against the command table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "seq bigint, ts_ms bigint, cmd string, key string, args array<string>"

#: Command: fewest arguments, most (None: any number), and in what multiples after the first those come. The key counts.
COMMANDS = {
    "PING": (0, 0, 1), "INFO": (0, 0, 1), "COMPACT": (0, 0, 1), "DEL": (1, None, 1), "MEMORY": (2, 2, 1),
    "EXPIRE": (2, 2, 1), "EXPIRENX": (2, 2, 1), "EXPIREXX": (2, 2, 1), "EXPIREAT": (2, 2, 1), "EXPIREATNX": (2, 2, 1), "EXPIREATXX": (2, 2, 1), "TTL": (1, 1, 1), "PERSIST": (1, 1, 1),
    "SET": (2, 2, 1), "GET": (1, 1, 1), "INCR": (1, 1, 1), "DECR": (1, 1, 1), "INCRBY": (2, 2, 1), "DECRBY": (2, 2, 1),
    "HLL.ADD": (2, None, 1), "HLL.COUNT": (1, None, 1), "HLL.MERGE": (2, None, 1),
    "BF.ADD": (2, 2, 1), "BF.MADD": (2, None, 1), "BF.EXISTS": (2, 2, 1), "BF.MEXISTS": (2, None, 1),
    "CMS.INIT": (3, 3, 1), "CMS.INITBYPROB": (3, 3, 1), "CMS.INCRBY": (3, None, 2), "CMS.QUERY": (2, None, 1),
    "TOPK.RESERVE": (2, 5, 3), "TOPK.ADD": (2, None, 1), "TOPK.INCRBY": (3, None, 2), "TOPK.QUERY": (2, None, 1), "TOPK.LIST": (1, 2, 1),
}

#: Family of a command: which operator module takes its rows.
FAMILY = {c: "hll" if c[:4] == "HLL." else "bloom" if c[:3] == "BF." else "cms" if c[:4] == "CMS." else "topk" if c[:5] == "TOPK." else "counters" if c in ("SET", "GET", "INCR", "DECR", "INCRBY", "DECRBY") else "ttl" if c.startswith("EXPIRE") or c in ("TTL", "PERSIST", "DEL", "MEMORY") else "server" for c in COMMANDS}


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines ``seq ts_ms COMMAND key arg…``, separated by white space, without quoting; blank lines are left out."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(parts.alias("p"))
    return rows.select(F.expr("try_cast(p[0] AS bigint)").alias("seq"), F.expr("try_cast(p[1] AS bigint)").alias("ts_ms"), F.upper(F.get("p", F.lit(2))).alias("cmd"), F.get("p", F.lit(3)).alias("key"), F.slice("p", F.lit(5), F.greatest(F.size("p") - 4, F.lit(0))).alias("args"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path)


def append(log: DataFrame, path: str) -> None:
    """The log's sink: appends Parquet files; a batch is committed as a whole."""
    log.select("seq", "ts_ms", "cmd", "key", "args").write.mode("append").parquet(path)


def error_of(cmd: Column, n_args: Column) -> Column:
    """Null, or what is wrong with a command of so many arguments (the key included)."""
    out = F.when(~cmd.isin(*COMMANDS), F.concat(F.lit("ERR unknown command '"), cmd, F.lit("'")))
    for name, (least, most, step) in COMMANDS.items():
        wrong = (n_args < least) | ((n_args > most) if most is not None else F.lit(False)) | ((n_args - least) % step != 0)
        out = out.when((cmd == name) & wrong, f"ERR wrong number of arguments for '{name}' command")
    return out


def check(log: DataFrame) -> DataFrame:
    """The log with ``family`` and ``error`` columns."""
    n = F.when(F.col("key").isNull(), 0).otherwise(1) + F.coalesce(F.size("args"), F.lit(0))
    family = F.create_map(*[F.lit(x) for pair in FAMILY.items() for x in pair])
    return log.withColumns({"family": family[F.upper("cmd")], "error": error_of(F.upper("cmd"), n)})


def items(log: DataFrame, cmd: str) -> DataFrame:
    """key, seq, place, item: a row for each argument of an ADD, EXISTS or QUERY command."""
    return log.where(F.col("cmd") == cmd).select("key", "seq", F.posexplode("args").alias("place", "item"))


def weighted_items(log: DataFrame, cmd: str) -> DataFrame:
    """key, seq, place, item, weight: a row for each pair of an INCRBY command."""
    pairs = F.transform(F.sequence(F.lit(0), F.size("args") - 2, F.lit(2)), lambda i: F.struct(F.get("args", i).alias("item"), F.get("args", i + 1).alias("w")))
    rows = log.where((F.col("cmd") == cmd) & (F.size("args") >= 2)).select("key", "seq", F.posexplode(pairs).alias("place", "p"))
    return rows.select("key", "seq", "place", F.col("p.item").alias("item"), F.expr("try_cast(p.w AS bigint)").alias("weight"))


def counter_ops(log: DataFrame) -> DataFrame:
    """The rows that counters.running_value takes."""
    amount = F.when(F.col("cmd").isin("INCR", "DECR"), 1).otherwise(F.expr("try_cast(get(args, 0) AS decimal(38,0))"))
    delta = F.when(F.col("cmd").isin("DECR", "DECRBY"), -amount).otherwise(amount)
    rows = log.where(F.col("cmd").isin("SET", "INCR", "DECR", "INCRBY", "DECRBY", "DEL"))
    return rows.select("key", "seq", F.col("cmd").alias("op"), F.when(F.col("cmd") == "SET", F.get("args", F.lit(0))).alias("value"), F.when(~F.col("cmd").isin("SET", "DEL"), delta).alias("delta"))


def ttl_ops(log: DataFrame) -> DataFrame:
    """The rows that ttl.apply takes."""
    kinds = ("SET", "GET", "DEL", "TTL", "PERSIST", "EXPIRE", "EXPIREAT", "EXPIRENX", "EXPIREXX", "EXPIREATNX", "EXPIREATXX")
    return log.where(F.col("cmd").isin(*kinds)).select("key", "seq", "ts_ms", F.col("cmd").alias("op"), F.when(F.col("cmd").startswith("EXPIRE"), F.expr("try_cast(get(args, 0) AS bigint)")).alias("arg_ms"))
