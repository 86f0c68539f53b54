"""What the operators of this subpackage share: the shared folder, cut lineage, connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) is a temporary folder made and set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="brindle-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/brindle/{name}-{uuid.uuid4().hex}"
    _fs_path(spark, path, "deleteOnExit")
    return path


def _fs_path(spark: SparkSession, path: str, method: str, *args):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return getattr(fs, method)(p, *args)


def remove_path(spark: SparkSession, path: str) -> None:
    _fs_path(spark, path, "delete", True)


def cut(df: DataFrame, name: str, options: dict | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that survive executors.

    The shuffles behind it go when the write is done, since nothing reads them again; the session's setting is put back.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    was = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        spark.conf.set(_CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path), path


def carried(docs: DataFrame, id_col: str, text_col: str, carry: bool) -> DataFrame:
    """(doc_id, text) or (doc, doc_id, text): with ``carry`` all input columns travel as one struct."""
    cols = [F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")]
    if carry:
        cols.insert(0, F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc"))
    return docs.select(*cols)


def heavy_keys(counts: DataFrame, most: int) -> DataFrame:
    """Rows of ``counts`` (with n) that hold over one in ``most`` of all: fewer than ``most`` rows, whatever the size."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") > total / most)


def anti_heavy(rows: DataFrame, heavy: DataFrame, key: str) -> DataFrame:
    """``rows`` whose key isn't one of the few ``heavy`` ones (see heavy_keys), which are broadcast; null keys stay."""
    return rows.join(F.broadcast(heavy), key, "left_anti")


def bit_filter(numbers: DataFrame, bits: int = 26) -> DataFrame:
    """One row: the words of a Bloom filter of 2 ** ``bits`` bits, two for each ``no`` (a long that is a hash).

    Its size is fixed, whatever the rows; with many more rows than a tenth of its bits it lets ever more through.
    """
    words = 1 << (bits - 6)
    place = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1))
    each = numbers.select(F.explode(F.array(*[place(x) for x in _twice(F.col("no"))])).alias("p"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int"))
    used = each.groupBy(F.shiftright("p", 6).alias("id")).agg(F.bit_or(one).alias("w"))
    every = numbers.sparkSession.range(0, words, 1, 8).join(used, "id", "left")
    row = every.agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("w", F.lit(0).cast("long")).alias("w")))).alias("_words"))
    return cut(row.select(F.transform("_words", lambda x: x["w"]).alias("_words")), "filter")[0]


def _twice(no: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(no, 1), F.shiftrightunsigned(no, 33)


def passing(rows: DataFrame, filled: DataFrame, number: Column, inside: bool = True) -> DataFrame:
    """``rows`` whose number the filter may have, or (not ``inside``) certainly hasn't. The filter is one row of fixed size."""
    has = F.lit(True)
    for x in _twice(number):
        p = x.bitwiseAND(F.size("_words").cast("long") * 64 - 1)
        word = F.get("_words", F.shiftright(p, 6).cast("int"))
        has = has & (F.call_function("shiftright", word, p.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return rows.crossJoin(F.broadcast(filled)).where(has if inside else ~has).drop("_words")


def connected_components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until a round leaves the edges as they were.
    Each round is written to the shared folder, the one before is dropped; only two numbers reach the driver.
    Both steps replace a node's links by links to the smallest neighbour, so a hub's links never multiply, and
    the smallest neighbour is found by an aggregate with map-side combine: a hub is never gathered in one task.
    """
    spark = edges.sparkSession
    state = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    state, path = cut(state, f"{name}-cc")
    last = None
    for _ in range(max_rounds):
        both = state.unionByName(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: the neighbours above a node go to the smallest in its neighbourhood.
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node's neighbours below it, and itself, go to the smallest of them.
        below = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(below, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        state, old = small.where(F.col("a") != F.col("b")).distinct(), path
        state, path = cut(state, f"{name}-cc")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        remove_path(spark, old)
        if tuple(now) == last:
            break
        last = tuple(now)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return state.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def sha256_of(col: Column) -> Column:
    return F.sha2(col, 256)
