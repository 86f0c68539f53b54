"""Hashes and unsigned arithmetic as Spark expressions.

Columns are hashed with ``xxhash64``; the second hash of double hashing is the hash of the first. ``seed0`` gives the
seed-0 hash through the JVM gateway (classic sessions only); ``portable`` can be computed by any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
#: Constants of the public XXH64 specification.
_P1, _P2, _P3, _P4, _P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def default(col: Column) -> Column:
    """64 bits, signed."""
    return F.xxhash64(col)


def portable(col: Column) -> Column:
    """60 bits of MD5, never negative; the same in any SQL engine."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 15), 16, 10).cast("bigint")


def seed0(col: Column) -> Column:
    """XXH64 with seed 0 of the column's bytes."""
    from pyspark.sql import SparkSession

    jvm = SparkSession.getActiveSession()._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    seq = jvm.org.apache.spark.api.python.PythonUtils.toSeq([utils.expression(col._jc)])
    return Column(utils.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(seq, 0)))


def second(h: Column) -> Column:
    """An independent second hash of a hash."""
    return F.xxhash64(h)


def unsigned_mod(h: Column, width: int) -> Column:
    """h modulo width, with h as an unsigned 64-bit number."""
    return F.pmod(F.pmod(F.shiftrightunsigned(h, 1), F.lit(width)) * 2 + h.bitwiseAND(F.lit(1).cast("bigint")), F.lit(width).cast("bigint"))


def bigint_hash_sql(column: str, seed: int = 42) -> str:
    """DuckDB expression (UHUGEINT) for ``xxhash64`` of a BIGINT column."""
    m = f"{MASK64 + 1}::UHUGEINT"
    x = f"(({column})::HUGEINT & {MASK64}::HUGEINT)::UHUGEINT"

    def mul(a: str, b: int) -> str:
        # Both factors are under 2^64, so the product is under 2^128.
        return f"(({a}) * {b}::UHUGEINT % {m})"

    def rotl(a: str, n: int) -> str:
        return f"((({a}) * {1 << n}::UHUGEINT % {m}) + (({a}) // {1 << (64 - n)}::UHUGEINT))"

    steps = [("a", x), ("b", mul("a", _P2)), ("c", rotl("b", 31)), ("d", mul("c", _P1)), ("e", f"xor({(seed + _P5 + 8) & MASK64}::UHUGEINT, d)"), ("f", rotl("e", 27)), ("g", f"(({mul('f', _P1)}) + {_P4}::UHUGEINT) % {m}"), ("h", f"xor(g, g // {1 << 33}::UHUGEINT)"), ("i", mul("h", _P2)), ("j", f"xor(i, i // {1 << 29}::UHUGEINT)"), ("k", mul("j", _P3)), ("l", f"xor(k, k // {1 << 32}::UHUGEINT)")]
    body = "l"
    for name, expression in reversed(steps):
        body = f"list_transform([{expression}], lambda {name}: {body})[1]"
    return body
