"""The reference cases of the sketches, and invariants."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import hashing
from brindle.operators import bloom, cms, hll, topk


def items(spark, **keys):
    return spark.createDataFrame([(k, i) for k, v in keys.items() for i in v], "key string, item string")


def union_of(spark, *names, **keys):
    return hll.union_estimate(hll.registers(items(spark, **keys), ["key"], "item"), "key", list(names)).first().estimate


def test_hll_small_cases(spark):
    assert union_of(spark, "a", "b", a=["apple", "banana"], b=["banana", "cherry"]) == 3
    assert union_of(spark, "a", "none", a=["p", "q"]) == 2
    assert union_of(spark, "a", "b", "c", a="ab", b="bc", c="cde") == 5
    assert union_of(spark, "none", a="ab") == 0
    r = hll.registers(items(spark, dest=["x"], src=["y", "z"]), ["key"], "item")
    assert {x.key: x.estimate for x in hll.estimate(hll.merge_as(r, "key", "dest", ["src"]), ["key"]).collect()} == {"dest": 3, "src": 2}
    assert {x.key: x.estimate for x in hll.estimate(hll.merge_as(r, "key", "new", ["src", "dest"]), ["key"]).collect()} == {"dest": 1, "src": 2, "new": 3}


def test_hll_merge_laws(spark):
    a = hll.registers(items(spark, k=[f"item-{i}" for i in range(300)]), ["key"], "item")
    b = hll.registers(items(spark, k=[f"item-{i}" for i in range(200, 500)]), ["key"], "item")
    rows = lambda d: {(r.key, r.idx, r["rank"]) for r in d.select("key", "idx", "rank").collect()}
    assert rows(hll.merge(a, b)) == rows(hll.merge(b, a)) == rows(hll.merge(a, b, a))
    assert rows(hll.merge(a, a)) == rows(a)


@pytest.mark.parametrize("n,tolerance", [(100, 0.05), (10_000, 0.02), (100_000, 0.02)])
def test_hll_accuracy(spark, n, tolerance):
    df = spark.range(n).select(F.concat(F.lit("item-"), F.col("id")).alias("item"))
    assert abs(hll.estimate(hll.registers(df, [], "item"), []).first().estimate - n) <= tolerance * n


def test_hll_sigma_tau(spark):
    row = spark.range(1).select(hll.sigma(F.lit(0.0)).alias("s"), hll.tau(F.lit(0.5)).alias("t"), hll.tau(F.lit(1.0)).alias("one"), hll.tau(F.lit(0.0)).alias("zero")).first()
    assert row.s == 0 and row.one == 0 and row.zero == 0 and abs(row.t - 0.1499294958640881) < 1e-12


def test_hll_ignores_nulls_and_empty(spark):
    df = spark.createDataFrame([("a", None)], "key string, item string")
    assert hll.registers(df, ["key"], "item").count() == 0
    assert hll.estimate(hll.registers(df, [], "item"), []).first().estimate == 0


def test_seed0_hash(spark):
    import xxhash

    h = spark.createDataFrame([("apple",)], "x string").select(hashing.seed0(F.col("x")).alias("h")).first().h
    assert h % (1 << 64) == xxhash.xxh64_intdigest("apple")


def test_unsigned_mod(spark):
    cases = [0, 1, -1, -(1 << 63), (1 << 63) - 1, 12345678901234]
    got = spark.createDataFrame([(c,) for c in cases], "h bigint").select("h", hashing.unsigned_mod(F.col("h"), 1000).alias("m")).collect()
    assert all(r.m == r.h % (1 << 64) % 1000 for r in got)


def test_bloom_sizes():
    assert bloom.size_bytes(100, 0.01) == 128
    assert bloom.size_bytes(10_000, 0.01) == 12_032


@pytest.mark.parametrize("n,error,probes,factor", [(1000, 0.01, 20_000, 2), (500, 0.05, 20_000, 2), (10_000, 0.001, 50_000, 4)])
def test_bloom_rates(spark, n, error, probes, factor):
    config = bloom.Config(n, error)
    name = lambda p, k: spark.range(k).select(F.concat(F.lit(p), F.col("id")).alias("x"))
    f = bloom.build(name("item-", n), [], "x", config)
    assert bloom.probe(f, name("item-", n), [], "x", config).where("found = 0").count() == 0
    assert bloom.probe(f, name("notexist-", probes), [], "x", config).agg(F.sum("found")).first()[0] <= factor * error * probes


def test_bloom_grows(spark):
    config = bloom.Config(100, 0.01)
    df = spark.range(1000).select(F.concat(F.lit("e"), F.col("id")).alias("x"), F.col("id").alias("seq"))
    placed = bloom.assign_layers(df, [], "x", "seq", config, ranges=7)
    assert {(r.nth, r.first) for r in placed.collect()} == {(i + 1, i) for i in range(1000)}
    f = bloom.build_layered(df, [], "x", "seq", config, layers=5)
    assert bloom.probe(f, df, [], "x", config, layers=5).where("found = 0").count() == 0
    absent = spark.range(10_000).select(F.concat(F.lit("n"), F.col("id")).alias("x"))
    assert bloom.probe(f, absent, [], "x", config, layers=5).agg(F.sum("found")).first()[0] <= 600


def test_bloom_replies(spark):
    df = spark.createDataFrame([("k", "a", 1), ("k", "a", 2), ("k", "b", 3), ("j", "a", 4)], "key string, x string, seq int")
    prior = spark.createDataFrame([("j", "a")], "key string, x string")
    assert {r.seq: r.added for r in bloom.add_replies(df, ["key"], "x", "seq", prior).collect()} == {1: 1, 2: 0, 3: 1, 4: 0}
    empty = bloom.build(df.limit(0), ["key"], "x")
    assert bloom.probe(empty, df, ["key"], "x").agg(F.max("found")).first()[0] == 0


def test_bloom_semi_join_both_ways(spark):
    left = spark.range(1000).select(F.col("id").alias("k"))
    right = spark.range(0, 5000, 7).select(F.col("id").alias("k"))
    want = sorted(range(0, 1000, 7))
    assert sorted(r.k for r in bloom.semi_join(left, right, "k").collect()) == want
    assert sorted(r.k for r in bloom.semi_join(left, right, "k", broadcast_bytes=1).collect()) == want


def test_cms_config():
    assert [(c.width, c.depth) for c in (cms.Config.from_prob(*p) for p in ((0.01, 0.01), (0.001, 0.01), (0.001, 0.001)))] == [(272, 5), (2719, 5), (2719, 7)]
    for bad in (lambda: cms.Config(0, 1), lambda: cms.Config(1, 0), lambda: cms.Config.from_prob(1, 0.5), lambda: cms.Config.from_prob(0.5, 0)):
        with pytest.raises(ValueError):
            bad()


def test_cms_counts(spark):
    rows = [("apple", 5), ("banana", 10), ("cherry", 3), ("date", 7), (None, 9)]
    df = spark.createDataFrame(rows, "x string, n int")
    sketch = cms.build(df, [], "x", "n")
    got = {r.item: r.estimate for r in cms.query(sketch, spark.createDataFrame([("apple",), ("date",), ("none",)], "x string"), [], "x").collect()}
    assert got["apple"] >= 5 and got["date"] >= 7
    halves = cms.merge(cms.build(df.where("n > 5"), [], "x", "n"), cms.build(df.where("n <= 5"), [], "x", "n"))
    cells = lambda d: {(r.row, r.col, r.cnt) for r in d.select("row", "col", "cnt").collect()}
    assert cells(halves) == cells(sketch)


def test_cms_saturates(spark):
    df = spark.createDataFrame([("a", cms.MAX_CELL), ("a", 5)], "x string, n bigint")
    assert cms.build(df, [], "x", "n").agg(F.max("cnt")).first()[0] == cms.MAX_CELL


def test_cms_conservative(spark):
    rows = [("k", "heavy", 0, 10_000)] + [("k", f"light{i}", i + 1, 1) for i in range(1000)]
    df = spark.createDataFrame(rows, "key string, x string, seq int, n bigint")
    config = cms.Config(100, 4)
    cu = {r.item: r.estimate for r in cms.fold_conservative(df, "key", "x", "seq", "n", config).collect()}
    lin = {r.item: r.estimate for r in cms.query(cms.build(df, [], "x", "n", config), df, [], "x", config).collect()}
    assert cu["heavy"] >= 10_000 and all(cu[f"light{i}"] >= 1 for i in range(1000))
    assert sum(cu.values()) < sum(lin.values())


def test_topk(spark):
    rows = [("k", "b", 2), ("k", "a", 2), ("k", "c", 5), ("k", "z", 0), ("k", None, 9), ("j", "x", 1)]
    df = spark.createDataFrame(rows, "key string, x string, n int")
    got = [(r.key, r["rank"], r.item, r.cnt) for r in topk.build(df, ["key"], "x", 2, "n").orderBy("key", "rank").collect()]
    assert got == [("j", 1, "x", 1), ("k", 1, "c", 5), ("k", 2, "a", 2)]
    lists = topk.build(df, ["key"], "x", 2, "n")
    assert {(r.key, r.item): r.found for r in topk.contains(lists, df.where("x in ('a', 'b')"), ["key"], "x").collect()} == {("k", "a"): 1, ("k", "b"): 0}
    assert {r.key: [x["item"] for x in r["items"]] for r in topk.list_items(lists, ["key"], True).collect()} == {"k": ["c", "a"], "j": ["x"]}
    for bad in (dict(k=0), dict(decay=1.0)):
        with pytest.raises(ValueError):
            topk.Config(**bad)


def test_topk_evictions(spark):
    rows = [("k", i, x, n) for i, (x, n) in enumerate([("light", 1), ("heavy", 3), ("light", 1), ("light", 5), ("zero", 0)])]
    df = spark.createDataFrame(rows, "key string, seq bigint, x string, n bigint")
    got = {r.seq: r.expelled for r in topk.evictions(df, "key", "x", "seq", 1, "n").collect()}
    assert got == {0: None, 1: "light", 2: "light", 3: "heavy", 4: "zero"}


def test_heavy_keeper(spark):
    rows = [("k", i, "elephant") for i in range(1000)] + [("k", 1000 + i, f"mouse{i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "key string, seq bigint, x string")
    got = {r.item: r.cnt for r in topk.heavy_keeper(df, "key", "x", "seq", topk.Config(5, 2048, 3, 0.9)).collect()}
    assert 900 <= got["elephant"] <= 1000
