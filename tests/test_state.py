"""Counters, expiry, logs, store and streams."""

import pytest
from pyspark.sql import functions as F

from brindle.operators import counters, ttl
from brindle.sources import commandlog, store
from brindle.streaming import expiring, windows

STATE = "key string, type string, value string, expires_at_ms bigint"


def run(spark, ops):
    df = spark.createDataFrame([("k", i, *o) for i, o in enumerate(ops)], "key string, seq bigint, op string, value string, delta bigint")
    return [(r.result, r.error) for r in counters.running_value(df).orderBy("seq").collect()]


def test_counters(spark):
    assert run(spark, [("INCR", None, 1), ("DECR", None, -1), ("INCRBY", None, -7)]) == [(1, None), (0, None), (-7, None)]
    assert run(spark, [("SET", "10", None), ("INCRBY", None, 5), ("DEL", None, None), ("INCR", None, 1)]) == [(None, None), (15, None), (None, None), (1, None)]
    assert run(spark, [("SET", "text", None), ("INCR", None, 1)])[1] == (None, counters.NOT_INTEGER)
    top = str(counters.INT64_MAX)
    assert run(spark, [("SET", top, None), ("INCR", None, 1), ("DECR", None, -1)])[1:] == [(None, counters.OVERFLOW), (counters.INT64_MAX - 1, None)]
    low = str(counters.INT64_MIN)
    assert run(spark, [("SET", low, None), ("DECR", None, -1)])[1] == (None, counters.OVERFLOW)


def test_set_get(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y")], "key string, seq int, value string")
    got = counters.get(counters.set_last(df), spark.createDataFrame([("a",), ("b",)], "key string")).collect()
    assert {r.key: r.value for r in got} == {"a": "y", "b": None}


def state(spark):
    return spark.createDataFrame([("forever", "string", "1", None), ("later", "string", "2", 500), ("gone", "string", "3", 100)], STATE)


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "key string")


def test_ttl_codes(spark):
    got = ttl.remaining(state(spark), keys(spark, "forever", "later", "gone", "none"), 200).collect()
    assert {r.key: r.ttl for r in got} == {"forever": -1, "later": 300, "gone": -2, "none": -2}


def test_expire_modes(spark):
    asked = spark.createDataFrame([("forever", 50), ("later", 50), ("gone", 50), ("none", 50)], "key string, ms bigint")
    for mode, done in (("always", {"forever", "later"}), ("nx", {"forever"}), ("xx", {"later"})):
        new, replies = ttl.expire(state(spark), asked, 200, mode=mode)
        assert {r.key for r in replies.where("reply = 1").collect()} == done
        assert {r.key: r.expires_at_ms for r in new.collect() if r.key in done} == {k: 250 for k in done}
    new, replies = ttl.expire(state(spark), keys(spark, "later").withColumn("ms", F.lit(-1).cast("bigint")), 200)
    assert {r.key for r in new.collect()} == {"forever"} and replies.first().reply == 1
    new, replies = ttl.expire(state(spark), keys(spark, "later").withColumn("ms", F.lit(ttl.INT64_MAX)), 200)
    assert replies.first().error == ttl.INVALID and replies.first().reply is None
    new, replies = ttl.expire(state(spark), keys(spark, "forever").withColumn("ms", F.lit(150).cast("bigint")), 200, absolute=True)
    assert {r.key for r in new.collect()} == {"later"}


def test_persist_delete_exists_memory(spark):
    new, replies = ttl.persist(state(spark), keys(spark, "later", "forever", "gone"), 200)
    assert {r.key: r.reply for r in replies.collect()} == {"later": 1, "forever": 0, "gone": 0}
    assert new.where("expires_at_ms is not null").count() == 0
    left, n = ttl.delete(state(spark), keys(spark, "later", "later", "gone"), 200)
    assert n.first().deleted == 1 and {r.key for r in left.collect()} == {"forever"}
    assert {r.key for r in ttl.exists(state(spark), keys(spark, "gone", "later"), 200).collect()} == {"later"}
    assert spark.range(1).select(ttl.memory_usage(F.lit("mykey"), F.lit("DATAhello")).alias("n")).first().n == 86


def test_ttl_log(spark):
    rows = [("k", i, t, op, "v", a) for i, (t, op, a) in enumerate([(0, "TTL", 0), (0, "SET", 0), (1, "EXPIRE", 10), (2, "EXPIRENX", 50), (3, "TTL", 0), (3, "EXPIREXX", 20), (22, "GET", 0), (23, "GET", 0), (24, "SET", 0), (25, "TTL", 0), (26, "EXPIREAT", 26), (27, "GET", 0), (28, "EXPIRE", ttl.INT64_MAX)])]
    out = ttl.apply(spark.createDataFrame(rows, "key string, seq bigint, ts_ms bigint, op string, value string, arg_ms bigint")).orderBy("seq").collect()
    assert [r.reply for r in out] == [-2, 1, 1, 0, 8, 1, 1, 0, 1, -1, 1, 0, None]
    assert out[-1].error == ttl.INVALID


def test_command_log(spark, tmp_path):
    (tmp_path / "log.txt").write_text("1 10 set k v\n\n2 11 HLL.ADD h a b\n3 12 NOPE\n4 13 CMS.INCRBY c x 3 y\n5 14 CMS.INCRBY c x 3 y 4\n6 15 decrby k 5\n")
    log = commandlog.read_text(spark, str(tmp_path))
    got = {r.seq: (r.family, r.error) for r in commandlog.check(log).collect()}
    assert got[1] == ("counters", None) and got[2] == ("hll", None)
    assert got[3][1] == "ERR unknown command 'NOPE'" and got[4][1] == "ERR wrong number of arguments for 'CMS.INCRBY' command" and got[5] == ("cms", None)
    assert [(r.item, r.weight) for r in commandlog.weighted_items(log.where("seq = 5"), "CMS.INCRBY").orderBy("place").collect()] == [("x", 3), ("y", 4)]
    assert [r.item for r in commandlog.items(log, "HLL.ADD").orderBy("place").collect()] == ["a", "b"]
    assert [(r.op, r.value, r.delta) for r in commandlog.counter_ops(log).orderBy("seq").collect()] == [("SET", "v", None), ("DECRBY", None, -5)]
    commandlog.append(log, str(tmp_path / "out"))
    assert commandlog.read_parquet(spark, str(tmp_path / "out")).count() == 6
    assert len(commandlog.COMMANDS) == 35


def test_store(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.load(spark, path, 0).count() == 0
    store.save(state(spark), path)
    log = "key string, seq bigint, ts_ms bigint, op string, value string, arg_ms bigint"
    store.append(spark.createDataFrame([("new", 1, 0, "SET", "n", None), ("forever", 2, 0, "EXPIREAT", None, 900), ("later", 3, 0, "DEL", None, None)], log), path)
    store.append(spark.createDataFrame([("later", 1, 0, "SET", "again", None), ("forever", 2, 0, "PERSIST", None, None), ("new", 3, 0, "EXPIREAT", None, 300)], log), path)
    want = {("new", "n", 300), ("forever", "1", None), ("later", "again", None)}
    read = lambda: {(r.key, r.value, r.expires_at_ms) for r in store.load(spark, path, 200).collect()}
    assert read() == want
    assert store.compact(spark, path, 200) == 2 and store.batches(spark, path, "log") == [] and read() == want
    assert store.compact(spark, path, 200) == 2
    assert store.append(spark.createDataFrame([("new", 1, 0, "DEL", None, None)], log), path) == 3
    assert {k for k, *_ in read()} == {"forever", "later"}
    assert {r.type: (r.keys, r.live) for r in store.describe(state(spark), 200).collect()} == {"string": (3, 2)}
    assert store.needs_compaction(200 << 20, 90 << 20) and not store.needs_compaction(1 << 20, 0)


def test_store_replays_counters_and_expiry(spark, tmp_path):
    import pytest

    path, log = str(tmp_path / "store"), "key string, seq bigint, ts_ms bigint, op string, value string, arg_ms bigint"
    big = (1 << 53) + 1  # no double holds this
    store.save(spark.createDataFrame([("n", "string", "40", big), ("text", "string", "x", None), ("old", "string", "9", 100), ("h", "hll", "40", None), ("stays", "string", "s", None)], STATE), path)
    ops = [("n", "INCRBY", "2", None), ("new", "INCRBY", "5", None), ("new", "DECR", None, None), ("text", "INCR", None, None), ("old", "DECRBY", "3", None), ("h", "INCR", None, None), ("text", "EXPIRENX", None, 1000), ("text", "EXPIRENX", None, 5), ("new", "EXPIREXX", None, 5), ("n", "GET", None, None)]
    ops += [("top", "SET", str(counters.INT64_MAX), None), ("top", "INCR", None, None), ("top", "EXPIRE", None, 500), ("top", "EXPIREATXX", None, 900), ("dead", "SET", "d", None), ("dead", "EXPIRE", None, 0), ("bad", "INCRBY", "two", None), ("set", "SET", "1", None), ("set", "DEL", None, None), ("set", "INCR", None, None)]
    store.append(spark.createDataFrame([(k, i, 200, op, v, a) for i, (k, op, v, a) in enumerate(ops)], log), path)
    want = {("n", "42", big), ("new", "4", None), ("text", "x", 1200), ("old", "-3", None), ("h", "40", None), ("stays", "s", None), ("top", str(counters.INT64_MAX), 900), ("set", "1", None)}
    read = lambda: {(r.key, r.value, r.expires_at_ms) for r in store.load(spark, path, 300).collect()}
    assert read() == want
    store.compact(spark, path, 300)
    assert store.batches(spark, path, "log") == [] and read() == want
    store.append(spark.createDataFrame([("s", 1, 300, "HLL.ADD", "a", None)], log), path)
    with pytest.raises(ValueError, match="HLL.ADD"):
        store.compact(spark, path, 300)
    assert store.batches(spark, path, "log") == [2]


def test_expiring_stream(spark, tmp_path):
    schema = "key string, seq bigint, ts_ms bigint, op string, value string, arg_ms bigint"
    rows = [("k", 1, 0, "SET", "v", 0), ("k", 2, 1, "EXPIRE", None, 10), ("k", 3, 5, "TTL", None, 0), ("k", 4, 11, "GET", None, 0), ("j", 5, 0, "DEL", None, 0), ("j", 6, 0, "SET", "w", 0), ("j", 7, 1, "GET", None, 0)]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = expiring.expiring_state(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    windows.run_to_files(stream, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.seq: (r.reply, r.value) for r in spark.read.schema(expiring.REPLIES).parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (1, None), 2: (1, None), 3: (6, None), 4: (0, None), 5: (0, None), 6: (1, None), 7: (1, "w")}


def test_windows_drop_late_rows(spark, tmp_path):
    schema = "k string, ts timestamp, x bigint"
    source, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    add = lambda rows: spark.createDataFrame(rows, "k string, t string, x bigint").selectExpr("k", "cast(t as timestamp) ts", "x").coalesce(1).write.mode("append").parquet(source)
    go = lambda: windows.run_to_files(windows.windowed(spark.readStream.schema(schema).parquet(source), "ts", "1 hour", ["k"], [F.count("*").alias("n"), windows.hll("x"), windows.top_k("x", 2), windows.count_min("x")], delay="10 minutes"), out, check)
    add([("a", "2024-01-01 00:10:00", 1), ("a", "2024-01-01 03:00:00", 2)])
    go()
    add([("a", "2024-01-01 00:20:00", 3), ("a", "2024-01-01 06:00:00", 4)])
    go()
    got = {(r.start, r.n) for r in spark.read.parquet(out).select(F.col("start").cast("string"), "n").collect()}
    assert ("2024-01-01 00:00:00", 1) in got and ("2024-01-01 00:00:00", 2) not in got


def test_integer_without_line_feed(spark):
    ops = spark.createDataFrame([("a", 1, "SET", "5\n", None), ("a", 2, "INCRBY", None, 1), ("b", 1, "SET", "5", None), ("b", 2, "INCRBY", None, 1)], "key string, seq bigint, op string, value string, delta bigint")
    got = {(r.key, r.seq): (r.result, r.error) for r in counters.running_value(ops).collect()}
    assert got[("a", 2)] == (None, counters.NOT_INTEGER) and got[("b", 2)] == (6, None)


def test_one_request_for_a_key(spark):
    state = spark.createDataFrame([("a", "v", None)], "key string, value string, expires_at_ms bigint")
    asked = spark.createDataFrame([("a", 5), ("a", 7)], "key string, ms bigint")
    with pytest.raises(Exception, match="several requests for key a"):
        ttl.expire(state, asked, 0)[0].collect()
