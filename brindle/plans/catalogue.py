"""The queries over the driver's tables and the SQL that DuckDB runs beside them.

Sketch queries are compared value by value where SQL can compute the same hash, and otherwise by whether they keep
their bounds against exact figures. No query reads the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import hashing
from brindle.operators import bloom, cms, counters, hll, topk, ttl
from brindle.plans import workdir
from brindle.sources import commandlog, store
from brindle.streaming import expiring, windows

#: Fixed instants of the TTL queries, in milliseconds.
NOW, TTL_MS = 1_706_000_000_000, 10 * 86_400_000
_BLOOM = bloom.Config(capacity=20_000, error_rate=0.01)
_LAYERS = bloom.Config(capacity=100, error_rate=0.01)
_CMS = cms.Config(1000, 5)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ms(col: str):
    return F.unix_millis(F.col(col).cast("timestamp"))


# ---- distinct counting

def flagship(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("event_type", "user_id")
    exact = events.groupBy("event_type").agg(F.countDistinct("user_id").alias("exact_users"))
    return hll.estimate(hll.registers(events, ["event_type"], "user_id"), ["event_type"]).join(exact, "event_type")


def hll_registers(spark, sf_dir):
    return hll.registers(_t(spark, sf_dir, "events"), ["event_type"], "user_id")


def hll_count(spark, sf_dir):
    return hll.estimate(hll.registers(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_orderkey"), ["l_returnflag"])


def hll_changed(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    old = hll.registers(events.where("day < DATE'2024-01-03'"), ["event_type"], "user_id")
    new = hll.registers(events.where("day >= DATE'2024-01-03'"), ["event_type"], "user_id")
    return hll.changed(old, new)


def hll_union(spark, sf_dir):
    registers = hll.registers(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_orderkey")
    return hll.union_estimate(registers, "l_returnflag", ["A", "R", "no such key"])


def hll_merge_week(spark, sf_dir):
    events = _t(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    days = hll.registers(events, ["day"], "event_id")
    return hll.estimate(hll.rollup(days.withColumn("week", F.weekofyear("day")), ["week"]), ["week"])


def hll_merge_dest(spark, sf_dir):
    registers = hll.registers(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_partkey")
    return hll.estimate(hll.merge_as(registers, "l_returnflag", "A", ["N"]), ["l_returnflag"])


def hll_cube(spark, sf_dir):
    base = hll.registers(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_orderkey")
    name = lambda c: F.coalesce(F.col(c), F.lit("all")).alias(c)
    cubed = base.cube("l_returnflag", "l_linestatus", "idx").agg(F.max("rank").alias("rank")).where(F.col("idx").isNotNull())
    return hll.estimate(cubed.select(name("l_returnflag"), name("l_linestatus"), "idx", "rank"), ["l_returnflag", "l_linestatus"])


def hll_native(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    exact = lines.groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("exact"))
    found = hll.native_estimate(hll.native(lines, ["l_returnflag"], "l_orderkey"), ["l_returnflag"]).join(exact, "l_returnflag")
    return found.select("l_returnflag", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.03 * F.col("exact")).alias("within"))


def hll_ladder(spark, sf_dir):
    keys = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    steps = spark.createDataFrame([(100, 0.05), (1000, 0.03), (10000, 0.03)], "n bigint, tolerance double")
    rows = keys.join(F.broadcast(steps), F.col("k") <= F.col("n"))
    exact = rows.groupBy("n", "tolerance").agg(F.count("*").alias("exact"))
    found = hll.estimate(hll.registers(rows, ["n"], "k"), ["n"]).join(exact, "n")
    return found.select("n", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= F.col("tolerance") * F.col("exact")).alias("within"))


def distinct_exact(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


# ---- membership

def bloom_bits(spark, sf_dir):
    return bloom.build(_t(spark, sf_dir, "customer"), [], "c_custkey", _BLOOM)


def bloom_members(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer")
    return bloom.probe(bloom.build(customers, [], "c_custkey", _BLOOM), customers, [], "c_custkey", _BLOOM).groupBy("found").agg(F.count("*").alias("n"))


def bloom_fpr(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer")
    absent = customers.select((-F.col("c_custkey") - 1).alias("c_custkey"))
    config = bloom.Config(capacity=max(1, customers.count()), error_rate=0.01)
    found = bloom.probe(bloom.build(customers, [], "c_custkey", config), absent, [], "c_custkey", config)
    return found.agg(F.count("*").alias("probes"), (F.sum("found") <= 0.02 * F.count("*") + 5).alias("within"))


def bloom_layers(spark, sf_dir):
    placed = bloom.assign_layers(_t(spark, sf_dir, "orders"), [], "o_custkey", "o_orderkey", _LAYERS)
    return placed.groupBy("layer").agg(F.count("*").alias("n"), F.min("nth").alias("first_nth"), F.max("nth").alias("last_nth"))


def bloom_layered_members(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    n = orders.agg(F.countDistinct("o_custkey")).first()[0]
    layers = bloom.layers_for(n, _LAYERS)
    filters = bloom.build_layered(orders, [], "o_custkey", "o_orderkey", _LAYERS, layers=layers)
    return bloom.probe(filters, orders, [], "o_custkey", _LAYERS, layers=layers).groupBy("found").agg(F.count("*").alias("n"))


def bloom_replies(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return bloom.add_replies(docs, ["lang"], "source", "doc_id").select("doc_id", "added")


def bloom_semi(spark, sf_dir):
    big = _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return bloom.semi_join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), big, "o_orderkey").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


def bloom_anti(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    orders = _t(spark, sf_dir, "orders").select("o_orderkey")
    config = bloom.Config(capacity=max(1, lines.distinct().count()))
    sure = bloom.anti_candidates(bloom.build(lines, [], "o_orderkey", config), orders, "o_orderkey", config)
    wrong = sure.join(lines, "o_orderkey", "left_semi").agg(F.count("*").alias("wrong"))
    share = sure.agg(F.count("*").alias("sure")).join(orders.join(lines, "o_orderkey", "left_anti").agg(F.count("*").alias("exact")))
    return wrong.join(share).select("wrong", "exact", (F.col("sure") >= 0.9 * F.col("exact")).alias("most"))


# ---- frequency

def cms_cells(spark, sf_dir):
    return cms.build(_t(spark, sf_dir, "lineitem"), [], "l_partkey", None, _CMS)


def cms_query(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    return cms.query(cms.build(lines, [], "l_partkey", None, _CMS), lines, [], "l_partkey", _CMS)


def cms_weighted(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("bigint"))
    return cms.query(cms.build(lines, ["l_returnflag"], "l_suppkey", "q", _CMS), lines, ["l_returnflag"], "l_suppkey", _CMS)


def cms_merge(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    parts = [cms.build(lines.where(F.col("l_linenumber") % 2 == i), [], "l_partkey", None, _CMS) for i in (0, 1)]
    return cms.merge(*parts).groupBy("row").agg(F.sum("cnt").cast("bigint").alias("total"), F.max("cnt").alias("top"))


def cms_never_under(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    config = cms.Config.from_prob(0.001, 0.01)
    exact = lines.groupBy(F.col("l_partkey").alias("item")).agg(F.count("*").alias("exact"))
    found = cms.query(cms.build(lines, [], "l_partkey", None, config), lines, [], "l_partkey", config).join(exact, "item")
    total = lines.count()
    return found.agg(F.count("*").alias("items"), F.min(F.col("estimate") >= F.col("exact")).alias("never_under"), (F.sum((F.col("estimate") > F.col("exact") + 0.001 * total).cast("int")) <= 0.01 * F.count("*")).alias("within"))


def cms_dimensions(spark, sf_dir):
    cases = [(0.01, 0.01), (0.001, 0.01), (0.001, 0.001)]
    rows = [(e, d, cms.Config.from_prob(e, d).width, cms.Config.from_prob(e, d).depth) for e, d in cases]
    return spark.createDataFrame(rows, "epsilon double, delta double, width bigint, depth bigint")


def cms_conservative(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("event_type", "event_id", F.col("user_id").cast("string").alias("user"))
    config = cms.Config(64, 3)
    exact = events.groupBy(F.col("event_type").alias("key"), F.col("user").alias("item")).agg(F.count("*").alias("exact"))
    folded = cms.fold_conservative(events, "event_type", "user", "event_id", None, config)
    rows = folded.groupBy("key").agg(F.sum("estimate").alias("all"), F.max("total").alias("total"), F.count("*").alias("items"))
    under = folded.join(exact, ["key", "item"]).groupBy("key").agg(F.min(F.col("estimate") >= F.col("exact")).alias("never_under"))
    linear = cms.query(cms.build(events, ["event_type"], "user", None, config), events, ["event_type"], "user", config).groupBy(F.col("event_type").alias("key")).agg(F.sum("estimate").alias("linear"))
    return rows.join(under, "key").join(linear, "key").select("key", "items", "total", "never_under", (F.col("all") <= F.col("linear")).alias("not_above_linear"))


# ---- heavy hitters

def topk_list(spark, sf_dir):
    return topk.build(_t(spark, sf_dir, "lineitem"), [], "l_partkey", 20)


def topk_group(spark, sf_dir):
    return topk.build(_t(spark, sf_dir, "events"), ["event_type"], "user_id", 5)


def topk_weighted(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem").withColumn("cents", F.round(F.col("l_extendedprice") * 100).cast("bigint"))
    return topk.build(lines, ["l_returnflag"], "l_partkey", 10, "cents")


def topk_query(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    return topk.contains(topk.build(lines, [], "l_suppkey", 10), lines, [], "l_suppkey")


def topk_as_list(spark, sf_dir):
    lists = topk.build(_t(spark, sf_dir, "events"), ["event_type"], "user_id", 3)
    return topk.list_items(lists, ["event_type"]).select("event_type", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


def topk_native(spark, sf_dir):
    lines = _t(spark, sf_dir, "lineitem")
    exact = topk.build(lines, [], "l_returnflag", 2)
    return topk.native(lines, [], "l_returnflag", 2).join(exact.select("item", F.col("cnt").alias("exact")), "item").select("item", "cnt", "exact")


def topk_evictions(spark, sf_dir):
    events = _t(spark, sf_dir, "events").select("event_type", "event_id", F.col("user_id").cast("string").alias("user"))
    out = topk.evictions(events, "event_type", "user", "event_id", 5)
    return out.groupBy("key").agg(F.count("*").alias("rows"), F.count("expelled").alias("expelled"))


def topk_heavy_keeper(spark, sf_dir):
    parts = _t(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").cast("string").alias("item"))
    out = topk.heavy_keeper(parts, "l_returnflag", "item", "seq", topk.Config(k=20, width=64, depth=3))
    exact = parts.groupBy(F.col("l_returnflag").alias("key"), "item").agg(F.count("*").alias("exact"))
    return out.join(exact, ["key", "item"]).groupBy("key").agg(F.count("*").alias("items"), F.min(F.col("cnt") <= F.col("exact")).alias("never_over"))


# ---- counters, strings, expiry

def counter_incr(spark, sf_dir):
    ops = _t(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 1000 == 0, "DEL").otherwise("INCRBY").alias("op"), F.lit(None).cast("string").alias("value"), F.col("user_id").alias("delta"))
    return counters.running_value(ops).select("key", "seq", "op", "result", "error")


def counter_errors(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    op = F.when(F.col("event_id") % 10 == 0, "SET").otherwise("INCRBY")
    value = F.when(F.col("event_id") % 20 == 0, F.lit("9223372036854775800")).otherwise(F.lit("text"))
    ops = events.select(F.floor(F.col("event_id") / 40).cast("string").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.when(op == "SET", value).alias("value"), F.lit(3).cast("bigint").alias("delta"))
    return counters.running_value(ops).withColumn("result", F.col("result").cast("string"))


def counter_lww(spark, sf_dir):
    chats = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.col("text").alias("value"))
    state = counters.set_last(chats)
    asked = chats.select("key").unionByName(spark.range(1).select(F.lit(-5).cast("bigint").alias("key")))
    return counters.get(state, asked).select("key", F.md5("value").alias("value_md5"))


def _keys_with_expiry(spark, sf_dir):
    events = _t(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").cast("string").alias("key")).agg(F.max(F.struct("ts", "event_type")).alias("_m")).select("key", F.lit("string").alias("type"), F.col("_m.event_type").alias("value"), F.when(F.col("key").cast("bigint") % 5 != 0, _ms("_m.ts") + TTL_MS).alias("expires_at_ms"))


def ttl_live(spark, sf_dir):
    return ttl.live(_keys_with_expiry(spark, sf_dir), NOW + TTL_MS).select("key", "expires_at_ms")


def ttl_remaining(spark, sf_dir):
    asked = spark.range(0, 300).select(F.col("id").cast("string").alias("key"))
    return ttl.remaining(_keys_with_expiry(spark, sf_dir), asked, NOW + TTL_MS)


def _ttl_log(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    kind = F.element_at(F.array(*map(F.lit, ["SET", "EXPIRE", "EXPIRENX", "EXPIREXX", "TTL", "GET", "PERSIST", "TTL", "DEL"])), (F.col("event_id") % 9 + 1).cast("int"))
    return e.select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), _ms("ts").alias("ts_ms"), kind.alias("op"), F.lit("v").alias("value"), (F.col("event_id") % 13 * 86_400_000).alias("arg_ms"))


def ttl_replies(spark, sf_dir):
    return ttl.apply(_ttl_log(spark, sf_dir))


def ttl_nx_xx(spark, sf_dir):
    state = _keys_with_expiry(spark, sf_dir)
    asked = state.select("key", F.lit(5 * 86_400_000).cast("bigint").alias("ms"))
    out = [ttl.expire(state, asked, NOW, mode=m)[1].select(F.lit(m).alias("mode"), "key", "reply") for m in ("always", "nx", "xx")]
    return out[0].unionByName(out[1]).unionByName(out[2]).groupBy("mode").agg(F.count("*").alias("asked"), F.sum("reply").cast("bigint").alias("done"))


def ttl_persist(spark, sf_dir):
    state = _keys_with_expiry(spark, sf_dir)
    new, replies = ttl.persist(state, state.where("key < '5'"), NOW)
    return replies.groupBy("reply").agg(F.count("*").alias("n")).join(new.agg(F.count("expires_at_ms").alias("expiring")))


def del_count(spark, sf_dir):
    asked = spark.range(0, 2000).select((F.col("id") % 1000).cast("string").alias("key"))
    return ttl.delete(_keys_with_expiry(spark, sf_dir), asked, NOW + TTL_MS)[1]


def memory_usage(spark, sf_dir):
    return _t(spark, sf_dir, "documents").select("doc_id", ttl.memory_usage(F.col("doc_id").cast("string"), F.col("text")).alias("bytes"))


# ---- logs, store, streams

def command_log(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    cmd = F.element_at(F.array(*map(F.lit, ["HLL.ADD", "CMS.INCRBY", "SET", "EXPIRE", "NOPE", "GET"])), (F.col("event_id") % 6 + 1).cast("int"))
    log = e.select(F.col("event_id").alias("seq"), _ms("ts").alias("ts_ms"), cmd.alias("cmd"), F.col("event_type").alias("key"), F.when(F.col("event_id") % 4 == 0, F.array(F.col("user_id").cast("string"))).otherwise(F.array(F.col("user_id").cast("string"), F.lit("1"))).alias("args"))
    return commandlog.check(log).groupBy("cmd", F.coalesce("error", F.lit("")).alias("error")).agg(F.count("*").alias("n"))


def store_roundtrip(spark, sf_dir):
    path = workdir.fresh(spark, "store")
    state = _keys_with_expiry(spark, sf_dir)
    store.save(state, path)
    log = state.where("key < '3'").select("key", F.lit(1).cast("bigint").alias("seq"), F.lit(NOW).alias("ts_ms"), F.when(F.col("key") < "2", "SET").otherwise("DEL").alias("op"), F.lit("new").alias("value"), F.lit(None).cast("bigint").alias("arg_ms"))
    store.append(log, path)
    store.compact(spark, path, NOW)
    return store.load(spark, path, NOW).select("key", "value", "expires_at_ms")


def store_describe(spark, sf_dir):
    return store.describe(_keys_with_expiry(spark, sf_dir), NOW + TTL_MS)


def _event_stream(spark, sf_dir):
    source = _t(spark, sf_dir, "events")
    return spark.readStream.schema(source.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def stream_windows(spark, sf_dir):
    stream = windows.windowed(_event_stream(spark, sf_dir), "ts", "1 day", ["event_type"], [windows.hll("user_id"), F.count("*").alias("n")])
    out, state = workdir.fresh(spark, "stream"), workdir.fresh(spark, "stream-state")
    windows.run_to_files(stream, out, state)
    rows = spark.read.schema("event_type string, start timestamp, end timestamp, sketch binary, n bigint").parquet(out)
    found = rows.select("event_type", F.col("start").cast("timestamp_ntz").alias("day"), "n", F.hll_sketch_estimate("sketch").alias("estimate"))
    exact = _t(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count_distinct("user_id").alias("users"))
    # Windows that no later event closes stay open.
    return found.join(exact, ["event_type", "day"]).select("event_type", "day", "n", "users", (F.abs(F.col("estimate") - F.col("users")) <= 0.05 * F.col("users") + 1).alias("within"))


def stream_sessions(spark, sf_dir):
    stream = windows.windowed(_event_stream(spark, sf_dir), "ts", "", ["user_id"], [F.count("*").alias("n")], gap="6 hours")
    out, state = workdir.fresh(spark, "stream"), workdir.fresh(spark, "stream-state")
    windows.run_to_files(stream, out, state)
    rows = spark.read.schema("user_id bigint, start timestamp, end timestamp, n bigint").parquet(out)
    return rows.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


_QUERIES = {
    "hll_count_by_event_type": flagship, "hll_registers_by_event_type": hll_registers, "hll_count_by_flag": hll_count, "hll_add_changed_flag": hll_changed, "hll_union_count": hll_union, "hll_merge_week": hll_merge_week, "hll_merge_dest": hll_merge_dest, "hll_rollup_cube": hll_cube, "hll_native_within": hll_native, "hll_accuracy_ladder": hll_ladder, "distinct_exact": distinct_exact,
    "bloom_static_bits": bloom_bits, "bloom_exists_members": bloom_members, "bloom_fpr_bound": bloom_fpr, "bloom_layer_assignment": bloom_layers, "bloom_layered_members": bloom_layered_members, "bloom_madd_reply": bloom_replies, "bloom_prefilter_semi_join": bloom_semi, "bloom_anti_candidates": bloom_anti,
    "cms_cells": cms_cells, "cms_query_min": cms_query, "cms_weighted_incrby": cms_weighted, "cms_merge": cms_merge, "cms_never_under": cms_never_under, "cms_dimensions": cms_dimensions, "cms_conservative_between": cms_conservative,
    "topk_list_withcount": topk_list, "topk_by_group": topk_group, "topk_incrby_weighted": topk_weighted, "topk_query_membership": topk_query, "topk_list_items": topk_as_list, "topk_native_recall": topk_native, "topk_eviction_log": topk_evictions, "topk_heavy_keeper": topk_heavy_keeper,
    "counter_incr_by_key": counter_incr, "counter_errors": counter_errors, "counter_set_get_lww": counter_lww, "ttl_live_keys": ttl_live, "ttl_remaining": ttl_remaining, "ttl_replies": ttl_replies, "ttl_nx_xx": ttl_nx_xx, "ttl_persist": ttl_persist, "del_count": del_count, "memory_usage": memory_usage,
    "command_log_check": command_log, "store_snapshot_roundtrip": store_roundtrip, "store_describe": store_describe, "stream_windowed_hll": stream_windows, "stream_sessions": stream_sessions,
}


def queries() -> dict:
    return dict(_QUERIES)


# ---- oracle SQL

_H = hashing.bigint_hash_sql


def _registers_sql(source: str, keys: str, col: str) -> str:
    return f"""SELECT {keys}, idx, CAST(max(rank) AS INTEGER) AS rank FROM (
      SELECT {keys}, CAST(h % 16384 AS INTEGER) AS idx, bit_count((r & (-r)) - 1) + 1 AS rank
      FROM (SELECT {keys}, h, CAST(h // 16384 AS BIGINT) | {1 << 50} AS r FROM (SELECT {keys}, {_H(col)} AS h FROM {source}))) GROUP BY {keys}, idx"""


def _estimate_sql(registers: str, keys: str) -> str:
    """Ertl's estimate, by the same sums."""
    group, by = (f"{keys}, ", f"GROUP BY {keys}") if keys else ("", "")
    sigma = "(x + (SELECT sum(pow(x, pow(2::DOUBLE, i)) * pow(2::DOUBLE, i - 1)) FROM range(1, 61) t(i)))"
    tau = "(CASE WHEN y = 0 OR y = 1 THEN 0 ELSE (1 - y - (SELECT sum(pow(1 - pow(y, pow(2::DOUBLE, -i)), 2) * pow(2::DOUBLE, -i)) FROM range(1, 61) t(i))) / 3 END)"
    return f"""SELECT {group}CAST(round(0.7213475204444817::DOUBLE * 16384 * 16384 / (mid + 16384 * {sigma} + 16384 * {tau} * pow(2::DOUBLE, -50))) AS BIGINT) AS estimate FROM (
      SELECT {group}(16384 - count(*)) / 16384::DOUBLE AS x, 1 - count(*) FILTER (rank = 51) / 16384::DOUBLE AS y, coalesce(sum(pow(2::DOUBLE, -rank)) FILTER (rank <= 50), 0) AS mid FROM ({registers}) {by})"""


def _cells_sql(source: str, item: str, keys: str = "", weight: str = "1") -> str:
    k = f"{keys}, " if keys else ""
    return f"""SELECT {k}CAST(i AS INTEGER) AS row, CAST((CAST(a % 1000 AS BIGINT) + i * CAST(b % 1000 AS BIGINT)) % 1000 AS INTEGER) AS col, CAST(sum(n) AS BIGINT) AS cnt
      FROM (SELECT *, {_H("CAST(CASE WHEN a >= 9223372036854775808 THEN CAST(a AS HUGEINT) - 18446744073709551616 ELSE CAST(a AS HUGEINT) END AS BIGINT)")} AS b
            FROM (SELECT {k}{_H(item)} AS a, n FROM (SELECT {k}{item}, sum({weight}) AS n FROM {source} GROUP BY ALL))), range(0, 5) t(i) GROUP BY ALL"""


def _signed(h: str) -> str:
    return f"CAST(CASE WHEN {h} >= 9223372036854775808 THEN CAST({h} AS HUGEINT) - 18446744073709551616 ELSE CAST({h} AS HUGEINT) END AS BIGINT)"


def _bloom_sql(source: str, col: str, blocks: int) -> str:
    return f"""SELECT 0 AS layer, block, CAST(bit // 64 AS INTEGER) AS word, {_signed("bits")} AS bits FROM (
      SELECT block, bit // 64 * 64 AS bit, sum(v) AS bits FROM (
        SELECT DISTINCT CAST(h % {blocks} AS BIGINT) AS block, (s + i * t) % 512 AS bit, CAST(pow(2.0, (s + i * t) % 512 % 64) AS HUGEINT) AS v
        FROM (SELECT h, CAST(g % 512 AS BIGINT) AS s, CAST(g // 4294967296 % 512 AS BIGINT) | 1 AS t FROM (SELECT h, {_H(_signed("h"))} AS g FROM (SELECT {_H(col)} AS h FROM {source}))), range(0, 8) r(i))
      GROUP BY ALL)"""


_KEYS_SQL = f"""(SELECT CAST(user_id AS VARCHAR) AS key, arg_max(event_type, (ts, event_type)) AS value, CASE WHEN user_id % 5 <> 0 THEN epoch_ns(max(ts)) // 1000000 + {TTL_MS} END AS expires_at_ms FROM events GROUP BY user_id)"""
_TOP = "SELECT {k}CAST(row_number() OVER ({p}ORDER BY cnt DESC, item) AS INTEGER) AS rank, item, cnt FROM (SELECT {k}{c} AS item, CAST({w} AS BIGINT) AS cnt FROM {t} GROUP BY ALL) QUALIFY rank <= {n}"


def oracle_sql() -> dict[str, str]:
    li = _registers_sql("lineitem", "l_returnflag", "l_orderkey")
    cube = " UNION ALL ".join(f"SELECT {a} AS l_returnflag, {b} AS l_linestatus, idx, max(rank) AS rank FROM base GROUP BY ALL" for a in ("l_returnflag", "'all'") for b in ("l_linestatus", "'all'"))
    live = f"(expires_at_ms IS NULL OR expires_at_ms > {NOW + TTL_MS})"
    return {
        "hll_count_by_event_type": f"SELECT e.event_type, estimate, exact_users FROM ({_estimate_sql(_registers_sql('events', 'event_type', 'user_id'), 'event_type')}) e JOIN (SELECT event_type, count(DISTINCT user_id) AS exact_users FROM events GROUP BY event_type) x ON e.event_type = x.event_type",
        "hll_registers_by_event_type": _registers_sql("events", "event_type", "user_id"),
        "hll_count_by_flag": _estimate_sql(li, "l_returnflag"),
        "hll_add_changed_flag": f"WITH o AS ({_registers_sql('(SELECT * FROM events WHERE ts < DATE $$2024-01-03$$)', 'event_type', 'user_id')}), n AS ({_registers_sql('(SELECT * FROM events WHERE ts >= DATE $$2024-01-03$$)', 'event_type', 'user_id')}) SELECT n.event_type, CAST(max(CASE WHEN n.rank > coalesce(o.rank, 0) THEN 1 ELSE 0 END) AS INTEGER) AS changed FROM n LEFT JOIN o ON n.event_type = o.event_type AND n.idx = o.idx GROUP BY n.event_type",
        "hll_union_count": _estimate_sql(f"SELECT idx, max(rank) AS rank FROM ({li}) WHERE l_returnflag IN ('A', 'R') GROUP BY idx", ""),
        "hll_merge_week": _estimate_sql(_registers_sql("(SELECT CAST(weekofyear(ts) AS INTEGER) AS week, event_id FROM events)", "week", "event_id"), "week"),
        "hll_merge_dest": _estimate_sql(_registers_sql("(SELECT l_returnflag, l_partkey FROM lineitem UNION ALL SELECT 'A', l_partkey FROM lineitem WHERE l_returnflag = 'N')", "l_returnflag", "l_partkey"), "l_returnflag"),
        "hll_rollup_cube": f"WITH base AS ({_registers_sql('lineitem', 'l_returnflag, l_linestatus', 'l_orderkey')}) {_estimate_sql(cube, 'l_returnflag, l_linestatus')}",
        "hll_native_within": "SELECT l_returnflag, count(DISTINCT l_orderkey) AS exact, true AS within FROM lineitem GROUP BY l_returnflag",
        "hll_accuracy_ladder": "SELECT n, count(*) AS exact, true AS within FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) JOIN (SELECT unnest([100, 1000, 10000])::BIGINT AS n) ON k <= n GROUP BY n",
        "distinct_exact": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
        "bloom_static_bits": _bloom_sql("customer", "c_custkey", _BLOOM.blocks()),
        "bloom_exists_members": "SELECT CAST(1 AS INTEGER) AS found, count(DISTINCT c_custkey) AS n FROM customer",
        "bloom_fpr_bound": "SELECT count(DISTINCT c_custkey) AS probes, true AS within FROM customer",
        "bloom_layer_assignment": "SELECT CAST(floor(log2((nth - 1) / 100.0 + 1)) AS INTEGER) AS layer, count(*) AS n, min(nth) AS first_nth, max(nth) AS last_nth FROM (SELECT row_number() OVER (ORDER BY f, o_custkey) AS nth FROM (SELECT o_custkey, min(o_orderkey) AS f FROM orders GROUP BY o_custkey)) GROUP BY 1",
        "bloom_layered_members": "SELECT CAST(1 AS INTEGER) AS found, count(DISTINCT o_custkey) AS n FROM orders",
        "bloom_madd_reply": "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) = 1 THEN 1 ELSE 0 END AS added FROM documents",
        "bloom_prefilter_semi_join": "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) GROUP BY o_orderstatus",
        "bloom_anti_candidates": "SELECT CAST(0 AS BIGINT) AS wrong, count(*) AS exact, true AS most FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)",
        "cms_cells": _cells_sql("lineitem", "l_partkey"),
        "cms_query_min": f"WITH c AS ({_cells_sql('lineitem', 'l_partkey')}), p AS (SELECT l_partkey AS item, row, col FROM ({_cells_sql('(SELECT DISTINCT l_partkey, l_partkey AS it FROM lineitem)', 'l_partkey', 'it')}) s(l_partkey, row, col, cnt)) SELECT item, min(cnt) AS estimate FROM p JOIN c USING (row, col) GROUP BY item",
        "cms_weighted_incrby": f"WITH c AS ({_cells_sql('lineitem', 'l_suppkey', 'l_returnflag', 'CAST(trunc(l_quantity) AS BIGINT)')}), p AS (SELECT l_returnflag, it AS l_suppkey, row, col FROM ({_cells_sql('(SELECT DISTINCT l_suppkey, l_returnflag, l_suppkey AS it FROM lineitem)', 'l_suppkey', 'l_returnflag, it')})) SELECT p.l_returnflag, p.l_suppkey AS item, min(cnt) AS estimate FROM p JOIN c ON p.l_returnflag = c.l_returnflag AND p.row = c.row AND p.col = c.col GROUP BY ALL",
        "cms_merge": f"SELECT row, CAST(sum(cnt) AS BIGINT) AS total, max(cnt) AS top FROM ({_cells_sql('lineitem', 'l_partkey')}) GROUP BY row",
        "cms_never_under": "SELECT count(DISTINCT l_partkey) AS items, true AS never_under, true AS within FROM lineitem",
        "cms_dimensions": "SELECT e AS epsilon, d AS delta, CAST(ceil(exp(1.0) / e) AS BIGINT) AS width, CAST(ceil(ln(1 / d)) AS BIGINT) AS depth FROM (VALUES (0.01::DOUBLE, 0.01::DOUBLE), (0.001, 0.01), (0.001, 0.001)) t(e, d)",
        "cms_conservative_between": "SELECT event_type AS key, count(DISTINCT user_id) AS items, count(*) AS total, true AS never_under, true AS not_above_linear FROM events GROUP BY event_type",
        "topk_list_withcount": _TOP.format(k="", p="", c="l_partkey", w="count(*)", t="lineitem", n=20),
        "topk_by_group": _TOP.format(k="event_type, ", p="PARTITION BY event_type ", c="user_id", w="count(*)", t="events", n=5),
        "topk_incrby_weighted": _TOP.format(k="l_returnflag, ", p="PARTITION BY l_returnflag ", c="l_partkey", w="sum(CAST(round(l_extendedprice * 100) AS BIGINT))", t="lineitem", n=10),
        "topk_query_membership": "SELECT item, CASE WHEN row_number() OVER (ORDER BY cnt DESC, item) <= 10 THEN 1 ELSE 0 END AS found FROM (SELECT l_suppkey AS item, count(*) AS cnt FROM lineitem GROUP BY 1)",
        "topk_list_items": "SELECT event_type, string_agg(CAST(item AS VARCHAR), ',' ORDER BY rank) AS items FROM (" + _TOP.format(k="event_type, ", p="PARTITION BY event_type ", c="user_id", w="count(*)", t="events", n=3) + ") GROUP BY event_type",
        "topk_native_recall": "SELECT l_returnflag AS item, count(*) AS cnt, count(*) AS exact FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2",
        "topk_heavy_keeper": "SELECT l_returnflag AS key, least(count(DISTINCT l_partkey), 20) AS items, true AS never_over FROM lineitem GROUP BY ALL",
        "counter_incr_by_key": "SELECT event_type AS key, event_id AS seq, op, CASE WHEN op <> 'DEL' THEN CAST(sum(CASE WHEN op = 'DEL' THEN 0 ELSE user_id END) OVER (PARTITION BY event_type, seg ORDER BY event_id) AS BIGINT) END AS result, CAST(NULL AS VARCHAR) AS error FROM (SELECT *, sum(CASE WHEN op = 'DEL' THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY event_id) AS seg FROM (SELECT *, CASE WHEN event_id % 1000 = 0 THEN 'DEL' ELSE 'INCRBY' END AS op FROM events))",
        "counter_errors": f"SELECT CAST(event_id // 40 AS VARCHAR) AS key, event_id AS seq, CASE WHEN event_id % 10 = 0 THEN 'SET' ELSE 'INCRBY' END AS op, CASE WHEN event_id // 10 % 2 = 0 AND event_id % 10 BETWEEN 1 AND 2 THEN CAST(9223372036854775800 + 3 * (event_id % 10) AS VARCHAR) END AS result, CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id // 10 % 2 = 1 THEN '{counters.NOT_INTEGER}' WHEN event_id % 10 > 2 THEN '{counters.OVERFLOW}' END AS error FROM events",
        "counter_set_get_lww": "SELECT conv_id AS key, md5(arg_max(text, turn)) AS value_md5 FROM conversations GROUP BY conv_id UNION ALL SELECT -5, NULL",
        "ttl_live_keys": f"SELECT key, expires_at_ms FROM {_KEYS_SQL} WHERE {live}",
        "ttl_remaining": f"SELECT CAST(i AS VARCHAR) AS key, CAST(CASE WHEN k.key IS NULL THEN -2 WHEN expires_at_ms IS NULL THEN -1 ELSE expires_at_ms - {NOW + TTL_MS} END AS BIGINT) AS ttl FROM range(0, 300) t(i) LEFT JOIN (SELECT * FROM {_KEYS_SQL} WHERE {live}) k ON k.key = CAST(i AS VARCHAR)",
        "ttl_nx_xx": f"SELECT mode, count(*) AS asked, CAST(sum(CASE WHEN NOT there THEN 0 WHEN mode = 'nx' THEN CASE WHEN e IS NULL THEN 1 ELSE 0 END WHEN mode = 'xx' THEN CASE WHEN e IS NULL THEN 0 ELSE 1 END ELSE 1 END) AS BIGINT) AS done FROM (SELECT expires_at_ms AS e, (expires_at_ms IS NULL OR expires_at_ms > {NOW}) AS there FROM {_KEYS_SQL}), (SELECT unnest(['always', 'nx', 'xx']) AS mode) GROUP BY mode",
        "ttl_persist": f"WITH k AS (SELECT * FROM {_KEYS_SQL} WHERE expires_at_ms IS NULL OR expires_at_ms > {NOW}), a AS (SELECT CASE WHEN k.expires_at_ms IS NULL THEN 0 ELSE 1 END AS reply FROM {_KEYS_SQL} s LEFT JOIN k ON s.key = k.key WHERE s.key < '5') SELECT reply, count(*) AS n, (SELECT count(expires_at_ms) FROM k WHERE key >= '5') AS expiring FROM a GROUP BY reply",
        "del_count": f"SELECT count(*) AS deleted FROM {_KEYS_SQL} WHERE {live} AND CAST(key AS BIGINT) < 1000",
        "memory_usage": "SELECT doc_id, CAST(strlen(CAST(doc_id AS VARCHAR)) + strlen(text) + 72 AS BIGINT) AS bytes FROM documents",
        "command_log_check": "SELECT cmd, CASE cmd WHEN 'NOPE' THEN 'ERR unknown command ''NOPE''' WHEN 'CMS.INCRBY' THEN CASE WHEN n <> 3 THEN 'ERR wrong number of arguments for ''CMS.INCRBY'' command' ELSE '' END WHEN 'GET' THEN 'ERR wrong number of arguments for ''GET'' command' WHEN 'HLL.ADD' THEN '' ELSE CASE WHEN n <> 2 THEN 'ERR wrong number of arguments for ''' || cmd || ''' command' ELSE '' END END AS error, count(*) AS n FROM (SELECT ['HLL.ADD', 'CMS.INCRBY', 'SET', 'EXPIRE', 'NOPE', 'GET'][CAST(event_id % 6 + 1 AS BIGINT)] AS cmd, CASE WHEN event_id % 4 = 0 THEN 2 ELSE 3 END AS n FROM events) GROUP BY ALL",
        "store_snapshot_roundtrip": f"SELECT key, CASE WHEN key < '2' THEN 'new' ELSE value END AS value, CASE WHEN key >= '2' THEN expires_at_ms END AS expires_at_ms FROM {_KEYS_SQL} WHERE key < '2' OR (key >= '3' AND (expires_at_ms IS NULL OR expires_at_ms > {NOW}))",
        "store_describe": f"SELECT 'string' AS type, count(*) AS keys, count(*) FILTER ({live}) AS live, count(expires_at_ms) AS expiring, CAST(sum(strlen(key) + strlen(value) + 72) AS BIGINT) AS bytes FROM {_KEYS_SQL}",
        "stream_windowed_hll": "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, count(DISTINCT user_id) AS users, true AS within FROM events GROUP BY ALL HAVING date_trunc('day', min(ts)) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE",
    }
