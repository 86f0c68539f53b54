"""Each query of the library's own operators against its SQL, and those without SQL for what they must hold."""

import pytest

from brindle.plans import catalogue
from tests.oracle import assert_same


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    assert_same(catalogue.queries()[name](spark, sf_dir), catalogue.oracle_sql()[name], sf_dir)


def test_all_but_folds_have_sql():
    assert set(catalogue.queries()) - set(catalogue.oracle_sql()) == {"ttl_replies", "stream_sessions", "topk_eviction_log"}


def test_evictions_by_brute_force(spark, sf_dir):
    want, state = {}, {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/events.parquet").collect(), key=lambda r: r.event_id):
        counts, held = state.setdefault(r.event_type, ({}, set()))
        user = str(r.user_id)
        counts[user] = counts.get(user, 0) + 1
        rows, gone = want.get(r.event_type, (0, 0))
        least = min(held, key=lambda x: (counts[x], x), default=None)
        if user in held or len(held) < 5:
            held.add(user)
        else:
            gone += 1
            if counts[user] > counts[least]:
                held.remove(least)
                held.add(user)
        want[r.event_type] = rows + 1, gone
    got = {r.key: (r.rows, r.expelled) for r in catalogue.queries()["topk_eviction_log"](spark, sf_dir).collect()}
    assert got == want and any(gone for _, gone in want.values())


def test_sessions_agree_with_batch(spark, sf_dir):
    from pyspark.sql import functions as F

    got = {r.user_id: (r.sessions, r.longest) for r in catalogue.queries()["stream_sessions"](spark, sf_dir).collect()}
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    # Compared here: as a filter, the bound would be pushed below the merging of sessions.
    closed = str(events.agg((F.max("ts") - F.expr("INTERVAL 10 MINUTES")).cast("string")).first()[0])
    want: dict = {}
    for r in events.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).count().select("user_id", "count", F.col("w.end").cast("string").alias("end")).collect():
        if r.end <= closed:
            s, longest = want.get(r.user_id, (0, 0))
            want[r.user_id] = (s + 1, max(longest, r["count"]))
    assert got == want


def test_ttl_replies_of_every_key(spark, sf_dir, tmp_path):
    import datetime

    # The smallest table has only few users.
    spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("* EXCEPT (user_id)", "event_id * 7 % 60 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    sf_dir = str(tmp_path)

    kinds = ["SET", "EXPIRE", "EXPIRENX", "EXPIREXX", "TTL", "GET", "PERSIST", "TTL", "DEL"]
    epoch, ms = datetime.datetime(1970, 1, 1), datetime.timedelta(milliseconds=1)
    want, state = {}, {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/events.parquet").collect(), key=lambda r: r.event_id):
        key, now, op = str(r.user_id), (r.ts.replace(tzinfo=None) - epoch) // ms, kinds[r.event_id % 9]
        # state: the expiry of each key that is there, None for none
        if key in state and state[key] is not None and state[key] <= now:
            del state[key]
        there, has = key in state, state.get(key) is not None
        reply = int(there)
        if op == "SET":
            state[key], reply = None, 1
        elif op == "DEL":
            state.pop(key, None)
        elif op == "TTL":
            reply = -2 if not there else state[key] - now if has else -1
        elif op == "PERSIST":
            reply = int(has)
            if there:
                state[key] = None
        elif op.startswith("EXPIRE"):
            reply = int(there and {"EXPIRE": True, "EXPIRENX": not has, "EXPIREXX": has}[op])
            if reply and r.event_id % 13 == 0:
                del state[key]
            elif reply:
                state[key] = now + r.event_id % 13 * 86_400_000
        want[r.event_id] = (key, op, reply)
    got = catalogue.queries()["ttl_replies"](spark, sf_dir).collect()
    assert len(got) == len(want) and {r.seq: (r.key, r.op, r.reply) for r in got} == want
    assert len({r.key for r in got}) == 60


def test_layered_members_beyond_twelve_layers(spark, tmp_path, monkeypatch):
    from brindle.operators import bloom

    monkeypatch.setattr(catalogue, "_LAYERS", bloom.Config(capacity=1, error_rate=0.01))
    spark.range(9000).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in catalogue.queries()["bloom_layered_members"](spark, str(tmp_path)).collect()] == [(1, 9000)]
    assert [bloom.layers_for(n, bloom.Config(capacity=100)) for n in (0, 100, 101, 300, 301, 409_500, 409_501)] == [1, 1, 2, 2, 3, 12, 13]
    rows = spark.range(200).selectExpr("id AS k", "id AS o")
    with pytest.raises(Exception, match="more than 3 layers"):
        bloom.build_layered(rows, [], "k", "o", bloom.Config(capacity=10), layers=3).collect()


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 5
