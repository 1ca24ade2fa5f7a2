"""Limiter and cache against step-by-step replays; streams against batch."""

import random
from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumbline.functions import pricing as P
from plumbline.operators import metering as op
from plumbline.operators.ordered import assign_windows, running_total, window_cover
from plumbline.streaming import metering as stream

S = 1_000_000


class Limiter:
    def __init__(self, limit, window):
        self.limit, self.window, self.state = limit, window, {}

    def hit(self, key, now):
        count, reset = self.state.get(key, (0, now + self.window))
        if reset <= now:
            self.state[key] = (1, now + self.window)
            return True
        if count >= self.limit:
            return False
        self.state[key] = (count + 1, reset)
        return True


def trace(seed, n=250, keys=3, span=2000):
    rnd = random.Random(seed)
    # one key holds most of the rows, and equal times occur
    return [(str(min(rnd.randrange(keys * 3), keys - 1)), i, rnd.randrange(span) * S // 2, rnd.choice([0.5, 1.0, 2.0])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "key string, event_id bigint, at_us bigint, cost double")


def test_limiter_matches_replay(spark):
    for seed, limit, window in ((1, 2, 30), (2, 5, 200)):
        rows = trace(seed)
        ref = Limiter(limit, window * S)
        want = {e: ref.hit(k, t) for k, e, t, _ in sorted(rows, key=lambda r: (r[2], r[1]))}
        got = {r.event_id: r.allowed for r in op.rate_limit(frame(spark, rows).drop("cost"), limit, window).collect()}
        assert got == want


def test_windows_are_copied_to_two_slots_and_shuffled(spark):
    starts = spark.createDataFrame([("a", 0), ("a", 100), ("b", 37), ("b", -63)], "key string, start bigint")
    cover = window_cover(starts, 100)
    assert sorted(tuple(r) for r in cover.collect()) == sorted(
        (k, s, s // 100 + i) for k, s in (("a", 0), ("a", 100), ("b", 37), ("b", -63)) for i in (0, 1))
    requests = spark.createDataFrame([("a", 1, 99), ("b", 2, -63), ("b", 3, 36), ("b", 4, 37)], "key string, event_id long, at long")
    rows = assign_windows(requests, 100)
    assert "strategy=merge" in rows._jdf.queryExecution().optimizedPlan().toString()  # copies are not broadcast by file size
    assert {r.event_id: (r.start, r.position) for r in rows.collect()} == {1: (99, 1), 2: (-63, 1), 3: (-63, 2), 4: (37, 1)}


def test_cache_accounting(spark):
    rows = trace(5, n=150)
    open_until, want = {}, {}
    for key, event, at, _ in sorted(rows, key=lambda r: (r[2], r[1])):
        want[event] = open_until.get(key, -1) <= at
        if want[event]:
            open_until[key] = at + 100 * S
    got = {r.event_id: r.billed for r in op.cache_accounting(frame(spark, rows).drop("cost"), 100).collect()}
    assert got == want


def test_running_total_crosses_cells(spark):
    rows = trace(7)
    total, want = defaultdict(float), {}
    for key, event, at, cost in sorted(rows, key=lambda r: (r[2], r[1])):
        total[key] += cost
        want[event] = total[key]
    got = {r.event_id: r.running for r in running_total(frame(spark, rows), ["key"], "at_us", "event_id", F.col("cost"), 7 * S).collect()}
    assert got == want


def test_token_cost_and_unknown_model(spark):
    row = spark.range(1).select(
        P.token_cost(F.lit("claude-haiku-4-5"), F.lit(10**6), F.lit(10**6), F.lit(10**6), F.lit(10**6)).alias("a"),
        P.token_cost(F.lit("other"), F.lit(5), F.lit(5)).alias("b")).first()
    assert abs(row.a - 7.35) < 1e-9 and row.b == 0


def test_stream_limiter_equals_batch(spark, tmp_path):
    rows = trace(9, n=200)
    src = frame(spark, rows).select("key", "event_id", F.timestamp_micros("at_us").alias("at"))
    cut = sorted(r[2] for r in rows)[100]
    for i, cond in enumerate((F.unix_micros("at") <= cut, F.unix_micros("at") > cut)):  # two files in time order
        src.where(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(stream.REQUEST_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r.event_id: r.allowed for r in stream.run_to_files(stream.limiter_stream(live, 2, 60)).collect()}
    want = {r.event_id: r.allowed for r in op.rate_limit(frame(spark, rows).drop("cost"), 2, 60).collect()}
    assert got == want


def test_cached_call_is_not_billed_twice(spark, tmp_path):
    src = spark.range(6).select((F.col("id") % 2).cast("string").alias("cache_key"), F.timestamp_seconds(F.col("id")).alias("at"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema("cache_key string, at timestamp").parquet(str(tmp_path / "in"))
    assert stream.run_to_files(stream.first_seen_stream(live)).count() == 2


def test_budget_alert_levels(spark):
    df = spark.createDataFrame([("d1", 5.0), ("d1", 12.0), ("d2", 20.0), ("d3", 1.0)], "day string, cost double")
    assert {(r.day, r.level) for r in stream.budget_alerts(df).collect()} == {("d1", "warn"), ("d2", "stop")}


def _live(spark, folder, schema, batches):
    """A stream that takes one of the given batches after the other."""
    import os
    import time

    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        for name in os.listdir(folder):  # the source takes files by age
            if name.startswith("part-") and not os.path.exists(f"{folder}/.seen-{name}"):
                os.utime(f"{folder}/{name}", (time.time() - 1000 + i, time.time() - 1000 + i))
                open(f"{folder}/.seen-{name}", "w").close()
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def _drain(df, folder):
    (df.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log")
     .trigger(availableNow=True).start().awaitTermination())
    left = df.sparkSession.read.format("statestore").option("path", f"{folder}/log").option("stateVarName", "entry").load().count()
    return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/out").collect(), left


def test_limiter_state_goes_after_an_idle_window(spark, tmp_path):
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    batches = [[("a", 1, t(0)), ("a", 2, t(1)), ("b", 3, t(2)), ("a", 4, t(3))], [("a", 5, t(61))], [("z", 6, t(600))], [("z", 7, t(1200))], [("z", 8, t(1200))]]
    live = _live(spark, tmp_path / "in", stream.REQUEST_SCHEMA, batches)
    got, left = _drain(stream.limiter_stream(live, 2, 3600, "1 minute"), tmp_path)
    assert {r.event_id: r.allowed for r in got} == {1: True, 2: True, 3: True, 4: False, 5: True, 6: True, 7: True, 8: True}
    assert left == 1  # z alone: a's second window and b's ended long before


def test_cache_state_goes_with_its_last_response(spark, tmp_path):
    t = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    put = lambda k, i, m, ttl: (k, i, t(m), False, f"r{i}", ttl * 60)
    get = lambda k, i, m: (k, i, t(m), True, None, 0)
    batches = [[get("a", 1, 0), put("a", 2, 0, 10), get("a", 3, 5), put("b", 4, 1, 30)], [get("a", 5, 9), put("a", 6, 9, 100), get("a", 7, 12), get("b", 8, 31)],
               [get("a", 9, 108), get("a", 10, 109)], [put("z", 11, 5000, 10)], [get("z", 12, 5001)], [get("z", 13, 5001)]]
    live = _live(spark, tmp_path / "in", stream.CACHE_EVENT_SCHEMA, batches)
    got, left = _drain(stream.cache_lookup_stream(live, "1 minute"), tmp_path)
    assert {r.event_id: r.response for r in got} == {1: "r2", 3: "r2", 5: "r6", 7: "r6", 8: None, 9: "r6", 10: None, 12: "r11", 13: "r11"}
    assert all(r.hit == (r.response is not None) for r in got)
    assert left == 1
