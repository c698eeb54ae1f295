"""The monitor over several batches: late, repeated and crashed ones end in the batch answer."""

import datetime
import json
import random

import pytest
from pyspark.sql import functions as F

from riverlens.streaming import monitor

SCHEMA = "event_id long, pixel long, day date, wet boolean"
DAY = datetime.date(2024, 3, 1)


@pytest.fixture
def world(spark, tmp_path):
    static = spark.range(64).select(F.col("id").alias("pixel"), F.expr("id div 8").alias("row"), F.expr("id % 8").alias("col"), F.expr("id % 3").alias("zone"), F.lit(False).alias("perm"), F.lit(10_000.0).alias("m2"))
    texts = spark.createDataFrame([("en", "{zone}: {km2}")], "lang string, template string")
    r = random.Random(1)
    events = [(i, r.randrange(64), DAY + datetime.timedelta(days=r.randrange(28)), r.random() < 0.5) for i in range(600)]
    return static, texts, events, f"file://{tmp_path}"


def arrive(spark, events, base):
    spark.createDataFrame(events, SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/in")


def go(spark, world):
    static, texts, _, base = world
    monitor.run_batches(spark.readStream.schema(SCHEMA).parquet(f"{base}/in"), static, texts, f"{base}/out", 0.0)


def answer(spark, world):
    """Snapshot and look-backs of all events at once."""
    static, texts, events, _ = world
    df = spark.createDataFrame(events, SCHEMA)
    last = max(e[2] for e in events)
    recent = df.where(F.col("day") > F.lit(last - datetime.timedelta(days=10)))
    snapshot = json.loads(monitor.run_monitor(recent.drop("event_id"), static, texts, 0.0).first().value)
    back = {}
    for _, _, day, wet in events:
        for k in range(10):
            n = back.setdefault(day - datetime.timedelta(days=k), [0, 0])
            n[0], n[1] = n[0] + 1, n[1] + wet
    return snapshot, back


def state(spark, base):
    snapshot = json.loads(monitor.last_snapshot(spark, f"{base}/out").first().value)
    rows = spark.read.schema("n long, wet long, start date").parquet(f"{base}/out/lookback").collect()
    assert len({r.start for r in rows}) == len(rows)
    return snapshot, {r.start: [r.n, r.wet] for r in rows}


def parts(events):
    late = [e for e in events if e[2].day in (5, 6, 7) and e[0] % 2]
    first = [e for e in events if e[2].day <= 9 and e not in late]
    second = [e for e in events if 9 < e[2].day <= 16]
    return [first, second + late, first[::3] + [e for e in events if 16 < e[2].day <= 21], [e for e in events if e[2].day > 21]]


def test_four_drops(spark, world):
    for drop in parts(world[2]):
        arrive(spark, drop, world[3])
        go(spark, world)
    assert state(spark, world[3]) == answer(spark, world)
    go(spark, world)  # nothing new
    assert state(spark, world[3]) == answer(spark, world)


def test_arrivals_hold_an_event_once(spark, world):
    """What repeats is left out when it comes, so snapshots and look-backs compare no ids; look-backs
    need no static layers."""
    _, _, events, base = world
    for drop in parts(events):
        arrive(spark, drop + drop[:7], base)
        monitor.run_batches(spark.readStream.schema(SCHEMA).parquet(f"{base}/in"), None, None, f"{base}/out")
    kept = monitor.arrivals(spark, f"{base}/out")
    assert sorted(r.event_id for r in kept.select("event_id").collect()) == [e[0] for e in events]
    rows = spark.read.schema("n long, wet long, start date").parquet(f"{base}/out/lookback").collect()
    assert {r.start: [r.n, r.wet] for r in rows} == answer(spark, world)[1]


@pytest.mark.parametrize("where", ["publish", "lookback"])
def test_crash_between_write_and_commit(spark, world, monkeypatch, where):
    """The third batch fails after it has written, and is run again from the checkpoint."""
    step, crashed = monitor.monitor_step, []

    def failing(batch, number, static, *args):
        if number == 2 and not crashed:
            crashed.append(number)
            if where == "publish":
                with monkeypatch.context() as m:
                    m.setattr(monitor, "run_monitor", lambda *a: 1 / 0)
                    step(batch, number, static, *args)
            step(batch, number, static, *args)
            raise RuntimeError("lost after the write")
        step(batch, number, static, *args)

    monkeypatch.setattr(monitor, "monitor_step", failing)
    for drop in parts(world[2]):
        arrive(spark, drop, world[3])
        try:
            go(spark, world)
        except Exception:
            go(spark, world)
    assert crashed == [2]
    assert state(spark, world[3]) == answer(spark, world)
    ids = spark.read.parquet(f"{world[3]}/out/arrivals")
    assert {r.batch for r in ids.select("batch").distinct().collect()} == {0, 1, 2, 3}


def test_nine_scenes_leave_the_last_day(spark):
    """Beyond eight scenes only the last of three days is taken up."""
    rows = [(datetime.datetime(2026, 7, d, 1, k),) for d in (10, 15, 20) for k in range(3)]
    plan = monitor.plan_passes(spark.createDataFrame(rows, "ts timestamp")).orderBy("day").collect()
    assert [(r.day.day, r.n, r.skipped) for r in plan] == [(10, 3, True), (15, 3, True), (20, 3, False)]
    assert not any(r.skipped for r in monitor.plan_passes(spark.createDataFrame(rows[:8], "ts timestamp")).collect())
    assert monitor.plan_passes(spark.createDataFrame([], "ts timestamp")).count() == 0
