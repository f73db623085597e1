from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from weftmark.functions import ordering
from weftmark.functions.ordering import previous_value, sequence_numbers
from weftmark.operators import runlog

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)
SCHEMA = (
    "event_id bigint, run_id bigint, ts timestamp, agent string, step string, type string, status string, "
    "tokens_in bigint, tokens_out bigint, cost_usd decimal(18,6), duration_s decimal(18,4)"
)


def event(i, run=1, at=0.0, agent="a", step="", kind="tool_call", status="ok", tin=10, tout=20, cost="0.5", dur="30"):
    return (i, run, T0 + dt.timedelta(seconds=at), agent, step, kind, status, tin, tout, Decimal(cost), Decimal(dur))


def log(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_run_summary_arithmetic(spark):
    rows = [
        event(1, step="profile"), event(2, step="profile"), event(3, step="sql"), event(4, step="unknown"),
        event(5, step="etl", kind="tool_result"), event(6, step="", kind="tool_call", dur="0"),
    ]
    row = runlog.run_summary(log(spark, rows)).first()
    assert row.steps_done == "profile,sql,unknown"
    assert (row.tool_calls, row.tokens_in, row.tokens_out) == (5, 60, 120)
    assert row.total_cost_usd == 3.0 and row.agent_minutes == 2.5 and row.human_hours == 3.0
    assert row.speedup_x == 72.0


def test_run_without_time_has_no_speedup(spark):
    assert runlog.run_summary(log(spark, [event(1, step="etl", dur="0")])).first().speedup_x == 0


def test_token_cost(spark):
    df = spark.createDataFrame([(1_000_000, 1_000_000)], "i bigint, o bigint")
    assert df.select(runlog.token_cost(F.col("i"), F.col("o")).alias("c")).first().c == Decimal("30.000000")


def test_agent_rollup_and_totals(spark):
    rows = [event(1, agent="x"), event(2, agent="x", status="error"), event(3, agent="y", dur="90")]
    got = {r.agent: r for r in runlog.agent_rollup(log(spark, rows)).collect()}
    assert got["x"].success_rate == 50 and got["y"].avg_duration_s == 90 and got["ALL"].runs == 3
    assert got["ALL"].total_tokens == 90


def hot_log(spark, n=3000):
    """One run holds nearly everything; many events share a second, some a timestamp."""
    rng = random.Random(5)
    rows = [
        event(i, run=1 if rng.random() < 0.9 else rng.randint(2, 5), at=rng.choice([0, 0.25, 1, 59, 3600, 3601, 90000]) + rng.randint(0, 40) * 0.5)
        for i in range(n)
    ]
    return rows, log(spark, rows)


def by_run(rows):
    runs = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        runs.setdefault(r[1], []).append(r)
    return runs


def test_sequence_of_a_hot_run(spark):
    rows, df = hot_log(spark)
    want = {r[0]: i + 1 for run in by_run(rows).values() for i, r in enumerate(run)}
    got = sequence_numbers(df, "run_id", "ts", "event_id")
    assert {r.event_id: r.seq for r in got.collect()} == want
    assert set(got.columns) == {*df.columns, "seq"}


def test_previous_event_of_a_hot_run(spark):
    rows, df = hot_log(spark)
    want = {}
    for run in by_run(rows).values():
        for before, r in zip([None, *run], run):
            want[r[0]] = before[2].replace(tzinfo=None) if before else None
    got = previous_value(df, "run_id", "ts", "event_id").withColumn("previous_ts", F.col("previous_ts").cast("timestamp_ntz"))
    assert {r.event_id: r.previous_ts for r in got.collect()} == want


@pytest.mark.parametrize("seconds", [1, 86400])
def test_null_and_coarse_times_make_no_large_slice(spark, monkeypatch, seconds):
    """One run, most rows without a time or all on few days."""
    monkeypatch.setattr(ordering, "ROWS_EACH", 100)
    sizes = []
    write = ordering.materialize

    def seen(df, name):
        out = write(df, name)
        sizes.extend(r["count"] for r in out.groupBy("_slice").count().collect())
        return out

    monkeypatch.setattr(ordering, "materialize", seen)
    rows = [event(i, at=i % 3 * seconds) for i in range(1500)]
    rows += [(10_000 + i, i % 2 or None, None, *rows[0][3:]) for i in range(1500)]
    got = sequence_numbers(log(spark, rows).repartition(6), "run_id", "ts", "event_id").collect()
    want = {r[0]: i + 1 for run in by_run(rows[:1500]).values() for i, r in enumerate(run)}
    assert {r.event_id: r.seq for r in got} == {**want, **{10_000 + i: None for i in range(1500)}}
    assert max(sizes) < 400
    assert runlog.event_gaps(log(spark, rows)).count() == 3000


def test_gaps_are_clamped(spark):
    rows = [event(1, at=0), event(2, at=0.01), event(3, at=1.01), event(4, at=100), event(5, run=2, at=3)]
    got = {r.event_id: r.gap_s for r in runlog.event_gaps(log(spark, rows)).collect()}
    assert got == {1: 0.15, 2: 0.15, 3: 1.0, 4: 2.0, 5: 0.15}


def test_cursor(spark):
    numbered = runlog.with_sequence(log(spark, [event(i, at=i) for i in range(6)] + [event(9, run=2)]))
    assert sorted(r.seq for r in runlog.events_after(numbered, 1, 4).collect()) == [5, 6]
    assert runlog.events_after(numbered, 3, 0).count() == 0


def test_latest_finished_and_states(spark):
    rows = [
        event(1, run=1, at=0), event(2, run=1, at=9, kind="job_finished"),
        event(3, run=2, at=5), event(4, run=2, at=6, kind="job_finished"), event(5, run=2, at=7, kind="job_failed"),
        event(6, run=3, at=8),
    ]
    states = {r.run_id: r.state for r in runlog.run_states(log(spark, rows)).collect()}
    assert states == {1: "finished", 2: "failed", 3: "running"}
    assert runlog.latest_finished(log(spark, rows)).first().run_id == 1
    assert runlog.latest_finished(log(spark, rows[2:])).count() == 0


def test_run_status(spark):
    rows = [event(1), event(2), event(3, run=2), event(4, run=2, status="error")]
    assert {r.run_id: r.run_status for r in runlog.run_status(log(spark, rows)).collect()} == {1: "ok", 2: "partial"}


def test_recent_runs(spark):
    got = runlog.recent_runs(log(spark, [event(i, at=i % 7) for i in range(30)]), 3).collect()
    assert [r.event_id for r in got] == [6, 13, 20]


@pytest.mark.parametrize("value", ['{"k": 7}', "{broken", "", None])
def test_malformed_json_gives_null_tokens(spark, value):
    from weftmark.plans.inputs import as_run_events

    raw = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), 1, "view", 2.0, value)],
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    )
    assert as_run_events(raw).first().tokens_in == (7 if value == '{"k": 7}' else None)
