from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from test_runlog import SCHEMA, event
from weftmark.streaming import drift, rollup

MONDAY = dt.date(2024, 1, 1)


def days(n):
    return n * 86400.0


class Rollup:
    """A roll-up stream whose events arrive file by file."""

    def __init__(self, spark, base, late="2 days", every=20):
        self.spark, self.base, self.late, self.every, self.arrived = spark, str(base), late, every, 0

    def store(self, *rows):
        self.spark.createDataFrame(list(rows), SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.base}/in")

    def run(self):
        source = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.base}/in")
        started = rollup.start_rollup(source, f"{self.base}/out", f"{self.base}/checkpoint", self.late, self.every)
        started.awaitTermination()
        self.arrived += rollup.arrived_events(started)
        return self.rows()

    def rows(self):
        return {(str(r.day), r.agent): r.runs for r in rollup.read_rollup(self.spark, f"{self.base}/out").collect()}

    def late_events(self):
        return tuple(rollup.late_events(self.arrived, rollup.read_rollup(self.spark, f"{self.base}/out")).first())


def test_rollup_of_several_files_in_one_run(spark, tmp_path):
    """A file a batch: one late file within the bound counts, one beyond it does not, event by event."""
    stream = Rollup(spark, tmp_path)
    stream.store(event(1, at=0), event(2, at=60), event(3, at=days(1), agent="b"))
    stream.store(event(4, at=days(5)))
    stream.store(event(5, at=days(3)), event(6, at=days(4), agent="b"))
    stream.store(event(7, at=0), event(8, at=1), event(9, at=2), event(10, at=days(5)))
    assert stream.run() == {
        ("2024-01-01", "a"): 2, ("2024-01-02", "b"): 1, ("2024-01-06", "a"): 2, ("2024-01-04", "a"): 1, ("2024-01-05", "b"): 1
    }
    assert stream.late_events() == (7, 3)


def test_rollup_goes_on_after_a_restart(spark, tmp_path):
    stream = Rollup(spark, tmp_path)
    stream.store(event(1, at=0), event(2, at=60), event(3, at=days(3), agent="b"))
    assert stream.run() == {("2024-01-01", "a"): 2, ("2024-01-04", "b"): 1}
    stream.store(event(4, at=days(2)), event(5, at=days(3), agent="b"))
    got = stream.run()
    assert got[("2024-01-03", "a")] == 1 and got[("2024-01-04", "b")] == 2
    stream.store(event(6, at=days(20)))
    stream.run()
    stream.store(event(7, at=0), event(8, at=days(20)))
    got = stream.run()
    assert got[("2024-01-01", "a")] == 2 and got[("2024-01-21", "a")] == 2
    assert stream.late_events() == (7, 1)


def test_stored_size_of_a_rollup_is_bounded(spark, tmp_path):
    stream = Rollup(spark, tmp_path, late="30 days", every=3)
    for i in range(14):
        stream.store(event(i, at=days(i % 2)), event(100 + i, at=days(i)))
    got = stream.run()
    assert got[("2024-01-01", "a")] == 7 + 1 and sum(got.values()) == 28
    base, delta = (len(list((tmp_path / "out" / kind).iterdir())) for kind in ("base", "delta"))
    assert base <= 2 and delta <= 2 * 3
    # a merge that is run again changes nothing
    rollup.compact(spark, f"{tmp_path}/out", 11)
    assert stream.rows() == got
    # nor does a merge that stopped halfway
    (tmp_path / "out" / "base" / "batch=99").mkdir()
    assert stream.rows() == got


def test_rollup_equals_batch(spark, tmp_path):
    rows = [event(i, at=i * 5000.0, agent="ab"[i % 2], status="ok" if i % 3 else "error") for i in range(60)]
    events = spark.createDataFrame(rows, SCHEMA)
    events.write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    rollup.start_rollup(source, f"{tmp_path}/out", f"{tmp_path}/checkpoint", "30 days", 2).awaitTermination()
    stream = rollup.read_rollup(spark, f"{tmp_path}/out")
    batch = rollup.finish(rollup.rollup_by_day(events))
    assert stream.count() == batch.count() and stream.exceptAll(batch).count() == 0


class Drift:
    def __init__(self, spark, base, late):
        self.spark, self.base, self.late, self.late_rows = spark, str(base), late, 0

    def store(self, *rows):
        self.spark.createDataFrame(list(rows), drift.INPUT).coalesce(1).write.mode("append").parquet(f"{self.base}/in")

    def run(self):
        series = self.spark.readStream.schema(drift.INPUT).option("maxFilesPerTrigger", 1).parquet(f"{self.base}/in")
        started = drift.start_drift(series, f"{self.base}/out", f"{self.base}/checkpoint", late=self.late)
        started.awaitTermination()
        self.late_rows += drift.late_rows(started)
        return self.spark.read.schema(drift.OUTPUT).parquet(f"{self.base}/out")


def week(i):
    return MONDAY + dt.timedelta(weeks=i)


def check_sums(rows, scores):
    """The sums of one series in order of its weeks."""
    high = low = 0.0
    assert [r.week_start_date for r in rows] == [week(i) for i in sorted(scores)]
    for row, i in zip(rows, sorted(scores)):
        if scores[i] is not None:
            high, low = max(0.0, high + scores[i] - 0.5), max(0.0, low - scores[i] - 0.5)
        assert (row.cusum_high, row.cusum_low) == (pytest.approx(high), pytest.approx(low))


@pytest.mark.parametrize("seed", range(2))
def test_drift_of_rows_in_any_order_within_the_bound(spark, tmp_path, seed):
    rng = random.Random(seed)
    scores = {s: {i: None if rng.random() < 0.1 else rng.gauss(0, 2) for i in range(24)} for s in ("M", "N")}
    rows = [("S", s, week(i), z) for s, x in scores.items() for i, z in x.items()]
    # no row comes more than six weeks after a newer one
    rows.sort(key=lambda r: (r[2] - MONDAY).days / 7 + rng.uniform(0, 6))
    stream = Drift(spark, tmp_path, "49 days")
    for lo in range(0, len(rows), 12):
        stream.store(*rows[lo : lo + 12])
        if lo == 12:
            stream.run()  # and goes on after a restart
    stream.store((None, None, week(60), None))
    out = stream.run()
    assert stream.late_rows == 0 and out.where("rejected").count() == 0
    for s, x in scores.items():
        check_sums(out.where(f"metric = '{s}'").orderBy("week_start_date").collect(), x)


def test_rows_wait_until_the_watermark_and_late_ones_are_counted(spark, tmp_path):
    stream = Drift(spark, tmp_path, "14 days")
    stream.store(("S", "M", week(1), 3.0), ("S", "M", week(0), 1.0))
    assert stream.run().count() == 0  # nothing is due yet
    # another series moves the watermark; the first one is released by its timer
    stream.store(("S", "N", week(3), 1.0))
    stream.store(("S", "N", week(9), 1.0))
    out = stream.run()
    assert {(r.metric, r.week_start_date) for r in out.collect()} == {("M", week(0)), ("M", week(1)), ("N", week(3))}
    stream.store(("S", "M", week(2), 9.0), ("S", "M", week(8), 2.0), ("S", "M", week(8), 7.0))
    stream.store((None, "M", week(30), None))
    out = stream.run()
    assert stream.late_rows == 1
    rejected = out.where("rejected").collect()
    assert [(r.metric, r.week_start_date) for r in rejected] == [("M", week(8))]
    check_sums(out.where("NOT rejected AND metric = 'M'").orderBy("week_start_date").collect(), {0: 1.0, 1: 3.0, 8: 2.0})


def test_stream_source_of_json_lines(spark, tmp_path):
    from weftmark.sources import files

    files.write_event_log(spark.createDataFrame([event(1), event(2)], SCHEMA), f"{tmp_path}/log")
    seen = files.stream_event_log(spark, f"{tmp_path}/log").groupBy("agent").agg(F.count("*").alias("n"))
    q = seen.writeStream.outputMode("complete").format("memory").queryName("seen_events").trigger(availableNow=True)
    q.option("checkpointLocation", f"{tmp_path}/c").start().awaitTermination()
    assert spark.table("seen_events").first().n == 2
