from __future__ import annotations

import pytest

from test_runlog import SCHEMA, event
from weftmark.operators import runlog
from weftmark.sources import event_store


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def numbers(df):
    return sorted((r.run_id, r.seq, r.event_id) for r in df.where("seq IS NOT NULL").collect())


def test_batches_go_on_counting_each_run(spark, tmp_path):
    path = str(tmp_path / "log")
    assert event_store.append_events(frame(spark, event(2, at=5), event(1, at=5), event(3, run=2, at=1)), path) == 0
    # earlier than what is stored, yet appended later
    assert event_store.append_events(frame(spark, event(4, at=0), event(5, run=3), event(6, run=2, at=9)), path) == 1
    assert event_store.append_events(frame(spark).where("false"), path) == 2
    assert event_store.append_events(frame(spark, event(7, at=1)), path) == 3
    assert numbers(event_store.read_events(spark, path)) == [
        (1, 1, 1), (1, 2, 2), (1, 3, 4), (1, 4, 7), (2, 1, 3), (2, 2, 6), (3, 1, 5)
    ]
    assert [r.event_id for r in event_store.events_after(spark, path, 1, 2).orderBy("seq").collect()] == [4, 7]
    assert event_store.events_after(spark, path, 1, 4).count() == 0
    assert event_store.events_after(spark, path, 99, 0).count() == 0
    assert {(r.run_id, r.last_seq) for r in event_store.heads(spark, path).collect()} == {(1, 4), (2, 2), (3, 1)}


def test_cursor_opens_only_the_files_of_its_run_and_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(event_store, "BUCKET_EVENTS", 500)
    path = str(tmp_path / "log")
    # one run holds a third of all events
    rows = [event(i, run=1 if i % 3 == 0 else i % 50, at=float(i)) for i in range(3000)]
    events = frame(spark, *rows)
    event_store.append_events(events, path, seq_range=100)
    got = event_store.events_after(spark, path, 1, 950)
    want = runlog.events_after(runlog.with_sequence(events), 1, 950)
    assert numbers(got) == numbers(want) and got.count() > 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "run_bucket" in plan[plan.index("PartitionFilters") :]
    files = {r.f for r in got.selectExpr("input_file_name() AS f").collect()}
    stored = event_store.read_events(spark, path).inputFiles()
    assert len(files) <= 3 < len(stored) / 5


def test_a_batch_without_heads_does_not_count(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    event_store.append_events(frame(spark, event(1)), path)
    frame(spark, event(9)).selectExpr("*", "2L AS seq", "0 AS run_bucket", "0L AS seq_range").write.partitionBy(
        "run_bucket", "seq_range"
    ).parquet(f"{path}/events/batch=1")
    assert numbers(event_store.read_events(spark, path)) == [(1, 1, 1)]
    assert event_store.append_events(frame(spark, event(2), event(3)), path) == 1
    assert numbers(event_store.read_events(spark, path)) == [(1, 1, 1), (1, 2, 2), (1, 3, 3)]


@pytest.mark.parametrize("column", ["run_id", "ts"])
def test_events_without_a_place_have_no_number(spark, tmp_path, column):
    path = str(tmp_path / "log")
    rows = frame(spark, event(1), event(2))
    event_store.append_events(rows.withColumn(column, rows[column].substr(99, 1).cast(rows.schema[column].dataType)), path)
    stored = event_store.read_events(spark, path)
    assert stored.count() == 2 and stored.where("seq IS NULL").count() == 2
