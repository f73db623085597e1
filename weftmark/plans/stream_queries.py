"""Registered streaming queries, run to the end of their input."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftmark.config import PERIOD
from weftmark.operators import detect
from weftmark.plans import inputs, sql
from weftmark.plans.registry import comparable, query, snap_sql
from weftmark.plans.text_queries import _EVENTS
from weftmark.session import materialize, workspace
from weftmark.streaming import drift, rollup


LATE_DAYS = 10
# every seventh event is held back; those of the last days come late but in time, the others at last
_ARRIVALS = sql.with_(
    _EVENTS,
    f"""arrivals AS (
      SELECT *, event_id % 7 = 0 AS held, CAST((SELECT max(ts) FROM run_events) AS TIMESTAMP) - INTERVAL {LATE_DAYS} DAY AS mark
      FROM run_events WHERE ts IS NOT NULL
    ), timely AS (SELECT * FROM arrivals WHERE NOT held OR CAST(ts AS DATE) + INTERVAL 1 DAY > mark)""",
)


def _rolled(spark, sf_dir):
    """One run of the stream over four files, one a batch: two in order of time, then held-back events of the last days, then the rest.

    The third file comes late within the bound. Most days of the fourth ended longer than the bound before the newest event.
    """
    events = inputs.read(spark, sf_dir, "events")
    out = workspace(spark, "rollup")
    last, day, held = events.agg(F.max(F.to_date("ts")).alias("d")).scalar(), F.to_date("ts"), F.col("event_id") % 7 == 0
    early, recent = F.datediff(last, day) > 15, F.datediff(last, day) < LATE_DAYS - 1
    for part in (~held & early, ~held & ~early, held & recent, held & ~recent):
        events.where(part).coalesce(1).write.mode("append").parquet(f"{out}/in")
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/in")
    started = rollup.start_rollup(
        inputs.as_run_events(source), f"{out}/rows", f"{out}/checkpoint", late=f"{LATE_DAYS} days", compact_every=2
    )
    started.awaitTermination()
    return started, rollup.read_rollup(spark, f"{out}/rows")


@query(
    "stream_run_rollup",
    _ARRIVALS + f"""SELECT CAST(ts AS DATE) AS day, agent, count(*) AS runs, sum(tokens_in)::BIGINT AS tokens_in,
      sum(tokens_out)::BIGINT AS tokens_out, CAST(sum(micro_usd) AS DOUBLE) / 1e6 AS total_cost,
      {snap_sql("CAST(sum(centi_s) AS DOUBLE) / 100 / count(*)", 6)} AS avg_duration_s,
      count(*) FILTER (WHERE status = 'ok') AS ok FROM timely GROUP BY 1, 2""",
)
def stream_run_rollup(spark, sf_dir):
    return comparable(_rolled(spark, sf_dir)[1], avg_duration_s=6)


@query(
    "stream_late_events",
    _ARRIVALS + """SELECT (SELECT count(*) FROM timely) AS counted,
      (SELECT count(*) FROM arrivals) - (SELECT count(*) FROM timely) AS late""",
)
def stream_late_events(spark, sf_dir):
    """How many events the roll-up stream counts, and how many come too late."""
    started, rolled = _rolled(spark, sf_dir)
    return rollup.late_events(rollup.arrived_events(started), rolled)


@query(
    "stream_cusum",
    sql.with_(sql.DETECT_SEEDED)
    + f"""SELECT source_table, metric, week_start_date, {snap_sql("cusum_high", 5)} AS cusum_high,
      {snap_sql("cusum_low", 5)} AS cusum_low FROM summary""",
)
def stream_cusum(spark, sf_dir):
    """The scored series arrives out of order within a bound, and the stream is stopped and started again on the way.

    Of every 120 weeks, the rows come in two files dealt by hash, one file a batch. A row without a series then moves the watermark
    past the end.
    """
    base = workspace(spark, "cusum")
    scored = detect.detect_anomalies(inputs.channel_series(spark, sf_dir)).select("source_table", "metric", PERIOD, "z_score")
    scored = materialize(scored, "scored")
    end = scored.agg(F.min(PERIOD).alias("first"), F.max(PERIOD).alias("last")).first()
    block = F.floor(F.datediff(PERIOD, F.lit(end["first"])) / 7 / 120)
    blocks = (end["last"] - end["first"]).days // 7 // 120 + 1 if end["first"] else 0

    def arrive(rows):
        rows.coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        series = spark.readStream.schema(drift.INPUT).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        drift.start_drift(series, f"{base}/out", f"{base}/checkpoint", late="840 days").awaitTermination()

    for i in range(blocks):
        for side in (1, 0):
            arrive(scored.where((block == i) & (F.pmod(F.xxhash64("metric", PERIOD), F.lit(2)) == side)))
        if i == 0:
            run()
    far = F.date_add(F.max(PERIOD), 900).alias(PERIOD)
    none = F.lit(None).cast("string")
    arrive(scored.agg(far).select(none.alias("source_table"), none.alias("metric"), PERIOD, F.lit(None).cast("double").alias("z_score")))
    run()
    return comparable(spark.read.schema(drift.OUTPUT).parquet(f"{base}/out").where("NOT rejected").drop("rejected"), 5)
