"""Roll-ups of an append-only run-event log.

Columns used: run_id, seq, event_id, ts, agent, step, type, status, tokens_in, tokens_out, cost_usd,
duration_s. Money and durations are exact decimals, so sums do not depend on the order of events.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmark.functions.numbers import half_up, money, ratio
from weftmark.functions.ordering import previous_value, sequence_numbers, top_by

# Fixed values.
PRICE_IN = Decimal("0.000005")
PRICE_OUT = Decimal("0.000025")
BASELINE_HOURS = {"profile": 2.0, "etl": 6.0, "anomaly": 3.0, "sql": 1.0, "report": 2.0}
MIN_GAP_S, MAX_GAP_S = 0.15, 2.0
ALL_AGENTS = "ALL"


def token_cost(tokens_in: Column, tokens_out: Column) -> Column:
    exact = tokens_in.cast("decimal(18,0)") * F.lit(PRICE_IN) + tokens_out.cast("decimal(18,0)") * F.lit(PRICE_OUT)
    return exact.cast("decimal(18,6)")


def run_summary(events: DataFrame, baseline_hours: Mapping[str, float] = BASELINE_HOURS) -> DataFrame:
    """One row per run.

    Totals are first taken per run and step, so a run that holds a large part of the log is summed on many
    tasks and each distinct step meets its baseline hours once.
    """
    tool = F.col("type") == "tool_call"
    per_step = events.groupBy("run_id", F.coalesce("step", F.lit("")).alias("step")).agg(
        F.count_if(tool).alias("tool_calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        F.sum("cost_usd").alias("cost"),
        F.sum("duration_s").alias("seconds"),
    )
    done = (F.col("tool_calls") > 0) & (F.col("step") != "")
    hours = F.lit(0.0)
    for step, value in baseline_hours.items():
        hours = F.when(F.col("step") == step, value).otherwise(hours)
    runs = per_step.groupBy("run_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(done, F.col("step")))), ",").alias("steps_done"),
        F.sum("tool_calls").alias("tool_calls"),
        F.sum("tokens_in").alias("tokens_in"),
        F.sum("tokens_out").alias("tokens_out"),
        money(F.sum("cost"), 4).alias("total_cost_usd"),
        half_up(F.sum("seconds").cast("double") / 60.0, 2).alias("agent_minutes"),
        F.sum(F.when(done, hours).otherwise(0.0)).alias("human_hours"),
    )
    faster = half_up(ratio(F.col("human_hours") * 60.0, F.col("agent_minutes")), 1)
    return runs.withColumn("speedup_x", F.coalesce(faster, F.lit(0.0)))


def agent_rollup(events: DataFrame) -> DataFrame:
    """Per agent, and over all agents: runs, tokens, cost, mean duration and success rate."""
    ok = F.count_if(F.col("status") == "ok")
    rolled = events.rollup("agent").agg(
        F.grouping("agent").alias("_total"),
        F.count("*").alias("runs"),
        (F.sum("tokens_in") + F.sum("tokens_out")).alias("total_tokens"),
        money(F.sum("cost_usd"), 6).alias("total_cost"),
        ratio(F.sum("duration_s"), F.count("duration_s")).alias("avg_duration_s"),
        half_up(ratio(ok * 100.0, F.count("*")), 0).alias("success_rate"),
    )
    name = F.when(F.col("_total") == 1, ALL_AGENTS).otherwise(F.col("agent")).alias("agent")
    return rolled.select(name, "runs", "total_tokens", "total_cost", "avg_duration_s", "success_rate")


def recent_runs(events: DataFrame, n: int = 10) -> DataFrame:
    """The newest entries."""
    newest = top_by(events, F.col("ts"), n, "event_id")
    return newest.select(
        "event_id", "ts", "agent", "status", F.round("duration_s", 2).cast("double").alias("duration_s"),
        money(F.col("cost_usd"), 6).alias("cost"),
    )


def with_sequence(events: DataFrame) -> DataFrame:
    """Number the events of each run by time, for logs that carry no sequence."""
    return sequence_numbers(events, "run_id", "ts", "event_id")


def events_after(events: DataFrame, run_id: int, cursor: int) -> DataFrame:
    """Events of a run beyond a cursor; the log must carry ``seq``."""
    return events.where((F.col("run_id") == run_id) & (F.col("seq") > cursor))


def run_states(events: DataFrame) -> DataFrame:
    """Per run: creation time and state (running, finished or failed), from its last closing event."""
    closing = F.when(F.col("type").isin("job_finished", "job_failed"), F.col("type"))
    when = F.when(closing.isNotNull(), F.struct("ts", "event_id"))
    state = F.max_by(closing, when)
    return events.groupBy("run_id").agg(
        F.min("ts").alias("created"),
        F.when(state == "job_finished", "finished")
        .when(state == "job_failed", "failed")
        .otherwise("running")
        .alias("state"),
    )


def latest_finished(events: DataFrame) -> DataFrame:
    """The newest finished run, or no row."""
    done = run_states(events).where(F.col("state") == "finished")
    newest = done.agg(F.max(F.struct("created", "run_id")).alias("r")).where("r IS NOT NULL")
    return newest.select("r.run_id", "r.created")


def run_status(events: DataFrame) -> DataFrame:
    all_ok = F.bool_and(F.col("status") == "ok")
    return events.groupBy("run_id").agg(
        F.count("*").alias("steps"), F.when(all_ok, "ok").otherwise("partial").alias("run_status")
    )


def event_gaps(events: DataFrame) -> DataFrame:
    """Seconds since the run's previous event, held between 0.15 and 2."""
    gaps = previous_value(events, "run_id", "ts", "event_id")
    micros = F.unix_micros("ts") - F.unix_micros(F.coalesce("previous_ts", "ts"))
    clamped = F.least(F.greatest(micros / 1e6, F.lit(MIN_GAP_S)), F.lit(MAX_GAP_S))
    return gaps.select("run_id", "event_id", "ts", clamped.alias("gap_s"))


# -- routing of texts by keywords ---------------------------------------------------------------------------

# Label -> hint words, in label order, and phrases that select every label.
ROUTING_HINTS = {
    "sql": (
        "sql", "query", "question", "select", "how many", "what is", "show me", "revenue", "top", "average",
        "count", "trend", "monthly", "weekly",
    ),
    "etl": ("etl", "pipeline", "transform", "clean", "profile", "mart", "data quality"),
    "quality": (
        "quality", "anomaly", "pii", "outlier", "data quality", "scan", "validate", "integrity", "cleanliness",
        "sql", "query", "anti-pattern",
    ),
    "analytics": (
        "report", "chart", "visualize", "dashboard", "insight", "summary", "executive", "kpi", "metric",
        "analytics", "business",
    ),
    "documentation": (
        "doc", "documentation", "dictionary", "schema", "describe", "data catalog", "lineage", "metadata", "docs",
    ),
}
ALL_LABEL_PHRASES = ("full lifecycle", "everything", "all agents", "orchestrate", "complete run", "run full")
DEFAULT_LABEL = "sql"


def keyword_route(
    texts: DataFrame,
    text: str,
    hints: Mapping[str, Sequence[str]] = ROUTING_HINTS,
    phrases: Sequence[str] = ALL_LABEL_PHRASES,
    default: str = DEFAULT_LABEL,
) -> DataFrame:
    """Labels of each text by number of hint words it contains, best first.

    Ties keep the label order, no hit gives the default, and some phrases give every label. The hints are a
    parameter, so scoring is a projection: no join and no shuffle.
    """
    # a column of its own, so that it is computed once per row and not once per hint
    texts = texts.withColumn("_lowered", F.lower(F.col(text)))
    lowered = F.col("_lowered")

    def hits(words: Sequence[str]) -> Column:
        return sum((lowered.contains(w).cast("int") for w in words), F.lit(0))

    scores = F.array(
        *[
            F.struct((-hits(words)).alias("rank"), F.lit(i).alias("place"), F.lit(label).alias("label"))
            for i, (label, words) in enumerate(hints.items())
        ]
    )
    texts = texts.withColumn("_scored", F.array_sort(F.filter(scores, lambda s: s["rank"] < 0)))
    positive = F.col("_scored")
    chosen = F.transform(positive, lambda s: s["label"])
    everything = F.lit(False)
    for phrase in phrases:
        everything = everything | lowered.contains(phrase)
    routes = (
        F.when(everything, F.array(*[F.lit(label) for label in hints]))
        .when(F.size(chosen) > 0, chosen)
        .otherwise(F.array(F.lit(default)))
    )
    best = F.when(F.size(positive) > 0, -positive[0]["rank"]).otherwise(0)
    routed = texts.withColumn("routes", routes).withColumn("hits", best).drop("_lowered", "_scored")
    return routed.withColumn("label", F.col("routes")[0])
