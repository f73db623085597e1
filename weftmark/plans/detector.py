"""The whole detector: facts to ranked actions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame

from weftmark.config import DetectorParams
from weftmark.operators import detect, explain, facts, gate, impact
from weftmark.session import materialize


def summarize(fact_rows: DataFrame, params: DetectorParams = DetectorParams()) -> tuple[DataFrame, DataFrame]:
    """Facts and their anomaly summary, each written once because every later step reads them."""
    kept = materialize(fact_rows, "facts")
    return kept, materialize(detect.detect_anomalies(facts.weekly_series(kept), params), "summary")


def detector_outputs(
    fact_rows: DataFrame, tables: Mapping[str, DataFrame | None] | None = None, params: DetectorParams = DetectorParams()
) -> dict[str, DataFrame]:
    """All outputs as named frames. The source tables are scanned once, for the facts.

    With ``tables`` the quality gate is part of the result; its issues never stop the run, since none of the
    checks is fatal.
    """
    kept, summary = summarize(fact_rows, params)
    decomposed = explain.decomposition_narrative(explain.decompose_volume_yield(kept, params), params)
    segments = explain.segment_contributions(summary, kept)
    indicators = materialize(
        explain.lead_significance(explain.lagged_correlation(summary, params), params), "indicators"
    )
    warnings = explain.early_warnings(summary, indicators)
    impacts = impact.financial_impact(summary, impact.proxy_ratios(kept), params)
    outputs = {
        "metric_facts": kept,
        "metric_summary": summary,
        "causal_decomposition": decomposed,
        "segment_contributions": segments,
        "leading_indicators": indicators,
        "leading_warnings": warnings,
        "financial_impacts": impacts,
        "yoy_comparison": explain.yoy_comparison(summary, params),
        "dashboard": impact.traffic_light(summary, impacts),
        "dashboard_items": impact.traffic_light_items(summary),
        "executive_brief": impact.executive_brief_facts(summary, impacts, decomposed, warnings, params),
        "action_items": impact.action_items(summary, impacts),
        "segment_spotlight": explain.segment_spotlight(segments),
    }
    if tables:
        outputs["quality_gate"] = gate.quality_gate(tables, params)
    return outputs


def detect_from_tables(
    tables: Mapping[str, DataFrame | None],
    params: DetectorParams = DetectorParams(),
    keywords: gate.Keywords = gate.ROLE_KEYWORDS,
    until: str | None = None,
    lookback_weeks: int | None = None,
) -> dict[str, DataFrame]:
    """From source tables to all outputs: gate, roles by column names, facts of every table with a date, detection.

    ``until`` (exclusive) and ``lookback_weeks`` bound the rows of every table. A table given as None could not be read and is
    left out. Only the gate's issues come back if one of them is fatal.
    """
    issues = gate.quality_gate(tables, params, keywords)
    if not gate.gate_passed(issues).first()["passed"]:
        return {"quality_gate": issues}
    parts = [
        facts.weekly_facts(df, name, facts.Roles.discover(df, keywords), until=until, lookback_weeks=lookback_weeks)
        for name, df in tables.items()
        if df is not None
    ]
    return {**detector_outputs(facts.weekly_facts_union(parts), params=params), "quality_gate": issues}
