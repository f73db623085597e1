from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmark.functions.stats import student_two_sided_p
from weftmark.operators import detect, explain, facts, impact
from weftmark.plans import detector

MONDAY = dt.date(2024, 1, 1)
FACTS = (
    "source_table string, week_start_date date, country string, device string, traffic_source string, "
    "fundraisers double, gdv double, nac2 double, completes double, views double, clicks double, cost double"
)
SUMMARY = (
    "source_table string, week_start_date date, metric string, actual double, baseline_avg double, pct_diff double, "
    "z_score double, consensus_strength double, direction string, severity string"
)


def week(i):
    return MONDAY + dt.timedelta(weeks=i)


def fact_rows(spark, gdv, completes, **dims):
    d = {"country": None, "device": None, "traffic_source": None, **dims}
    rows = [
        ("S", week(i), d["country"], d["device"], d["traffic_source"], None, float(g), None, float(c), None, None, None)
        for i, (g, c) in enumerate(zip(gdv, completes))
    ]
    return spark.createDataFrame(rows, FACTS)


def test_volume_plus_yield_is_the_change(spark):
    rng = np.random.default_rng(1)
    df = fact_rows(spark, rng.uniform(1e4, 9e4, 40), rng.integers(10, 90, 40))
    rows = explain.decompose_volume_yield(df).where("gdv_delta IS NOT NULL").collect()
    assert len(rows) == 39
    for r in rows:
        assert r.volume_effect + r.yield_effect == pytest.approx(r.gdv_delta, rel=1e-9)
        assert r.volume_pct_of_change + r.yield_pct_of_change == pytest.approx(100)


def test_no_completes_and_no_change(spark):
    rows = explain.decompose_volume_yield(fact_rows(spark, [5, 5, 5], [0, 0, 0])).orderBy("week_start_date").collect()
    assert rows[1].avg_gift_current == 0 and rows[1].volume_pct_of_change == 0
    assert rows[0].gdv_baseline_avg is None


def test_narrative_names_the_larger_effect(spark):
    df = fact_rows(spark, [100_000, 100_000, 200_000, 100], [100, 100, 200, 1])
    text = explain.decomposition_narrative(explain.decompose_volume_yield(df)).orderBy("week_start_date").collect()
    assert text[1].decomposition_narrative == explain.IMMATERIAL
    assert text[2].decomposition_narrative == (
        "GDV increase of $100,000 driven primarily by volume (donation count) ($100,000 vs $0 from yield "
        "(average gift size)). Average gift changed from $1000.00 to $1000.00."
    )
    assert text[3].decomposition_narrative.startswith("GDV decline of $133,233 driven primarily by volume")


def test_segment_shares_add_to_100(spark):
    df = fact_rows(spark, [10, 30], [1, 1], country="US").union(fact_rows(spark, [10, 70], [1, 0], country="IN"))
    summary = detect.detect_anomalies(facts.weekly_series(df))
    shares = explain.segment_contributions(summary, df)
    gdv = {r.country: r.share_of_total_pct for r in shares.where("metric = 'GDV'").collect()}
    assert gdv == {"US": 30.0, "IN": 70.0}
    assert {r.share_of_total_pct for r in shares.where("metric = 'VIEWS'").collect()} == {0.0}
    top = explain.segment_spotlight(shares, 1).first()
    assert (top.metric, top.country, top.device) == ("COMPLETES", "US", "All devices")


# 5 % points of Student's t from tables
@pytest.mark.parametrize("free, t", [(1, 12.7062), (2, 4.30265), (3, 3.18245), (10, 2.22814), (15, 2.13145), (20, 2.08596), (341, 1.96694)])
def test_student_p_at_tabulated_points(spark, free, t):
    p = spark.range(1).select(student_two_sided_p(F.lit(t), F.lit(free)).alias("p")).first().p
    assert p == pytest.approx(0.05, abs=2e-6)


def test_student_p_limits(spark):
    rows = spark.createDataFrame([(0.0, 5), (-3.18245, 3), (50.0, 30)], "t double, n int")
    p = [r.p for r in rows.select(student_two_sided_p(F.col("t"), F.col("n")).alias("p")).collect()]
    assert p[0] == pytest.approx(1) and p[1] == pytest.approx(0.05, abs=1e-6) and 0 <= p[2] < 1e-12


def summary_of(spark, columns):
    """columns: (source, metric) -> values by week; None leaves the week out."""
    rows = [
        (s, week(i), m, float(v), None, None, None, 0.0, "NORMAL", "LOW")
        for (s, m), values in columns.items()
        for i, v in enumerate(values)
        if v is not None
    ]
    return spark.createDataFrame(rows, SUMMARY)


def test_lagged_correlation_equals_numpy(spark):
    rng = np.random.default_rng(3)
    gdv, views = rng.uniform(0, 9, 30), list(rng.uniform(0, 9, 30))
    views[4] = None
    df = summary_of(spark, {("A", "GDV"): gdv, ("B", "VIEWS"): views, ("B", "FLAT"): [2.0] * 30})
    got = {(r.predictor_metric, r.lag_weeks): r for r in explain.lagged_correlation(df).collect()}
    assert len(got) == 6
    filled = np.array([0.0 if v is None else v for v in views])
    for lag in (1, 2, 4):
        row = got["B::VIEWS", lag]
        assert row.target_metric == "A::GDV" and row.n_observations == 30 - lag
        assert row.correlation == pytest.approx(np.corrcoef(filled[:-lag], gdv[lag:])[0, 1], abs=1e-12)
        assert got["B::FLAT", lag].correlation == 0


def test_too_few_weeks_give_no_indicators(spark):
    df = summary_of(spark, {("A", "GDV"): [1, 2, 3, 4, 5], ("B", "VIEWS"): [1, 2, 3, 4, 6]})
    assert explain.lagged_correlation(df).count() == 0
    seven = summary_of(spark, {("A", "GDV"): range(7), ("B", "VIEWS"): range(7)})
    # lag 4 leaves three pairs only; a perfect correlation has t = 0 by definition
    rows = explain.lead_significance(explain.lagged_correlation(seven)).collect()
    assert {r.lag_weeks for r in rows} == {1, 2}
    for r in rows:
        assert r.correlation == pytest.approx(1.0) and r.direction == "leading"


def test_early_warning_needs_an_abnormal_predictor(spark):
    indicators = spark.createDataFrame(
        [("B::VIEWS", "A::GDV", 2, 0.8, 30, 0.001, True, "leading"), ("B::CLICKS", "A::GDV", 1, 0.9, 30, 0.001, True, "leading"),
         ("B::VIEWS", "A::GDV", 4, -0.8, 30, 0.001, True, "inverse_leading"), ("B::VIEWS", "A::GDV", 1, 0.1, 30, 0.6, False, "leading")],
        "predictor_metric string, target_metric string, lag_weeks int, correlation double, n_observations bigint, "
        "p_value double, significant boolean, direction string",
    )
    summary = spark.createDataFrame(
        [("B", week(9), "VIEWS", 50.0, 100.0, -50.0, -4.0, 0.8, "DROP", "CRITICAL"),
         ("B", week(9), "CLICKS", 50.0, 50.0, 0.0, 0.0, 0.0, "NORMAL", "LOW"),
         ("B", week(8), "CLICKS", 50.0, 10.0, 400.0, 9.0, 0.8, "SPIKE", "CRITICAL")],
        SUMMARY,
    )
    rows = explain.early_warnings(summary, indicators).collect()
    assert len(rows) == 1
    assert rows[0].projected_impact_pct == pytest.approx(-20) and rows[0].projected_impact_value == pytest.approx(-20)
    assert rows[0].narrative == (
        "⚠ EARLY WARNING: B.VIEWS (DROP: -50.0%) is a leading indicator for A.GDV (lag=2wk, r=0.80). "
        "If pattern holds, expect -20.0% impact (≈$20) in ~2 week(s)."
    )


def test_year_over_year(spark):
    df = summary_of(spark, {("A", "GDV"): [10.0, 0.0] + [None] * 50 + [15.0, 3.0]})
    rows = explain.yoy_comparison(df).collect()
    assert [(r.week_start_date, r.actual_yoy, r.yoy_pct_diff) for r in rows] == [(week(52), 10.0, 50.0)]


def test_year_over_year_leaves_out_what_has_no_change(spark):
    """A null on either side, a zero or no value 52 weeks before; other metrics and sources are no prior value."""
    points = [
        ("A", "GDV", 0, 10.0), ("A", "GDV", 52, None), ("A", "GDV", 1, None), ("A", "GDV", 53, 5.0), ("A", "GDV", 2, 0.0),
        ("A", "GDV", 54, 5.0), ("A", "VIEWS", 0, 4.0), ("A", "VIEWS", 53, 8.0), ("B", "GDV", 52, 7.0), ("A", "COST", 3, -4.0),
        ("A", "COST", 55, 2.0),
    ]
    df = spark.createDataFrame([(s, week(w), m, v) for s, m, w, v in points], "source_table string, week_start_date date, metric string, actual double")
    rows = explain.yoy_comparison(df).collect()
    assert [tuple(r) for r in rows] == [("A", "COST", week(55), 2.0, -4.0, -150.0)]


def test_the_detector_gives_all_outputs(spark):
    rng = np.random.default_rng(5)
    outputs = detector.detector_outputs(fact_rows(spark, rng.uniform(1e4, 9e4, 60), rng.integers(10, 90, 60)))
    # eight weeks have one 52 weeks before, and two of the seven metrics are not zero there
    counts = {name: outputs[name].count() for name in ("metric_facts", "metric_summary", "yoy_comparison")}
    assert counts == {"metric_facts": 60, "metric_summary": 420, "yoy_comparison": 16}
    assert {1, 2, 3, 8, 9} <= {r.section for r in outputs["executive_brief"].collect()}
    assert len(outputs) == 13 and all(df.columns for df in outputs.values())


def impact_summary(spark):
    row = lambda m, a, b, w=9, s="CRITICAL", d="DROP", p=-50.0: ("A", week(w), m, a, b, p, -4.0, 0.8, d, s)
    return spark.createDataFrame(
        [
            row("GDV", 50_000.0, 100_000.0), row("COMPLETES", 100.0, 400.0), row("VIEWS", 0.0, 2_000_000.0),
            row("COST", 90_000.0, 10_000.0, d="SPIKE", p=800.0), row("NAC2", 0.0, 1e9), row("CLICKS", 0.0, 1000.0),
            row("FUNDRAISERS", 0.0, 50_000.0, s="LOW"), row("GDV", 10_000.0, 90_000.0, w=8),
        ],
        SUMMARY,
    )


def test_financial_impact_factors(spark):
    ratios = spark.createDataFrame([("A", 100.0, None)], "source_table string, gift_ratio double, fund_ratio double")
    got = {(r.metric, r.week_start_date): r for r in impact.financial_impact(impact_summary(spark), ratios).collect()}
    assert {m for m, _ in got} == {"GDV", "COMPLETES", "VIEWS", "COST"}  # the rest is below the floor or worth nothing
    assert got["GDV", week(9)].weekly_dollar_impact == -50_000
    assert got["COMPLETES", week(9)].weekly_dollar_impact == -30_000
    assert got["VIEWS", week(9)].weekly_dollar_impact == -20_000
    assert got["COST", week(9)].direction == "COST_SPIKE" and got["COST", week(9)].weekly_dollar_impact == 80_000
    assert got["GDV", week(9)].narrative == (
        "Revenue impact: $50,000/week ($2,600,000/year annualized, 0.3% of target). Movement: -50.0% (drop)."
    )


def test_ratios_skip_weeks_without_completes(spark):
    row = impact.proxy_ratios(fact_rows(spark, [10, 30, 99], [1, 2, 0])).first()
    assert row.gift_ratio == pytest.approx(12.5) and row.fund_ratio is None


def test_action_items_rank_by_severity_then_money(spark):
    ratios = spark.createDataFrame([("A", 100.0, None)], "source_table string, gift_ratio double, fund_ratio double")
    summary = impact_summary(spark)
    rows = impact.action_items(summary, impact.financial_impact(summary, ratios)).collect()
    assert [r.priority for r in rows] == ["CRITICAL"] * 6 + ["LOW"]
    assert rows[0].metric == "COST" and rows[0].urgency == "This week" and rows[-1].urgency == "Normal cadence"
    gdv = next(r for r in rows if r.metric == "GDV")
    assert gdv.expected_impact == "$4,160,000/yr"  # the series' earliest impact
    assert {r.expected_impact for r in rows if r.metric in ("NAC2", "CLICKS", "FUNDRAISERS")} == {"Unquantified"}


def test_all_normal_gives_one_none_row_and_healthy_light(spark):
    summary = summary_of(spark, {("A", "GDV"): [1.0] * 6})
    ratios = spark.createDataFrame([], "source_table string, gift_ratio double, fund_ratio double")
    impacts = impact.financial_impact(summary, ratios)
    rows = impact.action_items(summary, impacts).collect()
    assert [(r.action, r.expected_impact) for r in rows] == [(impact.NO_ACTION, "$0")]
    light = impact.traffic_light(summary, impacts).first()
    assert light.overall_status == impact.HEALTHY and light.annualized_financial_exposure == 0
    none = summary.where("false")
    assert impact.action_items(none, impacts).count() == 0 and impact.traffic_light(none, impacts).count() == 0


def test_traffic_light_takes_the_worst(spark):
    summary = impact_summary(spark)
    empty = spark.createDataFrame([], "source_table string, gift_ratio double, fund_ratio double")
    light = impact.traffic_light(summary, impact.financial_impact(summary, empty)).first()
    assert light.overall_status.endswith("CRITICAL") and light.critical_issues == 6 and light.total_anomalies == 7
    assert math.isfinite(light.annualized_financial_exposure)


def test_pairs_of_many_series_in_many_blocks(spark, monkeypatch):
    """The same pairs whatever the number of blocks."""
    rng = np.random.default_rng(3)
    weeks = [dt.date(2024, 1, 1) + dt.timedelta(weeks=i) for i in range(12)]
    rows = [("S", m, w, float(rng.normal())) for m in [f"GDV{i}" for i in range(7)] + [f"M{i}" for i in range(23)] for w in weeks]
    df = spark.createDataFrame(rows, "source_table string, metric string, week_start_date date, actual double")
    found = []
    for each in (64, 3, 1):
        monkeypatch.setattr(explain, "BLOCK_SERIES", each)
        got = explain.lagged_correlation(df)
        found.append(sorted(tuple(r) for r in got.collect()))
        assert len(found[-1]) == 7 * 23 * 3
    assert found[0] == found[1] == found[2]


def test_warning_lines_are_numbered_by_impact(spark):
    schema = "predictor_metric string, target_metric string, lag_weeks int, projected_impact_value double, narrative string, recommended_action string"
    rows = [(f"P{i % 7}", f"T{i}", i % 3, None if i == 5 else float((i * 37) % 50 - 25), f"n{i}", "a") for i in range(60)]
    got = explain.warning_lines(spark.createDataFrame(rows, schema)).orderBy("line").collect()
    order = sorted(rows, key=lambda r: (-abs(round(r[3] or 0.0, 6)), r[0], r[1], r[2]))
    assert [(r.line, r.text) for r in got] == [(i, f"{r[4]} a") for i, r in enumerate(order, 1)]
    none = explain.warning_lines(spark.createDataFrame([], schema)).collect()
    assert [(r.line, r.text) for r in none] == [(1, explain.NO_WARNING)]
