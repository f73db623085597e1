"""Registered queries of the weekly facts, the detection layers and everything built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftmark.config import METRICS, PERIOD
from weftmark.operators import detect, explain, facts, facts_store, impact
from weftmark.plans import detector, inputs, sql
from weftmark.plans.registry import comparable, query, snap_sql
from weftmark.session import materialize, workspace

# digits of the comparison grid: counts and money coarse, ratios fine
_VALUE_DIGITS = {"fundraisers": 2, "gdv": 2, "nac2": 2, "completes": 2, "views": 2, "clicks": 2, "cost": 3}
_ID = "source_table, week_start_date, country, device, traffic_source"
_FACT_COLUMNS = _ID + ", " + ", ".join(f"{snap_sql(c, d)} AS {c}" for c, d in _VALUE_DIGITS.items())


# -- facts ----------------------------------------------------------------------------------------------------


@query(
    "weekly_facts",
    # the axis ends with a week, so the window is whole weeks
    sql.with_(sql.FACTS_ALL)
    + f"""SELECT {_FACT_COLUMNS} FROM facts, weeks_axis WHERE source_table = 'ORDERS' AND week_start_date >= last_week - 25 * 7""",
)
def weekly_facts(spark, sf_dir):
    bounded = inputs.order_facts(spark, sf_dir, until=inputs.axis_end(spark, sf_dir), lookback_weeks=26)
    return comparable(bounded, **_VALUE_DIGITS)


@query(
    "weekly_facts_updated",
    sql.with_(sql.FACTS_ALL) + f"SELECT {_FACT_COLUMNS} FROM facts WHERE source_table = 'ORDERS'",
)
def weekly_facts_updated(spark, sf_dir):
    """Facts kept up to date over three batches: older weeks, newer weeks, and what came late for the last half year."""
    path, lines = workspace(spark, "facts-store"), materialize(inputs.fact_lines(spark, sf_dir), "fact-lines")
    recent = F.col("order_date") >= lines.agg(F.date_sub(F.max("order_date"), 182)).scalar()
    late = recent & (F.pmod(F.xxhash64("order_id", "product_id"), F.lit(10)) == 0)
    middle = lines.agg(F.date_add(F.min("order_date"), (F.datediff(F.max("order_date"), F.min("order_date")) / 2).cast("int"))).scalar()
    old = F.col("order_date") < middle
    for batch, part in enumerate((~late & old, ~late & ~old, late)):
        facts_store.update_facts(lines.where(part), "ORDERS", inputs.ORDER_ROLES, path, batch)
    return comparable(facts_store.read_facts(spark, path), **_VALUE_DIGITS)


@query("weekly_facts_union", sql.with_(sql.FACTS_ALL) + f"SELECT {_FACT_COLUMNS} FROM facts")
def weekly_facts_union(spark, sf_dir):
    return comparable(inputs.all_facts(spark, sf_dir), **_VALUE_DIGITS)


@query(
    "weekly_channel_facts",
    sql.with_(sql.CHANNEL_FACTS)
    + f"SELECT {_ID}, {snap_sql('gdv', 2)} AS gdv, {snap_sql('completes', 2)} AS completes FROM channel_facts",
)
def weekly_channel_facts(spark, sf_dir):
    return comparable(facts.weekly_channel_facts(inputs.raw_orders(spark, sf_dir)), 2)


@query(
    "facts_long",
    sql.with_(sql.FACTS_ALL, sql.FACTS_LONG) + f"SELECT {_ID}, metric, {snap_sql('value', 2)} AS value FROM facts_long",
)
def facts_long(spark, sf_dir):
    return comparable(facts.facts_long(inputs.all_facts(spark, sf_dir)), 2)


@query(
    "weekly_series",
    sql.with_(sql.SERIES) + f"SELECT source_table, week_start_date, metric, {snap_sql('value', 2)} AS value FROM series",
)
def weekly_series(spark, sf_dir):
    return comparable(facts.weekly_series(inputs.all_facts(spark, sf_dir)), 2)


# -- layers on the seeded order series ---------------------------------------------------------------------------

_KEY = "source_table, metric, week_start_date"
_DIGITS = {
    "value": 2, "actual": 2, "baseline_avg": 2, "baseline_std": 2, "pct_diff": 5, "z_score": 5,
    "bayes_change_prob": 6, "cusum_high": 5, "cusum_low": 5, "ensemble_score": 6, "consensus_strength": 6,
}


def _layer(name: str, column_names: list[str]) -> None:
    """Register a layer: the columns it adds, over the seeded series."""
    shown = ", ".join(f"{snap_sql(c, _DIGITS[c])} AS {c}" if c in _DIGITS else c for c in column_names)
    text = sql.with_(sql.DETECT_SEEDED) + f"SELECT {_KEY}, {shown} FROM summary"

    def build(spark, sf_dir):
        summary = detect.detect_anomalies(inputs.channel_series(spark, sf_dir))
        return comparable(summary.select("source_table", "metric", PERIOD, *column_names), **_DIGITS)

    query(name, text)(build)


_layer("rolling_baseline", ["actual", "baseline_count", "baseline_avg", "baseline_std"])
_layer("pct_diff", ["pct_diff"])
_layer("z_score", ["z_score"])
_layer("iqr_outlier", ["actual", "iqr_outlier"])
_layer("bayes_change_prob", ["bayes_change_prob"])
_layer("cusum", ["cusum_high", "cusum_low"])
_layer("ensemble", ["ensemble_score", "n_agreeing_layers", "consensus_strength"])
_layer("direction", ["ensemble_score", "direction"])
_layer("severity", ["direction", "severity"])

_SUMMARY_COLUMNS = ", ".join(
    f"{snap_sql(c, _DIGITS[c])} AS {c}" if c in _DIGITS else c for c in detect.OUTPUT
)


@query("detect_anomalies", sql.with_(sql.DETECT) + f"SELECT {_SUMMARY_COLUMNS} FROM summary")
def detect_anomalies(spark, sf_dir):
    series = facts.weekly_series(inputs.all_facts(spark, sf_dir))
    return comparable(detect.detect_anomalies(series), **_DIGITS)


@query(
    "top_anomalies",
    sql.with_(sql.DETECT_SEEDED)
    + f"""SELECT week_start_date AS week, source_table, metric, direction, severity,
      {snap_sql("pct_diff", 1)} AS pct_diff, {snap_sql("z_score", 2)} AS z_score, {snap_sql("actual", 2)} AS actual,
      {snap_sql("baseline_avg", 2)} AS baseline_avg FROM summary WHERE direction <> 'NORMAL'
      ORDER BY round(abs(ensemble_score), 9) DESC, week_start_date, source_table, metric LIMIT 10""",
)
def top_anomalies(spark, sf_dir):
    summary = detect.detect_anomalies(inputs.channel_series(spark, sf_dir))
    return comparable(detect.top_anomalies(summary), 2, pct_diff=1)


# -- explanation ------------------------------------------------------------------------------------------------


def _summarized(spark, sf_dir):
    return detector.summarize(inputs.all_facts(spark, sf_dir))


_DECOMPOSED = f"""{sql.FACTS_ALL}, weekly AS (
  SELECT source_table, week_start_date, sum(COALESCE(gdv, 0.0e0)) AS gdv_current,
    sum(COALESCE(completes, 0.0e0)) AS completes_current FROM facts GROUP BY ALL
), prior AS (
  SELECT *, avg(gdv_current) OVER w AS gdv_baseline_avg, avg(completes_current) OVER w AS completes_baseline_avg
  FROM weekly WINDOW w AS (PARTITION BY source_table ORDER BY week_start_date ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)
), gifts AS (
  SELECT *, gdv_current - gdv_baseline_avg AS gdv_delta,
    CASE WHEN completes_current > 0 THEN gdv_current / completes_current ELSE 0 END AS avg_gift_current,
    CASE WHEN completes_baseline_avg > 0 THEN gdv_baseline_avg / completes_baseline_avg ELSE 0 END
      AS avg_gift_baseline_avg
  FROM prior
), decomposed AS (
  SELECT *, (completes_current - completes_baseline_avg) * avg_gift_baseline_avg AS volume_effect,
    completes_current * (avg_gift_current - avg_gift_baseline_avg) AS yield_effect,
    (completes_current - completes_baseline_avg) * (avg_gift_current - avg_gift_baseline_avg) AS interaction_effect
  FROM gifts
), shared AS (
  SELECT *, CASE WHEN gdv_delta <> 0 THEN volume_effect / gdv_delta * 100 WHEN gdv_delta = 0 THEN 0 END
      AS volume_pct_of_change,
    CASE WHEN gdv_delta <> 0 THEN yield_effect / gdv_delta * 100 WHEN gdv_delta = 0 THEN 0 END AS yield_pct_of_change
  FROM decomposed
)"""
_DECOMPOSED_DIGITS = {
    **{
        c: 2
        for c in (
            "gdv_current", "completes_current", "gdv_baseline_avg", "completes_baseline_avg", "gdv_delta",
            "volume_effect", "yield_effect", "interaction_effect",
        )
    },
    **{c: 4 for c in ("avg_gift_current", "avg_gift_baseline_avg")},
    **{c: 3 for c in ("volume_pct_of_change", "yield_pct_of_change")},
}


@query(
    "decompose_volume_yield",
    sql.with_(_DECOMPOSED)
    + "SELECT source_table, week_start_date, "
    + ", ".join(f"{snap_sql(c, d)} AS {c}" for c, d in _DECOMPOSED_DIGITS.items())
    + " FROM shared",
)
def decompose_volume_yield(spark, sf_dir):
    return comparable(explain.decompose_volume_yield(inputs.all_facts(spark, sf_dir)), **_DECOMPOSED_DIGITS)


def _thousands_sql(value: str) -> str:
    return f"format('{{:,}}', CAST(floor({value} + 0.500001e0) AS BIGINT))"


def _fixed_sql(value: str, digits: int) -> str:
    scale = f"{10**digits}e0"
    return f"printf('%.{digits}f', floor({value} * {scale} + 0.500001e0) / {scale})"


_NARRATIVE = f"""CASE WHEN abs(gdv_delta) >= 10000 THEN
  'GDV ' || CASE WHEN gdv_delta > 0 THEN 'increase' ELSE 'decline' END || ' of $' || {_thousands_sql("abs(gdv_delta)")}
  || ' driven primarily by '
  || CASE WHEN abs(volume_effect) > abs(yield_effect) THEN '{explain.VOLUME}' ELSE '{explain.YIELD}' END
  || ' ($' || {_thousands_sql("abs(volume_effect)")} || ' vs $' || {_thousands_sql("abs(yield_effect)")} || ' from '
  || CASE WHEN abs(volume_effect) > abs(yield_effect) THEN '{explain.YIELD}' ELSE '{explain.VOLUME}' END
  || '). Average gift changed from $' || {_fixed_sql("avg_gift_baseline_avg", 2)} || ' to $'
  || {_fixed_sql("avg_gift_current", 2)} || '.'
  ELSE '{explain.IMMATERIAL}' END AS decomposition_narrative"""


@query(
    "decomposition_narrative",
    sql.with_(_DECOMPOSED) + f"SELECT source_table, week_start_date, {_NARRATIVE} FROM shared",
)
def decomposition_narrative(spark, sf_dir):
    decomposed = explain.decompose_volume_yield(inputs.all_facts(spark, sf_dir))
    return explain.decomposition_narrative(decomposed).select("source_table", PERIOD, "decomposition_narrative")


_SEGMENTS = f"""{sql.SERIES}, newest AS (SELECT max(week_start_date) AS w FROM series), segments AS (
  SELECT f.*, sum(value) OVER (PARTITION BY source_table, metric) AS total FROM facts_long f, newest
  WHERE week_start_date = w
), contributions AS (
  SELECT source_table, week_start_date, metric, country, device, traffic_source, value,
    CASE WHEN total > 0 THEN value / total * 100 ELSE 0 END AS share_of_total_pct FROM segments
)"""


@query(
    "segment_contributions",
    sql.with_(_SEGMENTS)
    + f"""SELECT source_table, week_start_date, metric, country, device, traffic_source, {snap_sql("value", 2)} AS value,
      {snap_sql("share_of_total_pct", 5)} AS share_of_total_pct FROM contributions""",
)
def segment_contributions(spark, sf_dir):
    kept, summary = _summarized(spark, sf_dir)
    return comparable(explain.segment_contributions(summary, kept), value=2, share_of_total_pct=5)


@query(
    "segment_spotlight",
    sql.with_(_SEGMENTS)
    + """SELECT metric, source_table, country, device, traffic_source,
        floor(share_of_total_pct * 10 + 0.5e0) / 10 AS share_of_total_pct FROM (
        SELECT metric, source_table, COALESCE(nullif(country, ''), 'Global') AS country,
          COALESCE(nullif(device, ''), 'All devices') AS device,
          COALESCE(nullif(traffic_source, ''), 'All sources') AS traffic_source, share_of_total_pct FROM contributions)
      ORDER BY round(share_of_total_pct, 9) DESC, source_table, metric, country, device, traffic_source LIMIT 5""",
)
def segment_spotlight(spark, sf_dir):
    kept, summary = _summarized(spark, sf_dir)
    return explain.segment_spotlight(explain.segment_contributions(summary, kept))


# Two-sided p value of Student's t by gamma functions: an independent form of the finite series used in Spark.
_SERIES_TERM_ODD = "exp(lgamma(k + 1.0e0) - lgamma(k + 1.5e0)) * sqrt(pi()) / 2 * pow(cos(theta), 2 * k + 1)"
_SERIES_TERM_EVEN = "exp(lgamma(k + 0.5e0) - lgamma(k + 1.0e0)) / sqrt(pi()) * pow(cos(theta), 2 * k)"
_CORRELATED = f"""{sql.SERIES}, axis AS (
  SELECT p, row_number() OVER (ORDER BY p) - 1 AS at, count(*) OVER () AS weeks
  FROM (SELECT DISTINCT week_start_date AS p FROM series)
), names AS (SELECT DISTINCT source_table, metric FROM series), dense AS (
  SELECT upper(n.source_table || '::' || n.metric) AS series_name, a.at, COALESCE(s.value, 0.0e0) AS v
  FROM names n CROSS JOIN axis a LEFT JOIN series s
    ON s.source_table = n.source_table AND s.metric = n.metric AND s.week_start_date = a.p
  WHERE a.weeks >= 6
), correlated AS (
  SELECT p.series_name AS predictor_metric, t.series_name AS target_metric, CAST(lag AS INT) AS lag_weeks,
    CASE WHEN var_pop(p.v) = 0 OR var_pop(t.v) = 0 THEN 0.0e0 ELSE corr(p.v, t.v) END AS correlation,
    count(*) AS n_observations
  FROM dense t JOIN (SELECT unnest([1, 2, 4]) AS lag) ON true JOIN dense p ON p.at = t.at - lag
  WHERE contains(t.series_name, 'GDV') AND NOT contains(p.series_name, 'GDV')
  GROUP BY 1, 2, 3 HAVING count(*) >= 5
), tested AS (
  SELECT *, n_observations - 2 AS free, CASE WHEN abs(correlation) < 1
    THEN correlation * sqrt((n_observations - 2) / (1 - correlation * correlation)) ELSE 0 END AS t FROM correlated
), angled AS (SELECT *, atan(abs(t) / sqrt(CAST(free AS DOUBLE))) AS theta FROM tested), significant AS (
  SELECT * EXCLUDE (free, t, theta, p), p AS p_value, p < 0.05 AS significant,
    CASE WHEN correlation > 0 THEN 'leading' ELSE 'inverse_leading' END AS direction
  FROM (SELECT *, greatest(0.0e0, 1 - CASE
      WHEN free = 1 THEN theta * 2 / pi()
      WHEN free % 2 = 1 THEN (theta + sin(theta) * (SELECT sum({_SERIES_TERM_ODD})
        FROM (SELECT unnest(generate_series(0, (free - 3) // 2)) AS k))) * 2 / pi()
      ELSE sin(theta) * (SELECT sum({_SERIES_TERM_EVEN})
        FROM (SELECT unnest(generate_series(0, (free - 2) // 2)) AS k)) END) AS p FROM angled)
)"""
_LEAD_DIGITS = {"correlation": 6, "p_value": 6}


@query(
    "lagged_correlation",
    sql.with_(_CORRELATED)
    + f"""SELECT predictor_metric, target_metric, lag_weeks, {snap_sql("correlation", 6)} AS correlation,
      n_observations FROM correlated""",
)
def lagged_correlation(spark, sf_dir):
    _, summary = _summarized(spark, sf_dir)
    return comparable(explain.lagged_correlation(summary), **_LEAD_DIGITS)


@query(
    "lead_significance",
    sql.with_(_CORRELATED)
    + f"""SELECT predictor_metric, target_metric, lag_weeks, {snap_sql("correlation", 6)} AS correlation,
      n_observations, {snap_sql("p_value", 6)} AS p_value, significant, direction FROM significant""",
)
def lead_significance(spark, sf_dir):
    _, summary = _summarized(spark, sf_dir)
    return comparable(explain.lead_significance(explain.lagged_correlation(summary)), **_LEAD_DIGITS)


_WARNED = f"""{_CORRELATED}, {sql.LAYERS}, now AS (
  SELECT upper(source_table || '::' || metric) AS predictor_metric, source_table || '.' || metric AS predictor,
    pct_diff AS predictor_pct_diff, direction AS predictor_direction, baseline_avg
  FROM summary WHERE week_start_date = (SELECT max(week_start_date) FROM summary) AND direction <> 'NORMAL'
), warned AS (
  SELECT s.predictor_metric, target_metric, replace(target_metric, '::', '.') AS target, predictor, lag_weeks,
    correlation, predictor_pct_diff, predictor_direction,
    predictor_pct_diff * abs(correlation) * 0.5e0 AS projected_impact_pct,
    baseline_avg * (predictor_pct_diff * abs(correlation) * 0.5e0) / 100 AS projected_impact_value
  FROM significant s JOIN now n ON s.predictor_metric = n.predictor_metric
  WHERE significant AND s.direction = 'leading'
), early AS (
  SELECT 'LEADING_INDICATOR' AS warning_type, predictor_metric, target_metric, lag_weeks, correlation,
    predictor_pct_diff, predictor_direction, projected_impact_pct, projected_impact_value,
    '⚠ EARLY WARNING: ' || predictor || ' (' || predictor_direction || ': '
      || {_fixed_sql("predictor_pct_diff", 1)} || '%) is a leading indicator for ' || target || ' (lag=' || lag_weeks
      || 'wk, r=' || {_fixed_sql("correlation", 2)} || '). If pattern holds, expect '
      || {_fixed_sql("projected_impact_pct", 1)} || '% impact (≈$' || {_thousands_sql("abs(projected_impact_value)")}
      || ') in ~' || lag_weeks || ' week(s).' AS narrative,
    'Investigate ' || predictor || ' root cause now to mitigate potential downstream impact on ' || target || '.'
      AS recommended_action FROM warned
)"""
_WARNING_DIGITS = {"correlation": 6, "predictor_pct_diff": 5, "projected_impact_pct": 5, "projected_impact_value": 2}


@query(
    "early_warnings",
    sql.with_(_WARNED)
    + "SELECT warning_type, predictor_metric, target_metric, lag_weeks, predictor_direction, narrative, "
    + "recommended_action, "
    + ", ".join(f"{snap_sql(c, d)} AS {c}" for c, d in _WARNING_DIGITS.items())
    + " FROM early",
)
def early_warnings(spark, sf_dir):
    _, summary = _summarized(spark, sf_dir)
    indicators = explain.lead_significance(explain.lagged_correlation(summary))
    return comparable(explain.early_warnings(summary, indicators), **_WARNING_DIGITS)


@query(
    "early_warning_lines",
    sql.with_(_WARNED)
    + """SELECT CAST(row_number() OVER (ORDER BY round(abs(projected_impact_value), 6) DESC, predictor_metric, target_metric,
        lag_weeks) AS INT) AS line, narrative || ' ' || recommended_action AS text FROM early
      UNION ALL SELECT 1, 'No leading indicator warnings detected.' WHERE (SELECT count(*) FROM early) = 0""",
)
def early_warning_lines(spark, sf_dir):
    _, summary = _summarized(spark, sf_dir)
    indicators = explain.lead_significance(explain.lagged_correlation(summary))
    return explain.warning_lines(explain.early_warnings(summary, indicators))


_YOY = """SELECT a.source_table, a.metric, a.week_start_date, a.actual, b.actual AS actual_yoy,
  (a.actual - b.actual) / b.actual * 100 AS yoy_pct_diff
  FROM summary a JOIN summary b ON a.source_table = b.source_table AND a.metric = b.metric
    AND b.week_start_date = CAST(a.week_start_date - INTERVAL 52 WEEKS AS DATE)
  WHERE b.actual <> 0"""


@query(
    "yoy_comparison",
    sql.with_(sql.DETECT)
    + f"""SELECT source_table, metric, week_start_date, {snap_sql("actual", 2)} AS actual,
      {snap_sql("actual_yoy", 2)} AS actual_yoy, {snap_sql("yoy_pct_diff", 5)} AS yoy_pct_diff FROM ({_YOY})""",
)
def yoy_comparison(spark, sf_dir):
    _, summary = _summarized(spark, sf_dir)
    return comparable(explain.yoy_comparison(summary), actual=2, actual_yoy=2, yoy_pct_diff=5)


# -- impact -----------------------------------------------------------------------------------------------------

_RATIOS = """ratios AS (
  SELECT source_table, avg(gdv / nullif(completes, 0)) AS gift_ratio, avg(gdv / nullif(fundraisers, 0)) AS fund_ratio
  FROM (SELECT source_table, week_start_date, sum(COALESCE(gdv, 0.0e0)) AS gdv,
    sum(COALESCE(completes, 0.0e0)) AS completes, sum(COALESCE(fundraisers, 0.0e0)) AS fundraisers
    FROM facts GROUP BY 1, 2)
  GROUP BY source_table
)"""
_IMPACT = f"""{sql.DETECT}, {_RATIOS}, valued AS (
  SELECT s.source_table, week_start_date, metric,
    CASE WHEN metric = 'COST' THEN 'COST_' || direction ELSE direction END AS direction, severity, pct_diff,
    (actual - baseline_avg) * CASE metric WHEN 'GDV' THEN 1 WHEN 'COST' THEN 1
      WHEN 'COMPLETES' THEN CASE WHEN gift_ratio > 0 THEN gift_ratio ELSE 1 END
      WHEN 'FUNDRAISERS' THEN CASE WHEN fund_ratio > 0 THEN fund_ratio ELSE 1 END
      WHEN 'VIEWS' THEN 0.01e0 WHEN 'CLICKS' THEN 0.05e0 ELSE 0 END AS weekly_dollar_impact
  FROM summary s LEFT JOIN ratios r ON s.source_table = r.source_table
  WHERE direction <> 'NORMAL' AND severity <> 'LOW' AND pct_diff IS NOT NULL AND baseline_avg IS NOT NULL
), impacts AS (
  SELECT *, weekly_dollar_impact * 52 AS annualized_dollar_impact,
    weekly_dollar_impact * 52 / 1e9 * 100 AS annualized_pct_of_target
  FROM valued WHERE abs(weekly_dollar_impact) >= 10000
)"""
_IMPACT_TEXT = f"""CASE WHEN metric = 'GDV' THEN 'Revenue impact' ELSE 'Estimated proxy impact' END || ': $'
  || {_thousands_sql("abs(weekly_dollar_impact)")} || '/week ($' || {_thousands_sql("abs(annualized_dollar_impact)")}
  || '/year annualized, ' || {_fixed_sql("abs(annualized_pct_of_target)", 1)} || '% of target). Movement: '
  || {_fixed_sql("pct_diff", 1)} || '% (' || lower(direction) || ').' AS narrative"""
_IMPACT_DIGITS = {
    "pct_diff": 5, "weekly_dollar_impact": 2, "annualized_dollar_impact": 1, "annualized_pct_of_target": 6,
}


@query(
    "proxy_ratios",
    sql.with_(sql.FACTS_ALL, _RATIOS)
    + f"""SELECT source_table, {snap_sql("gift_ratio", 4)} AS gift_ratio, {snap_sql("fund_ratio", 4)} AS fund_ratio
      FROM ratios""",
)
def proxy_ratios(spark, sf_dir):
    return comparable(impact.proxy_ratios(inputs.all_facts(spark, sf_dir)), 4)


def _impacts(spark, sf_dir):
    kept, summary = _summarized(spark, sf_dir)
    return kept, summary, impact.financial_impact(summary, impact.proxy_ratios(kept))


@query(
    "financial_impact",
    sql.with_(_IMPACT)
    + f"SELECT source_table, week_start_date, metric, direction, severity, {_IMPACT_TEXT}, "
    + ", ".join(f"{snap_sql(c, d)} AS {c}" for c, d in _IMPACT_DIGITS.items())
    + " FROM impacts",
)
def financial_impact(spark, sf_dir):
    return comparable(_impacts(spark, sf_dir)[2], **_IMPACT_DIGITS)


_LATEST = "latest AS (SELECT * FROM summary WHERE week_start_date = (SELECT max(week_start_date) FROM summary))"


@query(
    "traffic_light",
    sql.with_(_IMPACT, _LATEST)
    + f"""SELECT CASE WHEN critical_issues > 0 THEN '🔴 CRITICAL' WHEN high_issues > 0 THEN '🟡 WARNING'
        WHEN medium_issues > 0 THEN '🟢 MONITOR' ELSE '✅ HEALTHY' END AS overall_status, *,
        {snap_sql("(SELECT COALESCE(sum(annualized_dollar_impact), 0) FROM impacts)", 0)}
          AS annualized_financial_exposure
      FROM (SELECT max(week_start_date) AS reporting_week, count(*) FILTER (WHERE severity = 'CRITICAL')
        AS critical_issues, count(*) FILTER (WHERE severity = 'HIGH') AS high_issues,
        count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_issues,
        count(*) FILTER (WHERE direction <> 'NORMAL') AS total_anomalies FROM latest)""",
)
def traffic_light(spark, sf_dir):
    _, summary, impacts = _impacts(spark, sf_dir)
    return comparable(impact.traffic_light(summary, impacts), annualized_financial_exposure=0)


@query(
    "traffic_light_items",
    sql.with_(sql.DETECT, _LATEST)
    + f"""SELECT metric, source_table, {snap_sql("pct_diff", 1)} AS pct_change, severity,
      CASE WHEN severity = 'CRITICAL' THEN {snap_sql("z_score", 2)} END AS z_score
      FROM latest WHERE severity IN ('CRITICAL', 'HIGH')""",
)
def traffic_light_items(spark, sf_dir):
    return comparable(impact.traffic_light_items(_summarized(spark, sf_dir)[1]), pct_change=1, z_score=2)


_ACTION_ROWS = ", ".join(
    "(" + ", ".join("'" + text + "'" for text in (name, *row)) + ")" for name, row in impact.ACTIONS.items()
)


@query(
    "action_items",
    sql.with_(_IMPACT, _LATEST)
    + f"""SELECT severity AS priority, l.metric, l.source_table, floor(pct_diff * 10 + 0.5e0) / 10 AS pct_change, direction,
        COALESCE(action, '{impact.DEFAULT_ACTION[0]}') AS action,
        CASE WHEN COALESCE(value, 0) <> 0 THEN '$' || {_thousands_sql("abs(value)")} || '/yr' ELSE 'Unquantified' END
          AS expected_impact, {snap_sql("COALESCE(value, 0)", 1)} AS financial_annualized,
        COALESCE(category, '{impact.DEFAULT_ACTION[1]}') AS category, COALESCE(owner, '{impact.DEFAULT_ACTION[2]}') AS owner,
        CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'This week' ELSE 'Normal cadence' END AS urgency,
        floor(consensus_strength * 100 + 0.5e0) / 100 AS consensus_strength
      FROM latest l
      LEFT JOIN (SELECT source_table, metric, arg_min(annualized_dollar_impact, week_start_date) AS value
        FROM impacts GROUP BY 1, 2) i ON l.source_table = i.source_table AND l.metric = i.metric
      LEFT JOIN (VALUES {_ACTION_ROWS}) AS a(metric, action, category, owner) ON l.metric = a.metric
      WHERE direction <> 'NORMAL'""",
)
def action_items(spark, sf_dir):
    _, summary, impacts = _impacts(spark, sf_dir)
    return comparable(impact.action_items(summary, impacts), financial_annualized=1)


_BRIEF = f"""SELECT 1 AS section, '' AS order_key, 'Week Ending: ' || max(week_start_date) AS text FROM latest
UNION ALL SELECT 2, '', 'TOP-LINE: GDV ' || direction || ' of ' || {_fixed_sql("pct_diff", 1)} || '% (z='
  || {_fixed_sql("z_score", 1)} || ', severity=' || severity || ') Source: ' || source_table
  FROM (SELECT * FROM latest WHERE metric = 'GDV' ORDER BY pct_diff NULLS LAST, source_table LIMIT 1)
UNION ALL SELECT 3, source_table, 'DECOMP: ' || decomposition_narrative FROM (SELECT source_table, week_start_date,
  {_NARRATIVE} FROM shared) WHERE week_start_date = (SELECT max(week_start_date) FROM summary)
UNION ALL SELECT CASE severity WHEN 'CRITICAL' THEN 4 ELSE 5 END, source_table || '|' || metric,
  severity || ': ' || source_table || '.' || metric || ': ' || {_fixed_sql("pct_diff", 1)} || '% (' || direction || ')'
  FROM latest WHERE severity IN ('CRITICAL', 'HIGH')
UNION ALL SELECT 6, '', 'FINANCIAL IMPACT: weekly $' || {_thousands_sql("abs(week)")} || ' ('
  || CASE WHEN week > 0 THEN 'favorable' ELSE 'unfavorable' END || '), annualized $' || {_thousands_sql("abs(year)")}
  || ' (' || CASE WHEN year > 0 THEN 'opportunity' ELSE 'exposure' END || '), '
  || {_fixed_sql("abs(year) / 1e9 * 100", 1)} || '% of annual target'
  FROM (SELECT sum(weekly_dollar_impact) AS week, sum(annualized_dollar_impact) AS year FROM impacts)
  WHERE week IS NOT NULL
UNION ALL SELECT 7, predictor_metric || '|' || target_metric || '|' || lag_weeks, narrative FROM early
UNION ALL SELECT 8, '', count(*) FILTER (WHERE severity = 'CRITICAL') || ' critical, '
  || count(*) FILTER (WHERE severity = 'HIGH') || ' high, ' || count(*) FILTER (WHERE severity = 'MEDIUM')
  || ' medium signals detected' FROM latest
UNION ALL SELECT 9, '', 'Data spans ' || count(DISTINCT week_start_date) || ' weeks across '
  || count(DISTINCT source_table) || ' source tables' FROM summary"""
# one chain of common tables for the brief: layers, indicators, decomposition and impacts over the same series
_BRIEF_TABLES = ", ".join(
    [
        _WARNED,
        _IMPACT.removeprefix(sql.DETECT + ", "),
        _DECOMPOSED.removeprefix(sql.FACTS_ALL + ", "),
        _LATEST,
    ]
)


@query("executive_brief_facts", sql.with_(_BRIEF_TABLES) + _BRIEF)
def executive_brief_facts(spark, sf_dir):
    return detector.detector_outputs(inputs.all_facts(spark, sf_dir))["executive_brief"]


_COUNTED = {
    "metric_facts": "facts",
    "metric_summary": "summary",
    "causal_decomposition": "shared",
    "leading_indicators": "significant",
    "leading_warnings": "early",
    "financial_impacts": "impacts",
    "yoy_comparison": f"({_YOY})",
    "dashboard_items": "latest WHERE severity IN ('CRITICAL', 'HIGH')",
    "action_items": "latest WHERE direction <> 'NORMAL'",
}


@query(
    "detector_run",
    sql.with_(_BRIEF_TABLES)
    + sql.union_columns(
        [f"SELECT '{name}' AS output, count(*) AS row_count FROM {table}" for name, table in _COUNTED.items()]
    ),
)
def detector_run(spark, sf_dir):
    """Every output of the detector, counted."""
    outputs = detector.detector_outputs(inputs.all_facts(spark, sf_dir))
    counts = [
        outputs[name].agg(F.count("*").alias("row_count")).select(F.lit(name).alias("output"), "row_count")
        for name in _COUNTED
    ]
    return facts.union_all(counts)


@query(
    "detector_from_tables",
    sql.with_(sql.DETECT)
    + f"""SELECT 'metric_facts' AS output, source_table, count(*) AS row_count, {snap_sql("sum(gdv)", 1)} AS gdv FROM facts
        WHERE source_table <> 'SHIPMENTS' GROUP BY source_table
      UNION ALL SELECT 'metric_summary', source_table, count(*),
        {snap_sql("sum(CASE WHEN metric = 'GDV' THEN actual END)", 1)} FROM summary WHERE source_table <> 'SHIPMENTS'
        GROUP BY source_table
      UNION ALL SELECT 'quality_gate', 'GONE', 1, NULL
      UNION ALL SELECT 'quality_gate', 'EVENTS', count(*), NULL FROM (SELECT count(*) AS n,
        count(CASE WHEN event_type = 'purchase' THEN value END) AS seen FROM events) WHERE 1 - seen / n > 0.3 HAVING count(*) > 0""",
)
def detector_from_tables(spark, sf_dir):
    outputs = detector.detect_from_tables(inputs.discoverable_tables(spark, sf_dir), until=inputs.axis_end(spark, sf_dir))

    def counted(name, table, gdv):
        rows = outputs[name].groupBy(F.col(table).alias("source_table")).agg(F.count("*").alias("row_count"), gdv.alias("gdv"))
        return rows.select(F.lit(name).alias("output"), "source_table", "row_count", "gdv")

    found = [
        counted("metric_facts", "source_table", F.sum("gdv")),
        counted("metric_summary", "source_table", F.sum(F.when(F.col("metric") == "GDV", F.col("actual")))),
        counted("quality_gate", "table_name", F.max(F.lit(None).cast("double"))),
    ]
    return comparable(facts.union_all(found), 1)


assert set(_VALUE_DIGITS) == {m.lower() for m in METRICS}
