from __future__ import annotations

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmark.config import DetectorParams
from weftmark.operators import detect

MONDAY = dt.date(2024, 1, 1)


def weeks(values, source="S", metric="GDV"):
    return [(source, metric, MONDAY + dt.timedelta(weeks=i), float(v)) for i, v in enumerate(values)]


def series(spark, rows):
    return spark.createDataFrame(rows, "source_table string, metric string, week_start_date date, value double")


def by_hand(values, p=DetectorParams()):
    """Plain sequential version of all layers for one series."""
    high = low = 0.0
    out = []
    for i, v in enumerate(values):
        prior = values[max(0, i - 8) : i]
        enough = len(prior) >= 4
        mean = sum(prior) / len(prior) if enough else None
        sd = statistics.stdev(prior) if enough else None
        pct = (v - mean) / mean * 100 if enough and mean else None
        z = (v - mean) / sd if enough and sd else None
        fence = False
        if prior:
            q1, q3 = np.percentile(prior, [25, 75])
            fence = v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)
        prob = 1 / (1 + math.exp(-len(prior) * z * z / 4)) if z is not None else 0.5
        if z is not None:
            high, low = max(0.0, high + z - 0.5), max(0.0, low - z - 0.5)
        side = -1 if mean is not None and v < mean else 1
        votes = [
            0 if pct is None else -1 if pct <= -10 else 1 if pct >= 10 else 0,
            0 if z is None else -1 if z <= -2 else 1 if z >= 2 else 0,
            side if fence else 0,
            1 if high > 3 else -1 if low > 3 else 0,
            side if prob > 0.8 else 0,
        ]
        score = sum(a * b for a, b in zip(votes, (1, 2, 1.5, 1, 1.5))) / 7
        agree = sum(x != 0 for x in votes)
        way = "DROP" if score <= -0.3 else "SPIKE" if score >= 0.3 else "NORMAL"
        big = (pct is not None and abs(pct) >= 25) or (z is not None and abs(z) >= 3.5)
        if way == "NORMAL":
            level = "LOW"
        elif big:
            level = "CRITICAL"
        elif agree >= 3 and way == "DROP":
            level = "HIGH"
        else:
            level = "MEDIUM" if agree >= 2 else "LOW"
        out.append((mean, sd, pct, z, fence, prob, high, low, score, agree, way, level))
    return out


COLUMNS = (
    "baseline_avg", "baseline_std", "pct_diff", "z_score", "iqr_outlier", "bayes_change_prob", "cusum_high",
    "cusum_low", "ensemble_score", "n_agreeing_layers", "direction", "severity",
)


@pytest.mark.parametrize("seed", range(3))
def test_layers_equal_sequential_version(spark, seed):
    rng = np.random.default_rng(seed)
    values = rng.normal(1000, 80, 120).round(3)
    values[40] *= 4
    values[70] *= 0.3
    values[90:] += 150
    got = detect.detect_anomalies(series(spark, weeks(values))).orderBy("week_start_date").collect()
    for row, want in zip(got, by_hand(list(values))):
        for name, expected in zip(COLUMNS, want):
            if isinstance(expected, float) and not isinstance(expected, bool):
                assert row[name] == pytest.approx(expected, rel=1e-8, abs=1e-8), name
            else:
                assert row[name] == expected, name


def test_planted_spike_and_drop(spark):
    values = [100 + (i % 3) for i in range(30)]
    values[20], values[27] = 400, 40
    got = {r.week_start_date: r for r in detect.detect_anomalies(series(spark, weeks(values))).collect()}
    spike, drop = (got[MONDAY + dt.timedelta(weeks=i)] for i in (20, 27))
    assert (spike.direction, spike.severity) == ("SPIKE", "CRITICAL")
    assert drop.direction == "DROP"
    assert detect.top_anomalies(detect.detect_anomalies(series(spark, weeks(values)))).first().direction == "SPIKE"


def test_few_periods_have_no_baseline(spark):
    got = detect.detect_anomalies(series(spark, weeks([5, 5, 5, 9]))).orderBy("week_start_date").collect()
    assert all(r.baseline_avg is None and r.bayes_change_prob == 0.5 for r in got)
    assert [r.iqr_outlier for r in got] == [False, False, False, True]  # the fences work from the second period


def test_zero_mean_and_zero_deviation(spark):
    got = detect.detect_anomalies(series(spark, weeks([0] * 6 + [7]))).orderBy("week_start_date").collect()[-1]
    assert got.pct_diff is None and got.z_score is None
    assert got.iqr_outlier and got.cusum_high == 0 and got.bayes_change_prob == 0.5
    assert got.direction == "NORMAL"


def test_missing_week_is_not_filled(spark):
    rows = weeks(range(10, 22))
    del rows[5]
    got = detect.rolling_baseline(series(spark, rows)).orderBy("week_start_date").collect()
    assert got[-1].baseline_count == 8
    assert got[-1].baseline_avg == pytest.approx(sum(r[3] for r in rows[-9:-1]) / 8)


def test_series_do_not_mix_and_order_of_rows_is_irrelevant(spark):
    a, b = weeks([1, 2, 3, 4, 5, 60], metric="A"), weeks([9, 8, 7, 6, 5, 4], metric="B")
    alone = {tuple(r) for r in detect.detect_anomalies(series(spark, a)).collect()}
    mixed = detect.detect_anomalies(series(spark, list(reversed(a + b)))).where("metric = 'A'")
    assert {tuple(r) for r in mixed.collect()} == alone


def test_empty_input(spark):
    summary = detect.detect_anomalies(series(spark, []))
    assert summary.count() == 0 and tuple(summary.columns) == detect.OUTPUT
    assert detect.top_anomalies(summary).count() == 0


def test_cusum_goes_on_from_a_given_state(spark):
    rng = np.random.default_rng(7)
    z = rng.normal(0, 1.5, 60)
    rows = [("S", "M", MONDAY + dt.timedelta(weeks=i), float(v)) for i, v in enumerate(z)]
    df = spark.createDataFrame(rows, "source_table string, metric string, week_start_date date, z_score double")
    whole = detect.cusum(df).orderBy("week_start_date").collect()
    cut = MONDAY + dt.timedelta(weeks=25)
    state = whole[24]
    rest = detect.cusum(
        df.where(F.col("week_start_date") >= cut), start_high=F.lit(state.cusum_high), start_low=F.lit(state.cusum_low)
    )
    for a, b in zip(rest.orderBy("week_start_date").collect(), whole[25:]):
        assert a.cusum_high == pytest.approx(b.cusum_high, abs=1e-9)
        assert a.cusum_low == pytest.approx(b.cusum_low, abs=1e-9)


def test_invariants_on_test_data(spark, sf_dir):
    from weftmark.plans import inputs

    summary = detect.detect_anomalies(inputs.channel_series(spark, sf_dir))
    bad = summary.where(
        "cusum_high < 0 OR cusum_low < 0 OR bayes_change_prob NOT BETWEEN 0.5 AND 1 OR n_agreeing_layers > 5"
    )
    assert bad.count() == 0
    spiked = summary.where("week_start_date = '2001-03-05' AND metric = 'GDV'").first()
    assert (spiked.direction, spiked.severity) == ("SPIKE", "CRITICAL")


def test_all_windows_share_one_shuffle(spark, sf_dir):
    """From the aggregated series on there is one exchange, however many windows follow."""
    rows = series(spark, weeks(range(20)))
    plan = detect.detect_anomalies(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
