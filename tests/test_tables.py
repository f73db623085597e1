from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftmark.config import DetectorParams
from weftmark.functions import quantiles
from weftmark.functions.bitmaps import rows_in_map
from weftmark.functions.quantiles import exact_quantiles, value_counts
from weftmark.operators import clean, facts, facts_store, gate, marts, metrics, profile
from weftmark.plans import inputs, medallion
from weftmark.sources import catalog, files

ORDERS = "order_id bigint, customer_id bigint, product_id bigint, order_date string, quantity int, unit_price string, channel string"
CUSTOMERS = "customer_id bigint, name string, email string, country string, signup_date date"
PRODUCTS = "product_id bigint, product_name string, category string, list_price double"


@pytest.fixture(scope="module")
def raw(spark):
    orders = spark.createDataFrame(
        [
            (1, 1, 1, "2024-01-01", 2, "10.50", "web"),
            (2, 1, 2, "2024-01-07", 1, "3.00", "web"),
            (3, 2, 1, "2024-01-08", -1, "10.50", "mobile"),
            (4, 2, 9, "2024-02-01", 3, "N/A", "mobile"),
            (5, 2, 2, "2024-02-02", 4, "1.25", "partner"),
            (6, 3, 2, None, 1, None, "web"),
        ],
        ORDERS,
    )
    day = dt.date(2024, 1, 1)
    customers = spark.createDataFrame(
        [(1, "A", None, "US", day), (1, "A", None, "US", day), (2, "B", "b@x.com", "IN", day), (9, "Z", "z@x.com", "IN", day)],
        CUSTOMERS,
    )
    products = spark.createDataFrame([(1, "P", "Toys", 10.5), (2, "Q", "Food", 3.0), (3, "R", None, 1.0)], PRODUCTS)
    return {"orders": orders, "customers": customers, "products": products}


def test_silver_keeps_all_rows_and_clean_drops_them(raw):
    silver = clean.silver_orders(raw["orders"]).orderBy("order_id").collect()
    assert [(r.quantity, None if r.unit_price is None else float(r.unit_price)) for r in silver] == [
        (2, 10.5), (1, 3.0), (None, 10.5), (3, None), (4, 1.25), (1, None),
    ]
    assert [float(r.revenue) for r in clean.orders_clean(raw["orders"]).orderBy("order_id").collect()] == [21.0, 3.0, 5.0]


def test_quality_report_counts_null_category_as_good(raw):
    row = clean.silver_quality_report(raw["orders"], raw["customers"], raw["products"]).first()
    assert row.asDict() == {
        "total_orders": 6, "bad_quantity": 1, "bad_price": 2, "null_dates": 1, "total_customers": 4,
        "duplicate_customers": 1, "total_products": 3, "bad_categories": 1,
    }
    kinds = [r.category for r in clean.silver_products(raw["products"]).orderBy("product_id").collect()]
    assert kinds == ["Toys", "Other", "Other"]


def test_medallion(spark, raw):
    made = medallion.medallion(raw)
    weekly = [tuple(r) for r in made["gold_weekly_sales"].orderBy("week").collect()]
    assert weekly == [(dt.date(2024, 1, 1), 24.0, 2, 1), (dt.date(2024, 1, 29), 5.0, 1, 1)]
    people = {r.customer_id: r for r in made["gold_customer_metrics"].collect()}
    assert people[1].avg_order_value == 12.0 and people[1].total_orders == 2
    assert (people[9].total_orders, people[9].lifetime_value) == (0, None)
    kinds = {r.category: r.revenue for r in made["gold_category_performance"].collect()}
    assert kinds == {"Toys": 21.0, "Other": 8.0}


def test_reports(raw):
    facts_row = marts.executive_facts(raw["orders"]).first()
    assert (facts_row.periods, facts_row.total_revenue, facts_row.latest_revenue, facts_row.trend) == (2, 29.0, 5.0, "down")
    assert (facts_row.bad_quantity_pct, facts_row.bad_price_pct, facts_row.repeat_rate) == (16.7, 33.3, 66.7)
    assert marts.repeat_customer_rate(raw["orders"]).first().repeat_customer_pct == 66.7
    assert marts.top_products(raw["orders"], raw["products"], 1).first().product_name == "P"
    even = marts.breakeven_by_group(raw["orders"].where("channel = 'web'"), 5.0, 2).first()
    assert even.net == 24.0 / 2 - 5 and even.payback_month == 1


def test_metrics(spark, raw):
    registry = metrics.MetricRegistry(medallion.metric_tables(medallion.medallion(raw)))
    assert len(registry.list_metrics()) == 6 and registry.get("nope") is None
    assert registry.resolve("total_revenue").first().total_revenue == 29.0
    by = {r.country: r.total_revenue for r in registry.resolve("total_revenue", ["country"]).collect()}
    assert by == {"US": 24.0, "IN": 5.0}
    assert registry.from_entries([{"name": "n", "sql": "SELECT count(*) AS n FROM {silver_products}"}]) == 1
    assert registry.resolve("n").first().n == 3
    with pytest.raises(KeyError):
        registry.resolve("nope")
    with pytest.raises(ValueError):
        registry.resolve("avg_order_value", ["country"])


def test_findings(raw):
    nulls = {(r.table_name, r.column_name): r.severity for r in profile.null_findings(raw).collect()}
    assert nulls["orders", "order_date"] == "high" and ("orders", "order_id") not in nulls
    assert [(r.table_name, r.value) for r in profile.duplicate_rows(raw).collect()] == [("customers", 1)]
    words = {r.column_name: r.description for r in profile.data_dictionary({"orders": raw["orders"], "x": raw["products"]}).collect()}
    assert words["order_id"] == "Unique order identifier" and words["list_price"] == "—"


def test_series_checks_need_enough_weeks(spark):
    def orders(values):
        rows = [(i, 1, 1, str(dt.date(2024, 1, 1) + dt.timedelta(weeks=i)), 1, str(v), "web") for i, v in enumerate(values)]
        return spark.createDataFrame(rows, ORDERS)

    assert profile.pct_change_anomalies(orders([1, 100, 1])).count() == 0
    jumps = profile.pct_change_anomalies(orders([10, 10, 16, 10, 40])).orderBy("week").collect()
    assert [(r.severity, round(r.size, 1)) for r in jumps] == [("medium", 60.0), ("high", 300.0)]
    assert profile.zscore_anomalies(orders([1, 1, 1, 99])).count() == 0
    odd = profile.zscore_anomalies(orders([10] * 12 + [90])).collect()
    assert [(r.metric, r.severity) for r in odd] == [("GDV", "high")]
    assert profile.zscore_anomalies(orders([10] * 12)).count() == 0  # no deviation at all


@pytest.mark.parametrize(
    "values",
    [
        [5.0], [1.0, 2.0], [3.0] * 40, list(np.random.default_rng(0).normal(0, 1, 999)),
        list(np.random.default_rng(1).integers(-5, 5, 500).astype(float)), [0.0] * 300 + [1e12, -1e12, 3.5],
        list(np.random.default_rng(2).lognormal(0, 6, 701)),
    ],
)
def test_exact_quantiles_equal_numpy(spark, values):
    values = [float(v) for v in values]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double").repartition(5)
    row = exact_quantiles(value_counts(df, "x"), [0.25, 0.5, 0.75, 0.0, 1.0]).first()
    assert row.total == len(values)
    for i, p in enumerate([25, 50, 75, 0, 100]):
        assert row[f"q{i}"] == pytest.approx(np.percentile(values, p), rel=1e-12, abs=1e-12)


def test_one_far_value_leaves_slices_even(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "VALUES_EACH", 500)
    sizes = []
    write = quantiles.materialize

    def seen(df, name):
        out = write(df, name)
        if name == "value-slices":
            sizes.extend(r["count"] for r in out.groupBy("s").count().collect())
        return out

    monkeypatch.setattr(quantiles, "materialize", seen)
    values = [*np.random.default_rng(3).uniform(0, 2000, 9999).tolist(), 1e13]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(5)
    row = exact_quantiles(value_counts(df, "x"), [0.25, 0.75]).first()
    assert (row.q0, row.q1) == pytest.approx(tuple(np.percentile(values, [25, 75])), rel=1e-12)
    assert max(sizes) < 1500 and len(sizes) > 10
    # also of a frame that is no stored table
    pairs = df.groupBy(df.x.alias("v")).count().withColumnRenamed("count", "c")
    assert exact_quantiles(pairs, [0.25]).first().q0 == row.q0


def test_iqr_outliers_of_few_prices(spark, raw):
    assert profile.iqr_outliers(raw["orders"].where("order_id < 4")).count() == 0
    rows = [(i, 1, 1, "2024-01-01", 1, p, "web") for i, p in enumerate(["1", "2", "3", "4", "5", "99", "N/A"])]
    row = profile.iqr_outliers(spark.createDataFrame(rows, ORDERS)).first()
    assert (row.outliers, row.total, row.lower_bound, row.upper_bound) == (1, 6, -1.5, 8.5)


def test_roles_prefer_keyword_order_then_column_order(spark):
    df = spark.createDataFrame([], "created_at timestamp, week_label string, report_date date, amount double, goal_amount double, source string, utm_source string")
    assert gate.pick_role(df.schema, "date") == "created_at"
    assert gate.pick_role(df.schema, "gdv") == "goal_amount"
    assert gate.pick_role(df.schema, "source") == "utm_source"
    assert gate.pick_role(df.schema, "click") is None
    rows = gate.role_profile(catalog.catalog_columns({"t": df})).collect()
    assert {r.role: r.column_name for r in rows} == {
        role: gate.pick_role(df.schema, role) for role in gate.ROLE_KEYWORDS if gate.pick_role(df.schema, role)
    }
    plain = spark.createDataFrame([], "ts timestamp, other date")
    assert gate.pick_role(plain.schema, "date") == "ts"


def test_gate_issues_are_never_fatal(spark, raw):
    tables = {"orders": raw["orders"], "gone": None}
    keywords = {**gate.ROLE_KEYWORDS, "gdv": ("unit_price",)}
    issues = gate.quality_gate(tables, DetectorParams(), keywords)
    assert {r.check for r in issues.collect()} == {"row_count", "metric_type"}
    passed = gate.gate_passed(issues).first()
    assert passed.issues == 3 and passed.passed


def test_facts_respect_roles_and_bounds(spark):
    df = spark.createDataFrame(
        [("2024-01-03", "u1", "5.5"), ("2024-01-04", "u1", "bad"), ("2024-01-10", "u2", "1"), ("nonsense", "u3", "9"), (None, "u3", "9")],
        "day string, who string, paid string",
    )
    roles = facts.Roles(date="day", fundraiser="who", gdv="paid", view="who")
    rows = facts.weekly_facts(df, "T", roles).orderBy("week_start_date").collect()
    assert [(r.week_start_date, r.fundraisers, r.gdv, r.views, r.cost) for r in rows] == [
        (dt.date(2024, 1, 1), 1.0, 5.5, 2.0, None), (dt.date(2024, 1, 8), 1.0, 1.0, 1.0, None),
    ]
    cut = facts.weekly_facts(df, "T", roles, until="2024-01-10", lookback_weeks=1)
    assert cut.count() == 1
    assert facts.weekly_facts(df, "T", facts.Roles()) is None
    with pytest.raises(ValueError):
        facts.weekly_facts_union([None])
    zero = facts.weekly_series(facts.weekly_facts(df, "T", roles)).where("metric = 'COST'").collect()
    assert [r.value for r in zero] == [0.0, 0.0]


def test_date_bounds_reach_the_scan(spark, sf_dir):
    from weftmark.plans import inputs

    bounded = inputs.event_facts(spark, sf_dir, until="2024-01-31", lookback_weeks=2)
    plan = bounded._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :]
    assert "GreaterThanOrEqual(ts,2024-01-17" in pushed and "LessThan(ts,2024-01-31" in pushed
    whole = inputs.event_facts(spark, sf_dir)
    inside = whole.where("week_start_date >= '2024-01-17' AND week_start_date < '2024-01-31'")
    assert bounded.exceptAll(inside).count() == 0 and bounded.count() == inside.count() > 0
    by_dates = facts.weekly_facts_by_dates(
        inputs.event_rows(spark, sf_dir), {"EVENTS": "ts"}, inputs.EVENT_ROLES, until="2024-01-31", lookback_weeks=2, period="day"
    )
    assert by_dates.exceptAll(bounded).count() == 0 and by_dates.count() == bounded.count()


def test_one_pass_over_several_dates_equals_separate_passes(spark, sf_dir):
    from weftmark.plans import inputs

    lines = inputs.fact_lines(spark, sf_dir)
    both = facts.weekly_facts_by_dates(lines, {"ORDERS": "order_date", "SHIPMENTS": "ship_date"}, inputs.ORDER_ROLES)
    from dataclasses import replace

    single = facts.weekly_facts(lines, "SHIPMENTS", replace(inputs.ORDER_ROLES, date="ship_date"))
    assert both.where("source_table = 'SHIPMENTS'").exceptAll(single).count() == 0
    assert both.where("source_table = 'SHIPMENTS'").count() == single.count()


# -- sources ----------------------------------------------------------------------------------------------------


def test_csv_types_are_inferred_or_given(spark, tmp_path):
    (tmp_path / "orders.csv").write_text(
        "order_id,customer_id,product_id,order_date,quantity,unit_price,channel\n1,2,3,2024-01-01,4,N/A,web\n2,2,3,2024-01-02,4,1.5,web\n"
    )
    inferred = files.read_csv_tables(spark, str(tmp_path), ["orders"])["orders"]
    assert dict(inferred.dtypes)["unit_price"] == "string" and dict(inferred.dtypes)["order_date"] == "date"
    given = files.read_csv_tables(spark, str(tmp_path), ["orders"], files.RAW_SCHEMAS)["orders"]
    assert dict(given.dtypes)["order_id"] == "bigint" and given.count() == 2


def test_schema_hash_and_drift(spark, raw):
    orders = raw["orders"]
    assert catalog.schema_hash(orders) == catalog.schema_hash(orders.select(*reversed(orders.columns)))
    assert catalog.schema_hash(orders) != catalog.schema_hash(orders.drop("channel"))
    old = catalog.bronze_manifest({"orders": orders})
    assert catalog.schema_drift(old, old).count() == 0


def test_adhoc_sql_gives_all_rows_unless_a_limit_is_asked(spark, raw):
    many = {"orders": spark.range(80).toDF("order_id"), "products": raw["products"]}
    assert files.adhoc_sql(spark, "SELECT * FROM {orders} ORDER BY order_id", many).count() == 80
    assert files.adhoc_sql(spark, "SELECT * FROM {orders} ORDER BY order_id", many, limit=50).count() == 50
    assert files.sample_rows(raw["products"], ["product_id"], 2).collect()[1].list_price == "3.0"


def test_provenance_and_skipped_empty_table(spark, raw):
    name = files.save_with_provenance(raw["products"], "kept_products", "it's a test")
    note = files.read_provenance(spark, name)
    assert note["row_count"] == 3 and note["description"] == "it's a test" and note["columns"][0] == "product_id"
    files.save_with_provenance(raw["products"].where("false"), "kept_products")
    assert spark.table("kept_products").count() == 3
    files.save_with_provenance(spark.table("kept_products").where(F.col("product_id") == 1), "kept_products")
    assert spark.table("kept_products").count() == 1


def test_event_log_lines_keep_microseconds(spark, sf_dir, tmp_path):
    from weftmark.plans import inputs

    events = inputs.run_events(spark, sf_dir)
    files.write_event_log(events, str(tmp_path / "log"))
    assert files.read_event_log(spark, str(tmp_path / "log")).exceptAll(events).count() == 0
    (tmp_path / "extra").mkdir()
    (tmp_path / "extra" / "a.json").write_text('{"event_id": 1, "run_id": 2}\n{broken\n')
    rows = files.read_event_log(spark, str(tmp_path / "extra")).collect()
    assert sorted((r.event_id, r.ts) for r in rows if r.event_id) == [(1, None)] and len(rows) == 2


def test_working_folder_follows_the_session(spark):
    from types import SimpleNamespace

    from weftmark.session import CHECKPOINT_CONF, workspace

    assert workspace(spark, "x").startswith(spark.conf.get(CHECKPOINT_CONF))

    def bare(master, **conf):
        values = {"spark.sql.warehouse.dir": "file:/tmp/wh", "spark.master": master, **conf}
        get = lambda key, *default: values.get(key, *default)
        return SimpleNamespace(conf=SimpleNamespace(get=get), sparkContext=SimpleNamespace(applicationId="app-1"))

    first, second = workspace(bare("local[2]"), "x"), workspace(bare("local[2]"), "x")
    assert first.startswith("file:/tmp/wh/_work/")
    assert workspace(bare("yarn", **{"spark.sql.warehouse.dir": "hdfs://n/wh"}), "x").startswith("hdfs://n/wh/_work/")
    with pytest.raises(ValueError, match="share"):
        workspace(bare("yarn"), "x")
    assert first != second and first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


def test_duplicates_are_compared_as_whole_rows(spark, monkeypatch):
    """Rows with nulls in other places and equal texts across columns differ; hashes that meet by chance do not matter."""
    rows = [(1, None, "a"), (None, 1, "a"), (1, None, "a"), (2, 3, None), (2, 3, None), (2, 3, None), (4, 4, "b"), (None, None, None)]
    df = spark.createDataFrame(rows, "x int, y int, `z.z` string")
    tables = {"t": df, "u": df.dropDuplicates(), "v": df.where("false"), "w": df.union(df)}
    want = {"t": 3, "w": 11}
    assert {r.table_name: r.value for r in profile.duplicate_rows(tables).collect()} == want
    monkeypatch.setattr(profile, "_row_hashes", lambda df: [F.lit(7).cast("bigint"), F.lit(8).cast("bigint")])
    assert {r.table_name: r.value for r in profile.duplicate_rows(tables).collect()} == want


def test_few_rows_are_moved_as_a_whole(spark):
    """Of many different rows only those with a repeated hash pass the map, and a few by chance."""
    df = spark.range(20_000).selectExpr("id % 19990 AS a", "concat('row ', id % 19990) AS b")
    hashed = df.select(*[h.alias(n) for h, n in zip(profile._row_hashes(df), ("h1", "h2"))])
    repeated = hashed.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
    own = df.select("*", *[h.alias(n) for h, n in zip(profile._row_hashes(df), ("h1", "h2"))])
    assert 20 <= rows_in_map(own, F.col("h1"), repeated, "h1").count() <= 40
    assert tuple(profile.repeated_rows(df, repeated).first()) in {(20 + i, 10 + i) for i in range(21)}
    assert profile.duplicate_rows({"t": df}).first().value == 10


def test_no_row_is_left_out_of_the_facts(spark, sf_dir):
    """Every valid line counts once by its order and once by its shipment, every event once, and all sources end together."""
    lines, events = inputs.fact_lines(spark, sf_dir), spark.read.parquet(f"{sf_dir}/events.parquet")
    got = inputs.all_facts(spark, sf_dir).groupBy("source_table").agg(
        F.sum("completes").alias("n"), F.max("week_start_date").alias("last"), F.sum("views").alias("views")
    )
    got = {r.source_table: r for r in got.collect()}
    assert got["ORDERS"].n == got["SHIPMENTS"].n == lines.count()
    assert got["EVENTS"].views == events.where("event_type = 'view'").count()
    assert got["SHIPMENTS"].last == got["EVENTS"].last == got["ORDERS"].last


def test_sets_of_dimensions_equal_single_queries(spark, raw):
    registry = metrics.MetricRegistry(medallion.metric_tables(medallion.medallion(raw)))
    registry.register(
        "people", source="valid_orders", wide_source="valid_orders_by_country", dimensions=("channel", "country"),
        parts=[("n", "distinct", "customer_id"), ("most", "max", "revenue")], formula="n * 1000 + most",
    )
    registry.register("plain", source="valid_orders", measure="count(DISTINCT customer_id) * 1000 + max(revenue)", dimensions=("channel",))
    for name, alias in (("total_revenue", "total_revenue"), ("avg_order_value", "avg_order_value"), ("customer_lifetime_value_avg", "avg_lifetime_value")):
        sets = registry.resolve_sets(name)
        for label in {r.dimension_set for r in sets.collect()}:
            dims = label.split(",") if label else []
            one = {tuple(r) for r in registry.resolve(name, dims).select(*dims, alias).collect()}
            assert {tuple(r) for r in sets.where(F.col("dimension_set") == label).select(*dims, alias).collect()} == one
    got = registry.resolve_sets("people", [[], ["channel"]])
    assert {tuple(r) for r in got.where("dimension_set = 'channel'").select("channel", "people").collect()} == {
        tuple(r) for r in registry.resolve("plain", ["channel"]).collect()
    }
    assert got.where("dimension_set = ''").first().people == registry.resolve("plain").first().plain == registry.resolve("people").first().people


def test_the_source_is_scanned_once_and_not_copied_for_each_set(spark, raw):
    registry = metrics.MetricRegistry(medallion.metric_tables(medallion.medallion(raw)))
    plan = registry.resolve_sets("total_revenue")._jdf.queryExecution().optimizedPlan().toString()
    # the copies are made above an aggregate, not above the rows
    assert plan.count("Expand") == 1 and "Aggregate" in plan[plan.index("Expand") :]


def test_metrics_that_cannot_be_put_together(spark, raw):
    registry = metrics.MetricRegistry(medallion.metric_tables(medallion.medallion(raw)))
    with pytest.raises(ValueError, match="no parts"):
        registry.resolve_sets("weekly_active_customers")
    with pytest.raises(ValueError, match="no dimension"):
        registry.resolve_sets("total_revenue", [["week"]])
    with pytest.raises(ValueError, match="put together"):
        registry.register("m", source="valid_orders", parts=[("x", "median", "revenue")], formula="x")


def test_broken_metric_file_names_the_place(raw):
    pytest.importorskip("yaml")
    registry = metrics.MetricRegistry(raw)
    with pytest.raises(ValueError, match="line 4"):
        registry.from_yaml("metrics:\n  - name: a\n    sql: 'SELECT 1\n")
    assert registry.from_yaml("other: 1") == 0


@pytest.mark.parametrize("kind", ["uniform", "skewed", "few"])
def test_quantile_sketch_keeps_its_rank_error(spark, kind):
    rng = np.random.default_rng(7)
    values = {"uniform": rng.uniform(0, 100, 30_000), "skewed": rng.lognormal(0, 2, 30_000), "few": rng.integers(0, 4, 30_000)}[kind].round(4)
    rows = spark.createDataFrame([(f"{v:.4f}",) for v in values] + [("N/A",), (None,)], "unit_price string").repartition(8)
    row = profile.iqr_outliers_sketch(rows).first()
    assert row.total == 30_000
    for bound, rank in ((row.q1, 0.25), (row.q3, 0.75)):
        assert (values < bound).mean() <= rank + profile.SKETCH_ERROR and (values <= bound).mean() >= rank - profile.SKETCH_ERROR
    outside = ((values < row.lower_bound) | (values > row.upper_bound)).sum()
    assert abs(int(outside) - row.outliers) <= 2 * profile.SKETCH_ERROR * 30_000
    assert profile.iqr_outliers_sketch(rows.limit(0)).count() == 0


FACT_ROWS = "day date, who bigint, country string, amount decimal(10,2), hits int"
FACT_ROLES = facts.Roles(date="day", fundraiser="who", country="country", gdv="amount", complete="who", view="hits")


def fact_rows(spark, seed, n=300):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        who = None if rng.random() < 0.1 else int(rng.choice([rng.integers(-5, 60), rng.integers(0, 2**40)]))
        day = None if rng.random() < 0.05 else dt.date(2024, 1, 1) + dt.timedelta(days=int(rng.integers(0, 40)))
        rows.append((day, who, [None, "a", "b"][rng.integers(3)], None if rng.random() < 0.1 else Decimal(int(rng.integers(-500, 9000))) / 100, int(rng.integers(5))))
    return spark.createDataFrame(rows, FACT_ROWS)


def same_facts(a, b):
    return sorted(map(tuple, a.select(b.columns).collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_updated_facts_equal_all_at_once(spark, tmp_path):
    path = str(tmp_path / "facts")
    parts = [fact_rows(spark, seed) for seed in range(3)]
    for batch, part in enumerate(parts):
        facts_store.update_facts(part, "T", FACT_ROLES, path, batch)
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    assert same_facts(facts_store.read_facts(spark, path), facts.weekly_facts(whole, "T", FACT_ROLES))
    # a batch that is run again under its number, with other rows, replaces itself
    facts_store.update_facts(parts[1].where("day < '2024-01-20'"), "T", FACT_ROLES, path, 1)
    whole = parts[0].unionByName(parts[1].where("day < '2024-01-20'")).unionByName(parts[2])
    assert same_facts(facts_store.read_facts(spark, path), facts.weekly_facts(whole, "T", FACT_ROLES))
    facts_store.update_facts(parts[0].where("false"), "T", FACT_ROLES, path, 3)
    assert same_facts(facts_store.read_facts(spark, path), facts.weekly_facts(whole, "T", FACT_ROLES))


def test_a_batch_touches_only_its_weeks(spark, tmp_path):
    path = str(tmp_path / "facts")
    rows = fact_rows(spark, 1)
    facts_store.update_facts(rows, "T", FACT_ROLES, path, 0)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "facts" / "facts").rglob("*.parquet")}
    week = facts_store.update_facts(rows.where("day BETWEEN '2024-01-15' AND '2024-01-21'"), "T", FACT_ROLES, path, 1)
    assert {r.week_start_date for r in week.collect()} == {dt.date(2024, 1, 15)}
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "facts" / "facts").rglob("*.parquet")}
    changed = {p.parent.name for p in now.keys() ^ before.keys()}
    assert changed == {"week_start_date=2024-01-15"} and all(now[p] == t for p, t in before.items() if p in now)
    # a week that loses all its rows goes
    facts_store.update_facts(rows.where("day < '2024-01-08'"), "T", FACT_ROLES, path, 0)
    weeks = {r.week_start_date for r in facts_store.read_facts(spark, path).collect()}
    assert weeks == {dt.date(2024, 1, 1), dt.date(2024, 1, 15)}
    with pytest.raises(ValueError, match="whole numbers"):
        facts_store.update_facts(rows.withColumn("who", F.col("country")), "T", FACT_ROLES, path, 2)


def test_fact_rows_are_dealt_by_fundraiser(spark, sf_dir, monkeypatch):
    """Tasks follow the number of rows, each fundraiser stands in one of them, and no row is lost."""
    monkeypatch.setattr(facts, "TASK_ROWS", 500)
    rows = inputs.fact_lines(spark, sf_dir)
    lines = inputs.read(spark, sf_dir, "lineitem").count()
    assert rows.rdd.getNumPartitions() >= lines / 500 > 4
    places = rows.select("customer_id", F.spark_partition_id().alias("task")).distinct()
    assert places.count() == rows.select("customer_id").distinct().count()
    monkeypatch.setattr(facts, "TASK_ROWS", 1 << 20)
    assert rows.count() == inputs.fact_lines(spark, sf_dir).count()
    assert inputs.event_rows(spark, sf_dir).count() == inputs.read(spark, sf_dir, "events").count()


def test_facts_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    """Rows without a fundraiser, and one fundraiser with most rows; the distinct count moves dealt rows no more."""
    rows = fact_rows(spark, 7).unionByName(fact_rows(spark, 8, 500).withColumn("who", F.lit(3).cast("bigint")))
    want = facts.weekly_facts(rows, "T", FACT_ROLES)
    for each, tasks in ((50, 16), (1 << 20, 1)):
        monkeypatch.setattr(facts, "TASK_ROWS", each)
        dealt = facts.deal_by_fundraiser(rows, "who", rows.count())
        got = facts.weekly_facts(dealt, "T", FACT_ROLES)
        assert dealt.rdd.getNumPartitions() == tasks and same_facts(got, want)
        assert got._jdf.queryExecution().executedPlan().toString().count("Exchange ") == min(2, tasks)


def test_events_are_dealt_by_user(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(facts, "TASK_ROWS", 100)
    rows = inputs.event_rows(spark, sf_dir)
    assert rows.rdd.getNumPartitions() >= inputs.read(spark, sf_dir, "events").count() / 100 > 4
    places = rows.select("user_id", F.spark_partition_id().alias("task")).distinct()
    assert places.count() == rows.select("user_id").distinct().count()


def test_lines_are_dealt_ahead_of_the_join_with_orders(spark, sf_dir, monkeypatch):
    """The join's tasks follow the number of lines where they ask for more than Spark's; few lines are left to Spark, and rows stay."""

    def dealt(rows):
        return re.findall(r"hashpartitioning\(l_orderkey#\d+L, (\d+)\), REPARTITION", rows._jdf.queryExecution().executedPlan().toString())

    want, lines = inputs.fact_lines(spark, sf_dir), inputs.read(spark, sf_dir, "lineitem").count()
    assert dealt(want) == []
    monkeypatch.setattr(facts, "TASK_ROWS", 500)
    got = inputs.fact_lines(spark, sf_dir)
    assert dealt(got) == [str(-(-lines // 500))] and lines > 4 * 500
    assert got.count() == want.count() and got.exceptAll(want).isEmpty()


def test_many_parts_are_not_broadcast(spark, sf_dir, monkeypatch):
    """Parts beyond a number of rows are sorted and merged in tasks that follow the number of lines, and rows stay; fewer are left to Spark."""

    def joins(rows):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        return re.findall(r"(\w+Join) \[l_partkey", plan), re.findall(r"hashpartitioning\(l_partkey#\d+L, (\d+)\), REPARTITION", plan)

    monkeypatch.setattr(facts, "TASK_ROWS", 500)
    want, raw = inputs.fact_lines(spark, sf_dir), inputs.raw_orders(spark, sf_dir)
    assert joins(want) == joins(raw) == (["BroadcastHashJoin"], [])
    monkeypatch.setattr(inputs, "BROADCAST_ROWS", inputs.read(spark, sf_dir, "part").count() - 1)
    tasks = str(-(-inputs.read(spark, sf_dir, "lineitem").count() // 500))
    for got, same in ((inputs.fact_lines(spark, sf_dir), want), (inputs.raw_orders(spark, sf_dir), raw)):
        assert joins(got) == (["SortMergeJoin"], [tasks])
        assert got.count() == same.count() and got.exceptAll(same).isEmpty() and same.exceptAll(got).isEmpty()
