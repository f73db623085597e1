"""Named business metrics over the silver and gold tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Exact average: the sum is decimal, only the quotient is a double.
_AOV = "floor(CAST(sum(revenue) AS DOUBLE) / count(revenue) * 100 + 0.5) / 100"
_CLV = "floor(CAST(sum(CAST(lifetime_value AS DECIMAL(28,2))) AS DOUBLE) / count(lifetime_value) * 100 + 0.5) / 100"
_REPEAT = "floor(1000.0D * count_if(orders > 1) / count(*) + 0.5) / 10"


@dataclass(frozen=True)
class Metric:
    """``measure`` is an aggregate over ``source``; a metric with ``columns`` is a plain projection instead.

    ``wide_source`` is read in place of ``source`` only for dimensions that ``source`` lacks.
    ``parts`` (name, kind, value) are aggregates that can be put together from those of smaller groups: sum, count, min and max of a
    value, or the number of distinct ones; ``formula`` makes the metric of them.
    """

    name: str
    description: str
    kind: str
    source: str
    measure: str = ""
    columns: tuple[str, ...] = ()
    dimensions: tuple[str, ...] = ()
    alias: str = ""
    sql: str = ""
    wide_source: str = ""
    parts: tuple[tuple[str, str, str], ...] = ()
    formula: str = ""


# How parts of smaller groups are put together.
_TOGETHER = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}

# Names, descriptions and kinds of the built-in metrics.
BUILT_IN = (
    Metric(
        "total_revenue",
        "Total gross revenue from all orders",
        "aggregate",
        "valid_orders",
        measure="CAST(round(sum(revenue), 2) AS DOUBLE)",
        dimensions=("channel", "country"),
        wide_source="valid_orders_by_country",
        parts=(("total", "sum", "revenue"),),
        formula="CAST(round(total, 2) AS DOUBLE)",
    ),
    Metric(
        "avg_order_value",
        "Average value per order",
        "aggregate",
        "valid_orders",
        measure=_AOV,
        dimensions=("channel",),
        parts=(("total", "sum", "revenue"), ("lines", "count", "revenue")),
        formula="floor(CAST(total AS DOUBLE) / lines * 100 + 0.5) / 100",
    ),
    Metric(
        "repeat_customer_rate",
        "Percentage of customers with more than one order",
        "ratio",
        "customer_orders",
        measure=_REPEAT,
    ),
    Metric(
        "weekly_active_customers",
        "Number of unique customers per week",
        "simple",
        "gold_weekly_sales",
        columns=("week", "unique_customers AS weekly_active_customers"),
        dimensions=("week",),
    ),
    Metric(
        "category_revenue_share",
        "Revenue contribution by product category",
        "simple",
        "gold_category_performance",
        columns=("category", "revenue AS category_revenue"),
        dimensions=("category",),
    ),
    Metric(
        "customer_lifetime_value_avg",
        "Average lifetime value across all customers",
        "aggregate",
        "gold_customer_metrics",
        measure=_CLV,
        dimensions=("country",),
        alias="avg_lifetime_value",
        parts=(("total", "sum", "CAST(lifetime_value AS DECIMAL(28,2))"), ("people", "count", "lifetime_value")),
        formula="floor(CAST(total AS DOUBLE) / people * 100 + 0.5) / 100",
    ),
)


@dataclass
class MetricRegistry:
    """Looks metrics up by name and turns them into DataFrames over the given tables."""

    tables: Mapping[str, DataFrame]
    metrics: dict[str, Metric] = field(default_factory=lambda: {m.name: m for m in BUILT_IN})

    def list_metrics(self) -> list[dict[str, str]]:
        return [{"name": m.name, "description": m.description, "type": m.kind} for m in self.metrics.values()]

    def get(self, name: str) -> Metric | None:
        return self.metrics.get(name)

    def register(
        self, name: str, sql: str = "", description: str = "", kind: str = "simple", dimensions: Sequence[str] = (),
        source: str = "", measure: str = "", wide_source: str = "", parts: Sequence[Sequence[str]] = (), formula: str = "",
    ) -> None:
        """Add a metric: SQL with tables in braces, as in ``FROM {silver_orders}``, or a measure over a source table.

        Only a metric with a measure can be grouped by its dimensions, and only one with parts by several sets of them at once.
        """
        if not sql and not (source and (measure or parts)):
            raise ValueError(f"metric {name} needs SQL, or a source and a measure or parts")
        unknown = [k for _, k, _ in parts if k not in (*_TOGETHER, "distinct")]
        if unknown or bool(parts) != bool(formula):
            raise ValueError(f"metric {name} needs a formula of parts that can be put together, not {unknown}")
        self.metrics[name] = Metric(
            name, description, kind, source=source, measure=measure, dimensions=tuple(dimensions), sql=sql, wide_source=wide_source,
            parts=tuple((n, k, v) for n, k, v in parts), formula=formula,
        )

    def from_yaml(self, text: str) -> int:
        """Register the entries of a ``metrics:`` list; returns how many, 0 for text without one.

        Broken text raises an error that names the place.
        """
        try:
            import yaml
        except ImportError as missing:
            raise RuntimeError("metric files need the PyYAML package") from missing
        try:
            loaded = yaml.safe_load(text)
        except yaml.YAMLError as broken:
            at = getattr(broken, "problem_mark", None)
            place = f"line {at.line + 1}, column {at.column + 1}" if at else "unknown place"
            raise ValueError(f"metric file is no YAML at {place}: {getattr(broken, 'problem', broken)}") from broken
        return self.from_entries(loaded.get("metrics", []) if isinstance(loaded, dict) else [])

    def from_entries(self, entries: Sequence[Mapping[str, str]]) -> int:
        for entry in entries:
            self.register(
                entry["name"], entry.get("sql", ""), entry.get("description", ""), entry.get("type", "simple"),
                entry.get("dimensions", ()), entry.get("source_table", ""), entry.get("measure", ""),
                entry.get("wide_source", ""), entry.get("parts", ()), entry.get("formula", ""),
            )
        return len(entries)

    def _known(self, name: str, dimensions: Sequence[str]) -> Metric:
        metric = self.metrics.get(name)
        if metric is None:
            raise KeyError(f"unknown metric: {name}")
        unknown = [d for d in dimensions if d not in metric.dimensions]
        if unknown:
            raise ValueError(f"metric {name} has no dimension {unknown}")
        return metric

    def resolve_sets(self, name: str, sets: Sequence[Sequence[str]] | None = None) -> DataFrame:
        """The metric for several sets of dimensions from one scan; without ``sets``, for all sets of its dimensions.

        Columns: dimension_set (names, joined by commas), the dimensions (null where a set lacks them) and the metric. The source is
        first grouped by all dimensions, and by the value whose distinct ones are counted; only these groups, not the rows
        of the source, are then copied for each set.
        """
        metric = self._known(name, [d for s in sets or () for d in s])
        if not metric.parts:
            raise ValueError(f"metric {name} has no parts")
        if sets is None:
            sets = [c for n in range(len(metric.dimensions) + 1) for c in combinations(metric.dimensions, n)]
        dimensions = [d for d in metric.dimensions if any(d in s for s in sets)]
        counted = [(n, v) for n, k, v in metric.parts if k == "distinct"]
        if len(counted) > 1:
            raise ValueError(f"metric {name} counts distinct values of more than one kind")
        source = self.tables[metric.source]
        if any(d not in source.columns for d in dimensions):
            source = self.tables[metric.wide_source]
        keys = [F.expr(v).alias("_counted") for _, v in counted]
        sums = [getattr(F, k)(F.expr(v)).alias(n) for n, k, v in metric.parts if k != "distinct"]
        groups = source.groupBy(*dimensions, *keys).agg(*(sums or [F.count("*").alias("_rows")]))
        parts = [_TOGETHER[k](n).alias(n) for n, k, _ in metric.parts if k != "distinct"]
        parts += [F.count_distinct("_counted").alias(n) for n, _ in counted]
        label = F.concat_ws(",", *[F.when(F.grouping(d) == 0, d) for d in dimensions]) if dimensions else F.lit("")
        together = groups.groupingSets(sets, *dimensions) if dimensions else groups.groupBy()
        rows = together.agg(label.alias("dimension_set"), *parts)
        return rows.select("dimension_set", *dimensions, F.expr(metric.formula).cast("double").alias(metric.alias or metric.name))

    def resolve(self, name: str, dimensions: Sequence[str] = ()) -> DataFrame:
        """The metric as a DataFrame, grouped by the wanted dimensions."""
        metric = self._known(name, dimensions)
        if metric.parts and not (metric.measure or metric.columns or metric.sql):
            return self.resolve_sets(name, [dimensions]).drop("dimension_set")
        if dimensions and not (metric.measure or metric.columns):
            raise ValueError(f"metric {name} is SQL without a measure and cannot be grouped")
        if metric.sql and not dimensions:
            used = {t: df for t, df in self.tables.items() if "{" + t + "}" in metric.sql}
            session = next(iter(self.tables.values())).sparkSession
            return session.sql(metric.sql, **used)
        source = self.tables[metric.source]
        if metric.columns:
            return source.selectExpr(*metric.columns)
        if any(d not in source.columns for d in dimensions):
            source = self.tables[metric.wide_source]
        measure = F.expr(metric.measure).cast("double").alias(metric.alias or metric.name)
        return source.groupBy(*dimensions).agg(measure)
