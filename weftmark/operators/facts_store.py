"""Weekly facts that are kept up to date batch by batch.

Every batch leaves the state of its own rows: for each period and segment the exact sums and counts, and the distinct fundraisers as
bitmaps, a page of 32,768 numbers each. States can be put together: sums are added, bitmaps joined bit by bit, so distinct counts stay
exact however the rows of a fundraiser are spread over batches. After a batch, only the facts of the periods that it touches are made
anew, from the states of these periods.

    <path>/state/batch=N/week_start_date=W
    <path>/facts/week_start_date=W

A batch reads its own rows and the small states of its periods, never the rows of earlier batches. A batch that is run again under its
number replaces itself. There is one writer at a time. Fundraisers must be whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmark.config import DIMENSIONS, PERIOD
from weftmark.operators.clean import safe_number_sum, safe_timestamp
from weftmark.operators.facts import Roles, count_or_sum, within
from weftmark.operators.marts import week_of
from weftmark.session import materialize

_SUMS = ("gdv", "nac2", "completes", "views", "clicks", "cost")
_KEY = ("source_table", PERIOD, *DIMENSIONS)
_WHOLE = ("byte", "short", "integer", "long")
_NO_PAGE = -1


def _measures(df: DataFrame, roles: Roles) -> dict[str, Column]:
    def optional(column: str | None, build, kind: str) -> Column:
        return (F.lit(None) if column is None else build(column)).cast(kind)

    exact = "decimal(38,6)"
    return {
        "gdv": optional(roles.gdv, lambda c: safe_number_sum(df, c), exact),
        "nac2": optional(roles.nac2, F.count, exact),
        "completes": optional(roles.complete, F.count, exact),
        "views": count_or_sum(df, roles.view).cast(exact),
        "clicks": count_or_sum(df, roles.click).cast(exact),
        "cost": optional(roles.cost, lambda c: safe_number_sum(df, c), exact),
    }


def batch_state(df: DataFrame, source: str, roles: Roles, period: str = "week") -> DataFrame:
    """State of rows: one row for each period, segment and page of fundraisers.

    The sums of a segment's rows without a fundraiser stand on a page of their own, so every row counts once.
    """
    if roles.date is None:
        raise ValueError(f"source {source} has no date column")
    if roles.fundraiser is not None and df.schema[roles.fundraiser].dataType.typeName() not in _WHOLE:
        raise ValueError("distinct states need whole numbers as fundraisers")
    moment = safe_timestamp(df, roles.date)
    start = week_of(moment) if period == "week" else F.to_date(F.date_trunc(period, moment))
    dims = [
        (F.lit(None) if column is None else F.col(column)).cast("string").alias(name)
        for column, name in zip((roles.country, roles.device, roles.source), DIMENSIONS)
    ]
    who = (F.lit(None) if roles.fundraiser is None else F.col(roles.fundraiser)).cast("bigint")
    page = F.when(who.isNotNull(), F.bitmap_bucket_number(who))
    marks = F.bitmap_construct_agg(F.bitmap_bit_position(F.coalesce(who, F.lit(0).cast("bigint"))))
    rows = df.where(within(df, roles.date, None, None))
    grouped = rows.groupBy(F.lit(source).alias("source_table"), start.alias(PERIOD), *dims, page.alias("page"))
    state = grouped.agg(*[m.alias(n) for n, m in _measures(df, roles).items()], marks.alias("marks"))
    # with pages or not, a source without a fundraiser role has no count of them
    return state.withColumn("counts", F.lit(roles.fundraiser is not None)).withColumn("marks", F.when(F.col("page").isNotNull(), F.col("marks")))


def facts_of(state: DataFrame) -> DataFrame:
    """The facts that states of any number of batches give."""
    pages = state.groupBy(*_KEY, "page").agg(
        *[F.sum(c).alias(c) for c in _SUMS], F.bitmap_or_agg("marks").alias("marks"), F.max("counts").alias("counts")
    )
    people = F.when(F.max("counts"), F.coalesce(F.sum(F.when(F.col("page").isNotNull(), F.bitmap_count("marks"))), F.lit(0)))
    sums = [F.sum(c).cast("double").alias(c) for c in _SUMS]
    return pages.groupBy(*_KEY).agg(people.cast("double").alias("fundraisers"), *sums)


def update_facts(df: DataFrame, source: str, roles: Roles, path: str, batch: int, period: str = "week") -> DataFrame:
    """Add a batch of rows; gives the facts of the periods that it touches, as they are now."""
    spark = df.sparkSession
    target = f"{path}/state/batch={batch}"
    earlier = _periods(spark, target)
    state = batch_state(df, source, roles, period).withColumn("_day", F.col(PERIOD))
    # a file for each period; a period has as many rows as segments and pages
    state.repartition(PERIOD).write.mode("overwrite").partitionBy(PERIOD).parquet(target)
    # a batch that replaces itself also touches the periods it had before
    touched = sorted({*earlier, *_periods(spark, target)})
    stored = spark.read.option("basePath", f"{path}/state").parquet(f"{path}/state") if touched else None
    if stored is None:
        return facts_of(state.drop("_day"))
    states = stored.where(F.col(PERIOD).isin(touched)).withColumn(PERIOD, F.col("_day")).drop("_day", "batch")
    facts = materialize(facts_of(states), "facts-of-periods")
    gone = [day for day in touched if day not in {r[0] for r in facts.select(PERIOD).distinct().collect()}]
    if gone:
        from weftmark.sources import folders

        for day in gone:
            folders.drop(spark, f"{path}/facts/{PERIOD}={day.isoformat()}")
    kept = facts.withColumn("_day", F.col(PERIOD)).repartition(PERIOD).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    kept.partitionBy(PERIOD).parquet(f"{path}/facts")
    return facts


def _periods(spark: SparkSession, path: str) -> list:
    """The periods that a stored state has: one for each of its folders."""
    from pyspark.errors import AnalysisException

    try:
        return [r[0] for r in spark.read.parquet(path).select("_day").distinct().collect() if r[0] is not None]
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return []


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """The facts of all periods, in the columns of ``weekly_facts``."""
    rows = spark.read.parquet(f"{path}/facts").withColumn(PERIOD, F.col("_day"))
    return rows.select(*_KEY, "fundraisers", *_SUMS)
