"""Descriptive statistics, rankings, calendar series and correlations."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orepulse.functions.numbers import exact_mean, exact_sum
from orepulse.operators.quantiles import exact_quantiles

NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double")


def numeric_columns(df: DataFrame) -> list[str]:
    return [name for name, kind in df.dtypes if kind in NUMERIC_TYPES or kind.startswith("decimal")]


def describe_columns(df: DataFrame, columns: Sequence[str] | None = None, **quantile_options) -> DataFrame:
    """Count, mean, sample std, min, quartiles, max and bias-corrected skewness and kurtosis, 3 decimals.

    Moments of all columns come from one aggregation; quartiles from :func:`exact_quantiles`.
    """
    columns = list(columns or numeric_columns(df))
    quartiles = exact_quantiles(df, columns, (0.25, 0.5, 0.75), **quantile_options)
    aggregates = []
    for i, name in enumerate(columns):
        c = F.col(name).cast("double")
        aggregates += [
            F.count(c).alias(f"n{i}"),
            F.avg(c).alias(f"mean{i}"),
            F.stddev_samp(c).alias(f"std{i}"),
            F.min(c).alias(f"min{i}"),
            F.max(c).alias(f"max{i}"),
            F.skewness(c).alias(f"g1{i}"),
            F.kurtosis(c).alias(f"g2{i}"),
        ]
    rows = []
    for i, name in enumerate(columns):
        n, g1, g2 = F.col(f"n{i}").cast("double"), F.col(f"g1{i}"), F.col(f"g2{i}")
        skew = F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2))
        kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
        q = quartiles[name]
        rows.append(
            F.struct(
                F.lit(name).alias("column"),
                F.col(f"n{i}").alias("count"),
                F.round(f"mean{i}", 3).alias("mean"),
                F.round(f"std{i}", 3).alias("std"),
                F.round(f"min{i}", 3).alias("min"),
                *[F.round(F.lit(v).cast("double"), 3).alias(a) for v, a in zip(q, ("p25", "p50", "p75"))],
                F.round(f"max{i}", 3).alias("max"),
                F.round(skew, 3).alias("skewness"),
                F.round(kurt, 3).alias("kurtosis"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair, each over the rows where both are present, 3 decimals."""
    pairs = list(combinations(columns, 2))
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = []
    for i, (a, b) in enumerate(pairs):
        for left, right in ((a, b), (b, a)):
            cells.append((left, right, F.round(f"r{i}", 3)))
    cells += [(c, c, F.lit(1.0)) for c in columns]
    structs = [F.struct(F.lit(a).alias("left_column"), F.lit(b).alias("right_column"), r.alias("r")) for a, b, r in cells]
    return wide.select(F.inline(F.array(*structs)))


AGGREGATES = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min, "count": F.count}


def aggregate(column: str, how: str) -> Column:
    if how not in AGGREGATES:
        raise ValueError(f"Unknown aggregation '{how}'; use one of {', '.join(AGGREGATES)}")
    if how in ("mean", "sum"):
        return exact_mean(column) if how == "mean" else exact_sum(column)
    return AGGREGATES[how](F.col(column)).cast("double")


def rank_entities(
    df: DataFrame, metric: str, entity: str, *, top_n: int = 10, ascending: bool = False, agg: str = "mean"
) -> DataFrame:
    """The ``top_n`` entities by an aggregate, with sequential ranks; ties go by entity."""
    totals = (
        df.filter(F.col(entity).isNotNull())
        .groupBy(F.col(entity).cast("string").alias("entity"))
        .agg(F.round(aggregate(metric, agg), 3).alias("value"))
        .filter(F.col("value").isNotNull())
    )
    order = [F.col("value").asc() if ascending else F.col("value").desc(), F.col("entity").asc()]
    top = totals.orderBy(*order).limit(top_n)
    return top.select(F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("rank"), "entity", "value")


def fleet_performance_summary(df: DataFrame, metric: str, entity: str, *, n: int = 5) -> DataFrame:
    """Top and bottom ``n`` entities by rounded mean, with the average and spread of those means."""
    means = (
        df.filter(F.col(entity).isNotNull())
        .groupBy(F.col(entity).cast("string").alias("entity"))
        .agg(F.round(aggregate(metric, "mean"), 3).alias("value"))
        .filter(F.col("value").isNotNull())
    )
    overall = means.agg(
        F.round(F.avg("value"), 3).alias("fleet_average"), F.round(F.stddev_samp("value"), 3).alias("fleet_std")
    )
    parts = []
    for side, direction in (("top", F.desc), ("bottom", F.asc)):
        order = [direction("value"), F.asc("entity")]
        side_rows = means.orderBy(*order).limit(n)
        parts.append(
            side_rows.select(
                F.lit(side).alias("side"),
                F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("position"),
                "entity",
                "value",
            )
        )
    return parts[0].unionByName(parts[1]).withColumns(
        {c: overall.select(c).scalar() for c in ("fleet_average", "fleet_std")}
    )


# Calendar frequency codes and the spacing of their period starts.
FREQUENCIES = {"D": ("day", "1 day"), "W": ("week", "7 days"), "ME": ("month", "1 month"), "QE": ("quarter", "3 months")}


def period_end(column: Column, freq: str) -> Column:
    """Date of the last day of the period holding ``column`` (weeks end on Sunday)."""
    start = F.date_trunc(FREQUENCIES[freq][0], column)
    if freq == "D":
        return F.to_date(start)
    if freq == "W":
        return F.date_add(F.to_date(start), 6)
    if freq == "ME":
        return F.last_day(start)
    return F.last_day(F.add_months(F.to_date(start), 2))


def time_series(
    df: DataFrame,
    date_column: str,
    values: Sequence[str],
    *,
    freq: str = "W",
    agg: str = "mean",
    group_by: str | None = None,
    fill_empty: bool = True,
) -> DataFrame:
    """Calendar aggregation labelled by period end, 3 decimals.

    Periods without rows between the first and the last are emitted (sum and count 0, others null)
    unless ``fill_empty`` is off. Rows without a date, or without a group, are dropped.
    """
    unit, step = FREQUENCIES[freq]
    keys = ["group_value"] if group_by else []
    rows = df.filter(F.col(date_column).isNotNull())
    if group_by:
        rows = rows.filter(F.col(group_by).isNotNull()).withColumn("group_value", F.col(group_by).cast("string"))
    rows = rows.withColumn("_start", F.to_date(F.date_trunc(unit, F.col(date_column))))
    series = rows.groupBy(*keys, "_start").agg(*[F.round(aggregate(v, agg), 3).alias(v) for v in values])
    if fill_empty:
        bounds = series.groupBy(*keys).agg(F.min("_start").alias("lo"), F.max("_start").alias("hi"))
        spine = bounds.select(*keys, F.explode(F.expr(f"sequence(lo, hi, interval {step})")).alias("_start"))
        series = spine.join(series, [*keys, "_start"], "left")
        if agg in ("sum", "count"):
            series = series.fillna(0.0, subset=list(values))
    return series.select(*keys, period_end(F.col("_start").cast("timestamp"), freq).alias("period_end"), *values)


def ends_per_group(means: DataFrame, group: str, entity: str, value: str, n: int = 3) -> DataFrame:
    """``group, side, position, entity, value``: the ``n`` highest and lowest entities of every group, ties by entity."""
    sides = []
    for side, direction in (("top", F.desc), ("bottom", F.asc)):
        order = Window.partitionBy(group).orderBy(direction(value), F.asc(entity))
        ranked = means.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= n)
        sides.append(ranked.select(group, F.lit(side).alias("side"), F.col("position").cast("bigint").alias("position"), entity, value))
    return sides[0].unionByName(sides[1])


def first_last_change(df: DataFrame, group: str, value: str, order: Sequence[str]) -> DataFrame:
    """First and last value of every group and the change in percent of the first, one decimal; null on a first value of 0."""
    at = F.struct(*order)
    ends = df.groupBy(group).agg(F.min_by(value, at).alias("first"), F.max_by(value, at).alias("last"))
    return ends.withColumn("pct_change", F.round(F.try_divide(F.col("last") - F.col("first"), F.abs("first")) * 100, 1))
