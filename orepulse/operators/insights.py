"""Outliers, trends and threshold findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orepulse.functions.numbers import exact_mean
from orepulse.operators.quantiles import exact_quantiles
from orepulse.operators.stats import FREQUENCIES, period_end

DEFAULT_CUTOFF = {"iqr": 1.5, "zscore": 3.0}


def outlier_bounds(df: DataFrame, column: str, method: str = "iqr", threshold: float | None = None) -> tuple[float, float]:
    """Lower and upper bound of ordinary values."""
    cutoff = DEFAULT_CUTOFF[method] if threshold is None else threshold
    if method == "iqr":
        q1, q3 = exact_quantiles(df, [column], (0.25, 0.75))[column]
        if q1 is None:
            return float("-inf"), float("inf")
        return q1 - cutoff * (q3 - q1), q3 + cutoff * (q3 - q1)
    row = df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")).first()
    if row["std"] is None:
        return float("-inf"), float("inf")
    return row["mean"] - cutoff * row["std"], row["mean"] + cutoff * row["std"]


def outlier_rows(df: DataFrame, column: str, *, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """All rows strictly outside the bounds."""
    low, high = outlier_bounds(df, column, method, threshold)
    return df.filter((F.col(column) < F.lit(low)) | (F.col(column) > F.lit(high)))


def detect_outliers(df: DataFrame, column: str, *, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """One summary row; the percentage is over all rows, nulls included."""
    if method not in DEFAULT_CUTOFF:
        raise ValueError("method must be 'iqr' or 'zscore'")
    low, high = outlier_bounds(df, column, method, threshold)
    out = (F.col(column) < F.lit(low)) | (F.col(column) > F.lit(high))
    return df.agg(F.count_if(out).alias("outlier_count"), F.count(F.lit(1)).alias("total_rows")).select(
        F.lit(column).alias("column"),
        F.lit(method).alias("method"),
        F.lit(float(DEFAULT_CUTOFF[method] if threshold is None else threshold)).alias("threshold"),
        "outlier_count",
        "total_rows",
        F.round(F.col("outlier_count") / F.col("total_rows") * 100, 1).alias("outlier_pct"),
        F.round(F.lit(low), 3).alias("lower_bound"),
        F.round(F.lit(high), 3).alias("upper_bound"),
    )


def outlier_samples(
    df: DataFrame,
    column: str,
    order: Sequence[str],
    *,
    entity: str | None = None,
    method: str = "iqr",
    threshold: float | None = None,
    limit: int = 20,
) -> DataFrame:
    """The first outliers in file order."""
    shown = [entity, column] if entity else [column]
    return (
        outlier_rows(df, column, method=method, threshold=threshold)
        .orderBy(*order)
        .limit(limit)
        .select(*order, *[c for c in shown if c not in order])
    )


def detect_trend(df: DataFrame, date_column: str, value: str, *, freq: str = "W", group_by: str | None = None) -> DataFrame:
    """Linear trend of the per-period mean over the periods that have data (at least three).

    The fact rows collapse to one row per period first, so the regression sees a calendar, not a table.
    """
    keys = ["group_value"] if group_by else []
    rows = df.filter(F.col(date_column).isNotNull() & F.col(value).isNotNull())
    if group_by:
        rows = rows.filter(F.col(group_by).isNotNull()).withColumn("group_value", F.col(group_by).cast("string"))
    start = F.date_trunc(FREQUENCIES[freq][0], F.col(date_column))
    per_period = (
        rows.groupBy(*keys, start.alias("_start"))
        .agg(exact_mean(value).alias("y"))
        .withColumn("label", period_end(F.col("_start"), freq))
    )
    order = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("label")
    numbered = per_period.withColumn("x", (F.row_number().over(order) - 1).cast("double"))
    fitted = numbered.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("periods"),
        F.regr_slope("y", "x").alias("slope"),
        F.regr_r2("y", "x").alias("r2"),
        F.min("y").alias("y_min"),
        F.max("y").alias("y_max"),
        F.min_by("y", "label").alias("first"),
        F.max_by("y", "label").alias("last"),
    )
    r2 = F.when(F.col("y_min") == F.col("y_max"), 0.0).otherwise(F.col("r2"))
    change = F.when(F.col("first") == 0, 0.0).otherwise((F.col("last") - F.col("first")) / F.abs("first") * 100)
    direction = (
        F.when((F.abs(change) < 5) | (r2 < 0.3), "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    )
    return fitted.filter(F.col("periods") >= 3).select(
        *keys,
        F.lit(value).alias("value_column"),
        F.lit(freq).alias("freq"),
        "periods",
        F.round("slope", 4).alias("slope_per_period"),
        F.round(r2, 3).alias("r_squared"),
        F.round(change, 1).alias("pct_change_first_to_last"),
        direction.alias("direction"),
    )


def breach(rule: Mapping) -> Column:
    value, limit = F.col(rule["column"]), F.lit(float(rule["threshold"]))
    return {
        ">": value > limit,
        "<": value < limit,
        ">=": value >= limit,
        "<=": value <= limit,
        "==": value == limit,
    }[rule["operator"]]


OPERATORS = (">", "<", ">=", "<=", "==")


def rule_problem(df: DataFrame, rule: Mapping) -> str | None:
    if rule["column"] not in df.columns:
        return f"Column '{rule['column']}' not found"
    if rule["operator"] not in OPERATORS:
        return f"Unknown operator '{rule['operator']}'"
    return None


def check_thresholds(df: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """Breach count and share per rule ``{column, operator, threshold, label}``, all in one aggregation."""
    good = [(i, r) for i, r in enumerate(rules) if rule_problem(df, r) is None]
    wide = df.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(breach(r)).alias(f"b{i}") for i, r in good]
    )
    counted = {i for i, _ in good}
    cells = []
    for i, r in enumerate(rules):
        breaches = F.col(f"b{i}") if i in counted else F.lit(None).cast("bigint")
        cells.append(
            F.struct(
                F.lit(r.get("label") or f"{r['column']} {r['operator']} {r['threshold']}").alias("rule"),
                breaches.alias("breach_count"),
                F.round(breaches / F.col("rows") * 100, 1).alias("breach_pct"),
                F.lit(rule_problem(df, r)).cast("string").alias("error"),
            )
        )
    return wide.select(F.inline(F.array(*cells)))


def threshold_samples(df: DataFrame, rules: Sequence[Mapping], limit: int = 10) -> DataFrame:
    """The ``limit`` smallest breaching values per rule.

    Every rule is a bounded top-k of its own; breaching rows are never gathered.
    """
    parts = []
    for rule in rules:
        if rule_problem(df, rule) is None:
            order = [F.asc("value")]
            smallest = (
                df.filter(breach(rule))
                .select(F.lit(rule.get("label")).alias("rule"), F.col(rule["column"]).cast("double").alias("value"))
                .orderBy(*order)
                .limit(limit)
            )
            parts.append(smallest.select("rule", F.row_number().over(Window.orderBy(*order)).cast("bigint").alias("position"), "value"))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
