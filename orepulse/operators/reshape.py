"""Header clean-up, recipes and reshaping."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orepulse.operators.scans import ordered_scan

# Name fragments that mark a date column.
DATE_FRAGMENTS = ("date", "time", "timestamp", "_at", "_on", "created", "updated")

# Headers of export mechanics, compared on letters and digits only.
IGNORABLE_HEADERS = ("result", "table", "_start", "_stop", "_result", "unnamed: 0", "")


def header_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*[header_name(c) for c in df.columns])


def canonical_rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename matched columns to canonical names; two columns may not claim the same name."""
    used = {c: t for c, t in mapping.items() if c in df.columns}
    if len(set(used.values())) != len(used):
        raise ValueError("canonical mapping is not one to one")
    return df.withColumnsRenamed(used)


def drop_ignorable(df: DataFrame) -> DataFrame:
    keys = {re.sub("[^a-z0-9]", "", h) for h in IGNORABLE_HEADERS}
    return df.drop(*[c for c in df.columns if re.sub("[^a-z0-9]", "", c.lower()) in keys])


# Date layouts that are read besides ISO, tried in this order. Of two numbers with a slash the month comes first, unless there
# is no such month; numbers with dots or dashes before the year begin with the day.
DATE_FORMATS = (
    "M/d/yyyy[ H:mm[:ss]]", "yyyy/M/d[ H:mm[:ss]]", "d-MMM-yyyy[ H:mm[:ss]]", "d MMM yyyy[ H:mm[:ss]]", "MMM d yyyy[ H:mm[:ss]]", "MMM d, yyyy[ H:mm[:ss]]", "yyyyMMdd",
    "d/M/yyyy[ H:mm[:ss]]", "d.M.yyyy[ H:mm[:ss]]", "d-M-yyyy[ H:mm[:ss]]",
)


def is_date_name(name: str) -> bool:
    return any(part in name.lower() for part in DATE_FRAGMENTS)


def coerce_dates(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Parse date-named (or the given) text columns; values that do not parse become null."""
    chosen = list(columns) if columns is not None else [c for c, t in df.dtypes if t == "string" and is_date_name(c)]
    return df.withColumns({c: _moment(F.col(c)) for c in chosen if c in df.columns})


def _moment(text: Column) -> Column:
    """ISO-like text or one of ``DATE_FORMATS``. A full date is required: a bare time would mean today."""
    iso = F.when(text.rlike(r"^\s*\d{4}-\d"), F.try_to_timestamp(text))
    return F.coalesce(iso, *[F.try_to_timestamp(text, F.lit(form)) for form in DATE_FORMATS])


def unparsed_dates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``column, unparsed``: how many non-blank texts of each column ``coerce_dates`` cannot read."""
    counts = df.agg(*[F.count_if((F.trim(F.col(c).cast("string")) != "") & _moment(F.col(c).cast("string")).isNull()).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "unparsed")


def coerce_numbers(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.expr(f"try_cast(`{c}` AS DOUBLE)") for c in columns if c in df.columns})


def keep_rows(df: DataFrame, predicate: str) -> DataFrame:
    return df.filter(F.expr(predicate))


def filter_rows(df: DataFrame, exclude: str, **_: object) -> DataFrame:
    """Drop rows matching ``exclude``; rows for which the comparison is null stay."""
    return df.filter(~F.coalesce(F.expr(exclude), F.lit(False)))


def rename_columns(df: DataFrame, mapping: Mapping[str, str], **_: object) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def drop_columns(df: DataFrame, columns: Sequence[str], **_: object) -> DataFrame:
    return df.drop(*columns)


def skip_rows(df: DataFrame, n: int, row_index: str = "row_idx", **_: object) -> DataFrame:
    """Drop the first ``n`` rows of the file (positions 0 .. n-1 of ``row_index``)."""
    return df.filter(F.col(row_index) >= n)


def with_row_index(df: DataFrame, order: Sequence[str], *, keys: Sequence[str] = (), name: str = "row_idx") -> DataFrame:
    """Dense 0-based position in file order, per ``keys``."""
    return ordered_scan(df, keys, order, row_index=name)


def _header_rows(df: DataFrame, rows: Sequence[int], row_index: str) -> list[list[str | None]]:
    columns = [c for c in df.columns if c != row_index]
    found = df.filter(F.col(row_index).isin([int(r) for r in rows])).orderBy(row_index).limit(len(rows)).collect()
    if len(found) != len(rows):
        raise ValueError(f"header row out of range: {list(rows)}")
    return [[None if r[c] is None else str(r[c]) for c in columns] for r in found]


def _unique(names: Sequence[str]) -> list[str]:
    seen: dict[str, int] = {}
    result = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        result.append(name if seen[name] == 1 else f"{name}_{seen[name] - 1}")
    return result


def set_header_row(df: DataFrame, row: int, row_index: str = "row_idx", **_: object) -> DataFrame:
    """Promote one row to column names and drop it and everything above."""
    return combine_header_rows(df, [row], row_index)


def combine_header_rows(df: DataFrame, rows: Sequence[int], row_index: str = "row_idx", **_: object) -> DataFrame:
    """Join several header rows column by column with ``_`` and drop the rows down to the last of them."""
    parts = _header_rows(df, rows, row_index)
    names = []
    for pieces in zip(*parts):
        joined = "_".join(p.strip() for p in pieces if p is not None and p.strip())
        names.append(re.sub("_+", "_", joined).strip("_") if len(rows) > 1 else joined)
    columns = [c for c in df.columns if c != row_index]
    body = df.filter(F.col(row_index) > max(rows))
    return body.select(*[F.col(c).alias(n) for c, n in zip(columns, _unique(names))], row_index)


def transpose(df: DataFrame, index_column: str) -> DataFrame:
    """Rows become columns named by ``index_column``. Spark bounds the width (``transposeMaxValues``)."""
    others = [c for c in df.columns if c != index_column]
    text = df.select(F.col(index_column).cast("string"), *[F.col(c).cast("string") for c in others])
    return text.transpose(index_column).withColumnRenamed("key", "field")


MAX_SEGMENTS = 1000


def segment_values(df: DataFrame, column: str, limit: int = MAX_SEGMENTS) -> list[str]:
    """The distinct values that become columns. Beyond ``limit`` the pivot is refused, never cut."""
    found = df.select(F.col(column).cast("string").alias("v")).filter("v IS NOT NULL").distinct().limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"'{column}' has more than {limit} distinct values; use the long form")
    return sorted(r["v"] for r in found)


def pivot_segments(
    df: DataFrame,
    segment: str,
    value: str,
    index: Sequence[str] | None = None,
    row_index: str = "row_idx",
    **_: object,
) -> DataFrame:
    """One column per segment, holding the first non-null value in file order; null index keys are dropped."""
    index = list(index) if index else [c for c in df.columns if c not in (segment, value, row_index)]
    names = segment_values(df, segment)
    rows = df.filter(F.col(value).isNotNull())
    for key in index:
        rows = rows.filter(F.col(key).isNotNull())
    seg = F.col(segment).cast("string")
    cells = [F.min_by(F.col(value), F.when(seg == n, F.col(row_index))).alias(n) for n in names]
    return rows.groupBy(*index).agg(*cells)


def melt(
    df: DataFrame,
    id_vars: Sequence[str],
    value_vars: Sequence[str],
    var_name: str = "variable",
    value_name: str = "value",
    **_: object,
) -> DataFrame:
    """Wide to long; null cells are kept."""
    return df.unpivot(list(id_vars), list(value_vars), var_name, value_name)


def fill_forward(
    df: DataFrame, column: str, row_index: str = "row_idx", keys: Sequence[str] = (), **_: object
) -> DataFrame:
    """Carry the last non-null value on in file order."""
    filled = ordered_scan(df, keys, [row_index], fills={"_filled": column})
    return filled.withColumn(column, F.col("_filled")).drop("_filled")


def tyre_pressures_long(df: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Four corner columns to ``(tire_position, pressure_psi)``."""
    corners = {"fl": "front_left", "fr": "front_right", "rl": "rear_left", "rr": "rear_right"}
    wide = df.select(*ids, *[F.col(f"tire_pressure_{k}_psi").alias(v) for k, v in corners.items()])
    return wide.unpivot(list(ids), list(corners.values()), "tire_position", "pressure_psi")


def eav_pivot(df: DataFrame, keys: Sequence[str], field: str = "_field", value: str = "_value", order: str = "row_idx") -> DataFrame:
    """Declared entity-attribute-value rows to one column per field (first non-null value)."""
    if field not in df.columns or value not in df.columns:
        raise ValueError("EAV columns are not declared")
    return pivot_segments(df, field, value, keys, order)


Recipe = Callable[..., DataFrame]
OPERATIONS: dict[str, Recipe] = {
    "filter_rows": filter_rows,
    "rename_columns": rename_columns,
    "drop_columns": drop_columns,
    "skip_rows": skip_rows,
    "set_header_row": set_header_row,
    "combine_header_rows": combine_header_rows,
    "pivot_segments": pivot_segments,
    "melt": melt,
    "fill_forward": fill_forward,
    "transpose": transpose,
}


def register_operation(name: str, operation: Recipe) -> None:
    """Add a table-to-table step that recipes can name."""
    OPERATIONS[name] = operation


def run_recipe(df: DataFrame, steps: Sequence[Mapping]) -> tuple[DataFrame, list[dict]]:
    """Apply ``[{operation, params}]`` in order.

    An unknown operation is reported as skipped and a failing one as failed (analysis of the new plan
    included); in both cases the table goes on unchanged.
    """
    report = []
    for step in steps:
        name = step.get("operation", "")
        operation = OPERATIONS.get(name)
        if operation is None:
            report.append({"operation": name, "status": "skipped", "detail": "unknown operation"})
            continue
        try:
            after = operation(df, **step.get("params", {}))
            after.schema  # analysis errors surface here, not at the sink
        except Exception as problem:
            report.append({"operation": name, "status": "failed", "detail": str(problem).split("\n")[0]})
            continue
        df = after
        report.append({"operation": name, "status": "applied", "detail": ""})
    return df, report


RECIPE_REPORT = T.StructType([T.StructField(c, T.StringType()) for c in ("operation", "status", "detail")])


def recipe_report(spark: SparkSession, report: list[dict]) -> DataFrame:
    return spark.createDataFrame([(r["operation"], r["status"], r["detail"]) for r in report], RECIPE_REPORT)


def chart_series(df: DataFrame, group: str, date: str, values: Sequence[str]) -> DataFrame:
    """Grouped series to one ``<group>_<metric>`` column per group, by date."""
    names = segment_values(df, group)
    cells: list[Column] = []
    for n in names:
        for v in values:
            cells.append(F.max(F.when(F.col(group) == n, F.col(v))).alias(f"{n}_{v}"))
    return df.groupBy(date).agg(*cells)


def duration_us(start: str, end: str) -> Column:
    """Microseconds from one time column to another; null when either is missing."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return micros(end) - micros(start)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole first row of every key in ``order`` (nulls first), by an aggregation that keeps one row per key and task."""
    row = F.struct(*df.columns)
    first = df.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("_first"))
    return first.select(*[F.col(f"_first.{c}").alias(c) for c in df.columns])


def uncovered_columns(present: DataFrame, covered: DataFrame, key: str, column: str) -> DataFrame:
    """Columns of ``present`` (key, column) that ``covered`` does not name for the key, so that every column is covered once."""
    return present.select(key, column).distinct().join(covered.select(key, column).distinct(), [key, column], "left_anti")
