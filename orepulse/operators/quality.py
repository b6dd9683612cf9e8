"""Column profiles, type inference, row anomalies, intake verdicts and masking."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orepulse.functions.numbers import EXACT
from orepulse.operators.reshape import is_date_name
from orepulse.operators.stats import numeric_columns

CATEGORY_RATIO = 0.05
NUMERIC_SHARE = 0.9
CARDINALITY_CAP = 1000
HEADER_PATTERN = "^[a-zA-Z][a-zA-Z0-9_]{1,60}$"

# Texts a numeric column may hold without being a type break.
NULL_WORDS = ("nan", "null", "none", "na", "n/a", "")


def _text_columns(df: DataFrame) -> list[str]:
    return [c for c, t in df.dtypes if t == "string"]


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` of the non-null values; hot values collapse before the shuffle."""
    long = df.select([F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    return long.filter("value IS NOT NULL").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The ``k`` most frequent values per column; ties go by value."""
    order = Window.partitionBy("column").orderBy(F.desc("n"), F.asc("value"))
    return (
        value_counts(df, columns)
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= k)
        .select("column", F.col("position").cast("bigint").alias("position"), "value", "n")
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Type, nulls, range and mean per column.

    All counters come from one aggregation; distinct counts, needed only to tell categories from text,
    come from the counted values of the text columns.
    """
    kinds = dict(df.dtypes)
    numbers = set(numeric_columns(df))
    texts = _text_columns(df)
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(df.columns):
        aggregates.append(F.count(F.col(c)).alias(f"n{i}"))
        if c in numbers:
            x = F.col(c).cast("double")
            aggregates += [F.min(x).alias(f"lo{i}"), F.max(x).alias(f"hi{i}"), F.avg(x).alias(f"mean{i}")]
        elif kinds[c] in ("timestamp", "date", "timestamp_ntz"):
            aggregates += [F.min(c).alias(f"from{i}"), F.max(c).alias(f"to{i}")]
    cells = []
    for i, c in enumerate(df.columns):
        number, date = c in numbers, kinds[c] in ("timestamp", "date", "timestamp_ntz")
        if date:
            kind = "datetime"
        elif kinds[c] == "boolean":
            kind = "boolean"
        elif number:
            kind = "integer" if kinds[c] in ("tinyint", "smallint", "int", "bigint") else "float"
        else:
            kind = "string"
        nothing, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
        cells.append(
            F.struct(
                F.lit(c).alias("column"),
                F.lit(kind).alias("base_type"),
                (F.col("rows") - F.col(f"n{i}")).alias("null_count"),
                F.round((F.col("rows") - F.col(f"n{i}")) / F.col("rows") * 100, 1).alias("null_pct"),
                (F.round(f"lo{i}", 3) if number else nothing).alias("min"),
                (F.round(f"hi{i}", 3) if number else nothing).alias("max"),
                (F.round(f"mean{i}", 3) if number else nothing).alias("mean"),
                (F.date_format(f"from{i}", "yyyy-MM-dd HH:mm:ss") if date else no_text).alias("date_min"),
                (F.date_format(f"to{i}", "yyyy-MM-dd HH:mm:ss") if date else no_text).alias("date_max"),
            )
        )
    profile = df.agg(*aggregates).select(F.inline(F.array(*cells)))
    if not texts:
        return profile.withColumnRenamed("base_type", "type")
    distinct = value_counts(df, texts).groupBy("column").agg(F.count(F.lit(1)).alias("d"), F.sum("n").alias("present"))
    ratio = F.col("d") / F.col("present")
    kind = F.when((F.col("base_type") == "string") & (ratio < CATEGORY_RATIO), "categorical").otherwise(F.col("base_type"))
    return profile.join(distinct, "column", "left").select(
        "column",
        kind.alias("type"),
        *[c for c in profile.columns if c not in ("column", "base_type")],
    )


def data_quality_report(df: DataFrame, threshold: float = 10.0) -> DataFrame:
    """Columns with more than ``threshold`` percent nulls."""
    return column_profile(df).filter(F.col("null_pct") > threshold).select("column", "null_count", "null_pct")


def streaming_profile(df: DataFrame, row_index: str, *, exact_cardinality: bool = True) -> DataFrame:
    """Profile of raw (text) columns: nulls, numeric share, range and mean (4 decimals), capped cardinality, type.

    Values of every column are counted once per distinct value, so the statistics read the counted
    values, not the rows. ``exact_cardinality=False`` skips that shuffle and uses a sketch.
    """
    columns = [c for c in df.columns if c != row_index]
    text = df.select([F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) for c in columns])
    totals = text.agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)])
    counts = totals.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("column"), F.col("rows").alias("total_count"), F.col(f"n{i}").alias("present"))
                    for i, c in enumerate(columns)
                ]
            )
        )
    )
    long = text.unpivot([], columns, "column", "value").filter("value IS NOT NULL")
    if exact_cardinality:
        long = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        cardinality = F.count(F.lit(1))
    else:
        long = long.withColumn("n", F.lit(1))
        cardinality = F.approx_count_distinct("value")
    number = F.expr("try_cast(value AS DOUBLE)")
    exact = F.col("value").try_cast(EXACT)
    fine = F.bool_and(F.when(number.isNotNull(), F.coalesce(exact.cast("double") == number, F.lit(False))))
    whole = F.when(fine, F.sum(exact * F.col("n")).cast("double")).otherwise(F.sum(number * F.col("n")))
    stats = long.groupBy("column").agg(
        cardinality.alias("distinct_values"),
        F.sum(F.when(number.isNotNull(), F.col("n")).otherwise(0)).alias("numeric_votes"),
        F.min(number).alias("lo"),
        F.max(number).alias("hi"),
        (whole / F.sum(F.when(number.isNotNull(), F.col("n")))).alias("mean"),
        F.max(F.contains(F.col("value"), F.lit("."))).alias("has_point"),
    )
    date_named = reduce(lambda a, b: a | b, [F.col("column") == c for c in columns if is_date_name(c)], F.lit(False))
    present = F.col("present")
    kind = (
        F.when(date_named, "datetime")
        .when(present == 0, "string")
        .when((F.col("numeric_votes") / present >= NUMERIC_SHARE) & ~F.col("has_point"), "integer")
        .when(F.col("numeric_votes") / present >= NUMERIC_SHARE, "float")
        .when(F.least("distinct_values", F.lit(CARDINALITY_CAP)) / present < CATEGORY_RATIO, "categorical")
        .otherwise("string")
    )
    return counts.join(stats, "column", "left").select(
        "column",
        kind.alias("inferred_type"),
        (F.col("total_count") - present).alias("null_count"),
        "total_count",
        F.round("lo", 4).alias("min_val"),
        F.round("hi", 4).alias("max_val"),
        F.round("mean", 4).alias("mean"),
        F.least(F.coalesce("distinct_values", F.lit(0)), F.lit(CARDINALITY_CAP)).cast("bigint").alias("cardinality"),
        (F.coalesce("distinct_values", F.lit(0)) > CARDINALITY_CAP).alias("cardinality_capped"),
    )


def sample_values(df: DataFrame, columns: Sequence[str], row_index: str, k: int = 10) -> DataFrame:
    """The first ``k`` distinct values per column in file order."""
    long = df.select(row_index, *[F.trim(F.col(c).cast("string")).alias(c) for c in columns])
    seen = (
        long.unpivot([row_index], list(columns), "column", "value")
        .filter("value IS NOT NULL AND value <> ''")
        .groupBy("column", "value")
        .agg(F.min(row_index).alias("first_row"))
    )
    order = Window.partitionBy("column").orderBy("first_row", "value")
    return (
        seen.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= k)
        .select("column", F.col("position").cast("bigint").alias("position"), "value", "first_row")
    )


def head_rows(df: DataFrame, row_index: str, n: int = 50) -> DataFrame:
    return df.filter(F.col(row_index) < n)


def tail_rows(df: DataFrame, row_index: str, n: int = 20) -> DataFrame:
    return df.orderBy(F.desc(row_index)).limit(n)


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c)) == "")


def _share(flags: Sequence[Column], of: Column) -> Column:
    hits = reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags])
    return hits / of


def row_anomalies(df: DataFrame, row_index: str, numeric: Sequence[str]) -> DataFrame:
    """At most one finding per row: separator row, embedded header, or text in a numeric column.

    ``df`` holds raw text columns. The first data row is exempt. Purely row-wise, so it never shuffles.
    """
    columns = [c for c in df.columns if c != row_index]
    n_cells = F.lit(len(columns))
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    separator = _share([_blank(c) for c in columns], n_cells) >= 0.8
    header = (filled > 0) & (_share([F.trim(F.col(c)).rlike(HEADER_PATTERN) for c in columns], filled) >= 0.5)
    breaks = []
    for c in numeric:
        text = F.trim(F.col(c))
        bad = F.expr(f"try_cast(trim(`{c}`) AS DOUBLE)").isNull() & text.isNotNull() & ~F.lower(text).isin(*NULL_WORDS)
        detail = F.concat(F.lit(f"Numeric column '{c}' contains string value '"), F.left(F.col(c), F.lit(40)), F.lit("'"))
        breaks.append(F.when(bad, detail))
    broken = F.coalesce(*breaks) if breaks else F.lit(None).cast("string")
    flagged = df.filter(F.col(row_index) >= 1).select(
        row_index,
        F.when(separator, "separator_row").when(header, "embedded_header").when(broken.isNotNull(), "type_break").alias("anomaly_type"),
        broken.alias("_broken"),
    )
    detail = (
        F.when(F.col("anomaly_type") == "separator_row", "at least 80% of values are null or empty")
        .when(F.col("anomaly_type") == "embedded_header", "at least 50% of values match column-name patterns")
        .otherwise(F.col("_broken"))
    )
    return flagged.filter("anomaly_type IS NOT NULL").select(row_index, "anomaly_type", detail.alias("detail"))


def anomaly_sample(anomalies: DataFrame, row_index: str, limit: int = 100) -> DataFrame:
    """The first anomalous rows, one finding each, for display beside the full counts."""
    return anomalies.orderBy(row_index).limit(limit)


def column_count_shift(lines: DataFrame, line: str, row_index: str, expected: int, separator: str = ",") -> DataFrame:
    """Raw lines whose width differs from the header's; separators inside quoted fields do not count."""
    unquoted = F.regexp_replace(F.col(line), '"(?:[^"]|"")*"', "q")
    width = F.size(F.split(unquoted, separator, -1))
    return lines.filter(width != expected).select(
        row_index,
        F.lit("column_count_shift").alias("anomaly_type"),
        F.concat(F.lit(f"Expected {expected} columns, got "), width.cast("string")).alias("detail"),
    )


def profile_text(profile: DataFrame, samples: DataFrame) -> DataFrame:
    """One line of text per column of a :func:`streaming_profile`."""
    listed = samples.groupBy("column").agg(
        F.array_sort(F.collect_list(F.struct("position", "value"))).alias("s")  # at most ten per column
    )
    null_pct = F.concat(F.format_string("%.1f", F.col("null_count") / F.greatest("total_count", F.lit(1)) * 100), F.lit("%"))
    quoted = F.transform(F.col("s"), lambda x: F.concat(F.lit("'"), x["value"], F.lit("'")))
    shown = lambda n: F.concat(F.lit("["), F.array_join(F.slice(quoted, 1, n), ", "), F.lit("]"))
    head = F.concat(F.lit("  "), F.rpad("column", 40, " "), F.lit(" ["), F.col("inferred_type"), F.lit("]"))
    number = lambda c: F.format_string("%.4f", F.col(c))
    body = (
        F.when(
            F.col("inferred_type").isin("float", "integer"),
            F.concat(
                F.lit("mean="), number("mean"), F.lit("  min="), number("min_val"), F.lit("  max="), number("max_val"),
                F.lit("  null="), null_pct,
            ),
        )
        .when(F.col("inferred_type") == "datetime", F.concat(F.lit("sample="), shown(2), F.lit("  null="), null_pct))
        .otherwise(
            F.concat(
                F.lit("cardinality="), F.col("cardinality").cast("string"),
                F.when(F.col("cardinality_capped"), "+").otherwise(""),
                F.lit("  sample="), shown(5), F.lit("  null="), null_pct,
            )
        )
    )
    return profile.join(listed, "column", "left").select("column", F.concat(head, F.lit("  "), body).alias("line"))


# Identifiers that are masked, in this order: a text every match contains (empty: none), pattern, tag.
MASKS = (
    ("@", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", "{EMAIL}"),
    (
        "",
        r"(?:(?:[+][0-9]{1,3}|\b1)[ .-]?)?(?:[(][0-9]{3}[)][ .-]?|\b[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}\b|[+][0-9]{1,3}(?:[ .-][0-9]{2,4}){2,5}\b"
        r"|[(]0[0-9]{2,4}[)][ .-]?[0-9]{3,4}[ .-][0-9]{3,4}\b",
        "{PHONE}",
    ),
    (
        "",
        "[0-9]{1,5} [A-Z][a-z]+(?: [A-Z][a-z]+)? (?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr)[.]?",
        "{ADDRESS}",
    ),
    ("EMP-", r"\bEMP-\d{4,6}\b", "{EmployeeId}"),
    ("CT-", r"\bCT-\d{4,}\b", "{ContractId}"),
    ("SITE-", r"\bSITE-[A-Z0-9]{2,}\b", "{SiteId}"),
)


# What every match of a pattern without a fixed text contains; finding it takes no backtracking.
NEEDED = {"{PHONE}": "[0-9]{3}[ .-][0-9]{4}|[+][0-9]|[(]0", "{ADDRESS}": "[0-9] [A-Z][a-z]"}


def mask_identifiers(df: DataFrame, column: str) -> DataFrame:
    """Replace e-mail, phone, address and site identifiers of a column by tags, over the whole text.

    A plain test, for a substring or a short pattern, spares most texts the whole regular expression.
    """
    for hint, pattern, tag in MASKS:
        masked = F.regexp_replace(F.col(column), F.lit(pattern), F.lit(tag))
        likely = F.contains(F.col(column), F.lit(hint)) if hint else F.col(column).rlike(NEEDED[tag])
        df = df.withColumn(column, F.when(likely, masked).otherwise(F.col(column)))
    return df


def mask_counts(df: DataFrame, text: str) -> DataFrame:
    """How many identifiers of each kind the column holds."""
    tags = F.array(
        *[
            F.struct(F.lit(tag).alias("kind"), F.regexp_count(F.col(text), F.lit(pattern)).alias("n"))
            for _, pattern, tag in MASKS
        ]
    )
    return df.select(F.inline(tags)).groupBy("kind").agg(
        F.count_if(F.col("n") > 0).alias("rows_hit"), F.sum("n").cast("bigint").alias("hits")
    )


def intake_verdict(signals: DataFrame, accept_share: float = 0.6) -> DataFrame:
    """accept / reject / quarantine per file; quarantine unless one of the others is earned.

    ``signals``: ``source_file, row_count, column_count, matched_columns, candidate_columns,
    constant_columns, peer_graph`` (see :func:`intake_signals`).
    """
    share = F.col("matched_columns") / F.greatest("candidate_columns", F.lit(1))
    empty = (F.col("row_count") == 0) | (F.col("column_count") == 0)
    constant = (F.col("column_count") > 0) & (F.col("constant_columns") == F.col("column_count"))
    verdict = (
        F.when(empty | constant | F.col("peer_graph"), "reject").when(share >= accept_share, "accept").otherwise("quarantine")
    )
    reason = (
        F.when(empty, "no data rows")
        .when(constant, "only constant columns")
        .when(F.col("peer_graph"), "association table between peers, not measurements")
        .when(share >= accept_share, "headers match canonical fields")
        .when(F.col("matched_columns") > 0, "header match below the accept threshold")
        .otherwise("no recognised header")
    )
    confidence = F.when(empty, 1.0).when(constant, 0.95).when(F.col("peer_graph"), 0.8).otherwise(F.round(share, 2))
    return signals.select("source_file", verdict.alias("verdict"), confidence.alias("confidence"), reason.alias("reason"))


def peer_graph_share(df: DataFrame, left: str, right: str) -> DataFrame:
    """Share of one column's vocabulary also found in another: high overlap marks a peer-to-peer table."""
    a = df.select(F.col(left).cast("string").alias("v")).filter("v IS NOT NULL").distinct().withColumn("l", F.lit(1))
    b = df.select(F.col(right).cast("string").alias("v")).filter("v IS NOT NULL").distinct().withColumn("r", F.lit(1))
    both = a.join(b, "v", "full")
    return both.agg(
        F.count("l").alias("left_values"),
        F.count("r").alias("right_values"),
        F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared_values"),
    ).withColumn("overlap", F.round(F.col("shared_values") / F.greatest(F.least("left_values", "right_values"), F.lit(1)), 3))
