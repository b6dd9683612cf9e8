"""Overlapping telemetry chunks and their text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orepulse.functions.numbers import exact_mean, exact_sum
from orepulse.functions.text import chunk_id, file_stem, iso_timestamp, parent_folder
from orepulse.operators.scans import ordered_scan
from orepulse.session import checkpoint_cut

# Name endings of columns that add up.
SUM_SUFFIXES = (
    "_total", "_count", "_tonnes", "_km", "_litres", "_l", "_kg", "_events", "_trips", "_cycles", "_loads",
)


def time_window_chunks(
    df: DataFrame,
    source: str,
    date: str,
    order: Sequence[str],
    *,
    window_days: int = 7,
    max_rows: int = 500,
    overlap: int = 50,
    on_overflow: str = "split",
) -> DataFrame:
    """Rows with ``chunk_index`` and ``position``; overlap rows appear in several chunks.

    Windows of ``window_days`` run from the first time of a source. A window with more than ``max_rows``
    rows becomes several chunks; only on request (``on_overflow="first"``) are its further rows left out,
    which ``dropped_by_cap`` counts. Empty windows take no number, and a chunk starts with the last
    ``overlap`` rows before it. ``order`` must be unique within a source and is applied after ``date``.

    Chunk borders are prefix sums over one row per chunk, and overlap rows are found by an equality join
    on their positions.
    """
    valid = df.filter(F.col(date).isNotNull())
    starts = valid.groupBy(source).agg(F.min(date).alias("_t0"))
    width = window_days * 86400 * 1_000_000
    number = F.floor((F.unix_micros(F.col(date).cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))) / width)
    placed = valid.join(starts, source).withColumn("_win", number).drop("_t0")
    if on_overflow == "split":
        ranked = ordered_scan(placed, [source, "_win"], [date, *order], row_index="_at")
        kept = ranked.withColumn("_sub", F.floor(F.col("_at") / max_rows)).withColumn("_rn", F.col("_at") % max_rows).drop("_at")
    else:
        inside = Window.partitionBy(source, "_win").orderBy(date, *order)
        kept = (
            placed.withColumn("_rn", F.row_number().over(inside))
            .filter(F.col("_rn") <= max_rows)
            .withColumn("_rn", F.col("_rn") - 1)
            .withColumn("_sub", F.lit(0).cast("bigint"))
        )
    per_chunk = kept.groupBy(source, "_win", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    if on_overflow == "split":
        numbered = ordered_scan(per_chunk, [source], ["_win", "_sub"], row_index="chunk_index", sums={"_upto": F.col("_n")})
    else:  # one row per calendar window
        along = Window.partitionBy(source).orderBy("_win")
        upto = F.sum("_n").over(along.rowsBetween(Window.unboundedPreceding, 0))
        numbered = per_chunk.withColumns({"chunk_index": F.row_number().over(along) - 1, "_upto": upto})
    borders = numbered.select(
        source, "_win", "_sub", F.col("chunk_index").cast("bigint").alias("chunk_index"), (F.col("_upto") - F.col("_n")).alias("_lo")
    )
    own = kept.join(borders, [source, "_win", "_sub"]).withColumn("_g", F.col("_lo") + F.col("_rn"))
    carry = df.columns
    mine = own.select(*carry, "chunk_index", "_g", F.col("_lo").alias("_chunk_lo"))
    if overlap > 0:
        wanted = borders.filter(F.col("_lo") > 0).select(
            source,
            F.col("chunk_index"),
            F.col("_lo").alias("_chunk_lo"),
            F.explode(F.sequence(F.greatest(F.col("_lo") - overlap, F.lit(0)), F.col("_lo") - 1)).alias("_g"),
        )
        tail = own.select(*carry, "_g").join(wanted, [source, "_g"]).select(*carry, "chunk_index", "_g", "_chunk_lo")
        mine = mine.unionByName(tail)
    first = F.greatest(F.col("_chunk_lo") - overlap, F.lit(0))
    return mine.select(*carry, "chunk_index", (F.col("_g") - first).alias("position"))


def dropped_by_cap(
    df: DataFrame, source: str, date: str, *, window_days: int = 7, max_rows: int = 500, on_overflow: str = "split"
) -> DataFrame:
    """How many rows the chunks of ``time_window_chunks`` with the same options leave out, per source."""
    beyond = F.greatest(F.col("n") - max_rows, F.lit(0)) if on_overflow == "first" else F.lit(0).cast("bigint")
    valid = df.filter(F.col(date).isNotNull())
    starts = valid.groupBy(source).agg(F.min(date).alias("_t0"))
    number = F.floor((F.unix_micros(F.col(date).cast("timestamp")) - F.unix_micros(F.col("_t0").cast("timestamp"))) / (window_days * 86400 * 1_000_000))
    sizes = valid.join(starts, source).groupBy(source, number.alias("_win")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy(source).agg(
        F.sum("n").alias("rows"), F.sum(beyond).alias("dropped_rows")
    )


def row_count_chunks(
    df: DataFrame, source: str, order: Sequence[str], *, size: int = 500, overlap: int = 50
) -> DataFrame:
    """Sliding windows of ``size`` rows per source; a row is copied to each window that holds it."""
    if size <= overlap:
        overlap = size // 4
    step = max(1, size - overlap)
    indexed = ordered_scan(df, [source], order, row_index="_i")
    last = F.floor(F.col("_i") / step)
    first = F.greatest(F.ceil((F.col("_i") - size + 1) / step), F.lit(0))
    return indexed.select(
        *df.columns, "_i", F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))).alias("chunk_index")
    ).select(*df.columns, "chunk_index", (F.col("_i") - F.col("chunk_index") * step).alias("position"))


def row_ranges(chunks: DataFrame, source: str) -> DataFrame:
    """Cumulative ``[row_start, row_end)`` per chunk, overlap rows counted."""
    sizes = chunks.groupBy(source, "chunk_index").agg(F.count(F.lit(1)).alias("row_count"))
    scanned = ordered_scan(sizes, [source], ["chunk_index"], sums={"row_end": F.col("row_count")})
    return scanned.select(source, "chunk_index", "row_count", (F.col("row_end") - F.col("row_count")).alias("row_start"), "row_end")


def adds_up(column: str) -> bool:
    return column.endswith(SUM_SUFFIXES)


def metric_summaries(chunks: DataFrame, source: str, metrics: Sequence[str]) -> DataFrame:
    """total/mean/max of adding columns and mean/min/max of others, per chunk, 3 decimals."""
    aggregates = []
    for i, m in enumerate(metrics):
        aggregates += [
            F.count(m).alias(f"n{i}"),
            exact_sum(m).alias(f"sum{i}"),
            exact_mean(m).alias(f"mean{i}"),
            F.min(m).cast("double").alias(f"min{i}"),
            F.max(m).cast("double").alias(f"max{i}"),
        ]
    wide = chunks.groupBy(source, "chunk_index").agg(*aggregates)
    cells = [
        F.struct(
            F.lit(i).alias("metric_no"),
            F.lit(m).alias("metric"),
            F.lit("sum" if adds_up(m) else "mean").alias("kind"),
            F.col(f"n{i}").alias("n"),
            F.round(f"sum{i}", 3).alias("total"),
            F.round(f"mean{i}", 3).alias("mean"),
            F.round(f"min{i}", 3).alias("min"),
            F.round(f"max{i}", 3).alias("max"),
        )
        for i, m in enumerate(metrics)
    ]
    return wide.select(source, "chunk_index", F.inline(F.array(*cells))).filter("n > 0")


def chunk_outliers(chunks: DataFrame, source: str, metric: str, date: str, *, examples: int = 3) -> DataFrame:
    """Rows of a chunk outside 1.5 IQR (at least four values, IQR not 0), first ``examples`` marked.

    A chunk has at most ``max_rows + overlap`` rows, so its quartiles fit the built-in percentile.
    """
    bounds = (
        chunks.groupBy(source, "chunk_index")
        .agg(F.count(metric).alias("n"), F.percentile(metric, F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
        .filter((F.col("n") >= 4) & (F.col("q")[1] != F.col("q")[0]))
        .select(
            source,
            "chunk_index",
            (F.col("q")[0] - 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("lower"),
            (F.col("q")[1] + 1.5 * (F.col("q")[1] - F.col("q")[0])).alias("upper"),
        )
    )
    out = chunks.join(bounds, [source, "chunk_index"]).filter((F.col(metric) > F.col("upper")) | (F.col(metric) < F.col("lower")))
    nth = F.row_number().over(Window.partitionBy(source, "chunk_index").orderBy("position"))
    return out.select(
        source,
        "chunk_index",
        F.lit(metric).alias("metric"),
        nth.cast("bigint").alias("example_no"),
        F.col(metric).alias("value"),
        F.col(date).alias("at"),
        (nth <= examples).alias("shown"),
    )


def category_counts(chunks: DataFrame, source: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """Top ``k`` values per chunk and category column; ties go by value."""
    long = chunks.select(source, "chunk_index", *[F.col(c).cast("string") for c in columns]).unpivot(
        [source, "chunk_index"], list(columns), "category", "value"
    )
    counted = long.filter("value IS NOT NULL").groupBy(source, "chunk_index", "category", "value").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(source, "chunk_index", "category").orderBy(F.desc("n"), F.asc("value"))
    top = counted.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    return top.withColumn("place", F.col("place").cast("bigint"))


def entity_snapshot(chunks: DataFrame, source: str, columns: Sequence[str], k: int = 5) -> DataFrame:
    """First-seen distinct values per chunk and entity column, with the total distinct."""
    long = chunks.select(source, "chunk_index", "position", *[F.col(c).cast("string") for c in columns]).unpivot(
        [source, "chunk_index", "position"], list(columns), "entity", "value"
    )
    seen = long.filter("value IS NOT NULL").groupBy(source, "chunk_index", "entity", "value").agg(F.min("position").alias("first"))
    per = Window.partitionBy(source, "chunk_index", "entity")
    ranked = seen.withColumns(
        {"place": F.row_number().over(per.orderBy("first", "value")), "distinct_values": F.count(F.lit(1)).over(per)}
    ).filter(F.col("place") <= k)
    return ranked.groupBy(source, "chunk_index", "entity").agg(
        F.max("distinct_values").alias("distinct_values"),
        F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("values"),
    )


def number_text(value: Column) -> Column:
    """A rounded double as Python prints it: shortest form with at least one decimal."""
    plain = F.format_string("%.3f", value)
    return F.regexp_replace(F.regexp_replace(plain, "0+$", ""), "[.]$", ".0")


def chunk_documents(
    chunks: DataFrame,
    source: str,
    *,
    date: str,
    entities: Sequence[str],
    metrics: Sequence[str],
    categories: Sequence[str],
    schema_version: str = "1.0",
    markers: DataFrame | None = None,
) -> DataFrame:
    """One row per chunk with ``chunk_id``, ``text`` and a ``metadata`` struct.

    ``markers`` (``source, missing_fields, unmapped_columns, active_domains``) adds coverage lines.
    Every part is an aggregate per chunk, joined on ``(source, chunk_index)``; the chunk rows are
    written once and read by each of them.
    """
    key = [source, "chunk_index"]
    chunks = checkpoint_cut(chunks)
    base = row_ranges(chunks, source).join(
        chunks.groupBy(*key).agg(F.min(date).alias("t_min"), F.max(date).alias("t_max")), key
    )

    snap = entity_snapshot(chunks, source, entities)
    shown = (
        F.when(F.col("distinct_values") == 1, F.concat("entity", F.lit("="), F.col("values")[0]))
        .when(F.col("distinct_values") <= 5, F.concat("entity", F.lit("=["), F.array_join("values", ", "), F.lit("]")))
        .otherwise(F.concat("entity", F.lit(" ("), F.col("distinct_values").cast("string"), F.lit(" entities)")))
    )
    order_of = F.array_position(F.array(*[F.lit(e) for e in entities]), F.col("entity"))
    entity_lines = snap.groupBy(*key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(order_of.alias("o"), shown.alias("s")))), lambda x: x["s"]), ", "
        ).alias("entity_text"),
        F.map_from_entries(F.collect_list(F.struct("entity", "values"))).alias("entity_values"),
    )

    outliers = chunk_outliers(chunks, source, metrics[0], date)
    for m in metrics[1:]:
        outliers = outliers.unionByName(chunk_outliers(chunks, source, m, date))
    counted = outliers.groupBy(*key, "metric").agg(
        F.count(F.lit(1)).alias("outlier_count"),
        F.array_sort(F.collect_list(F.when(F.col("shown"), F.struct("example_no", "value", "at")))).alias("examples"),
    )
    metric_rows = metric_summaries(chunks, source, metrics).join(counted, [*key, "metric"], "left")
    line = F.when(
        F.col("kind") == "sum",
        F.concat(F.lit("  "), "metric", F.lit(": total="), number_text(F.col("total")), F.lit(", mean="),
                 number_text(F.col("mean")), F.lit(", max="), number_text(F.col("max"))),
    ).otherwise(
        F.concat(F.lit("  "), "metric", F.lit(": mean="), number_text(F.col("mean")), F.lit(", min="),
                 number_text(F.col("min")), F.lit(", max="), number_text(F.col("max")))
    )
    line = F.concat(line, F.coalesce(F.concat(F.lit("  ["), F.col("outlier_count").cast("string"), F.lit(" outlier(s)]")), F.lit("")))
    notes = F.transform(
        F.coalesce("examples", F.array()),
        lambda e: F.concat(
            F.lit("  "), F.col("metric"), F.lit("="), number_text(F.round(e["value"], 3)),
            F.coalesce(F.concat(F.lit(" at "), iso_timestamp(e["at"])), F.lit("")),
        ),
    )
    metric_lines = metric_rows.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("metric_no", line.alias("line"), notes.alias("notes")))).alias("m")
    ).select(
        *key,
        F.transform("m", lambda x: x["line"]).alias("measure_lines"),
        F.flatten(F.transform("m", lambda x: x["notes"])).alias("outlier_lines"),
    )

    pairs = F.concat("value", F.lit(":"), F.col("n").cast("string"))
    cat_order = F.array_position(F.array(*[F.lit(c) for c in categories]), F.col("category"))
    by_category = (
        category_counts(chunks, source, categories)
        .groupBy(*key, "category")
        .agg(F.array_sort(F.collect_list(F.struct("place", pairs.alias("p")))).alias("c"))
        .withColumn("line", F.concat(F.lit("  "), "category", F.lit(": "), F.array_join(F.transform("c", lambda x: x["p"]), ", ")))
    )
    category_lines = by_category.groupBy(*key).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(cat_order.alias("o"), "line"))), lambda x: x["line"]
        ).alias("category_lines")
    )

    joined = base
    for part in (entity_lines, metric_lines, category_lines):
        joined = joined.join(part, key, "left")
    if markers is not None:
        joined = joined.join(markers, source, "left")
    else:
        empty = F.array().cast("array<string>")
        joined = joined.withColumns({"missing_fields": empty, "unmapped_columns": empty, "active_domains": empty})

    def block(title: str, lines: str) -> Column:
        return F.when(F.size(lines) > 0, F.concat(F.lit(f"{title}\n"), F.array_join(lines, "\n")))

    header = F.concat(
        F.concat_ws(
            ". ",
            F.concat(F.lit("Mining telemetry from "), F.col(source)),
            F.concat(F.lit("time "), iso_timestamp(F.col("t_min")), F.lit(" to "), iso_timestamp(F.col("t_max"))),
            F.nullif("entity_text", F.lit("")),
            F.concat(F.col("row_count").cast("string"), F.lit(" records")),
        ),
        F.lit("."),
    )
    text = F.concat_ws(
        "\n\n",
        header,
        block("Measurements:", "measure_lines"),
        block("Categories:", "category_lines"),
        block("Outliers detected:", "outlier_lines"),
        F.when(
            F.size("missing_fields") > 0,
            F.concat(F.lit("Fields not tracked in this dataset: "), F.array_join("missing_fields", ", "), F.lit(".")),
        ),
        F.when(
            F.size("unmapped_columns") > 0,
            F.concat(
                F.lit("Unmapped source columns (present but not in the canonical schema): "),
                F.array_join("unmapped_columns", ", "), F.lit("."),
            ),
        ),
    )
    folder, stem = parent_folder(F.col(source)), file_stem(F.col(source))
    columns = F.array(*[F.lit(c) for c in chunks.columns if c not in ("chunk_index", "position", source)])
    metadata = F.struct(
        F.col(source).alias("source_file"),
        folder.alias("folder"),
        F.col("chunk_index"),
        F.array("row_start", "row_end").alias("row_range"),
        F.struct(iso_timestamp(F.col("t_min")).alias("start"), iso_timestamp(F.col("t_max")).alias("end")).alias("date_range"),
        F.col("entity_values"),
        F.lit(schema_version).alias("schema_version"),
        columns.alias("column_list"),
        F.col("row_count"),
        F.array_sort(columns).alias("available_fields"),
        F.col("missing_fields").alias("missing_canonical_fields"),
        F.col("unmapped_columns"),
        F.col("active_domains"),
    )
    return joined.select(
        F.col(source), "chunk_index", chunk_id(folder, stem, F.col("chunk_index")).alias("chunk_id"),
        text.alias("text"), metadata.alias("metadata"),
    )
