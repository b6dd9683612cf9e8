"""Tenant analysis: findings, dashboard sections, charts, report JSON and indexable texts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orepulse.functions.text import title_label
from orepulse.operators.kpi import REGISTRY, SECTION_KPIS, calculate_kpi, feasible_kpis
from orepulse.operators.quantiles import grouped_quantiles
from orepulse.operators.schema import column_section, kpi_section_column
from orepulse.operators.stats import FREQUENCIES, aggregate
from orepulse.session import checkpoint_cut

# The chart palette and how many entities a ranking shows.
PALETTE = ("#2563EB", "#16A34A", "#DC2626", "#D97706", "#7C3AED", "#0891B2", "#DB2777", "#65A30D")
TOP_ENTITIES = 10


def kpi_findings(df: DataFrame, source: str, names: Sequence[str] | None = None) -> DataFrame:
    """KPIs of every file of every tenant in one aggregation: ``(client_id, source, kpi, value, unit, status, error)``."""
    names = list(names or feasible_kpis(df.columns))
    return calculate_kpi(df, names, group_by=["client_id", source])


def analysis_table(df: DataFrame, source: str, date: str, entity: str, metrics: Sequence[str], *, kpi_inputs: bool = True) -> DataFrame:
    """The columns an analysis reads, written once: several aggregations follow, and a joined view is costly to repeat.

    ``kpi_inputs=False`` leaves out what only KPIs read: one aggregation over the view costs less than writing these many columns.
    """
    inputs = {c for n in feasible_kpis(df.columns) for c in REGISTRY[n].required} if kpi_inputs else set()
    wanted = {"client_id", source, date, entity, *metrics, *inputs}
    return checkpoint_cut(df.select(*[c for c in df.columns if c in wanted]))


def merge_files(kpis: DataFrame, sequence: str) -> DataFrame:
    """One row per tenant and KPI: the last computed value wins and an error never replaces one."""
    row = F.struct("value", "unit", "status", "error")
    good = F.col("status") != "error"
    folded = kpis.groupBy("client_id", "kpi").agg(
        F.max_by(row, F.when(good, F.col(sequence))).alias("good"),
        F.min_by(row, sequence).alias("first"), F.min(sequence).alias("position")
    )
    return folded.select("client_id", "kpi", "position", F.inline(F.array(F.coalesce("good", "first"))))


def section_counts(kpis: DataFrame) -> DataFrame:
    """KPI count per tenant and section, and the tenant's total."""
    placed = kpis.withColumn("section", kpi_section_column(F.col("kpi"))).filter("section IS NOT NULL")
    return placed.groupBy("client_id", "section").agg(F.count(F.lit(1)).alias("kpi_count"))


def overview(files: DataFrame) -> DataFrame:
    """Totals per tenant over ``(client_id, source_file, status, row_count, column_count)`` rows, one per file."""
    return files.groupBy("client_id").agg(
        F.sum("row_count").alias("total_rows"),
        F.count(F.lit(1)).alias("file_count"),
        F.count_if(F.col("status") == "error").alias("failed_files"),
        F.array_sort(F.collect_list(F.struct("source_file", "status", "row_count", "column_count"))).alias("files"),
    )


def tenant_statistics(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """count/mean/std/min/max per tenant and metric, all metrics in one aggregation."""
    cells, aggregates = [], []
    for i, m in enumerate(metrics):
        aggregates += [
            F.count(m).alias(f"n{i}"), F.avg(F.col(m).cast("double")).alias(f"mean{i}"), F.stddev_samp(m).alias(f"std{i}"),
            F.min(m).cast("double").alias(f"lo{i}"), F.max(m).cast("double").alias(f"hi{i}"),
        ]
        cells.append(
            F.struct(
                F.lit(m).alias("metric"), F.col(f"n{i}").alias("n"), F.round(f"mean{i}", 3).alias("mean"), F.round(f"std{i}", 3).alias("std"),
                F.round(f"lo{i}", 3).alias("min"), F.round(f"hi{i}", 3).alias("max"),
            )
        )
    return df.groupBy("client_id").agg(*aggregates).select("client_id", F.inline(F.array(*cells)))


def tenant_outliers(df: DataFrame, metrics: Sequence[str], cutoff: float = 1.5) -> DataFrame:
    """IQR outlier counts per tenant and metric.

    Readings are counted once per distinct value and written; quartiles and outlier counts both read
    the counts, and no tenant's values are gathered in one task.
    """
    long = df.select("client_id", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        ["client_id"], list(metrics), "metric", "value"
    )
    counted = long.filter("value IS NOT NULL").groupBy("client_id", "metric", "value").agg(F.count(F.lit(1)).alias("n"))
    return outliers_of_counts(checkpoint_cut(counted), cutoff)


def outliers_of_counts(counted: DataFrame, cutoff: float = 1.5) -> DataFrame:
    """IQR bounds and outlier counts from ``client_id, metric, value, n``, which must be written down."""
    quartiles = grouped_quantiles(counted, ["client_id", "metric"], "value", (0.25, 0.75))
    spread = F.col("q")[1] - F.col("q")[0]
    bounds = quartiles.select(
        "client_id", "metric", (F.col("q")[0] - cutoff * spread).alias("lower_bound"), (F.col("q")[1] + cutoff * spread).alias("upper_bound")
    )
    outside = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    return (
        counted.join(bounds, ["client_id", "metric"])
        .groupBy("client_id", "metric", "lower_bound", "upper_bound")
        .agg(F.coalesce(F.sum(F.when(outside, F.col("n"))), F.lit(0)).alias("outlier_count"), F.sum("n").alias("rows"))
        .select(
            "client_id", "metric", F.round("lower_bound", 3).alias("lower_bound"), F.round("upper_bound", 3).alias("upper_bound"),
            "outlier_count", F.round(F.col("outlier_count") / F.col("rows") * 100, 1).alias("outlier_pct"),
        )
    )


def tenant_trends(df: DataFrame, date: str, metrics: Sequence[str], freq: str = "W") -> DataFrame:
    """Trend per tenant and metric; all metrics share the per-period aggregation."""
    start = F.date_trunc(FREQUENCIES[freq][0], F.col(date))
    periods = df.filter(F.col(date).isNotNull()).groupBy("client_id", start.alias("s")).agg(*[aggregate(m, "mean").alias(m) for m in metrics])
    return trends_of_periods(periods.unpivot(["client_id", "s"], list(metrics), "metric", "y"))


def trends_of_periods(means: DataFrame) -> DataFrame:
    """Least-squares trend per tenant and metric over the means ``y`` of its periods ``s``: ``client_id, metric, s, y``."""
    long = means.filter("y IS NOT NULL")
    order = Window.partitionBy("client_id", "metric").orderBy("s")
    fitted = long.withColumn("x", (F.row_number().over(order) - 1).cast("double")).groupBy("client_id", "metric").agg(
        F.count(F.lit(1)).alias("periods"), F.regr_slope("y", "x").alias("slope"),
        F.when(F.min("y") == F.max("y"), 0.0).otherwise(F.regr_r2("y", "x")).alias("r2"),
        F.min_by("y", "s").alias("first"), F.max_by("y", "s").alias("last"),
    )
    change = F.when(F.col("first") == 0, 0.0).otherwise((F.col("last") - F.col("first")) / F.abs("first") * 100)
    direction = F.when((F.abs(change) < 5) | (F.col("r2") < 0.3), "stable").when(F.col("slope") > 0, "increasing").otherwise("decreasing")
    return fitted.filter("periods >= 3").select(
        "client_id", "metric", "periods", F.round("slope", 4).alias("slope"), F.round("r2", 3).alias("r_squared"),
        F.round(change, 1).alias("pct_change"), direction.alias("direction"),
    )


def tenant_rankings(df: DataFrame, entity: str, metric: str, n: int = TOP_ENTITIES) -> DataFrame:
    """Top ``n`` entities per tenant by rounded mean."""
    means = df.filter(F.col(entity).isNotNull()).groupBy("client_id", F.col(entity).alias("entity")).agg(
        F.round(aggregate(metric, "mean"), 3).alias("value")
    )
    return rankings_of_means(means, metric, n)


def rankings_of_means(means: DataFrame, metric: str, n: int = TOP_ENTITIES) -> DataFrame:
    """Top ``n`` of ``client_id, entity, value`` per tenant."""
    order = Window.partitionBy("client_id").orderBy(F.desc("value"), F.asc("entity"))
    return means.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n).select(
        "client_id", F.lit(metric).alias("metric"), F.col("rank").cast("bigint").alias("rank"), "entity", "value"
    )


# ---- charts ---------------------------------------------------------------------------------


def series_color(position: Column) -> Column:
    """Palette colour of a 0-based series."""
    return F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (position % len(PALETTE)).cast("int") + 1)


def _series(names: Column) -> Column:
    return F.transform(
        names,
        lambda k, i: F.struct(k.alias("key"), F.initcap(F.replace(k, F.lit("_"), F.lit(" "))).alias("name"), series_color(i).alias("color")),
    )


def line_chart(title: Column, data: Column, x_key: str, y_keys: Column) -> Column:
    return F.struct(
        F.lit("LineChart").alias("chart_type"), title.alias("title"), data.alias("data"),
        F.struct(F.lit(x_key).alias("key"), F.lit(x_key).alias("label")).alias("x_axis"), _series(y_keys).alias("series"),
        (F.size(y_keys) > 1).alias("legend"),
    )


def bar_chart(title: Column, data: Column, x_key: str, y_keys: Column, layout: str = "vertical") -> Column:
    return F.struct(
        F.lit("BarChart").alias("chart_type"), title.alias("title"), data.alias("data"), F.lit(layout).alias("layout"),
        F.struct(F.lit(x_key).alias("key"), F.lit(x_key).alias("label")).alias("x_axis"), _series(y_keys).alias("series"),
    )


def scatter_chart(title: Column, data: Column, x_key: str, y_key: str) -> Column:
    return F.struct(
        F.lit("ScatterChart").alias("chart_type"), title.alias("title"), data.alias("data"),
        F.struct(F.lit(x_key).alias("key")).alias("x_axis"), F.struct(F.lit(y_key).alias("key")).alias("y_axis"), F.lit(PALETTE[0]).alias("color"),
    )


def pie_chart(title: Column, names: Column, values: Column, donut: bool = True) -> Column:
    data = F.transform(
        F.arrays_zip(names.alias("name"), values.alias("value")),
        lambda x, i: F.struct(x["name"].alias("name"), x["value"].alias("value"), series_color(i).alias("_color")),
    )
    return F.struct(
        F.lit("PieChart").alias("chart_type"), title.alias("title"), data.alias("data"), F.lit(donut).alias("donut"),
        F.lit(60 if donut else 0).alias("inner_radius"), F.lit(100).alias("outer_radius"),
    )


def kpi_cards(title: Column, kpis: Column) -> Column:
    cards = F.transform(
        kpis, lambda k: F.struct(title_label(k["kpi"]).alias("label"), k["value"].alias("value"), k["unit"].alias("unit"))
    )
    return F.struct(F.lit("KPICards").alias("chart_type"), title.alias("title"), cards.alias("cards"))


def heatmap(title: Column, data: Column, row_key: str, col_key: str, value_key: str, scheme: str = "blue") -> Column:
    return F.struct(
        F.lit("Heatmap").alias("chart_type"), title.alias("title"), data.alias("data"), F.lit(row_key).alias("row_key"),
        F.lit(col_key).alias("col_key"), F.lit(value_key).alias("value_key"), F.lit(scheme).alias("color_scheme"),
    )


# ---- findings, texts, report ----------------------------------------------------------------

SECTIONS = tuple(SECTION_KPIS)
PLAIN = "DECIMAL(20,3)"


def _shown(value: Column) -> Column:
    return value.cast(PLAIN).cast("string")


def findings(df: DataFrame, source: str, date: str, entity: str, metrics: Sequence[str], *, max_series: int | None = None) -> DataFrame:
    """All findings as ``(client_id, section, kind, name, text, brief)``, one row each, empty sections absent.

    Every metric of the list is in every block; ``max_series`` asks for the trends of the first few only.
    """
    metrics = list(metrics)
    kpis = checkpoint_cut(merge_files(kpi_findings(df, source), source))  # callers read the findings several times
    df = analysis_table(df, source, date, entity, metrics, kpi_inputs=False)
    blocks = {
        "kpis": kpis, "outliers": tenant_outliers(df, metrics),
        "trends": tenant_trends(df, date, metrics[:max_series]), "statistics": tenant_statistics(df, metrics), "rankings": tenant_rankings(df, entity, metrics[0]),
    }
    return findings_of(blocks, entity)


def findings_of(blocks: Mapping[str, DataFrame], entity: str) -> DataFrame:
    """The findings of ``kpis, outliers, trends, statistics`` and ``rankings``, as :func:`findings` makes them."""
    kpi = blocks["kpis"].withColumn("section", kpi_section_column(F.col("kpi")))
    value_text = F.when(
        F.col("status") == "error", F.concat(F.col("kpi"), F.lit(" = NOT COMPUTED ("), "error", F.lit(")"))
    ).otherwise(F.concat(F.col("kpi"), F.lit(" = "), _shown(F.col("value")), F.lit(" "), "unit"))
    parts = [kpi.select("client_id", "section", F.lit("kpi").alias("kind"), F.col("kpi").alias("name"), F.concat(F.lit("KPI "), value_text).alias("text"), value_text.alias("brief"))]

    def routed(frame: DataFrame, kind: str, text: Column, brief: Column) -> DataFrame:
        return frame.select("client_id", column_section(F.col("metric")).alias("section"), F.lit(kind).alias("kind"), F.col("metric").alias("name"), text.alias("text"), brief.alias("brief"))

    m = F.col("metric")
    parts.append(
        routed(
            blocks["outliers"], "outlier", F.concat(F.col("outlier_count").cast("string"), F.lit(" outliers in "), m, F.lit(" (iqr)")),
            F.concat(F.col("outlier_count").cast("string"), F.lit(" in "), m),
        )
    )
    parts.append(
        routed(
            blocks["trends"], "trend",
            F.concat(F.lit("trend of "), m, F.lit(": "), "direction", F.lit(" (r²="), _shown(F.col("r_squared")), F.lit(", slope="), F.col("slope").cast("DECIMAL(20,4)").cast("string"), F.lit(")")),
            F.concat(m, F.lit(" "), "direction", F.lit(" (r²="), _shown(F.col("r_squared")), F.lit(")")),
        )
    )
    parts.append(
        routed(
            blocks["statistics"], "stat",
            F.concat(F.lit("statistics for "), m, F.lit(": mean="), _shown(F.col("mean")), F.lit(", min="), _shown(F.col("min")), F.lit(", max="), _shown(F.col("max"))),
            F.lit(None).cast("string"),
        )
    )
    ranked = blocks["rankings"].filter("rank <= 5").groupBy("client_id", "metric").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.concat("entity", F.lit("="), _shown(F.col("value"))).alias("t")))).alias("top")
    )
    tops = F.array_join(F.transform("top", lambda x: x["t"]), ", ")
    parts.append(
        routed(
            ranked, "ranking", F.concat(F.lit(f"top {entity} by "), m, F.lit(": "), tops), F.concat(F.lit(f"Top {entity} by "), m, F.lit(": "), tops, F.lit("."))
        )
    )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.filter("section IS NOT NULL")


def report_texts(found: DataFrame, totals: DataFrame, processed_at: str) -> DataFrame:
    """Index rows: an overview and one parent per section, one child per finding.

    ``(chunk_level, parent_id, client_id, section, kind, text)``; only children are embedded.
    """
    sources = totals.select("client_id", F.array_join(F.transform("files", lambda f: f["source_file"]), ", ").alias("sources"), "total_rows", "file_count")
    prefix = F.concat("client_id", F.lit(" "), "section", F.lit(" — "))
    children = found.select(
        F.lit("child").alias("chunk_level"), F.concat("client_id", F.lit(":"), "section").alias("parent_id"), "client_id", "section", "kind",
        F.concat(prefix, "text").alias("text"),
    )

    def listed(kind: str, label: str) -> Column:
        briefs = F.transform(F.filter("f", lambda x: x["kind"] == kind), lambda x: x["brief"])
        return F.when(F.size(briefs) > 0, F.concat(F.lit(f"{label}: "), F.array_join(briefs, "; "), F.lit(".")))

    grouped = found.groupBy("client_id", "section").agg(F.array_sort(F.collect_list(F.struct("kind", "name", "brief"))).alias("f"))
    ranking = F.array_join(F.transform(F.filter("f", lambda x: x["kind"] == "ranking"), lambda x: x["brief"]), "\n")
    head = F.concat(
        F.lit("Client "), "client_id", F.lit(" — "), "section", F.lit(f" section (computed {processed_at}, from "), "sources", F.lit(").")
    )
    text = F.concat_ws("\n", head, listed("kpi", "KPIs"), listed("trend", "Trends"), listed("outlier", "Outliers"), F.nullif(ranking, F.lit("")))
    parents = grouped.join(sources, "client_id").select(
        F.lit("parent").alias("chunk_level"), F.concat("client_id", F.lit(":"), "section").alias("parent_id"), "client_id", "section",
        F.lit("section").alias("kind"), text.alias("text"),
    )
    computed = found.filter("kind = 'kpi'").groupBy("client_id").agg(F.count(F.lit(1)).alias("kpis"))
    top = sources.join(computed, "client_id", "left").select(
        F.lit("parent").alias("chunk_level"), F.concat("client_id", F.lit(":overview")).alias("parent_id"), "client_id", F.lit("overview").alias("section"),
        F.lit("overview").alias("kind"),
        F.concat(
            F.lit("Client "), "client_id", F.lit(f" — overview (computed {processed_at}). Files: "), F.col("file_count").cast("string"), F.lit(", total rows: "),
            F.col("total_rows").cast("string"), F.lit(". KPIs computed: "), F.coalesce("kpis", F.lit(0)).cast("string"), F.lit("."),
        ).alias("text"),
    )
    return top.unionByName(parents).unionByName(children)


def tenant_report(df: DataFrame, files: DataFrame, source: str, date: str, entity: str, metrics: Sequence[str], *, max_series: int | None = None) -> DataFrame:
    """One JSON dashboard per tenant: ``overview`` and seven sections of KPIs, statistics, outliers, trends and charts.

    Every metric of the list is in every block; ``max_series`` asks for the trends of the first few only. Every block is a handful of rows per tenant by the time it is collected into the report.
    """
    metrics = list(metrics)
    kpi = merge_files(kpi_findings(df, source), source)
    df = analysis_table(df, source, date, entity, metrics, kpi_inputs=False)
    sections = F.array(*[F.lit(s) for s in SECTIONS])
    frame = overview(files)

    def per_section(rows: DataFrame, name: str, cell: Column, section: Column) -> DataFrame:
        placed = rows.select("client_id", section.alias("section"), cell.alias("cell")).filter("section IS NOT NULL")
        grouped = placed.groupBy("client_id", "section").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
        return grouped.groupBy("client_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "cells"))).alias(name))

    m = column_section(F.col("metric"))
    blocks = {
        "kpis": per_section(kpi, "kpis", F.struct("kpi", "value", "unit", "status"), kpi_section_column(F.col("kpi"))),
        "statistics": per_section(tenant_statistics(df, metrics), "statistics", F.struct("metric", "mean", "std", "min", "max"), m),
        "outliers": per_section(tenant_outliers(df, metrics), "outliers", F.struct("metric", "outlier_count", "outlier_pct"), m),
        "trends": per_section(tenant_trends(df, date, metrics[:max_series]), "trends", F.struct("metric", "direction", "slope", "r_squared"), m),
    }
    ranked = tenant_rankings(df, entity, metrics[0]).groupBy("client_id", "metric").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity", "value"))), lambda x: F.struct(x["entity"].alias("entity"), x["value"].alias("value"))).alias("data")
    )
    chart = bar_chart(F.concat(F.lit("Top "), title_label(F.lit(entity))), F.col("data"), "entity", F.array(F.lit("value")))
    blocks["charts"] = per_section(ranked, "charts", F.to_json(chart), m)
    for block in blocks.values():
        frame = frame.join(block, "client_id", "left")
    body = F.transform(
        sections,
        lambda s: F.struct(
            s.alias("section"), *[F.coalesce(F.try_element_at(F.col(name), s), F.array()).alias(name) for name in blocks]
        ),
    )
    counted = F.transform(sections, lambda s: F.struct(s.alias("section"), F.coalesce(F.size(F.try_element_at("kpis", s)), F.lit(0)).alias("n")))
    total = F.aggregate(counted, F.lit(0), lambda acc, x: acc + x["n"])
    head = F.struct(
        "total_rows", "file_count", "failed_files", "files", F.struct(total.alias("total_computed"), counted.alias("by_section")).alias("kpi_summary")
    )
    return frame.select("client_id", F.to_json(F.struct(F.col("client_id"), head.alias("overview"), body.alias("sections"))).alias("report"))
