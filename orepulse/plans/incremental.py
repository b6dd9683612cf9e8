"""Tenant analysis from stored per-file states: only changed files are read again, the report is merged from the states of all.

A file's state is what its rows add to the tenant's results: its KPIs, the counts of its columns, each metric's counted values (from which
count, mean, deviation, range, quartiles and outliers follow exactly), sums per period and sums per entity. States of files add up, so a
changed file replaces its own state and nothing else.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orepulse.functions.numbers import exact_sum
from orepulse.functions.text import title_label
from orepulse.operators.kpi import SECTION_KPIS
from orepulse.operators.quantiles import grouped_quantiles
from orepulse.operators.retrieval import embed
from orepulse.operators.schema import column_section, kpi_section_column
from orepulse.operators.stats import FREQUENCIES, period_end
from orepulse.plans.dashboard import (
    TOP_ENTITIES, bar_chart, findings_of, kpi_cards, kpi_findings, line_chart, merge_files, outliers_of_counts, rankings_of_means, report_texts,
    trends_of_periods,
)
from orepulse.session import checkpoint_cut
from orepulse.sources.ledger import append_ledger, read_ledger, stale_clients, stale_files
from orepulse.sources.snapshots import latest_version, read_current, replace_keys

STATE = "client_id string, source_file string, kind string, name string, label string, moment timestamp, value double, n bigint, unit string, status string, error string"
MANY_NULLS = 10.0  # fixed value: percent of nulls from which a column is listed


def file_states(df: DataFrame, source: str, date: str, entity: str, metrics: Sequence[str], *, freq: str = "W") -> DataFrame:
    """The states of all files in ``df`` (``client_id``, ``source``, measures), in the columns of ``STATE``.

    ``kind`` is ``file`` (rows and columns), ``column`` (values that are not null), ``kpi``, ``value`` (how often a metric has a value),
    ``period`` and ``entity`` (sum and count of a metric).
    """
    metrics = list(metrics)
    rows = checkpoint_cut(df)  # four groupings follow
    key = ["client_id", F.col(source).alias("source_file")]
    columns = [c for c in df.columns if c not in ("client_id", source)]

    def states(frame: DataFrame, kind: str, **given) -> DataFrame:
        made = {"kind": F.lit(kind), **given}
        return frame.select(
            "client_id", "source_file",
            *[(made[f] if f in made else F.lit(None)).cast(t).alias(f) for f, t in (x.rsplit(" ", 1) for x in STATE.split(", ")) if f not in ("client_id", "source_file")],
        )

    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)])
    cells = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"n{i}").alias("k")) for i, c in enumerate(columns)])
    counts = checkpoint_cut(counts.select("client_id", "source_file", "rows", cells.alias("cells")))
    parts = [
        states(counts, "file", n=F.col("rows"), value=F.lit(len(columns)), status=F.lit("ok")),
        states(counts.select("client_id", "source_file", F.inline("cells")), "column", name=F.col("c"), n=F.col("k")),
    ]
    kpi = kpi_findings(rows, source).withColumnRenamed(source, "source_file")
    parts.append(states(kpi, "kpi", name=F.col("kpi"), value=F.col("value"), unit=F.col("unit"), status=F.col("status"), error=F.col("error")))
    long = rows.select(*key, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["client_id", "source_file"], metrics, "metric", "v")
    values = long.filter("v IS NOT NULL").groupBy("client_id", "source_file", "metric", "v").agg(F.count(F.lit(1)).alias("k"))
    parts.append(states(values, "value", name=F.col("metric"), value=F.col("v"), n=F.col("k")))

    def sums(by: str, where: DataFrame, wanted: Sequence[str]) -> DataFrame:
        made = where.groupBy("client_id", "source_file", by).agg(*[x for i, m in enumerate(wanted) for x in (exact_sum(m).alias(f"s{i}"), F.count(m).alias(f"k{i}"))])
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"s{i}").alias("s"), F.col(f"k{i}").alias("k")) for i, m in enumerate(wanted)])
        return made.select("client_id", "source_file", by, F.inline(pairs)).filter("k > 0")

    start = F.date_trunc(FREQUENCIES[freq][0], F.col(date)).alias("at")
    dated = rows.filter(F.col(date).isNotNull()).select(*key, start, *metrics)
    parts.append(states(sums("at", dated, metrics), "period", name=F.col("metric"), moment=F.col("at"), value=F.col("s"), n=F.col("k")))
    owned = rows.filter(F.col(entity).isNotNull()).select(*key, F.col(entity).cast("string").alias("who"), metrics[0])
    parts.append(states(sums("who", owned, metrics[:1]), "entity", name=F.col("metric"), label=F.col("who"), value=F.col("s"), n=F.col("k")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def merged_blocks(states: DataFrame, metrics: Sequence[str], *, freq: str = "W") -> dict[str, DataFrame]:
    """Per tenant, from the states of its files: ``files, quality, kpis, statistics, outliers, trends, series`` and ``rankings``."""
    of = lambda kind: states.filter(F.col("kind") == kind)
    files = of("file").select("client_id", "source_file", "status", F.col("n").alias("row_count"), F.col("value").cast("bigint").alias("column_count"), "error")
    share = F.round((F.col("row_count") - F.col("n")) / F.col("row_count") * 100, 1)
    quality = of("column").join(files.select("client_id", "source_file", "row_count"), ["client_id", "source_file"]).select(
        "client_id", "source_file", F.col("name").alias("column"), (F.col("row_count") - F.col("n")).alias("null_count"), share.alias("null_pct")
    ).filter(F.col("null_pct") > MANY_NULLS)
    kpis = merge_files(of("kpi").select("client_id", "source_file", F.col("name").alias("kpi"), "value", "unit", "status", "error"), "source_file")
    counted = checkpoint_cut(of("value").groupBy("client_id", F.col("name").alias("metric"), "value").agg(F.sum("n").alias("n")))
    by = ["client_id", "metric"]
    firsts = counted.groupBy(*by).agg(F.sum("n").alias("rows"), (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    apart = counted.join(firsts.select(*by, "m"), by).groupBy(*by).agg(F.sum(F.col("n") * F.pow(F.col("value") - F.col("m"), 2)).alias("squares"))
    quarters = grouped_quantiles(counted, by, "value", (0.25, 0.5, 0.75))
    statistics = firsts.join(apart, by).join(quarters, by).select(
        *by, F.col("rows").alias("n"), F.round("m", 3).alias("mean"), F.round(F.sqrt(F.col("squares") / F.nullif(F.col("rows") - 1, F.lit(0))), 3).alias("std"),
        F.round("lo", 3).alias("min"), F.round("hi", 3).alias("max"), *[F.round(F.col("q")[i], 3).alias(c) for i, c in enumerate(("p25", "median", "p75"))],
    )
    means = of("period").groupBy("client_id", F.col("name").alias("metric"), F.col("moment").alias("s")).agg((F.sum("value") / F.sum("n")).alias("y"))
    means = checkpoint_cut(means)
    series = means.select(*by, period_end(F.col("s"), freq).alias("period_end"), F.round("y", 3).alias("value"))
    owned = of("entity").groupBy("client_id", F.col("label").alias("entity")).agg(F.round(F.sum("value") / F.sum("n"), 3).alias("value"))
    return {
        "files": files, "quality": quality, "kpis": kpis, "statistics": statistics, "outliers": outliers_of_counts(counted), "trends": trends_of_periods(means),
        "series": series, "rankings": rankings_of_means(owned, metrics[0]),
    }


def report_of(blocks: dict[str, DataFrame], entity: str, *, failed: DataFrame | None = None) -> DataFrame:
    """``client_id, report``: one JSON dashboard per tenant from :func:`merged_blocks`.

    The overview has totals, every file with its status and error, columns with many nulls and the KPI count per section. A section has
    its KPIs, statistics with quartiles, outliers with bounds, trends, series, and charts: a line per metric, the ranking, and cards of
    its KPIs. ``failed`` (``client_id, source_file, error``) adds files that could not be read; their tenants have a report even if none
    of their files could. Lists are ordered by name or rank.
    """
    files = blocks["files"]
    if failed is not None:
        none = F.lit(None).cast("bigint")
        files = files.unionByName(failed.select("client_id", "source_file", F.lit("error").alias("status"), none.alias("row_count"), none.alias("column_count"), "error"))
    frame = files.groupBy("client_id").agg(
        F.coalesce(F.sum("row_count"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("file_count"), F.count_if(F.col("status") == "error").alias("failed_files"),
        F.array_sort(F.collect_list(F.struct("source_file", "status", "row_count", "column_count", "error"))).alias("files"),
    )
    listed = blocks["quality"].groupBy("client_id").agg(F.array_sort(F.collect_list(F.struct("source_file", "column", "null_count", "null_pct"))).alias("data_quality"))
    frame = frame.join(listed, "client_id", "left")
    m = column_section(F.col("metric"))

    def per_section(rows: DataFrame, name: str, cell, section) -> DataFrame:
        placed = rows.select("client_id", section.alias("section"), cell.alias("cell")).filter("section IS NOT NULL")
        grouped = placed.groupBy("client_id", "section").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
        return grouped.groupBy("client_id").agg(F.map_from_entries(F.collect_list(F.struct("section", "cells"))).alias(name))

    kpi_section = kpi_section_column(F.col("kpi"))
    points = blocks["series"].groupBy("client_id", "metric").agg(F.array_sort(F.collect_list(F.struct("period_end", "value"))).alias("data"))
    lines = line_chart(F.concat(title_label(F.col("metric")), F.lit(" over time")), F.col("data"), "period_end", F.array(F.lit("value")))
    ranked = blocks["rankings"].groupBy("client_id", "metric").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity", "value"))), lambda x: F.struct(x["entity"].alias("entity"), x["value"].alias("value"))).alias("data")
    )
    bars = bar_chart(F.concat(F.lit("Top "), title_label(F.lit(entity))), F.col("data"), "entity", F.array(F.lit("value")))
    shown = blocks["kpis"].filter("status = 'computed'").select("client_id", "kpi", "value", "unit", kpi_section.alias("section")).filter("section IS NOT NULL")
    cards = shown.groupBy("client_id", "section").agg(F.array_sort(F.collect_list(F.struct("kpi", "value", "unit"))).alias("data"))
    cards = cards.select("client_id", F.col("section"), F.to_json(kpi_cards(F.concat(title_label(F.col("section")), F.lit(" KPIs")), F.col("data"))).alias("chart"))
    charts = points.select("client_id", m.alias("section"), F.to_json(lines).alias("chart")).unionByName(ranked.select("client_id", m.alias("section"), F.to_json(bars).alias("chart"))).unionByName(cards)
    made = {
        "kpis": per_section(blocks["kpis"], "kpis", F.struct("kpi", "value", "unit", "status", "error"), kpi_section),
        "statistics": per_section(blocks["statistics"], "statistics", F.struct("metric", "n", "mean", "std", "min", "p25", "median", "p75", "max"), m),
        "outliers": per_section(blocks["outliers"], "outliers", F.struct("metric", "outlier_count", "outlier_pct", "lower_bound", "upper_bound"), m),
        "trends": per_section(blocks["trends"], "trends", F.struct("metric", "direction", "slope", "r_squared", "pct_change", "periods"), m),
        "series": per_section(points, "series", F.struct("metric", "data"), m),
        "charts": per_section(charts, "charts", F.col("chart"), F.col("section")),
    }
    for part in made.values():
        frame = frame.join(part, "client_id", "left")
    names = F.array(*[F.lit(s) for s in SECTION_KPIS])
    body = F.transform(names, lambda s: F.struct(s.alias("section"), *[F.coalesce(F.try_element_at(F.col(c), s), F.array()).alias(c) for c in made]))
    counted = F.transform(names, lambda s: F.struct(s.alias("section"), F.coalesce(F.size(F.try_element_at("kpis", s)), F.lit(0)).alias("n")))
    total = F.aggregate(counted, F.lit(0), lambda acc, x: acc + x["n"])
    head = F.struct(
        "total_rows", "file_count", "failed_files", "files", F.coalesce("data_quality", F.array()).alias("data_quality"),
        F.struct(total.alias("total_computed"), counted.alias("by_section")).alias("kpi_summary"),
    )
    return frame.select("client_id", F.to_json(F.struct("client_id", head.alias("overview"), body.alias("sections"))).alias("report"))


def refresh_states(
    spark: SparkSession, files: DataFrame, ledger: DataFrame, states: str, read: Callable[[DataFrame], DataFrame], *, version: str, source: str, date: str,
    entity: str, metrics: Sequence[str], force: bool = False,
) -> DataFrame:
    """Bring the stored states up to date: ``client_id, source_file, signature, reason`` of the current files, written down.

    Only files with a reason are read (``read`` gets their names and gives their rows); their states replace the old ones in one step,
    and the states of files that are gone go with it.
    """
    judged = stale_files(files, ledger, version)
    judged = checkpoint_cut(judged.withColumn("reason", F.coalesce("reason", F.lit("forced"))) if force else judged)
    stale = judged.filter("reason IS NOT NULL").select("source_file")
    known = read_current(spark, states).select("source_file").distinct() if latest_version(spark, states) else spark.createDataFrame([], "source_file string")
    gone = checkpoint_cut(known.join(judged.select("source_file"), "source_file", "left_anti"))
    if not stale.isEmpty():
        replace_keys(file_states(read(stale), source, date, entity, metrics), states, "source_file", clear=stale.unionByName(gone))
    elif not gone.isEmpty():
        replace_keys(spark.createDataFrame([], STATE), states, "source_file", clear=gone)
    return judged


def ingest_analysis(
    spark: SparkSession, files: DataFrame, ledger: str, states: str, index: str, read: Callable[[DataFrame], DataFrame], *, version: str, processed_at: str,
    source: str, date: str, entity: str, metrics: Sequence[str], dimension: int = 1024, embedder=None, force: bool = False,
) -> DataFrame:
    """Index the analysis of every tenant with a stale file: ``client_id, action, files, indexed``.

    ``files``: ``client_id, source_file, signature``. The states of changed files are refreshed, the stale tenants' findings rendered from
    the states of all their files as an overview, parents per section and children per finding, the children embedded, and the tenant's
    rows in the index (a snapshot table by tenant) replaced in one step. The ledger gets its records after that, so a run that dies is
    repeated; tenants that are up to date are not touched. ``action`` is ``indexed``, ``skipped``, or ``error`` if nothing was rendered.
    """
    book = read_ledger(spark, ledger)
    due = checkpoint_cut(stale_clients(files, book, version, force).join(files.groupBy("client_id").agg(F.count(F.lit(1)).alias("files")), "client_id"))
    clients = due.filter("stale").select("client_id")
    if clients.isEmpty():
        return due.select("client_id", F.lit("skipped").alias("action"), "files", F.lit(0).cast("bigint").alias("indexed"))
    judged = refresh_states(spark, files, book, states, read, version=version, source=source, date=date, entity=entity, metrics=metrics, force=force)
    current = read_current(spark, states).join(clients, "client_id", "left_semi")
    blocks = merged_blocks(current, metrics)
    totals = blocks["files"].groupBy("client_id").agg(
        F.sum("row_count").alias("total_rows"), F.count(F.lit(1)).alias("file_count"), F.array_sort(F.collect_list(F.struct("source_file"))).alias("files")
    )
    texts = checkpoint_cut(report_texts(findings_of(blocks, entity), totals, processed_at).withColumn("row_id", F.xxhash64("parent_id", "chunk_level", "kind", "text")))
    vectors = embed(texts.filter("chunk_level = 'child'"), "row_id", "text", dimension=dimension, embedder=embedder)
    replace_keys(texts.join(vectors, "row_id", "left"), index, "client_id", clear=clients)
    counted = read_current(spark, index).groupBy("client_id").agg(F.count(F.lit(1)).alias("indexed"))
    result = checkpoint_cut(due.join(counted, "client_id", "left").select(
        "client_id", F.when(~F.col("stale"), "skipped").when(F.col("indexed") > 0, "indexed").otherwise("error").alias("action"), "files",
        F.when(F.col("stale"), F.coalesce("indexed", F.lit(0))).otherwise(F.lit(0)).alias("indexed"),
    ))
    last = book.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    done = judged.join(result.filter("action = 'indexed'").select("client_id"), "client_id", "left_semi")
    append_ledger(
        done.select(
            F.lit(last + 1).cast("bigint").alias("seq"), "client_id", "source_file", F.col("signature").alias("content_signature"),
            F.lit(version).alias("pipeline_version"), F.lit("indexed").alias("status"),
        ),
        ledger,
    )
    return result
