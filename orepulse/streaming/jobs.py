"""Structured Streaming forms of ingestion, live aggregates and alerts."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from orepulse.functions.numbers import exact_mean
from orepulse.operators.insights import breach
from orepulse.sources import snapshots
from orepulse.sources.folders import is_there
from orepulse.sources.ledger import append_ledger
from orepulse.sources.sinks import overwrite_keys


def _mean(value: str) -> Column:
    return F.round(exact_mean(value), 3)


def file_stream(spark: SparkSession, path: str, schema: str, *, fmt: str = "parquet", per_trigger: int = 1000, **options: str) -> DataFrame:
    """New files under ``path`` as a stream."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load(path)


def ingest_new_files(stream: DataFrame, target: str, checkpoint: str, *, partition: str | None = None) -> StreamingQuery:
    """Copy what arrived since the last run and stop; a scheduler simply runs it again."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", target)
    if partition:
        writer = writer.partitionBy(partition)
    return writer.trigger(availableNow=True).start()


def replace_by_key_stream(
    stream: DataFrame,
    target: str,
    key: str,
    checkpoint: str,
    *,
    ledger: str | None = None,
    records: Callable[[DataFrame, int], DataFrame] | None = None,
) -> StreamingQuery:
    """A run replaces the key folders it touches; the ledger is written only after that succeeded.

    All files that are new when the run starts form one batch, however many there are, so that no later batch of the same run can
    replace what an earlier one wrote. A run that fails is repeated as a whole with the same batch number.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        overwrite_keys(batch, target, key)
        if ledger and records:
            append_ledger(records(batch, batch_id), ledger)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(once=True).start()


def refresh_keys(
    stream: DataFrame, target: str, key: str, checkpoint: str, *, ledger: str | None = None, records: Callable[[DataFrame], DataFrame] | None = None,
) -> list[str]:
    """Replace, in a snapshot table, the rows of every key that arrived since the last run, and return the runs that were committed.

    New files are taken in batches as small as the stream's ``maxFilesPerTrigger`` asks, each staged under its batch number, so that a
    batch that is repeated replaces itself. When all of them are staged, one step makes their rows the only ones of their keys: a key
    whose rows arrive in several batches keeps them all, readers never see half a run, and a run that dies leaves the old rows; the next
    one goes on after the batches that are done and commits these with its own. ``records`` makes ledger records from the rows of the
    last commit; they are appended after it, and again by the next run if that failed (equal records are not written twice).
    """
    spark = stream.sparkSession
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def stage(batch: DataFrame, batch_id: int) -> None:
        snapshots.stage_rows(batch, target, key, f"{own}-{batch_id:09d}")

    stream.writeStream.foreachBatch(stage).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    done = set(snapshots.committed_runs(spark, target)) if is_there(spark, f"{target}/table.json") else set()
    waiting = [r for r in snapshots.staged_runs(spark, target) if r.startswith(f"{own}-") and r not in done]
    if waiting:
        snapshots.commit_runs(spark, target, waiting)
    if ledger and records and (last := snapshots.latest_version(spark, target)):
        fresh = snapshots.version_keys(spark, target).where(F.col("rows").isNotNull() & (F.col("since") == last)).select(F.col("key").alias("_fresh"))
        rows = snapshots.read_current(spark, target)
        append_ledger(records(rows.join(fresh, F.col(key).eqNullSafe(F.col("_fresh")), "left_semi")), ledger)
    return waiting


def hourly_mean_stream(stream: DataFrame, moment: str, value: str, *, lateness: str = "1 hour") -> DataFrame:
    """Mean per tumbling hour."""
    windowed = stream.withWatermark(moment, lateness).groupBy(F.window(moment, "1 hour"))
    return windowed.agg(_mean(value).alias("mean_value"), F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("hour"), "mean_value", "n"
    )


def sliding_mean_stream(
    stream: DataFrame, moment: str, value: str, keys: Sequence[str], *, width: str = "7 days", slide: str = "1 day", lateness: str = "1 day"
) -> DataFrame:
    """Mean per key over a sliding window."""
    windowed = stream.withWatermark(moment, lateness).groupBy(F.window(moment, width, slide), *keys)
    return windowed.agg(_mean(value).alias("mean_value"), F.count(F.lit(1)).alias("n")).select(
        F.col("window.start").alias("from"), F.col("window.end").alias("to"), *keys, "mean_value", "n"
    )


def activity_sessions(stream: DataFrame, moment: str, key: str, *, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Runs of activity per equipment separated by idle gaps."""
    windowed = stream.withWatermark(moment, lateness).groupBy(F.session_window(moment, gap), key)
    return windowed.agg(F.count(F.lit(1)).alias("events")).select(
        key, F.col("session_window.start").alias("from"), F.col("session_window.end").alias("to"), "events"
    )


def without_late_duplicates(stream: DataFrame, moment: str, ids: Sequence[str], *, lateness: str = "1 hour") -> DataFrame:
    """Drop repeats of an id that arrive within the watermark."""
    return stream.withWatermark(moment, lateness).dropDuplicatesWithinWatermark(list(ids))


def threshold_alerts(stream: DataFrame, rules: Sequence[Mapping]) -> DataFrame:
    """One row per breached rule; stateless, so it also runs on a batch."""
    hits = [
        F.when(
            breach(r),
            F.struct(F.lit(r["label"]).alias("rule"), F.lit(r.get("severity", "warning")).alias("severity"),
                     F.col(r["column"]).cast("double").alias("measured")),
        )
        for r in rules
    ]
    return stream.select("*", F.inline(F.array_compact(F.array(*hits))))
