"""Replace-by-key writes, counted writes and report files."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def replace_by_key(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows after replacing every key present in ``incoming``: old rows of other keys plus all new rows."""
    touched = incoming.select(*keys).distinct()
    return existing.join(touched, list(keys), "left_anti").unionByName(incoming)


def overwrite_keys(df: DataFrame, path: str, key: str) -> None:
    """Replace whole key folders of a parquet table; other keys are not read or rewritten."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key)
        .parquet(path)
    )


def write_counted(
    df: DataFrame, save: Callable[[DataFrame], None], valid: str = "true", rejects: Callable[[DataFrame], None] | None = None
) -> dict[str, int]:
    """Save the valid rows and return ``{indexed, failed}``, counted while writing; ``rejects`` saves the others."""
    counts = Observation()
    flagged = df.withColumn("_ok", F.coalesce(F.expr(valid), F.lit(False))).observe(
        counts, F.count_if("_ok").alias("indexed"), F.count_if(~F.col("_ok")).alias("failed")
    )
    save(flagged.filter("_ok").drop("_ok"))
    if rejects is not None:
        rejects(df.filter(~F.coalesce(F.expr(valid), F.lit(False))))
    return dict(counts.get)


def write_reports(reports: DataFrame, path: str, client: str = "client_id", text: str = "report") -> None:
    """One JSON report line per tenant, one folder per tenant."""
    reports.select(client, F.col(text).alias("value")).write.mode("overwrite").partitionBy(client).text(path)


def index_counts(indexes: dict[str, DataFrame]) -> DataFrame:
    """Rows per named index."""
    parts = [df.select(F.lit(name).alias("index")) for name, df in indexes.items()]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union.groupBy("index").agg(F.count(F.lit(1)).alias("documents"))


def vectors_per_source(vectors: DataFrame, source: str) -> DataFrame:
    """Stored vectors per source; rows without one count as unknown."""
    return vectors.groupBy(F.coalesce(F.col(source), F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("vectors"))
