"""The processing ledger: append-only records, last state wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

LEDGER_SCHEMA = (
    "seq bigint, client_id string, source_file string, content_signature string, pipeline_version string, status string"
)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All records; malformed lines are skipped and a missing ledger is empty."""
    try:
        return spark.read.schema(LEDGER_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER_SCHEMA)


def append_ledger(records: DataFrame, path: str) -> None:
    """Add the records that the ledger does not hold yet, so that a repeated batch writes nothing twice."""
    known = read_ledger(records.sparkSession, path)
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"k.{c}")) for c in records.columns]
    records.alias("r").join(known.select(*records.columns).alias("k"), same, "left_anti").write.mode("append").json(path)


def latest_states(ledger: DataFrame) -> DataFrame:
    state = F.struct("content_signature", "pipeline_version", "status")
    return ledger.groupBy("client_id", "source_file").agg(F.max_by(state, "seq").alias("s")).select(
        "client_id", "source_file", "s.*"
    )


def stale_files(files: DataFrame, ledger: DataFrame, version: str) -> DataFrame:
    """Current files with the reason each needs processing, null when it is up to date.

    ``files``: ``client_id, source_file, signature``.
    """
    joined = files.join(latest_states(ledger), ["client_id", "source_file"], "left")
    reason = (
        F.when(F.col("status").isNull() & F.col("content_signature").isNull(), "absent")
        .when(~F.col("content_signature").eqNullSafe(F.col("signature")), "changed")
        .when(~F.col("pipeline_version").eqNullSafe(F.lit(version)), "version")
        .when(~F.col("status").eqNullSafe(F.lit("indexed")), "status")
    )
    return joined.select("client_id", "source_file", "signature", reason.alias("reason"))


def stale_clients(files: DataFrame, ledger: DataFrame, version: str, force: bool = False) -> DataFrame:
    """Whether each client that has files needs another run."""
    return stale_files(files, ledger, version).groupBy("client_id").agg(
        (F.bool_or(F.col("reason").isNotNull()) | F.lit(force)).alias("stale"),
        F.count_if(F.col("reason").isNotNull()).alias("stale_files"),
    )
