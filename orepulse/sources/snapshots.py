"""Tables whose keys are replaced as a whole, with one atomic switch per change.

Rows lie in run folders that never change once they are committed. A version is a small table that says which run holds which key, and it
counts only when Spark has marked it as complete. Readers take the newest complete version, so they see either all of a replacement or
nothing of it, and a writer that dies leaves the old rows in place. A table has one writer at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orepulse.sources.folders import get_record, is_there, names_in, put_record, remove

MOST_BROADCAST = 400_000  # entries of a version (two short columns) that are sent to the tasks; more are joined by a shuffle


def _version(path: str, number: int) -> str:
    return f"{path}/versions/v={number:09d}"


def _described(spark: SparkSession, path: str) -> tuple[str, T.StructType]:
    """The table's key column and the columns of its rows."""
    record = get_record(spark, f"{path}/table.json")
    return record["key"], T.StructType.fromJson(record["schema"])


def _runs(spark: SparkSession, path: str, schema: T.StructType, runs: Sequence[str]) -> DataFrame:
    wide = T.StructType([*schema.fields, T.StructField("run", T.StringType())])
    return spark.read.schema(wide).option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/run={r}" for r in runs])


def stage_rows(df: DataFrame, path: str, key: str, run: str) -> None:
    """Write the rows of a run, clustered by ``key``; nobody sees them before ``commit_runs``. A run that is repeated replaces itself."""
    spark = df.sparkSession
    if not is_there(spark, f"{path}/table.json"):
        put_record(spark, f"{path}/table.json", {"key": key, "schema": df.schema.jsonValue()})
    kept_by, schema = _described(spark, path)
    if kept_by != key or [(f.name, f.dataType) for f in schema] != [(f.name, f.dataType) for f in df.schema]:
        raise ValueError(f"{path} is kept by '{kept_by}' with the columns {', '.join(schema.names)}")
    df.hint("rebalance", key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/rows/run={run}")


def staged_runs(spark: SparkSession, path: str) -> list[str]:
    """Runs whose rows are complete, committed or not."""
    runs = [n.removeprefix("run=") for n in names_in(spark, f"{path}/rows")]
    return [r for r in runs if is_there(spark, f"{path}/rows/run={r}/_SUCCESS")]


def latest_version(spark: SparkSession, path: str) -> int:
    """Number of the newest complete version, 0 for a table that has none."""
    numbers = sorted((int(n.removeprefix("v=")) for n in names_in(spark, f"{path}/versions")), reverse=True)
    return next((n for n in numbers if is_there(spark, _version(path, n) + "/_SUCCESS")), 0)


def version_keys(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """``key, run, rows, since``: which run holds a key, with how many rows, and since which version.

    Each committed run also has an entry without rows, as long as the table lives.
    """
    number = latest_version(spark, path) if version is None else version
    if not number:
        raise FileNotFoundError(f"{path} has no committed version")
    return spark.read.parquet(_version(path, number))


def committed_runs(spark: SparkSession, path: str, since: int = 0) -> list[str]:
    """Names of the runs that versions after ``since`` brought in."""
    if not latest_version(spark, path):
        return []
    marks = version_keys(spark, path).where(F.col("rows").isNull() & (F.col("since") > since))
    return sorted(r["run"] for r in marks.select("run").collect())  # one row per run


def commit_runs(spark: SparkSession, path: str, runs: Sequence[str], clear: DataFrame | None = None) -> int:
    """Make the rows of staged ``runs`` the only ones of their keys; keys in ``clear`` lose their rows even if no run has new ones.

    Returns the number of the new version. Of the runs only the key column is read.
    """
    key, schema = _described(spark, path)
    last = latest_version(spark, path)
    entry = T.StructType([T.StructField("key", schema[key].dataType), T.StructField("run", T.StringType()), T.StructField("rows", T.LongType())])
    entries = spark.createDataFrame([(None, r, None) for r in runs], entry)
    touched = spark.createDataFrame([], T.StructType([entry["key"]]))
    if runs:
        held = _runs(spark, path, schema, runs).groupBy(F.col(key).alias("key"), "run").agg(F.count(F.lit(1)).alias("rows"))
        entries, touched = entries.unionByName(held), touched.unionByName(held.select("key"))
    if clear is not None:
        touched = touched.unionByName(clear.select(F.col(key).cast(schema[key].dataType).alias("key")))
    entries = entries.withColumn("since", F.lit(last + 1).cast("long"))
    if last:
        same = F.col("o.key").eqNullSafe(F.col("t.key")) & F.col("o.rows").isNotNull()
        entries = version_keys(spark, path, last).alias("o").join(touched.distinct().alias("t"), same, "left_anti").unionByName(entries)
    entries.write.mode("overwrite").parquet(_version(path, last + 1))  # what lies there already is incomplete, from a writer that died
    return last + 1


def replace_keys(df: DataFrame, path: str, key: str, clear: DataFrame | None = None) -> int:
    """Replace the rows of every key in ``df`` (and of those in ``clear``) by the rows of ``df``; returns the new version's number.

    A null key is a key like any other.
    """
    run = uuid.uuid4().hex
    stage_rows(df, path, key, f"r{run}")
    return commit_runs(df.sparkSession, path, [f"r{run}"], clear)


def read_current(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of ``version``; only runs that it names are opened."""
    key, schema = _described(spark, path)
    keys = version_keys(spark, path, version).where("rows IS NOT NULL").select(F.col("key").alias("_key"), F.col("run").alias("_run"))
    runs = sorted(r["_run"] for r in keys.select("_run").distinct().collect())  # as many as writes since the last clean-up
    if not runs:
        return spark.createDataFrame([], schema)
    known = F.broadcast(keys) if keys.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else keys
    own = (F.col("run") == F.col("_run")) & F.col(key).eqNullSafe(F.col("_key"))
    return _runs(spark, path, schema, runs).join(known, own, "left_semi").select(*schema.names)


def clean_up(spark: SparkSession, path: str, keep: int = 2) -> list[str]:
    """Remove all but the ``keep`` newest versions, and committed runs that none of these reads; returns the removed runs.

    Readers of older versions must be done. Staged runs that wait for their commit stay.
    """
    last = latest_version(spark, path)
    numbers = [n for n in (int(x.removeprefix("v=")) for x in names_in(spark, f"{path}/versions")) if n <= last]
    complete = [n for n in numbers if is_there(spark, _version(path, n) + "/_SUCCESS")]
    used: set[str] = set()
    for number in complete[-keep:]:
        used |= {r["run"] for r in version_keys(spark, path, number).where("rows IS NOT NULL").select("run").distinct().collect()}
    gone = [r for r in committed_runs(spark, path) if r not in used and is_there(spark, f"{path}/rows/run={r}")]
    for number in set(numbers) - set(complete[-keep:]):
        remove(spark, _version(path, number))
    for run in gone:
        remove(spark, f"{path}/rows/run={run}")
    return gone
