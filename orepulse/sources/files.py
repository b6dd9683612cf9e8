"""Tenant files: listing, reading, and the text formats between stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orepulse.operators.reshape import coerce_dates, normalise_headers


def list_files(spark: SparkSession, root: str, suffix: str = ".csv", content_signature: bool = False) -> DataFrame:
    """``(path, client_id, length, modified, signature)`` of the files below ``root``.

    The suffix is compared without case. The signature is built from size and time; with
    ``content_signature`` it is a digest of the bytes, which reads every file.
    """
    found = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        .filter(F.lower("path").endswith(suffix.lower()))
    )
    relative = F.replace(F.col("path"), F.lit(_uri(root)), F.lit(""))
    cheap = F.md5(F.concat_ws("|", F.col("length").cast("string"), F.col("modificationTime").cast("string")))
    return found.select(
        F.regexp_replace(relative, "^/+", "").alias("path"),
        F.split(F.regexp_replace(relative, "^/+", ""), "/")[0].alias("client_id"),
        "length",
        F.col("modificationTime").alias("modified"),
        (F.sha2("content", 256) if content_signature else cheap).alias("signature"),
    )


def _uri(root: str) -> str:
    return root if "://" in root else f"file:{root}"


def list_folder(spark: SparkSession, root: str, client: str) -> DataFrame:
    """The tenant's CSV files, sorted."""
    return list_files(spark, root).filter(F.col("client_id") == client).select("path").orderBy("path")


def discover_tenants(files: DataFrame) -> DataFrame:
    return files.select("client_id").distinct().orderBy("client_id")


def client_signature(files: DataFrame) -> DataFrame:
    """``file=signature`` pairs, sorted and joined, per client. One row per *file* goes in, not per record."""
    pair = F.concat("path", F.lit("="), "signature")
    return files.groupBy("client_id").agg(F.array_join(F.array_sort(F.collect_set(pair)), ";").alias("signature"))


def load_csv(
    spark: SparkSession,
    path: str,
    *,
    schema: T.StructType | str | None = None,
    date_columns: Sequence[str] | None = None,
    as_text: bool = False,
    comment: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV with a header row: clean headers, typed columns, dates parsed leniently.

    ``multi_line`` reads quoted fields that hold line breaks, at the price of one task per file.

    Give ``schema`` for large inputs, inference reads the data twice. ``as_text`` keeps raw strings.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("multiLine", multi_line).option("escape", '"')
    if comment:
        reader = reader.option("comment", comment)
    if schema is not None:
        return coerce_dates(normalise_headers(reader.schema(schema).csv(path)), date_columns)
    # An explicit format keeps inference from reading ids such as T1 as a time of day; dates are parsed below.
    reader = reader.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").option("inferSchema", not as_text)
    df = normalise_headers(reader.csv(path))
    return df if as_text else coerce_dates(df, date_columns)


def load_tenant(spark: SparkSession, root: str, client: str, schemas: dict[str, str]) -> DataFrame:
    """All files of a tenant in one frame: one read per schema group, missing columns null.

    ``schemas`` maps a file name to its schema; ``source_file`` keeps where a row came from.
    """
    parts = []
    for name, schema in schemas.items():
        rows = load_csv(spark, f"{root}/{client}/{name}", schema=schema)
        parts.append(rows.withColumn("source_file", F.lit(f"{client}/{name}")))
    return union_files(parts)


def union_files(parts: Sequence[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part, allowMissingColumns=True)
    return result


def canonical_json(df: DataFrame) -> DataFrame:
    """One JSON text per row, ISO dates, nulls kept."""
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss"}
    return df.select(F.to_json(F.struct(*df.columns), options).alias("value"))


def write_canonical(df: DataFrame, path: str, *, as_json: bool = True, mode: str = "overwrite") -> None:
    """NDJSON between stages; parquet is the better choice for large tables."""
    if as_json:
        df.write.mode(mode).option("ignoreNullFields", "false").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)
    else:
        df.write.mode(mode).parquet(path)


def read_canonical(spark: SparkSession, path: str, schema: T.StructType | str, *, as_json: bool = True) -> DataFrame:
    if not as_json:
        return spark.read.schema(schema).parquet(path)
    return spark.read.schema(schema).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss").json(path)


CHUNK_SCHEMA = (
    "chunk_id string, text string, metadata struct<source_file: string, folder: string, chunk_index: bigint, "
    "row_range: array<bigint>, date_range: struct<start: string, end: string>, "
    "entity_values: map<string, array<string>>, schema_version: string, column_list: array<string>, "
    "row_count: bigint, available_fields: array<string>, missing_canonical_fields: array<string>, "
    "unmapped_columns: array<string>, active_domains: array<string>>"
)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk lines; blank and malformed lines are skipped."""
    return spark.read.schema(CHUNK_SCHEMA).option("mode", "DROPMALFORMED").json(path)


def object_key_parts(key: Column) -> dict[str, Column]:
    """Decoded object key, its file name, and whether it is a PDF."""
    decoded = F.url_decode(key)
    return {
        "object_key": decoded,
        "file_name": F.regexp_extract(decoded, "[^/]*$", 0),
        "is_pdf": F.lower(decoded).endswith(".pdf"),
    }
