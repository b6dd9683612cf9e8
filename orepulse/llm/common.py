"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from orepulse.session import checkpoint_cut, drop_cut, release_shuffles  # noqa: F401

WORD = r"[^\x20\x09-\x0D]+"
SHINGLE_WORDS = 5
SIMILARITY = 0.8

cut = checkpoint_cut


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One input table; only Spark opens the path."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % modulus


def join_bounded(big: DataFrame, small: DataFrame, on, how: str = "inner", most_rows: int = 400_000) -> DataFrame:
    """Join with a narrow table: sent to every task if its counted rows stay below the bound, shuffled on the key otherwise."""
    return big.join(F.broadcast(small) if small.count() <= most_rows else small, on, how)


def per_batch(df: DataFrame, work: Callable[[list], list], added: str) -> DataFrame:
    """``df`` with its ``text`` replaced by new columns: ``work`` gets the texts of a bounded Arrow batch and returns those columns.

    All other columns stay in Arrow, so that large ids and nulls come through unchanged.
    """
    new = T.StructType.fromDDL(added)
    fields = [(f.name, to_arrow_type(f.dataType)) for f in new.fields]

    def run(batches):
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names if name != "text"}
            made = work(batch.column("text").to_pylist())
            columns |= {name: pa.array(values, kind) for (name, kind), values in zip(fields, made)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return df.mapInArrow(run, T.StructType([f for f in df.schema.fields if f.name != "text"] + new.fields))
