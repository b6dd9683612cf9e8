"""Ordered scans (row numbers, running sums, forward fill, previous value) that survive hot keys.

A window over ``partition by key order by t`` puts one key into one task. Here the rows are range
partitioned on ``(keys, order)``, so a key holding a third of the table is spread over many blocks;
each block is scanned on its own and only one summary row per (key, block) is carried across blocks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orepulse.session import checkpoint_cut, release_shuffles

BLOCK = "_scan_block"
MOST_CARRIED = 400_000  # summary rows that are sent to the tasks; more are joined by a shuffle


def ordered_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Contiguous blocks of the order ``(keys, order)``, numbered in ``_block``.

    Block borders come from sampling, so they are fixed by a checkpoint before anything depends on them. Rows that have a block number
    from a scan before keep it.
    """
    if BLOCK in df.columns:
        blocks = checkpoint_cut(df, "zstd")
    else:  # held by no name, so that its shuffle files can go
        blocks = checkpoint_cut(df.repartitionByRange(*[F.col(c) for c in [*keys, *order]]).withColumn(BLOCK, F.spark_partition_id()), "zstd")
    release_shuffles(df.sparkSession)
    return blocks


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    row_index: str | None = None,
    sums: Mapping[str, Column] | None = None,
    fills: Mapping[str, str] | None = None,
    previous: Mapping[str, str] | None = None,
    keep_blocks: bool = False,
) -> DataFrame:
    """Add prefix results per ``keys`` in ``order`` (which must be unique within a key).

    row_index: name of a 0-based dense position; sums: ``{output: numeric column}`` running sums up to
    and including the row; fills: ``{output: column}`` last non-null value so far; previous:
    ``{output: column}`` value of the row before (null on the first). ``keep_blocks`` leaves the block numbers in the result, so that a
    next scan with the same keys and order need not put the rows in order again.
    """
    sums, fills, previous = dict(sums or {}), dict(fills or {}), dict(previous or {})
    keys = list(keys)
    by_block = [BLOCK, *keys]
    summed = {out: f"_scan_add_{i}" for i, out in enumerate(sums)}
    blocks = ordered_blocks(df.withColumns({summed[o]: c for o, c in sums.items()}), keys, order)

    inside = Window.partitionBy(*by_block).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local: dict[str, Column] = {"_scan_n": F.row_number().over(inside)}
    for i, (out, column) in enumerate(sums.items()):
        local[f"_scan_sum_{i}"] = F.sum(summed[out]).over(upto)
    for i, column in enumerate(fills.values()):
        local[f"_scan_fill_{i}"] = F.last(column, ignorenulls=True).over(upto)
    for i, column in enumerate(previous.values()):
        local[f"_scan_prev_{i}"] = F.lag(F.struct(F.col(column).alias("v"))).over(inside)

    position = F.struct(*[F.col(c) for c in order])
    tail = [F.count(F.lit(1)).alias("_scan_rows")]
    tail += [F.sum(summed[out]).alias(f"_scan_t_sum_{i}") for i, out in enumerate(sums)]
    tail += [
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), position)).alias(f"_scan_t_fill_{i}")
        for i, c in enumerate(fills.values())
    ]
    tail += [
        F.max_by(F.struct(F.col(c).alias("v")), position).alias(f"_scan_t_prev_{i}")
        for i, c in enumerate(previous.values())
    ]
    tails = blocks.groupBy(*by_block).agg(*tail)
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(BLOCK)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    carried = {"_scan_b_rows": F.coalesce(F.sum("_scan_rows").over(before), F.lit(0))}
    for i in range(len(sums)):
        carried[f"_scan_b_sum_{i}"] = F.sum(f"_scan_t_sum_{i}").over(before)
    for i in range(len(fills)):
        carried[f"_scan_b_fill_{i}"] = F.last(f"_scan_t_fill_{i}", ignorenulls=True).over(before)
    for i in range(len(previous)):
        carried[f"_scan_b_prev_{i}"] = F.last(f"_scan_t_prev_{i}", ignorenulls=True).over(before)
    carry = tails.select(
        F.col(BLOCK).alias("_scan_cb"),
        *[F.col(k).alias(f"_scan_ck_{i}") for i, k in enumerate(keys)],
        *[expr.alias(name) for name, expr in carried.items()],
    )

    same = [F.col(BLOCK) == F.col("_scan_cb")]
    same += [F.col(k).eqNullSafe(F.col(f"_scan_ck_{i}")) for i, k in enumerate(keys)]
    carry = checkpoint_cut(carry)  # its size is known before the rows are joined, which are not shuffled for a small one
    carry = F.broadcast(carry) if carry.count() <= MOST_CARRIED else carry
    joined = blocks.withColumns(local).join(carry, reduce(lambda a, b: a & b, same))
    result = [F.col(c) for c in df.columns if c != BLOCK]
    if row_index:
        result.append((F.col("_scan_b_rows") + F.col("_scan_n") - 1).alias(row_index))
    for i, out in enumerate(sums):
        total = F.coalesce(F.col(f"_scan_b_sum_{i}") + F.col(f"_scan_sum_{i}"), F.col(f"_scan_sum_{i}"), F.col(f"_scan_b_sum_{i}"))
        result.append(total.alias(out))
    for i, out in enumerate(fills):
        result.append(F.coalesce(F.col(f"_scan_fill_{i}"), F.col(f"_scan_b_fill_{i}")).alias(out))
    for i, out in enumerate(previous):
        result.append(F.coalesce(F.col(f"_scan_prev_{i}"), F.col(f"_scan_b_prev_{i}"))["v"].alias(out))
    return joined.select(*result, *([BLOCK] if keep_blocks else []))


def trailing_rows(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    size: int,
    aggregates: Mapping[str, Column],
    *,
    bucket_rows: int = 4096,
) -> DataFrame:
    """Aggregates over the last ``size`` rows (the row included), by a dense 0-based ``index`` per key.

    Rows are cut into buckets of ``bucket_rows`` positions; the last ``size - 1`` rows of a bucket are
    repeated at the head of the next one, so no task holds more than a bucket of one key.
    """
    bucket = F.floor(F.col(index) / bucket_rows)
    last = F.col(index) % bucket_rows >= bucket_rows - (size - 1)
    copies = F.when(last, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
    spread = df.withColumn("_scan_bucket", F.explode(copies))
    frame = Window.partitionBy(*keys, "_scan_bucket").orderBy(index).rowsBetween(-(size - 1), Window.currentRow)
    return (
        spread.withColumns({name: expr.over(frame) for name, expr in aggregates.items()})
        .filter(F.col("_scan_bucket") == bucket)
        .drop("_scan_bucket")
    )
