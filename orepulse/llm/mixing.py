"""Mixing sources to target weights.

Every source gets a share of the wanted number of words by its weight; a source that cannot give that much is taken as often as
allowed and the excess goes to the others (water filling). Within a source the documents are put into a random but repeatable order by
a hash key, a range sort spreads them over blocks, prefix sums of the word counts run over the blocks, and the mix takes whole epochs
and then words up to the exact budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orepulse.llm.common import WORD, cut

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST_EPOCHS = 2


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS) -> DataFrame:
    """``source, source_size, target`` for a frame of ``source, size``.

    Sources are ordered by code point with null last and get ``weights`` in turn, repeating. Sources fill from the one with the least
    room for its weight: the water level of the first that is not full is the target of every later one, per unit of weight.
    """
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("nth", nth)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    room = sources.withColumn("weight", weight).withColumn("room", F.col("source_size") * F.lit(float(most_epochs)))
    order = Window.orderBy(F.col("room") / F.col("weight"), "nth")
    everything = Window.partitionBy()
    level = (F.lit(float(share)) * F.sum("source_size").over(everything) - F.col("before")) / F.col("left")
    filled = (
        room.withColumn("before", F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("left", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", level)
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("room"))
    )
    water = F.min_by(F.when(F.col("open"), F.col("level")), F.when(F.col("open"), F.col("room") / F.col("weight"))).over(everything)
    target = F.when(F.col("open"), F.col("weight") * water).otherwise(F.col("room"))
    return filled.withColumn("target", target).select("source", "source_size", "target")


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS, seed: str = "mix"
) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken`` for every row of ``docs`` (doc_id, text, source).

    ``size`` counts words (null text: 0) and ``taken`` the words that the mix takes of the document, repeats counted: whole epochs of
    the source, then its documents in key order until the budget is used up, the last one up to the exact word. Rows of one id keep
    their own share; equal rows are interchangeable. A null source is a source of its own, an empty table gives no rows.
    """
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select("doc_id", "source", size.alias("size"), key.alias("key"))
    order = [F.col("key"), F.col("doc_id"), F.col("size")]
    parts = max(2, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = sized.repartitionByRange(parts, F.col("source").asc_nulls_last(), *order)
    blocks = cut(dealt.withColumn("block", F.spark_partition_id()))

    sums = blocks.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "block", F.coalesce(F.sum("block_size").over(earlier), F.lit(0)).alias("offset"))
    targets = source_targets(sums.select("source", F.col("block_size").alias("size")), weights, share, most_epochs)
    per_block = offsets.alias("o").join(targets.alias("t"), F.col("o.source").eqNullSafe(F.col("t.source")))
    per_block = per_block.select(F.col("o.source").alias("of"), F.col("block").alias("at"), "offset", "source_size", "target")

    inside = Window.partitionBy("block", "source").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    running = blocks.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = running.join(per_block, (F.col("block") == F.col("at")) & F.col("source").eqNullSafe(F.col("of")))
    budget = F.floor(F.col("target") + 0.5)
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = budget - epochs * F.col("source_size")
    tail = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), rest - F.col("offset") - F.col("inside")))
    return joined.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + tail).cast("long").alias("taken"))


SQL = """
WITH sized AS (
  SELECT doc_id, source, CAST(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5('mix:' || COALESCE(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(SUM(size) AS BIGINT) AS source_size,
         [3.0, 1.0, 2.0][CAST((ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1]::DOUBLE AS weight
  FROM sized GROUP BY source
), steps AS (
  SELECT *, 2.0 * source_size AS room,
         COALESCE(SUM(2.0 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         SUM(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest_weight,
         1.5 * SUM(source_size) OVER () AS whole
  FROM sources WINDOW o AS (ORDER BY 2.0 * source_size / weight, source NULLS LAST)
), water AS (
  SELECT MIN((whole - before) / rest_weight) AS level FROM steps
  WHERE (whole - before) / rest_weight * weight <= room
    AND room / weight = (SELECT MIN(room / weight) FROM steps WHERE (whole - before) / rest_weight * weight <= room)
), targets AS (
  SELECT source, source_size, CAST(CASE WHEN (whole - before) / rest_weight * weight <= room THEN weight * level ELSE room END AS DOUBLE) AS target
  FROM steps, water
), placed AS (
  SELECT s.*, t.source_size, t.target,
         COALESCE(SUM(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), budgets AS (SELECT *, CAST(FLOOR(target + 0.5) AS BIGINT) AS budget FROM placed)
SELECT doc_id, source, size, source_size, target,
       CAST(CASE WHEN source_size > 0 THEN budget // source_size * size
            + GREATEST(0, LEAST(size, budget % source_size - before)) ELSE 0 END AS BIGINT) AS taken
FROM budgets
"""
