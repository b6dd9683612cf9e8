"""Near-duplicate embeddings by random-hyperplane hashing.

The signs of a vector against random hyperplanes are its code in a table; vectors near each other agree on all bits of a table with a
known chance, from which the number of tables follows. Vectors that share a code in some table are compared exactly in double
precision, block by block, so that a crowded code is spread over many tasks. A pair is counted in the first table in which it meets;
only counts and one link per vector and block leave a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orepulse.llm.common import cut
from orepulse.llm.components import components

COSINE = 0.95
MISSED = 1e-4  # chance that a pair at exactly the threshold meets in no table
CROWD = 128  # vectors that share a code by chance, on average
BLOCK = 1024  # vectors of a code that are compared in one task at a time


def plan(n: int, cosine: float = COSINE, missed: float = MISSED, crowd: int = CROWD) -> tuple[int, int]:
    """(bits per table, tables) for ``n`` vectors: codes grow with the logarithm of ``n``, tables make up for the recall."""
    bits = min(30, max(6, math.ceil(math.log2(max(2, n) / crowd))))
    agree = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, math.ceil(math.log(missed) / math.log(1 - agree))


def codes(x: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """The code of each vector in each table."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], bits * tables))
    signs = (x @ planes > 0).reshape(len(x), tables, bits)
    return signs @ (1 << np.arange(bits, dtype=np.int64))


def usable(embedding: Column) -> Column:
    """Not null, without null or non-finite components, and not all zero."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    return F.coalesce(embedding.isNotNull() & ~bad & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_vectors(
    vectors: DataFrame, cosine: float = COSINE, missed: float = MISSED, crowd: int = CROWD, block: int = BLOCK, seed: int = 11
) -> DataFrame:
    """``vec_id, n_links, component_id, kept``: one row per row of ``vectors`` (vec_id long, embedding array).

    Unusable vectors and those without partners have no links and are their own component. Exact copies are compared once and counted
    each. Vectors of different length never link. A repeated id counts as one more copy or vector of that id; a null id has no
    component and is kept.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    unique = cut(good.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("own", F.monotonically_increasing_id()))
    bits, tables = plan(unique.count(), cosine, missed, crowd)

    def hashed(batches):
        for batch in batches:
            for length, part in batch.groupby(batch["embedding"].map(len)):
                found = codes(_unit(part["embedding"]), bits, tables, seed)
                yield pd.DataFrame({
                    "own": np.repeat(part["own"].to_numpy(), tables), "number": np.tile(np.arange(tables), len(part)),
                    "code": found.ravel(), "length": length,
                })

    placed = cut(unique.select("own", "embedding").mapInPandas(hashed, "own long, number int, code long, length int"))
    bucket = ["number", "length", "code"]
    crowded = placed.groupBy(*bucket).agg(F.count("*").alias("size")).where("size > 1")
    blocks = F.ceil(F.col("size") / block).cast("int")
    dealt = placed.join(crowded, bucket).withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("own"), F.col("blocks")).cast("int"))
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select(*bucket, "own", "mine", partner.alias("other"))
    dealt = dealt.select(*bucket, "own", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    dealt = dealt.join(unique, "own")

    def compare(key, group: pd.DataFrame) -> pd.DataFrame:
        number, _, _, i, j = key
        x, own = _unit(group["embedding"]), group["own"].to_numpy()
        mine = group["mine"].to_numpy()
        left = np.flatnonzero(mine == i)
        right = left if i == j else np.flatnonzero(mine == j)
        hit = x[left] @ x[right].T >= cosine
        if i == j:
            hit &= np.triu(np.ones(hit.shape, bool), 1)
        a, b = np.nonzero(hit)
        a, b = left[a], right[b]
        label = np.arange(len(own))
        while len(a):  # the smallest label within reach of the links of this block
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if (label == before).all():
                break
        every = codes(x, bits, tables, seed)
        new = np.empty(len(a), bool)
        for at in range(0, len(a), 100_000):
            s = slice(at, at + 100_000)
            new[s] = (every[a[s]] == every[b[s]]).argmax(axis=1) == number
        copies = group["copies"].to_numpy()
        n = np.bincount(a[new], copies[b[new]], len(own)) + np.bincount(b[new], copies[a[new]], len(own))
        used = (n > 0) | (label != np.arange(len(own))) | np.isin(np.arange(len(own)), label[label != np.arange(len(own))])
        return pd.DataFrame({"rep": group["rep"][used], "low": group["rep"].to_numpy()[label[used]], "n": n[used].astype(np.int64)})

    met = cut(dealt.groupBy(*bucket, "i", "j").applyInPandas(compare, "rep long, low long, n long"))
    found = cut(components(met.select(F.col("rep").alias("a"), F.col("low").alias("b"))))
    # copies of one id under several embeddings meet in their id
    counts = met.groupBy("rep").agg(F.sum("n").alias("n"))
    known = unique.join(counts, "rep", "left").join(found, F.col("rep") == F.col("id"), "left").select(
        F.col("embedding").alias("same"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("least")
    )
    usable_key = F.when(usable(F.col("embedding")) & F.col("vec_id").isNotNull(), F.col("embedding"))
    out = rows.withColumn("key", usable_key).join(known, F.col("key") == F.col("same"), "left")
    component = F.coalesce("least", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach(id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT links.a, reach.other FROM reach JOIN links ON links.b = reach.id
), least AS (SELECT id, MIN(other) AS component_id FROM reach GROUP BY id),
counts AS (SELECT a, COUNT(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(COALESCE(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM embeddings v JOIN least ON least.id = v.vec_id LEFT JOIN counts ON counts.a = v.vec_id
"""
