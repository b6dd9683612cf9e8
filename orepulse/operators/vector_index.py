"""Approximate nearest neighbours in stored inverted lists with product-quantised residuals.

A vector lies in the list of its nearest centre, below the folder of its scope, as a few bytes that say which code word of each part of the
space its distance from the centre resembles. A search opens only the folders of its scope and of the lists nearest to the query, ranks the
codes there by table look-ups, and scores the best of them exactly. Centres and code words are learned from a bounded sample; every vector
is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orepulse.operators.retrieval import SCORE_DECIMALS, usable_vector

SAMPLE = 50_000  # vectors that centres and code words are learned from, at most about
WORDS = 256  # code words of a part: one byte
MOST_QUERIES = 4096  # queries that the tasks hold at a time; more are searched in several rounds
LAYOUT = "vec_id bigint, code binary, embedding array<float>, scope string, list_id int"


@dataclass
class VectorModel:
    """``centres`` (lists x dimension) and ``words`` (parts x code words x dimension / parts) of unit vectors."""

    centres: np.ndarray
    words: np.ndarray

    @property
    def dimension(self) -> int:
        return self.centres.shape[1]


def _unit(x: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _closest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmax(x[i : i + 4096] @ centres.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.empty(0, np.int64)


def _means(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's k-means; a centre that loses all its rows takes the row that is worst off."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _closest(x, centres)
        sums, sizes = np.zeros_like(centres), np.bincount(own, minlength=k)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(sizes == 0)
        centres = sums / np.maximum(sizes, 1)[:, None]
        if len(empty):
            centres[empty] = x[np.argsort(-((x - centres[own]) ** 2).sum(axis=1))[: len(empty)]]
    return centres


def learn_index(vectors: DataFrame, lists: int, *, vector_id: str = "vec_id", vector: str = "embedding", parts: int = 8, sample: int = SAMPLE, seed: int = 7) -> VectorModel:
    """Centres and code words from at most about ``sample`` of the usable vectors, picked by a hash of their ids."""
    good = vectors.select(F.col(vector_id).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter(usable_vector("v"))
    total = good.count()
    if not total:
        raise ValueError("there is no usable vector to learn from")
    picked = good if total <= sample else good.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < int(sample / total * (1 << 40)))
    rows = picked.orderBy("id").select("v").toArrow().column("v").combine_chunks()
    x = _unit(rows.flatten().to_numpy().reshape(len(rows), -1))
    if x.shape[1] % parts:
        raise ValueError(f"{parts} parts do not divide {x.shape[1]} dimensions")
    centres = _means(x, lists, seed)
    rest = (x - centres[_closest(x, centres)]).reshape(len(x), parts, -1)
    return VectorModel(centres, np.stack([_padded(_means(rest[:, p], WORDS, seed + p + 1)) for p in range(parts)]))


def _padded(words: np.ndarray) -> np.ndarray:
    """Fewer rows than code words leave the others so far away that nothing takes them."""
    return np.concatenate([words, np.full((WORDS - len(words), words.shape[1]), 1e6)])


def build_index(vectors: DataFrame, model: VectorModel, path: str, *, vector_id: str = "vec_id", vector: str = "embedding", scope: str | None = None) -> None:
    """Write every usable vector of the model's dimension to the folder of its scope and list. A null scope is a scope of its own.

    Large lists are spread over several files, small ones are not cut up.
    """
    shipped = vectors.sparkSession.sparkContext.broadcast((model.centres, model.words))
    rows = vectors.select(
        F.col(vector_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<float>").alias("embedding"),
        (F.col(scope).cast("string") if scope else F.lit("all")).alias("scope"),
    ).filter(usable_vector("embedding") & (F.size("embedding") == model.dimension) & F.col("vec_id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, words = shipped.value
        for batch in batches:
            if not len(batch):
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float)
            x = _unit(flat.reshape(len(batch), -1))
            own = _closest(x, centres)
            rest = (x - centres[own]).reshape(len(x), len(words), -1)
            codes = np.stack([_closest(rest[:, p], words[p]) for p in range(len(words))], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("embedding"), batch.column("scope"), pa.array(own.astype(np.int32))],
                names=["vec_id", "code", "embedding", "scope", "list_id"],
            )

    listed = rows.mapInArrow(run, LAYOUT)
    listed.hint("rebalance", "scope", "list_id").write.partitionBy("scope", "list_id").mode("errorifexists").parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYOUT).parquet(path)


def probed_lists(queries: DataFrame, model: VectorModel, probes: int, *, query_id: str = "query_id", query_vector: str = "query_vector", scope: str | None = None) -> DataFrame:
    """``query_id, scope, list_id``: the ``probes`` lists nearest to each usable query."""
    shipped = queries.sparkSession.sparkContext.broadcast(model.centres)
    rows = queries.select(
        F.col(query_id).cast("bigint").alias("query_id"), F.col(query_vector).cast("array<double>").alias("vec"), (F.col(scope).cast("string") if scope else F.lit("all")).alias("scope")
    ).filter(usable_vector("vec") & (F.size("vec") == model.dimension))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = shipped.value
        take = min(probes, len(centres))
        for batch in batches:
            if not len(batch):
                continue
            x = _unit(batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1))
            near = np.argsort((centres**2).sum(axis=1) / 2 - x @ centres.T, axis=1, kind="stable")[:, :take]
            again = pa.array(np.repeat(np.arange(len(batch)), take))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(again), batch.column("scope").take(again), pa.array(near.ravel().astype(np.int32))], names=["query_id", "scope", "list_id"]
            )

    return rows.mapInArrow(run, "query_id bigint, scope string, list_id int")


def search_index(
    spark: SparkSession, path: str, model: VectorModel, queries: DataFrame, k: int, *, probes: int = 8, candidates: int | None = None,
    query_id: str = "query_id", query_vector: str = "query_vector", scope: str | None = None, most_queries: int = MOST_QUERIES,
) -> DataFrame:
    """``query_id, vec_id, score, rank``: about the ``k`` nearest vectors of each query within its scope, by exact cosine.

    Of the ``probes`` nearest lists the best ``candidates`` per query by code (default: all) are scored exactly. With all lists and all
    candidates the answer is exact. Query ids must be unique; queries that are not usable have no result.
    """
    total = queries.count()
    rounds = max(1, -(-total // most_queries))
    out = None
    for i in range(rounds):
        some = queries if rounds == 1 else queries.filter(F.pmod(F.xxhash64(query_id), F.lit(rounds)) == i)
        found = _search(spark, path, model, some, k, probes, candidates, query_id, query_vector, scope)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    ranked = out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id), "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))


def _search(spark, path, model, queries, k, probes, candidates, query_id, query_vector, scope) -> DataFrame:
    wanted = probed_lists(queries, model, probes, query_id=query_id, query_vector=query_vector, scope=scope).toArrow().to_pylist()  # probes rows per query of the round
    rows = queries.select(F.col(query_id).cast("bigint").alias("q"), F.col(query_vector).cast("array<double>").alias("v")).filter(usable_vector("v") & (F.size("v") == model.dimension)).toArrow()
    ids = rows.column("q").to_pylist()
    x = _unit(rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)) if ids else np.empty((0, model.dimension))
    at = {q: i for i, q in enumerate(ids)}
    asked: dict[tuple, list[int]] = {}
    for row in wanted:
        asked.setdefault((row["scope"], row["list_id"]), []).append(at[row["query_id"]])
    shipped = spark.sparkContext.broadcast((x, ids, {key: np.array(v) for key, v in asked.items()}, model.centres, model.words))
    probed = F.lit(False)
    by_scope: dict = {}
    for name, number in asked:
        by_scope.setdefault(name, []).append(number)
    lists_of: dict[tuple, list] = {}
    for name, numbers in by_scope.items():
        lists_of.setdefault(tuple(sorted(numbers)), []).append(name)
    for numbers, names in lists_of.items():  # partition filters, so that only these folders are listed and read
        known = [n for n in names if n is not None]
        inside = F.col("scope").isin(known) if known else F.lit(False)
        if None in names:
            inside = inside | F.col("scope").isNull()
        probed = probed | (inside & F.col("list_id").isin(list(numbers)))
    stored = _stored(spark, path).filter(probed)
    if candidates is not None:
        order = Window.partitionBy("q").orderBy("away", "vec_id")
        near = stored.select("vec_id", "code", "scope", "list_id").mapInArrow(_by_code(shipped, candidates), "q bigint, vec_id bigint, away double, scope string, list_id int")
        best = near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= candidates).select("q", "vec_id", "scope", "list_id")
        pairs = stored.select("vec_id", "embedding", "scope", "list_id").alias("s").join(
            F.broadcast(best).alias("b"), (F.col("s.vec_id") == F.col("b.vec_id")) & (F.col("s.list_id") == F.col("b.list_id")) & F.col("s.scope").eqNullSafe(F.col("b.scope"))
        )
        return pairs.select("b.q", "s.vec_id", "embedding").mapInArrow(_score_pairs(shipped), "query_id bigint, vec_id bigint, score double")
    return stored.select("vec_id", "embedding", "scope", "list_id").mapInArrow(_score_lists(shipped, k), "query_id bigint, vec_id bigint, score double")


def _groups(batch: pa.RecordBatch, asked: dict) -> Iterator[tuple[tuple, np.ndarray, np.ndarray]]:
    """Rows of a batch by list, with the queries that probe it."""
    scopes, lists = batch.column("scope").to_pylist(), batch.column("list_id").to_numpy()
    names: dict = {}
    numbers = np.array([names.setdefault(s, len(names)) for s in scopes], np.int64)
    back = list(names)
    for key in np.unique(numbers * (1 << 32) + lists):
        name, number = back[key >> 32], int(key & 0xFFFFFFFF)
        if (name, number) in asked:
            yield (name, number), np.flatnonzero((numbers == key >> 32) & (lists == number)), asked[(name, number)]


def _best_rows(q: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest (score, id) of each query."""
    order = np.lexsort((ids, score, q))
    first = np.searchsorted(q[order], q[order])
    return order[np.arange(len(q)) - first < k]


def _by_code(shipped, keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ids, asked, centres, words = shipped.value
        for batch in batches:
            found = []
            codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(len(batch), len(words)) if len(batch) else None
            vec = batch.column("vec_id").to_numpy()
            for (name, number), rows, queries in _groups(batch, asked):
                rest = (x[queries] - centres[number]).reshape(len(queries), len(words), -1)
                for i, q in enumerate(queries):
                    table = ((rest[i][:, None, :] - words) ** 2).sum(axis=2)  # parts x code words
                    away = table[np.arange(len(words)), codes[rows]].sum(axis=1)
                    near = rows[np.argpartition(away, keep - 1)[:keep]] if len(rows) > keep else rows
                    kept = away if len(rows) <= keep else away[np.argpartition(away, keep - 1)[:keep]]
                    found.append((np.full(len(near), q), near, kept))
            if found:
                q, rows, away = (np.concatenate(c) for c in zip(*found))
                best = _best_rows(q, away, vec[rows], keep)
                take = pa.array(rows[best])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids[i] for i in q[best]], pa.int64()), batch.column("vec_id").take(take), pa.array(away[best]), batch.column("scope").take(take), batch.column("list_id").take(take)],
                    names=["q", "vec_id", "away", "scope", "list_id"],
                )

    return run


def _score_lists(shipped, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ids, asked, _, _ = shipped.value
        for batch in batches:
            found = []
            if not len(batch):
                continue
            v = _unit(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1))
            vec = batch.column("vec_id").to_numpy()
            for _, rows, queries in _groups(batch, asked):
                scores = np.round(v[rows] @ x[queries].T, SCORE_DECIMALS)
                found.append((np.tile(queries, len(rows)), np.repeat(rows, len(queries)), scores.ravel()))
            if found:
                q, rows, score = (np.concatenate(c) for c in zip(*found))
                best = _best_rows(q, -score, vec[rows], k)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q[best]], pa.int64()), pa.array(vec[rows[best]]), pa.array(score[best])], names=["query_id", "vec_id", "score"])

    return run


def _score_pairs(shipped):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, ids, _, _, _ = shipped.value
        at = {q: i for i, q in enumerate(ids)}
        for batch in batches:
            if not len(batch):
                continue
            v = _unit(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(batch), -1))
            own = np.array([at[q] for q in batch.column("q").to_pylist()])
            score = np.round((v * x[own]).sum(axis=1), SCORE_DECIMALS)
            yield pa.RecordBatch.from_arrays([batch.column("q"), batch.column("vec_id"), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run
