"""Nearest-neighbour retrieval, tenant scope, parent collapse and rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CLIENT_ID = "^[A-Za-z0-9_-]{1,64}$"

# Hits taken per index, hits kept after fusion, and the fusion constant.
REGULATORY_K, TELEMETRY_K, ANALYSIS_K = 4, 4, 10
FUSED_HITS = 4
RRF_CONSTANT = 60
INDEX_ORDER = ("regulatory", "telemetry", "analysis")

MAX_QUERIES = 4096
"""Query sets up to this many rows are sent to the tasks; larger ones are joined in blocks."""

MAX_QUERY_BYTES = 64 << 20
"""Query vectors of up to so many bytes are sent to the tasks."""

SCORE_DECIMALS = 9


def valid_client(client: Column) -> Column:
    return F.coalesce(client.rlike(CLIENT_ID), F.lit(False))


def client_from_request(raw: Column) -> Column:
    """Trimmed, upper-cased tenant id; null when it is not a valid id."""
    cleaned = F.upper(F.trim(raw))
    return F.when(valid_client(cleaned), cleaned)


def in_tenant_scope(source_file: Column, client: Column) -> Column:
    """Whole-segment prefix match; nothing matches an invalid client."""
    return F.coalesce(valid_client(client) & F.startswith(source_file, F.concat(client, F.lit("/"))), F.lit(False))


def usable_vector(vector: str) -> Column:
    """Whether a vector has elements and all of them are finite; a length of zero or null has no direction and is not usable either."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def fits_dimension(vector: str, dimension: int) -> Column:
    """Whether a vector is there, has the right length and finite elements only; its length may be zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dimension) & finite, F.lit(False))


def split_by_dimension(df: DataFrame, vector: str, dimension: int) -> tuple[DataFrame, DataFrame]:
    """Usable vectors and rejects (missing, wrong length, or with a missing or non-finite element)."""
    good = fits_dimension(vector, dimension)
    return df.filter(good), df.filter(~good)


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


POOL = 1 << 18  # hits that wait to be cut to the best of their query
TILE_ROWS = 2048  # vectors scored against the queries of their scope at a time


class _Partial:
    """Running k best per query over batches of vectors."""

    def __init__(self, queries: np.ndarray, scopes: Sequence | None, k: int):
        self.queries, self.k = _unit_rows(queries), k
        self.own: dict = {}  # queries by scope
        for q, scope in enumerate([None] * len(queries) if scopes is None else scopes):
            self.own.setdefault(scope, []).append(q)
        self.own = {scope: np.array(some) for scope, some in self.own.items()}
        self.scoped = scopes is not None
        self.bar = np.full(len(queries), -np.inf)
        self.pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, ids: np.ndarray, vectors: np.ndarray, scopes: np.ndarray | None) -> None:
        if not self.scoped:
            return self._score(np.arange(len(self.queries)), ids, vectors)
        names, inverse = np.unique(scopes.astype(str), return_inverse=True)
        for i, name in enumerate(names):
            some = self.own.get(name)
            if some is not None:  # vectors of a scope that nobody asks for are not scored
                inside = inverse == i
                self._score(some, ids[inside], vectors[inside])

    def _score(self, some: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(ids), TILE_ROWS):
            tile = ids[at : at + TILE_ROWS]
            scores = np.round(_unit_rows(vectors[at : at + TILE_ROWS]) @ self.queries[some].T, SCORE_DECIMALS)
            if len(tile) > self.k:
                self.bar[some] = np.maximum(self.bar[some], np.partition(scores, len(tile) - self.k, axis=0)[len(tile) - self.k])
            row, column = np.nonzero(scores >= self.bar[some])
            self.pool.append((some[column], tile[row], scores[row, column]))
            self.held += len(row)
            if self.held > POOL:
                self._cut()

    def _cut(self) -> None:
        """Keep the k best of every query by (score descending, id ascending)."""
        q, ids, scores = (np.concatenate(x) for x in zip(*self.pool))
        order = np.lexsort((ids, -scores, q))
        q, ids, scores = q[order], ids[order], scores[order]
        first = np.searchsorted(q, q)
        nth = np.arange(len(q)) - first
        last = nth == self.k - 1
        self.bar[q[last]] = np.maximum(self.bar[q[last]], scores[last])
        keep = nth < self.k
        self.pool, self.held = [(q[keep], ids[keep], scores[keep])], 0

    def rows(self, names: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.pool:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self._cut()
        q, ids, scores = self.pool[0]
        return np.asarray(names, np.int64)[q], ids, scores


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    vector_id: str = "vec_id",
    vector: str = "embedding",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
    scope: tuple[str, str] | None = None,
    max_queries: int = MAX_QUERIES,
    rows_per_block: int = 50_000,
) -> DataFrame:
    """Exact ``k`` nearest vectors per query by cosine: ``(query_id, vec_id, score, rank)``.

    ``scope=(vector column, query column)`` only ranks vectors whose value equals the query's, so the
    result is the k nearest *among* the rows in scope, and only those are scored. Vectors that are null, empty or zero or have null or
    non-finite elements are left out on both sides; each query is ranked among the vectors of its own length. Each task keeps k rows
    per query while it streams its vectors; only those are shuffled. A query set that fits ``max_queries`` and ``MAX_QUERY_BYTES`` (both
    checked) is sent to the tasks, a larger one is matched block by block with bounded memory. Ids are 64-bit integers.
    """
    v = vectors.select(
        F.col(vector_id).cast("bigint").alias("vid"),
        F.col(vector).cast("array<double>").alias("vec"),
        (F.col(scope[0]).cast("string") if scope else F.lit("")).alias("scope"),
    )
    q = queries.select(
        F.col(query_id).cast("bigint").alias("qid"),
        F.col(query_vector).cast("array<double>").alias("vec"),
        (F.col(scope[1]).cast("string") if scope else F.lit("")).alias("scope"),
    )
    q = q.filter(usable_vector("vec") & F.col("qid").isNotNull())
    v = v.filter(usable_vector("vec") & F.col("vid").isNotNull())
    schema = "qid bigint, vid bigint, score double"
    size = q.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("vec")), F.lit(0)).alias("numbers")).first()
    if size["rows"] <= max_queries and 8 * size["numbers"] <= MAX_QUERY_BYTES:
        head = q.collect()
        lengths = sorted({len(r["vec"]) for r in head})
        v = v.filter(F.size("vec").isin(lengths)) if lengths else v.limit(0)
        by_length = {n: [r for r in head if len(r["vec"]) == n] for n in lengths}
        sent = {
            n: ([r["qid"] for r in some], np.array([r["vec"] for r in some], dtype=float), [r["scope"] for r in some] if scope else None)
            for n, some in by_length.items()
        }

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = {n: _Partial(matrix, scopes, k) for n, (_, matrix, scopes) in sent.items()}
            for batch in batches:
                sizes = pc.list_value_length(batch.column("vec")).to_numpy(zero_copy_only=False)
                for n in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == n))
                    flat = part.column("vec").flatten().to_numpy(zero_copy_only=False)
                    near = np.asarray(part.column("scope").to_pylist(), dtype=object) if scope else None
                    best[n].add(part.column("vid").to_numpy(), flat.reshape(part.num_rows, -1), near)
            for n, found in best.items():
                columns = [pa.array(c) for c in found.rows(sent[n][0])]
                yield pa.RecordBatch.from_arrays(columns, names=["qid", "vid", "score"])

        partial = v.mapInArrow(scan, schema)
    else:
        partial = _in_blocks(v, q, k, schema, scope is not None, max_queries, rows_per_block)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("vid"))
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.col("qid").alias(query_id), F.col("vid").alias(vector_id), "score", F.col("rank").cast("bigint").alias("rank"))
    )


def _in_blocks(v: DataFrame, q: DataFrame, k: int, schema: str, scoped: bool, block: int, rows_per_block: int) -> DataFrame:
    """Every block of queries meets every block of vectors of its scope once; both sides of a group are bounded."""
    counts = [x.groupBy("scope").agg(F.count(F.lit(1)).alias(n)) for x, n in ((q, "nq"), (v, "nv"))]
    sizes = counts[0].join(counts[1], "scope").select("scope", F.ceil(F.col("nq") / block).alias("q_blocks"), F.ceil(F.col("nv") / rows_per_block).alias("v_blocks"))

    def every(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

    left = v.join(sizes, "scope").withColumn("vb", F.pmod(F.xxhash64("vid"), F.col("v_blocks"))).withColumn("qb", every("q_blocks"))
    right = q.join(sizes, "scope").withColumn("qb", F.pmod(F.xxhash64("qid"), F.col("q_blocks"))).withColumn("vb", every("v_blocks"))
    left, right = left.drop("q_blocks", "v_blocks"), right.drop("q_blocks", "v_blocks")

    def match(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        parts = [pd.DataFrame({"qid": [], "vid": [], "score": []})]
        for n in set(queries["vec"].map(len)) & set(vectors["vec"].map(len)):
            some_q, some_v = queries[queries["vec"].map(len) == n], vectors[vectors["vec"].map(len) == n]
            best = _Partial(np.stack(some_q["vec"].to_list()), some_q["scope"].tolist() if scoped else None, k)
            best.add(
                some_v["vid"].to_numpy(), np.stack(some_v["vec"].to_list()),
                some_v["scope"].to_numpy(dtype=object) if scoped else None,
            )
            parts.append(pd.DataFrame(dict(zip(("qid", "vid", "score"), best.rows(some_q["qid"].tolist())))))
        return pd.concat(parts[1:]) if len(parts) > 1 else parts[0]

    return left.groupBy("scope", "vb", "qb").cogroup(right.groupBy("scope", "vb", "qb")).applyInPandas(match, schema)


def collapse_to_parents(child_hits: DataFrame, children: DataFrame, parents: DataFrame) -> DataFrame:
    """Best child score per parent, then the parent's row; tenant and level are checked again.

    ``child_hits``: ``query_id, client_id, vec_id, score``; ``children``: ``vec_id, client_id, parent_id,
    chunk_level``; ``parents``: ``parent_id, client_id, section, text``.
    """
    own = child_hits.join(children.filter("chunk_level = 'child'"), ["vec_id", "client_id"])
    best = own.groupBy("query_id", "client_id", "parent_id").agg(F.max("score").alias("score"))
    return best.join(parents, ["parent_id", "client_id"])


def fuse_ranks(hits: DataFrame, *, constant: int = RRF_CONSTANT, top: int = FUSED_HITS) -> DataFrame:
    """Reciprocal rank fusion of ``(query_id, index, locator, score)``.

    Hits are deduplicated by (index, locator), ranked from 0 inside their index, scored
    ``1 / (constant + rank)`` and cut to ``top``; ties keep index order, then rank.
    """
    unique = hits.groupBy("query_id", "index", "locator").agg(F.max("score").alias("score"))
    inside = Window.partitionBy("query_id", "index").orderBy(F.desc("score"), F.asc("locator"))
    ranked = unique.withColumn("index_rank", F.row_number().over(inside) - 1).filter(F.col("index_rank") < top)
    fused = ranked.withColumn("rrf", F.lit(1.0) / (F.lit(constant) + F.col("index_rank")))
    place = F.array_position(F.array(*[F.lit(i) for i in INDEX_ORDER]), F.col("index"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), place, F.asc("index_rank"))
    return (
        fused.withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= top)
        .select(
            "query_id", F.col("position").cast("bigint").alias("position"), "index", "locator", "score",
            F.col("index_rank").cast("bigint").alias("index_rank"), F.round("rrf", 6).alias("rrf"),
        )
    )


def merge_by_score(hits: DataFrame, top: int) -> DataFrame:
    """Union of hit lists: best score per id, then the ``top`` per query."""
    best = hits.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    ranked = best.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= top)
    return ranked.withColumn("position", F.col("position").cast("bigint"))


def locator(index: str, row: Mapping[str, Column] | None = None) -> Column:
    """Where a hit comes from, as text: pages of a document, chunk of a telemetry file, or section and files of an analysis."""
    col = lambda name: (row or {}).get(name, F.col(name)).cast("string")
    unknown = lambda name: F.coalesce(col(name), F.lit("?"))
    if index == "regulatory":
        return F.concat(unknown("source"), F.lit(" p."), unknown("page_start"), F.lit("-"), unknown("page_end"))
    if index == "telemetry":
        return F.concat(unknown("source"), F.lit(" chunk "), unknown("chunk_index"))
    if index == "analysis":
        return F.concat(F.lit("analysis:"), unknown("section"), F.lit(" ("), F.coalesce(col("sources"), F.lit("")), F.lit(")"))
    raise ValueError(f"Unknown index '{index}'")


def text_preview(text: Column) -> Column:
    """The first 300 characters, as result lists show them."""
    return F.left(text, F.lit(300))


def context_block(position: Column, locator: Column, text: Column, findings: Column | None = None) -> Column:
    """One numbered entry of retrieved context: source, text (1500 characters), exact values."""
    head = F.concat(F.lit("["), position.cast("string"), F.lit("] (source: "), locator, F.lit(")\n"), F.left(text, F.lit(1500)))
    if findings is None:
        return head
    return F.concat(head, F.coalesce(F.concat(F.lit("\nExact values (verbatim): "), findings), F.lit("")))


def hashed_terms(df: DataFrame, doc: str, text: str, dimension: int = 1024) -> DataFrame:
    """Term frequencies hashed into ``dimension`` slots, L2-normalised, as ``(doc, slot, weight)``."""
    terms = df.select(doc, F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")).alias("term")).filter("term <> ''")
    slot = F.conv(F.substring(F.md5("term"), 1, 6), 16, 10).cast("bigint") % dimension
    counted = terms.groupBy(doc, slot.alias("slot")).agg(F.count(F.lit(1)).alias("tf"))
    norm = F.sqrt(F.sum(F.col("tf") * F.col("tf")).over(Window.partitionBy(doc)))  # at most `dimension` slots
    return counted.select(doc, "slot", (F.col("tf") / norm).alias("weight"))


def embed(df: DataFrame, doc: str, text: str, *, dimension: int = 1024, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """``(doc, embedding)``: an injected vectorised embedder, or hashed terms."""
    if embedder is not None:
        return df.select(doc, embedder(F.col(text)).alias("embedding"))
    slots = hashed_terms(df, doc, text, dimension).groupBy(doc).agg(F.collect_list(F.struct("slot", "weight")).alias("w"))
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dimension)
    filled = F.transform(
        F.array_sort(F.concat("w", F.array(F.struct(F.lit(dimension).cast("bigint").alias("slot"), F.lit(0.0).alias("weight"))))),
        lambda x, i: F.struct(x["slot"].alias("slot"), x["weight"].alias("weight"), i.alias("i")),
    )
    ordered = slots.select(doc, filled.alias("w"))
    gap = lambda x: F.array_repeat(F.lit(0.0).cast("float"), (x["slot"] - F.when(x["i"] == 0, -1).otherwise(F.get(F.col("w.slot"), x["i"] - 1)) - 1).cast("int"))
    dense = F.slice(F.flatten(F.transform("w", lambda x: F.concat(gap(x), F.array(x["weight"].cast("float"))))), 1, dimension)
    every = df.select(doc).distinct().join(ordered.select(doc, dense.alias("embedding")), doc, "left")
    return every.select(doc, F.coalesce("embedding", zeros).alias("embedding"))


def cluster_lists(vectors: DataFrame, vector: str, lists: int, *, seed: int = 7, iterations: int = 10) -> tuple[DataFrame, np.ndarray]:
    """Assign every vector to one of ``lists`` k-means lists (``list_id``); also the list centres."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    featured = vectors.withColumn("_f", array_to_vector(F.col(vector).cast("array<double>")))
    model = KMeans(k=lists, seed=seed, maxIter=iterations, featuresCol="_f", predictionCol="list_id").fit(featured)
    return model.transform(featured).drop("_f"), np.array(model.clusterCenters())


def nearest_in_lists(
    listed: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, *, probes: int = 3, query_vector: str = "query_vector", **options
) -> DataFrame:
    """Approximate nearest: each query only ranks vectors of its ``probes`` nearest lists.

    With the vectors partitioned by ``list_id`` on disk, a probe reads one folder. Results are merged
    per query, so asking for all lists gives the exact answer.
    """
    centre_rows = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in centres])
    away = F.transform(
        centre_rows,
        lambda c, i: F.struct(
            F.aggregate(F.zip_with(c, F.col(query_vector), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x).alias("d"),
            i.alias("list_id"),
        ),
    )
    probed = queries.select("*", F.posexplode(F.slice(F.array_sort(away), 1, probes)).alias("_p", "_near"))
    routed = probed.select(
        (F.col("query_id") * probes + F.col("_p")).alias("probe_id"), "query_id", query_vector, F.col("_near.list_id").alias("probe_list")
    )
    hits = nearest(
        listed, routed, k, query_id="probe_id", query_vector=query_vector, scope=("list_id", "probe_list"), **options
    )
    merged = hits.withColumn("query_id", F.floor(F.col("probe_id") / probes))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return (
        merged.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "vec_id", "score", F.col("rank").cast("bigint").alias("rank"))
    )
