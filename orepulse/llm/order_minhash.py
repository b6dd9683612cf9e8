"""Near-duplicate documents by Order MinHash.

A text is the sequence of its word shingles, each labelled with how often it occurred before, so that all are different. Under each of
many hash functions the smallest few are sampled and put back into text order; two texts agree on such a sample with a chance that falls
with their edit distance, not only with what they share. Texts that agree on a sample are aligned within the band that the similarity
allows. Equal texts are collapsed first; classes are the connected components of the links.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orepulse.llm.common import SHINGLE_WORDS, SIMILARITY, cut, join_bounded, per_batch
from orepulse.llm.components import linked, ranked_id

SAMPLES, PICKED = 24, 5  # at shingle similarity 0.8 a pair agrees on some sample with chance 1 - (1 - 0.8 ** 5) ** 24 = 0.9999
SHORT = 10  # texts of up to so many shingles also give keys with which any pair at similarity 0.8 among them meets for certain
CHUNK_WORDS = 400_000
LOOK = 32  # places that the alignment compares at a time
_RANDOM = np.random.default_rng(23)
FACTORS = _RANDOM.integers(1, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
POWERS = _RANDOM.integers(1, 1 << 63, SHINGLE_WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LABEL = np.uint64(0x9E3779B97F4A7C15)  # fixed value: the golden ratio, a common odd multiplier


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_sequences(texts: list[str | None], size: int = SHINGLE_WORDS) -> list[np.ndarray]:
    """For each text the hashes of its labelled word shingles in order; fewer words than a shingle are one, no words none."""
    words = [(t or "").lower().split() for t in texts]
    lengths = np.array([len(w) for w in words], np.int64)
    if not lengths.sum():
        return [np.empty(0, np.uint64) for _ in texts]
    each = pd.util.hash_array(np.array([w for ws in words for w in ws], dtype=object), categorize=False)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    total = len(each)
    rolled = np.zeros(total, np.uint64)
    for j in range(size):
        if j < total:
            rolled[: total - j] += each[j:] * POWERS[j]
    place = np.arange(total) - np.repeat(starts, lengths)
    whole = place <= np.repeat(lengths, lengths) - size
    short = np.flatnonzero((lengths > 0) & (lengths < size))
    for i in short:
        rolled[starts[i]] = (each[starts[i] : starts[i] + lengths[i]] * POWERS[: lengths[i]]).sum(dtype=np.uint64) + np.uint64(lengths[i])
        whole[starts[i]] = True
    owner = np.repeat(np.arange(len(words)), lengths)[whole]
    shingles = mix(rolled[whole])
    inside = shingles ^ mix(owner.astype(np.uint64) + np.uint64(1))
    twice = np.flatnonzero(pd.Series(inside).duplicated(keep=False).to_numpy())
    if len(twice):
        before = pd.Series(inside[twice]).groupby(inside[twice]).cumcount().to_numpy().astype(np.uint64)
        shingles[twice] = mix(shingles[twice] + before * LABEL)
    return np.split(shingles, np.cumsum(np.bincount(owner, minlength=len(words)))[:-1])


def samples(sequences: list[np.ndarray], picked: int = PICKED) -> np.ndarray:
    """A row per text and a column per hash function: the ``picked`` smallest shingles in text order as one key. Texts with fewer
    shingles give all they have; those without any must be left out before."""
    values = np.zeros((len(sequences), SAMPLES, picked), np.uint64)
    for row, shingles in enumerate(sequences):
        if len(shingles) <= picked:
            values[row, :, : len(shingles)] = shingles
            continue
        for some in [slice(0, SAMPLES)] if len(shingles) <= 100_000 else [slice(i, i + 1) for i in range(SAMPLES)]:
            at = np.argpartition(shingles[None, :] * FACTORS[some, None], picked - 1, axis=1)[:, :picked]
            at.sort(axis=1)
            values[row, some] = shingles[at]
    keys = np.broadcast_to(np.arange(1, SAMPLES + 1, dtype=np.uint64) * LABEL, values.shape[:2])
    for i in range(picked):
        keys = mix((keys ^ values[:, :, i]) * LABEL)
    return keys.view(np.int64)


def short_keys(shingles: np.ndarray) -> np.ndarray:
    """Of a text of few shingles the whole sequence and those with one left out as keys, of ten shingles also those with two left out.

    At similarity 0.8 two such texts have a common sequence that lacks at most one shingle of each, or they have eight and ten.
    """
    n = len(shingles)
    if n < 4 or n > SHORT:
        return np.empty(0, np.int64)
    out = []
    for left in range(n - (2 if n == 10 else 1), n + 1):
        some = shingles[np.array(list(combinations(range(n), left)))]
        keys = np.full(len(some), SAMPLES + 1, np.uint64) * LABEL
        for i in range(left):
            keys = mix((keys ^ some[:, i]) * LABEL)
        out.append(keys)
    return np.concatenate(out).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether an alignment matches enough: matches / (len(a) + len(b) - matches) reaches the similarity.

    The furthest place on every diagonal is pushed on edit by edit (insertions and deletions); the similarity bounds the number of
    edits, and that bounds the band of diagonals.
    """
    total = len(a) + len(b)
    band = int(np.floor(total - 2 * similarity * total / (1 + similarity) + 1e-9))
    if abs(len(a) - len(b)) > band:
        return False
    shared = np.intersect1d(a, b).size  # no alignment matches more
    if total - 2 * shared > band:
        return False
    size = min(len(a), len(b))
    same = a[:size] == b[:size]
    head = size if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n, m = len(a), len(b)
    wide_a, wide_b = np.concatenate([a, np.zeros(LOOK, a.dtype)]), np.concatenate([b, np.zeros(LOOK, b.dtype)])
    steps = np.arange(LOOK)
    reach = np.full(2 * band + 3, -1, np.int64)  # diagonal k at band + 1 + k
    reach[band + 2] = 0
    for edits in range(band + 1):
        k = np.arange(-edits, edits + 1, 2)
        k = k[(k >= -m) & (k <= n)]
        at = band + 1 + k
        x = np.where((k == -edits) | ((k != edits) & (reach[at - 1] < reach[at + 1])), reach[at + 1], reach[at - 1] + 1)
        moving = np.flatnonzero((x < n) & (x - k < m) & (x >= 0) & (x - k >= 0))
        while len(moving):
            p, q = x[moving, None] + steps, (x - k)[moving, None] + steps
            equal = (p < n) & (q < m)
            equal &= wide_a[np.minimum(p, n)] == wide_b[np.minimum(q, m)]
            run = np.where(equal.all(axis=1), LOOK, equal.argmin(axis=1))
            x[moving] += run
            moving = moving[run == LOOK]
        reach[at] = x
        if ((x >= n) & (x - k >= m)).any():
            return True
    return False


def _chunks(texts: list):
    """Parts of a list of texts with a bounded number of characters; one text is never split."""
    held, total = [], 0
    for text in texts:
        held.append(text)
        total += len(text or "")
        if total >= CHUNK_WORDS * 6:
            yield held
            held, total = [], 0
    if held:
        yield held


def _placed(values: list[np.ndarray], rows: list[int], n: int) -> list:
    """The rows of ``values`` at their places among ``n``, empty lists elsewhere."""
    out: list = [[]] * n
    for row, value in zip(rows, values):
        out[row] = value
    return out


def sketches(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, k1, k2, keys``: the digest of the text and the sample keys of every row."""

    def work(texts: list) -> list:
        keys = []
        for part in _chunks(texts):
            sequences = shingle_sequences(part, size)
            full = [i for i, s in enumerate(sequences) if len(s)]
            found = samples([sequences[i] for i in full])
            keys += _placed([np.concatenate([k, short_keys(sequences[i])]) for i, k in zip(full, found)], full, len(part))
        return [keys]

    return per_batch(digested(docs), work, "keys array<long>")


def digested(docs: DataFrame) -> DataFrame:
    """``doc_id, text, k1, k2`` of the rows that have a text."""
    return docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"))


def links_across(left: pd.DataFrame, right: pd.DataFrame, similarity: float) -> list[tuple[int, int]]:
    """For each left text one link to every other component of the right side that has a text like it; columns id, component, s.

    The numbers of shared shingles with all right texts come from one pass; only texts that share enough are aligned.
    """
    others = [np.frombuffer(s, np.uint32) for s in right["s"]]
    sizes = np.array([len(s) for s in others])
    values, where = np.unique(np.concatenate(others), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    ids, groups = right["id"].to_numpy(), right["component"].to_numpy()
    out, mark = [], np.zeros(len(values), np.int64)
    for own, group, data in zip(left["id"], left["component"], left["s"]):
        mine = np.frombuffer(data, np.uint32)
        at = np.minimum(np.searchsorted(values, mine), len(values) - 1)
        at = at[values[at] == mine]
        mark[at] = 1
        shared = np.add.reduceat(mark[where], starts)
        mark[at] = 0
        enough = np.flatnonzero((shared >= similarity * (len(mine) + sizes - shared) - 1e-9) & (groups != group))
        done: set[int] = set()
        for i in enough[np.argsort(-shared[enough], kind="stable")]:
            if groups[i] not in done and aligned(mine, others[i], similarity):
                done.add(groups[i])
                out.append((own, ids[i]))
    return out


BLOCK = 512  # texts of a bucket that are compared with as many others in one task


def classes(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE_WORDS) -> DataFrame:
    """``k1, k2, keeper`` of every text: the row that stays for its class, as (no_id, doc_id, k1, k2), smallest first."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "k1", "k2")
    found = sketches(docs, size).groupBy("k1", "k2").agg(
        F.min(row).alias("first"), F.count("*").alias("n"), F.first("keys").alias("keys")
    )
    marked = cut(found.withColumn("id", ranked_id(F.col("n"))))

    def sequences(ids: DataFrame) -> DataFrame:
        """``id, s``: the folded shingle hashes of texts; 32 bits are enough to tell the shingles of two texts apart."""
        wanted = cut(marked.select("id", "k1", "k2", "first.doc_id").join(ids.distinct(), "id"))
        texts = join_bounded(digested(docs).select("k1", "k2", "doc_id", "text"), wanted.withColumnRenamed("doc_id", "of"), ["k1", "k2"])
        texts = texts.where(F.col("doc_id").eqNullSafe(F.col("of"))).select("id", "text")

        def cut_up(texts: list) -> list:
            parts = [shingle_sequences(part, size) for part in _chunks(texts)]
            return [[(s >> np.uint64(32)).astype(np.uint32).tobytes() for part in parts for s in part]]

        return cut(per_batch(texts, cut_up, "s binary").dropDuplicates(["id"]))

    def verify(pairs: DataFrame) -> DataFrame:
        pairs = cut(pairs)
        found = sequences(pairs.select(F.explode(F.array("a", "b")).alias("id")))

        def compare(batches):
            for batch in batches:
                alike = [aligned(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), similarity) for x, y in zip(batch["x"], batch["y"])]
                yield batch.loc[alike, ["a", "b"]]

        left, right = found.select(F.col("id").alias("a"), F.col("s").alias("x")), found.select(F.col("id").alias("b"), F.col("s").alias("y"))
        fits = F.least(F.length("x"), F.length("y")) >= F.lit(similarity) * F.greatest(F.length("x"), F.length("y"))
        return pairs.join(left, "a").join(right, "b").where(fits).select("a", "b", "x", "y").mapInPandas(compare, "a long, b long")

    def across(rest: DataFrame) -> DataFrame:
        counts = rest.groupBy("key").agg(
            F.ceil(F.count_if("outside") / BLOCK).cast("int").alias("left_blocks"), F.ceil(F.count("*") / BLOCK).cast("int").alias("right_blocks")
        )
        rest = rest.join(counts, "key")
        own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = rest.where("outside").select("key", own("left_blocks").alias("i"), every("right_blocks").alias("j"), F.lit(True).alias("left"), "id", "component")
        right = rest.select("key", every("left_blocks").alias("i"), own("right_blocks").alias("j"), F.lit(False).alias("left"), "id", "component")
        dealt = left.unionByName(right).join(sequences(rest.select("id")), "id")

        def compare(group: pd.DataFrame) -> pd.DataFrame:
            sides = [group[group["left"]], group[~group["left"]]]
            found = links_across(*sides, similarity) if all(map(len, sides)) else []
            return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

        return dealt.groupBy("key", "i", "j").applyInPandas(compare, "a long, b long").distinct()

    members = marked.select("id", F.explode("keys").alias("key"))
    found = cut(linked(members, verify, across))
    joined = marked.select("id", "k1", "k2", "first").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    keepers = joined.groupBy("component").agg(F.min("first").alias("keeper"))
    return joined.join(keepers, "component").select("k1", "k2", "keeper")


def _classified(docs: DataFrame, similarity: float, size: int) -> DataFrame:
    """The rows of ``docs``, each as the one value ``_whole`` so that no column name can clash, with ``_class_id`` and ``_kept``."""
    found = cut(classes(docs, similarity, size))
    k1, k2 = F.xxhash64("text"), F.xxhash64("text", F.lit(1))
    keyed = docs.select(F.struct(*docs.columns).alias("_whole"), "doc_id", F.when(F.col("text").isNotNull(), k1).alias("_k1"), k2.alias("_k2"))
    put = found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("keeper").alias("_keeper"))
    placed = join_bounded(keyed, put, ["_k1", "_k2"], "left")
    chosen = F.col("_keeper").isNull() | (
        F.col("doc_id").eqNullSafe(F.col("_keeper.doc_id")) & (F.col("_k1") == F.col("_keeper.k1")) & (F.col("_k2") == F.col("_keeper.k2"))
    )
    class_id = F.when(F.col("_keeper").isNull(), F.col("doc_id")).otherwise(F.col("_keeper.doc_id"))
    placed = placed.withColumns({"_class_id": class_id, "_kept": chosen}).drop("_keeper")
    repeated = placed.where("_kept and _k1 is not null").groupBy("doc_id", "_k1", "_k2").agg(F.count("*").alias("_n")).where("_n > 1")
    repeated = cut(repeated.select(F.col("doc_id").alias("_id"), F.col("_k1").alias("_r1"), F.col("_k2").alias("_r2")))
    on = (F.col("_k1") == F.col("_r1")) & (F.col("_k2") == F.col("_r2")) & F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_kept")
    again = placed.join(F.broadcast(repeated) if repeated.count() <= 400_000 else repeated, on, "left_semi")
    order = Window.partitionBy("doc_id", "_k1", "_k2").orderBy("_k1")
    again = again.withColumn("_kept", F.row_number().over(order) == 1)
    once = placed.join(F.broadcast(repeated) if repeated.count() <= 400_000 else repeated, on, "left_anti")
    return once.unionByName(again).drop("_k1", "_k2")


def near_documents(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with ``class_id``, the doc_id of the document that stays for the class, and ``kept``, whether this row is it.

    Equal texts, empty ones too, are one class; a null text is a class of its own. The row with the smallest doc_id stays (null last); of
    equal rows one. Columns of ``docs`` that have these names are replaced.
    """
    found = _classified(docs, similarity, size)
    others = [F.col("_whole").getField(c).alias(c) for c in docs.columns if c not in ("class_id", "kept")]
    return found.select(*others, F.col("_class_id").alias("class_id"), F.col("_kept").alias("kept"))


def drop_near_documents(docs: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE_WORDS) -> DataFrame:
    """One document of each class, with the columns of ``docs``; null texts all stay."""
    found = _classified(docs, similarity, size).where("_kept")
    return found.select(*[F.col("_whole").getField(c).alias(c) for c in docs.columns])
