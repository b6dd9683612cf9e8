"""Ranked lexical search by accumulator-limited term-at-a-time evaluation.

One pass over the documents keeps, of each, its number of terms and its occurrences of query terms; counts over all of them give the
term weights. The second pass takes that table in blocks of documents: the block's postings are grouped by term, and every query reads its
terms rarest first. A term may create accumulators only while the terms that are left could still lift a new document to the k-th best
partial score; after that, later terms only add to the accumulators there are, which stay exact. The k-th best score of earlier blocks of
the task counts as a partial score too, so later blocks create few accumulators. Each task gives k rows per query, and the best k of these
are the answer.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from orepulse.llm.common import cut

TOP = 10
MOST_QUERY_TERMS = 500_000  # pairs of query and term that the tasks hold at a time; more queries are answered in several passes
BLOCK_POSTINGS, BLOCK_DOCS = 2_000_000, 1 << 17  # postings and documents of a block, unless one document has more
_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters beyond ASCII, only A to Z lower-cased."""
    return text.translate(_TERM_BYTES).split() if text else []


def _query_blocks(items: DataFrame, most_terms: int) -> list[DataFrame]:
    """The queries in groups of at most about ``most_terms`` pairs of query and term, by a hash of the query."""
    counted = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"] // 2 + 1  # a term and its border take two characters
    blocks = -(-counted // most_terms)
    if blocks == 1:
        return [items]
    place = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    return [items.where(place == b) for b in range(blocks)]


def query_postings(docs: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """``doc_id, n, terms, times``: of every document its number of terms, and which of ``words`` it has how often."""
    shipped = docs.sparkSession.sparkContext.broadcast(words)
    key = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        find = shipped.value.get
        for batch in batches:
            n, found, times, ends = [], [], [], [0]
            for text in batch.column("text").to_pylist():
                words = terms_of(text)
                n.append(len(words))
                counts: dict[int, int] = {}
                for term in map(find, words):
                    if term is not None:
                        counts[term] = counts.get(term, 0) + 1
                found += counts
                times += counts.values()
                ends.append(len(found))
            at = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(values, pa.int32())) for values in (found, times)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(key), pa.array(n, pa.int64()), *lists], names=["doc_id", "n", "terms", "times"])

    made = T.StructType([docs.schema["doc_id"]] + T.StructType.fromDDL("n long, terms array<int>, times array<int>").fields)
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, made)


class Block:
    """The postings of a block of documents by term: ``docs[first[t]:first[t + 1]]`` have term t and gain ``gain`` from it."""

    def __init__(self, n: np.ndarray, owner: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, total_docs: int, total_terms: int):
        order = np.argsort(terms, kind="stable")
        self.docs, terms, times = owner[order], terms[order], times[order].astype(np.int64)
        m = 10 + (90 * n * total_docs) // total_terms
        self.gain = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 8 * m[self.docs]))
        self.first = np.searchsorted(terms, np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        some = np.flatnonzero(self.first[1:] > self.first[:-1])
        if len(some):
            self.most[some] = np.maximum.reduceat(self.gain, self.first[some])
        self.scores, self.live = np.zeros(len(n), np.int64), np.zeros(len(n), bool)

    def best(self, query: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best of a query, whose k-th best so far scores ``floor``, with their exact scores.

        ``query`` holds terms, rarest first. Documents that tie with the k-th best are all returned.
        """
        query = query[self.most[query] > 0]
        left = np.cumsum(self.most[query][::-1])[::-1]  # what a document can gain from this term and all later ones
        members, creating, bar = np.empty(0, np.int64), True, floor
        for term, bound in zip(query, left):
            postings = slice(self.first[term], self.first[term + 1])
            docs, gain = self.docs[postings], self.gain[postings]
            if creating and len(members) >= k:
                partial = self.scores[members]
                bar = max(floor, int(np.partition(partial, len(members) - k)[len(members) - k]))
            creating = creating and bound >= bar
            if creating:
                new = docs[~self.live[docs]]
                self.live[new] = True
                members = np.concatenate([members, new])
            else:
                there = self.live[docs]
                docs, gain = docs[there], gain[there]
            self.scores[docs] += gain
            if not creating and not len(members):
                break
        scores = self.scores[members]
        self.scores[members], self.live[members] = 0, False
        if len(members) > k:
            bar = max(floor, int(np.partition(scores, len(members) - k)[len(members) - k]))
        wanted = scores >= max(bar if len(members) > k else floor, 1)
        return members[wanted], scores[wanted]


def _top(table: pa.Table, k: int) -> pa.Table:
    order = pc.sort_indices(table, [("score", "descending"), ("doc_id", "ascending")], null_placement="at_end")
    return table.take(order[:k])


def search(docs: DataFrame, items: DataFrame, k: int = TOP, most_terms: int = MOST_QUERY_TERMS) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of ``docs`` (doc_id, text) that score best for each of ``items`` (item_id, text).

    Only documents that score above 0 are ranked, equal scores by ascending doc_id (null last). Every row of ``docs`` is a document of
    its own, also if an id repeats; every row of ``items`` a query of its own, and rows that share an item_id are ranked each for itself.
    Null and empty texts have no terms: as documents they are never found, as queries they have no result. Further columns are ignored.
    Empty tables give no rows.
    """
    out = None
    for group in _query_blocks(items, most_terms):
        found = _search(docs, group, k)
        out = found if out is None else out.unionByName(found)
    return out


def _search(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    asked = items.select("item_id", F.col("text").cast("binary").alias("text")).toArrow()  # bounded by the block of queries
    texts = [list(dict.fromkeys(terms_of(t))) for t in asked.column("text").to_pylist()]
    words = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    postings = cut(query_postings(docs, words))
    totals = postings.agg(F.coalesce(F.sum((F.col("n") > 0).cast("long")), F.lit(0)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"]
    df = np.zeros(len(words), np.int64)
    for row in postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # as many rows as query terms at most
        df[row["term"]] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    queries = [np.array(sorted((words[w] for w in t if df[words[w]]), key=lambda i: (df[i], i)), np.int64) for t in texts]
    shipped = spark.sparkContext.broadcast((weights, queries))
    key = to_arrow_type(docs.schema["doc_id"].dataType)

    def run(batches):
        weights, queries = shipped.value
        best: list[pa.Table | None] = [None] * len(queries)

        def take(held: list[pa.RecordBatch]):
            table = pa.Table.from_batches(held).combine_chunks()
            lists, ids = table.column("terms").combine_chunks(), table.column("doc_id").combine_chunks()
            owner = np.repeat(np.arange(len(table)), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = [table.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("terms", "times")]
            block = Block(table.column("n").to_numpy(), owner, *flat, weights, n_docs, n_terms)
            for q, query in enumerate(queries):
                old = best[q]
                floor = old.column("score")[k - 1].as_py() if old is not None and len(old) == k else 0
                found, scores = block.best(query, k, floor)
                if len(found):
                    new = pa.table({"doc_id": ids.take(pa.array(found)), "score": pa.array(scores)})
                    best[q] = _top(new if old is None else pa.concat_tables([old, new]), k)

        held, size, rows = [], 0, 0
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
            held.append(batch)
            size, rows = size + len(batch.column("terms").flatten()), rows + len(batch)
            if size >= BLOCK_POSTINGS or rows >= BLOCK_DOCS:
                take(held)
                held, size, rows = [], 0, 0
        if rows:
            take(held)
        for q, table in enumerate(best):
            if table is not None:
                table = table.combine_chunks()
                columns = [pa.array(np.full(len(table), q)), table.column("doc_id").combine_chunks().cast(key), table.column("score").combine_chunks()]
                yield pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "score"])

    made = T.StructType([T.StructField("query", T.LongType()), docs.schema["doc_id"], T.StructField("score", T.LongType())])
    near = postings.mapInArrow(run, made)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    ranked = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = T.StructType([T.StructField("query", T.LongType()), items.schema["item_id"]])
    known = spark.createDataFrame(pa.table({"query": pa.array(range(len(asked)), pa.int64()), "item_id": asked.column("item_id")}), names)
    return ranked.join(F.broadcast(known), "query").select("item_id", "rank", "doc_id", "score")


SQL = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents
), counts AS (SELECT doc_id, term, COUNT(*) AS tf FROM terms GROUP BY doc_id, term),
lengths AS (SELECT doc_id, SUM(tf) AS n FROM counts GROUP BY doc_id),
totals AS (SELECT COUNT(*) AS docs, SUM(n) AS words FROM lengths),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), weights AS (
  SELECT term, CAST(FLOOR(1000 * LN(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM (SELECT term, COUNT(*) AS df FROM counts WHERE term IN (SELECT term FROM asked) GROUP BY term), totals
), gains AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // words))) AS gain
  FROM counts JOIN weights USING (term) JOIN lengths USING (doc_id), totals
), scores AS (SELECT item_id, doc_id, SUM(gain) AS score FROM asked JOIN gains USING (term) GROUP BY item_id, doc_id HAVING SUM(gain) > 0),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM scores)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM ranked WHERE place <= 10
"""
