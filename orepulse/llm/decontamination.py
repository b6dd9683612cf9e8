"""Benchmark decontamination by SimHash of item-sized windows.

A window that resembles an item shares at least one word shingle with it, so windows as long as an item are laid only where a document
has a shingle of an item, at the place the item would have there. Windows and items get a SimHash of their weighted shingles. Fingerprints
within the radius agree in at least one of radius + 1 blocks of bits, so joining on the blocks finds all of them; the weighted Jaccard
similarity of the shingles then decides exactly. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orepulse.llm.common import SHINGLE_WORDS, SIMILARITY, cut, join_bounded

HALF = 63  # bits of each half of a fingerprint; sums of three bits at a time share a long, 21 binary digits each
LANES, WIDTH = 3, 21
BLOCKS_PER_HALF = 16
BLOCKS = 2 * BLOCKS_PER_HALF
RADIUS = BLOCKS - 1  # a pair at the similarity bound differs in 19 of 126 bits, with a standard deviation of 4
LANE_MASK = sum(1 << (WIDTH * lane) for lane in range(LANES))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def _shingle(array: Column, at: Column, size: int, salt: int | None = None) -> Column:
    parts = [F.get(array, at + i) for i in range(size)]
    return F.xxhash64(*parts, *([] if salt is None else [F.lit(salt)]))


def _starts(array: Column, size: int) -> Column:
    """Places where a shingle of ``size`` words starts; an array that is shorter has none."""
    return F.when(F.size(array) >= size, F.sequence(F.lit(0), F.size(array) - size)).otherwise(F.array().cast("array<int>"))


def shingle_counts(arrays: DataFrame, key: list[str], size: int) -> DataFrame:
    """``key, h, g, c``: the distinct shingles of ``words``, two hashes and how often; fewer words than a shingle are one shingle."""
    short = F.size("words") < size
    at = F.explode(F.when(short, F.array(F.lit(0))).otherwise(_starts(F.col("words"), size)))
    rows = arrays.select(*key, "words", at.alias("at"))
    return rows.select(*key, _shingle(F.col("words"), F.col("at"), size).alias("h"), _shingle(F.col("words"), F.col("at"), size, 1).alias("g")).groupBy(
        *key, "h", "g"
    ).agg(F.count("*").alias("c"))


def fingerprints(counts: DataFrame, key: list[str]) -> DataFrame:
    """``key, low, high, total``: the two halves of the SimHash, a bit for each that more than half of the weight has set."""
    sums = {f"{half}{j}": F.sum(F.col("c") * F.shiftrightunsigned(half, j).bitwiseAND(LANE_MASK)) for half in ("h", "g") for j in range(WIDTH)}
    summed = counts.groupBy(*key).agg(F.sum("c").alias("total"), *[s.alias(n) for n, s in sums.items()])

    def gathered(half: str) -> Column:
        bits = [
            F.when(F.shiftrightunsigned(f"{half}{j}", WIDTH * lane).bitwiseAND((1 << WIDTH) - 1) * 2 > F.col("total"), F.lit(1 << (WIDTH * lane + j))).otherwise(0)
            for j in range(WIDTH)
            for lane in range(LANES)
        ]
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    return summed.select(*key, gathered("h").alias("low"), gathered("g").alias("high"), "total")


def blocks() -> Column:
    """The blocks of a fingerprint, each with its number."""
    pieces = [F.struct(F.lit(half * BLOCKS_PER_HALF + i).alias("number"), F.shiftrightunsigned(name, 4 * i).bitwiseAND(15).alias("bits"))
              for half, name in enumerate(("low", "high")) for i in range(BLOCKS_PER_HALF)]
    return F.explode(F.array(*pieces))


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, item_id, similarity, n_windows``: the documents that hold a passage like an item, with the best window's similarity.

    Whole texts are searched. Items shorter than a shingle are one shingle and must occur as they are; items without words match nothing,
    as do null and empty texts. Rows that share a doc_id or an item_id are taken together; a null id is an id of its own.
    """
    known = items.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    known = cut(known.distinct().withColumns({"item": F.monotonically_increasing_id(), "length": F.size("words")}))
    sizes = [r["k"] for r in known.select(F.least("length", F.lit(size)).alias("k")).distinct().collect()]  # at most `size` values
    found = None
    for k in sorted(sizes):
        some = known.where(F.least("length", F.lit(size)) == k)
        part = _of_size(docs, some, similarity, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        no_item = F.lit(None).cast(items.schema["item_id"].dataType).alias("item_id")
        found = docs.where("false").select("doc_id", no_item, F.lit(0.0).alias("similarity"), F.lit(0).alias("n_windows"))
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.sum("n_windows").alias("n_windows"))


def _of_size(docs: DataFrame, items: DataFrame, similarity: float, k: int) -> DataFrame:
    places = items.select("length", "words", F.explode(_starts(F.col("words"), k)).alias("there"))
    anchors = cut(places.select(_shingle(F.col("words"), F.col("there"), k).alias("h"), "there", "length").distinct())
    text = docs.select("doc_id", words(F.col("text")).alias("words"))
    here = text.select("doc_id", "words", F.explode(_starts(F.col("words"), k)).alias("at"))
    here = here.select("doc_id", "words", "at", _shingle(F.col("words"), F.col("at"), k).alias("h"))
    laid = join_bounded(here, anchors, "h")
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("there"), F.size("words") - F.col("length")))
    laid = laid.select("doc_id", "length", start.alias("start"), "words").select("doc_id", "length", "start", F.expr("slice(words, start + 1, length)").alias("words"))
    windows = cut(laid.distinct().withColumn("window", F.md5(F.concat_ws(" ", "words").cast("binary"))))

    key = ["window", "length"]
    distinct = windows.groupBy(*key).agg(F.min("words").alias("words"))
    counts = cut(shingle_counts(distinct, key, k))
    marks = cut(fingerprints(counts, key))
    item_counts = cut(shingle_counts(items, ["item", "length"], k))
    item_marks = cut(fingerprints(item_counts, ["item", "length"]))
    left = marks.select("window", "length", "low", "high", "total", blocks().alias("block"))
    right = item_marks.select(
        "item", F.col("length").alias("size"), F.col("low").alias("ilow"), F.col("high").alias("ihigh"), F.col("total").alias("itotal"), blocks().alias("iblock")
    )
    apart = F.bit_count(F.col("low").bitwiseXOR(F.col("ilow"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("ihigh")))
    near = left.join(right, (F.col("length") == F.col("size")) & (F.col("block") == F.col("iblock")) & (apart <= RADIUS))
    near = near.select("window", "length", "total", "item", "itotal").distinct()
    shared = near.join(counts.select("window", "length", "h", "g", "c"), key)
    shared = shared.join(item_counts.select("item", "h", "g", F.col("c").alias("ic")), ["item", "h", "g"])
    common = shared.groupBy("window", "length", "item", "total", "itotal").agg(F.sum(F.least("c", "ic")).alias("common"))
    alike = common.withColumn("similarity", F.col("common") / (F.col("total") + F.col("itotal") - F.col("common"))).where(F.col("similarity") >= similarity)
    hits = windows.select("doc_id", "window", "length").join(alike.select("window", "length", "item", "similarity"), key).join(items.select("item", "item_id"), "item")
    return hits.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.count("*").alias("n_windows"))


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, size: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` without the documents that hold a passage like an item.

    A document without an id goes with the other such documents; null and empty texts hold no passage and stay, repeated rows stay or go
    together. All columns are as they were.
    """
    bad = cut(contaminated(docs, items, similarity, size).select(F.col("doc_id").alias("_bad")).distinct())
    return docs.alias("d").join(bad.alias("b"), F.col("d.doc_id").eqNullSafe(F.col("b._bad")), "left_anti")


# For items of at least five words; windows are laid as above and every item of their length is compared.
SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ish AS (SELECT item_id, len(w) AS size, there, array_to_string(w[there:there + 4], ' ') AS s FROM i, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS there)),
dsh AS (SELECT doc_id, w, place, array_to_string(w[place:place + 4], ' ') AS s FROM d, LATERAL (SELECT unnest(range(1, len(w) - 3)) AS place)),
starts AS (SELECT DISTINCT doc_id, w, size, GREATEST(0, LEAST(place - there, len(w) - size)) AS start FROM dsh JOIN (SELECT DISTINCT size, there, s FROM ish) USING (s)),
windows AS (SELECT DISTINCT doc_id, size, w[start + 1:start + size] AS v FROM starts),
kinds AS (SELECT row_number() OVER () AS k, size, v FROM (SELECT DISTINCT size, v FROM windows)),
wc AS (SELECT k, size, s, COUNT(*) AS c FROM (SELECT k, size, array_to_string(v[p:p + 4], ' ') AS s FROM kinds, LATERAL (SELECT unnest(range(1, GREATEST(2, len(v) - 3))) AS p)) GROUP BY ALL),
wt AS (SELECT k, SUM(c) AS t FROM wc GROUP BY k),
ic AS (SELECT item_id, size, s, COUNT(*) AS c FROM ish GROUP BY ALL), it AS (SELECT item_id, SUM(c) AS t FROM ic GROUP BY item_id),
common AS (SELECT k, item_id, SUM(LEAST(wc.c, ic.c)) AS m FROM wc JOIN ic USING (size, s) GROUP BY ALL),
alike AS (SELECT k, item_id, CAST(m AS DOUBLE) / CAST(wt.t + it.t - m AS DOUBLE) AS similarity FROM common JOIN wt USING (k) JOIN it USING (item_id))
SELECT doc_id, item_id, MAX(similarity) AS similarity
FROM alike JOIN kinds USING (k) JOIN windows USING (size, v) WHERE similarity >= 0.8 GROUP BY doc_id, item_id
"""
