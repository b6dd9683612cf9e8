"""Token ids as ORC files.

Documents are range-partitioned and sorted by id, each task encodes its texts with a public tokenizer and writes one ORC file of its
part of the order: ids as run-length encoded integers, a row index every thousand documents and a Bloom filter on the document id.
A small table of the parts (their first id, rows and how many ids lie before them) is made from the files. Readers work stripe by
stripe in parallel; a document is found through part bounds, row index and Bloom filter, a range of ids through the table of parts.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from orepulse.llm.common import join_bounded

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
STRIPE_BYTES, ROW_GROUP, BLOOM_FPP = 16 << 20, 1000, 0.01  # a stripe is what one reader takes; a row group what an index entry covers
MAX_REMEMBERED = 600_000  # units whose ids a worker remembers, and as many older ones
MAX_UNIT = 100  # longer units are encoded, not remembered
MAX_TEXT = 1 << 20  # characters that are encoded at a time, unless one unit is longer
MAX_IDS = 4 << 20  # ids of a batch of output rows, unless one document has more


# The characters that lower-case text of plain Latin letters consists of, as the tokenizer's pattern sorts them.
_SPACE, _LETTER, _NUMBER = "\t-\r \x85\xa0", "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff\u0100-\u017f", "0-9\xb2\xb3\xb9\xbc-\xbe"
PLAIN = re.compile("[^\u0130\u0180-\U0010ffff]*")  # text whose normal form is itself and whose lower case has a letter for each letter
PIECES = re.compile(f"[{_LETTER}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")


class Encoder(dict):
    """``encoder[unit]``: the ids of a unit of text as little-endian unsigned 32-bit integers, worked out on first use.

    The tokenizer lower-cases, drops white space and makes no token across what its pattern separates. A text of plain Latin characters
    is cut into just these pieces; any other text, and one that may hold a special token, is cut at spaces, line feeds and tabs only. So
    a text's ids are those of its units in a row, and common units are encoded once. Tokenizers of another make are cut into nothing.
    """

    def __init__(self, definition: str):
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.older: dict[str, bytes] = {}
        rules = json.loads(definition)
        special = [t["content"] for t in rules.get("added_tokens", [])]
        self.whole = (
            rules.get("pre_tokenizer") != _PRE_TOKENIZER or rules.get("normalizer") != _NORMALIZER
            or any(not t.startswith("<|") or any(c.isspace() for c in t) for t in special)
        )
        line = {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False}
        bare = {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [line, _PRE_TOKENIZER["pretokenizers"][1]]}}
        self.bare = self.tokenizer if self.whole else Tokenizer.from_str(json.dumps(rules | bare))  # the same merges, for pieces one to a line
        suffix, vocabulary = rules["model"].get("end_of_word_suffix"), rules["model"].get("vocab")
        self.last = None  # whether a token ends a piece, if tokens show that
        if suffix and isinstance(vocabulary, dict):
            self.last = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
            self.last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def direct(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, new: Iterable[str], tokenizer) -> dict[str, bytes]:
        """Encode units that are not remembered, many in one go; those too long to remember are returned.

        A full memory becomes the older one, from which units that occur again are taken over.
        """
        kept, older = [], self.older
        long = {}
        for unit in new:
            if unit in older:
                self[unit] = older[unit]
            elif len(unit) <= MAX_UNIT:
                kept.append(unit)
            else:
                long[unit] = self.direct(unit)
        for at in range(0, len(kept), MAX_TEXT // 16):
            some = kept[at : at + MAX_TEXT // 16]
            data, ends = self.lines(some, tokenizer)
            borders = (4 * ends).tolist()
            self.update((unit, data[a:b]) for unit, a, b in zip(some, [0, *borders], borders))
        return long

    def lines(self, units: list[str], tokenizer) -> tuple[bytes, np.ndarray]:
        """The ids of units, encoded one to a line, and after how many ids each unit ends.

        Pieces end with their only token that can end one; a count that differs shows that these are no pieces, and places in the text decide.
        """
        text = "\n".join(units)
        if tokenizer is self.bare and self.last is not None:
            ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(units):
                return ids.tobytes(), ends
        whole = tokenizer.encode(text, add_special_tokens=False)
        offsets = whole.offsets
        place = np.array(next(zip(*offsets)), np.int64) if offsets else np.empty(0, np.int64)
        ends = np.cumsum(np.fromiter(map(len, units), np.int64, len(units)) + 1)
        return np.array(whole.ids, "<u4").tobytes(), np.searchsorted(place, ends)

    def texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        if self.whole:
            return [self.direct(t) for t in texts]
        if len(self) > MAX_REMEMBERED:
            self.older = dict(self)
            self.clear()
        plain = ["<|" not in t and (t.isascii() or PLAIN.fullmatch(t) is not None) for t in texts]
        units = [PIECES.findall(t.lower()) if p else t.replace("\n", " ").replace("\t", " ").split(" ") for t, p in zip(texts, plain)]
        long = self.learn([u for u in set().union(*[us for us, p in zip(units, plain) if p]) if u not in self], self.bare)
        if not all(plain):
            long |= self.learn({u for us, p in zip(units, plain) if not p for u in us if u not in self}, self.tokenizer)
        if long:
            return [b"".join([long[u] if u in long else self[u] for u in us]) for us in units]
        return [b"".join(map(self.__getitem__, us)) for us in units]


# What a tokenizer must do with a text before its merges for units to be encoded apart.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def _groups(texts: list[str]):
    """Slices of a list of texts with a bounded number of characters; one text is never split."""
    first, total = 0, 0
    for at, text in enumerate(texts):
        if total and total + len(text) > MAX_TEXT:
            yield slice(first, at)
            first, total = at, 0
        total += len(text)
    if first < len(texts):
        yield slice(first, len(texts))


def encoded(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """``doc_id, part, before, n_tokens, ids`` in ascending order of (doc_id, text digest), null ids first.

    ``part`` numbers the tasks in this order and ``before`` counts the ids of the documents before this one in its part.
    """
    spark = docs.sparkSession
    # A worker's copy of this value is its memory for as long as it lives: the tokenizer and what it has encoded.
    held = spark.sparkContext.broadcast({"definition": Path(tokenizer).read_text(encoding="utf-8")})
    key = to_arrow_type(docs.schema["doc_id"].dataType)
    end = np.array([end_id], "<u4").tobytes()
    names = ["doc_id", "part", "before", "n_tokens", "ids"]

    def run(batches):
        own = held.value
        if "encoder" not in own:
            own["encoder"] = Encoder(own["definition"])
        encoder, part, before = own["encoder"], TaskContext.get().partitionId(), 0

        def rows(doc_ids: pa.Array, data: list[bytes]):
            nonlocal before
            n = np.array([len(d) // 4 for d in data], np.int64)
            starts = before + np.concatenate([[0], np.cumsum(n)[:-1]])
            before += int(n.sum())
            values = pa.array(np.frombuffer(b"".join(data), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), values)
            columns = [doc_ids.cast(key), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), lists]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            texts, data, first, size = batch.column("text").to_pylist(), [], 0, 0
            for some in _groups(texts):
                for ids in encoder.texts(texts[some]):
                    if data and size + len(ids) > 4 * MAX_IDS:
                        yield rows(batch.column("doc_id").slice(first, len(data)), data)
                        first, data, size = first + len(data), [], 0
                    data.append(ids + end)
                    size += len(ids) + 4
            if data:
                yield rows(batch.column("doc_id").slice(first, len(data)), data)

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)
    made = T.StructType([docs.schema["doc_id"]] + T.StructType.fromDDL("part int, before long, n_tokens long, ids array<int>").fields)
    return dealt.mapInArrow(run, made)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> None:
    """Write the token ids of ``docs`` (doc_id, text) to the new folders ``folder``/ids and ``folder``/parts.

    Every text is encoded whole, without special tokens, and closed by ``end_id``; a null text is empty, so that it is the end id alone.
    Rows lie in ascending order of doc_id (null first), rows of one id in the order of their text digests; equal rows all stay.
    Further columns are not written. An empty table gives files without rows.
    """
    options = {
        "orc.create.index": "true", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(BLOOM_FPP),
        "orc.stripe.size": str(STRIPE_BYTES), "orc.row.index.stride": str(ROW_GROUP),
    }
    encoded(docs, tokenizer, end_id).write.options(**options).orc(f"{folder}/ids", compression="snappy")
    parts = _ids(docs.sparkSession, folder).groupBy("part").agg(
        F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("rows"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    )
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as files
    parts.withColumn("first", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).write.orc(f"{folder}/parts")


def _ids(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.orc(f"{folder}/ids")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents; ``start`` counts the ids of all documents before."""
    parts = spark.read.orc(f"{folder}/parts").select("part", "first")
    return join_bounded(_ids(spark, folder), parts, "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids")


def find_documents(spark: SparkSession, folder: str, doc_ids: list) -> DataFrame:
    """``read_tokens`` for the given ids; stripes and row groups without them are skipped by bounds and Bloom filters."""
    parts = spark.read.orc(f"{folder}/parts").select("part", "first")
    found = _ids(spark, folder).where(F.col("doc_id").isin(doc_ids))
    return found.join(F.broadcast(parts), "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids")


def token_range(spark: SparkSession, folder: str, start: int, stop: int) -> DataFrame:
    """``doc_id, start, ids``: the ids numbered from ``start`` up to before ``stop``, by document; only parts that hold some are read."""
    parts = spark.read.orc(f"{folder}/parts").where((F.col("first") < stop) & (F.col("first") + F.col("n_tokens") > start)).select("part", "first")
    wanted = parts.toArrow().to_pylist()  # as many rows as files that the range lies in
    rows = _ids(spark, folder).where(F.col("part").isin([p["part"] for p in wanted])).join(F.broadcast(parts), "part")
    at = F.col("first") + F.col("before")
    rows = rows.withColumn("at", at).where((F.col("at") < stop) & (F.col("at") + F.col("n_tokens") > start))
    skip = F.greatest(F.lit(start) - F.col("at"), F.lit(0)).cast("int")
    size = (F.least(F.lit(stop), F.col("at") + F.col("n_tokens")) - F.col("at")).cast("int") - skip
    return rows.select("doc_id", (F.col("at") + skip).alias("start"), F.slice("ids", skip + 1, size).alias("ids"))


def digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows as ``read_tokens`` gives them."""
    key = to_arrow_type(tokens.schema["doc_id"].dataType)

    def run(batches):
        for batch in batches:
            lists = batch.column("ids")
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            ends = (lists.offsets.to_numpy().astype(np.int64) * 4).tolist()
            sums = [zlib.crc32(data[a:b]) for a, b in zip(ends, ends[1:])]
            counts = lists.value_lengths().cast(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(key), batch.column("start"), counts, pa.array(sums, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )

    made = T.StructType([tokens.schema["doc_id"]] + T.StructType.fromDDL("start long, n_tokens long, ids_crc32 long").fields)
    return tokens.select("doc_id", "start", "ids").mapInArrow(run, made)
