"""Spelling variants by range search in k-d trees over letter counts.

A word is the vector of its letter counts. One replaced letter lowers one count by one and raises another by one, one inserted letter
raises one count by one, so words that are one edit apart have vectors at most two apart in L1. For every word length a k-d tree over these
vectors cuts the words into cells; a word is searched in the trees of its own length and of the next one, only in cells whose box the one
lowered and the one raised count can reach. Inside a cell the same search goes on down to a few words, whose vectors and then whose letter
order are compared. Links are counted where they are found, so no pair is ever a row.

The upper part of the trees is learned from a bounded sample of the words. It only decides how even the cells are: every word lies in
exactly one cell and every cell within reach is searched, so the result does not depend on it.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orepulse.llm.common import cut, drop_cut, join_bounded

MODULUS = 97  # one in so many occurrences of a word loses a letter, see word_counts
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 5, 3, 2
SAMPLE = 200_000  # about as many words are sent to the driver to learn the upper part of the trees
CELL = 4096  # words that a cell should hold
MOST_LETTERS, MOST_ASKED = 16 * CELL, 1 << 17  # letters of the words of a cell and searches of it that one task takes; larger cells are split
FEW = 16  # words below which a search compares instead of splitting
PAIRS, ROWS = 1 << 18, 1 << 13  # pairs compared and words counted at a time
MOST_REMEMBERED = 400_000  # words counted in a task before the counts are passed on
LETTERS = 90  # a to z and the 64 characters from À to ÿ
MEMBER, SAME, SHORTER = 0, 1, 2  # what a row is to its cell: one of its words, a word of the same length to search, one of a letter less
NONE, SPENT = -1, 255  # no letter lowered or raised yet; none may be

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, modulus: int = MODULUS) -> DataFrame:
    """``word, n``: the words of all texts with their occurrences.

    A run of letters (A to Z lower-cased) loses its code point ``h % length`` where ``modulus`` divides h, the crc32 of id and run.
    """
    runs = re.compile(f"[a-zÀ-ÿ]{{{least_length},}}")  # shorter runs give no word

    def run(batches):
        counts: dict[str, int] = {}

        def out():
            yield pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
            counts.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(runs.findall(text.translate(_LOWER).decode("utf-8", "replace"))).items():
                    h = zlib.crc32(word.encode(), start)
                    if h % modulus == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > MOST_REMEMBERED:
                    yield from out()
        yield from out()

    texts = docs.where("text is not null").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def letters(words: list[str]) -> np.ndarray:
    """A row per word, all of one length, with the numbers of its letters."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(len(words), -1)
    return np.where(points < 0xC0, points - 97, points - 0xC0 + 26).astype(np.uint8)


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """How often each word has each letter, 255 standing for more (which can only make distances smaller)."""
    out = np.empty((len(codes), LETTERS), np.uint8)
    for at in range(0, len(codes), ROWS):
        some = codes[at : at + ROWS]
        flat = np.arange(len(some))[:, None] * LETTERS + some
        out[at : at + ROWS] = np.minimum(np.bincount(flat.ravel(), minlength=len(some) * LETTERS), 255).reshape(len(some), LETTERS)
    return out


def present(vectors: np.ndarray) -> np.ndarray:
    """The letters a word has as bits, some letters sharing one; a count that changes by one changes one bit at most."""
    bits = np.uint64(1) << (np.arange(LETTERS, dtype=np.uint64) % np.uint64(64))
    out = np.empty(len(vectors), np.uint64)
    for at in range(0, len(vectors), ROWS):
        out[at : at + ROWS] = np.bitwise_or.reduce(np.where(vectors[at : at + ROWS] > 0, bits, np.uint64(0)), axis=1)
    return out


def split_of(vectors: np.ndarray) -> tuple[int, int, float] | None:
    """The letter and count that part the vectors most evenly (at most this count, or more), with the smaller part's share."""
    best = None
    for count in range(3):
        share = (vectors <= count).mean(axis=0)
        letter = int(np.abs(share - 0.5).argmin())
        smaller = float(min(share[letter], 1 - share[letter]))
        if smaller > 0 and (best is None or smaller > best[2]):
            best = (letter, count, smaller)
    if best is None:
        spread = vectors.max(axis=0).astype(int) - vectors.min(axis=0)
        letter = int(spread.argmax())
        if not spread[letter]:
            return None
        count = min(int(np.median(vectors[:, letter])), int(vectors[:, letter].max()) - 1)
        best = (letter, count, float(min((x := (vectors[:, letter] <= count).mean()), 1 - x)))
    return best


def learn_trees(sample: list[str], total: int, cell: int = CELL) -> dict[int, list[tuple[int, int, int, int]]]:
    """By word length the nodes (letter, count, node below, node above) of a tree; a letter of -1 is a cell and the count its number."""
    each = max(1.0, total / max(1, len(sample)))  # words that a word of the sample stands for
    trees = {}
    by_length: dict[int, list[str]] = {}
    for word in sorted(sample):
        by_length.setdefault(len(word), []).append(word)
    for length, words in by_length.items():
        nodes: list[tuple[int, int, int, int]] = []
        cells = 0

        def grow(vectors: np.ndarray) -> int:
            nonlocal cells
            at = len(nodes)
            nodes.append((-1, 0, 0, 0))
            found = split_of(vectors) if len(vectors) * each > cell and len(vectors) > 1 else None
            if found is None:
                nodes[at] = (-1, cells, 0, 0)
                cells += 1
            else:
                letter, count, _ = found
                below = vectors[:, letter] <= count
                nodes[at] = (letter, count, grow(vectors[below]), grow(vectors[~below]))
            return at

        grow(letter_counts(letters(words)))
        trees[length] = nodes
    return trees


def step(value: np.ndarray, letter: int, count: int, lowered: np.ndarray, raised: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which searches reach the part with at most ``count`` of ``letter`` and which the other, and what they have lowered or raised then.

    A search may lower one count and raise one; what it did so far is part of its vector.
    """
    value = value.astype(np.int16) - (lowered == letter) + (raised == letter)
    below = (value <= count) | ((value == count + 1) & (lowered == NONE))
    above = (value > count) | ((value == count) & (raised == NONE))
    return below, above, np.where(value > count, letter, lowered).astype(np.int16), np.where(value <= count, letter, raised).astype(np.int16)


def cells_in_reach(nodes: list[tuple[int, int, int, int]], vectors: np.ndarray, lower: bool, rise: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of ``vectors``, cell) of all cells that a vector reaches by lowering and raising one count, as far as allowed."""
    n = len(vectors)
    rows, cells = [], []
    work = [(0, np.arange(n), np.full(n, NONE if lower else SPENT, np.int16), np.full(n, NONE if rise else SPENT, np.int16))]
    while work:
        node, at, lowered, raised = work.pop()
        letter, count, low, high = nodes[node]
        if not len(at):
            continue
        if letter < 0:
            rows.append(at)
            cells.append(np.full(len(at), count, np.int64))
            continue
        below, above, down, up = step(vectors[at, letter], letter, count, lowered, raised)
        work.append((low, at[below], down[below], raised[below]))
        work.append((high, at[above], lowered[above], up[above]))
    return (np.concatenate(rows), np.concatenate(cells)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def searches(words: DataFrame, trees: dict[int, list[tuple[int, int, int, int]]]) -> DataFrame:
    """``length, cell, kind, word, n``: every word as a member of its cell and as a search of all cells in reach."""
    shipped = words.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        trees, single = shipped.value, [(-1, 0, 0, 0)]
        for batch in batches:
            texts = np.array(batch.column("word").to_pylist(), object)
            sizes = np.array([len(w) for w in texts], np.int64)
            for length in np.unique(sizes):
                own = np.flatnonzero(sizes == length)
                for some in np.array_split(own, -(-len(own) * int(length) // (1 << 21))):
                    vectors = letter_counts(letters(texts[some].tolist()))
                    for kind, size, lower, rise in ((MEMBER, length, False, False), (SAME, length, True, True), (SHORTER, length + 1, False, True)):
                        rows, cells = cells_in_reach(trees.get(int(size), single), vectors, lower, rise)
                        for at in range(0, len(rows), 100_000):
                            picked = pa.array(some[rows[at : at + 100_000]])
                            k = len(picked)
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(k, size, np.int32)), pa.array(cells[at : at + k]), pa.array(np.full(k, kind, np.int8)),
                                 batch.column("word").take(picked), batch.column("n").take(picked)],
                                names=["length", "cell", "kind", "word", "n"],
                            )

    return words.select("word", "n").mapInArrow(run, "length int, cell long, kind byte, word string, n long")


def pairs_in_cell(members: np.ndarray, asked: np.ndarray, shorter: np.ndarray):
    """Yields arrays (search, member) of pairs that are one edit apart; ``members`` and ``asked`` are letter numbers, padded for ``shorter``."""
    length = members.shape[1]
    counts, wanted = letter_counts(members), _asked_counts(asked, shorter)
    masks = present(counts), present(wanted)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    total = 0

    def compared():
        at = np.concatenate([x for x, _ in held])
        to = np.concatenate([y for _, y in held])
        held.clear()
        near = np.bitwise_count(masks[1][at] ^ masks[0][to]) <= 2 - shorter[at]
        at, to = at[near], to[near]
        most = max(1, PAIRS // max(1, length))
        for some in range(0, len(at), PAIRS // 4):
            a, b = at[some : some + PAIRS // 4], to[some : some + PAIRS // 4]
            apart = np.abs(wanted[a].astype(np.int16) - counts[b]).sum(axis=1)
            close = apart <= 2 - shorter[a]
            a, b = a[close], b[close]
            for part in range(0, len(a), most):
                x, y = a[part : part + most], b[part : part + most]
                good = one_edit(asked[x], members[y], shorter[x])
                if good.any():
                    yield x[good], y[good]

    work = [(np.arange(len(members)), np.arange(len(asked)), np.where(shorter, SPENT, NONE).astype(np.int16), np.full(len(asked), NONE, np.int16))]
    while work:
        own, at, lowered, raised = work.pop()
        if not len(own) or not len(at):
            continue
        found = split_of(counts[own]) if len(own) > FEW else None
        if found is None:
            for some in range(0, len(at), max(1, PAIRS // len(own))):
                few = at[some : some + max(1, PAIRS // len(own))]
                held.append((np.repeat(few, len(own)), np.tile(own, len(few))))
                total += len(few) * len(own)
                if total >= PAIRS:
                    yield from compared()
                    total = 0
            continue
        letter, count, _ = found
        part = counts[own, letter] <= count
        below, above, down, up = step(wanted[at, letter], letter, count, lowered, raised)
        work.append((own[part], at[below], down[below], raised[below]))
        work.append((own[~part], at[above], lowered[above], up[above]))
    if held:
        yield from compared()


def _asked_counts(asked: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    out = np.zeros((len(asked), LETTERS), np.uint8)
    if (~shorter).any():
        out[~shorter] = letter_counts(asked[~shorter])
    if shorter.any():
        out[shorter] = letter_counts(asked[shorter, :-1])
    return out


def one_edit(asked: np.ndarray, members: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Row by row: whether one letter is replaced, or, where ``shorter``, whether the member has one letter more (``asked`` is padded)."""
    length = members.shape[1]
    differ = asked != members
    replaced = differ.sum(axis=1) == 1
    if not shorter.any():
        return replaced
    ahead, behind = differ[:, :-1], asked[:, :-1] != members[:, 1:]
    head = np.where(ahead.any(axis=1), ahead.argmax(axis=1), length - 1)  # letters before the first that differs
    tail = np.where(behind.any(axis=1), behind[:, ::-1].argmax(axis=1), length - 1)  # letters after the last that differs when moved by one
    return np.where(shorter, head + tail >= length - 1, replaced)


def _best(owner: np.ndarray, other: np.ndarray, n: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each owner the number of others and the other of largest ``n``, the one of least ``rank`` among equals."""
    order = np.lexsort((rank[other], -n[other], owner))
    owner, other = owner[order], other[order]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    return owner[first], np.diff(np.concatenate([first, [len(owner)]])), other[first]


def near_in_cells(rows: DataFrame) -> DataFrame:
    """``word, n_near, best_n, best``: for the words of each cell and each search of it what was found there."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        words = np.array(table.column("word").to_pylist(), object)
        n = table.column("n").to_numpy()
        own, ask = np.flatnonzero(kind == MEMBER), np.flatnonzero(kind != MEMBER)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if len(own) and len(ask):
            shorter = kind[ask] == SHORTER
            asked = letters([w + "a" if s else w for w, s in zip(words[ask], shorter)])
            for x, y in pairs_in_cell(letters(words[own].tolist()), asked, shorter):
                found.append((ask[x], own[y]))
                back = shorter[x]  # a pair of unequal length is found from its shorter word alone
                found.append((own[y][back], ask[x][back]))
        if not found:
            return empty
        owner, other = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
        used = np.unique(other)
        rank = np.zeros(len(words), np.int64)
        rank[sorted(used, key=words.__getitem__)] = np.arange(len(used))
        owner, times, best = _best(owner, other, n, rank)
        return pa.table({"word": pa.array(words[owner], pa.string()), "n_near": pa.array(times, pa.int64()), "best_n": pa.array(n[best], pa.int64()), "best": pa.array(words[best], pa.string())})

    empty = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best_n": pa.array([], pa.int64()), "best": pa.array([], pa.string())})
    return rows.groupBy("length", "cell", "words_part", "asked_part").applyInArrow(run, "word string, n_near long, best_n long, best string")


def _dealt(rows: DataFrame, most_letters: int, most_asked: int) -> DataFrame:
    """Every row with the part of its cell that it goes to; in cells above the bounds every part of the words meets every part of the searches."""
    member = F.col("kind") == MEMBER
    sizes = rows.groupBy("length", "cell").agg(F.sum(member.cast("long")).alias("members"), F.sum((~member).cast("long")).alias("asked"))
    parts = sizes.select(
        "length", "cell", F.ceil(F.col("members") * F.col("length") / most_letters).alias("m"), F.ceil(F.col("asked") * F.col("length") / (16 * most_asked)).alias("a")
    )
    large = parts.where("(m > 1 or a > 1) and m > 0")
    spread = join_bounded(rows, cut(large), ["length", "cell"], "left")
    place = F.pmod(F.xxhash64("word"), F.when(member, F.col("m")).otherwise(F.col("a")))
    others = F.sequence(F.lit(0).cast("long"), F.when(member, F.col("a")).otherwise(F.col("m")) - 1)
    spread = spread.withColumn("place", F.coalesce(place, F.lit(0))).withColumn("other", F.explode(F.coalesce(others, F.array(F.lit(0).cast("long")))))
    return spread.select(
        "length", "cell", F.when(member, F.col("place")).otherwise(F.col("other")).alias("words_part"),
        F.when(member, F.col("other")).otherwise(F.col("place")).alias("asked_part"), "kind", "word", "n",
    )


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for (word, form): the last word on the way from form to form.

    Every form is at least twice as frequent as its word, so ways end and are short; each round doubles the steps taken.
    """
    links = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("at"), F.col("root").alias("next"))
        after = cut(links.join(onward, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop_cut(links)
        if not after.where("moved").limit(1).count():
            return after.select("word", "root")
        links = after.select("word", "root")


def spelling_variants(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, modulus: int = MODULUS, ratio: float = FORM_RATIO,
    sample: int = SAMPLE, cell: int = CELL, most_letters: int = MOST_LETTERS, most_asked: int = MOST_ASKED,
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``docs`` (doc_id, text) that is long and frequent enough.

    Words are near if one inserted, deleted or replaced code point turns one into the other. A word's form is its most frequent near
    word (ties: the smallest in code-point order) if that is at least ``ratio`` times as frequent, its root the end of the way from
    form to form. Null and empty texts have no words, a null id counts as empty text, repeated rows count each, further columns are
    ignored. An empty table gives no rows.
    """
    words = cut(word_counts(docs, least_length, least_count, modulus))
    total = words.count()
    picked = words if total <= sample else words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 40)) < int(sample / total * (1 << 40)))
    trees = learn_trees(picked.select("word").toArrow().column("word").to_pylist(), total, cell)
    rows = cut(searches(words, trees))
    found = near_in_cells(_dealt(rows, most_letters, most_asked))
    nothing = [F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best")]
    both = found.withColumn("n", F.lit(None).cast("long")).unionByName(words.select("word", F.lit(0).cast("long").alias("n_near"), *nothing, "n"))
    best = F.min(F.when(F.col("best_n").isNotNull(), F.struct((-F.col("best_n")).alias("less"), "best"))).alias("b")
    merged = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    has = -F.col("b.less") >= F.col("n") * ratio
    merged = cut(merged.select("word", "n", "n_near", F.when(has, F.col("b.best")).alias("form"), F.when(has, -F.col("b.less")).alias("form_n")))
    drop_cut(rows)
    ends = roots(merged.where("form is not null"))
    return merged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


# The links come from equal rests after one deletion; crc32 is folded over the bytes with its table.
SQL = r"""
WITH RECURSIVE steps AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT] || [0::BIGINT for x in range(8)],
                          lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents
), counted AS (SELECT doc_id, run, COUNT(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY doc_id, run),
hashed AS (
  SELECT run, n, xor(list_reduce([4294967295::BIGINT] || flatten(
      [CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195::BIGINT, ord(c) - 64] END FOR c IN string_split(COALESCE(CAST(doc_id AS VARCHAR), '') || ':' || run, '')]),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM counted, steps
), words AS (
  SELECT word, CAST(SUM(n) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING SUM(n) >= 3
), rests AS (
  SELECT word, n, length(word) AS size, i, substr(word, 1, CAST(i AS INTEGER)) || substr(word, CAST(i AS INTEGER) + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i AND a.size = b.size AND a.word <> b.word
  UNION
  SELECT a.word, b.word, b.n FROM words a JOIN rests b ON a.word = b.rest
  UNION
  SELECT b.word, a.word, a.n FROM words a JOIN rests b ON a.word = b.rest
), best AS (
  SELECT word, COUNT(*) AS n_near, FIRST(other ORDER BY other_n DESC, other) AS other, MAX(other_n) AS other_n FROM near GROUP BY word
), formed AS (
  SELECT w.word, CASE WHEN other_n >= 2 * n THEN other END AS form, n, CAST(COALESCE(n_near, 0) AS BIGINT) AS n_near, CASE WHEN other_n >= 2 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), ways AS (
  SELECT word, word AS root FROM formed
  UNION ALL
  SELECT w.word, f.form FROM ways w JOIN formed f ON w.root = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n
FROM formed f JOIN ways w ON f.word = w.word JOIN formed e ON w.root = e.word AND e.form IS NULL
"""
