"""Language-model scores from a probabilistic suffix tree.

A text is its words, lower-cased A to Z, each spelled in UTF-8 and closed by a space, and an end mark; the symbols of the tree are
these bytes, so every text has a probability. Counts of all byte sequences of the tree's depth are gathered from the training
documents; every shorter context is a sum of them. A context is kept if its next symbols differ from those of its parent (the context
without its oldest byte) by more than the divergence test asks; the distribution of a kept context is smoothed with its parent's. The
state of a position is its longest kept context.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orepulse.llm.common import cut, remainder

DEPTH = 5  # bytes of context, at most; a context and its next symbol must fit into 63 bits
LEAST_GAIN = 12.0  # divergence in nats, times occurrences, that a kept context needs
MOST_GRAMS = 1 << 20  # pairs that the tasks hold, the whole model or the most frequent sequences; all others are looked up by a join
MOST_WORDS = 200_000  # frequent words whose counts the tasks hold; all others are looked up by a join
HELD_OUT, FOLDS = 2, 7
END_WORD = b"\n"  # fixed value: the end token, which no word equals
CHUNK = 1 << 21  # bytes of text that are counted or scored at a time

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; ``bytes.split`` parts at exactly the blanks of the token rule."""
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


def spelled(words: list[bytes]) -> bytes:
    """Each word and a space, then the end mark."""
    return b" ".join(words) + b" \n" if words else b"\n"


def grams(texts: list[bytes], depth: int) -> np.ndarray:
    """At every byte of the spelled texts: the ``depth`` bytes before it in its text (zeros before the start) and the byte itself."""
    start = b"\0" * depth
    data = np.frombuffer(start + start.join(texts), np.uint8)
    real = np.ones(len(data), bool)
    ends = np.cumsum([depth + len(t) for t in texts])
    for back in range(1, depth + 1):
        real[np.concatenate([[0], ends[:-1]]) + back - 1] = False
    out = data.astype(np.int64)
    for back in range(1, depth + 1):
        out[depth:] |= data[depth - back : len(data) - back].astype(np.int64) << (8 * back)
    return out[real]


def _chunks(texts, size: int = CHUNK):
    """Lists of (row number, words, spelled text) of a bounded number of bytes; one text is never split."""
    held, total = [], 0
    for row, text in enumerate(texts):
        words = words_of(text)
        held.append((row, words, spelled(words)))
        total += len(held[-1][2])
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def count_grams(docs: DataFrame, depth: int = DEPTH, held_out: Column | None = None) -> DataFrame:
    """``gram, n, held``: counts of the full-depth byte sequences of all texts, and in the texts for which ``held_out`` is true.

    Counts are summed per chunk before the shuffle; texts held out are in chunks of their own.
    """

    def run(batches):
        for batch in batches:
            apart = batch["held_out"].to_numpy(bool)
            for own in (False, True):
                for held in _chunks(batch["text"][apart == own]):
                    values, n = np.unique(grams([d for _, _, d in held], depth), return_counts=True)
                    for at in range(0, len(values), 500_000):
                        some = n[at : at + 500_000]
                        yield pd.DataFrame({"gram": values[at : at + 500_000], "n": some, "held": some * own})

    apart = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    counted = docs.select("text", apart.alias("held_out")).mapInPandas(run, "gram long, n long, held long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("held").alias("held"))


def tree(full: DataFrame, depth: int = DEPTH, least_gain: float = LEAST_GAIN) -> DataFrame:
    """``gram, level, p``: smoothed probabilities of the next symbol in every kept context, level 0 being the empty context.

    The smoothing of Witten and Bell: ``(n + kinds * parent) / (total + kinds)``. Every context that passes the test is kept, and every
    suffix of it, so that the probabilities of a state's 256 next bytes sum to 1.
    """
    level = full.select("gram", "n")
    levels = {depth: level}
    for d in range(depth - 1, -1, -1):
        level = cut(level.groupBy(F.col("gram").bitwiseAND((1 << (8 * (d + 1))) - 1).alias("gram")).agg(F.sum("n").alias("n")))
        levels[d] = level
    kept, parent = [], None
    for d in range(depth + 1):
        context = F.shiftright("gram", 8)
        rows = levels[d].withColumn("context", context)
        totals = rows.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        rows = rows.join(totals, "context")
        if parent is None:
            smooth = rows.withColumn("q", F.lit(1 / 256.0))
        else:
            shorter = parent.select(F.col("gram").alias("short"), F.col("p").alias("q"))
            smooth = rows.withColumn("short", F.col("gram").bitwiseAND((1 << (8 * d)) - 1)).join(shorter, "short")
        smooth = smooth.withColumn("p", (F.col("n") + F.col("kinds") * F.col("q")) / (F.col("total") + F.col("kinds")))
        smooth = cut(smooth.select("gram", "context", "n", "total", "kinds", "q", "p"))
        divergence = F.sum(F.col("n") * F.log((F.col("n") / F.col("total")) / F.col("q"))).alias("gain")
        gains = smooth.groupBy("context").agg(divergence)
        kept.append(gains.where((F.col("gain") >= least_gain) | F.lit(d == 0)).select("context"))
        parent = smooth
        levels[d] = smooth
    closed = cut(kept[depth])  # with a context all its shorter forms are kept, so that what it leaves over goes to its own parent
    kept[depth] = closed
    for d in range(depth - 1, -1, -1):
        parents = closed.select(F.col("context").bitwiseAND((1 << (8 * d)) - 1).alias("context"))
        closed = kept[d] = cut(kept[d].unionByName(parents).distinct())
    out = None
    for d in range(depth + 1):
        here = levels[d].join(kept[d], "context").select(
            "gram", F.lit(d).alias("level"), "p", (F.col("kinds") / (F.col("total") + F.col("kinds"))).alias("back")
        )
        out = here if out is None else out.unionByName(here)
    return out


def sequence_values(full: DataFrame, model: DataFrame, depth: int) -> DataFrame:
    """``gram, value``: log10 probability of the last byte of every full-depth sequence of ``full``, by joins with the model.

    Level by level over the distinct shorter sequences, so that a key has at most 256 rows.
    """
    shorts = {depth: full.select("gram")}
    for d in range(depth - 1, -1, -1):
        shorts[d] = shorts[d + 1].select(F.col("gram").bitwiseAND((1 << (8 * (d + 1))) - 1).alias("gram")).distinct()
    values = None
    for d in range(depth + 1):
        pairs = model.where(F.col("level") == d)
        contexts = pairs.groupBy(F.shiftright("gram", 8).alias("context")).agg(F.first("back").alias("back"))
        rows = shorts[d].withColumn("context", F.shiftright("gram", 8)).join(pairs.select("gram", "p"), "gram", "left").join(contexts, "context", "left")
        if values is None:
            rows = rows.withColumn("q", F.lit(1 / 256.0))
        else:
            shorter = values.select(F.col("gram").alias("short"), "q")
            rows = rows.withColumn("short", F.col("gram").bitwiseAND((1 << (8 * d)) - 1)).join(shorter, "short")
        chance = F.when(F.col("back").isNull(), F.col("q")).otherwise(F.coalesce("p", F.col("back") * F.col("q")))
        values = cut(rows.select("gram", chance.alias("q")))
    return values.select("gram", F.log10("q").alias("value"))


class Scorer:
    """Log10 probabilities of the kept states, looked up by (context, symbol)."""

    def __init__(self, levels: list[tuple[np.ndarray, ...]], depth: int):
        self.levels, self.depth = levels, depth

    @staticmethod
    def level(gram: np.ndarray, p: np.ndarray, back: np.ndarray) -> tuple[np.ndarray, ...]:
        """Sorted pairs with their probabilities, and sorted contexts with the weight of their parent."""
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        context, first = np.unique(gram >> 8, return_index=True)
        return gram, p[order], context, back[order][first]

    def log10(self, values: np.ndarray) -> np.ndarray:
        """For distinct full-depth sequences: the smoothed probability of the last byte in the longest kept context."""
        out = np.full(len(values), 1 / 256.0)
        for d, (gram, p, context, back) in enumerate(self.levels):
            if not len(gram):
                continue
            short = values & ((1 << (8 * (d + 1))) - 1)
            at = np.minimum(np.searchsorted(context, short >> 8), len(context) - 1)
            known = context[at] == short >> 8
            place = np.minimum(np.searchsorted(gram, short), len(gram) - 1)
            seen = gram[place] == short
            out = np.where(known, np.where(seen, p[place], back[at] * out), out)
        return np.log10(out)

    def texts(self, held: list[bytes]) -> tuple[np.ndarray, list[list[int]], list[list[int]]]:
        """The score of each text without the sequences whose value is not held here; these, and how often each occurs."""
        where, values = pd.factorize(grams(held, self.depth))
        logs = self.log10(values)
        unknown = np.isnan(logs)
        sizes = [len(d) for d in held]
        sums = np.add.reduceat(np.where(unknown, 0.0, logs)[where], np.cumsum([0] + sizes[:-1]))
        rare: list[list[int]] = [[] for _ in held]
        times: list[list[int]] = [[] for _ in held]
        if unknown.any():
            places = np.flatnonzero(unknown[where])
            owner = np.repeat(np.arange(len(held)), sizes)[places]
            pairs, n = np.unique(owner * len(values) + where[places], return_counts=True)
            owners, grams_ = np.divmod(pairs, len(values))
            for text in np.unique(owners):
                some = slice(*np.searchsorted(owners, [text, text + 1]))
                rare[text], times[text] = values[grams_[some]].tolist(), n[some].tolist()
        return sums, rare, times


class Cache(Scorer):
    """The values of the most frequent full-depth sequences."""

    def __init__(self, gram: np.ndarray, value: np.ndarray, depth: int):
        order = np.argsort(gram, kind="stable")
        self.gram, self.value, self.depth = gram[order], value[order], depth

    def log10(self, values: np.ndarray) -> np.ndarray:
        if not len(self.gram):
            return np.full(len(values), np.nan)
        at = np.minimum(np.searchsorted(self.gram, values), len(self.gram) - 1)
        return np.where(self.gram[at] == values, self.value[at], np.nan)


def score_texts(
    docs: DataFrame, depth: int = DEPTH, least_gain: float = LEAST_GAIN, most_grams: int = MOST_GRAMS, most_words: int = MOST_WORDS,
    held_out: int = HELD_OUT, folds: int = FOLDS,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for every row of ``docs``.

    Documents whose crc32 remainder is not ``held_out`` are learned from. Tokens are words and one end per text; a null text is empty.
    ``base_score`` is the add-one unigram log10 probability; ``score`` that of the suffix tree. Rows that share an id are scored each
    by its own text. Without training documents the tree is uniform over bytes and the base knows no word.
    """
    spark = docs.sparkSession
    own = F.monotonically_increasing_id()
    held = remainder(F.col("doc_id"), folds) == held_out
    kind = docs.schema["doc_id"].dataType
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), held.alias("held_out"), "text")  # pandas would round large ids
    training = rows.where(~F.col("held_out"))
    vocabulary = cut(_word_counts(training))
    totals = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    frequent = vocabulary.orderBy(F.desc("c"), "word").limit(most_words).toArrow()
    logs = np.log10((frequent["c"].to_numpy() + 1) / (n + v + 1)).tolist()
    known_words = spark.sparkContext.broadcast(dict(zip(frequent["word"].to_pylist(), logs)))
    counted = cut(count_grams(rows, depth, F.col("held_out")))  # of all texts, as a large model is looked up for the sequences of all texts
    learned = counted.select("gram", (F.col("n") - F.col("held")).alias("n")).where("n > 0")
    model = cut(tree(learned, depth, least_gain))
    values = None
    if model.count() <= most_grams:
        held_model = model.toArrow().to_pandas()
        columns = (("gram", np.int64), ("p", np.float64), ("back", np.float64))
        arrays = [Scorer.level(*(held_model.loc[held_model["level"] == d, c].to_numpy(t) for c, t in columns)) for d in range(depth + 1)]
    else:  # the same probabilities, worked out for the distinct sequences of all texts; the frequent ones are sent to the tasks
        sequences = counted.select("gram", "n")
        values = cut(sequences.join(sequence_values(sequences, model, depth), "gram"))
        frequent = values.orderBy(F.desc("n"), "gram").limit(most_grams).toArrow()
        arrays = frequent["gram"].to_numpy(), frequent["value"].to_numpy()
    shipped = spark.sparkContext.broadcast(arrays)  # plain arrays: workers need not be able to import this package
    make = Scorer if values is None else lambda held, d: Cache(*held, d)

    def run(batches):
        scorer, logs = make(shipped.value, depth), known_words.value
        for batch in batches:
            for part in _chunks(batch["text"].to_numpy()):
                frame = batch[["row", "doc_id", "held_out"]].iloc[[r for r, _, _ in part]]
                base, tokens, known, rare = [], [], [], []
                for _, words, _ in part:
                    words.append(END_WORD)
                    found = list(map(logs.get, words))
                    tokens.append(len(found))
                    missing: dict[bytes, int] = {}
                    if None in found:
                        for word, value in zip(words, found):
                            if value is None:
                                missing[word] = missing.get(word, 0) + 1
                        found = [x for x in found if x is not None]
                    known.append(len(found))
                    base.append(sum(found))
                    rare.append(missing)
                score, grams_, gram_times = scorer.texts([d for _, _, d in part])
                yield frame.assign(
                    n_tokens=tokens, n_known=known, base_score=base, score=score, grams=grams_, gram_times=gram_times,
                    words=[list(x) for x in rare], times=[list(x.values()) for x in rare],
                )

    schema = "row long, doc_id string, held_out boolean, n_tokens long, n_known long, base_score double, score double, grams array<long>, gram_times array<long>, words array<binary>, times array<long>"
    scored = cut(rows.select(own.alias("row"), "doc_id", "held_out", "text").mapInPandas(run, schema))
    parts = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
    looked = parts.join(vocabulary, F.col("words") == F.col("word"), "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10((F.coalesce("c", F.lit(0)) + 1) / F.lit(float(n + v + 1)))).alias("added"),
    )
    scored = scored.join(looked, "row", "left")
    score = F.col("score")
    if values is not None:
        missing = scored.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("g")).select("row", "g.grams", "g.gram_times")
        found = missing.join(values, F.col("grams") == F.col("gram")).groupBy("row").agg(F.sum(F.col("gram_times") * F.col("value")).alias("rest"))
        scored, score = scored.join(found, "row", "left"), F.col("score") + F.coalesce("rest", F.lit(0.0))
    return scored.select(
        F.col("doc_id").cast(kind).alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("added", F.lit(0.0))).alias("base_score"), score.alias("score"),
    )


def _word_counts(training: DataFrame) -> DataFrame:
    """``word, c``: occurrences of every token in the training texts, summed per bounded piece before the shuffle."""

    def run(batches):
        counts: dict[str, int] = {}

        def out():
            frame = pd.DataFrame({"word": list(counts), "c": list(counts.values())})
            for at in range(0, len(frame), 100_000):
                yield frame.iloc[at : at + 100_000]

        for batch in batches:
            for text in batch["text"]:
                for word in words_of(text):
                    counts[word] = counts.get(word, 0) + 1
                counts[END_WORD] = counts.get(END_WORD, 0) + 1
                if len(counts) > 400_000:
                    yield from out()
                    counts.clear()
        yield from out()

    return training.select("text").mapInPandas(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))
