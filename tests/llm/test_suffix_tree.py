import math
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from orepulse.llm.suffix_tree import Scorer, count_grams, score_texts, spelled, tree, words_of

DEPTH, GAIN = 3, 2.0


def contexts(data):
    """(context of each length, symbol) at every byte of one spelled text; zeros stand before its start."""
    padded = b"\0" * DEPTH + data
    for at in range(DEPTH, len(padded)):
        yield [padded[at - d : at] for d in range(DEPTH + 1)], padded[at]


def brute(rows):
    held = lambda d: zlib.crc32(str("" if d is None else d).encode()) % 7 == 2
    counts, words = [{} for _ in range(DEPTH + 1)], Counter()
    for d, text in rows:
        if not held(d):
            words.update([*words_of(text), b"\n"])
            for found, symbol in contexts(spelled(words_of(text))):
                for level, context in enumerate(found):
                    counts[level].setdefault(context, Counter())[symbol] += 1
    smooth = [{} for _ in counts]
    kept = [set() for _ in counts]
    for level in range(DEPTH + 1):
        for context, seen in counts[level].items():
            total, kinds, gain = seen.total(), len(seen), 0.0
            for symbol, n in seen.items():
                parent = 1 / 256 if level == 0 else smooth[level - 1][context[1:], symbol]
                smooth[level][context, symbol] = (n + kinds * parent) / (total + kinds)
                gain += n * math.log(n / total / parent)
            if level == 0 or gain >= GAIN:
                kept[level].add(context)
    for level in range(DEPTH, 0, -1):
        kept[level - 1] |= {context[1:] for context in kept[level]}
    n, v = words.total(), len(words)

    def chance(found, symbol, level):
        if level < 0:
            return 1 / 256
        if found[level] not in kept[level]:
            return chance(found, symbol, level - 1)
        if (found[level], symbol) in smooth[level]:
            return smooth[level][found[level], symbol]
        seen = counts[level][found[level]]
        return len(seen) / (seen.total() + len(seen)) * chance(found, symbol, level - 1)

    out = []
    for d, text in rows:
        tokens = [*words_of(text), b"\n"]
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in tokens)
        score = sum(math.log10(chance(f, s, DEPTH)) for f, s in contexts(spelled(words_of(text))))
        out.append((str(d), held(d), len(tokens), sum(words[w] > 0 for w in tokens), n, base, score))
    return out


def test_against_brute_force(spark, small):
    rows = [(r.doc_id, (r.text or "")[:700]) for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()]
    rows += [(900, None), (901, ""), (901, "The THE the"), (None, "ÀÉ é x\ty"), (902, "a " * 3000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    found = [tuple(r) for r in score_texts(docs, DEPTH, GAIN, most_words=20).collect()]
    order = lambda r: (str(r[0]), r[2], r[-1])
    for a, b in zip(sorted(found, key=order), sorted(brute(rows), key=order), strict=True):
        assert (str(a[0]), *a[1:5]) == b[:5]
        assert np.allclose(a[5:], b[5:], rtol=1e-9)


def test_a_model_above_the_bound_scores_the_same(spark, small):
    rows = [(r.doc_id, (r.text or "")[:300]) for r in spark.read.parquet(f"{small}/documents.parquet").limit(30).collect()] + [(900, None), (902, "a " * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    expected = sorted(brute(rows))
    for bound in (1, 200):
        found = sorted((str(r[0]), *r[1:]) for r in score_texts(docs, DEPTH, GAIN, most_grams=bound, most_words=20).collect())
        assert [r[:5] for r in found] == [r[:5] for r in expected]
        assert np.allclose([r[5:] for r in found], [r[5:] for r in expected], rtol=1e-9)


def test_no_training_rows(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string").limit(0)
    assert score_texts(docs).count() == 0


def test_every_state_is_a_distribution(spark, small):
    """The kept contexts are closed under suffixes, and the probabilities of the 256 next bytes sum to 1 in each of them."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("text")
    model = tree(count_grams(docs, DEPTH), DEPTH, GAIN).toPandas()
    states = [set((model.loc[model["level"] == d, "gram"].to_numpy(np.int64) >> 8).tolist()) for d in range(DEPTH + 1)]
    for d in range(1, DEPTH + 1):
        assert len(states[d]) > 10 and {c & ((1 << (8 * (d - 1))) - 1) for c in states[d]} <= states[d - 1]
    columns = (("gram", np.int64), ("p", np.float64), ("back", np.float64))
    scorer = Scorer([Scorer.level(*(model.loc[model["level"] == d, c].to_numpy(t) for c, t in columns)) for d in range(DEPTH + 1)], DEPTH)
    some = [c for d in range(DEPTH + 1) for c in sorted(states[d])[:: max(1, len(states[d]) // 60)]]
    for context in some:
        assert math.isclose((10 ** scorer.log10((context << 8) + np.arange(256))).sum(), 1.0, rel_tol=1e-9), context


def test_texts_are_counted_once(spark, monkeypatch):
    """One count serves the model and, if that is too large to send, the sequences of all texts; held-out texts are not learned from."""
    from orepulse.llm import suffix_tree

    rows = [(i, f"alpha beta{i % 7} gamma{'' if i % 5 else ' delta'}") for i in range(120)] + [(500, None), (501, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    calls, count = [], suffix_tree.count_grams
    monkeypatch.setattr(suffix_tree, "count_grams", lambda *args: calls.append(1) or count(*args))
    scored = {most: {r.doc_id: r for r in score_texts(docs, most_grams=most).collect()} for most in (1 << 20, 10)}
    assert len(calls) == 2
    for i, r in scored[10].items():
        assert abs(r.score - scored[1 << 20][i].score) < 1e-9
    learned = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2)
    split = count(docs, 5, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    want = {r.gram: r.n for r in count(learned, 5).collect()}
    assert {r.gram: r.n - r.held for r in split.collect() if r.n > r.held} == want
