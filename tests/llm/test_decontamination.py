import random
import re
from collections import Counter

from orepulse.llm.decontamination import BLOCKS, RADIUS, clean, contaminated


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def weights(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(docs, items):
    out = {}
    for d, text in docs:
        words = split(text)
        for i, item in items:
            target = split(item)
            if not target or not words:
                continue
            k, size = min(5, len(target)), len(target)
            b = weights(target, k)
            for at in range(max(1, len(words) - size + 1)):
                a = weights(words[at : at + size], k)
                common = sum((a & b).values())
                value = common / (a.total() + b.total() - common)
                if value >= 0.8:
                    out[d, i] = max(value, out.get((d, i), 0))
    return out


def test_against_every_window(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 6))) for _ in range(80)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([1, 3, 5, 8, 20, 30, 45])))) for i in range(25)] + [(90, ""), (91, None), (92, "Long " + " ".join(some(60)))]
    docs = []
    for d in range(80):
        words = some(rng.randrange(1, 120))
        if d % 2:
            passage = (rng.choice(items)[1] or "").split()
            for _ in range(rng.randrange(3)):
                if passage:
                    passage[rng.randrange(len(passage))] = rng.choice(vocabulary)
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + "," for w in passage] if d % 3 else passage
        docs.append((d, "\n".join([" ".join(words)])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in contaminated(frame, bench).collect()}
    expected = brute(docs, items)
    assert len(expected) > 30
    assert found == expected
    assert {r.doc_id for r in clean(frame, bench).collect()} == {d for d, _ in docs} - {d for d, _ in expected}


def test_blocks_cover_the_radius():
    assert BLOCKS == RADIUS + 1


def test_edges(spark):
    bench = spark.createDataFrame([(1, "one two three four five six"), (1, "other words that are here now"), (None, "x y")], "item_id long, text string")
    rows = [(1, None), (2, ""), (3, "ONE, two; three four\nfive six!"), (3, "one"), (None, "a x y b"), (4, "w " * 30_000 + "one two three four five six")]
    docs = spark.createDataFrame([(*r, "k", 1.0) for r in rows], "doc_id long, text string, item_id string, similarity double")
    out = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert out == {(3, 1), (None, None), (4, 1)}
    assert clean(docs, bench).count() == 2 and clean(docs, bench).columns == docs.columns
    assert contaminated(docs.limit(0), bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0 and clean(docs, bench.limit(0)).count() == 6
