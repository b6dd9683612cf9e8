import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from orepulse.llm import lexical
from orepulse.llm.lexical import Block, search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, k=10):
    """item_id, rank, doc_id, score by scoring every document."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scored.append((d, score))
        scored.sort(key=lambda x: (-x[1], x[0] is None, x[0]))
        out += [(item, rank + 1, d, s) for rank, (d, s) in enumerate(scored[:k])]
    return out


def key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("postings,docs_,most", [(2_000_000, 1 << 17, 500_000), (300, 1 << 17, 500_000), (10**9, 7, 40)])
def test_against_scoring_every_document(spark, monkeypatch, postings, docs_, most):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(lexical, "BLOCK_DOCS", docs_)
    monkeypatch.setattr(lexical, "MOST_QUERY_TERMS", most)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    rng = random.Random(11)
    words = [f"w{i}" for i in range(60)] + ["Ärger", "ÉCOLE", "école", "漢字", "A1", "a1", "the"]
    weights = [1 / (i + 1) for i in range(len(words))]

    def text(n):
        return " ".join(rng.choices(words, weights, k=n)) + rng.choice(["", ".", ", The_end", "\u0000x", " W3-w4"])

    docs = [(i, text(rng.randrange(0, 60))) for i in range(400)] + [(1000 + i, "w9 w50 w51 the") for i in range(40)] + [(7, None), (8, ""), (9, " ... ")]
    items = [(i, text(rng.randrange(1, 12))) for i in range(25)] + [(90, None), (91, ""), (92, "nowhere"), (93, "w51 w51 W51"), (94, "the"), (95, "w50 w51")]
    found = search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_terms=most)
    assert sorted(map(tuple, found.collect())) == sorted(brute(docs, items))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_later_terms_create_no_accumulators():
    """A term that cannot lift a new document to the k-th best score only adds to the accumulators that are there."""
    n = np.full(1000, 10)
    owner = np.concatenate([np.arange(20), np.arange(1000)])
    words = np.array([0] * 20 + [1] * 1000)
    block = Block(n, owner, words, np.ones(1020, np.int64), np.array([5000, 3]), 1000, 10_000)
    made = []
    block.live = type("Marks", (np.ndarray,), {"__setitem__": lambda self, k, v: (made.append(len(k)) if v else None, np.ndarray.__setitem__(self, k, v))[1]})((1000,), bool)
    block.live[:] = False
    found, scores = block.best(np.array([0, 1]), 10, 0)
    assert sum(made) == 20 and len(found) == 20 and (scores == block.gain[0] + block.gain[20]).all()
    found, _ = block.best(np.array([1]), 10, int(scores[0]) + 1)
    assert not len(found) and not block.scores.any()


def test_edges(spark):
    docs = [(None, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (1, "gamma " * 50_000), (2, None), (4, "delta")]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, rank int, query string")
    items = [(1, "Alpha"), (1, "gamma"), (None, "beta"), (2, None), (3, "alpha")]
    asked = spark.createDataFrame([(*i, 5) for i in items], "item_id long, text string, score int")
    found = [tuple(r) for r in search(frame, asked).collect()]
    assert sorted(found, key=key) == sorted(brute(docs, items), key=key)
    assert search(frame.limit(0), asked).count() == 0 and search(frame, asked.limit(0)).count() == 0
    named = search(frame.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text"), asked, k=1)
    assert {(r.item_id, r.doc_id) for r in named.collect()} == {(1, "3"), (1, "1"), (None, "3"), (3, "3")}
