import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from orepulse.llm import spelling
from orepulse.llm.spelling import cells_in_reach, learn_trees, letter_counts, letters, spelling_variants


def words_in(docs, modulus=97):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % modulus == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, modulus=97):
    words = words_in(docs, modulus)
    form, n_near = {}, {}
    for a in words:
        others = [b for b in words if near(a, b)]
        n_near[a] = len(others)
        best = min(others, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best and words[best] >= 2 * words[a] else None
    out = []
    for a in words:
        root = a
        while form[root]:
            root = form[root]
        out.append((a, form[a], root, words[a], n_near[a], words[form[a]] if form[a] else None))
    return sorted(out)


def noisy(rng, bases, letters_, n):
    """Words near to some bases, near to each other, and their anagrams."""
    out = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            at, kind = rng.randrange(len(w) + 1), rng.randrange(4)
            if kind == 0:
                w.insert(at, rng.choice(letters_))
            elif kind == 1 and at < len(w):
                w[at] = rng.choice(letters_)
            elif kind == 2 and at < len(w):
                del w[at]
            else:
                rng.shuffle(w)
        out.append("".join(w))
    return out


@pytest.mark.parametrize("cell,most_letters,most_asked,sample", [(4096, 1 << 16, 1 << 17, 200_000), (6, 1 << 16, 1 << 17, 200_000), (40, 60, 5, 150), (1 << 30, 90, 9, 0)])
def test_against_all_pairs(spark, cell, most_letters, most_asked, sample):
    rng = random.Random(cell)
    bases = ["quarry", "haulage", "conveyor", "Ärgernis", "éléphant", "aaaaaa", "ababab", "crusher", "drills", "blasting"]
    words = noisy(rng, bases, "abelrsÉéäÿ×", 12000)
    docs = [(i, " ".join(words[i * 30 : i * 30 + 30]) + rng.choice([".", "-", "_", "1", " ", "漢"])) for i in range(400)]
    found = spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), modulus=7, cell=cell, most_letters=most_letters, most_asked=most_asked, sample=sample)
    got = sorted(map(tuple, found.collect()))
    want = brute(docs, 7)
    assert got == want and len(want) > 200 and any(r[2] != (r[1] or r[0]) for r in want)


def test_every_cell_with_a_near_word_is_searched():
    rng = random.Random(2)
    words = sorted(set(w for w in noisy(rng, ["conveyor", "overconf", "nocevroy", "éléphant"], "abcé", 3000) if len(w) in (7, 8, 9)))
    trees = learn_trees(words, 20 * len(words), 100)
    assert all(len(trees[n]) > 50 for n in (7, 8, 9))
    cell_of, reached = {}, {}
    for w in words:
        v = letter_counts(letters([w]))
        cell_of[w] = cells_in_reach(trees[len(w)], v, False, False)[1].tolist()
        reached[w] = {0: set(cells_in_reach(trees[len(w)], v, True, True)[1].tolist()), 1: set(cells_in_reach(trees[len(w) + 1], v, False, True)[1].tolist()) if len(w) < 9 else set()}
    assert all(len(c) == 1 for c in cell_of.values())
    for a in words:
        for b in words:
            if len(b) - len(a) in (0, 1) and near(a, b):
                assert cell_of[b][0] in reached[a][len(b) - len(a)], (a, b)
    n_cells = sum(1 for node in trees[8] if node[0] < 0)
    assert np.mean([len(r[0]) for w, r in reached.items() if len(w) == 8]) < n_cells / 3  # boxes out of reach are pruned


def test_edges(spark):
    long = "z" * 3000 + "y"
    rows = [(1, "Hauler hauler HAULER haulers haulers haulers"), (1, "Hauler hauler HAULER"), (1, "Hauler hauler HAULER"), (None, "hauler"), (2, None), (3, ""),
            (4, f"{long} {long} {long} z{long} z{long} z{long} " + "abcde " * 100_000), (5, "four four four"), (6, "É" * 5 + " ééééé ÉÉÉÉÉ ÉÉÉÉÉ ééééé ééééé")]
    docs = spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, word string, n int")
    assert sorted(map(tuple, spelling_variants(docs).collect())) == brute(rows)
    assert spelling_variants(docs.limit(0)).count() == 0
    assert spelling_variants(docs.where("doc_id = 5")).count() == 0


def test_a_full_memory_passes_its_counts_on(spark, small, monkeypatch):
    monkeypatch.setattr(spelling, "MOST_REMEMBERED", 50)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    got = {r.word: r.n for r in spelling.word_counts(docs).collect()}
    assert got == words_in(map(tuple, docs.collect()))
