import random

import numpy as np

from orepulse.llm.order_minhash import aligned, drop_near_documents, near_documents, shingle_sequences


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def similar(a, b):
    common = lcs(a, b)
    return common >= 0.8 * (len(a) + len(b) - common)


def labelled(text):
    words, seen, out = (text or "").lower().split(), {}, []
    for i in range(max(1, len(words) - 4) if words else 0):
        s = tuple(words[i : i + 5])
        out.append((s, seen.setdefault(s, 0)))
        seen[s] += 1
    return out


def test_alignment_is_exact():
    rng = np.random.default_rng(3)
    for _ in range(400):
        a = rng.integers(1, 12 if rng.random() < 0.3 else 10_000, rng.integers(1, 90)).astype(np.uint32)
        b = list(a)
        for _ in range(rng.integers(0, 14)):
            at = rng.integers(0, len(b) + 1)
            if rng.random() < 0.5:
                b[at:at] = [int(v) for v in rng.integers(20_000, 30_000, rng.integers(1, 4))]
            elif len(b) > 3:
                del b[at : at + 2]
        a, b = np.unique(a, return_index=True), b
        a = a[0][np.argsort(a[1])]
        b = np.array(list(dict.fromkeys(b)), np.uint32)
        assert aligned(a, b) == similar(a.tolist(), b.tolist())


def test_shingles_are_told_apart():
    texts = ["a b c d e f", "a b", "", None, "a a a a a a a", "A b C d e f"]
    found = shingle_sequences(texts)
    assert [len(s) for s in found] == [2, 1, 0, 0, 3, 2] and len(set(found[4].tolist())) == 3 and (found[0] == found[5]).all()


def test_against_every_pair(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    base = [some(rng.choice([2, 4, 6, 30, 90, 200])) for _ in range(14)]
    rows = []
    for d in range(150):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 5, 9])):
            at = rng.randrange(len(words) + 1)
            words[at : at + rng.randrange(2)] = some(rng.randrange(2))
        if rng.random() < 0.1:
            words = words[len(words) // 2 :] + words[: len(words) // 2]
        rows.append((d, " ".join(words)))
    texts = [labelled(t) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] == rows[j][1] or texts[i] and texts[j] and similar(texts[i], texts[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.class_id, r.kept) for r in near_documents(docs).collect()}
    assert found == {d: (c, d == c) for d, c in enumerate(label)}
    assert len(set(label)) < 120
    assert {r.doc_id for r in drop_near_documents(docs).collect()} == set(label)


def test_edges(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [(1, None), (2, None), (3, ""), (4, ""), (5, long), (6, long + " end"), (7, "same"), (7, "same"), (None, "Same"), (None, "alone"), (8, " \n")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, kept string")
    out = sorted(((r.doc_id or 0, r.text and r.text[:5], r.class_id, r.kept) for r in near_documents(docs).collect()), key=str)
    expected = [(1, None, 1, True), (2, None, 2, True), (3, "", 3, True), (4, "", 3, False), (5, "w0 w1", 5, True), (6, "w0 w1", 5, False)]
    expected += [(7, "same", 7, True), (7, "same", 7, False), (0, "Same", 7, False), (0, "alone", None, True), (8, " \n", 8, True)]
    assert out == sorted(expected, key=str)
    assert drop_near_documents(docs).columns == docs.columns and drop_near_documents(docs).count() == 7
    assert near_documents(docs.limit(0)).count() == 0


def test_short_texts_with_a_word_more_are_found(spark):
    """Pairs of 8 and 9, 9 and 10, 12 and 14 words: 4 and 5, 5 and 6, 8 and 10 shingles."""
    rows = []
    for n, more in ((8, 1), (9, 1), (12, 2)):
        for i in range(200):
            words = [f"w{n}x{i}y{j}" for j in range(n + more)]
            rows += [(len(rows), " ".join(words[more * (i % 2) :][:n])), (len(rows) + 1, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in near_documents(docs).collect()}
    assert found == {d: d - d % 2 for d, _ in rows}
