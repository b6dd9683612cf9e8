import random

import numpy as np
import pytest

import corpus_pipeline
from orepulse.llm import lines as lines_module
from orepulse.llm.lines import dedup_lines, removed_lines, shared_keys, shingles as shingle_hashes

BOUND = 0.8


def shingles(line, size):
    return {line[i : i + size] for i in range(max(1, len(line) - size + 1))}


def brute(rows, size):
    """Removed line numbers by (doc_id, text), by comparing every pair of lines."""
    places = sorted((d, i, line) for d, text in rows for i, line in enumerate((text or "").split("\n")) if line.strip(" "))
    kinds = sorted({line for _, _, line in places})
    sets, parent = {k: shingles(k, size) for k in kinds}, {k: k for k in kinds}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common >= BOUND * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    seen, gone = set(), {}
    for d, i, line in places:
        if root(line) in seen:
            gone.setdefault(d, []).append(i)
        seen.add(root(line))
    return gone


def corpus(n=60):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randrange(3, 60))) for _ in range(40)]
    rows = []
    for d in range(n):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            line = rng.choice(base)
            if rng.random() < 0.6:
                parts = line.split(" ")
                parts[rng.randrange(len(parts))] = rng.choice(words)
                line = " ".join(parts)
            lines.append(rng.choice([line, line, "", "Of.", line[: len(line) // 2]]))
        rows.append((d, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("size,block", [(12, 256), (4, 256), (4, 3)])
def test_against_every_pair(spark, monkeypatch, size, block):
    monkeypatch.setattr(lines_module, "BLOCK", block)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.removed for r in removed_lines(docs, size=size).collect() if r.removed}
    expected = brute(rows, size)
    assert sum(map(len, expected.values())) > 50
    assert found == expected
    texts = {r.doc_id: r.text for r in dedup_lines(docs, size=size).collect()}
    for d, text in rows:
        assert texts[d] == "\n".join(x for i, x in enumerate(text.split("\n")) if i not in expected.get(d, []))


def test_edges(spark):
    long = "x" * 30_000 + "yz"
    rows = [(1, None, "k"), (2, "", "k"), (3, "a\n\na", "k"), (3, "a\n\na", "k"), (None, "a\nb", "k"), (5, long, "k"), (6, long + "\n" + long + "!", "k"), (7, "é😀漢" * 9, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string")
    out = sorted(((r.doc_id, r.text, r.removed) for r in dedup_lines(docs).collect()), key=str)
    assert out == sorted([(1, None, "k"), (2, "", "k"), (3, "", "k"), (3, "", "k"), (None, "a\nb", "k"), (5, long, "k"), (6, long + "!", "k"), (7, "é😀漢" * 9, "k")], key=str)
    assert dedup_lines(docs.limit(0)).count() == 0


def test_small_sets_at_the_bound_are_found(spark):
    """4 of 5 shingles alike: the bands lose about 2 in 1000 such pairs, and nothing else may lose more."""
    rng = random.Random(6)
    rows = []
    for d in range(3000):
        line = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(8))
        rows.append((d, line[:7] + "\n" + line))
    found = removed_lines(spark.createDataFrame(rows, "doc_id long, text string"), size=4).where("cardinality(removed) = 1").count()
    assert found >= 2973


def test_one_edit_in_lines_of_usual_length(spark):
    """The pipeline's stage takes lines for alike that differ in one character from 40 characters on, or in one six-letter word from 90 on."""
    rng, rows = random.Random(12), []
    for size in range(40, 121, 10):
        for _ in range(10):
            line = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(size))
            at = rng.randrange(10, size - 16)
            rows.append((len(rows), line + "\n" + line[:at] + "#" + line[at + 1 :], 1))
            if size >= 90:
                rows.append((len(rows), line[::-1] + "\n" + line[::-1][:at] + "ABCDEF" + line[::-1][at + 6 :], 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    left = [r for r in corpus_pipeline.cut_lines(spark, docs, "").collect() if "\n" in r.text]
    assert len(left) <= 2


def test_shingle_hashes():
    texts = ["a", "ab", "abcd", "abcde", "xabcd", "éé漢😀", "b" * 5000, "abcd"]
    sets = [set(x.tolist()) for x in shingle_hashes(texts, 4)]
    for x, p in zip(texts, sets):
        for y, q in zip(texts, sets):
            assert len(p & q) == len(shingles(x, 4) & shingles(y, 4)), (x, y)
    assert [len(x) for x in sets[:4]] == [1, 1, 1, 2]


def test_shared_keys_of_hot_and_rare_bands(spark, monkeypatch):
    monkeypatch.setattr(lines_module, "PART_KEYS", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "40")
    rng, rows, want = np.random.default_rng(3), [], {}
    for i in range(300):
        keys = np.concatenate([[10**9 if i % 3 else 10**9 + i + 1], rng.choice(5000, lines_module.BANDS - 1, replace=False)]).astype(np.uint64)  # one key of two thirds
        rows.append((i, keys.tobytes()))
        for k in keys.tolist():
            want.setdefault(k, set()).add(i)
    signed = spark.createDataFrame(rows, "id long, bands binary").repartition(3)
    got = {}
    for r in shared_keys(signed, 300).collect():
        got.setdefault(r.key, []).append(r.id)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if len(v) > 1}
    assert len(got[10**9]) == 200


def test_columns_with_the_names_used_inside(spark):
    names = ["_id", "_row", "_removed", "_copy", "_times", "_whole", "h1", "pos", "line", "id"]
    docs = spark.createDataFrame([(1, "same line\nother", *[f"{n}1" for n in names]), (2, "same line", *[f"{n}2" for n in names])], f"doc_id long, text string, {', '.join(f'{n} string' for n in names)}")
    out = {r.doc_id: r for r in dedup_lines(docs).collect()}
    assert out[1].text == "same line\nother" and out[2].text == ""
    assert all(out[i][n] == f"{n}{i}" for i in (1, 2) for n in names) and dedup_lines(docs).columns == docs.columns


def test_blocks_are_compared_many_at_a_time(spark, monkeypatch):
    """Several blocks in one call give the links of each block on its own, and the classes do not depend on how blocks are dealt."""
    import pandas as pd

    rng, rows = random.Random(8), []
    for key in range(40):
        base = "".join(rng.choice("abcdefgh ") for _ in range(80))
        for n in range(rng.randrange(1, 7)):
            rows.append((key, n % 2, 0, rng.random() < 0.5, len(rows), rng.randrange(3), rng.choice([base, base[:-1] + "#", base[::-1], "x"])))
    group = pd.DataFrame(rows, columns=["key", "i", "j", "left", "id", "component", "line"]).sample(frac=1, random_state=1)
    want = []
    for _, block in group.groupby(["key", "i", "j"]):
        sides = [block[block["left"]], block[~block["left"]]]
        want += lines_module.links_across(*sides, BOUND, 4) if all(map(len, sides)) else []
    found = lines_module.links_of_blocks(group, BOUND, 4)
    assert sorted(found) == sorted(want) and len(want) > 10
    assert lines_module.links_of_blocks(group.iloc[:0], BOUND, 4) == []
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    expected = brute(corpus(), 4)
    for size in (1, 4000):
        monkeypatch.setattr(lines_module, "PART_LINES", size)
        assert {r.doc_id: r.removed for r in removed_lines(docs, size=4).collect() if r.removed} == expected


def test_line_classes_need_no_python_workers(spark, monkeypatch):
    """DataFrame functions alone give the classes of all pairs, as the way on Arrow batches does."""
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    by_arrow = {tuple(r)[:2]: tuple(r.keeper) for r in lines_module.line_classes(docs, size=4, native=False).collect()}

    def refused(*_, **__):
        raise AssertionError("Python workers")

    for kind, names in ((type(docs), ["mapInArrow", "mapInPandas"]), (type(docs.groupBy("doc_id")), ["applyInArrow", "applyInPandas"])):
        for name in names:
            monkeypatch.setattr(kind, name, refused)
    assert {tuple(r)[:2]: tuple(r.keeper) for r in lines_module.line_classes(docs, size=4).collect()} == by_arrow and by_arrow
    assert {r.doc_id: r.removed for r in removed_lines(docs, size=4).collect() if r.removed} == brute(corpus(), 4)


def test_pairs_at_the_bound_share_a_key(spark):
    """Sets of shingles that all differ, of sizes around every change of the keys; the pairs lose at most 1.5 %, the smallest nothing."""
    rng, rows, kinds = random.Random(15), [], [(4, 5), (5, 6), (9, 9), (8, 10), (10, 12), (13, 13), (14, 15), (16, 18), (36, 36), (80, 100), (144, 144), (238, 242), (300, 370)]
    for k, (m, n) in enumerate(kinds):
        for i in range(200):
            line = [chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n)]
            other = line[:m] if m < n else [*(chr(0xE000 + j) for j in range(n // 9)), *line[n // 9 :]]
            rows += [(2 * len(rows), "".join(line), k, i), (2 * len(rows) + 1, "".join(other), k, i)]
    lines = spark.createDataFrame(rows, "id long, line string, kind int, i int")
    keys = lines.join(lines_module.line_keys(lines, BOUND, 1), "id").groupBy("kind", "i", "key").count().where("count = 2")
    found = {r.kind: r["count"] for r in keys.select("kind", "i").distinct().groupBy("kind").count().collect()}
    assert all(found[k] >= 197 for k in range(len(kinds))) and all(found[k] == 200 for k in (0, 1, 2))


def test_sketches_differ_in_no_more_bits_than_sets(spark):
    rng = random.Random(2)
    base = ["".join(rng.choice("abcd ") for _ in range(n)) for n in (3, 20, 80, 400, 3000) for _ in range(4)]
    texts = [*base, *(x[: len(x) // 2] + "#" + x[len(x) // 2 + 1 :] for x in base)]
    drawn = lines_module.sketches(spark.createDataFrame(list(enumerate(texts)), "id long, line string"), 4).collect()
    seen = {r.id: r for r in drawn}
    mask = (1 << 64) - 1
    for i, x in enumerate(texts):
        assert seen[i]["size"] == len(shingles(x, 4))
        for j, y in enumerate(texts):
            bits = sum(((seen[i][f"s{w}"] ^ seen[j][f"s{w}"]) & mask).bit_count() for w in range(lines_module.WIDTH))
            assert bits <= len(shingles(x, 4) ^ shingles(y, 4))
