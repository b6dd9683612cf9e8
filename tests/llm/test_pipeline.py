import random

import pytest

import corpus_pipeline
from orepulse.llm.decontamination import contaminated
from orepulse.llm.mixing import mix
from tests.llm.test_decontamination import brute as leaks
from orepulse.llm.lines import SHORT_SHINGLE
from tests.llm.test_lines import brute as repeated
from tests.llm.test_order_minhash import labelled, similar


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghijklmn") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, some(30)) for i in range(4)]
    rows = []
    for d in range(120):
        text = "\n".join(some(rng.randrange(8, 25)) for _ in range(rng.randrange(1, 6)))
        if d % 5 == 1:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif d % 11 == 2:
            text += "\n" + some(5) + " " + items[d % 4][1]
        elif d % 7 == 3 and rows:
            words = rows[-1][1].replace("\n", " ").split() + some(20).split()
            text = " ".join(words)
        elif d % 13 == 4:
            text += "\nthe same line of every such document again"
        rows.append((d, text, "en", f"s{d % 4 if d % 3 else 0}", len(text), "kept"))
    rows += [(200, None, None, None, None, "kept"), (201, "", "en", "s1", 0, "kept"), (5, rows[5][1], "en", "s1", 1, "kept")]
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(d, int(d % 5 != 1), 0) for d in range(0, 120, 1) if d % 3], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    columns = docs.columns
    good = stages["quality"](spark, docs, folder).cache()
    assert good.columns == columns
    assert {r.doc_id for r in good.collect()} == {d for d in range(120) if d % 5 != 1}  # empty texts have none of a good text's features and go too
    short = stages["lines"](spark, good, folder).cache()
    assert short.columns == columns
    gone = repeated([(r.doc_id, r.text) for r in good.where("doc_id <> 5").collect()], SHORT_SHINGLE)
    before = {r.doc_id: r.text for r in good.collect()}
    for r in short.where("doc_id <> 5").collect():
        assert r.text == (None if before[r.doc_id] is None else "\n".join(x for i, x in enumerate(before[r.doc_id].split("\n")) if i not in gone.get(r.doc_id, [])))
        assert r.n_chars == len(r.text or "")
    one = stages["near copies"](spark, short, folder).cache()
    texts = {r.doc_id: r.text for r in short.where("text is not null").collect()}
    dropped = set(texts) - {r.doc_id for r in one.collect()}
    for d in sorted(texts):
        twins = [e for e in texts if e < d and (texts[e] == texts[d] or labelled(texts[e]) and labelled(texts[d]) and similar(labelled(texts[e]), labelled(texts[d])))]
        assert (d in dropped) == bool(twins)
    clean = stages["benchmark"](spark, one, folder).cache()
    found = {d for d, _ in leaks([(r.doc_id, r.text) for r in one.collect()], items)}
    assert found and {r.doc_id for r in clean.collect()} == {r.doc_id for r in one.collect()} - found
    mixed = stages["mix"](spark, clean, folder)
    assert sorted(map(tuple, mixed.collect()), key=str) == sorted(map(tuple, mix(clean).where("taken > 0").collect()), key=str)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) == sorted(map(tuple, mixed.collect()), key=str)


def test_mix_meets_the_budgets(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = mix(docs).collect()
    sizes = {}
    for r in rows:
        assert r.size == len((next(iter([d.text for d in docs.where(f"doc_id = {r.doc_id}").take(1)])) or "").split()) if r.doc_id in (0, 200, 201) else True
        assert 0 <= r.taken <= 2 * r.size
        sizes.setdefault(r.source, [0, 0, r.target, r.source_size])
        sizes[r.source][0] += r.taken
        sizes[r.source][1] += r.size
    assert all(abs(taken - target) <= 0.5 and size == whole for taken, size, target, whole in sizes.values())
    assert abs(sum(v[2] for v in sizes.values()) - 1.5 * sum(v[3] for v in sizes.values())) < 1e-6
    assert None in sizes and mix(docs.limit(0)).count() == 0


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name
    assert contaminated(docs, spark.read.parquet(f"{folder}/benchmark.parquet")).count() == 0
