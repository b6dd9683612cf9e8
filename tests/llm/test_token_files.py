import glob
import random
import zlib

import numpy as np
import pyarrow.orc
import pytest
from tokenizers import Tokenizer

from orepulse.llm import token_files
from orepulse.llm.token_files import Encoder, TOKENIZER, digests, find_documents, read_tokens, token_range, write_tokens


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(TOKENIZER)


def expected(rows, exact):
    """doc_id, start, n_tokens, ids of rows that are in file order."""
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*exact.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), ids))
        start += len(ids)
    return out


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_units_give_the_ids_of_whole_texts(exact):
    encoder = Encoder(open(TOKENIZER, encoding="utf-8").read())
    texts = ["", " ", "\n\t ", "It's  we'll\tthey'd\n'S", "<|endoftext|>x <|startoftext|>", "é e ́x", "İstanbul ΑΣ ΑΣ.", "漢字 かな", "a b c\x1cd\re",
             "x" * 500 + " y", "😀😀 1234.5", "\u0000 ﻿", "ﬁ Å ẛ̣", "한 ㅎㅏ"]
    rng = random.Random(5)
    pieces = ["a", "The", "'s", "'", " ", "  ", "\n", "\t", "\r", "́", "İ", "ñ", "é", "9", ".", "<|endoftext|>", " ", "Ä", "漢", "😀", "x" * 120]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(2000)]
    for some in (texts[:40], texts[40:], texts):
        got = encoder.texts(some)
        for text, data in zip(some, got):
            assert np.frombuffer(data, "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids, repr(text)


def test_pieces_end_with_their_last_token(exact):
    """New pieces need no places in the text; where the ends do not fit the pieces, places decide."""
    encoder = Encoder(open(TOKENIZER, encoding="utf-8").read())
    bare = encoder.bare

    class Fast:
        def encode_batch_fast(self, *args, **options):
            return bare.encode_batch_fast(*args, **options)

    text = "Don't STOP, \x00 éÀ 12 ~~ " + " ".join(chr(c) for c in range(0x21, 0x180)) + " " + "q" * 90
    encoder.bare = Fast()
    ids = np.frombuffer(encoder.texts([text.replace("\u0130", "")])[0], "<u4").tolist()
    assert ids == exact.encode(text.replace("\u0130", ""), add_special_tokens=False).ids
    for last in (np.zeros_like(encoder.last), np.ones_like(encoder.last), None):
        again = Encoder(open(TOKENIZER, encoding="utf-8").read())
        again.last = last
        assert np.frombuffer(again.texts([text])[0], "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids


def test_a_full_memory_starts_afresh(exact, monkeypatch):
    monkeypatch.setattr(token_files, "MAX_REMEMBERED", 3)
    monkeypatch.setattr(token_files, "MAX_TEXT", 64)
    encoder = Encoder(open(TOKENIZER, encoding="utf-8").read())
    for text in ["one two three four five six seven", "five six", "one " * 50 + "z" * 300]:
        assert np.frombuffer(encoder.texts([text])[0], "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids


def test_documents_come_back_from_the_files(spark, small, exact, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    write_tokens(docs, str(tmp_path / "a"))
    want = expected(sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()), exact)
    got = sorted(map(tuple, read_tokens(spark, str(tmp_path / "a")).collect()))
    assert got == want
    sums = sorted(map(tuple, digests(read_tokens(spark, str(tmp_path / "a"))).collect()))
    assert sums == [(d, s, n, crc(ids)) for d, s, n, ids in want]
    whole = [i for *_, ids in want for i in ids]
    for start, stop in ((0, 5), (3, 4), (len(whole) // 3, len(whole) // 2), (len(whole) - 7, len(whole) + 50), (9, 9)):
        parts = sorted(map(tuple, token_range(spark, str(tmp_path / "a"), start, stop).collect()), key=lambda r: r[1])
        assert [i for _, _, ids in parts for i in ids] == whole[start:stop]
        assert all(whole[at : at + len(ids)] == ids for _, at, ids in parts)


def test_edges(spark, exact, tmp_path):
    long = " ".join(f"word{i}" for i in range(30_000)) + "z" * 20_000
    rows = [(5, "b"), (5, "b"), (5, "a"), (None, "n"), (1, None), (2, ""), (9007199254740993, long), (-3, "  ")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, part int, ids string")
    write_tokens(docs, str(tmp_path / "a"))
    got = sorted(read_tokens(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -3, 1, 2, 5, 5, 5, 9007199254740993]
    start = 0
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids) and r.ids[-1] == 1
        start += r.n_tokens
    assert [r.ids for r in got if r.doc_id in (1, 2, -3)] == [[1]] * 3
    assert sorted(r.ids for r in got if r.doc_id == 5) == sorted([*exact.encode(t, add_special_tokens=False).ids, 1] for t in "bba")
    assert got[-1].ids == [*exact.encode(long, add_special_tokens=False).ids, 1]
    write_tokens(docs.limit(0), str(tmp_path / "none"))
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0 and digests(read_tokens(spark, str(tmp_path / "none"))).count() == 0
    keyed = docs.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text")
    write_tokens(keyed, str(tmp_path / "text"))
    assert digests(read_tokens(spark, str(tmp_path / "text"))).count() == len(rows)


def _scanned(frame):
    """Rows that the scan of the ids gave to the query; the frame must have run."""
    found = []

    def walk(node):
        name = node.nodeName()
        if name.startswith("AdaptiveSparkPlan"):
            return walk(node.executedPlan())
        if hasattr(node, "plan") and "QueryStage" in name:
            return walk(node.plan())
        if name.startswith("Scan orc") and "ids" in node.schema().fieldNames():
            found.append(node.metrics().apply("numOutputRows").value())
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(frame._jdf.queryExecution().executedPlan())
    return sum(found)


def test_metadata_prunes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "STRIPE_BYTES", 64 << 10)
    docs = spark.range(40_000).selectExpr("id * 2 AS doc_id", "concat_ws(' ', id, md5(cast(id AS STRING)), sha(cast(id AS STRING))) AS text")
    write_tokens(docs, str(tmp_path / "a"))
    files = glob.glob(f"{tmp_path}/a/ids/*.orc")
    assert len(files) > 1 and max(pyarrow.orc.ORCFile(f).nstripes for f in files) > 1
    found = find_documents(spark, str(tmp_path / "a"), [31_000])
    assert [r.doc_id for r in found.collect()] == [31_000] and 0 < _scanned(found) <= 2 * token_files.ROW_GROUP
    absent = find_documents(spark, str(tmp_path / "a"), [31_001])
    assert absent.collect() == [] and _scanned(absent) == 0  # within the bounds of a row group, so only the Bloom filter can tell
    some = token_range(spark, str(tmp_path / "a"), 100, 140)
    assert some.collect() and _scanned(some) < 40_000
