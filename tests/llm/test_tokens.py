import random

import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from orepulse.llm.tokens import Counter, count_tokens, read_vocabulary


@pytest.fixture(scope="module")
def vocabulary():
    return read_vocabulary()


@pytest.fixture(scope="module")
def exact(vocabulary):
    worst = min(s for _, s in vocabulary)
    extra = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    tokenizer = Tokenizer(models.Unigram(extra + [(p, max(s, worst)) for p, s in vocabulary], 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return tokenizer


def test_same_counts_as_the_tokenizer(spark, small, vocabulary, exact):
    counter = Counter(vocabulary)
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]
    texts += ["", " ", "  a", "a  b ", "\n", "▁", "漢字かな", "😀 x😀y", "naïve\tcafé\n\nline", "x" * 5000, "\u0000\u0001", "ab" * 3000]
    rng = random.Random(3)
    texts += ["".join(rng.choice("abcé 😀\n.,thein▁") for _ in range(rng.randrange(40))) for _ in range(500)]
    for text in texts:
        assert counter.text(text) == len(exact.encode(text, add_special_tokens=False).ids), text[:80]


def test_ties_keep_the_path_whose_last_piece_starts_first():
    scores = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("c", -1.0), ("ab", -2.0), ("bc", -2.0), ("abc", -3.0)]
    tokenizer = Tokenizer(models.Unigram([("<unk>", -50.0), *scores], 0, False))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter = Counter(scores)
    for word in ("abc", "ab", "bc", "abcabc", "cab", "bca"):
        assert counter.text(word) == len(tokenizer.encode(word).ids)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 5), (2, "", 5), (2, "a b", 6), (None, "a b", 7)], "doc_id long, text string, n_tokens int")
    rows = sorted((r.doc_id or -1, r.n_tokens) for r in count_tokens(docs).collect())
    assert rows[0][0] == -1 and rows[1:3] == [(1, 0), (2, 0)] and rows[3][1] == rows[0][1] == 2
    assert count_tokens(docs.limit(0)).count() == 0


def test_runs_of_spaces_as_in_an_unsplit_tokenizer(spark, vocabulary):
    worst = min(s for _, s in vocabulary)
    extra = [("<unk>", 0.0)] + [(f"<0x{b:02X}>", 0.0) for b in range(256)]
    tokenizer = Tokenizer(models.Unigram(extra + [(p, max(s, worst)) for p, s in vocabulary], 0, True))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    counter = Counter(vocabulary, whole_runs=True)
    assert counter.text("a" + " " * 8 + "b") == 3 and counter.text("x" + " " * 40 + "y") == 5
    rng = random.Random(9)
    texts = [" " * n for n in range(1, 40)] + ["    if x:\n        return y\n", "a  b   c    d", "   lead", "tail   ", "| a      | b  |"]
    texts += ["".join(rng.choice(["a", "the", " ", "   ", "\n", " " * rng.randrange(1, 30), "▁", "é"]) for _ in range(rng.randrange(30))) for _ in range(500)]
    for text in texts:
        assert counter.text(text) == len(tokenizer.encode(text, add_special_tokens=False).ids), text
    docs = spark.createDataFrame([(1, "a" + " " * 8 + "b"), (2, "x" + " " * 40 + "y")], "doc_id long, text string")
    assert [r.n_tokens for r in count_tokens(docs).orderBy("doc_id").collect()] == [3, 5]


def test_pieces_over_the_border_of_a_unit():
    scores = [("▁", -1.0), ("a", -1.0), ("b", -1.0), ("a▁b", -1.5)]
    assert Counter(scores, whole_runs=True).text("a b") == 2
