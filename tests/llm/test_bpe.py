import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ostinato.llm import bpe, tokens

tokenizers = pytest.importorskip("tokenizers")
SIGNS = ["'", "s", "t", "re", "ve", "ll", "d", "m", " ", "  ", "\n", "\t", "\xa0", "　", "a", "Z", "é", "1", "23", "½", "!", "--", "日本", "😀", "\x1c", "\x00", "<|endoftext|>", "​", "\x85", "aaaa", "S", "\r\n"]


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def ours(texts, encoder=None):
    e = encoder or bpe.Encoder()
    return pa.concat_arrays([e.ids(w) for w in e.words(pa.array(texts, pa.string()))]).to_pylist()


def test_as_the_library_on_random_texts(library):
    rng = random.Random(7)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    assert ours(texts) == library(texts)


def test_null_empty_long_and_repeated(library, monkeypatch):
    long = "a" * 100_000 + " " + "ab" * 50_000 + " " * 5000 + "x"
    texts = ["", long, " ", "same", "same", "\n\n"]
    assert ours(texts) == library(texts)
    assert ours([None, "x", None]) == [[], library(["x"])[0], []]
    monkeypatch.setattr(bpe, "CHUNK", 10)
    assert ours(texts) == library(texts)


def test_colliding_hashes_change_nothing(library, monkeypatch):
    texts = ["one two three four one", "five six seven", "two one"]
    monkeypatch.setattr(bpe, "_mix", lambda: bpe.np.zeros(0x110000, dtype=bpe.np.uint64))
    assert ours(texts) == library(texts)


def test_forgetting_words_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bpe, "MOST_WORDS", 2)
    e = bpe.Encoder()
    for texts in (["one two three"], ["two four"], ["one two three"]):
        assert ours(texts, e) == library(texts)


def test_operator(spark, library):
    rows = [(1, "It's a barrel.", 5, "k"), (1, "It's a barrel.", 5, "k"), (2, None, 0, "k"), (None, "", 0, "k"), (3, "日本語 text", 1, "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int, key string")
    got = [(r["doc_id"], list(r["ids"])) for r in tokens.token_ids(df).collect()]
    assert sorted(got, key=str) == sorted([(r[0], library([r[1] or ""])[0]) for r in rows], key=str)
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.token_counts(df.filter(F.col("doc_id") > 1)).collect()}
    assert counts == {2: 0, 3: len(library(["日本語 text"])[0])}
    assert tokens.token_ids(df.limit(0)).count() == 0
