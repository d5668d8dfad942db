"""The transducer against the library of the vocabulary, and decoding."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerspark.llm import tokens as T

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def merges():
    return T.Merges(T.vocabulary_file())


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


PARTS = ["a", "aa", "'", "s", "re", "'ll", " ", "  ", "\n", "1", "22", "é", "漢字", "!!", "...", "\t", "the", "ing", "​", "<|endoftext|>", "😀", "ab" * 30, " ", "\x00", "\x1f"]


def test_random_texts(merges, reference):
    rng, enc = random.Random(1), T.Encoder(merges)
    for _ in range(3000):
        s = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14)))
        assert list(enc.ids(s)) == reference(s), repr(s)


def test_any_chunking(merges, reference, monkeypatch):
    rng, enc = random.Random(2), T.Encoder(merges)
    for _ in range(1500):
        s = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40)))
        monkeypatch.setattr(T, "CHUNK", rng.randint(1, 9))
        monkeypatch.setattr(T, "HOLD", rng.choice([3, 8, 1000]))
        assert list(enc.ids(s)) == reference(s), repr(s)


@pytest.mark.parametrize("s", ["a" * 5000, " " * 5000 + "x", "x" + "\n" * 3000, "ab" * 4000 + "  z", "漢字仮名" * 1500, "!" * 4000, " " + "1" * 3000, " \n" * 2500 + "q"])
def test_long_runs_in_constant_memory(merges, reference, s):
    enc = T.Encoder(merges)
    assert list(enc.ids(s)) == reference(s)
    t = T.Transducer(merges)
    most = 0
    for i in range(0, len(s), 50):
        t.push(s[i : i + 50].encode())
        most = max(most, len(t.buf))
    assert most < 12 * merges.lookahead


def test_every_prefix_is_stable(merges, reference):
    rng = random.Random(3)
    s = "".join(rng.choice("abcdeh") for _ in range(2000))
    t, out = T.Transducer(merges), []
    for c in s:
        out += t.push(c.encode())
    assert out == reference(s)[: len(out)] and len(out) > 500


def test_decoder(merges):
    enc = T.Encoder(merges)
    for s in ("héllo wörld 漢字 😀 <|endoftext|>\n\t", "", "﻿x"):
        d, out = T.Decoder(merges.text), ""
        for i in enc.ids(s):
            out += d.push([i])
        assert out + d.finish() == s
    for raw in (b"\xff\xfea", b"\xe6\xbc", b"\xf0\x9f\x98a", b"\xc3\xc3\xa9", b"\xed\xa0\x80", b"\xf4\x90\x80\x80"):
        d = T.Decoder([raw])
        assert d.push([0]) + d.finish() == raw.decode("utf-8", "replace")


def test_encode_and_decode_tables(spark, reference):
    texts = [(1, "Hello world"), (2, ""), (3, None), (4, "  "), (4, "  "), (None, "x"), (5, "long " * 30_000)]
    df = spark.createDataFrame(texts, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("ids", F.lit(1))
    out = T.encode(df)
    assert sorted(((r.doc_id, r.ids) for r in out.collect()), key=repr) == sorted(((i, reference(t) if t else []) for i, t in texts), key=repr)
    back = T.decode(out)
    assert sorted(((r.doc_id, r.text) for r in back.collect()), key=repr) == sorted(((i, t or "") for i, t in texts), key=repr)
    assert T.encode(df.limit(0)).count() == 0
