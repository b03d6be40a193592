"""Encoding and decoding against the tokenizers library: the tables' texts, all code points, random and long texts."""

import hashlib
import random

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewatch.llm import bpe, queries

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "s", "re", " ", "  ", "\n", "\t", " ", "　", "\x85", "\x1c", "a", "Z", "é", "1", "٣", "!", "<|endoftext|>", "<|", "|>", "中", "🙂", "the", " of", "aaaa", "_"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    with open(PATH, "rb") as f:
        return bpe.Vocabulary(f.read())


def agree(own, library, texts):
    raw = [t.encode() for t in texts]
    ids, at = own.encode(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    data, off = own.decode(ids.astype("<u4"), at)
    for k, one in enumerate(library.encode_batch(texts, add_special_tokens=False)):
        assert ids[at[k] : at[k + 1]].tolist() == one.ids, texts[k][:80]
        assert data[off[k] : off[k + 1]].tobytes().decode() == library.decode(one.ids, skip_special_tokens=False)


def test_all_code_points(own, library):
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(every), 50000):
        agree(own, library, [f"a{c}a1 {c}1  {c}" for c in every[i : i + 50000]])


def test_random_and_long(own, library):
    rng = random.Random(3)
    agree(own, library, ["".join(rng.choices(BITS, k=rng.randint(0, 25))) for _ in range(20000)])
    agree(own, library, ["a" * 5000, "ab" * 3000, "\n" * 3000, " " * 70, "=-" * 999, "aAbB" * 777, "x" * bpe.SHORT + "y", "", " ", "é" * 500])


def test_ways_of_merging_agree(own):
    rng = random.Random(4)
    words = ["".join(rng.choices("aeioustrn'eé", k=rng.randint(1, 40))).encode() for _ in range(3000)] + [b"a" * 33, b"abab" * 9]
    off = np.cumsum([0, *map(len, words)])
    ids, word = own.merge_all(np.frombuffer(b"".join(words), np.uint8), off)
    assert [ids[word == k].tolist() for k in range(len(words))] == [own.merge(w) for w in words]


def test_check_of_pairs(own):
    """Two tokens side by side pass the check if and only if merging their bytes gives them back."""
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, 50256, (2, 4000))
    common = np.array([own.merge(w)[0] for w in (b"e", b"s", b" the", b"in", b"er", b"a")])
    a, b = np.append(a, common.repeat(6)), np.append(b, np.tile(common, 6))
    spell = lambda i: own.data[own.off[i] : own.off[i + 1]].tobytes()
    expected = [own.merge(spell(x) + spell(y)) != [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert own.crossed(a, b).tolist() == expected and 0 < sum(expected) < len(expected)


def test_few_words_are_merged(own):
    text = b" the cat sat on the mat and the dog looked at it with great interest during the afternoon"
    starts = [i for i, c in enumerate(text) if c == 32]
    assert own.words(np.frombuffer(text, np.uint8), np.array([*starts, len(text)]))[2] == 0


def test_pieces():
    data = np.frombuffer(b"abc def ghi  jkl\nmno" * 50, np.uint8)
    cut = list(bpe.pieces(data, 64))
    assert cut[0][0] == 0 and cut[-1][1] == len(data) and all(x[1] == y[0] and data[y[0]] == 32 and data[y[0] - 1] > 32 for x, y in zip(cut, cut[1:], strict=False)) and len(cut) > 5
    assert list(bpe.pieces(np.full(500, 97, np.uint8), 64)) == [(0, 500)]


def test_query(spark, library):
    found = {r.doc_id: r for r in queries.queries()["op12_bpe"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(found) == len(docs)
    for r in docs:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        got = found[r.doc_id]
        assert got.n_tokens == len(ids) and got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_edge_rows(spark, library, monkeypatch):
    monkeypatch.setattr(bpe.pieces, "__defaults__", (2000,))
    long = " ".join(f"word{i}'s ²{i}" for i in range(3000)) + "<|endoftext|> x"
    texts = [None, "", " ", long, "same text", "same text", "<|endoftext|>", "\n\n a\n"]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("ids", "n_tokens", "decoded", "sig")})
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs.repartition(8), PATH).withColumn("ids_too", F.col("ids")), PATH).collect()}
    for i, t in enumerate(texts):
        r = got[i if i else None]
        assert r.decoded == (t or "") and np.frombuffer(r.ids_too, "<u4").tolist() == library.encode(t or "", add_special_tokens=False).ids
    assert bpe.round_trip(docs.where("false"), PATH).count() == 0
    broken = spark.createDataFrame([(None,), (bytearray(np.array([60000, 72, 50256], "<u4").tobytes()),), (bytearray(np.array([94], "<u4").tobytes()),)], "ids binary")
    assert sorted(r.decoded for r in bpe.decode(broken, PATH).collect()) == sorted(["", "i<|endoftext|>", library.decode([94])])


def test_other_tokenizers_are_refused(spark):
    with pytest.raises(ValueError):
        bpe.encode(spark.createDataFrame([(1, "a")], "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"))
