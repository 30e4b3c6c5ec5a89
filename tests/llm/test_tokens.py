"""Token ids against a second library and exact round trips."""

import random

import pytest

from graphweft.llm import tokens

pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.read_ranks())


@pytest.fixture(scope="module")
def other():
    t = pytest.importorskip("tokenizers").Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


TEXTS = ["", "a", " ", "Hello  world\n\n", "<|endoftext|> is text", "don't we'll I'VE", "日本語 テキスト 🙂👩‍👩‍👧", "a" * 5000, "\t\t x\r\n y", " " * 4000 + "ab", "ab" + " \n" * 3000 + "cd", "x " + "\t" * 3000, "x " * 1500, "�\x00\x1c\x1d z", "é" * 700, "12 345,678.90" * 400]


def test_ids_agree_with_another_library(enc, other):
    for t in TEXTS:
        assert tokens.encode_text(enc, t) == other.encode(t, add_special_tokens=False).ids, t[:20]


def test_parts_do_not_change_ids(enc, other):
    rng = random.Random(1)
    alphabet = ["word", " ", "  ", "\n", ".", "12", "é", "🙂", " a", "'s", "\t", "x y z "]
    for _ in range(60):
        t = "".join(rng.choice(alphabet) for _ in range(400))
        want = other.encode(t, add_special_tokens=False).ids
        assert all(tokens.encode_text(enc, t, size) == want for size in (1, 7, 50, 100_000))
        assert "".join(tokens.parts(t, 20)) == t


def test_round_trip(enc):
    for t in TEXTS:
        assert tokens.decode_ids(enc, tokens.encode_text(enc, t)) == t


def test_very_long_texts(enc):
    for t in ("ab cd " * 400_000, " " * 1_000_000 + "a", "a" * 500_000):
        assert tokens.decode_ids(enc, tokens.encode_text(enc, t)) == t


def test_frames(spark):
    df = spark.createDataFrame([(1, "a b", "old"), (2, "", "old"), (3, None, "old"), (4, "é🙂", None)], "doc_id long, text string, ids string")
    got = tokens.encode(df)
    assert dict(got.dtypes) == {"doc_id": "bigint", "ids": "array<int>"}
    rows = {r.doc_id: list(r.ids) for r in got.collect()}
    assert rows[2] == rows[3] == [] and rows[1] == [64, 275]
    back = {r.doc_id: r.text for r in tokens.decode(got).collect()}
    assert back == {1: "a b", 2: "", 3: "", 4: "é🙂"}
    assert tokens.encode(df.limit(0)).count() == 0
    assert "Exchange" not in got._jdf.queryExecution().toString()
