import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geoloom.llm import encoding as E

BPE = E.load(E.vocabulary_file())
SCHEMA = "doc_id bigint, text string, ids string"


@pytest.fixture(scope="module")
def other():
    tiktoken = pytest.importorskip("tiktoken")
    with open(E.vocabulary_file(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "\n\n\t x  ", "<|endoftext|>", "don't we'll", "a" * 20_000, "ab" * 3000 + "zq" * 2000, "é😊日本語" * 200, "\u0000�​", "x" * 100 + " " * 1000]


@pytest.mark.parametrize("text", ODD)
def test_odd_texts(other, text):
    ids = BPE.encode(text)
    assert ids == other.encode_ordinary(text) and BPE.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text(text):
    tiktoken = pytest.importorskip("tiktoken")
    with open(E.vocabulary_file(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)} if not hasattr(test_any_text, "enc") else None
    if ranks:
        test_any_text.enc = tiktoken.Encoding("own", pat_str=E.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert BPE.encode(text) == test_any_text.enc.encode_ordinary(text) and BPE.decode(BPE.encode(text)) == text


def test_frames(spark):
    texts = [None, "", "hello world", "hello world", *ODD]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r["ids"] for r in E.encode(df, "doc_id", "text").collect()}
    assert got == {i: BPE.encode(t) for i, t in enumerate(texts)} and got[0] == got[1] == []
    back = {r["doc_id"]: r["text"] for r in E.decode(E.encode(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["size"] for r in E.token_counts(df, "doc_id", "text").collect()} == {i: len(v) for i, v in got.items()}
    assert E.encode(df.limit(0), "doc_id", "text").count() == 0


def test_a_full_table_starts_anew(monkeypatch):
    monkeypatch.setattr(E, "TABLE", 3)
    b = E.ByteBPE(E.vocabulary_file())
    assert b.encode("one two three four five one two") == BPE.encode("one two three four five one two") and len(b.table) <= 3
