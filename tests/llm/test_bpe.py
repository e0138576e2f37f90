import base64

import pytest
import tiktoken
from hypothesis import given, settings, strategies as st

from redline.llm import bpe

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def words():
    return bpe.Vocabulary.read(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = [None, "", "a" * 5000, "é" * 40 + "\x1c\x85 x", "  \n\n hi \t", "日本語 1234५६", "don't we'll 'S", "\U0001f468‍\U0001f469", "<|endoftext|>", "ß ö", " " * 900 + "x", "same", "same"]


def test_round_trip_and_library(spark, words, library):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in bpe.encode_decode(df, words).collect()}
    for i, t in enumerate(ODD):
        assert list(got[i]["ids"]) == library.encode_ordinary(t or "")
        assert bytes(got[i]["decoded"]) == (t or "").encode()
    apart = bpe.decode(bpe.encode(df, words), words).collect()
    assert {r["doc_id"]: bytes(r["decoded"]) for r in apart} == {i: bytes(r["decoded"]) for i, r in got.items()}
    assert bpe.encode(df.where("false"), words).count() == 0
    clash = df.selectExpr("doc_id", "text", "7 as ids")
    assert bpe.encode(clash, words).columns == ["doc_id", "text", "ids"]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_pieces_as_library(words, library, text):
    import regex

    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = [i for p in regex.findall(P.PATTERN, text) for i in words.encode_piece(p.encode())]
    assert ids == library.encode_ordinary(text)


def test_perfect_hash(words):
    assert sorted(words.ids) == list(range(len(words.ids))) and None not in words.keys
    assert all(words.rank(k) == i for k, i in zip(words.keys, words.ids, strict=True))
    assert words.rank(b"\xff\xfe no such token") == -1
