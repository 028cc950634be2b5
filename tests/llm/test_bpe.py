import base64
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from idsync.llm import bpe

pytestmark = pytest.mark.skipif(not Path(bpe.VOCABULARY).exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bpe.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


ODD = ["", " ", "a", "\x1c \x1d a\x85b c　d ᠎ x", "<|endoftext|> hi", "a" * 50_000, " " * 3000 + "x", "É́", "👩‍👩‍👧 ٣٤५ Ⅷ ²", "\x00\x0b\r\n\r\n", "it's we'll I'D", "日本語のテキスト", "x\n\n\n  y"]


def ids(enc, texts):
    flat, offsets = enc.encode_batch(texts)
    return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def test_odd_texts(reference):
    enc = bpe.encoder(bpe.VOCABULARY)
    assert ids(enc, [*ODD, None]) == [*map(reference.encode_ordinary, ODD), []]
    assert enc.count_batch([*ODD, None]) == [len(x) for x in ids(enc, [*ODD, None])]


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(reference, text):
    assert ids(bpe.encoder(bpe.VOCABULARY), [text]) == [reference.encode_ordinary(text)]
    assert reference.decode(ids(bpe.encoder(bpe.VOCABULARY), [text])[0]) == text


def test_perfect_hash_is_minimal():
    enc = bpe.encoder(bpe.VOCABULARY)
    keys = list(enc.ranks)
    assert sorted(enc.hash(bpe.hash_bytes(keys)).tolist()) == list(range(len(keys)))


def test_memory_starts_anew(monkeypatch, reference):
    monkeypatch.setattr(bpe, "MEMORY", 2)
    enc = bpe.Encoder()
    texts = ["qxzvk wqxjz zzkqx vvkqz"] * 2
    assert ids(enc, texts) == list(map(reference.encode_ordinary, texts)) and len(enc.merged) <= 2


def test_tables(spark, reference):
    df = spark.createDataFrame([(1, "hello world", 5), (1, "hello world", 5), (2, None, 1), (3, "", 2)], "doc_id long, text string, ids int")
    assert sorted((r.doc_id, r.ids) for r in bpe.encode(df, "doc_id", "text").collect()) == sorted([(1, reference.encode_ordinary("hello world"))] * 2 + [(2, []), (3, [])])
    assert sorted(tuple(r) for r in bpe.token_counts(df, "doc_id", "text").collect()) == [(1, 2), (1, 2), (2, 0), (3, 0)]
    assert bpe.encode(df.limit(0), "doc_id", "text").count() == 0
