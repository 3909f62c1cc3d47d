"""Byte-level BPE against the tiktoken library, and exact round trips."""

import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from cuadro.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
EDGE = ["", " ", "  ", "\n", " \n ", "a", " a", "  a", "don't we'll they've I'm he'd 'tis ''s 's' 'S",
        "x 's y", "12ab34 ½²", "tab\t\tx \t y", "é ñ ß 中文 العربية 😀👍🏽", "a b  c　", "\x1c\x1fa \x85b",
        "'''''ll", "a'r e're'", "end   ", "!!! ???  ...", "ab" * 700, "!" * 500, " " * 300 + "x", "\r\n\r\nq"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def voc():
    return bpe.Vocabulary(bpe.read_ranks(PATH))


def _random_texts(n, seed):
    rng = random.Random(seed)
    pool = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "a", "Z", "é", "中", "9", "½", "!", "…", "😀",
            " ", " ", "the", "ing", "'s", "\r", "\x1e", "ñ", "-"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 120))) for _ in range(n)]


def test_ids_equal_the_library(voc, reference):
    texts = EDGE + _random_texts(3000, 1)
    got = voc.encode_texts(texts)
    for text, ids in zip(texts, got):
        assert list(ids) == reference.encode_ordinary(text), repr(text)
        assert voc.decode(ids) == text.encode()
        assert voc.offsets(ids)[-1] == len(text.encode())


def test_long_texts_are_cut_at_safe_places(voc, reference, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_SPAN", 50)
    texts = _random_texts(200, 2) + ["word " * 300, "x" * 400, "a  b " * 100]
    for text, ids in zip(texts, voc.encode_texts(texts)):
        assert list(ids) == reference.encode_ordinary(text)


def test_long_merge_equals_short_merge(voc):
    for text in ["ab" * 60, "é" * 90, "internationalization" * 9, "zq" * 99]:
        raw = text.encode()
        assert voc._merge_long(raw) == voc._merge_short(raw)


def test_encode_and_decode_frames(spark):
    rows = [(1, "Hello world's end", "x"), (2, None, "y"), (2, None, "y"), (None, "", None), (4, "é " * 50, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    enc = bpe.encode(docs, PATH)
    out = sorted((r.doc_id or -1, bytes(r.content).decode()) for r in bpe.decode(enc, PATH).collect())
    assert out == sorted((r[0] or -1, r[1] or "") for r in rows)
    first = [r for r in enc.collect() if r.doc_id == 1][0]
    assert first.offsets[0] == 0 and len(first.offsets) == len(first.ids)


def test_round_trip_digests(spark, reference):
    rows = [(i, t) for i, t in enumerate(EDGE)] + [(100, None)]
    got = {r.doc_id: r for r in bpe.round_trip(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()}
    for i, t in rows:
        ids = reference.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.round_trip(docs, PATH).count() == 0 and bpe.encode(docs, PATH).count() == 0
