"""Rank-order language profiles against a plain dictionary version, and held-out accuracy."""

import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cuadro.llm import language_id as L
from cuadro.llm import queries as Q
from tests.conftest import SF_CHECK


def grams_of(text):
    chars, out = "", []
    for ch in " " + text.lower() + " ":
        ch = ch if ch.isalpha() else " "
        if not (ch == " " and chars.endswith(" ")):
            chars += ch
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            g = chars[i:i + n]
            if g != " " and " " not in g[1:-1]:
                out.append(g)
    return out


def code(g):
    v = 0
    for ch in g:
        v = v << 21 | ord(ch)
    return v


def rank(counter, size):
    return [g for g, _ in sorted(counter.items(), key=lambda x: (-x[1], code(x[0])))[:size]]


def brute_predict(text, profiles, size):
    if not text or not any(ch.isalpha() for ch in text.lower()) or not profiles:
        return "und", 0.0
    own = rank(Counter(grams_of(text)), size)
    best = None
    for name in sorted(profiles):
        place = {g: i for i, g in enumerate(profiles[name])}
        d = sum(min(abs(place[g] - i), size) if g in place else size for i, g in enumerate(own))
        if best is None or d < best[0]:
            best = (d, name)
    return best[1], 1 - best[0] / (size * len(own))


ROWS = [(1, "The cat and the dog in the rain", "en"), (2, "Der Hund und die Katze im Regen", "de"),
        (3, "The dog", None), (4, None, "en"), (5, "", "de"), (6, "123 !!", "en"), (7, "Ärger über Öl ẞ", "de"),
        (8, "the the " * 3000, "en"), (8, "the the " * 3000, "en"), (None, "und der Regen", None), (9, "İstanbul ﬁn", "en")]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, g, 0.5, "z") for i, t, g in ROWS],
                                 "doc_id long, text string, lang string, score double, gram string")
    size = 30
    learned = L.learn(docs, F.col("lang"), size=size)
    counts = {}
    for _, t, g in ROWS:
        if t is not None and g is not None:
            counts.setdefault(g, Counter()).update(grams_of(t))
    profiles = {g: rank(c, size) for g, c in counts.items()}
    assert learned == {g: [code(x) for x in p] for g, p in profiles.items()}
    got = sorted((r.doc_id or 0, r.lang_pred, round(r.score, 12)) for r in L.predict(docs, learned, size=size).collect())
    want = sorted((i or 0, p, round(s, 12)) for i, (p, s) in ((i, brute_predict(t, profiles, size)) for i, t, _ in ROWS))
    assert got == want


def test_no_training_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert L.learn(docs, F.col("lang")) == {}
    assert [tuple(r) for r in L.predict(docs, {}).collect()] == [(1, "und", 0.0)]
    assert L.predict(docs.limit(0), {"en": [97]}).count() == 0


def test_too_many_labels_is_an_error(spark):
    docs = spark.createDataFrame([(i, "abc", f"l{i}") for i in range(5)], "doc_id long, text string, lang string")
    try:
        L.learn(docs, F.col("lang"), max_languages=4)
    except ValueError:
        return
    raise AssertionError("no error")


def test_counting_in_parts_is_the_same():
    g = L.ngrams(L.letters("some words in a row and some words"))
    whole = L.counted(g)
    parts = L._summed([L.counted(g[:10]), L.counted(g[10:25]), L.counted(g[25:])])
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts))


def test_query_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang").collect()}
    rows = Q.QUERIES["op2_language_id"](spark, SF_CHECK).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_long_texts_are_counted_in_pieces(monkeypatch):
    text = "Ein Wort, noch ein Wort! " * 40 + "x" * 30 + " ende"
    whole = L.text_counts(text)
    monkeypatch.setattr(L, "PIECE", 17)
    assert all(np.array_equal(a, b) for a, b in zip(whole, L.text_counts(text)))
