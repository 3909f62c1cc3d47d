"""Source divergence against plain counting and sums over all terms."""

import random
import re
from collections import Counter

import numpy as np

from cuadro.llm import source_divergence as S

rng = random.Random(8)
DOCS = "doc_id long, text string, lang string, source string, term string, n long"


def brute(docs, top=10):
    rows = [((t or ""), (lang or ""), (s or "")) for _, t, lang, s, *_ in docs]
    upper = {c: c + 32 for c in range(65, 91)}
    words = [[w.translate(upper) for w in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)] for t, _, _ in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        own = [i for i, r in enumerate(rows) if r[1] == lang]
        df = Counter(w for i in own for w in set(words[i]))
        kept = sorted(w for w, n in df.items() if n >= 10)
        counts = {s: Counter(w for i in own if rows[i][2] == s for w in words[i]) for s in {rows[i][2] for i in own}}
        whole = sum(counts.values(), Counter())

        def shares(c):
            size = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 2) // (size + 2 * len(kept)) for w in kept}
        p = {s: shares(c) for s, c in counts.items()}
        q = shares(whole)
        for s in p:
            pair = [(sum((p[s][w] - p[o][w])**2 // (p[s][w] + p[o][w]) for w in kept), o) for o in p if o != s]
            term = [((p[s][w] - q[w])**2 // (p[s][w] + q[w]), w) for w in kept if counts[s][w] > 0 and p[s][w] > q[w]]
            for part, found, limit in (("pair", pair, None), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, rank) for rank, (v, item) in enumerate(found[:limit], 1)}
    return out


def result(frame):
    rows = [tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus():
    vocabulary = ["Alpha", "beta", "gamma", "straße", "ÄRGER", "ñandú", "x", "delta9eta", "foo-bar", "日本", "zz", "rare"]
    docs = []
    for i in range(150):
        words = rng.choices(vocabulary, weights=[9, 8, 7, 6, 5, 4, 3, 3, 2, 2, 1, .2], k=rng.randrange(0, 12))
        docs.append((i, " ".join(words), rng.choice(["en", "en", "de", None]), rng.choice(["a", "b", "c", "d", "é", None, ""]), "t", 1))
    docs += [(1000 + i, "copied Text of many words alpha", "en", rng.choice("abc"), None, None) for i in range(40)]
    docs += [(7, None, "en", "a", None, None), (None, "Alpha", "en", "lonely", None, None), (8, "few words", "it", "a", None, None),
             (9, "", "it", "b", None, None), (10, "\x00\x7f@[`{", "fr", None, None, None), docs[0], docs[0]]
    return docs


def test_matches_plain_sums(spark):
    docs = corpus()
    frame = spark.createDataFrame(docs, DOCS).repartition(5)
    assert result(S.audit(frame)) == brute(docs)
    assert result(S.audit(frame, top=2)) == brute(docs, 2)


def test_tiles_and_buckets_change_nothing(spark):
    counts, groups = S.sparse_counts(spark.createDataFrame(corpus(), DOCS).repartition(3), min_documents=2)
    whole = {tuple(r) for r in S.pairs(counts, groups).collect()}
    assert {tuple(r) for r in S.pairs(counts, groups, tile=2, bucket=10).collect()} == whole
    assert {tuple(r) for r in S.pairs(counts, groups, tile=1, bucket=1000).collect()} == whole


def test_small_memory_changes_nothing(spark, monkeypatch):
    frame = spark.createDataFrame(corpus(), DOCS).repartition(2)
    want = result(S.audit(frame))
    for name in ("HELD_TEXTS", "HELD_COUNTS", "PIECE"):
        monkeypatch.setattr(S, name, 3)
    assert result(S.audit(frame)) == want


def test_a_text_is_tokenised_once(spark):
    seen = spark.createDataFrame([(i, "same text", "en", "abc"[i % 3], None, None) for i in range(60)], DOCS).coalesce(1)
    rows = S.collapse(seen).collect()
    assert sum(r.text is not None for r in rows) == 1
    assert sorted((r.source, r.n) for r in rows if r.text is None) == [("a", 20), ("b", 20), ("c", 20)]


def test_empty_table(spark):
    assert result(S.audit(spark.createDataFrame([], DOCS))) == set()


def test_pair_sums_against_dense_matrix():
    r = np.random.default_rng(3)
    zero = r.integers(1, 50, 6)
    p = np.where(r.random((300, 6)) < .4, r.integers(1, 10**9, (300, 6)), 0)
    term, at = np.nonzero(p)
    dense = np.where(p > 0, p, zero)
    want = [[int(S.divergence(dense[:, i], dense[:, j]).sum()) for j in range(6)] for i in range(6)]
    got = S.pair_sums(p[term, at], at, term, zero, 300)
    assert all(got[i, j] == want[i][j] for i in range(6) for j in range(6) if i != j)


def test_terms_in_pieces(monkeypatch):
    monkeypatch.setattr(S, "PIECE", 5)
    for t in ("Ab cd, AB é É 日本語日本語", "x" * 40, "", "\x00\x7f"):
        want = Counter(w.translate({c: c + 32 for c in range(65, 91)}) for w in re.findall("[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t))
        assert {k.decode(): v for k, v in S.terms(t).items()} == dict(want)
