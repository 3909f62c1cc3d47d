"""Language-model scores: counts and base scores by hand, normalised probabilities, gain on held-out text."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from cuadro.llm import lm
from cuadro.llm import queries as Q
from cuadro.llm.common import held_out, id_text
from tests.conftest import SF_SMALL

rng = random.Random(2)


def tokens(t):
    return [*(t or "").encode().lower().split(), lm.END]


def brute_base(rows, training):
    c = Counter(w for t in training for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)))
            for i, t in rows}


def texts(n):
    """A two-word grammar, so that context helps."""
    out = []
    for _ in range(n):
        w = ["start"]
        for _ in range(rng.randint(0, 60)):
            w.append(rng.choice({"start": ["a", "b"], "a": ["b"], "b": ["c", "c", "a"], "c": ["a", "rare%d" % rng.randint(0, 400)]}
                                .get(w[-1], ["A", "b"])).lower())
        out.append(" ".join(w))
    return out


def frame(spark):
    rows = list(enumerate(texts(400))) + [(900, None), (901, ""), (902, " \t"), (903, "unseenword"), (904, "a " * 20000), (7, "a b c")]
    return rows, spark.createDataFrame([(i, t, 1.0, b"q") for i, t in rows] + [(None, "a b", 1.0, None)],
                                       "doc_id long, text string, score double, word binary")


def test_counts_and_base_score(spark):
    rows, docs = frame(spark)
    docs = id_text(docs)
    training = docs.where(~held_out("doc_id", 7, 2)).select("text")
    want = brute_base([r for r in rows if r[0] != 7], [r.text for r in training.collect()])
    for frequent in (5, 200_000):                    # rare words joined, or all words sent along
        got = {r.doc_id: r for r in lm.score(docs, training, vocabulary=8, dims=4, frequent=frequent).collect() if r.doc_id != 7}
        for i, (n, known, total, base) in want.items():
            r = got[i]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
            assert math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-9)
    assert lm.score(docs, training, vocabulary=8, dims=4).count() == len(rows) + 1


def test_probabilities_sum_to_one():
    m = lm.Model(np.array([5.0, 3, 2, 1]), 3)
    m.q += 0.7
    a, b, log_z = m.tables()
    p = np.exp(a[:, None, :] + b[None, :, :] - log_z[:, :, None]).sum(-1)
    assert np.allclose(p, 1, atol=1e-5)


def test_contexts_restart_with_every_text():
    one, two, word = lm.contexts([np.array([1, 2, 3]), np.array([4]), np.array([5, 6])], 9)
    assert word.tolist() == [1, 2, 3, 4, 5, 6]
    assert one.tolist() == [9, 1, 2, 9, 9, 5] and two.tolist() == [9, 9, 1, 9, 9, 9]


def test_other_words_share_their_class(spark):
    """Words outside the vocabulary and the unseen word divide the mass of their class among them."""
    training = spark.createDataFrame([(t,) for t in ["a b", "a c", "a a d", "e"]], "text string")
    words = lm.frequent_words(lm.count_words(training), 100)
    assert words[0] == (lm.END, 4) and words[1] == (b"a", 4)
    s = lm.Scorer(words, 12, 6, 3, 2)                # events: other, end, a
    assert s.rest == sum(n + 1 for _, n in words[2:]) + 1
    docs = spark.createDataFrame([(i, w) for i, w in enumerate(["b", "e", "never", "also never"])], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(docs, training, vocabulary=3, dims=2).collect()}
    assert math.isclose(got[0], got[1]) and math.isclose(got[0] - got[2], math.log10(2), rel_tol=1e-6)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in lm.score(docs, docs.select("text").limit(0)).collect())
    assert got == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]
    assert lm.score(docs.limit(0), docs.select("text"), dims=2).count() == 0


def test_context_gains_on_held_out_text(spark):
    docs = spark.createDataFrame(list(enumerate(texts(3000))), "doc_id long, text string").repartition(2)
    training = docs.where("doc_id < 2500").select("text")
    rows = lm.score(docs, training, vocabulary=16, dims=8).where("doc_id >= 2500").collect()
    assert sum(r.score for r in rows) > 0.8 * sum(r.base_score for r in rows)


def test_query_on_the_small_table(spark):
    rows = Q.QUERIES["op5_lm_score"](spark, SF_SMALL).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) for r in rows)
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)
