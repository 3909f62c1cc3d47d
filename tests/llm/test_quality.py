"""Quality measures and verdicts against plain Python, and the cascade's order."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuadro.llm import quality as Q

rng = random.Random(4)


def brute(text):
    text = text or ""
    w = [x for x in re.split("[ \t-\r]+", text) if x]
    grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search("[^ \t-\r]", x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"),
            "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered)}


def texts():
    pool = ["a", "bb", "ccc", "é", "##", "|", "x<y>", "\x85", "\xa0", "the", "\U0001f600"]
    out = [None, "", " ", "\n\n \t", " lead", "trail ", "a\x0bb\x0cc\rd\x1ce", "a b c d e", "a b c d", "x " * 12000,
           "one two three four five " * 3, "l\nl\nl\n\n \nl2\nl", "a b c d e z a b c d e", "same words again and again " * 2]
    for _ in range(150):
        out.append("".join(rng.choice(pool) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.randint(1, 60))))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 3, "w") for i, t in enumerate(texts())] + [(3, texts()[3], 3, None), (None, "a b", 3, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, _words string")


def test_measures(spark, docs):
    rows = {r.doc_id: r.asDict() for r in Q.measure(docs).collect()}
    for i, t in enumerate(texts()):
        if i < 14:
            want = brute(t)
            assert {k: rows[i][k] for k in want} == want, repr(t)
    got = sorted(tuple(v for k, v in r.asDict().items() if k != "doc_id") for r in Q.measure(docs.where("doc_id >= 14")).collect())
    want = sorted(tuple(brute(r.text)[k] for k in Q.MEASURES) for r in docs.where("doc_id >= 14").collect())
    assert got == want
    assert Q.measure(docs.limit(0)).count() == 0


def reject(rule, m):
    return bool(eval(rule.reject, {}, m))


def test_cascade_verdict_does_not_depend_on_the_order(spark, docs):
    rules = list(Q.BASE_RULES + Q.RULES)
    kept = None
    for _ in range(3):
        rng.shuffle(rules)
        rows = Q.cascade(docs, rules, ["doc_id", "text"]).collect()
        for r in rows:
            by = [x.name for x in rules if reject(x, brute(r.text))]
            assert r.rejected_by == (by[0] if by else None)
        now = sorted(str(r.doc_id) for r in rows if r.rejected_by is None)
        assert kept is None or now == kept
        kept = now


def test_order_by_rejection_per_cost(spark, docs):
    est = Q.estimate(docs, rows=50)
    assert set(est) == {r.name for r in Q.BASE_RULES + Q.RULES}
    assert all(c > 0 and 0 <= s <= 1 for c, s in est.values())
    order = Q.ordered(Q.RULES, {"symbols": (1.0, .1), "short_words": (.1, .1), "long_words": (.1, 0.), "dup_lines": (2., .9)})
    assert [r.name for r in order] == ["short_words", "dup_lines", "symbols", "long_words"]
    assert Q.estimate(docs.limit(0), rows=5)["symbols"][1] == 0.0


def test_unreached_measures_are_not_evaluated(spark, docs):
    first = Q.Rule("all", "n_words >= 0", ("n_words",))
    fails = Q.Rule("boom", "raise_error('reached') is null", ("n_repeat_words",))
    rows = Q.cascade(docs, [first, fails], ["doc_id"]).collect()
    assert {r.rejected_by for r in rows} == {"all"}


def test_no_python_in_the_plan(docs):
    plan = Q.cascade(docs, list(Q.RULES), ["doc_id"], Q.MEASURES)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan.replace("Scan ExistingRDD", ""))
    assert F is not None
