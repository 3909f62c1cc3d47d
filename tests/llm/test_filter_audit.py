"""Filter audit against filters applied one after the other, order by order."""

import itertools
import random
import re

import numpy as np

from cuadro.llm import filter_audit as A

rng = random.Random(5)
DOCS = "doc_id long, text string, source string, n long, digest string"
LABELS = "doc_id long, quality int, toxic int, part string"


def text(kind):
    n = rng.choice([5, 60, 80])
    words = [f"w{rng.randrange(30 if kind % 2 else 400)}" for _ in range(n)]
    if kind % 3 == 0:
        words = [w.upper() for w in words[:n // 2]] + words[n // 2:]
    return rng.choice([" ", "\n", "\x0b", "  "]).join(words) + ("#" if kind % 5 == 0 else "")


def brute(docs, labels):
    def fails(i):
        doc_id, t = docs[i][0], docs[i][1] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
                "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
                "E": doc_id is not None and any((d[1] or "") == t and d[0] is not None and d[0] < doc_id for d in docs)}
    failed = [fails(i) for i in range(len(docs))]
    good = {x[0] for x in labels if x[1] == 1} - {None}
    toxic = {x[0] for x in labels if x[2] == 1} - {None}
    out, shapley = {}, {}
    for part in {d[2] or "" for d in docs}:
        own = [i for i, d in enumerate(docs) if (d[2] or "") == part]
        for order in itertools.permutations("ABCDE"):
            left = own
            for s, f in enumerate(order, 1):
                gone = [i for i in left if failed[i][f]]
                left = [i for i in left if not failed[i][f]]
                out[part, "".join(order), s] = [
                    len(left), len(gone), sum(failed[i][f] for i in own) - len(gone),
                    sum(failed[i][f] and sum(failed[i].values()) == 1 for i in own),
                    sum(docs[i][0] in good for i in gone), sum(docs[i][0] in toxic for i in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def spark_rows(spark, docs, labels):
    found = A.audit(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS))
    rows = [tuple(r) for r in found.select("part", "filter_order", "step", *A.COLUMNS).collect()]
    assert len(rows) == len({r[:3] for r in rows})
    return {r[:3]: r[3:] for r in rows}


def test_matches_filters_applied_in_turn(spark):
    pool = [text(i) for i in range(12)] + [None, "", "Ä é " * 30, "ONE"]
    docs = [(i, rng.choice(pool), rng.choice(["a", "b", None, ""]), i, "x") for i in range(60)]
    docs += [docs[3], docs[3], (None, docs[3][1], "a", 1, None), (None, docs[3][1], "b", 1, None), (61, docs[3][1], "c", 1, None)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None]), "z") for i in range(0, 60, 2)]
    labels += [(3, 0, 1, "z"), (3, 1, 0, "z"), (None, 1, 1, "z"), (999, 1, 1, "z")]
    assert spark_rows(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert spark_rows(spark, [], []) == {}
    alone = spark_rows(spark, [(1, None, None, 0, None)], [])
    assert len(alone) == 600 and alone["", "BCDEA", 5] == (0, 1, 0, 1, 0, 0, 120) and alone["", "BCDEA", 4][0] == 1


def test_long_text_is_read_whole(monkeypatch):
    monkeypatch.setattr(A, "PIECE", 7)
    for t in ("ab cd" * 40, "x" * 100, " " * 50, "", "one two three\tfour"):
        assert [w for some in A.words(t.encode()) for w in some] == t.encode().split()
    long = " ".join(f"w{i % 97}" for i in range(20_000))
    assert A.failing(long)[0] == 0b01000


def test_figures_of_few_filters():
    # two filters: 3 pass both, 2 fail the first only, 1 the second only, 4 both
    rows = A.figures(["p"], np.array([[[3, 1, 2, 4]], [[0, 0, 0, 1]], [[0, 0, 1, 0]]]), "XY").to_pylist()
    got = {(r["filter_order"], r["step"]): [r[c] for c in A.COLUMNS] for r in rows}
    assert got["XY", 1] == [4, 6, 0, 2, 1, 1, 8] and got["XY", 2] == [3, 1, 4, 1, 0, 0, 6]
    assert got["YX", 1] == [5, 5, 0, 1, 1, 0, 6] and got["YX", 2] == [3, 2, 4, 2, 0, 1, 8]
