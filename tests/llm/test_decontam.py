"""Decontamination against a full Smith-Waterman of every document with every item."""

import random

from cuadro.llm import decontam as D

rng = random.Random(5)
VOCAB = [f"w{i}" for i in range(40)]


def full_score(doc, item):
    best, row = 0, [0] * (len(doc) + 1)
    for w in item:
        new = [0]
        for j, d in enumerate(doc):
            new.append(max(0, row[j] + (2 if w == d else -1), row[j + 1] - 2, new[j] - 2))
        row = new
        best = max(best, *row)
    return best


def brute(docs, items):
    out = []
    for i, t in docs:
        for k, q in items:
            d, w = D.words(t), D.words(q)
            if w and d:
                s = full_score(d, w)
                if s >= 2 * len(w) - 3 * (len(w) // 5):
                    out.append((i, k, round(s / (2 * len(w)), 9)))
    return sorted(out, key=str)


def edited(words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.random()
        if kind < 0.5:
            words[at] = rng.choice(VOCAB)
        elif kind < 0.75:
            words.insert(at, rng.choice(VOCAB))
        elif len(words) > 1:
            del words[at]
    return words


def text(n):
    return [rng.choice(VOCAB) for _ in range(n)]


def test_equals_full_alignment(spark):
    items = [(k, text(rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 30]))) for k in range(40)]
    docs = []
    for i in range(160):
        body = text(rng.randint(0, 60))
        if i % 2:
            k, q = rng.choice(items)
            at = rng.randint(0, len(body))
            body[at:at] = edited(q, rng.randint(0, max(1, len(q) // 3)))
        docs.append((i, " ".join(body).title() + rng.choice(["", ".", " !\n"])))
    docs += [(900, None), (901, ""), (902, "..."), (0, docs[0][1]), (903, " ".join(items[-1][1]) + " zz " + "w1 w2 " * 3000)]
    items = [(k, " ".join(w)) for k, w in items] + [(500, None), (501, ""), (502, "--"), (503, " ".join(text(15)))]
    items.append((504, items[-1][1]))
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, score int")
    got = sorted(((r.doc_id, r.item_id, round(r.score, 9)) for r in D.find(d, b).collect()), key=str)
    want = brute(docs, items)
    assert got == want and len(want) > 50
    kept = sorted(r.doc_id for r in D.remove(d, b).collect())
    assert kept == sorted(i for i, _ in docs if i not in {x for x, *_ in want})
    assert D.remove(d, b).columns == d.columns


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(k, " ".join(text(12))) for k in range(20)]
    docs = [(k, "a b " + q + " c") for k, q in items] + [(99, "nothing here")]
    b = spark.createDataFrame(items, "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = sorted(map(tuple, D.find(d, b).collect()))
    whole = D.blocks
    monkeypatch.setattr(D, "blocks", lambda x: whole(x, block_bytes=300))
    assert len(list(D.blocks(b))) > 2
    assert sorted(map(tuple, D.find(d, b).collect())) == want
    assert [r.doc_id for r in D.remove(d, b).collect()] == [99]


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.find(d.limit(0), b).count() == 0 and D.find(d, b.limit(0)).count() == 0
    assert D.remove(d, b.limit(0)).count() == 1 and D.remove(d.limit(0), b).count() == 0
