"""Substring dedup against a dictionary of all 50-byte windows."""

import hashlib
import random

import numpy as np
import pytest

from cuadro.llm import suffix_dedup as S

rng = random.Random(9)


def brute(rows):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        i = S.NO_ID if i is None else i
        for p in range(len(b) - 49):
            w = b[p:p + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p:p + 50]] < (S.NO_ID if i is None else i):
                gone[p:p + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and not (k and gone[k - 1]))
        out.append((i, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def prose(n):
    return "".join(rng.choice("abcdef é\n") for _ in range(n))


def corpus():
    passages = [prose(n) for n in (48, 49, 50, 51, 60, 75, 120, 400)]
    rows = []
    for i in range(150):
        text = prose(rng.randint(0, 200))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p)))) if rng.random() < 0.4 else (0, len(p))
            at = rng.randint(0, len(text))
            text = text[:at] + p[a:b] + text[at:]
        rows.append((rng.randint(0, 120), text))
    rows += [(500 + i, rows[i][1]) for i in range(20)]
    rows += [(600, None), (601, ""), (602, "x" * 49), (603, "x" * 50), (604, "x" * 51), (605, "y" * 3000 + "x" * 80),
             (606, "ab" * 700), (700, "ab" * 300), (None, "ab" * 200), (None, prose(80)), (None, passages[-1]),
             (607, "\0" * 120), (608, "\0" * 70 + "q")]
    return rows


@pytest.mark.parametrize("run_bytes,range_bytes,group_keys", [(2000, 3000, 20_000), (10**7, 10**7, 20_000), (1500, 4000, 2)])
def test_equals_brute_force(spark, run_bytes, range_bytes, group_keys):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "z") for i, t in rows], "doc_id long, text string, run int, body string").repartition(3)
    got = S.dedup(docs, True, run_bytes, range_bytes, group_keys).collect()
    mine = sorted(((S.NO_ID if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got), key=str)
    want = sorted(((S.NO_ID if i is None else i, *x) for i, *x in brute(rows)), key=str)
    assert mine == want
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 for r in got)
    assert sum(x[2] for x in want) > 5000


def test_empty_table(spark):
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_equal_windows_share_an_anchor():
    text = prose(3000).encode()
    w = text[100:150]
    other = prose(500).encode() + w + prose(500).encode()
    p, q = 100, other.index(w)
    places = []
    for buf, at in ((text, p), (other, q)):
        a, _ = S.anchors(np.frombuffer(buf, np.uint8), np.array([len(buf)]))
        places.append({int(x) - at for x in a if at <= x <= at + S.SPAN - 1})
    assert places[0] & places[1]


def test_anchors_do_not_depend_on_the_scan_size(monkeypatch):
    buf = np.frombuffer(prose(5000).encode(), np.uint8)
    ends = np.array([1000, 1030, 3500, len(buf)])
    whole = S.anchors(buf, ends)
    monkeypatch.setattr(S, "SCAN", 137)
    assert all(np.array_equal(x, y) for x, y in zip(whole, S.anchors(buf, ends)))


def test_merge_gives_order_and_common_prefixes():
    def coded(keys):
        m = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, S.KEY)
        lcp = np.zeros(len(m), np.uint8)
        lcp[1:] = (m[1:] != m[:-1]).argmax(axis=1)
        return S._squeeze(lcp, m[np.arange(S.KEY) >= lcp[:, None]], np.arange(len(m), dtype=np.int64), np.arange(len(m), dtype=np.int32))

    for k in (1, 2, 3, 5, 8, 13):
        lists = [sorted({bytes(rng.choice(b"ab") for _ in range(S.KEY - 20)) + b"z" * 20 if rng.random() < 0.5
                         else b"a" * rng.randint(1, S.KEY - 1) + b"b" * S.KEY for _ in range(rng.randint(1, 40))}) for _ in range(k)]
        lists = [[x[:S.KEY] for x in sorted({y[:S.KEY] for y in part})] for part in lists]
        out, before = [], b""
        for common, run in S.merged([S.Run(i, coded(part)) for i, part in enumerate(lists)]):
            same = next((i for i, (x, y) in enumerate(zip(before, run.key)) if x != y), len(before))
            assert common == same
            out.append(run.key)
            before = run.key
        assert out == sorted(x for part in lists for x in part)


def test_hash_ranges_are_even():
    buf = np.frombuffer(prose(200_000).encode(), np.uint8)
    h = np.unique(S.anchors(buf, np.array([len(buf)]))[1])
    counts = np.bincount(S._range_of(h, 100), minlength=100)
    assert counts.max() < 1.5 * counts.mean()
