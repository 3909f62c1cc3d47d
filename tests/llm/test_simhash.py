"""SimHash groups against all-pairs Hamming distances and a plain union-find."""

import random

import numpy as np
import xxhash

from cuadro.llm import simhash as S
from cuadro.llm.components import components

rng = random.Random(11)


def brute_fp(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(fps, bits):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    fl = sorted(root)
    for i, a in enumerate(fl):
        for b in fl[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                root[find(a)] = find(b)
    return {f: find(f) for f in fl}


def near(f, n):
    for _ in range(n):
        f ^= 1 << rng.randrange(64)
    return f


def partition(pairs):
    out = {}
    for f, r in pairs:
        out.setdefault(r, set()).add(f)
    return sorted(sorted(s) for s in out.values())


def clusters(n):
    out = set()
    for _ in range(n):
        c = rng.getrandbits(64)
        out.update(near(c, rng.randint(0, 5)) for _ in range(rng.choice([1, 2, 5, 30])))
    return out


def check_links(spark, fps, bits, segments, bucket=S.BUCKET):
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    df = spark.createDataFrame(signed, "fp long")
    got = {np.int64(r.node).view(np.uint64).item(): r.root for r in
           components(S.links(df, bits, segments, bucket), "a", "b").collect()}
    want = brute_groups(fps, bits)
    assert partition((f, got.get(f, f"alone{f}")) for f in fps) == partition(want.items())


def test_links_equal_all_pairs(spark):
    check_links(spark, clusters(60), 4, 8)
    check_links(spark, clusters(30), 3, 7)
    check_links(spark, clusters(20), 0, 4)


def test_hot_buckets_are_cut_into_blocks(spark):
    c = rng.getrandbits(64)
    fps = {near(c, rng.randint(0, 9)) for _ in range(300)} | clusters(5)
    check_links(spark, fps, 4, 8, bucket=16)


def test_forest_connects_what_links_connect():
    masks = S.boxes(8)
    for _ in range(20):
        c = rng.getrandbits(64)
        fps = np.array(sorted({near(c, rng.randint(0, 12)) for _ in range(120)}), np.uint64)
        a, b = S.forest(fps, masks, 4)
        assert all((int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(a, b))
        root = {int(f): int(f) for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for x, y in zip(a.tolist(), b.tolist()):
            root[find(x)] = find(y)
        assert partition((f, find(f)) for f in root) == partition(brute_groups([int(f) for f in fps], 4).items())


def test_every_link_passes_the_chain_test():
    masks = S.boxes(8)
    a = np.array([rng.getrandbits(64) for _ in range(5000)], np.uint64)
    b = np.array([near(int(x), 4) for x in a], np.uint64)
    assert S.on_ring(a ^ b, masks, 4).all()
    far = np.array([rng.getrandbits(64) for _ in range(5000)], np.uint64)
    assert S.on_ring(a ^ far, masks, 4).mean() < 0.01


def test_near_duplicates_frame(spark):
    base = [" ".join(rng.choice(["alpha", "beta", "gamma", "delta", "é"]) + str(rng.randint(0, 99)) for _ in range(80))
            for _ in range(12)]
    texts = base + [t.replace(" ", "\n", 3) for t in base] + [t + " extra" for t in base] + [None, "", " \t", "one", "ONE",
            "a b c", "A  B c", "\x85 x", "w " * 30000]
    rows = [(i + 5, t) for i, t in enumerate(texts)] + [(5, texts[0]), (None, texts[1]), (None, "null id only")]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, fp string, component_id int")
    got = S.near_duplicates(docs).withColumn("hex", S.fingerprint_hex()).collect()
    fps = [brute_fp(t, 4) for _, t in rows]
    group = brute_groups(set(fps), 4)
    low = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            low[group[f]] = min(low.get(group[f], 1 << 60), i)
    want = sorted(((i, f"{f:016x}", low.get(group[f])) for (i, _), f in zip(rows, fps)), key=str)
    assert sorted(((r.doc_id, r.hex, r.component_id) for r in got), key=str) == want
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (None, 3), (1, 0)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300))
    assert len(got) == 501
