"""Epsilon grid order join against all pairs and a plain union-find."""

import math
import random

import numpy as np
import pytest

from cuadro.llm import ego_join as E

rng = np.random.default_rng(4)
SCHEMA = "vec_id long, embedding array<float>, label int, n long, digest string"


def brute(rows, threshold=E.THRESHOLD):
    ok = [r[2] is not None and bool(r[1]) and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if ok[i] and ok[j] and a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.float32(a[1]).astype(float), np.float32(b[1]).astype(float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= threshold:
                    links[i] += 1
                    links[j] += 1
                    root[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], links[i], low.get(find(i)), r[0] == low.get(find(i))) for i, r in enumerate(rows)), key=str)


def found(spark, rows, **kw):
    out = E.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), **kw)
    return sorted((tuple(r) for r in out.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def cluster(n, dims, noise):
    base = rng.normal(size=dims)
    return [(base + noise * rng.normal(size=dims)).astype(np.float32).tolist() for _ in range(n)]


def sample():
    vectors = []
    for noise in (0.01, 0.1, 0.14, 0.2):
        vectors += cluster(25, 12, noise)
    vectors += [rng.normal(size=12).astype(np.float32).tolist() for _ in range(60)]
    vectors += [vectors[0]] * 20 + [[2 * x for x in vectors[0]]] + [vectors[1][:5]] * 3 + [[1.0], [2.5], [-1.0]]
    rows = [(i, v, int(rng.integers(0, 3)) if i % 3 else 1, i, "d") for i, v in enumerate(vectors)]
    random.Random(1).shuffle(rows)
    odd = [[], None, [0.0] * 12, [1.0, None], [float("nan")] * 12, [float("inf")] + [1.0] * 11, [1e-30, 1e-30], [1e30, 1e30]]
    rows += [(1000 + i, v, 1, 0, None) for i, v in enumerate(odd)]
    rows += [(2000, vectors[0], None, 0, None), (None, vectors[0], 1, 0, None), (None, vectors[7], 2, 0, None), rows[0], rows[0]]
    return rows


def test_matches_all_pairs(spark):
    rows = sample()
    assert found(spark, rows, threshold=0.9) == brute(rows, 0.9)


@pytest.mark.parametrize("points,leaf", [(1, 1), (10, 4)])
def test_small_blocks_and_leaves_change_nothing(spark, monkeypatch, points, leaf):
    monkeypatch.setattr(E, "LEAF", leaf)
    rows = sample()
    assert found(spark, rows, block_bytes=points * 12 * 8) == brute(rows)


def test_empty_and_unusable(spark):
    assert found(spark, []) == []
    rows = [(1, None, 1, 0, None), (2, [0.0], 1, 0, None), (3, [1.0], None, 0, None)]
    assert found(spark, rows) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]


def test_recursion_skips_distant_blocks(spark):
    """Three far clusters in a plane: most pairs of blocks are dropped, none with a link is."""
    angles = np.concatenate([np.linspace(0, .3, 200), np.linspace(2, 2.3, 200), np.linspace(4, 4.3, 200)])
    rows = [(i, [float(np.cos(x)), float(np.sin(x))], 0, 0, "") for i, x in enumerate(angles)]
    points = E.prepared(spark.createDataFrame(rows, SCHEMA)).groupBy("digest", "label", "dims", "unit") \
        .agg({"vec_id": "min"}).selectExpr("digest", "label", "dims", "unit", "`min(vec_id)` low", "1L n")
    by_dims = E.axes(points)
    cut = E.blocks(E.in_grid_order(points, by_dims, E.reach(.98)), by_dims, 20 * 16).persist()
    width = E.intervals(cut.count())
    boxes = cut.selectExpr("label", "dims", f"part * {E.FAN ** width} + seq as pos", *E.BOX)
    kept = E.near_blocks(boxes, E.intervals(8) + width, E.reach(.98)).count()
    every = cut.count() * (cut.count() + 1) // 2
    assert cut.count() >= 30 and kept < every / 2
    assert found(spark, rows, block_bytes=20 * 16) == brute(rows)


def test_labels_never_mix_in_near_blocks(spark):
    rows = [(i, [1.0, i / 1000], i % 2, 0, "") for i in range(40)]
    assert {r[1] for r in found(spark, rows, block_bytes=48)} == {19}
