"""Spherical-cap filters against all pairs."""

import math
import random

import numpy as np
import pytest

from tidepool.llm import caps


def brute(rows, least=0.9):
    """{position: (links, component)} of rows (id, vector)."""
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    near = {i: [] for i in range(len(rows))}
    for i in good:
        for j in good:
            if i < j and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) for k in (i, j))
                if a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b)) >= least:
                    near[i].append(j)
                    near[j].append(i)
    out, seen = {}, set()
    for i in near:
        if i in seen:
            continue
        todo, own = [i], {i}
        while todo:
            for j in near[todo.pop()]:
                if j not in own:
                    own.add(j)
                    todo.append(j)
        seen |= own
        ids = [rows[j][0] for j in own if rows[j][0] is not None]
        out |= {j: (len(near[j]), min(ids) if ids else None) for j in own}
    return out


def clusters(dims, rng, groups=30, noise=0.2):
    """Unit vectors with groups of like ones, some of them exact copies."""
    out = []
    for _ in range(groups):
        centre = rng.standard_normal(dims)
        centre /= np.linalg.norm(centre)
        for _ in range(int(rng.integers(1, 7))):
            v = centre + noise * rng.standard_normal(dims) / np.sqrt(dims)
            out += [v.round(4).tolist()] * int(rng.integers(1, 3))
    return out


def same(got, rows):
    want = brute(rows)
    assert sorted(got, key=repr) == sorted(((rows[i][0], n, c, rows[i][0] == c) for i, (n, c) in want.items()), key=repr)


@pytest.mark.parametrize("dims", (3, 24, 70))
def test_all_links_of_clusters(spark, dims):
    rows = list(enumerate(clusters(dims, np.random.default_rng(dims))))
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    out = caps.near_vectors(df).select("vec_id", "n_links", "component_id", "kept")
    same([tuple(r) for r in out.collect()], rows)


def test_crowded_filters_are_compared_in_blocks(spark):
    rows = list(enumerate(clusters(16, np.random.default_rng(9), groups=4, noise=0.1) * 2 + clusters(16, np.random.default_rng(4))))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    for most in (1000, 0):  # names of crowded filters broadcast, and joined by a shuffle
        out = caps.near_vectors(df, settings=caps.Settings(block_rows=4, most_broadcast=most)).select("vec_id", "n_links", "component_id", "kept")
        same([tuple(r) for r in out.collect()], rows)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(5, v), (5, v), (3, [x * 2 for x in v]), (None, v), (9, None), (10, [0.0, 0.0, 0.0]), (11, [1.0, None, 0.0]), (12, [float("nan"), 1.0, 0.0]),
            (13, [float("inf"), 1.0, 0.0]), (14, [1.0, 2.0, 3.0, 0.0]), (15, []), (16, [-1.0, -2.0, -3.0]), (17, [1.0]), (18, [2.0]), (19, [-2.0])]
    df = spark.createDataFrame([(i, x, "a", 7, "b") for i, x in rows], "vec_id long, embedding array<double>, kept string, n_links int, node string").repartition(3)
    out = caps.near_vectors(df)
    assert set(out.columns) == set(df.columns) | {"component_id"}
    same([(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in out.collect()], rows)
    assert caps.near_vectors(df.limit(0)).count() == 0
    floats = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    assert {r["component_id"] for r in caps.near_vectors(floats).collect()} == {1}


def test_pairs_at_the_limit_share_filters():
    """Two vectors just above the cosine wanted meet, at sizes of the table from hundreds to ten millions."""
    rng = np.random.default_rng(3)
    a = rng.standard_normal((1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    other = rng.standard_normal(a.shape)
    other -= (other * a).sum(1, keepdims=True) * a
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    b = 0.9005 * a + np.sqrt(1 - 0.9005**2) * other
    for vectors in (300, 50_000, 10_000_000):
        codes = caps.caps(64, vectors, 0.9, caps.Settings())
        (n, x), (m, y) = (caps.decoded_by(codes, v) for v in (a, b))
        mine, theirs = np.split(x, np.cumsum(n)[:-1]), np.split(y, np.cumsum(m)[:-1])
        met = np.mean([len(np.intersect1d(i, j)) > 0 for i, j in zip(mine, theirs)])
        assert met > 0.99 and n.mean() < 150  # a vector's filters grow slowly


def test_list_decoding_finds_every_cap():
    rng = np.random.default_rng(5)
    own = caps.Caps(caps.planned(24, 500, 0.9, caps.Settings()), [1, 2])
    x = rng.standard_normal((40, 24))
    row, code = own.decode(x, rows=7)
    turned, words = own.rotate(x), own.plan.words
    every = np.array([np.concatenate([own.code[0][i], own.code[1][j]]) for i in range(words) for j in range(words)]) / np.sqrt(2)
    held = turned @ every.T >= own.plan.height
    assert set(zip(row.tolist(), code.tolist())) == set(zip(*(c.tolist() for c in np.nonzero(held))))
    assert np.allclose((turned**2).sum(1), 1)
