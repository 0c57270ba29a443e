"""Hard negatives against brute force."""

import numpy as np
import pytest

from atalaya.llm import negatives


def slow(rows, every=100, k=5, n=5, low=80, high=100):
    """Rows of (id, vector, label), all of which take part."""
    wide = max(len(v) for _, v, _ in rows)
    full = [(i, [int(x) for x in v] + [0] * (wide - len(v)), g) for i, v, g in rows]
    out, anchors = [], {(i, tuple(v), g) for i, v, g in full if i % every == 0}
    for a, vec, label in anchors:
        scored = sorted((-sum(x * y for x, y in zip(vec, v)), i, g) for i, v, g in full if i != a)
        likes = [(i, -s) for s, i, g in scored if g == label][:k]
        for positive, p in likes:
            hard = [(i, -s) for s, i, g in scored if g != label and low * p <= -100 * s <= high * p][:n]
            out += [(a, positive, rank, i, p, s) for rank, (i, s) in enumerate(hard, 1)]
    return sorted(out)


def table_of(rng, count, dim, size=60):
    centres = rng.normal(size=(8, dim)) * size
    vectors = np.floor(centres[rng.integers(0, 8, count)] + rng.normal(size=(count, dim)) * size / 4)
    vectors *= rng.choice([1, 1, 1, 3], size=(count, 1))
    return [(k, v.tolist(), int(g)) for k, (v, g) in enumerate(zip(vectors, rng.integers(0, 4, count)))]


SMALL = {"sample": 300, "leaf_rows": 20, "leaves": 60, "page_bytes": 1, "block": 7}


@pytest.mark.parametrize("sizes", [{}, SMALL, {"leaf_rows": 10, "leaves": 3, "high": 90, "low": 30}])
def test_equals_brute_force(spark, sizes):
    """Ties, copies of one vector, shorter and empty vectors, repeated rows and ids, negative and great scores."""
    rng = np.random.default_rng(len(sizes))
    rows = table_of(rng, 900, 12)
    rows += [(1000 + k, rows[3][1], k % 2) for k in range(300)]  # one hot vector
    rows += [(1400 + k, rows[3][1][:5], 1) for k in range(4)] + [(1500, [], 1), (1501, [], 2), (1600, [-1.0] * 12, 1), (1700, rows[3][1], 0)]
    rows += [(1800, [2.0 ** 23] * 12, 2), (1801, [2.0 ** 23 - 1] * 12, 1), (1802, [2.0 ** 23 - 3] * 12, 2)]
    rows += [rows[5], rows[5], (1700, rows[9][1], 1), (200, rows[7][1], 3)]
    out = [(2000, [2.0 ** 28] * 12, 1), (2100, None, 1), (2200, [1.0, None], 1), (2300, [float("nan")], 1), (2400, [1.0], None), (None, [1.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + out], "vec_id long, vector array<double>, label int, no string, low int").repartition(5)
    limits = {x: sizes[x] for x in ("low", "high") if x in sizes}
    got = sorted(map(tuple, negatives.hard_negatives(df, **sizes).collect()))
    assert got == slow(rows, **limits)
    assert negatives.hard_negatives(df.where("false")).count() == 0


def test_text_labels(spark):
    rows = [(k, [float(k % 7), 1.0], "even" if k % 2 else "odd") for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, vector array<double>, label string")
    assert sorted(map(tuple, negatives.hard_negatives(df, every=10).collect())) == slow(rows, every=10)


def test_subtrees_are_skipped():
    """No leaf with a row inside an annulus is skipped, and most others are."""
    rng = np.random.default_rng(1)
    rows = np.array([v for _, v, _ in table_of(rng, 4000, 6)])
    tree = negatives.Tree(rows[::4], float(negatives.norms(rows).max()), 4000, 50, 200)
    ranges = {}
    leaf = tree.place(rows, ranges)
    for node, (near, far) in ranges.items():
        tree.nodes[node].near, tree.nodes[node].far = near, far
    anchors = rows[:40]
    scores = anchors @ rows.T
    high = np.sort(scores, axis=1)[:, -20:][:, [0, 10]].astype(np.int64)
    low = high - np.abs(high) // 200
    seen = {(a, number) for number, own in tree.reached(anchors, low, high) for a in own.tolist()}
    used = len(set(leaf.tolist()))
    for a in range(40):
        inside = ((scores[a] >= low[a][:, None]) & (scores[a] <= high[a][:, None])).any(axis=0)
        assert {(a, x) for x in leaf[inside].tolist()} <= seen
    assert 20 < used <= 200 and len(seen) < 0.5 * 40 * used
    assert sorted(k for _, own in tree.home(rows) for k in own.tolist()) == list(range(4000))
