"""Hard negatives against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm.op11_hard_negatives import VantageTree, hard_negatives, matrix, op11_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v string, block int"


def brute(rows, every=100, k=5, scale=256):
    """rows: (vec_id, embedding, label)."""
    sound = {}
    for i, e, label in rows:
        if i is not None and label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            x = [math.floor(scale * float(np.float32(y))) for y in e]
            sound[i] = min(sound.get(i, (label, x)), (label, x))
    out = []
    for a, (label, q) in sound.items():
        if a % every:
            continue
        scored = sorted(((-sum(s * t for s, t in zip(q, x)), i, other) for i, (other, x) in sound.items() if i != a))
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            fitting = [x for x in scored if x[2] != label and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out += [(a, p, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fitting)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("leaf", [1, 7, 64])
def test_tree_bounds_and_search(leaf):
    random = np.random.default_rng(5)
    x = random.integers(-90, 90, (500, 6))
    x[100:220] = x[100]  # copies
    tree = VantageTree(np.arange(500), random.integers(0, 3, 500), x.astype(float), leaf)
    q = random.integers(-90, 90, (40, 6)).astype(float)
    low, high = tree.bounds(q)
    for n, rows in enumerate(tree.leaves):
        away = tree.radii((q * q).sum(1)[:, None], q @ tree.vectors[rows].T)
        assert (low[:, n, None] <= away + tree.slack).all() and (away <= high[:, n, None] + tree.slack).all()
    assert sorted(np.concatenate(tree.leaves)) == list(range(500))
    ids, scores = tree.search(q, np.full(40, -1), np.zeros(40), np.full(40, np.inf), np.full(40, -np.inf), False, 4)
    for i in range(40):
        all_ = sorted((-s, r) for r, s in enumerate(q[i] @ tree.vectors.T) if tree.labels[r] != 0)[:4]
        assert list(zip(-scores[i], ids[i])) == all_


def test_pruning_visits_few_leaves():
    random = np.random.default_rng(6)
    centres = random.integers(-1000, 1000, (40, 8))
    x = (centres[random.integers(0, 40, 8000)] + random.integers(-5, 5, (8000, 8))).astype(float)
    tree, seen = VantageTree(np.arange(8000), np.zeros(8000, int), x), []
    visit = VantageTree._visit
    tree._visit = lambda leaf, who, *a: (seen.append(len(who)), visit(tree, leaf, who, *a))
    tree.search(x[:50], np.arange(50), np.zeros(50), np.full(50, np.inf), np.full(50, -np.inf), True, 5)
    assert sum(seen) < 0.5 * 50 * len(tree.leaves)


def test_brute_force_with_copies_and_ties(spark):
    random = np.random.default_rng(7)
    x = np.round(random.normal(0, 0.3, (900, 5)), 1)
    x[300:600] = x[300]
    rows = [(i, [float(np.float32(y)) for y in e], int(random.integers(0, 3))) for i, e in enumerate(x)]
    df = spark.createDataFrame([(*r, "a", "b", 1) for r in rows], SCHEMA).repartition(4)
    want = brute(rows)
    assert len(want) > 100
    for sizes in ((256, 1 << 16), (20, 30)):
        got = hard_negatives(df, block_rows=sizes)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert rows_of(got) == want


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.0, 9.0], 2), (1, [1.0, 0.5], 1), (2, [1.0, 0.25], 2), (3, [1.0], 2), (4, [1.0, inf], 2), (5, [nan, 1.0], 2), (6, [None, 1.0], 2), (7, None, 2), (8, [1.0, 0.5], None), (None, [1.0, 0.5], 2), (9, [], 1), (10, [0.9, 0.5, 0.7], 3), (100, [-1.0, -0.5], 1), (200, [], 4), (300, [0.9, 0.5], 1)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    assert rows_of(hard_negatives(df)) == brute(rows)
    assert hard_negatives(df.where("false")).count() == 0


def test_large_whole_numbers_stay_exact(spark):
    big = float(1 << 22)
    rows = [(0, [big, 1.0], 1), (1, [big, 2.0], 1), (2, [big, 1.5], 2), (3, [big, 2.0], 2), (4, [big - 0.5, 1.0], 2)]
    assert matrix([[1 << 30]], 1).dtype == object
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    assert rows_of(hard_negatives(df)) == brute(rows)


def test_table(spark, data):
    t = spark.read.parquet(f"{data}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in t.collect()]
    assert rows_of(op11_hard_negatives(spark, data)) == brute(rows)


def test_other_anchors(spark):
    rows = [(i, [math.cos(i), math.sin(i)], i % 2) for i in range(60)]
    df = spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)
    assert rows_of(hard_negatives(df, anchors=F.col("id") % 10 == 0, k=2)) == brute(rows, 10, 2)
