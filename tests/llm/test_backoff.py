"""Operator 5: what it moves, counts across groups and ranges, the order of keys."""

import collections
import math
import random

import numpy as np

from rasterloom.llm import op5_stupid_backoff as op5

from test_scans import backoff_oracle


def shuffled(spark):
    """Bytes of shuffle that each stage so far has written, by its id."""
    context = spark.sparkContext
    gateway = context._gateway
    stages = context._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return {(x := stages.apply(i)).stageId(): x.shuffleWriteBytes() for i in range(stages.size())}


def test_backoff_moves_ngrams_in_parts(spark):
    """No exchange, whose files are on disk at once, is much larger than the texts; scores of two documents against brute force."""
    rng = random.Random(55)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(40_000)]
    texts = [" ".join(words[int(40_000 * rng.random() ** 2)] for _ in range(1500)) for _ in range(720)]
    before = shuffled(spark)
    got = {r.doc_id: (r.n_words, r.n_backoffs, r.log_score) for r in op5.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    moved = [n for k, n in shuffled(spark).items() if k not in before]
    assert max(moved) < 2 * sum(map(len, texts)) and sum(moved) < 10 * sum(map(len, texts))
    assert got.keys() == set(range(720))
    for i in (0, 719):
        x, others = texts[i].split(), collections.Counter()
        for y in (t.split() for j, t in enumerate(texts) if j != i):
            for k in range(1, 4):
                others.update(zip(*(y[m:] for m in range(k))))
        steps, logs = 0, 0.0
        for at in range(1500):
            gram = tuple(x[max(0, at - 2) : at + 1])
            while len(gram) > 1 and not others[gram]:
                gram, steps, logs = gram[1:], steps + 1, logs + math.log(0.4)
            logs += math.log(max(others[gram], 1) / (others[gram[:-1]] if len(gram) > 1 else 719 * 1500))
        assert got[i][:2] == (1500, steps) and math.isclose(got[i][2], logs, rel_tol=1e-9)


def test_backoff_of_many_groups(spark):
    rng = random.Random(56)
    texts = [None, "", "x", "q " * 3000] + [" ".join(f"w{int(60 * rng.random() ** 3)}" for _ in range(rng.randrange(60))) for _ in range(200)]
    df, want = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), backoff_oracle(texts)
    for held in (900, 1 << 20):
        got = {r.doc_id: (r.n_words, r.n_backoffs, r.log_score) for r in op5.score(df, held=held).collect()}
        assert len(got) == len(texts)
        assert all(got[i][:2] == x[:2] and (got[i][2] is None if x[2] is None else math.isclose(got[i][2], x[2], rel_tol=1e-9, abs_tol=1e-9)) for i, x in enumerate(want))


def test_order_by_key():
    """Keys that share their leading bits, keys told apart by their checks only, equal rows in their own order."""
    rng = np.random.default_rng(57)
    for spread in (1 << 63, 1, 5):
        low = rng.integers(0, 1 << 63, 50, np.uint64)
        key = low[rng.integers(0, 50, 3000)] + rng.integers(0, spread, 3000, np.uint64)
        for check in (np.zeros(3000, np.uint32), rng.integers(0, 3, 3000, np.uint32)):
            assert op5.by_key(key, check).tolist() == sorted(range(3000), key=lambda i: (key[i], check[i], i))
    assert op5.by_key(np.empty(0, np.uint64), np.empty(0, np.uint32)).tolist() == []


def test_packed_integers_of_any_size():
    for values in ([], [0], [255, 3], [256, 1, 0], [1 << 40, 7], [(1 << 64) - 1, 0, 5]):
        assert op5.unpacked(op5.packed(np.array(values, np.uint64)), len(values)).tolist() == values
