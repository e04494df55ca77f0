"""Cases in which operators once did less than the whole job."""

import collections
import math
import random

from rasterloom.llm.op5_stupid_backoff import score
from rasterloom.llm.op7_minmax_dedup import keep_one
from rasterloom.llm.op8_quality_outliers import judge

from test_scans import backoff_oracle


def test_backoff_counts_more_words_than_16_bits(spark):
    texts = [" ".join(f"w{(d * 700 + i) % 84_000} the" for i in range(720)) for d in range(120)]
    rows = sorted(score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect())
    for r, (n, steps, logs) in zip(rows, backoff_oracle(texts), strict=True):
        assert (r["n_words"], r["n_backoffs"]) == (n, steps) and math.isclose(r["log_score"], logs, rel_tol=1e-9)


def test_outliers_of_small_groups(spark):
    """Sources of 12 documents, and a language of 13, are tested too."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    prose = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(30, 200)))
    rows = [(i, prose(), "en" if i < 120 else "de", f"source {i // 12}") for i in range(132)]
    rows += [(1000 + i, " ".join(rng.choice(words) + "$$$###" for _ in range(80)), lang, source) for i, (lang, source) in enumerate([("en", "source 3"), ("de", "source 10"), ("fr", None)])]
    got = {r["doc_id"]: r for r in judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i]["kept"] for i in range(132)) and not any(got[i]["kept"] for i in got if i >= 1000)
    assert all(r["distance"] is not None for r in got.values())


def test_near_dedup_goes_by_row(spark):
    """Copies go, but not other texts under the same id, null included; of copies that all lack an id one stays."""
    text = lambda name, n=60: " ".join(f"{name}{i}" for i in range(n))
    stay = [(1, text("a")), (None, text("b")), (2, text("c")), (2, text("d")), (7, text("g")), (7, text("g")), (None, ""), (None, "")]
    go = [(None, text("a") + " end"), (3, text("a") + " more"), (2, text("a", 59))]
    orphans = [(None, text("e")), (None, text("e")), (None, text("e") + " end"), (None, text("E"))]
    got = collections.Counter(tuple(r) for r in keep_one(spark.createDataFrame(stay + go + orphans, "doc_id long, text string")).collect())
    assert sum(got[o] for o in set(orphans)) == 1
    assert got - collections.Counter({o: got[o] for o in set(orphans)}) == collections.Counter(stay)
