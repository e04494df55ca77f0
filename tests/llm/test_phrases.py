"""Collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import op12_phrases
from rasterloom.llm.bitmaps import gathered, is_set, merged, sparse_counts
from rasterloom.llm.op12_phrases import collocations, frequent_phrases

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, chunk int"


def brute(rows, longest=5, support=100, top=2000, covered=100):
    """rows: (text, lang)."""
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        frequent = {p: a for p, a in counts.items() if a >= support}
        inside = {p[i : i + k] for p, b in frequent.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * b >= covered * frequent[p[i : i + k]]}
        found = []
        for p, a in frequent.items():
            if len(p) > 1 and p not in inside:
                cuts = [(1000 * a * n[lang] // (frequent[p[:k]] * frequent[p[k:]]), k, frequent[p[:k]], frequent[p[k:]]) for k in range(1, len(p))]
                s, _, l, r = min(cuts)
                found.append((-s, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def made(seed=1, docs=300):
    rng, fixed = random.Random(seed), ["new york city hall is", "état de l'art", "so called", "x x x x x x x", "Über die Straße", "a\x1cb c"]
    words = [f"w{i}" for i in range(30)]
    out = []
    for _ in range(docs):
        t = []
        for _ in range(rng.randint(0, 30)):
            t.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words))
            t.append(rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "!?"]))
        out.append(("".join(t), rng.choice(["en", "fr", None])))
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize(("longest", "support", "covered"), [(5, 20, 100), (3, 5, 60), (2, 40, 100)])
def test_brute_force(spark, longest, support, covered):
    rows = made()
    df = spark.createDataFrame([(i, t, lang, "clash", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(3)
    want = brute(rows, longest, support, 2000, covered)
    assert len(want) > 5
    got = collocations(df, longest=longest, support=support, covered=covered)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert rows_of(got) == want


def test_small_flushes(spark, monkeypatch):
    rows = made(2, 200)
    df = spark.createDataFrame([(i, t, lang, "", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA)
    for name in ("_HELD", "_PART", "_WORDS"):
        monkeypatch.setattr(op12_phrases, name, 50)
    found = []
    for lang, texts in (("en", [t for t, x in rows if x == "en"]),):
        work = op12_phrases.Pass(1, 5, 3, 1 << 16, None, None)
        total = Counter()
        for t in texts:
            for batch in work.add(t.encode(), lang):
                total.update({p: n for p, n, c in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))) if c is None})
        for batch in work.flush():
            total.update({p: n for p, n, c in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))) if c is None})
        found.append(total[None])
        assert total[None] == sum(len(t.translate(str.maketrans(".,;:!?\n", "       ")).encode().split()) for t in texts)
    monkeypatch.undo()
    assert rows_of(collocations(df, support=10, most_buckets=1 << 16)) == brute(rows, support=10)


def test_top_and_ties(spark):
    rows = [(f"p{i} q{i}. " * 3, "en") for i in range(10)]
    df = spark.createDataFrame([(i, t, lang, "", 1, 2) for i, (t, lang) in enumerate(rows)], SCHEMA)
    assert rows_of(collocations(df, support=3, top=4)) == brute(rows, support=3, top=4)
    assert [r.phrase for r in collocations(df, support=3, top=4).orderBy("rank").collect()] == ["p0 q0", "p1 q1", "p2 q2", "p3 q3"]


def test_odd_rows(spark, odd, none_of):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert rows_of(collocations(odd)) == brute(rows)
    assert collocations(none_of).count() == 0
    assert frequent_phrases(odd.where("text is null")).where("k > 0").count() == 0


def test_products_beyond_64_bits(spark):
    a = F.lit(10**12)
    got = spark.range(1).select(F.expr("(1000 * cast(3000000000000 as decimal(18,0)) * cast(900000000000000000 as decimal(18,0))) div (cast(3000000000001 as decimal(18,0)) * cast(3000000000007 as decimal(18,0)))").alias("s"), a).first().s
    assert got == 1000 * 3000000000000 * 900000000000000000 // (3000000000001 * 3000000000007)


def test_bitmaps(spark):
    from rasterloom.llm.shared import ship

    ship(spark)
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 1 << 18, 5000).astype(np.uint64) for _ in range(6)]
    sets[0][:300] = 77
    rows = [tuple(r) for s in sets for r in zip(*(sparse_counts(s, 100).column(i).to_pylist() for i in range(3)))]
    df = spark.createDataFrame([(c, bytearray(o), bytearray(n)) for c, o, n in rows], "chunk int, offsets binary, counts binary")
    for threshold in (1, 2, 100):
        bitmap = gathered(merged(df, threshold), 1 << 18)
        assert np.array_equal(is_set(bitmap, np.arange(1 << 18, dtype=np.uint64)), np.bincount(np.concatenate(sets).astype(int), minlength=1 << 18) >= threshold)
    with pytest.raises(ValueError, match="threshold"):
        merged(df, 256)
