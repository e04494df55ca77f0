"""Operators 2 and 7 against brute force, and their odd cases."""

import collections
import random

import numpy as np
from pyspark.sql import functions as F

from rasterloom.llm import op2_line_dedup as op2
from rasterloom.llm.op2_line_dedup import deduplicate, line_matches, op2_line_dedup
from rasterloom.llm.op7_minmax_dedup import MinMax, components, keep_one, near_duplicates, odd_sketch, op7_minmax_dedup, shingle_set

from helpers import line_oracle, near_groups


def test_near_duplicates_query(spark, data, texts):
    want, sets = near_groups(texts)
    got = {r["doc_id"]: r for r in op7_minmax_dedup(spark, data).collect()}
    assert {d: (r["n_shingles"], r["component_id"], r["kept"]) for d, r in got.items()} == {d: (len(sets[d]), want[d], want[d] == d) for d in texts}


def variants(seed, n, words, changes):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(4000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(changes)):
            w[rng.randrange(words)] = f"v{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_chains_and_large_groups(spark):
    """Groups whose members mostly resemble their original only, and exact copies."""
    all_of = variants(1, 90, 120, 9) + variants(2, 60, 40, 4) + ["copy of one text with some words"] * 30 + ["Copy OF one text with\tsome  words"] * 5 + ["two words", "two  words", "words two"]
    texts = dict(enumerate(all_of))
    want, _ = near_groups(texts)
    got = near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) > 3


def test_near_duplicates_odd_rows(odd, none_of):
    rows = near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r["doc_id"]].append(r)
    assert all(r["component_id"] == d and r["n_shingles"] == 0 for d in (0, 1, 2) for r in by_id[d])
    assert {r["component_id"] for r in by_id[None]} == {None} and len(by_id[5]) == 3
    assert near_duplicates(none_of).count() == 0
    assert keep_one(odd).columns == odd.columns and keep_one(none_of).count() == 0


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(1)
    for n in (1, 10, 400, 5000):
        a = rng.integers(0, 1 << 63, n, np.uint64)
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, n // 3 + 1, np.uint64)]))
        a = np.unique(a)
        bits = sum(int(x).bit_count() for x in (odd_sketch(a) ^ odd_sketch(b)).view(np.uint64))
        assert bits <= len(np.setxor1d(a, b))


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 1000, np.uint64) * np.uint64(2)
    b = np.concatenate([a[:750], rng.integers(0, 1 << 63, 0, np.uint64)])
    m = MinMax()
    assert abs((m.signature(a) == m.signature(b)).mean() - 0.75) < 0.08 and len(m.keys(m.signature(a))) == 80
    assert (shingle_set("A b\tC") == shingle_set("a B c")).all() and len(shingle_set("a b c d e f")) == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(200, 201)]
    labels = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(labels[i] == 0 for i in range(41)) and labels[119] == 100 and labels[201] == 200


def check_lines(rows, texts):
    want, got = line_oracle(texts), set()
    for r in rows:
        text = texts[r["doc_id"]]
        if isinstance(r["removed"], str):
            gone = {int(m.split(":")[0]): tuple(map(int, m.split(":")[1:])) for m in r["removed"].split(",") if m}
        else:
            gone = {m["line"]: (m["class_doc"], m["class_line"]) for m in r["removed"] or [] if m["removed"]}
            assert all((m["match_doc"], m["match_line"]) in want[r["doc_id"], m["line"]] for m in r["removed"] or [] if m["removed"])
            assert r["clean"] == (None if text is None else "\n".join(l for i, l in enumerate(text.split("\n")) if i not in gone))
        got |= {(r["doc_id"], i) for i in gone}
        words = lambda d, i: set(texts[d].split("\n")[i].split())
        assert all(words(r["doc_id"], i) == words(*first) for i, first in gone.items())
        assert r["n_removed"] == len(gone)
    assert got == want.keys()


def test_line_dedup_query(spark, data, texts):
    check_lines(op2_line_dedup(spark, data).collect(), texts)
    check_lines(deduplicate(spark.read.parquet(f"{data}/documents.parquet")).select("row.doc_id", "clean", "n_removed", F.col("matched").alias("removed")).collect(), texts)


def test_line_dedup_near_lines(spark):
    """Lines of few words, that resemble each other in groups."""
    rng = random.Random(6)
    base = [[f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 16))] for _ in range(40)]
    texts = {}
    for d in range(60):
        lines = []
        for _ in range(4):
            w = list(rng.choice(base))
            if rng.random() < 0.5:
                w[rng.randrange(len(w))] = f"w{rng.randrange(60)}"
            lines.append(" ".join(w))
        texts[d] = "\n".join(lines)
    rows = deduplicate(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).select("row.doc_id", "clean", "n_removed", F.col("matched").alias("removed")).collect()
    check_lines(rows, texts)


def test_line_dedup_odd_rows(odd, none_of):
    rows = deduplicate(odd).select("row.doc_id", "row.text", "clean", "n_lines", "n_removed").collect()
    assert len(rows) == odd.count()
    assert all(r["clean"] is None for r in rows if r["text"] is None)
    assert {r["clean"] for r in rows if r["doc_id"] == 9} == {"the same line of six words\n"}
    assert {r["clean"] for r in rows if r["doc_id"] is None} == {"no id here"}
    assert deduplicate(none_of).count() == 0


def test_templates_do_not_meet(spark):
    """Lines of a template with two changing words of twelve are all below the threshold and share ten words: what the join of unsettled classes makes grows with their number, not its square."""
    join, made = op2._Join(75), []
    for m in (500, 2000):
        rows = spark.range(m).select(F.col("id").alias("node"), F.lit(12).alias("n"), F.array(F.concat(F.lit("id"), F.col("id")), F.concat(F.lit("time"), F.col("id")), F.lit("a"), F.lit("b")).alias("prefix"))
        entries = rows.select("node", "n", F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("s1"), F.lit(False).alias("settled"), F.posexplode("prefix").alias("at", "token"))
        made.append(op2.unsettled(entries, join).count())
    assert made == [0, 0]
    texts = {i: "\n".join(f"user {i}-{k} has logged in at {i}:{k}:{i * k % 7} from the main front door" for k in range(40)) for i in range(30)}
    texts[30] = "user 3-5 has logged in at 3:5:1 from the main front door"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want = line_oracle(texts)
    got = {(r.r_doc, r.r_line) for r in line_matches(df).where("removed").collect()}
    assert got == set(want)


def test_words_are_joined_in_parts(spark, monkeypatch):
    """Entries of one part of the words are dealt out at a time: no join holds most of them, and together they are all."""
    held, join = [], op2.unsettled
    monkeypatch.setattr(op2, "unsettled", lambda entries, j: held.append({tuple(r) for r in entries.select("node", "token").collect()}) or join(entries, j))
    texts = {i: "\n".join(" ".join(f"w{(7 * i + k * k + j) % 90}" for j in range(8)) for k in range(6)) for i in range(30)}
    got = {(r.r_doc, r.r_line) for r in line_matches(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).where("removed").collect()}
    assert got == set(line_oracle(texts))
    together = set().union(*held)
    assert sum(map(len, held)) == len(together) > 100 and max(map(len, held)) < len(together) / 2
