"""Exact dedup against brute force."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rasterloom.llm.op13_bloom_dedup import SLICE_ROWS, drop_duplicates, exact_duplicates

SCHEMA = "doc_id long, text string, digest string, chunk int, given string"


def lowered(text):
    return (text or "").encode().lower()


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[lowered(r[1])].append(r[0])
    return sorted(((i, max((x for x in groups[lowered(t)] if x is not None), default=None), len(groups[lowered(t)]), hashlib.sha256(lowered(t)).hexdigest()) for i, t, *_ in rows), key=str)


ROWS = [
    (1, "Same text", "a", 1, "x"), (9, "same TEXT", "b", 2, "y"), (4, "same text", "c", 3, "z"), (2, "ÄÖ", "", 0, ""), (3, "äö", "", 0, ""),
    (5, None, "", 0, ""), (6, "", "", 0, ""), (None, "same text", "", 0, ""), (None, "only null", "", 0, ""), (None, "only null", "", 0, ""), (None, "alone", "", 0, ""),
    (7, "twice", "", 0, ""), (7, "twice", "", 0, ""), (8, "long " * 200_000, "", 0, ""), (10, "Long " * 200_000, "", 0, ""), (11, " same text", "", 0, ""), (12, "same text ", "", 0, ""),
]


@pytest.mark.parametrize("slice_rows", [SLICE_ROWS, 4])
def test_odd_rows(spark, slice_rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = exact_duplicates(df, slice_rows=slice_rows)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    rows = got.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in rows), key=str) == brute(ROWS)
    assert all(r.keep_id == r.doc_id for r in rows if r.kept)
    kept = [r.text_sha256 for r in rows if r.kept]
    assert len(kept) == len(set(kept)) == len({lowered(r[1]) for r in ROWS})  # one row of each text, repeated rows included


@pytest.mark.parametrize("slice_rows", [SLICE_ROWS, 5])
def test_rows_that_stay(spark, slice_rows):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = drop_duplicates(df, slice_rows=slice_rows)
    assert got.columns == df.columns
    rows = got.collect()
    ids = {lowered(r[1]): set() for r in ROWS}
    for i, t, *_ in ROWS:
        ids[lowered(t)].add(i)
    assert sorted(lowered(r.text) for r in rows) == sorted(ids)
    assert all(r.doc_id == max((x for x in ids[lowered(r.text)] if x is not None), default=None) for r in rows)
    assert {tuple(r) for r in rows} <= set(ROWS)


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(df).count() == drop_duplicates(df).count() == 0


def test_many_texts_and_a_hot_one(spark):
    df = spark.range(40_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("Hot")).otherwise(F.concat(F.lit("text "), (F.col("id") % 25_000).cast("string"))).alias("text"))
    rows = [tuple(r) for r in df.collect()]
    got = exact_duplicates(df.repartition(7), slice_rows=9000)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()), key=str) == brute(rows)
    assert got.where("kept").count() == got.select("text_sha256").distinct().count()


def test_most_texts_pass_straight_through(spark):
    from rasterloom.llm.op13_bloom_dedup import _hashed, asked, filters, text_hash
    from rasterloom.llm.shared import Scratch, ship

    ship(spark)
    df = spark.range(20_000).select(F.concat(F.lit("t"), F.when(F.col("id") < 19_000, F.col("id")).otherwise(F.col("id") - 1000).cast("string")).alias("text"))
    scratch = Scratch(spark, "t")
    keys = scratch.table("keys", _hashed(df.select(text_hash(F.col("text")).alias("digest")), 1))
    flagged = asked(keys, *filters(keys, scratch))
    assert 2000 <= flagged.where("perhaps").count() <= 2100  # 1,000 pairs, and few false alarms


def test_computed_input(spark):
    df = spark.range(3000).groupBy((F.col("id") % 900).alias("doc_id")).agg(F.concat(F.lit("T"), (F.min("id") % 400).cast("string")).alias("text")).repartition(5)
    rows = [(i, f"T{i % 400}") for i in range(900)]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_duplicates(df).collect()), key=str) == brute(rows)
