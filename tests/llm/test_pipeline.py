"""The corpus pipeline: stages against brute force on their own inputs."""

import re

import corpus_pipeline
import pytest

from helpers import line_oracle, near_groups


@pytest.fixture(scope="module")
def stages(spark, data):
    """Rows of documents, then of each stage."""
    docs, out = spark.read.parquet(f"{data}/documents.parquet"), []
    out.append(docs)
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], data).cache())
    return [d.collect() for d in out], [d.columns for d in out]


def test_columns(stages):
    rows, columns = stages
    assert all(c == columns[0] for c in columns[:-1]) and columns[-1] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_language(stages):
    before, after = stages[0][0], stages[0][1]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if re.search(r"[^\W\d_]", r["text"])}


def test_lines(stages):
    before, after = ({r["doc_id"]: r["text"] for r in stages[0][i]} for i in (1, 2))
    removed = set(line_oracle(before))
    want = {d: "\n".join(l for i, l in enumerate(t.split("\n")) if (d, i) not in removed) for d, t in before.items()}
    touched = {d for d, _ in removed}
    assert after == {d: t for d, t in want.items() if t.split() or d not in touched}


def test_near(stages):
    before, after = ({r["doc_id"]: r["text"] for r in stages[0][i]} for i in (2, 3))
    groups, _ = near_groups(before)
    assert after.keys() == {d for d, g in groups.items() if d == g}


def test_secrets(stages):
    before, after = ({r["doc_id"]: r["text"] for r in stages[0][i]} for i in (3, 4))
    assert before.keys() == after.keys()
    assert not any(re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", t) for t in after.values())
    assert all(after[d] == t for d, t in before.items() if not re.search(r"(?i)AKIA|[0-9a-f]{24}|password|passwd|secret|token|api_?key|\S{20}", t))


def test_packing(stages):
    before, after = stages[0][4], stages[0][5]
    assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before}
    used = {}
    for r in after:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in used.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_odd_rows(spark, odd, none_of):
    """Nulls, repeated rows and ids, long texts and clashing names pass all stages; no table is too small."""
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "").cache()
        assert docs.columns == odd.columns, name
        assert docs.where("text is null").count() == 0
    texts = [r["text"] for r in docs.collect()]
    plain = [t for t in texts if t.split()]
    assert set(plain) <= {r["text"] for r in odd.collect()} | {"the same line of six words\n"} and any(t.startswith("no id here") for t in texts) and "another text under the id of three" in texts
    assert corpus_pipeline.best_fit_packing(spark, docs, "").select("doc_id", "piece").count() >= len(texts)
    docs = none_of
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
