import os

import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return DATA


@pytest.fixture(scope="session")
def texts(data):
    """Texts of the smallest table by doc_id."""
    import pyarrow.parquet as pq

    t = pq.read_table(f"{data}/documents.parquet")
    return dict(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


LONG = "the quick brown fox jumps over a lazy dog " * 3000
ODD_TEXTS = [None, "", " ", "\n\n", "x", "one two three", "a b c d\x1ce\tf  g\n\n\nh ", "é日本語 😀😀" * 50, "zq" * 3000, "the same line of six words\n" * 40, LONG, "   leading and trailing   "]


@pytest.fixture
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, repeated and null ids, and columns whose names clash with those of operators."""
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 == 0 else "src") for i, t in enumerate(ODD_TEXTS)]
    rows += [rows[5], rows[5], (None, "no id here", None, None), (None, "no id here", None, None), (3, "another text under the id of three", "en", "src")]
    kind = "doc_id long, text string, lang string, source string, n_chars long, n_tokens long, ids string, row string, bands string, node long, `odd.name` string, tokens string, kept boolean"
    return spark.createDataFrame([(*r, len(r[1] or ""), 7, "ids", "row", None, 1, "dot", "t", False) for r in rows], kind)


@pytest.fixture
def none_of(odd):
    """The same columns without rows."""
    return odd.where("false")
