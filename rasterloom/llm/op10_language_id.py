"""Operator 10: language identification in two steps, family first, then one-versus-one linear support vector machines.

Features are hashed counts of byte pairs and triples of the lower-cased text, scaled to unit length. A one-versus-rest
machine per family picks the family; within it, a machine per pair of languages votes. Families of well-known languages
are given; a language without one joins the family whose languages' mean features are nearest to its own. The training sample is at most
`per_language` distinct texts a language, one at least, drawn by a hash of the text, and comes to the driver as fixed-size vectors.

Defined results: a null text, or one without a letter, is `und` with score 0; where nothing is labelled every text is
`und`; where one language is labelled, texts with a letter get it with score 1; ties go to the language first in
alphabetical order; repeated rows each get a row; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..packaging import ship
from .shared import documents, map_arrow, release

#: Families of languages by their two-letter codes.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy".split(),
    "romance": "fr es it pt ro ca gl oc".split(),
    "slavic": "ru uk pl cs sk bg sr hr sl mk be bs".split(),
    "uralic": "fi et hu".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indic": "hi bn ur mr gu pa ne".split(),
    "semitic": "ar he mt am".split(),
    "sinitic": "zh".split(),
}
#: Hashed features; training rows a language and in all, a documented bound of the sample.
SLOTS, PER_LANGUAGE, MOST_ROWS = 4096, 400, 8000


def counts(text: str) -> np.ndarray:
    """Counts of byte pairs and triples of the whole text, by slot."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    total = np.zeros(SLOTS, np.float32)
    for start in range(0, len(b), 1 << 16):  # in blocks that overlap by two bytes, so that long texts need no more memory
        block = b[start : start + (1 << 16) + 2]
        pair = block[:-1] << 8 | block[1:]
        triple = pair[:-1] << 8 | block[2:]
        pair = pair[: 1 << 16]
        slots = np.concatenate([pair * np.uint32(2654435761) >> 20, triple * np.uint32(2246822519) >> 20])
        total += np.bincount(slots, minlength=SLOTS)
    return total


def vector(text: str) -> np.ndarray:
    x = np.sqrt(counts(text))
    return x / (np.linalg.norm(x) or 1)


def train_svm(x: np.ndarray, positive: np.ndarray, cost: float = 10.0, rounds: int = 20, seed: int = 3) -> np.ndarray:
    """Weights (the bias last) of a linear support vector machine by dual coordinate descent."""
    y, w, a = np.where(positive, 1.0, -1.0), np.zeros(x.shape[1] + 1), np.zeros(len(x))
    square, random = np.einsum("ij,ij->i", x, x, dtype=np.float64) + 1, np.random.default_rng(seed)
    for _ in range(rounds):
        for i in random.permutation(len(x)):
            row = x[i].astype(np.float64)  # one at a time: a copy of all would be most of the driver's memory
            new = min(max(a[i] - (y[i] * (row @ w[:-1] + w[-1]) - 1) / square[i], 0.0), cost)
            if new != a[i]:
                step = (new - a[i]) * y[i]
                w[:-1] += step * row
                w[-1] += step
                a[i] = new
    return w


class Model:
    """Families, a machine per family and one per pair of languages of a family, all as columns of one weight matrix."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        y = np.array(langs)
        means = {l: x[y == l].mean(0) for l in self.langs}
        known = {l: f for f, members in FAMILIES.items() for l in members}
        family = {l: known[l] for l in self.langs if l in known}
        for l in self.langs:
            if l not in family:
                near = max((o for o in self.langs if o in known), key=lambda o: float(means[l] @ means[o]), default=None)
                family[l] = family[near] if near and float(means[l] @ means[near]) > 0.8 else f"own:{l}"
        self.families = {f: [l for l in self.langs if family[l] == f] for f in sorted(set(family.values()))}
        of_row = np.array([family[l] for l in langs])
        columns = [train_svm(x, of_row == f) for f in self.families] if len(self.families) > 1 else []
        self.pairs = {f: list(itertools.combinations(m, 2)) for f, m in self.families.items()}
        self.at = {}
        for f, pairs in self.pairs.items():
            self.at[f] = len(columns)
            for a, b in pairs:
                rows = (y == a) | (y == b)
                columns.append(train_svm(x[rows], y[rows] == a))
        self.weights = np.array(columns, np.float32).reshape(len(columns), SLOTS + 1).T.copy()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not text or not any(map(str.isalpha, text)):
            return "und", 0.0
        margins = vector(text) @ self.weights[:-1] + self.weights[-1] if self.weights.shape[1] else np.empty(0)
        sure = lambda m: float(1 / (1 + np.exp(-4 * np.clip(m, -20, 20))))
        names, score = list(self.families), 1.0
        best = names[0]
        if len(names) > 1:
            best = names[int(np.argmax(margins[: len(names)]))]
            score = sure(margins[names.index(best)])
        votes = dict.fromkeys(self.families[best], 0.0)
        won = {l: [1.0] for l in votes}
        for k, (a, b) in enumerate(self.pairs[best]):
            m = float(margins[self.at[best] + k])
            votes[a if m >= 0 else b] += 1
            won[a].append(sure(m)), won[b].append(sure(-m))
        lang = max(sorted(votes), key=votes.__getitem__)
        return lang, min(1.0, max(0.0, score * min(won[lang])))


def sample(labelled: DataFrame, lang_col: str, text_col: str, per_language: int, most_rows: int) -> DataFrame:
    """lang, text: of each language's distinct texts those with the least hashes, one at least, `per_language` at most, and about `most_rows` in all. What is drawn from is thinned before anything is sorted."""
    rows = labelled.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumn("h", F.pmod(F.xxhash64("text", F.lit(11)), F.lit(1 << 30)))
    each = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("texts"), F.min("h").alias("least")).collect()  # a row a language
    share = min(per_language, max(1, most_rows // max(1, len(each))))
    # Twice as many as are taken, as a draw by hashes varies; the row of the least hash in any case.
    bounds = [(r["lang"], max(r["least"], min(1 << 30, (1 << 30) * (2 * share + 20) // max(1, r["texts"])))) for r in each]
    bounds = labelled.sparkSession.createDataFrame(bounds, "lang string, bound long")
    drawn = rows.join(F.broadcast(bounds), "lang").where("h <= bound").select("lang", "text", "h").dropDuplicates(["lang", "text"])
    return drawn.withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("nth") <= share).select("lang", "text")


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", per_language: int = PER_LANGUAGE, most_rows: int = MOST_ROWS) -> Model:
    """Trains on a bounded sample of labelled rows that hold a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows = [(l, vector(t).astype(np.float16).tobytes()) for l, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary())], ["lang", "x"])

    ship(labelled.sparkSession)
    lettered = labelled.where(F.rlike(F.col(f"`{text_col}`").cast("string"), F.lit(r"\p{L}")))
    got = sample(lettered, lang_col, text_col, per_language, most_rows).mapInArrow(run, "lang string, x binary")
    rows = sorted(got.collect(), key=lambda r: (r["lang"], r["x"]))  # no more than the sample's bound, or one a language
    x, langs = np.empty((len(rows), SLOTS), np.float32), [r["lang"] for r in rows]
    for i, r in enumerate(rows):
        x[i] = np.frombuffer(r["x"], np.float16)
    del rows
    model = Model(x, langs)
    del x
    release()
    return model


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred string, score double."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                got = [model.predict(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    ship(df.sparkSession)
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), (held_out if held_out is not None else F.lit(False)).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")


def predict_rows(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """row (a struct of df's columns), lang_pred string, score double. Only texts go to Python."""
    ship(df.sparkSession)

    @F.arrow_udf("struct<lang_pred string, score double>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            for texts in batches:
                got = [model.predict(t) for t in texts.to_pylist()]
                yield pa.StructArray.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["lang_pred", "score"])
        finally:
            release()

    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), judged(F.col(f"`{text_col}`").cast("string")).alias("p"))
    return rows.select("row", "p.*")


def in_fold(doc_id: Column) -> Column:
    """Whether a document is held out: crc32 of its id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~in_fold(F.col("doc_id"))))
    return predict(docs, model, held_out=in_fold(F.col("doc_id")))
