"""Operator 11: hard negatives of anchors by vantage-point trees over norm-augmented vectors.

Scores are inner products of whole numbers. Every row gets one coordinate more, sqrt(M - |x|^2) with M the largest squared norm of its
block, and an anchor q a zero: then |q - x|^2 = |q|^2 + M - 2 q.x, so higher scores are nearer, and a window of scores is an annulus of
distances. Rows are dealt to blocks of bounded size, each with a tree of its own; anchors stream past each block. In a
tree, leaves that the annulus doesn't meet are left out, the rest are visited nearest first from the inner radius outwards until no leaf
can hold a row better than the `k` found. Each block gives its best `k` an anchor, and the best of these are the result, so it is exact.

Of rows with the same label and the same vector only those with the k + 1 least ids can be among anyone's first k (one of them may be the anchor itself): the rest
are left out before the blocks are made, which keeps groups of copies small without changing any result.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; of rows that share an id the one with the
least label, then the least vector, takes part; vectors may differ in length (missing components are zeros); ties go by the smaller id; extra columns are left out; an
empty table gives an empty result. Components become whole numbers below 2^53; scores have to fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..packaging import ship
from .shared import Scratch, map_arrow

K = 5
LEAF = 64
#: Rows of a block: a 64th of all, within these bounds.
BLOCK_ROWS = (256, 1 << 16)
#: Anchors a task holds at a time.
ANCHORS = 256


class VantageTree:
    """A vantage-point tree of rows (ids, labels, whole-number vectors as float64 or exact objects)."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        norms = (self.vectors * self.vectors).sum(1).astype(float)
        self.most = norms.max(initial=0.0)
        self.slack = 1e-6 * (1 + np.sqrt(2 * self.most))  # bounds are floating-point numbers, scores aren't
        self._flat, self._extra = self.vectors.astype(float), np.sqrt(np.maximum(0, self.most - norms))
        #: Of each inner node: its vantage row, and for both children (node or ~leaf, least and greatest distance from the vantage row).
        self.vantage: list[int] = []
        self.children: list[list[tuple[int, float, float]]] = []
        self.leaves: list[np.ndarray] = []
        self._grow(np.arange(len(ids)), leaf)

    def _grow(self, rows: np.ndarray, leaf: int) -> None:
        """Splits by rank, so rows without any distance between them are split too."""
        todo = [(rows, None)]
        while todo:
            rows, place = todo.pop()
            if len(rows) <= leaf:
                at = ~len(self.leaves)
                self.leaves.append(np.sort(rows))
            else:
                at, v = len(self.vantage), self._farthest(rows)
                gaps = self._distances(v, rows)
                near = np.argsort(gaps, kind="stable")
                half = len(rows) // 2
                self.vantage.append(v)
                self.children.append([])
                for part in (near[:half], near[half:]):
                    todo.append((rows[part], (at, gaps[part].min(), gaps[part].max())))
            if place:
                self.children[place[0]].append((at, *place[1:]))

    def _distances(self, v: int, rows: np.ndarray) -> np.ndarray:
        apart = self._flat[rows] - self._flat[v]
        return np.sqrt((apart * apart).sum(1) + (self._extra[rows] - self._extra[v]) ** 2)

    def _farthest(self, rows: np.ndarray) -> int:
        """A row far from another: a vantage point at the edge tells rows apart better than one in the middle."""
        return int(rows[np.argmax(self._distances(int(rows[0]), rows))])

    def radii(self, squared: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Distances that belong to scores, of anchors with squared norms."""
        return np.sqrt(np.maximum(0.0, (squared + self.most - 2 * scores).astype(float)))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible distance of each anchor from the rows of each leaf."""
        squared = (anchors * anchors).sum(1)
        low, high = np.zeros((len(anchors), len(self.leaves))), np.full((len(anchors), len(self.leaves)), np.inf)
        if not self.vantage:
            return low, high
        away = self.radii(squared[:, None], anchors @ self.vectors[self.vantage].T)
        of_node = {0: (np.zeros(len(anchors)), np.full(len(anchors), np.inf))}
        for node, parts in enumerate(self.children):  # parents come before their children
            at_least, at_most = of_node.pop(node)
            for child, least, greatest in parts:
                d = away[:, node]
                box = np.maximum(at_least, np.maximum(least - d, d - greatest)), np.minimum(at_most, d + greatest)
                if child >= 0:
                    of_node[child] = box
                else:
                    low[:, ~child], high[:, ~child] = box
        return low, high

    def search(self, anchors: np.ndarray, anchor_ids: np.ndarray, anchor_labels: np.ndarray, most: np.ndarray, least: np.ndarray, same: bool, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores, k an anchor, of the nearest rows with score <= most and 5 * score >= 4 * least, of the anchor's label (and another id) or of others. Missing: score -inf."""
        n = len(anchors)
        ids, scores = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf, object if anchors.dtype == object else float)
        squared = (anchors * anchors).sum(1)
        inner, outer = self.radii(squared, np.minimum(most, squared.astype(float) + self.most)), self.radii(squared, np.maximum(0.8 * least, -self.most - squared.astype(float) - 1))
        low, high = self.bounds(anchors)
        met = (low <= outer[:, None] + self.slack) & (high >= inner[:, None] - self.slack)
        first = np.where(met, np.maximum(low, inner[:, None]), np.inf)  # nearest first, from the inner radius outwards
        order = np.argsort(first, axis=1, kind="stable")
        active, at, step = np.arange(n), 0, 1
        while len(active) and at < len(self.leaves):
            asked = order[active, at : at + step]
            farthest = self.radii(squared[active], scores[active, -1]) if at else np.full(len(active), np.inf)
            farthest = np.where(scores[active, -1] > -np.inf, farthest, np.inf)
            open_ = first[active[:, None], asked] <= np.minimum(farthest + self.slack, 1e300)[:, None]
            who, which = active[np.nonzero(open_)[0]], asked[open_]
            for leaf in np.unique(which):
                self._visit(leaf, who[which == leaf], anchors, anchor_ids, anchor_labels, most, least, same, ids, scores)
            active = active[open_[:, -1]] if open_.shape[1] else active[:0]  # what comes later is no nearer
            at, step = at + step, 2 * step
        return ids, scores

    def _visit(self, leaf: int, who: np.ndarray, anchors, anchor_ids, anchor_labels, most, least, same: bool, ids: np.ndarray, scores: np.ndarray) -> None:
        rows, k = self.leaves[leaf], ids.shape[1]
        found = anchors[who] @ self.vectors[rows].T
        alike = self.labels[rows][None] == anchor_labels[who][:, None]
        fits = (found <= most[who][:, None]) & (5 * found >= 4 * least[who][:, None])
        fits &= alike & (self.ids[rows][None] != anchor_ids[who][:, None]) if same else ~alike
        found = np.where(fits, found, -np.inf)
        best = np.argsort(-found, axis=1, kind="stable")[:, :k]  # rows of a leaf are in the order of ids
        both = np.concatenate([scores[who], np.take_along_axis(found, best, 1)], 1)
        names = np.concatenate([ids[who], self.ids[rows][best]], 1)
        names = np.where(both > -np.inf, names, np.iinfo(np.int64).max)
        keep = np.lexsort((names, -both.astype(float))) if both.dtype != object else np.array([sorted(range(len(b)), key=lambda j: (-b[j], m[j])) for b, m in zip(both, names)]).reshape(both.shape)
        scores[who], ids[who] = np.take_along_axis(both, keep, 1)[:, :k], np.take_along_axis(names, keep, 1)[:, :k]


def matrix(vectors: list, width: int) -> np.ndarray:
    """Rows of one width; of objects where sums of products might not be exact otherwise."""
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : min(len(v), width)] = v[:width]
    largest = max(1, abs(int(out.max(initial=0))), abs(int(out.min(initial=0))))
    return out.astype(float) if 5 * largest * largest * max(1, width) < 1 << 52 else out.astype(object)


@dataclass
class Block:
    """Rows of one block as they come, then their tree."""

    number: int
    ids: list
    labels: list
    vectors: list
    tree: VantageTree | None = None

    def grown(self) -> VantageTree:
        if self.tree is None:
            self.width = max(map(len, self.vectors), default=0)
            self.tree = VantageTree(np.array(self.ids, np.int64), np.array(self.labels, np.int64), matrix(self.vectors, self.width))
        return self.tree


_IN = "block int, anchor boolean, id long, label long, v array<long>, w_ids array<long>, w_scores array<long>"
_OUT = "anchor_id long, window_id long, window_score long, found_id long, score long"


def _stream(k: int, same: bool, windowed: bool):
    """Blocks' rows, then their anchors, as they come sorted: the best k rows of each block for each window of each anchor."""

    def best(block: Block, anchors: list) -> pa.RecordBatch | None:
        if not block.ids:
            return None
        tree = block.grown()
        owner = np.repeat(np.arange(len(anchors)), [len(a[3]) for a in anchors])
        vectors = matrix([a[2] for a in anchors], block.width)
        if tree.vectors.dtype == object or vectors.dtype == object:
            vectors, tree.vectors = vectors.astype(object), tree.vectors.astype(object)
            vectors, tree.vectors = (np.array([[int(x) for x in r] for r in m], object).reshape(m.shape) for m in (vectors, tree.vectors))
        ids, labels = np.array([a[0] for a in anchors], np.int64), np.array([a[1] for a in anchors], np.int64)
        w_ids, w_scores = (np.array([x for a in anchors for x in a[i]], np.int64) for i in (3, 4))
        most, least = (w_scores.astype(vectors.dtype),) * 2 if windowed else (np.full(len(owner), np.inf), np.full(len(owner), -np.inf))
        found, scores = tree.search(vectors[owner], ids[owner], labels[owner], most, least, same, k)
        row, column = np.nonzero(scores > -np.inf)
        out = [ids[owner][row], w_ids[row], w_scores[row], found[row, column], np.array([int(x) for x in scores[row, column]], np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["anchor_id", "window_id", "window_score", "found_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = Block(-1, [], [], []), []
        for batch in batches:
            for number, anchor, i, label, v, w_ids, w_scores in zip(*(batch.column(c).to_pylist() for c in range(7))):
                if held and (number != block.number or len(held) == ANCHORS):
                    if (out := best(block, held)) is not None:
                        yield out
                    held = []
                if number != block.number:
                    block = Block(number, [], [], [])
                if anchor:
                    held.append((i, label, v, w_ids, w_scores))
                else:
                    block.ids.append(i)
                    block.labels.append(label)
                    block.vectors.append(v)
        if held and (out := best(block, held)) is not None:
            yield out

    return run


def vectors(df: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """id, label, v array<long>: a row per id, of rows that take part."""
    given = F.col(f"`{vector_col}`").cast("array<double>")
    whole = F.transform(given, lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    sound = ~F.exists(given, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), label.cast("long").alias("label"), F.when(sound, whole).alias("v")).where("id is not null and label is not null and v is not null")
    return rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("r")).select("id", "r.*")


def _searched(rows: DataFrame, anchors: DataFrame, blocks: int, k: int, same: bool) -> DataFrame:
    """The best k of all blocks for each window: anchor_id, window_id, window_score, found_id, score, rank."""
    dealt = rows.select("block", F.lit(False).alias("anchor"), "id", "label", "v", F.lit(None).cast("array<long>").alias("w_ids"), F.lit(None).cast("array<long>").alias("w_scores"))
    asking = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(True).alias("anchor"), "id", "label", "v", "w_ids", "w_scores")
    found = map_arrow(dealt.unionByName(asking).repartition("block").sortWithinPartitions("block", "anchor"), _stream(k, same, not same), _OUT)
    order = Window.partitionBy("anchor_id", "window_id").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchors: Column | None = None, id_col: str = "vec_id", label: Column | None = None, vector_col: str = "embedding", scale: int = 256, k: int = K, block_rows: tuple[int, int] = BLOCK_ROWS) -> DataFrame:
    """anchor_id, positive_id long, rank int, negative_id, positive_score, negative_score long.

    anchors: a condition on `id` (ids divisible by 100); label: an expression of df's columns (its column label). Positives are an anchor's first k other rows of its label;
    negatives of a positive are the first k rows of other labels with 80 to 100 percent of its score.
    """
    ship(df.sparkSession)
    scratch = Scratch(df.sparkSession, "negatives")
    anchors = F.pmod("id", F.lit(100)) == 0 if anchors is None else anchors
    rows = scratch.table("rows", vectors(df, id_col, F.col("label") if label is None else label, vector_col, scale))
    copies = Window.partitionBy("label", "v").orderBy("id")
    rare = scratch.table("rare", rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy"))  # copies beyond are left out before the shuffle, too
    n = rare.count()
    blocks = -(-max(1, n) // min(block_rows[1], max(block_rows[0], n // 64)))
    dealt = rare.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asking = rows.where(anchors)
    one = F.array(F.lit(0).cast("long"))
    positives = _searched(dealt, asking.withColumns({"w_ids": one, "w_scores": one}), blocks, k, True)
    windows = positives.groupBy("anchor_id").agg(F.collect_list(F.struct("found_id", "score")).alias("w"))  # k of them
    windows = scratch.table("windows", windows.select("anchor_id", F.col("w.found_id").alias("w_ids"), F.col("w.score").alias("w_scores")))
    asking = asking.join(windows, F.col("id") == F.col("anchor_id")).drop("anchor_id")
    negatives = _searched(dealt, asking, blocks, k, False)
    return negatives.select("anchor_id", F.col("window_id").alias("positive_id"), "rank", F.col("found_id").alias("negative_id"), F.col("window_score").alias("positive_score"), F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), label=label)


#: The query's rows in DuckDB's SQL.
OP11_SQL = """
WITH e AS MATERIALIZED (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.id AS anchor_id, b.id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.id % 100 = 0 AND a.id <> b.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 5
"""
