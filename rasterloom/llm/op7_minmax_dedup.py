"""Operator 7: near-duplicate documents by min-max hashing.

Each permutation of the shingle hashes gives two signature values, its minimum and its maximum, so half as many hash
evaluations fill a signature. `bands` bands of `rows` values make bucket keys; a pair at the threshold of 0.75 misses
all of them with a probability of about (1 - 0.75^6)^80 = 1.5e-7. Links are confirmed on the full shingle sets.

Groups of copies stay cheap. Documents with equal sets are one class from the start. A class is compared with the
centre of each bucket it is in, the class whose bands meet most others; what is then in one component needs no more comparisons.
Only pairs of a bucket whose two components still differ are compared too. Before full sets are moved, odd
sketches (bits that flip with each element) rule out pairs: sketches never differ in more bits than the sets do in
elements, so no link between components is lost.

Defined results: null, empty or blank texts have an empty set and link with nothing; fewer than five words are one
shingle; repeated rows each get a row; rows with a null id take part as documents of their own without being a
component's name unless alone (then null); extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, bit_set, documents, in_bit_set, map_arrow, own

WORDS, THRESHOLD = 5, 75
BANDS, ROWS = 80, 6
#: Longs of the odd sketch of a set, and of the shorter one that goes with the entries of buckets.
SKETCH, SHORT = 32, 8
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of `words` words; one for a shorter text; none without words."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space only
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    n = min(words, len(h))
    with np.errstate(over="ignore"):
        rolled = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            rolled = (rolled ^ h[k : len(h) - n + 1 + k]) * _MULTIPLIER
            rolled ^= rolled >> np.uint64(29)
    return np.unique(rolled)


class MinMax:
    """Permutations of 32-bit hashes: an odd multiplier after an exclusive or."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 7):
        self.bands, self.rows, n = bands, rows, bands * rows // 2
        random = np.random.default_rng(seed)
        self.xor = random.integers(0, 1 << 32, (n, 1), np.uint32)
        self.times = random.integers(0, 1 << 31, (n, 1), np.uint32) * np.uint32(2) + np.uint32(1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """Minima of all permutations, then their maxima."""
        h = (hashes >> np.uint64(32)).astype(np.uint32)
        low = np.full(len(self.xor), 0xFFFFFFFF, np.uint32)
        high = np.zeros(len(self.xor), np.uint32)
        for start in range(0, len(h), 2048):
            part = h[start : start + 2048]
            for p in range(0, len(self.xor), 40):
                x = (part ^ self.xor[p : p + 40]) * self.times[p : p + 40]
                np.minimum(low[p : p + 40], x.min(1), out=low[p : p + 40])
                np.maximum(high[p : p + 40], x.max(1), out=high[p : p + 40])
        return np.concatenate([low, high])

    def keys(self, signature: np.ndarray) -> np.ndarray:
        """A 64-bit key per band, of `rows` values that come from as many permutations."""
        with np.errstate(over="ignore"):
            out = np.arange(self.bands, dtype=np.uint64) * _MULTIPLIER
            for column in signature.reshape(self.bands, self.rows).T:
                out = (out ^ column.astype(np.uint64)) * _MULTIPLIER
                out ^= out >> np.uint64(31)
        return out.view(np.int64)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit per slot that an odd number of hashes falls into. Two sketches differ in at most as many bits as their sets in elements."""
    counts = np.bincount((hashes % np.uint64(64 * SKETCH)).astype(np.int64), minlength=64 * SKETCH)
    return np.packbits((counts & 1).astype(np.uint8)).view(np.int64)


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles long, set_key binary (null for an empty set), bands array<long>, text_key long (a hash of the text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minmax = MinMax(bands, rows)
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                n, key, band = [], [], []
                for text in part.column(1).to_pylist():
                    hashes = shingle_set(text, words)
                    n.append(len(hashes))
                    key.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                    band.append(minmax.keys(minmax.signature(hashes)) if len(hashes) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(band, pa.list_(pa.int64())), part.column(2)], ["doc_id", "n_shingles", "set_key", "bands", "text_key"])

    return map_arrow(own(df, id_col, text_col).withColumn("text_key", F.xxhash64("text")), run, "doc_id long, n_shingles long, set_key binary, bands array<long>, text_key long")


def shingle_sets(df: DataFrame, words: int = WORDS) -> DataFrame:
    """set_key binary, hashes, sketch array<long> of doc_id, text; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                sets = [x for x in (shingle_set(t, words) for t in batch.column(1).slice(start, 1000).to_pylist()) if len(x)]
                keys = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets]
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64())), pa.array([odd_sketch(x) for x in sets], pa.list_(pa.int64()))], ["set_key", "hashes", "sketch"])

    return map_arrow(df, run, "set_key binary, hashes array<long>, sketch array<long>")


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, label: the least node of the connected component, for each node of the edges (a, b).

    Each round a node takes the least label around it, then its label's label; rounds grow with the logarithm of the
    longest path. Minima are combined before the shuffle, so a node with many edges is no hot spot.
    """
    scratch = scratch or Scratch(edges.sparkSession, "components")
    run = uuid.uuid4().hex
    both = scratch.table(f"{run}-edges", edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).select("node", F.least("node", "label").alias("label"))
    labels, rounds = scratch.table(f"{run}-0", labels), 0
    while True:
        around = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("around"))
        near = labels.join(around, "node").select("node", F.least("label", "around").alias("near"), F.col("label").alias("was"))
        of_label = labels.select(F.col("node").alias("near"), F.col("label").alias("beyond"))
        rounds += 1
        new = scratch.table(f"{run}-{rounds}", near.join(of_label, "near").select("node", F.least("near", "beyond").alias("label"), "was"))
        scratch.drop(f"{run}-{rounds - 1}")
        labels = new.select("node", "label")
        if new.where("label <> was").isEmpty():
            return labels


def shorter(sketch: str) -> Column:
    """The odd sketch of the same set with SHORT longs: slots that are equal modulo its bits flip together."""
    def folded(i: int) -> Column:
        out = F.get(sketch, F.lit(i))
        for k in range(i + SHORT, SKETCH, SHORT):
            out = out.bitwiseXOR(F.get(sketch, F.lit(k)))
        return out

    return F.array(*map(folded, range(SHORT)))


def possible(longs: int) -> Column:
    """Whether sets of n_a and n_b elements with sketch_a and sketch_b can meet the threshold: sets that do differ in at most (n_a + n_b) (1 - t) / (1 + t) elements."""
    differing = sum((F.bit_count(F.get("sketch_a", F.lit(i)).bitwiseXOR(F.get("sketch_b", F.lit(i)))) for i in range(longs)), F.lit(0))
    return (100 + THRESHOLD) * differing <= (100 - THRESHOLD) * (F.col("n_a") + F.col("n_b"))


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the pairs (a, b) of nodes, those whose full sets meet the threshold."""
    a, b = (sets.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}")) for s in "ab")
    pairs = pairs.join(a, "a").join(b, "b").where(possible(SKETCH)).select("a", "b")
    a, b = (sets.select(F.col("node").alias(s), F.col("hashes").alias(f"set_{s}")) for s in "ab")
    common = pairs.join(a, "a").join(b, "b").select("a", "b", F.size("set_a").alias("n_a"), F.size("set_b").alias("n_b"), F.size(F.array_intersect("set_a", "set_b")).alias("common"))
    return common.where(f"100 * common >= {THRESHOLD} * (n_a + n_b - common)").select("a", "b")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id long, kept boolean: a row per row of df."""
    return _verdicts(df, id_col, text_col, words, bands, rows).drop("text_key", "stays")


def _verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """As near_duplicates, with text_key long and `stays`: whether the row has the id and the text of the one document that stays of its component."""
    docs, scratch = own(df, id_col, text_col), Scratch(df.sparkSession, "near")
    found = scratch.table("found", features(docs, "doc_id", "text", words, bands, rows))
    first = lambda *c: F.struct(F.col(c[0]).isNull(), *c)  # noqa: E731  nulls come last
    classes = found.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("first_id"), F.min_by("text_key", first("doc_id", "text_key")).alias("first_text"), F.first("bands").alias("bands"))
    classes = scratch.table("classes", classes.withColumn("node", F.monotonically_increasing_id()))
    entries = classes.select("node", F.explode("bands").alias("key"))
    shared = scratch.table("shared", entries.join(entries.groupBy("key").count().where("count > 1"), "key"))
    scratch.drop()
    # A class that meets more others is the better centre: near copies all resemble their original more than each other.
    met = scratch.table("met", shared.groupBy("node").agg(F.sum("count").alias("met")))
    centres = shared.join(met, "node").groupBy("key").agg(F.max_by("node", F.struct("met", -F.col("node"))).alias("centre"))
    first_pairs = scratch.table("first_pairs", shared.join(centres, "key").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct())

    members = scratch.table("members", met.join(classes.select("node", "set_key", "first_id"), "node").select("node", "set_key", "first_id"))
    texts = docs.where(in_bit_set(bit_set(members, "first_id"), "doc_id")).join(members.select("first_id").distinct(), F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    sets = shingle_sets(texts, words).groupBy("set_key").agg(F.first("hashes").alias("hashes"), F.first("sketch").alias("sketch"))
    sets = scratch.table("sets", sets.join(members.select("set_key", "node"), "set_key").select("node", F.size("hashes").alias("n"), "hashes", "sketch"))
    scratch.drop("met", "members")
    edges = scratch.table("edges", linked(first_pairs, sets))
    labels = scratch.table("labels", components(edges, scratch))

    # What is left: pairs of a bucket in different components. In each bucket the label that most of its entries have is
    # on one side only, so a group of near copies isn't compared with itself. Entries carry short sketches; the full ones follow in `linked`.
    placed = shared.select("key", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    by_label = placed.groupBy("key", "label").count().groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    rest = placed.join(by_label.where("labels > 1").drop("labels"), "key").join(sets.select("node", "n", shorter("sketch").alias("sketch")), "node")
    rest = scratch.table("rest", rest)
    scratch.drop("shared")
    left, right = (rest.select("key", "main", *(F.col(x).alias(f"{x}_{side}") for x in ("node", "label", "n", "sketch"))) for side in "ab")
    met = left.where("label_a <> main").join(right.drop("main"), "key")
    once = (F.col("label_b") == F.col("main")) | (F.col("node_a") < F.col("node_b"))
    more_pairs = met.where((F.col("label_a") != F.col("label_b")) & once & possible(SHORT)).select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).distinct()
    more_edges = scratch.table("more_edges", linked(more_pairs.join(first_pairs, ["a", "b"], "left_anti"), sets))
    scratch.drop("rest", "first_pairs", "sets")
    if not more_edges.isEmpty():
        labels = scratch.table("all_labels", components(edges.union(more_edges), scratch))

    named = classes.select("set_key", "node", "first_id", "first_text").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"), F.min_by("first_text", first("first_id", "set_key")).alias("stays_text"))
    of_class = named.join(least, "label").select("set_key", "component_id", "stays_text")
    stays = F.col("set_key").isNull() | (F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("stays_text")))
    return found.select("doc_id", "n_shingles", "set_key", "text_key").join(of_class, "set_key", "left").select("doc_id", "n_shingles", "text_key", stays.alias("stays"), F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("doc_id").isNull() & F.col("component_id").isNull()))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, all columns, of the document that stays of each component; of rows with the same id and text each stays where that document does, of those with a null id and the same text one."""
    gone = Scratch(df.sparkSession, "gone").table("rows", _verdicts(df, id_col, text_col).where(~F.col("stays")).select(F.col("doc_id").alias("g_id"), F.col("text_key").alias("g_text")).distinct())
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    rows = rows.withColumns({"g_id": F.col(f"row.`{id_col}`").cast("long"), "text": F.col(f"row.`{text_col}`").cast("string")})
    may_go = F.col("g_id").isNull() | in_bit_set(bit_set(gone, "g_id"), "g_id")  # of the rest no text moves
    moved = rows.where(may_go).withColumn("r_text", F.xxhash64("text")).alias("r")
    on = F.col("r.g_id").eqNullSafe(F.col("g.g_id")) & (F.col("r_text") == F.col("g.g_text"))
    stay = moved.join(gone.alias("g"), on, "left_anti")
    copies = F.col("g_id").isNull() & F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    left = rows.where(~may_go).select("row").union(stay.where(~copies).select("row")).union(stay.where(copies).dropDuplicates(["r_text"]).select("row"))
    return left.select(*(F.col(f"row.`{c}`").alias(c) for c in df.columns))


def op7_minmax_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


#: The contract's rows in DuckDB's SQL: all pairs of distinct sets that share a shingle, then the least id that can be reached.
OP7_SQL = r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> '') AS words FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(list_slice(words, i, i + 4), ' ')))) END AS shingles FROM w),
c AS MATERIALIZED (SELECT shingles, min(doc_id) AS id, len(shingles) AS n FROM s WHERE len(shingles) > 0 GROUP BY shingles),
x AS MATERIALIZED (SELECT id, n, unnest(shingles) AS shingle FROM c),
e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.shingle = b.shingle AND a.id < b.id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
both_ways AS MATERIALIZED (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT id, id AS node FROM c UNION SELECT r.id, t.b FROM reach r JOIN both_ways t ON r.node = t.a),
comp AS MATERIALIZED (SELECT id, min(node) AS component_id FROM reach GROUP BY id)
SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(comp.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(comp.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON s.shingles = c.shingles LEFT JOIN comp ON comp.id = c.id
"""
