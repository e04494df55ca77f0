"""Operator 12: collocations of two words and more, mined level by level with bucket counts (PCY, DHP) and Apriori pruning.

A pass over the texts for each length k counts the k-grams exactly and, into hash buckets, the (k + 1)-grams that may follow. Between passes two
bitmaps of bounded size are broadcast: the buckets of (k + 1)-grams that reached the support, and the hashes of the k-grams that
are frequent. The next pass counts an n-gram only where its bucket's bit and the bits of both its shorter parts are set. Bitmaps only rule out what can't
be frequent; what is counted is counted by its words, so results are exact. Counts are added up per task before
they are shuffled, so a frequent phrase is a row per task.

Everything is per language. A phrase's score is the least, over all cuts into two parts, of 1000 a n / (l r), with a, l and r the occurrences of phrase, first part and rest
and n all words; arithmetic is in decimals of 38 digits. A phrase inside a longer frequent phrase that occurs about as often is dropped.

Defined results: null texts are empty; null languages are `und`; a piece without words has no phrases; repeated rows count each; ties go by phrase in byte order; extra columns
are left out; an empty table gives an empty result. Bitmaps have a bit per 16 bytes of text, 2^28 at most: with fuller bitmaps passes count more, with the same results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..packaging import ship
from .bitmaps import CHUNK, SPARSE, gathered, is_set, merged, power_of_two, sparse_counts
from .shared import Scratch, by_size, documents, map_arrow

LONGEST, SUPPORT, TOP = 5, 100, 2000
#: Share of its occurrences that a longer phrase has to have to make a shorter one superfluous, in percent.
COVERED = 100
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Separators of pieces become full stops, tabs become spaces.
_TABLE = bytes.maketrans(b".,;:!?\n\x0b\x0c\r\t", b".......... ")
#: Tokens counted at a time, bytes of a text split at a time, and distinct words remembered.
_HELD, _PART, _WORDS = 1 << 20, 1 << 22, 1 << 19
_OUT = "lang string, phrase binary, n long, " + SPARSE


class Words(dict):
    """Numbers of words in the order in which they are met; a full stop, which no word holds, is -1."""

    def __init__(self):
        super().__init__({b".": -1})
        self.known: list[bytes] = []
        self.hashes = np.empty(0, np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.known)
        self.known.append(word)
        return n

    def hashed(self) -> np.ndarray:
        new = self.known[len(self.hashes) :]
        if new:
            self.hashes = np.concatenate([self.hashes, np.fromiter(map(xxhash.xxh3_64_intdigest, new), np.uint64, len(new))])
        return self.hashes


def parts(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text and a full stop between pieces, a few megabytes at a time."""
    text = (text or b"").lower().translate(_TABLE)
    start = 0
    while start < len(text):
        end = text.find(b".", start + _PART)
        end = len(text) if end < 0 else end
        yield text[start:end].replace(b".", b" . ").split()
        start = end


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = (a ^ b) * _MULTIPLIER
    return out ^ (out >> np.uint64(29))


def gram_hashes(words: np.ndarray, lang: np.ndarray, k: int) -> list[np.ndarray]:
    """Hashes of the 1- to k-grams of a language that begin at each place, from hashes of words."""
    out = [mix(lang, words)]
    for j in range(1, k):
        last = out[-1]
        out.append(mix(last[: max(0, len(last) - 1)], words[j:]))
    return out


class Pass:
    """One pass: exact counts of k-grams, bucket counts of (k + 1)-grams. `likely`: the bitmap of the k-grams' buckets; `frequent`: that of the frequent (k - 1)-grams; both None for words."""

    def __init__(self, k: int, longest: int, support: int, buckets: int, likely: np.ndarray | None, frequent: np.ndarray | None):
        self.k, self.longest, self.support, self.mask, self.likely, self.frequent = k, longest, support, np.uint64(buckets - 1), likely, frequent
        self.words, self.langs = Words(), {}
        self.ids: list[np.ndarray] = []
        self.lang_of: list[int] = []
        self.n = 0

    def add(self, text: bytes | None, lang: str) -> Iterator[pa.RecordBatch]:
        code = self.langs.setdefault(lang, len(self.langs))
        for tokens in parts(text):
            ids = np.append(np.fromiter(map(self.words.__getitem__, tokens), np.int64, len(tokens)), -1)  # a part ends where a piece does
            self.ids.append(ids)
            self.lang_of.append(code)
            self.n += len(ids)
            if self.n >= _HELD:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        ids, lang = np.concatenate(self.ids), np.repeat(np.array(self.lang_of), [len(x) for x in self.ids])
        names = list(self.langs)
        word, full = np.append(self.words.hashed(), np.uint64(0))[ids], ids >= 0
        own = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in names), np.uint64, len(names))[lang]
        grams = gram_hashes(word, own, min(self.k + 1, self.longest))
        whole = [full]
        for j in range(1, len(grams)):
            whole.append(whole[-1][:-1] & full[j:])
        at = np.flatnonzero(whole[self.k - 1])
        if self.likely is not None:
            at = at[is_set(self.likely, grams[self.k - 1][at] & self.mask)]
            shorter = grams[self.k - 2] & self.mask
            at = at[is_set(self.frequent, shorter[at])]
            at = at[is_set(self.frequent, shorter[at + 1])]
        if len(at):
            yield self._counted(ids, lang, names, at)
        if self.k < self.longest:
            may = np.zeros(len(whole[self.k - 1]) + 1, bool)
            may[at] = True
            longer = np.flatnonzero(whole[self.k] & may[: len(whole[self.k])] & may[1 : len(whole[self.k]) + 1])  # both parts may be frequent
            if len(longer):
                sparse = sparse_counts(grams[self.k][longer] & self.mask, self.support)
                none = [pa.nulls(sparse.num_rows, t) for t in (pa.string(), pa.binary(), pa.int64())]
                yield pa.RecordBatch.from_arrays([*none, *sparse.columns], ["lang", "phrase", "n", *sparse.schema.names])
        self.ids, self.lang_of, self.n = [], [], 0
        if len(self.words.known) > _WORDS:
            self.words = Words()
        if len(self.langs) > _WORDS:
            self.langs = {}

    def _counted(self, ids: np.ndarray, lang: np.ndarray, names: list[str], at: np.ndarray) -> pa.RecordBatch:
        """Counts of the k-grams at some places, by their words; for words also all occurrences of each language, with a null phrase."""
        key, size = lang[at], len(names)
        for j in range(self.k):
            if size * (len(self.words.known) + 1) >= 1 << 62:
                met, key = np.unique(key, return_inverse=True)
                size = len(met)
            key, size = key * len(self.words.known) + ids[at + j], size * len(self.words.known)
        _, first, counts = np.unique(key, return_index=True, return_counts=True)
        first = at[first]
        known = self.words.known
        columns = [ids[first + j].tolist() for j in range(self.k)]
        phrases = [known[i] for i in columns[0]] if self.k == 1 else [b" ".join([known[i] for i in row]) for row in zip(*columns)]
        langs, counts = [names[i] for i in lang[first].tolist()], counts.tolist()
        if self.k == 1:
            for code, n in zip(*(x.tolist() for x in np.unique(lang[at], return_counts=True))):
                langs.append(names[code])
                phrases.append(None)
                counts.append(n)
        n = len(counts)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(phrases, pa.binary()), pa.array(counts, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], ["lang", "phrase", "n", "chunk", "offsets", "counts"])


def _passed(docs: DataFrame, k: int, longest: int, support: int, buckets: int, bitmaps) -> DataFrame:
    """What one pass over (lang, text binary) finds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = Pass(k, longest, support, buckets, *(bitmaps.value if bitmaps else (None, None)))
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from work.add(text.as_py(), lang)
        yield from work.flush()

    return map_arrow(docs, run, _OUT)


def _hash_buckets(frequent: DataFrame, buckets: int) -> DataFrame:
    """The buckets of frequent phrases, as sparse counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.fromiter(map(xxhash.xxh3_64_intdigest, phrase.split(b" ")), np.uint64)
                own = np.full(len(words), xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")), np.uint64)
                out.append(gram_hashes(words, own, len(words))[-1][0])
            if out:
                yield sparse_counts(np.array(out, np.uint64) & np.uint64(buckets - 1), 1)

    return map_arrow(frequent.select("lang", "phrase"), run, SPARSE)


def frequent_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, support: int = SUPPORT, most_buckets: int = 1 << 28, scratch: Scratch | None = None) -> DataFrame:
    """lang, phrase binary, k int (words), n long (occurrences, support or more); rows with a null phrase and k 0 have all words of a language."""
    if not 1 <= support <= 255:
        raise ValueError("support is a number from 1 to 255")
    spark = df.sparkSession
    ship(spark)
    scratch = scratch or Scratch(spark, "phrases")
    docs = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).where("text is not null")
    buckets = power_of_two((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 16, CHUNK, most_buckets)
    levels, bitmaps = [], None
    for k in range(1, longest + 1):
        found = scratch.table(f"pass-{k}", _passed(docs, k, longest, support, buckets, bitmaps))
        counts = found.where("lang is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= support) | F.col("phrase").isNull())
        counts = scratch.table(f"frequent-{k}", counts.select("lang", "phrase", F.when(F.col("phrase").isNull(), F.lit(0)).otherwise(F.lit(k)).alias("k"), "n"))
        levels.append(counts)
        if bitmaps is not None:
            bitmaps.unpersist()
        if k == longest or counts.where("k > 0").isEmpty():
            break
        likely = gathered(merged(found.where("chunk is not null").select("chunk", "offsets", "counts"), support), buckets)
        frequent = gathered(merged(_hash_buckets(counts.where("k > 0"), buckets), 1), buckets)
        bitmaps = spark.sparkContext.broadcast((likely, frequent))  # 2 * buckets / 8 bytes
        scratch.drop(f"pass-{k}")
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, support: int = SUPPORT, top: int = TOP, covered: int = COVERED, most_buckets: int = 1 << 28) -> DataFrame:
    """lang, rank (from 1) long, phrase string, a, l, r, n, score long: the `top` phrases of each language."""
    scratch = Scratch(df.sparkSession, "phrases")
    found = frequent_phrases(df, text_col, lang_col, longest, support, most_buckets, scratch)
    found = scratch.table("frequent", found.withColumn("phrase", F.col("phrase").cast("string")))
    totals = by_size(found.where("k = 0").select("lang", F.col("n").alias("words")))
    known = by_size(scratch.table("known", found.where("k > 0").select("lang", "phrase", F.col("n").alias("f"))))
    long = found.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"))
    words = long.withColumn("w", F.split("phrase", " "))
    joined = lambda start, n: F.array_join(F.slice("w", start, n), " ")
    # A phrase with two words more that covers this one does so through one with one word more, which occurs as often as it at least.
    longer = words.where("k > 2").select("lang", F.explode(F.array(joined(F.lit(1), F.col("k") - 1), joined(F.lit(2), F.col("k") - 1))).alias("phrase"), "a")
    longer = scratch.table("longer", longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    left = words.join(by_size(longer), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    cuts = left.select("lang", "phrase", "k", "w", "a", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")).select("lang", "phrase", "a", "cut", joined(F.lit(1), F.col("cut")).alias("first"), joined(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"]).join(known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"]).join(totals, "lang")
    exact = lambda c: f"cast({c} as decimal(18,0))"
    cuts = cuts.withColumn("score", F.expr(f"(1000 * {exact('a')} * {exact('words')}) div ({exact('l')} * {exact('r')})"))
    scored = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r")).alias("least"), F.first("a").alias("a"), F.first("words").alias("n")).select("lang", "phrase", "a", "least.l", "least.r", "n", "least.score")
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


#: The query's rows in DuckDB's SQL: all phrases of up to five words, without any pruning.
OP12_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
p AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, k, list_slice(w, i, i + k - 1) AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, range(1, 6) t(k))),
f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM p GROUP BY lang),
longer AS (SELECT lang, x AS phrase, max(a) AS a FROM (SELECT lang, a, unnest([list_slice(phrase, 1, k - 1), list_slice(phrase, 2, k)]) AS x FROM f WHERE k > 2) GROUP BY ALL),
c AS (SELECT f.*, unnest(range(1, f.k)) AS cut FROM f LEFT JOIN longer USING (lang, phrase) WHERE f.k > 1 AND (longer.a IS NULL OR longer.a < f.a)),
s AS (SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, n.n, CAST(1000 * CAST(c.a AS HUGEINT) * n.n // (CAST(x.a AS HUGEINT) * y.a) AS BIGINT) AS score
  FROM c JOIN f x ON x.lang = c.lang AND x.phrase = list_slice(c.phrase, 1, c.cut) JOIN f y ON y.lang = c.lang AND y.phrase = list_slice(c.phrase, c.cut + 1, c.k) JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS BIGINT) AS rank, array_to_string(phrase, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, score
FROM b QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) <= 2000
"""
