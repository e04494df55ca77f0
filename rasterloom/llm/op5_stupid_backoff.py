"""Operator 5: language-model scores by stupid backoff, from tables of n-gram counts that Spark deals out by hash.

The model is the corpus itself, each document scored by the counts of all others: for a word w after the `order` - 1 words
before it, S is c(context w) / c(context) if c(context w) > 0, else 0.4 S(w | context less its first word), and c(w) / N
without a context; counts are those of the corpus less the document's own. Words at a text's start have as much context as
there is, and no penalty for that. Every word counts as itself, by its 64-bit hash, and every n-gram by 96 bits made of the hashes of its words, so
nothing is capped or merged.

The texts are read once and written as groups of documents of some million words: the hashes of the distinct words, and the words as
numbers. A group asks for the counts of its distinct n-grams, each once, however many of its documents hold it; what is asked for is dealt out by ranges
of the key, added up there, and the totals go back in the order in which they were asked for, without keys. A join by group then brings totals and
words together; a document's own counts are taken off there. N-grams are asked for in parts of the key's range, one part's on disk at a time. A frequent n-gram is an entry per group, so
no range is larger than others.

Defined results: each row is a document, whether or not its id is null or repeated; null or empty texts have no words and score
null; words that no other document has score 0.4^k (1 / N) after k steps back; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, documents, map_arrow, own

BACKOFF, ORDER = 0.4, 3
#: Words of a group and n-grams of a range, about; the parts in which n-grams are asked for.
_HELD, _PARTS = 1 << 20, 4
_MULTIPLIERS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_GROUP = "doc_ids array<long>, lengths array<long>, n long, words binary, tokens binary"
_SCORES = "doc_id long, n_words long, n_backoffs long, log_score double"


class Numbers(dict):
    """Numbers of words in the order in which they are met."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers of as few bytes as hold the largest; first all lowest bytes, then the next ones, as high ones are mostly equal and compress."""
    kind = np.min_scalar_type(int(values.max(initial=0))).newbyteorder("<")
    return values.astype(kind).view(np.uint8).reshape(len(values), kind.itemsize).T.tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    width = len(data) // n if n else 1
    return np.frombuffer(data, np.uint8).reshape(width, n).T.copy().view(f"<u{width}").ravel()


def in_groups(rows: DataFrame, held: int) -> DataFrame:
    """Of rows (doc_id, text binary) groups of documents: their ids and numbers of words, n words in all, the hashes of the distinct ones, and each word's place among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, doc_ids, tokens, n = Numbers(), [], [], 0

        def group() -> pa.RecordBatch:
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), "<u8", len(numbers))
            values = doc_ids, [len(x) for x in tokens], n, hashes.tobytes(), packed(np.concatenate(tokens))
            kinds = pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary(), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], ["doc_ids", "lengths", "n", "words", "tokens"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = (text.as_py() or b"").lower().split()
                doc_ids.append(doc_id)
                tokens.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                n += len(words)
                if n + len(doc_ids) >= held:
                    yield group()
                    numbers, doc_ids, tokens, n = Numbers(), [], [], 0
        if doc_ids:
            yield group()

    return map_arrow(rows, run, _GROUP)


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin, as booleans."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for x in columns:
        out[1:] |= x[1:] != x[:-1]
    return out


def run_lengths(new: np.ndarray) -> np.ndarray:
    return np.diff(np.append(np.flatnonzero(new), len(new)))


def mixed(a: np.ndarray, b: np.ndarray, multiplier: np.uint64) -> np.ndarray:
    x = (a ^ b) * multiplier
    return x ^ (x >> np.uint64(32))


def grams(tokens: np.ndarray, lengths: np.ndarray, words: np.ndarray, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Where the n-grams of one word, two, and so on begin that lie within a document; key and check of each of them, one length after the other."""
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(tokens))  # words to the document's end, this one included
    hashes, at, keys, checks = words[tokens], [], [], []
    key = check = np.zeros(len(tokens), np.uint64)
    for k in range(order):
        n = max(0, len(tokens) - k)
        key, check = (mixed(h[:n], hashes[k:], m) for h, m in zip((key, check), _MULTIPLIERS))
        at.append(np.flatnonzero(left[:n] > k))
        keys.append(key[at[-1]])
        checks.append((check[at[-1]] >> np.uint64(32)).astype(np.uint32))
    return at, np.concatenate(keys), np.concatenate(checks)


def by_key(key: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Places in the order of (key, check), equal ones in their own."""
    place = np.uint64(len(key).bit_length())
    low = key.min(initial=np.iinfo(np.uint64).max)
    spare = np.uint64(64 - max(1, int(key.max(initial=low) - low).bit_length()))
    x = ((key - low) << spare >> place << place) | np.arange(len(key), dtype=np.uint64)  # as many leading bits as there is room for
    x.sort()
    order = (x & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    k, c = key[order], check[order]
    if (k[1:] < k[:-1]).any():
        order = order[np.argsort(k, kind="stable")]
        k, c = key[order], check[order]
    return np.lexsort((check, key)) if ((k[1:] == k[:-1]) & (c[1:] != c[:-1])).any() else order


def slots_of(key: np.ndarray, slots: int) -> np.ndarray:
    """The range, among `slots` equal ones, in which each key lies."""
    return ((key >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)).astype(np.int32)


def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """tokens, lengths and words of groups."""
    for lengths, n, words, tokens in zip(*(batch.column(x) for x in ("lengths", "n", "words", "tokens"))):
        yield unpacked(tokens.as_py(), n.as_py()), lengths.values.to_numpy(), np.frombuffer(words.as_py(), "<u8")


def asked(groups: DataFrame, order: int, slots: int, part: range) -> DataFrame:
    """Of each group a row per range of `part` in which it has n-grams: n distinct ones, their keys in order, checks and occurrences."""
    kinds = {"group": pa.int64(), "slot": pa.int32(), "n": pa.int64(), "keys": pa.binary(), "checks": pa.binary(), "counts": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, (tokens, lengths, words) in zip(batch.column("group"), read(batch)):
                _, key, check = grams(tokens, lengths, words, order)
                slot = slots_of(key, slots)
                mine = np.flatnonzero((slot >= part.start) & (slot < part.stop))
                mine = mine[by_key(key[mine], check[mine])]
                new = starts(key[mine], check[mine])
                mine, n = mine[new], run_lengths(new)
                key, check, slot = key[mine], check[mine], slot[mine]
                new = starts(slot)
                ends = np.cumsum(run_lengths(new))
                parts = lambda x: [packed(y) for y in np.split(x, ends[:-1])] if len(ends) else []
                columns = [group.as_py()] * len(ends), slot[new], run_lengths(new), parts(key), parts(check), parts(n)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds.values())], list(kinds))

    return map_arrow(groups, run, "group long, slot int, n long, keys binary, checks binary, counts binary")


def answered(ranges: DataFrame) -> DataFrame:
    """group, slot, n, totals binary: for each row of `asked` the occurrences of its n-grams in all groups. A partition has all rows of its ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, keys, checks, counts = [], [], [], []
        for batch in batches:
            names.append(batch.select(["group", "slot", "n"]))
            for n, key, check, count in zip(batch.column("n").to_pylist(), *(batch.column(x) for x in ("keys", "checks", "counts"))):
                for out, x, kind in ((keys, key, np.uint64), (checks, check, np.uint32), (counts, count, np.int64)):
                    out.append(unpacked(x.as_py(), n).astype(kind, copy=False))
        if keys:
            ends = np.cumsum([len(x) for x in keys])
            key, check, n = np.concatenate(keys), np.concatenate(checks), np.concatenate(counts)
            del keys, checks, counts
            order = by_key(key, check)
            new = starts(key[order], check[order])
            totals = np.empty(len(key), np.int64)
            totals[order] = np.repeat(np.add.reduceat(n[order], np.flatnonzero(new)), run_lengths(new))
            names = pa.Table.from_batches(names).combine_chunks().to_batches()[0]
            totals = pa.array([packed(x) for x in np.split(totals, ends[:-1])], pa.binary())
            yield pa.RecordBatch.from_arrays([*names.columns, totals], ["group", "slot", "n", "totals"])

    return map_arrow(ranges, run, "group long, slot int, n long, totals binary")


def scored(groups: DataFrame, order: int, total: int) -> DataFrame:
    """doc_id, n_words, n_backoffs, log_score, from groups with their answers (array of slot, n, totals)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_ids, answers, (tokens, lengths, words) in zip(batch.column("doc_ids"), batch.column("answers"), read(batch)):
                at, key, check = grams(tokens, lengths, words, order)
                place = by_key(key, check)
                new = starts(key[place], check[place])
                doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
                doc = np.concatenate([doc[x] for x in at])[place]
                answers = sorted((x["slot"], x["n"], x["totals"]) for x in answers.as_py() or ())
                totals = np.concatenate([np.empty(0, np.int64), *(unpacked(x, n).astype(np.int64) for _, n, x in answers)])
                mine = run_lengths(starts(np.cumsum(new), doc))  # a document's own occurrences, a run each
                others = np.empty(len(key), np.int64)
                others[place] = np.repeat(totals, run_lengths(new)) - np.repeat(mine, mine)
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(lengths), *_scores(at, others, lengths, total)], ["doc_id", "n_words", "n_backoffs", "log_score"])

    return map_arrow(groups, run, _SCORES)


def _scores(at: list[np.ndarray], others: np.ndarray, lengths: np.ndarray, total: int) -> tuple[pa.Array, pa.Array]:
    """Steps back and log scores of documents, by the places where n-grams begin and their occurrences in other documents."""
    n, longest = int(lengths.sum()), len(at) - 1
    begin = np.cumsum(lengths) - lengths
    context = np.minimum(np.arange(n) - np.repeat(begin, lengths), longest)  # words before this one, as far as they count
    steps, over, under, shorter = context.copy(), np.zeros(n, np.int64), total - np.repeat(lengths, lengths), None
    for k, places in enumerate(at):
        counts = np.zeros(n, np.int64)
        counts[places], others = others[: len(places)], others[len(places) :]
        seen = np.flatnonzero(counts > 0)
        over[seen + k] = counts[seen]
        if k:
            under[seen + k] = shorter[seen]
            steps[seen + k] = context[seen + k] - k
        shorter = counts
    logs = np.log(np.maximum(over, 1)) - np.log(np.maximum(under, 1)) + steps * np.log(BACKOFF)
    full = np.flatnonzero(lengths)
    n_backoffs, log_score = np.zeros(len(lengths), np.int64), np.zeros(len(lengths))
    if n:
        n_backoffs[full], log_score[full] = np.add.reduceat(steps, begin[full]), np.add.reduceat(logs.astype(np.longdouble), begin[full])
    return pa.array(n_backoffs), pa.array(log_score, mask=lengths == 0)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, held: int = _HELD) -> DataFrame:
    """doc_id, n_words, n_backoffs (steps to a shorter context) long, log_score, score (log_score a word) double: a row per row of df. `held`: words of a group, n-grams of a range, about."""
    # The input is read once: one that is computed may deal its rows otherwise each time.
    scratch = Scratch(df.sparkSession, "backoff")
    groups = in_groups(own(df, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text")), held)
    groups = scratch.table("groups", groups.withColumn("group", F.monotonically_increasing_id()))
    total = groups.agg(F.sum("n")).first()[0] or 0
    parts = max(1, min(_PARTS, 4 * total // held))
    ranges = max(1, -(-order * total // (parts * held)))  # of a part
    slots, answers = parts * ranges, None
    for i in range(parts):
        part = range(i * ranges, (i + 1) * ranges)
        dealt = asked(groups, order, slots, part).repartitionById(ranges, F.col("slot") - part.start)
        found = scratch.table(f"answers-{i}", answered(dealt))
        answers = found if answers is None else answers.unionByName(found)
        del dealt
        scratch.drop()
    answers = answers.groupBy("group").agg(F.collect_list(F.struct("slot", "n", "totals")).alias("answers"))
    found = scratch.table("scores", scored(groups.join(answers, "group", "left"), order, total))
    scratch.drop("groups", *(f"answers-{i}" for i in range(parts)))
    return found.select("doc_id", "n_words", "n_backoffs", "log_score", (F.col("log_score") / F.col("n_words")).alias("score"))


def op5_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As `score`, rounded, as sums of floating-point numbers differ in their last digits with the order."""
    return score(documents(spark, sf_dir)).select("doc_id", "n_words", "n_backoffs", F.round("log_score", 6).alias("log_score"), F.round("score", 6).alias("score"))


#: The query's rows in DuckDB's SQL: counts of others by windows over all positions.
OP5_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, unnest(range(len(words))) AS i, unnest(words) AS w FROM d),
t AS MATERIALIZED (SELECT doc_id, i, w, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS v, lag(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM p),
c AS MATERIALIZED (SELECT doc_id, i, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
  CASE WHEN i > 0 THEN count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) END AS c2,
  CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY doc_id, u, v, w) END AS c3 FROM t),
x AS MATERIALIZED (SELECT *, lag(c1) OVER (PARTITION BY doc_id ORDER BY i) AS b1, lag(c2) OVER (PARTITION BY doc_id ORDER BY i) AS b2, count(*) OVER (PARTITION BY doc_id) AS own, count(*) OVER () AS total FROM c),
s AS (SELECT doc_id, CASE WHEN c3 > 0 THEN 0 WHEN c2 > 0 THEN CAST(i > 1 AS INTEGER) ELSE least(i, 2) END AS steps,
  CASE WHEN c3 > 0 THEN ln(c3) - ln(b2) WHEN c2 > 0 THEN CAST(i > 1 AS INTEGER) * ln(0.4) + ln(c2) - ln(b1) ELSE least(i, 2) * ln(0.4) + ln(greatest(c1, 1)) - ln(greatest(total - own, 1)) END AS l FROM x)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(sum(steps), 0) AS BIGINT) AS n_backoffs, round(sum(l), 6) AS log_score, round(sum(l) / len(words), 6) AS score FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, words
"""
