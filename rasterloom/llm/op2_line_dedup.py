"""Operator 2: line dedup by an exact set-similarity join.

A line is the set of its words. Words are ordered by rarity (counts over all documents in a table of `COUNTERS` hashed
counters, so the order is total and its size bounded); a line's prefix are its n - ceil(0.75 n) + 1 rarest words, and
two lines that meet the threshold share one of them (the shorter has it among its rarest seventh). Pairs that share a prefix
word pass the length filter, the positional filter at their first common word and an odd sketch (a bit flips with each
word, so sketches never differ in more bits than the sets do in words), then the Jaccard similarity of the whole sets is
computed. A line is removed if an earlier line, by document and line number, matches it. Lines with equal sets are one class
from the start, so copies meet once however many there are.

Groups of near copies don't grow with their square. At each word each class is compared with the earliest class of the word
first, and those that match it are settled. Only classes that are not yet settled are then compared with all others of a word, and only where the shorter one has the word early enough.
What comes out is per removed line one earlier line that it matches. Both steps go through the words in parts, so that the
entries of one part only are on disk at a time.

All of it is DataFrame operations. Full sets are only built for lines of classes that have candidates; a bit set of fixed
size says which documents may hold one, so the text isn't shuffled for that.

Defined results: null texts stay null and empty texts empty; lines without words are left alone; rows with the same id and
text count as one document and get the same result; null ids come first in the order, and of rows with one id that with the
least hash of its text; extra columns stay (`deduplicate`) or are left out (`line_matches`); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD_SPACE, Scratch, bit_set, by_size, documents, in_bit_set

#: Similarity in percent.
THRESHOLD = 75
#: Counters of words, a power of two.
COUNTERS = 1 << 20
#: Parts of the words that are joined one after another: entries of one part only are on disk at a time.
PARTS = 4
#: Lines of more words have two sketches, one of which all their words flip, and one that half of them flip.
LONG = 64
REF = ["r_doc", "r_hash", "r_line"]


def _words(line: Column) -> Column:
    """Words; lines that hold no white space but spaces, by far the most, are split without a regular expression."""
    return F.array_remove(F.when(F.rlike(line, F.lit(r"[\x09-\x0D]")), F.split(line, WORD_SPACE)).otherwise(F.split(line, " ")), "")


def _lines(docs: DataFrame) -> DataFrame:
    """r_doc, r_hash (of the text), r_line, line; docs has r_doc and r_text."""
    return docs.where("r_text is not null").select("r_doc", F.xxhash64("r_text").alias("r_hash"), F.posexplode(F.split("r_text", "\n")).alias("r_line", "line"))


def rarity_classes(docs: DataFrame, scratch: Scratch) -> Column:
    """Per counter a byte, 4 log2 of how many words of the corpus fall into it, as a literal of fixed size, the only thing about words that reaches the driver."""
    breaks = F.rlike("r_text", F.lit(r"[\x09\x0B-\x0D]"))
    words = F.when(breaks, F.split("r_text", WORD_SPACE)).otherwise(F.split(F.replace("r_text", F.lit("\n"), F.lit(" ")), " "))
    counters = docs.where("r_text is not null").select(F.explode(words).alias("w")).where("w <> ''").select(F.xxhash64("w").bitwiseAND(COUNTERS - 1).alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n"))
    rarity = F.least(F.floor(4 * F.log2(F.col("n") + 1)), F.lit(120)).cast("long")
    eight = counters.groupBy(F.shiftright("c", 3).alias("i")).agg(F.bit_or(F.call_function("shiftleft", rarity, (8 * F.col("c").bitwiseAND(7)).cast("int"))).alias("bytes"))
    table = bytearray(COUNTERS)
    for i, packed in scratch.table("counters", eight).collect():  # COUNTERS / 8 rows
        table[8 * i : 8 * i + 8] = packed.to_bytes(8, "little")
    scratch.drop("counters")
    return F.lit(table)


def _hashes(line: Column) -> Column:
    return F.array_distinct(F.transform(_words(line), lambda w: F.xxhash64(w)))


def _tokens(line: Column, classes: Column) -> Column:
    """Sorted distinct words as longs: the rarity class in the top bits, so that rarer words come first, then 56 bits of the word's hash."""

    def token(h: Column) -> Column:
        rarity = F.ascii(F.substring(classes, h.bitwiseAND(COUNTERS - 1).cast("int") + 1, 1))
        return F.shiftleft(rarity.cast("long"), 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    return F.sort_array(F.transform(_hashes(line), token))


def _flipped(bit: Column) -> Column:
    """The odd sketch of `tokens`, whose low six bits say which bit of the sketch flips, of those for which `bit` is 1."""
    return F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a.bitwiseXOR(F.call_function("shiftleft", bit(t), t.bitwiseAND(63).cast("int"))))


class _Join:
    """The filters of the join, for entries (node, n words, at: a word's place, s, s1: sketches) of sides a and b."""

    def __init__(self, threshold: int):
        self.t = threshold

    def prefix(self, n: Column) -> Column:
        return n - F.ceil(n * self.t / 100).cast("int") + 1

    def shorter_prefix(self, n: Column) -> Column:
        """Of a line that is not the longer one of a pair."""
        return n - F.ceil(n * 2 * self.t / (100 + self.t)).cast("int") + 1

    def possible(self, a: str, b: str) -> Column:
        n_a, n_b, at_a, at_b = (F.col(f"{x}_{side}") for x in ("n", "at") for side in (a, b))
        length = 100 * F.least(n_a, n_b) >= self.t * F.greatest(n_a, n_b)
        place = F.when(n_a <= n_b, at_a < self.shorter_prefix(n_a)).otherwise(at_b < self.shorter_prefix(n_b))
        # At the first common word nothing before it is common: the words from it on have to hold the whole overlap.
        position = (100 + self.t) * F.least(n_a - at_a, n_b - at_b) >= self.t * (n_a + n_b)
        whole, half = (F.col(f"{x}_{a}").bitwiseXOR(F.col(f"{x}_{b}")) for x in ("s", "s1"))
        differing = F.when(F.least(n_a, n_b) > LONG, F.bit_count(half) + F.bit_count(half.bitwiseXOR(whole))).otherwise(F.bit_count(whole))
        return length & place & position & ((100 + self.t) * differing <= (100 - self.t) * (n_a + n_b))

    def similar(self, a: str, b: str) -> Column:
        common = F.size(F.array_intersect(a, b))
        return 100 * common >= self.t * (F.size(a) + F.size(b) - common)


def _side(entries: DataFrame, side: str, *more: str) -> DataFrame:
    return entries.select("token", *(F.col(x).alias(f"{x}_{side}") for x in ("node", "n", "at", "s", "s1", *more)))


def unsettled(entries: DataFrame, join: _Join) -> DataFrame:
    """Entries (token, node, n, at, s, s1, settled) of which not both are settled, in pairs that share a token, the one with fewer words (of equals, the smaller node) as a.

    That one has to have the word in the prefix of a line that isn't the longer one, which is asked before the join: lines of a template whose changing words are
    too many for a match have only these, rarer, words there, and the words that all of them share join nothing.
    """
    short = entries.where(F.col("at") < join.shorter_prefix(F.col("n")))
    ordered = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("node_a") < F.col("node_b")))
    # Settled ones meet only what isn't settled: whether b is settled is part of the key, so all entries are dealt out once.
    meets = F.when(F.col("settled"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))
    left = _side(short.withColumn("meets", F.explode(meets)), "a", "meets").withColumnRenamed("meets_a", "settled")
    right = _side(entries, "b", "settled").withColumnRenamed("settled_b", "settled")
    return left.join(right, ["token", "settled"]).where(ordered)


def matches(docs: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Of docs (r_doc, r_text): lines (REF, node of their class; of classes of several lines or that are removed), and these classes (node, REF of the first line, copies, removed, match: REF of an earlier line that matches, null if not removed)."""
    scratch, join = Scratch(docs.sparkSession, "lines"), _Join(threshold)
    classes_of = rarity_classes(docs, scratch)
    prefix = F.when(F.col("n") > 2, F.slice("tokens", 1, join.prefix(F.col("n")))).otherwise(F.array().cast("array<bigint>"))  # of fewer words only equal sets meet a threshold above 2 / 3
    if threshold <= 66:
        prefix = F.slice("tokens", 1, join.prefix(F.col("n")))
    sixth = lambda t: F.shiftright(t, 6).bitwiseAND(1)
    lines = (
        _lines(docs).withColumn("tokens", _tokens(F.col("line"), classes_of)).withColumn("n", F.size("tokens")).withColumn("prefix", prefix)
        .select(*REF, F.xxhash64("tokens").alias("k1"), F.xxhash64(F.lit(1), "tokens").alias("k2"), "n", F.transform("prefix", lambda t: F.hash(t)).alias("prefix"), _flipped(lambda t: F.lit(1).cast("long")).alias("s"), F.when(F.col("n") > LONG, _flipped(sixth)).otherwise(F.lit(0).cast("long")).alias("s1"))
    )
    # Lines without words go only here: before, the filter would move in front of the projection and words be hashed twice.
    lines = scratch.table("lines", lines).where("n > 0")
    first = ("n", "prefix", "s", "s1")
    classes = lines.groupBy("k1", "k2").agg(F.min(F.struct(*REF)).alias("first"), F.count(F.lit(1)).alias("copies"), *(F.first(c).alias(c) for c in first))
    classes = scratch.table("classes", classes.select(F.monotonically_increasing_id().alias("node"), "k1", "k2", "first.*", "copies", *first))
    scratch.drop()

    def verified(name: str, pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b) of nodes those whose whole sets meet the threshold: later, earlier (nodes), match (REF of the earlier)."""
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        involved = scratch.table(f"{name}_nodes", ends.join(classes.select("node", *REF), "node"))
        of_docs, of_lines = bit_set(involved, "r_doc", "r_hash"), bit_set(involved, *REF)
        may_hold = docs.where("r_text is not null").withColumn("r_hash", F.xxhash64("r_text")).where(in_bit_set(of_docs, "r_doc", "r_hash")).drop("r_hash")
        key = F.xxhash64(*REF).alias("ref_key")  # one shuffle by it serves the join and the removal of repeated rows
        whole = _lines(may_hold).where(in_bit_set(of_lines, *REF)).select(*REF, _hashes(F.col("line")).alias("tokens"), key)
        same = (F.col("i.ref_key") == F.col("w.ref_key")) & F.struct(*(f"i.{c}" for c in REF)).eqNullSafe(F.struct(*(f"w.{c}" for c in REF)))
        met = involved.select("*", key).alias("i").join(whole.alias("w"), same).select("i.ref_key", "i.node", *(f"i.{c}" for c in REF), "tokens")
        sets = scratch.table(f"{name}_sets", met.dropDuplicates(["ref_key", "node"]).drop("ref_key"))
        side = lambda x: sets.select(F.col("node").alias(x), F.struct(*REF).alias(f"ref_{x}"), F.col("tokens").alias(f"tokens_{x}"))
        links = pairs.join(side("a"), "a").join(side("b"), "b").where(join.similar("tokens_a", "tokens_b"))
        a_later = F.col("ref_a") > F.col("ref_b")
        links = links.select(F.when(a_later, F.col("a")).otherwise(F.col("b")).alias("later"), F.when(a_later, F.col("ref_b")).otherwise(F.col("ref_a")).alias("match"))
        found = scratch.table(f"{name}_links", links.groupBy("later").agg(F.min("match").alias("match")))
        scratch.drop(f"{name}_nodes", f"{name}_sets")
        return found

    # Each class with the earliest of the word, then what isn't settled with all.
    def in_parts(name: str, pairs_of: Callable[[DataFrame], DataFrame], of: DataFrame, *more: str) -> DataFrame:
        """Distinct pairs (a, b) of nodes that `pairs_of` finds among entries, word by word, in parts of the words."""
        known = of.where("size(prefix) > 0").select("node", "n", "s", "s1", *more, F.posexplode("prefix").alias("at", "token"))
        parts = []
        for i in range(PARTS):
            found = pairs_of(known.where(F.pmod("token", F.lit(PARTS)) == i))
            parts.append(scratch.table(f"{name}_{i}", found.distinct()))
            del found
            scratch.drop()
        pairs = scratch.table(name, reduce(DataFrame.union, parts).distinct())
        scratch.drop(*(f"{name}_{i}" for i in range(PARTS)))
        return pairs

    def with_earliest(entries: DataFrame) -> DataFrame:
        # The order of the words' lines, but for rows of one id; which line of a pair is the later one is asked when their sets are compared.
        earliest = entries.groupBy("token").agg(F.min(F.struct("r_doc", "r_line", "node", "n", "at", "s", "s1")).alias("e"), F.count(F.lit(1)).alias("m")).where("m > 1").select("token", "e.*")
        met = _side(entries, "a").join(_side(earliest, "b"), "token").where((F.col("node_a") != F.col("node_b")) & join.possible("a", "b"))
        return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))

    def with_all(entries: DataFrame) -> DataFrame:
        met = unsettled(entries, join).where(join.possible("a", "b"))
        return met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))

    first_pairs = in_parts("first_pairs", with_earliest, classes, "r_doc", "r_line")
    settled = verified("first", first_pairs)
    flag = by_size(settled.select(F.col("later").alias("node"), F.lit(True).alias("settled")))
    flagged = classes.select("node", "n", "prefix", "s", "s1").join(flag, "node", "left").withColumn("settled", F.coalesce("settled", F.lit(False)))
    pairs = in_parts("pairs", with_all, scratch.table("flagged", flagged), "settled")
    scratch.drop("flagged")
    scratch.drop("first_pairs")
    links = settled.union(verified("all", pairs)).groupBy(F.col("later").alias("node")).agg(F.min("match").alias("match"))

    judged = classes.select("node", "k1", "k2", *REF, "copies").join(links, "node", "left").where("copies > 1 or match is not null").withColumn("removed", F.col("match").isNotNull())
    judged = scratch.table("judged", judged)
    scratch.drop("pairs", "classes", "first_links", "all_links")
    placed = lines.select(*REF, "k1", "k2").where(in_bit_set(bit_set(judged, "k1", "k2"), "k1", "k2")).join(judged.select("k1", "k2", "node"), ["k1", "k2"])
    return placed.select(*REF, "node"), judged.drop("k1", "k2")


def line_matches(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """A row per line that has copies or is removed: r_doc, r_hash, r_line, class_doc, class_line (the class's first line), match_doc, match_line (an earlier line that matches; null if the line stays), removed boolean."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("r_doc"), F.col(f"`{text_col}`").cast("string").alias("r_text"))
    lines, classes = matches(docs, threshold)
    first = classes.select("node", *(F.col(c).alias(f"first_{c}") for c in REF), "match", F.col("removed").alias("class_removed"))
    is_first = F.struct(*REF).eqNullSafe(F.struct(*(F.col(f"first_{c}").alias(c) for c in REF)))
    match = lambda of, own: F.when(F.col("class_removed"), F.col(f"match.{of}")).when(~is_first, F.col(own))
    return lines.join(by_size(first), "node").select(
        *REF, F.col("first_r_doc").alias("class_doc"), F.col("first_r_line").cast("long").alias("class_line"),
        match("r_doc", "first_r_doc").alias("match_doc"), match("r_line", "first_r_line").cast("long").alias("match_line"), (F.col("class_removed") | ~is_first).alias("removed"),
    )


def _per_document(found: DataFrame) -> DataFrame:
    """r_doc, r_hash, matched: the matching lines of a document, in order (no more than it has lines)."""
    matched = F.struct(F.col("r_line").cast("long").alias("line"), "class_doc", "class_line", "match_doc", "match_line", "removed")
    return found.groupBy("r_doc", "r_hash").agg(F.array_sort(F.collect_set(matched)).alias("matched"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """row (a struct of df's columns), clean (the text without removed lines), n_lines, n_removed long, matched: array of (line, class_doc, class_line, match_doc, match_line, removed)."""
    per_doc = Scratch(df.sparkSession, "removed").table("lines", _per_document(line_matches(df, id_col, text_col, threshold)))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    rows = rows.select("row", F.col(f"row.`{id_col}`").cast("long").alias("d"), F.xxhash64(F.col(f"row.`{text_col}`").cast("string")).alias("h"))
    may_match = in_bit_set(bit_set(per_doc, "r_doc", "r_hash"), "d", "h")  # of the rest no text moves
    joined = rows.where(may_match).join(per_doc, F.col("d").eqNullSafe(F.col("r_doc")) & (F.col("h") == F.col("r_hash")), "left").select("row", "matched")
    joined = joined.union(rows.where(~may_match).select("row", F.lit(None).cast(per_doc.schema["matched"].dataType)))
    text = F.col(f"row.`{text_col}`").cast("string")
    gone = F.transform(F.filter("matched", lambda m: m["removed"]), lambda m: m["line"])
    joined = joined.select("row", "matched", F.split(text, "\n").alias("parts"), gone.alias("gone"))
    left = F.array_except(F.sequence(F.lit(0).cast("long"), F.size("parts").cast("long") - 1), "gone")
    clean = F.when(F.size("gone") > 0, F.array_join(F.transform(left, lambda i: F.get("parts", i.cast("int"))), "\n")).otherwise(text)
    removed = F.when(F.col("gone").isNotNull(), F.size("gone")).otherwise(0)
    return joined.select("row", clean.alias("clean"), F.when(F.col("parts").isNull(), 0).otherwise(F.size("parts")).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"), "matched")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document what `deduplicate` takes out of it: doc_id, n_lines, n_removed, and removed lines as line:class_doc:class_line, comma-joined; without moving the texts."""
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    listed = F.array_join(F.transform("gone", lambda m: F.concat_ws(":", *(m[c].cast("string") for c in ("line", "class_doc", "class_line")))), ",")
    per_doc = _per_document(line_matches(docs).where("removed")).select("r_doc", "r_hash", F.col("matched").alias("gone"))
    per_doc = per_doc.select("r_doc", "r_hash", F.size("gone").cast("long").alias("n_removed"), listed.alias("removed"))
    joined = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("h") == F.col("r_hash")), "left")
    return joined.select("doc_id", "n_lines", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("removed", F.lit("")).alias("removed"))


#: The query's rows in DuckDB's SQL: prefixes by exact document frequencies, then all pairs that share a prefix word.
OP2_SQL = r"""
WITH parts AS MATERIALIZED (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
k AS MATERIALIZED (SELECT * FROM (SELECT doc_id, line, list_sort(list_distinct(list_filter(regexp_split_to_array(part, '[\x20\x09-\x0D]+'), lambda x: x <> ''))) AS s
  FROM (SELECT doc_id, unnest(range(len(parts))) AS line, unnest(parts) AS part FROM parts)) WHERE len(s) > 0),
c AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY first_doc, first_line) AS id FROM (SELECT s, len(s) AS n, min(doc_id) AS first_doc, arg_min(line, (doc_id, line)) AS first_line FROM k GROUP BY s)),
t AS MATERIALIZED (SELECT id, n, unnest(s) AS word FROM c),
d AS MATERIALIZED (SELECT word, count(*) AS lines FROM t GROUP BY word),
p AS MATERIALIZED (SELECT id, n, word FROM (SELECT t.*, row_number() OVER (PARTITION BY id ORDER BY lines, word) AS r FROM t JOIN d USING (word)) WHERE r <= n - ceil(n * 75 / 100) + 1),
pairs AS MATERIALIZED (SELECT DISTINCT a.id AS a, b.id AS b FROM p a JOIN p b ON a.word = b.word AND a.id < b.id AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)),
removed AS MATERIALIZED (SELECT DISTINCT b AS id FROM (SELECT b, x.n + y.n AS total, len(list_intersect(x.s, y.s)) AS common FROM pairs JOIN c x ON x.id = a JOIN c y ON y.id = b) WHERE 100 * common >= 75 * (total - common)),
lines AS (SELECT k.doc_id, k.line, c.first_doc, c.first_line FROM k JOIN c ON k.s = c.s LEFT JOIN removed ON removed.id = c.id WHERE removed.id IS NOT NULL OR NOT (k.doc_id = first_doc AND k.line = first_line)),
per_doc AS (SELECT doc_id, count(*) AS n_removed, string_agg(concat_ws(':', line, first_doc, first_line), ',' ORDER BY line) AS removed FROM lines GROUP BY doc_id)
SELECT doc_id, CAST(len(parts) AS BIGINT) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM parts LEFT JOIN per_doc USING (doc_id)
"""
