"""Operator 1: secret scan, base patterns and a randomness test battery.

Base patterns find assignments, access keys and hex runs. The method looks at other unbroken runs of encoding
characters: it infers the encoding (hex, base32, base36, base62, base64), tests the symbols for uniformity (chi-squared), for
runs of one kind of symbol, and for serial correlation, and joins the three p-values by Fisher's rule. Of random
strings the p-values are uniform; of words and identifiers they are small. So in each stratum of encoding and length the strings with
p-values above one half tell how many random ones there are, and that tells how many of those above any bound are not. The
bound of a stratum is the least one whose reported strings are false to a share of `RATE` at most, as estimated; copies of a string count once; strata of few
strings lean on their encoding, and that on the law of random strings, with the weight of `PRIOR` strings. What
passes, and is long enough to hold `LEAST_BITS` bits, is reported as a random span. All of it is SQL expressions; p-values go into a
histogram of bounded size, so the bound covers the whole corpus without sorting it.

Defined results: a null text counts as empty and has no spans; repeated rows each get a row; extra columns are left out
(or kept, in `redact`); an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, documents

#: Fixed patterns of the base rules, in the order in which kinds are listed.
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",
    "hex": r"[0-9a-f]{24,}",
}
KINDS = [*BASE, "random"]
ASSIGNED = 6
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])"
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets in order of preference, whether padding may follow, and kinds of symbols a string must hold: the first that fits is the inferred encoding.
ENCODINGS = {
    "hex": (_DIGITS + "abcdef", False, ["[0-9]"]),
    "hex_upper": (_DIGITS + "ABCDEF", False, ["[0-9]"]),
    "base32": (_UPPER + "234567", True, ["[2-7]"]),
    "base36": (_DIGITS + _LOWER, False, ["[0-9]", "[a-z]"]),
    "base36_upper": (_DIGITS + _UPPER, False, ["[0-9]", "[A-Z]"]),
    "base62": (_UPPER + _LOWER + _DIGITS, False, ["[0-9]", "[A-Z]", "[a-z]"]),
    "base64": (_UPPER + _LOWER + _DIGITS + "+/", True, ["[0-9]", "[A-Z]", "[a-z]"]),
    "base64url": (_UPPER + _LOWER + _DIGITS + "-_", True, ["[0-9]", "[A-Z]", "[a-z]"]),
}
LEAST_BITS, RATE, BINS, PRIOR = 90, 0.05, 120, 20.0
#: Bins of p-values above about one half, and of those that can be reported at all (down to 0.001).
UPPER_BINS, LAST_BIN = 3, 30


def spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans of all matches: array of (start, end, kind, match). Positions are sums over the parts between matches and the matches before, in code points."""
    parts, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    entry = "array<struct<start:bigint,end:bigint,kind:int,match:string>>"
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(entry).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["part"])
        end = start + F.length(x["match"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["match"].alias("match"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    pairs = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda p, m: F.struct(p.alias("part"), m.alias("match")))
    out = F.aggregate(pairs, begin, step, lambda acc: acc["out"])
    out = F.filter(out, keep) if keep else out
    return F.when(F.rlike(text, F.lit(pattern)), out).otherwise(F.array().cast(entry))


def base_spans(text: Column) -> dict[str, Column]:
    long_enough = lambda s: F.length(F.regexp_extract(s["match"], BASE["assign"], 1)) >= ASSIGNED
    return {kind: spans(text, pattern, i, long_enough if kind == "assign" else None) for i, (kind, pattern) in enumerate(BASE.items())}


def _let(value: Column, f) -> Column:
    """f(value), where value is one node of the expression however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _normal_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, for z >= 0, by a rational approximation good to 1e-7."""
    series = lambda t: t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * _let(1.0 / (1.0 + 0.2316419 * z), series)


def encoding_of(token: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, (symbols, padded, needs) in reversed(ENCODINGS.items()):
        fits = F.length(F.translate(token, symbols + "=" * padded, "")) == 0
        for need in needs:
            fits = fits & F.rlike(token, F.lit(need))
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def randomness(token: Column, encoding: Column) -> Column:
    """The joint p-value of the battery under the hypothesis that all symbols are drawn alike and independently; padding doesn't count."""
    alphabet = F.lit("")
    for name, (symbols, *_) in ENCODINGS.items():
        alphabet = F.when(encoding == name, F.lit(symbols)).otherwise(alphabet)
    q, cubes = F.lit(0.0), F.lit(0.0)
    for name, (symbols, *_) in ENCODINGS.items():
        shares = [sum(map(symbols.count, kind)) / len(symbols) for kind in (_DIGITS, _UPPER, _LOWER, "+/-_")]
        q, cubes = (F.when(encoding == name, sum(x**e for x in shares)).otherwise(of) for e, of in ((2, q), (3, cubes)))
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)

    def coded(x: Column) -> Column:
        codes = F.transform(F.split(x["body"], ""), lambda c: (F.instr(x["alphabet"], c) - 1).cast("double"))
        return F.struct(F.length(x["body"]).cast("double").alias("n"), F.length(x["alphabet"]).cast("double").alias("k"), codes.alias("codes"), x["body"].alias("body"), F.split(x["alphabet"], "").alias("symbols"), x["q"].alias("q"), x["cubes"].alias("cubes"))

    def joint(x: Column) -> Column:
        n, k, codes = x["n"], x["k"], x["codes"]
        before, after = (lambda xs: F.slice(xs, 1, F.size(xs) - 1)), (lambda xs: F.slice(xs, 2, F.size(xs) - 1))
        # Uniformity: chi-squared, its tail by the cube-root law. Neighbouring symbols share a bin where the string is too short to have five of each.
        met = F.transform(F.filter(x["symbols"], lambda c: c != ""), lambda c: n - F.length(F.replace(x["body"], c)))
        m = F.greatest(F.lit(2.0), F.least(k, F.floor(n / 5).cast("double")))
        first = lambda j: F.ceil(j * k / m).cast("int")
        excess = lambda seen, due: (seen - due) * (seen - due) / due
        of_bin = lambda met: lambda j: excess(total(F.slice(met, first(j) + 1, first(j + 1) - first(j))), n * (first(j + 1) - first(j)) / k)
        chi = _let(met, lambda met: total(F.transform(F.sequence(F.lit(0), m.cast("int") - 1), of_bin(met))))
        df = m - 1
        z_chi = (F.pow(chi / df, 1.0 / 3.0) - (1.0 - 2.0 / (9.0 * df))) / F.sqrt(2.0 / (9.0 * df))
        p_chi = _let(z_chi, lambda z: F.when(z >= 0, _normal_tail(z)).otherwise(1.0 - _normal_tail(-z)))
        # Runs of symbols of one kind (digits, capitals, small letters, others): changes between neighbours are a share 1 - q of them by chance.
        kinds = F.translate(x["body"], _DIGITS + _UPPER + _LOWER, "0" * 10 + "A" * 26 + "a" * 26)
        changes = F.length(F.regexp_replace(F.translate(kinds, "+/-_", "...."), r"(.)\1++", "$1")) - 1.0
        q, cubes = x["q"], x["cubes"]
        spread = (n - 1) * (1 - q) * q + 2 * (n - 2) * (cubes - q * q)
        z_runs = F.abs(changes - (n - 1) * (1 - q)) / F.sqrt(spread)
        # Serial correlation of neighbours around the alphabet's mean.
        mean, variance = (k - 1) / 2, (k * k - 1) / 12
        z_serial = F.abs(total(F.zip_with(before(codes), after(codes), lambda a, b: (a - mean) * (b - mean)))) / (F.sqrt(n - 1) * variance)
        tails = [F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12)) for p in (p_chi, 2 * _let(z_runs, _normal_tail), 2 * _let(z_serial, _normal_tail))]
        half = -sum((F.log(p) for p in tails[1:]), F.log(tails[0]))
        return _let(half, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return _let(_let(F.struct(F.rtrim(token, F.lit("=")).alias("body"), alphabet.alias("alphabet"), q.alias("q"), cubes.alias("cubes")), coded), joint)


def candidates(text: Column, base: Column) -> Column:
    """Runs that no base span touches, with stratum and p-value: array of (start, end, kind, stratum, bits, h, p)."""
    def free_of(x: Column) -> Column:
        """The runs of x.found that meet no span of x.base: in order of starts, those before the furthest end of a base span so far, and from behind, those beyond the nearest start."""
        none = F.lit(-1).cast("int")
        bases = F.transform(x["base"], lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), none.alias("i")))
        runs = F.transform(x["found"], lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.cast("int").alias("i")))
        hit = lambda acc, v, meets: F.when((v["i"] >= 0) & meets, F.concat(acc["hits"], F.array(v["i"]))).otherwise(acc["hits"]).alias("hits")
        begin = lambda at: F.struct(F.lit(at).cast("bigint").alias("at"), F.array().cast("array<int>").alias("hits"))
        ahead = lambda acc, v: F.struct(F.when(v["i"] < 0, F.greatest(acc["at"], v["end"])).otherwise(acc["at"]).alias("at"), hit(acc, v, v["start"] < acc["at"]))
        behind = lambda acc, v: F.struct(F.when(v["i"] < 0, F.least(acc["at"], v["start"])).otherwise(acc["at"]).alias("at"), hit(acc, v, v["end"] > acc["at"]))
        hits = lambda ordered: F.concat(F.aggregate(ordered, begin(-1), ahead)["hits"], F.aggregate(F.reverse(ordered), begin((1 << 62)), behind)["hits"])
        every = F.when(F.size(x["found"]) > 0, F.sequence(F.lit(0), F.size(x["found"]) - 1)).otherwise(F.array().cast("array<int>"))
        left = F.array_except(every, _let(F.array_sort(F.concat(bases, runs)), hits))
        return F.when(F.size(x["base"]) == 0, x["found"]).otherwise(F.transform(left, lambda i: F.get(x["found"], i)))

    free = _let(F.struct(spans(text, CANDIDATE, len(BASE)).alias("found"), base.alias("base")), free_of)
    coded = F.filter(F.transform(free, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["match"].alias("match"), encoding_of(s["match"]).alias("encoding"))), lambda s: s["encoding"].isNotNull())

    def tested(s: Column) -> Column:
        size = F.lit(0.0)
        for name, (symbols, *_) in ENCODINGS.items():
            size = F.when(s["encoding"] == name, F.lit(math.log2(len(symbols)))).otherwise(size)
        n = s["end"] - s["start"]
        band = F.least(F.floor(F.log2(n.cast("double")) * 2), F.lit(30))
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.concat_ws(":", s["encoding"], band.cast("string")).alias("stratum"), (n * size).alias("bits"), F.xxhash64(s["match"]).alias("h"), randomness(s["match"], s["encoding"]).alias("p"))

    return F.transform(coded, tested)


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) * 10), F.lit(BINS)).cast("int")


def report_bounds(tested: DataFrame, rate: float = RATE) -> dict[str, int]:
    """Per stratum the bin of -10 log10 p from which strings are not reported. The histogram has at most encodings x length bands x bins rows."""
    rows = tested.select(F.explode("tested").alias("t")).groupBy(F.col("t.stratum").alias("stratum"), _bin(F.col("t.p")).alias("bin")).agg(F.countDistinct("t.h").alias("n")).collect()
    own: dict[str, list[float]] = {}
    of_encoding: dict[str, list[float]] = {}
    uniform = [10 ** (-b / 10) - 10 ** (-(b + 1) / 10) for b in range(BINS)] + [10 ** (-BINS / 10)]
    for stratum, at, n in rows:
        encoding = of_encoding.setdefault(stratum.split(":")[0], [PRIOR * u for u in uniform])
        encoding[at] += n
        own.setdefault(stratum, [0.0] * (BINS + 1))[at] += n
    out = {}
    for stratum, counts in own.items():
        wider = of_encoding[stratum.split(":")[0]]
        counts = [n + PRIOR * w / sum(wider) for n, w in zip(counts, wider)]
        random = sum(counts[:UPPER_BINS]) / sum(uniform[:UPPER_BINS])
        bound, reported, law = 0, 0.0, 0.0
        for b in range(LAST_BIN):
            reported, law = reported + counts[b], law + uniform[b]
            if reported - random * law <= rate * reported:
                bound = b + 1
        out[stratum] = bound
    return out


def random_spans(tested: Column, bounds: dict[str, int], least_bits: float = LEAST_BITS) -> Column:
    def kept(s: Column) -> Column:
        bound = F.lit(0)
        for stratum, least in sorted(bounds.items()):
            bound = F.when(s["stratum"] == stratum, F.lit(least)).otherwise(bound)
        return (s["bits"] >= least_bits) & (_bin(s["p"]) < bound)

    return F.transform(F.filter(tested, kept), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))


def _sorted(found: Column) -> Column:
    """Spans by start, then kind as listed."""
    return F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def examined(df: DataFrame, text: Column) -> DataFrame:
    """Adds assign, access, hex (arrays of spans) and tested (candidates with their p-values)."""
    df = df.withColumns(base_spans(text))
    return df.withColumn("tested", candidates(text, F.concat(*BASE)))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random long, base_sha256, spans string."""
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    found = cut(examined(docs, F.col("text")).select("doc_id", *(bare(k).alias(k) for k in BASE), "tested"))  # a few spans a document
    found = found.withColumn("random", random_spans(F.col("tested"), report_bounds(found)))
    base = F.concat(*BASE)
    return found.select(
        "doc_id", *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(_joined(_sorted(base)), 256).alias("base_sha256"), _joined(_sorted(F.concat(base, "random"))).alias("spans")
    )


def redact(df: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replaces each span, merged with those it overlaps, by a mark; all other columns and rows stay as they are. A null text stays null."""
    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")).withColumn("text", F.col(f"row.`{text_col}`"))
    bare = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    # Written once: the bounds need all spans before any text changes.
    found = cut(examined(packed, F.col("text")).select("row", F.concat(*map(bare, BASE)).alias("base"), "tested"))
    found = found.withColumn("text", F.col(f"row.`{text_col}`"))
    ordered = _sorted(F.concat("base", random_spans(F.col("tested"), report_bounds(found.select("tested")))))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    piece = lambda text, a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(piece(F.col("text"), acc["at"], s["start"]), F.lit(mark)))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    clean = F.aggregate(ordered, begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), piece(F.col("text"), acc["at"], F.length("text").cast("bigint"))))
    cleaned = found.withColumn("clean", F.when(F.size(ordered) > 0, clean).otherwise(F.col("text")))
    return cleaned.select(*(F.col("clean").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in df.columns))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
