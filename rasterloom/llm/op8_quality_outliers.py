"""Operator 8: quality rules, base rules on word statistics and a robust multivariate outlier test.

For each language and source a minimum-covariance-determinant estimate (concentration steps from four starts until the
determinant stops falling, the least of them, reweighted) gives centre and scatter of transformed statistics; a document far from its
group by Mahalanobis distance fails. The statistics are mean and mean squared length of words and the share of what is no letter: they vary in
plain prose, so their scatter says what is usual; repetition is left to the base rules, as most documents have none. All of it is DataFrame expressions and aggregates: sums and quantile sketches are combined before each shuffle,
so a group that holds a third of all rows costs what others cost.

Defined results: null texts have no words, so they fail the base rule; null languages and sources are groups like
others; groups of fewer than `min_group` documents that pass the base rules are tested by the estimate of their language,
and languages of fewer by that of all documents; repeated rows each get a row; extra columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD_SPACE, by_size, cut, documents

_SPACES, _SYMBOLS = " \t\n\x0b\x0c\r", "#*$%&|<>"
#: Tested statistics, and the least standard deviation of each: only a group without any spread meets it.
FLOORS = {"z_length": 1e-3, "z_marks": 1e-3, "z_spread": 1e-3}
#: Words at the median rates of its language that each document is taken to hold besides its own, so that a short one doesn't stand out by chance.
PRIOR_WORDS = 200
#: Share of a group's documents the estimate rests on, and the squared distance beyond which a document is an outlier: one in 10^5 of a 3-dimensional normal law lie beyond.
SUPPORT, CUTOFF, MIN_GROUP = 0.75, 25.902, 50
#: A determinant has stopped falling when its logarithm falls by less.
SETTLED = 1e-3
#: Makes the scatter of the innermost three quarters of a 3-dimensional normal law that of the whole: support / P(chi2 of 5 <= 3/4 quantile of chi2 of 3).
CONSISTENCY = 0.75 / 0.4661
#: Of the reweighting step: the squared distance within which 97.5 % of a 3-dimensional normal law lie, and what makes their scatter that of the whole.
INNER, INNER_CONSISTENCY = 9.348, 0.975 / 0.9041


def word_statistics(df: DataFrame, text: Column) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) of a text column."""
    blank = lambda x: F.length(F.translate(x, _SPACES, "")) == 0
    full = F.coalesce(text, F.lit(""))
    df = df.withColumn("w_text", full).withColumn("w_hashes", F.transform(F.array_remove(F.split("w_text", WORD_SPACE), ""), lambda w: F.xxhash64(w)))
    df = df.withColumn("w_lines", F.filter(F.split("w_text", "\n"), lambda x: ~blank(x)))
    n = F.size("w_hashes")
    windows = F.when(n >= 5, F.transform(F.sequence(F.lit(1), n - 4), lambda i: F.xxhash64(F.slice("w_hashes", i, 5)))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("w_windows", windows)
    placed = F.array_sort(F.transform("w_windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    same = lambda a, b: F.coalesce(F.get(a, b)["x"], F.lit(None))
    df = df.withColumn("w_placed", F.when(F.size("w_windows") > F.size(F.array_distinct("w_windows")), placed))
    twice = F.filter("w_placed", lambda p, k: F.coalesce(same("w_placed", k - 1) == p["x"], F.lit(False)) | F.coalesce(same("w_placed", k + 1) == p["x"], F.lit(False)))
    df = df.withColumn("w_starts", F.array_sort(F.transform(twice, lambda p: p["i"])))
    covered = F.aggregate(F.transform("w_starts", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("w_starts", k + 1) - p, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate("w_text", _SPACES, "")).cast("long"),
            "n_symbols": (F.length("w_text") - F.length(F.translate("w_text", _SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("w_lines") - F.size(F.array_distinct("w_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        }
    ).drop("w_text", "w_hashes", "w_lines", "w_windows", "w_placed", "w_starts")


#: Rates a word of the tested statistics: code points, code points that are no letters, squared code points.
_RATES = {"z_length": "word_chars", "z_marks": "n_marks", "z_spread": "n_squares"}


def text_rates(df: DataFrame, text: Column) -> DataFrame:
    """Adds n_marks (code points in words that are no letters) and n_squares (sum of squared lengths of words), long."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPACE), "")
    marks = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\p{L}\p{M}\x20\x09-\x0D]+", ""))
    return df.withColumns({"n_marks": marks.cast("long"), "n_squares": F.aggregate(words, F.lit(0).cast("long"), lambda a, w: a + F.length(w) * F.length(w))})


def transformed(rows: DataFrame, lang: str, prior: int = PRIOR_WORDS) -> DataFrame:
    """Adds the tested statistics to rows of one word or more: logarithms of rates, drawn towards the median rates of the language by `prior` words."""
    medians = rows.groupBy(lang).agg(*(F.percentile_approx(F.col(c) / F.col("n_words"), 0.5, 1000).alias(f"r_{c}") for c in _RATES.values()))
    joined = rows.join(by_size(cut(medians)), lang)
    smooth = {z: F.log((F.col(c) + prior * F.col(f"r_{c}") + 1) / (F.col("n_words") + prior)) for z, c in _RATES.items()}
    return joined.withColumns(smooth).drop(*(f"r_{c}" for c in _RATES.values()))


def _distance(dims: list[str]) -> Column:
    """Squared Mahalanobis distance by forward substitution, from columns m_<dim> and l_<i>_<j> (Cholesky factor)."""
    solved: list[Column] = []
    for i, d in enumerate(dims):
        rest = F.col(d) - F.col(f"m_{d}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * solved[j]
        solved.append(rest / F.col(f"l_{i}_{i}"))
    return sum((x * x for x in solved[1:]), solved[0] * solved[0])


def _cholesky(groups: DataFrame, dims: list[str]) -> DataFrame:
    """Replaces covariances c_<i>_<j> by the factor's entries l_<i>_<j>."""
    for i in range(len(dims)):
        for j in range(i + 1):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            groups = groups.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l_{j}_{j}"))
    return groups.drop(*(f"c_{i}_{j}" for i in range(len(dims)) for j in range(i + 1)))


def robust_distance(df: DataFrame, by: list[str], dims: dict[str, float], support: float = SUPPORT, min_group: int = MIN_GROUP) -> DataFrame:
    """Adds `distance`, squared, to rows with the columns of `by` (no nulls) and `dims` (and the least standard deviation of each), by the estimate of the narrowest group of min_group rows; groups are those of all of `by`, of all but its last, and so on to all rows, which have an estimate whatever their number. Reads df more than once."""
    names = list(dims)
    keys = [F.to_json(F.struct(F.lit(i).alias("level"), *by[:i])) for i in range(len(by) + 1)]
    groups = df.groupBy(*by).agg(F.count(F.lit(1)).alias(f"n_{len(by)}"))
    for i in range(1, len(by)):
        groups = groups.join(groups.groupBy(*by[:i]).agg(F.sum(f"n_{len(by)}").alias(f"n_{i}")), by[:i])
    groups = cut(groups.withColumn("e_key", F.coalesce(*(F.when(F.col(f"n_{i}") >= min_group, keys[i]) for i in range(len(by), 0, -1)), keys[0])).select(*by, "e_key"))
    groups = by_size(groups)  # rows go to no task by their group where estimates are few
    parts = by_size(cut(groups.select(*by, F.explode(F.array(*keys)).alias("e_key")).join(groups.select("e_key").distinct(), "e_key")))  # of the estimates in use those a group's rows belong to
    members = df.join(parts, by).select("e_key", *names)

    pairs = [(i, j, a, b) for i, a in enumerate(names) for j, b in enumerate(names[: i + 1])]
    means = [F.avg(d).alias(f"m_{d}") for d in names]
    scatter = lambda factor: [(F.covar_pop(a, b) * factor + (F.lit(dims[a] ** 2) if i == j else F.lit(0.0))).alias(f"c_{i}_{j}") for i, j, a, b in pairs]
    columns = ["e_key", "start", *(f"m_{d}" for d in names), *(f"l_{i}_{j}" for i, j, *_ in pairs)]
    quartiles = cut(members.groupBy("e_key").agg(*(F.percentile_approx(d, [0.25, 0.5, 0.75], 1000).alias(f"q_{d}") for d in names)))
    spread = members.join(by_size(quartiles), "e_key").groupBy("e_key").agg(*(F.percentile_approx(F.abs(F.col(d) - F.get(f"q_{d}", F.lit(1))), 0.5, 1000).alias(f"s_{d}") for d in names))
    # Starts: each quartile with the median deviation of each statistic, and the plain mean and scatter.
    starts = quartiles.join(spread, "e_key").crossJoin(df.sparkSession.range(3).select(F.col("id").cast("int").alias("start")))
    starts = starts.select("e_key", "start", *(F.get(f"q_{d}", F.col("start")).alias(f"m_{d}") for d in names), *((F.greatest(1.4826 * F.col(f"s_{a}"), F.lit(dims[a])) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i, j, a, _ in pairs))
    plain = _cholesky(members.groupBy("e_key").agg(*means, *scatter(1.0)), names).withColumn("start", F.lit(3))
    moving = cut(starts.unionByName(plain.select(*columns)).withColumn("log_det", F.lit(float("inf"))))
    settled = moving.where("false")
    while not moving.isEmpty():
        near = members.join(by_size(moving.select(*columns)), "e_key").withColumn("distance", _distance(names)).select("e_key", "start", *names, "distance")
        bound = near.groupBy("e_key", "start").agg(F.percentile_approx("distance", support, 1000).alias("bound"))
        inner = near.join(by_size(cut(bound)), ["e_key", "start"]).where("distance <= bound")
        after = _cholesky(inner.groupBy("e_key", "start").agg(*means, *scatter(CONSISTENCY)), names)
        after = after.select(*columns, sum((2 * F.log(f"l_{i}_{i}") for i in range(len(names))), F.lit(0.0)).alias("log_det"))
        after = cut(after.join(moving.select("e_key", "start", F.col("log_det").alias("old")), ["e_key", "start"]))
        fell = after.where(F.col("log_det") < F.col("old") - SETTLED)
        settled = settled.unionByName(moving.join(fell.select("e_key", "start"), ["e_key", "start"], "left_anti"))
        moving = fell.drop("old")
    least = cut(settled.groupBy("e_key").agg(F.min_by(F.struct(*columns[2:]), F.struct("log_det", "start")).alias("e")).select("e_key", "e.*"))
    inside = members.join(by_size(least), "e_key").where(_distance(names) <= INNER)
    weighted = _cholesky(inside.groupBy("e_key").agg(*means, *scatter(INNER_CONSISTENCY)), names)
    least = by_size(cut(weighted.select("e_key", *columns[2:])))
    return df.join(groups, by).join(least, "e_key").withColumn("distance", _distance(names)).select(*df.columns, "distance")


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long, base_failed, kept boolean, distance double (null: failed by the base rule)."""
    absent = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit(""))  # noqa: E731  nulls become a value that no other has
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), absent(lang_col).alias("g_lang"), absent(source_col).alias("g_source"), F.col(f"`{text_col}`").cast("string").alias("g_text"))
    rows = text_rates(word_statistics(rows, F.col("g_text")), F.col("g_text")).drop("g_text")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    rows = cut(rows)
    tested = robust_distance(cut(transformed(rows.where("not base_failed"), "g_lang")), ["g_lang", "g_source"], FLOORS).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance")
    failed = rows.where("base_failed").select(*tested.columns[:-1], F.lit(None).cast("double").alias("distance"))
    return tested.union(failed).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True)))


def op8_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))
