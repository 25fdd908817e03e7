"""Quality rules as robust multivariate outliers, in DataFrame functions only.

Each text becomes a few counts and from them a vector of transformed statistics.  Per language and
source, the minimum covariance determinant estimate takes the three quarters of the vectors with the
smallest Mahalanobis distance to its own centre, by concentration steps from coordinatewise medians.
A row far from the centre of its group is rejected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import salted_join
from ..session import settle

#: Statistics as whole numbers: this many units per unit of a transformed statistic.
UNITS = 1000
#: Groups with fewer texts than this take the estimate of their language, then that of all texts.
GROUP_ROWS = 200
#: Share of the rows that an estimate keeps, and concentration steps.
KEEP, STEPS = 0.75, 3
#: Least standard deviation of a statistic, in units: a constant statistic must not make every change an outlier.
FLOOR = 100
#: Distances are compared on a grid of this many cells per unit of log distance.
GRID = 200
#: Estimates up to this many groups are broadcast; more are joined by a split shuffle.
BROADCAST_GROUPS = 50_000
DIMENSIONS = ("x1", "x2", "x3", "x4", "x5")

# Fixed values for five dimensions: the chi-square quantile at 1 - 1e-7, and the factor that makes the
# covariance of the inner three quarters of a normal sample consistent (0.75 / P(chi2_7 <= chi2_5 quantile of 0.75)).
CUTOFF = 42.2
CONSISTENCY = 1.67

_BLANKS = r"[\x20\x09-\x0D]+"


def counts(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_lines``; a null text counts as empty."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.select(*keep, text.alias("_text"))
    out = out.withColumn("_words", F.filter(F.split("_text", _BLANKS), lambda w: w != ""))
    out = out.withColumn("_lines", F.filter(F.split("_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    word = lambda i: F.get(F.col("_words"), i)
    window = lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2), word(i + 3), word(i + 4))
    n = F.size("_words")
    out = out.withColumn("_windows", F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), window)).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn("_clean", F.size(F.array_distinct("_windows")) == F.size("_windows"))
    # Windows beside an equal one in sorted order repeat; each covers its words up to the next repeated one.
    placed = F.array_sort(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_sorted", F.when(~F.col("_clean"), placed))
    beside = lambda x, i: (F.get(F.col("_sorted"), i - 1)["h"].eqNullSafe(x["h"]) & (i > 0)) | F.get(F.col("_sorted"), i + 1)["h"].eqNullSafe(x["h"])
    out = out.withColumn("_starts", F.when(~F.col("_clean"), F.array_sort(F.transform(F.filter("_sorted", beside), lambda x: x["i"]))))
    covered = F.aggregate(F.transform("_starts", lambda s, i: F.least(F.lit(5), F.coalesce(F.get(F.col("_starts"), i + 1) - s, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    return out.select(
        *keep, n.cast("bigint").alias("n_words"), F.length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("_text", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("bigint").alias("n_repeat_words"), F.size("_lines").cast("bigint").alias("n_lines"))


def statistics() -> list[Column]:
    """The transformed statistics: logarithms of sizes and angles of shares, in whole units."""
    share = lambda part, whole: F.asin(F.sqrt(F.least(F.lit(1.0), F.col(part) / F.greatest(F.lit(1), F.col(whole)))))
    raw = (F.log(1.0 + F.col("n_words")) / 4, F.log(1.0 + F.col("word_chars") / F.greatest(F.lit(1), F.col("n_words"))),
           share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words"))
    return [F.round(x * UNITS).cast("bigint").alias(name) for x, name in zip(raw, DIMENSIONS)]


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(DIMENSIONS)) for j in range(i + 1)]


def _moments(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Means and the Cholesky factor of the floored covariance per group, from exact whole sums."""
    sums = [F.sum(x).alias(f"s_{x}") for x in DIMENSIONS]
    products = [F.sum(F.col(DIMENSIONS[i]) * F.col(DIMENSIONS[j])).alias(f"p_{i}{j}") for i, j in _pairs()]
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums, *products)
    means = [(F.col(f"s_{x}") / F.col("n")).alias(f"m_{x}") for x in DIMENSIONS]
    out = out.select("*", *means)
    cover = [((F.col(f"p_{i}{j}") / F.col("n") - F.col(f"m_{DIMENSIONS[i]}") * F.col(f"m_{DIMENSIONS[j]}")) * CONSISTENCY + (FLOOR ** 2 if i == j else 0)).alias(f"c_{i}{j}") for i, j in _pairs()]
    out = out.select(*keys, "n", *(f"m_{x}" for x in DIMENSIONS), *cover)
    for j in range(len(DIMENSIONS)):
        left = lambda i, j=j: reduce(lambda a, k: a - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}"), range(j), F.col(f"c_{i}{j}"))
        out = out.withColumn(f"l_{j}{j}", F.sqrt(F.greatest(left(j), F.lit(1.0))))
        for i in range(j + 1, len(DIMENSIONS)):
            out = out.withColumn(f"l_{i}{j}", left(i) / F.col(f"l_{j}{j}"))
    return out.select(*keys, "n", *(f"m_{x}" for x in DIMENSIONS), *(f"l_{i}{j}" for i, j in _pairs()))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution through the factor."""
    solved: list[Column] = []
    for i, x in enumerate(DIMENSIONS):
        top = reduce(lambda a, k: a - F.col(f"l_{i}{k}") * solved[k], range(i), F.col(x) - F.col(f"m_{x}"))
        solved.append(top / F.col(f"l_{i}{i}"))
    return reduce(lambda a, b: a + b, (y * y for y in solved))


def _with(rows: DataFrame, estimates: DataFrame, keys: list[str], spread: str) -> DataFrame:
    """Rows with their group's estimate: a broadcast while the groups are few, else a split shuffle."""
    if estimates.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(estimates), keys)
    return salted_join(estimates, rows, keys, spread)


def _inner(far: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The rows within the grid distance that ``share`` of their group does not exceed, ties included.
    Ranks come from counts per grid cell, so no group is sorted in one task."""
    cells = far.groupBy(*keys, "cell").agg(F.count(F.lit(1)).alias("n"))
    upto, whole = Window.partitionBy(*keys).orderBy("cell"), Window.partitionBy(*keys)
    ranked = cells.select(*keys, "cell", F.sum("n").over(upto).alias("reached"), F.sum("n").over(whole).alias("total"))
    edge = ranked.filter(F.col("reached") >= F.col("total") * share).groupBy(*keys).agg(F.min("cell").alias("edge"))
    return _with(far, settle(edge), keys, "_row").filter(F.col("cell") <= F.col("edge"))


def _medians(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Start of the concentration: the rows nearest to the coordinatewise medians, in robust units."""
    parts = []
    for x in DIMENSIONS:
        cells = rows.groupBy(*keys, F.col(x).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        upto, whole = Window.partitionBy(*keys).orderBy("v"), Window.partitionBy(*keys)
        ranked = cells.select(*keys, "v", F.sum("n").over(upto).alias("reached"), F.sum("n").over(whole).alias("total"))
        at = lambda q: F.min(F.when(F.col("reached") >= F.col("total") * q, F.col("v")))
        parts.append(ranked.groupBy(*keys).agg(at(0.5).alias(f"m_{x}"), ((at(0.75) - at(0.25)) / 1.349).alias(f"d_{x}")))
    out = reduce(lambda a, b: a.join(b, keys), parts)
    spread = [F.greatest(F.lit(float(FLOOR)), F.col(f"d_{x}")) for x in DIMENSIONS]
    factor = [(spread[i] if i == j else F.lit(0.0)).alias(f"l_{i}{j}") for i, j in _pairs()]
    return out.select(*keys, *(F.col(f"m_{x}").cast("double").alias(f"m_{x}") for x in DIMENSIONS), *factor)


def estimates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The minimum covariance determinant estimate of every group of ``keys``."""
    current = settle(_medians(rows, keys))
    for _ in range(STEPS):
        cell = F.floor(F.log(1.0 + _distance()) * GRID).alias("cell")
        far = _with(rows, current, keys, "_row").select("_row", *keys, *DIMENSIONS, cell)
        current = settle(_moments(_inner(far, keys, KEEP), keys))
    return current


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    distance`` for every row of ``docs``.

    ``base_failed``: under ten words, or over a fifth of them in repeated five-word windows.  The other
    rows form the groups; ``kept`` is false for failed rows and for those whose squared distance is
    above the cutoff.  A null text counts as empty; null languages and sources are groups of their own;
    repeated rows are each judged; an empty table gives no rows; other columns are ignored.
    """
    named = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang"),
                        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("_source"))
    base = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = settle(counts(named, ["_id", "_lang", "_source"], "_t").select("*", base.alias("base_failed"), *statistics(), F.monotonically_increasing_id().alias("_row")))
    good = counted.filter(~F.col("base_failed")).select("_row", "_lang", "_source", *DIMENSIONS)
    sizes = good.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))
    # Every group of (language, source) is named by what it is estimated from: itself, its language, or all.
    level = (sizes.select("_lang", "_source", "n", F.sum("n").over(Window.partitionBy("_lang")).alias("in_lang"))
             .select("_lang", "_source", F.when(F.col("n") >= GROUP_ROWS, F.struct("_lang", "_source"))
                     .when(F.col("in_lang") >= GROUP_ROWS, F.struct("_lang", F.lit(None).cast("string").alias("_source")))
                     .otherwise(F.struct(F.lit(None).cast("string").alias("_lang"), F.lit(None).cast("string").alias("_source"))).alias("_of"))
             .select("_lang", "_source", F.to_json("_of").alias("_group")))
    level = settle(level)
    own = settle(_with(good, level, ["_lang", "_source"], "_row").select("_row", "_lang", "_source", *DIMENSIONS, "_group"))
    # An estimate for a language or for all texts is made from all of them, not only the small groups.
    both = own.select("_row", *DIMENSIONS, F.explode(F.array(
        F.to_json(F.struct("_lang", "_source")), F.to_json(F.struct("_lang", F.lit(None).cast("string").alias("_source"))),
        F.to_json(F.struct(F.lit(None).cast("string").alias("_lang"), F.lit(None).cast("string").alias("_source"))))).alias("_group"))
    used = settle(both.join(F.broadcast(level.select("_group").distinct()), "_group", "left_semi") if level.count() <= BROADCAST_GROUPS else both)
    fitted = estimates(used, ["_group"])
    far = _with(own, fitted, ["_group"], "_row").select("_row", _distance().alias("distance"))
    # Rows that failed the base rules have no distance.
    out = counted.join(far, "_row", "left")
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= CUTOFF)).alias("kept"), "distance")
