"""Text normalisation and tokens as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that carry no evidence.
STOP_WORDS = """
a an and are as at be best by can capability data do does each find fits for
from geometry geometric get have how i in into is it its me method my need of on
or perform please process processing result run should supported than that the
their them these this to use using want what when which with without would you
your available computation compute task input output choose help information
""".split()

# Suffix, shortest word length it applies to, letters dropped, letters added.
STEM_RULES = [("ies", 6, 3, "y"), ("ing", 7, 3, ""), ("ated", 7, 1, ""), ("ited", 7, 1, ""), ("ed", 6, 2, "")]
# Suffix and its replacement; at least four letters must stay in front.
CANONICAL_RULES = [("ification", "if"), ("ify", "if"), ("ation", "at"), ("ions", ""), ("ion", "")]

# What a word is, the range of Chinese and Japanese characters, the spellings of "2d".
WORD = "[a-z][a-z0-9]*|[23]d"
CJK_RUN = "[\\u3040-\\u30ff\\u3400-\\u9fff\\uff66-\\uff9f]+"
# Particles that separate segments, and request phrases that carry no content.
CJK_PARTICLES = "のをはがにでともやへ"
CJK_BOILERPLATE = """
してください して下さい してほしい してもらいたい してもらえ したいです したい たいです お願いします お願い ください 下さい
ほしい 欲しい ですか でしょうか ます です ません できる でき について において として という ような ように による により
ための ために から まで ので ながら しながら する した して され さ?れる いる ある ない もの こと など
""".split()
TWO_D = ("(?<![a-z0-9])(?:2\\s*[-‐‑–—]?\\s*d|2\\s*[-‐‑–—]?\\s*dimensional|two\\s*[-‐‑–—]?\\s*dimensional"
         "|2\\s*次元|二次元)(?![a-z0-9])")
#: Words of any language, and what ends a word in running text.
ANY_WORD = "[\\p{L}\\p{M}\\p{N}_]+"
WORD_ENDS = "[\\s\u3000\u3001\u3002\uff01\uff0c\uff1f]+"


@F.pandas_udf(T.StringType())
def fold_compatible(text: pd.Series) -> pd.Series:
    """NFKC and case folding, which Spark SQL has no functions for."""
    return text.map(lambda s: unicodedata.normalize("NFKC", s).casefold(), na_action="ignore")


def normalize_text(text: Column, compatible: bool = False) -> Column:
    """Lower case, underscores to spaces, one spelling of "2d", single spaces.

    ``compatible`` adds NFKC and full case folding through an Arrow UDF; without it the expression
    stays in the JVM and differs only on compatibility characters.
    """
    folded = fold_compatible(text) if compatible else F.lower(text)
    unified = F.regexp_replace(F.replace(folded, F.lit("_"), F.lit(" ")), TWO_D, " 2d ")
    return F.trim(F.regexp_replace(unified, "\\s+", " "))


def stem(word: Column) -> Column:
    out: Column | None = None
    for suffix, shortest, drop, extra in STEM_RULES:
        cut = F.concat(F.left(word, F.length(word) - drop), F.lit(extra))
        test = word.endswith(suffix) & (F.length(word) >= shortest)
        out = F.when(test, cut) if out is None else out.when(test, cut)
    plural = word.endswith("s") & (F.length(word) > 4) & ~word.endswith("ss") & ~word.endswith("sis")
    return out.when(plural, F.left(word, F.length(word) - 1)).otherwise(word)


def _family(short: Column) -> Column:
    out: Column | None = None
    for suffix, new in CANONICAL_RULES:
        keep = F.length(short) - len(suffix)
        value = F.concat(F.left(short, keep), F.lit(new))
        test = short.endswith(suffix) & (keep >= 4)
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise(short)


def _drop_e(base: Column) -> Column:
    return F.when(base.endswith("e") & (F.length(base) > 5), F.left(base, F.length(base) - 1)).otherwise(base)


def canonical(words: Column) -> Column:
    """Stem, then one common spelling per word family.  One array pass per step: nested in a single
    pass, each step would evaluate the one before it many times per word."""
    return F.transform(F.transform(F.transform(words, stem), _family), _drop_e)


def _kept_words(normalized: Column) -> Column:
    long_enough = F.filter(F.regexp_extract_all(normalized, F.lit(WORD), F.lit(0)), lambda w: (F.length(w) >= 3) | w.isin("2d", "3d"))
    return F.array_except(long_enough, F.array(*[F.lit(w) for w in STOP_WORDS]))


def content_words(normalized: Column) -> Column:
    """Distinct stemmed words that are not stop words."""
    return F.array_distinct(F.transform(_kept_words(normalized), stem))


def _cjk_bigrams(normalized: Column) -> Column:
    runs = F.regexp_extract_all(normalized, F.lit(CJK_RUN), F.lit(0))
    cleaned = F.transform(runs, lambda r: F.regexp_replace(r, "|".join(CJK_BOILERPLATE), " "))
    parts = F.flatten(F.transform(cleaned, lambda r: F.filter(
        F.split(r, f"[{CJK_PARTICLES}\\s]+"), lambda p: F.length(p) > 0)))
    singles = F.transform(F.filter(parts, lambda p: (F.length(p) == 1) & ~p.rlike("[ぁ-ゟ]")),
                          lambda p: F.concat(F.lit("ja:"), p))
    pairs = F.flatten(F.transform(F.filter(parts, lambda p: F.length(p) > 1), lambda p: F.transform(
        F.sequence(F.lit(1), F.length(p) - 1), lambda n: F.concat(F.lit("ja:"), p.substr(n, F.lit(2))))))
    return F.concat(singles, pairs)


def tokens(normalized: Column, cjk: bool = True) -> Column:
    """Distinct canonical words, plus character bigrams of CJK runs."""
    words = canonical(_kept_words(normalized))
    if cjk:
        # Most texts hold no CJK character; the cheap test skips the nested arrays.
        extra = F.when(normalized.rlike(CJK_RUN), _cjk_bigrams(normalized)).otherwise(F.array().cast("array<string>"))
        words = F.concat(words, extra)
    return F.array_distinct(words)


def search_terms(normalized: Column) -> Column:
    """Terms to look for inside texts of any language: content words, words with other than ASCII letters,
    and the character trigrams of CJK runs.  Terms have three characters or more."""
    other = F.filter(F.regexp_extract_all(normalized, F.lit(ANY_WORD), F.lit(0)), lambda w: w.rlike("[^\\x00-\\x7f]") & ~w.rlike(CJK_RUN))
    runs = F.filter(F.regexp_extract_all(normalized, F.lit(CJK_RUN), F.lit(0)), lambda r: F.length(r) >= 3)
    grams = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 2), lambda n: r.substr(n, F.lit(3)))))
    return F.array_distinct(F.filter(F.concat(content_words(normalized), other, grams), lambda w: F.length(w) >= 3))


def ngrams(words: Column, longest: int) -> Column:
    """All runs of 1..longest consecutive words, joined by one blank."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - (n - 1))
        runs = F.transform(starts, lambda p: F.array_join(F.slice(words, p, n), " "))
        return F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<string>"))

    runs = [of(n) for n in range(1, longest + 1)]
    return F.array_distinct(F.flatten(F.array(*runs)))


def pieces(word: Column, lengths: list[int]) -> Column:
    """All substrings of ``word`` with one of the given lengths, repeats kept."""
    def of(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(word) - (n - 1))
        return F.when(F.length(word) >= n, F.transform(starts, lambda p: word.substr(p, F.lit(n)))) \
            .otherwise(F.array().cast("array<string>"))

    return F.flatten(F.array(*[of(n) for n in sorted(lengths)]))


def marked_words(normalized: Column) -> Column:
    """Words with every other character as a word of its own, so a phrase cannot cross it."""
    spaced = F.regexp_replace(normalized, "([^a-z0-9 ])", " $1 ")
    return F.split(F.trim(F.regexp_replace(spaced, " +", " ")), " ")
