"""Personal data by weak supervision, in DataFrame functions only.

Base patterns give the spans that are always kept.  Wider patterns give more candidates.  On every
candidate five labelers vote for, against, or not at all: the strict form, a checksum or range, a
gazetteer, the words before it, and its borders.  Expectation-maximisation over the counted vote
patterns estimates how reliable each labeler is; the resulting soft labels train a naive Bayes
classifier on features of the span, and candidates that it accepts become spans too.

Matches and their positions come from splitting the text at the pattern, so the work is linear in the
text and everything stays within its row; only the bounded table of vote patterns reaches the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle

# The base patterns, written so that a long run of characters is scanned once.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGITS = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_OCTETS = r"^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(\.0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"

# Wider patterns; the value is the group at the end of the match.
SECRET = r"(?i)(?:token|key|secret|password|passwd|pwd)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9+/_-]{16,}+)"
LOCAL_PHONE = r"(?<!\+[0-9]{1,3}[\x20.-])(?<![0-9+(])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"
HIDDEN_EMAIL = r"[A-Za-z0-9._%+-]{1,64}+\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])"

KINDS = ("email", "ip", "card", "phone", "secret", "social", "iban")

# Gazetteers: top-level domains, card issuer prefixes, private and example networks, calling codes.
_DOMAINS = r"(?i)\.(com|org|net|edu|gov|info|io|de|fr|es|uk|eu|it|nl|ch|at|ca|us)$"
_ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65)"
_SPECIAL_NETWORKS = r"^(0|127|255)\."
_CALLING = r"^\+?(1|3[0-9]|4[0-9]|5[1-8]|6[0-6]|7|8[1246]|9[0-58])"
# Words before a span that speak for or against personal data.
_FOR = r"(?i)(mail|contact|phone|tel|call|mobile|fax|card|visa|account|konto|compte|cuenta|ip|host|address|token|secret|password|key|ssn|iban)\W{0,4}\w{0,8}\W{0,4}$"
_AGAINST = r"(?i)(version|isbn|issn|doi|page|section|figure|table|order|sku|sha1|sha256|md5|commit|build|serial)\W{0,4}$"
LABELERS = ("form", "check", "gazetteer", "context", "border")
FEATURES = ("size", "digits", "left", "right", "cue")
ROUNDS = 25


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def _sums_before(values: Column) -> Column:
    """For each element the sum of those before it, through blocks of about the square root."""
    add = lambda array: F.aggregate(array, F.lit(0).cast("bigint"), lambda a, x: a + x)
    def with_width(s: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(s["v"]) - 1) / s["w"]).cast("int")), lambda j: add(F.slice(s["v"], j * s["w"] + 1, s["w"])))
        starts = lambda b: F.transform(b, lambda _, j: add(F.slice(b, F.lit(1), j)))
        inner = lambda b: F.transform(s["v"], lambda _, k: F.get(b, F.floor(k / s["w"]).cast("int")) + add(F.slice(s["v"], F.floor(k / s["w"]).cast("int") * s["w"] + 1, k % s["w"])))
        return _let(blocks, lambda b: _let(starts(b), inner))
    some = _let(F.struct(values.alias("v"), F.ceil(F.sqrt(F.size(values))).cast("int").alias("w")), with_width)
    return F.when(F.size(values) > 0, some).otherwise(F.array().cast("array<bigint>"))


def _matches(text: Column, kind: str, pattern: str, only_if: Column, group: int = 0) -> Column:
    """``kind, start, stop, value, before, after`` of the leftmost non-overlapping matches."""
    parts = F.struct(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("h"),
                     F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"))
    def placed(s: Column) -> Column:
        lengths = F.transform(s["h"], lambda h, k: (F.length(F.get(s["p"], k)) + F.length(h)).cast("bigint"))
        def span(before: Column) -> Column:
            stop = lambda h, k: F.get(before, k) + F.length(F.get(s["p"], k)) + F.length(h)
            return F.transform(s["h"], lambda h, k: F.struct(
                F.lit(kind).alias("kind"), (stop(h, k) - F.length(F.get(s["g"], k))).alias("start"), stop(h, k).alias("stop"), F.get(s["g"], k).alias("value"),
                F.concat(F.right(F.get(s["p"], k), F.lit(30)), F.substring(h, 1, 24) if group else F.lit("")).alias("before"), F.left(F.get(s["p"], k + 1), F.lit(1)).alias("after")))
        return _let(_sums_before(lengths), span)
    return F.when(only_if, _let(parts, placed)).otherwise(F.array().cast("array<struct<kind:string,start:bigint,stop:bigint,value:string,before:string,after:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    """Whether the digits pass the check sum that doubles every second one from the right."""
    def doubled(d: Column) -> Column:
        digit = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        each = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(F.when(digit(i) > 4, digit(i) * 2 - 9).otherwise(digit(i) * 2))
        return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda a, i: a + each(i)) % 10 == 0
    return _let(_digits(value), doubled)


def _in(low: int, high: int, value: Column) -> Column:
    return F.length(_digits(value)).between(low, high)


def candidates(picked: DataFrame) -> DataFrame:
    """The columns of ``picked`` (one is ``_text``) with the arrays of base spans, one per base kind, and
    of further candidates."""
    text, has_digits = F.col("_text"), F.col("_text").rlike("[0-9][ -]?[0-9][ -]?[0-9]")
    arrays = picked.select(
        "*",
        _matches(text, "email", EMAIL, text.contains("@")).alias("email"),
        F.filter(_matches(text, "ip", IP, text.rlike(r"[0-9]\.[0-9]")), lambda x: x["value"].rlike(_OCTETS)).alias("ip"),
        F.filter(_matches(text, "card", DIGITS, has_digits), lambda x: _in(13, 19, x["value"])).alias("_runs"),
        F.filter(_matches(text, "phone", PHONE, text.contains("+")), lambda x: _in(9, 15, x["value"])).alias("phone"),
        F.concat(_matches(text, "email", HIDDEN_EMAIL, text.contains("at)") | text.contains("at]")),
                 _matches(text, "phone", LOCAL_PHONE, has_digits),
                 _matches(text, "secret", SECRET, text.contains("=") | text.contains(":"), group=1),
                 _matches(text, "social", SOCIAL, has_digits), _matches(text, "iban", IBAN, has_digits)).alias("_wide"))
    arrays = arrays.withColumn("_checked", F.transform("_runs", lambda x: _luhn(x["value"])))
    card = F.filter("_runs", lambda x, i: F.get(F.col("_checked"), i))
    return arrays.select(*picked.columns, "email", "ip", card.alias("card"), "phone", F.concat(F.filter("_runs", lambda x, i: ~F.get(F.col("_checked"), i)), F.col("_wide")).alias("wide"))


def _votes(x: Column) -> list[Column]:
    """One vote per labeler: 1 for personal data, -1 against, 0 for none."""
    kind, value = x["kind"], x["value"]
    vote = lambda yes, no: F.when(yes, 1).when(no, -1).otherwise(0)
    is_kind = lambda *names: kind.isin(*names)
    never = F.lit(False)
    strict = ((is_kind("email") & value.contains("@")) | (is_kind("phone") & value.startswith("+")) | (is_kind("card") & value.rlike(r"^([0-9]{13,19}|[0-9]{4}([ -][0-9]{4}){3})$"))
              | (is_kind("ip") & value.rlike(_OCTETS)) | (is_kind("secret") & value.rlike(r"[0-9]") & value.rlike("[A-Za-z]")) | is_kind("social", "iban"))
    loose = is_kind("phone", "card") & ~strict
    passed = (is_kind("card") & _luhn(value)) | (is_kind("phone") & _in(10, 13, value)) | (is_kind("ip") & ~value.rlike(_SPECIAL_NETWORKS)) | (is_kind("secret") & (F.size(F.array_distinct(F.split(value, ""))) >= 10))
    failed = (is_kind("card") & ~_luhn(value)) | (is_kind("ip") & value.rlike(_SPECIAL_NETWORKS)) | (is_kind("social") & value.rlike("^(000|666|9)"))
    known = (is_kind("email") & value.rlike(_DOMAINS)) | (is_kind("card") & value.rlike(_ISSUERS)) | (is_kind("phone") & value.rlike(_CALLING))
    unknown = is_kind("card") & ~value.rlike(_ISSUERS)
    glued = x["before"].rlike(r"[\p{L}0-9]$") | x["after"].rlike(r"^[\p{L}0-9]")
    votes = (vote(strict, loose), vote(passed, failed), vote(known, unknown), vote(x["before"].rlike(_FOR), x["before"].rlike(_AGAINST)), vote(~glued & ~is_kind("secret"), glued & ~is_kind("secret") | never))
    return [v.alias(f"v_{name}") for name, v in zip(LABELERS, votes)]


def _features(x: Column) -> list[Column]:
    side = lambda c: F.when(c == "", "none").when(c.rlike(r"^\p{L}$"), "letter").when(c.rlike("^[0-9]$"), "digit").when(c.rlike(r"^\s$"), "space").otherwise("mark")
    size, share = F.length(x["value"]), F.length(_digits(x["value"])) / F.greatest(F.lit(1), F.length(x["value"]))
    cue = F.when(x["before"].rlike(_FOR), "for").when(x["before"].rlike(_AGAINST), "against").otherwise("none")
    cells = (F.least(F.lit(8), F.floor(F.log2(size.cast("double")))).cast("string"), F.floor(share * 4).cast("string"), side(F.right(x["before"], F.lit(1))), side(x["after"]), cue)
    return [c.alias(f"f_{name}") for name, c in zip(FEATURES, cells)]


def reliabilities(patterns: list[tuple[str, tuple[int, ...], float]]) -> tuple[dict, dict[tuple, float]]:
    """Expectation-maximisation over ``kind, votes, count``: how often each labeler casts each vote on
    personal data and on the rest, and the probability of every pattern.  Labelers err independently
    given the truth; each kind has its own share of personal data."""
    belief = {(k, v): 0.9 if sum(v) > 0 else 0.1 for k, v, _ in patterns}
    cast: dict = {}
    for _ in range(ROUNDS):
        cast, prior = defaultdict(lambda: 1.0), defaultdict(lambda: [1.0, 1.0])
        for kind, votes, n in patterns:
            for truth, share in ((1, belief[kind, votes]), (0, 1 - belief[kind, votes])):
                prior[kind][truth] += n * share
                for labeler, vote in enumerate(votes):
                    cast[labeler, truth, vote] += n * share
        total = {(j, t): sum(cast[j, t, v] for v in (-1, 0, 1)) for j in range(len(LABELERS)) for t in (0, 1)}
        for kind, votes, _n in patterns:
            odds = math.log(prior[kind][1] / prior[kind][0])
            for j, vote in enumerate(votes):
                odds += math.log(cast[j, 1, vote] / total[j, 1]) - math.log(cast[j, 0, vote] / total[j, 0])
            belief[kind, votes] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
    return dict(cast), belief


def _weights(counted: list, belief: dict[tuple, float]) -> dict[str, float]:
    """Naive Bayes log odds of ``kind`` and of ``kind|feature|value`` from the soft labels."""
    mass, of_kind = defaultdict(lambda: [0.5, 0.5]), defaultdict(lambda: [0.5, 0.5])
    for r in counted:
        p = belief[r["kind"], tuple(r[f"v_{v}"] for v in LABELERS)]
        for truth, share in ((1, p), (0, 1 - p)):
            of_kind[r["kind"]][truth] += r["n"] * share
            for f in FEATURES:
                mass[f"{r['kind']}|{f}|{r[f'f_{f}']}"][truth] += r["n"] * share
    out = {kind: math.log(n[1] / n[0]) for kind, n in of_kind.items()}
    for key, n in mass.items():
        whole = of_kind[key.split("|")[0]]
        out[key] = math.log(n[1] / whole[1]) - math.log(n[0] / whole[0])
    return out


def _detail(x: Column) -> Column:
    return F.struct(x["kind"], x["start"], x["stop"], *_votes(x), *_features(x))


def _place(x: Column) -> Column:
    return F.struct(x["kind"], x["start"], x["stop"])


def _detailed(picked: DataFrame) -> DataFrame:
    """The columns of ``picked`` but its text, counts per base kind, and both candidate arrays with votes
    and features."""
    wanted = ["email", "ip", "card", "phone"]
    return candidates(picked).select(*picked.columns, *(F.size(k).cast("bigint").alias(f"n_{k}") for k in wanted),
                                     F.transform(F.concat(*wanted), _detail).alias("base"), F.transform("wide", _detail).alias("wide"))


def fit(found: DataFrame) -> dict[str, float]:
    """The classifier's weights from all candidates of ``base`` and ``wide`` arrays."""
    each = found.select(F.explode(F.concat("base", "wide")).alias("x")).select("x.*")
    keys = ["kind", *(f"v_{v}" for v in LABELERS), *(f"f_{f}" for f in FEATURES)]
    counted = each.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).collect()
    totals: dict[tuple, float] = defaultdict(float)
    for r in counted:
        totals[r["kind"], tuple(r[f"v_{v}"] for v in LABELERS)] += r["n"]
    _, belief = reliabilities([(k, v, n) for (k, v), n in sorted(totals.items())])
    return _weights(counted, belief)


def _accepted(weights: dict[str, float]) -> Column:
    """The candidates of ``wide`` that the classifier takes for personal data."""
    table = F.create_map(*(F.lit(y) for item in sorted(weights.items()) for y in item)) if weights else F.lit(None).cast("map<string,double>")
    def score(x: Column) -> Column:
        parts = [F.concat_ws("|", x["kind"], F.lit(f), x[f"f_{f}"]) for f in FEATURES]
        return reduce(lambda a, b: a + b, (F.coalesce(F.try_element_at(table, k), F.lit(0.0)) for k in [x["kind"], *parts]))
    return F.transform(F.filter("wide", lambda x: score(x) > 0), _place)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_email, n_ip, n_card, n_phone, base, spans`` for every row of ``docs``.

    ``base`` and ``spans`` are arrays of ``kind, start, stop`` in code points, by kind, then start;
    ``spans`` holds the base spans and those the classifier accepts.  A null text counts as empty and
    has none; repeated rows are each searched; an empty table gives no rows; other columns are ignored.
    """
    picked = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    found = settle(_detailed(picked).drop("_text"))
    order = F.create_map(*(F.lit(y) for item in {k: i for i, k in enumerate(KINDS)}.items() for y in item))
    ranked = lambda a: F.transform(F.array_sort(F.transform(a, lambda x: F.struct(order[x["kind"]].alias("o"), x["start"], x["stop"], x["kind"]))), _place)
    base = F.transform("base", _place)
    return found.select(F.col("_id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", base.alias("base"),
                        F.when(F.size("wide") == 0, base).otherwise(ranked(F.concat(base, _accepted(fit(found))))).alias("spans"))


def joined(spans: str) -> Column:
    """``kind:start:end`` of a span array, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; the other columns stay, rows
    that repeat stay repeated, and a null text stays null.

    The texts are searched twice, once to fit the classifier and once to replace, so that no text moves
    between tasks.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text")
    weights = fit(settle(_detailed(docs.select(text)).select("base", "wide")))
    whole = F.struct(*docs.columns).alias("_whole")
    found = _detailed(docs.select(whole, text))
    spans = F.array_sort(F.transform(F.concat(F.transform("base", _place), _accepted(weights)), lambda x: F.struct(x["start"], x["stop"], x["kind"])))
    # Spans may overlap: each starts where those before it have ended.
    def cut(s: Column) -> Column:
        ends = F.transform(s["spans"], lambda x, i: F.greatest(F.lit(0), F.array_max(F.transform(F.slice(s["spans"], F.lit(1), i), lambda y: y["stop"]))))
        def parts(e: Column) -> Column:
            head = F.transform(s["spans"], lambda x, i: F.when(x["stop"] <= F.get(e, i), F.lit("")).otherwise(F.concat(
                F.substring(s["text"], (F.get(e, i) + 1).cast("int"), F.greatest(F.lit(0), x["start"] - F.get(e, i)).cast("int")), F.lit("<"), x["kind"], F.lit(">"))))
            last = F.array_max(F.transform(s["spans"], lambda x: x["stop"]))
            return F.concat(F.array_join(head, ""), F.substring(s["text"], (last + 1).cast("int"), F.length(s["text"])))
        return _let(ends, parts)
    placed = found.select("_whole", "_text", spans.alias("_spans"))
    replaced = F.when(F.size("_spans") == 0, F.col(f"_whole.{text_col}")).otherwise(_let(F.struct(F.col("_text").alias("text"), F.col("_spans").alias("spans")), cut))
    return placed.select(*(replaced.alias(c) if c == text_col else F.col(f"_whole.{c}") for c in docs.columns))
