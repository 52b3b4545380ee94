"""Secrets in texts, as DataFrame expressions: fixed patterns, and strings that look random to Markov models.

Two first-order Markov models of characters, one of random strings and one of ordinary identifiers, are
counted on labelled samples: values that the patterns find, and other words. A long token is a secret if the
first model explains it better than the second by a log-likelihood ratio of at least a threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns, in the order in which spans that begin together are listed; and what a match must hold.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"(?<![0-9a-f])[0-9a-f]+",
}
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = [*PATTERNS, "random"]
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Characters that the models tell apart, letters without case.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SPANS = "array<struct<start:int,kind:int,end:int>>"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _placed(text: Column, pattern: str, found: Column, kind: str, wanted: Callable[[Column], Column]) -> Column:
    """The spans, in code points, of those of the matches ``found`` of ``pattern`` that are wanted."""
    def step(between: Column) -> Callable[[Column, Column], Column]:
        def add(s: Column, i: Column) -> Column:
            start = s["at"] + F.length(F.get(between, i))
            match = F.get(found, i)
            span = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                            (start + F.length(match)).alias("end"))
            return F.struct((start + F.length(match)).alias("at"), F.when(
                wanted(match), F.concat(s["out"], F.array(span))).otherwise(s["out"]).alias("out"))

        return add

    begin = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    return _once(F.split(text, pattern, -1), lambda b: F.aggregate(
        F.sequence(F.lit(0), F.size(found) - 1), begin, step(b), lambda s: s["out"]))


def _value(match: Column) -> Column:
    return F.regexp_extract(match, PATTERNS["assign"], 2)


def _wanted(kind: str) -> Callable[[Column], Column]:
    return lambda m: F.length(_value(m) if kind == "assign" else m) >= LEAST[kind]


def _spans(text: Column, kind: str, pattern: str, wanted: Callable[[Column], Column]) -> Column:
    # The text is looked at once more, for places, only where a match is wanted at all.
    nothing = F.array().cast(SPANS)
    return _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.exists(found, wanted), _placed(text, pattern, found, kind, wanted)).otherwise(nothing))


def pattern_spans(text: Column, kind: str) -> Column:
    """Leftmost matches of a kind that don't overlap, those that are too short left out."""
    # A run of hexadecimal digits that is long enough is a run of them anyway; so the others needn't be listed.
    pattern = PATTERNS[kind] if kind != "hex" else PATTERNS[kind][:-1] + f"{{{LEAST['hex']},}}"
    return _spans(text, kind, pattern, _wanted(kind))


def _chars(token: Column) -> Column:
    return F.filter(F.split(F.lower(token), "", -1), lambda c: c != "")


def _pairs(token: Column) -> Column:
    """Each character of a token with the one after it."""
    return _once(_chars(token), lambda c: F.zip_with(
        F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.size(c)), lambda x, y: F.concat(x, y)))


def fit(docs: DataFrame, text: str = "text") -> list[float]:
    """The log-likelihood ratios of each pair of characters: random against ordinary.

    Learnt from all documents: what the patterns find labels the random samples, and the words of four characters or more
    without such digits or access keys are the ordinary ones. Equal tokens are counted before they are taken apart, and
    only the counts of pairs, at most twice those of the alphabet, go to the driver. Half the probability of a random string is spread evenly, as few samples
    can't show every pair; ordinary pairs never seen count as a tenth. Null and empty texts teach nothing; without any token all
    ratios are 0. A token of any length is taken apart in one pass.
    """
    body = F.col(f"`{text}`").cast("string")
    values = F.filter(F.concat(
        F.transform(F.regexp_extract_all(body, F.lit(PATTERNS["assign"]), F.lit(0)), _value),
        F.regexp_extract_all(body, F.lit("[0-9a-f]{24,}"), F.lit(0))), lambda v: F.length(v) >= LEAST["assign"])
    words = F.filter(F.regexp_extract_all(body, F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0)),
                     lambda w: ~w.rlike("[0-9a-f]{24}|AKIA[A-Z0-9]{16}"))

    def labelled(tokens: Column, random: bool) -> Column:
        return F.transform(tokens, lambda t: F.struct(F.lit(random).alias("random"), t.alias("token")))

    tokens = docs.where(F.length(body) > 0).select(F.inline(F.concat(labelled(values, True), labelled(words, False))))
    pairs = tokens.groupBy("random", "token").agg(F.count(F.lit(1)).alias("n")).select(
        "random", "n", F.explode(_pairs(F.col("token"))).alias("pair")).groupBy("random", "pair").agg(F.sum("n").alias("n"))
    counts = {(r["random"], r["pair"]): r["n"] for r in pairs.where(F.col("pair").rlike(f"^[{ALPHABET}]{{2}}$")).collect()}
    random, ordinary = ({pair: n for (kind, pair), n in counts.items() if kind is which} for which in (True, False))
    n, out = len(ALPHABET), []
    for a in ALPHABET:
        seen, known = (sum(c.get(a + b, 0) for b in ALPHABET) for c in (random, ordinary))
        for b in ALPHABET:
            likely = 0.5 / n + 0.5 * (random.get(a + b, 0) / seen if seen else 1 / n)
            out.append(math.log(likely) - math.log((ordinary.get(a + b, 0) + 0.1) / (known + 0.1 * n)))
    return out


def ratio(token: Column, ratios: list[float]) -> Column:
    """The log-likelihood ratio of a token, all of whose characters must be in the alphabet."""
    table = F.split(F.lit(",".join(f"{r:.5f}" for r in ratios)), ",").cast("array<double>")  # folded to a constant
    places = F.transform(_chars(token), lambda c: F.position(c, F.lit(ALPHABET)) - 1)
    return _once(places, lambda p: F.aggregate(
        F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), lambda a, b: a * len(ALPHABET) + b),
        F.lit(0.0).cast("double"), lambda total, k: total + F.get(table, k)))


def _without(text: Column, pattern: str, wanted: Callable[[Column], Column]) -> Column:
    """The text with spaces in place of wanted matches."""
    def blank(found: Column) -> Column:
        return F.array_join(F.transform(F.split(text, pattern, -1), lambda piece, i: F.concat(piece, F.coalesce(
            F.when(wanted(F.get(found, i)), F.repeat(F.lit(" "), F.length(F.get(found, i)))).otherwise(
                F.get(found, i)), F.lit("")))), "")

    return _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.exists(found, wanted), blank(found)).otherwise(text))


def found(docs: DataFrame, ratios: list[float], text: str = "text", threshold: float = 20.0) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: where secrets are, by pattern, and these with random-looking tokens.

    Spans are structs ``start, kind, end`` in code points, end exclusive, in that order; ``kind`` is an index
    in KINDS. Random-looking are tokens of 20 characters or more whose log-likelihood ratio is ``threshold`` or
    more and that stand outside all spans by pattern. Null and empty texts have no spans, an empty table gives no rows; columns named
    ``base`` and ``spans`` are replaced, all others and repeated rows stay. A token is looked through once, however long.
    """
    source = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    base = docs.withColumn("base", F.array_sort(F.concat(*(pattern_spans(source, k) for k in PATTERNS))))
    rest = source
    for kind, pattern in PATTERNS.items():
        rest = _without(rest, pattern, _wanted(kind))
    rest = F.when(F.size("base") > 0, rest).otherwise(source)
    random = _once(rest, lambda t: _spans(t, "random", TOKEN, lambda m: ratio(m, ratios) >= threshold))
    return base.withColumn("spans", F.array_sort(F.concat("base", random)))


def listed(spans: str) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
