"""Secret scan: fixed patterns, and Markov models of random strings and ordinary identifiers.

Both models give the chance of a character after the one before it. The random
one is learned from the strings that the fixed patterns label as secrets, mixed
with a uniform choice of characters, as labelled strings use only some
alphabets. The ordinary one is learned from the tokens of all documents without
such a match. Every token of 12 characters or more is judged by the models'
log-likelihood ratio: its mean over the token's pairs, so that length does not
decide, must reach a margin, and its sum certain odds. The margin is learned
too: it lies between the ordinary tokens' ratios and those of labelled strings
that were held out. Counts and ratios cover the whole corpus. All steps are
DataFrame functions; only tables of character pairs and of binned ratios, of
fixed size, go through the driver.

Defined results: a null text is an empty one, without spans; spans count code
points, end exclusive; per kind they do not overlap; a token that touches a span
of a fixed pattern is not reported again; without labelled strings the Markov
models add nothing; repeated rows are scanned alike; an empty table gives an
empty result; other columns stay, but one named ``spans`` is replaced where
spans are returned.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movelens.llm.text_ids import whole_text
from movelens.sources.staging import stage, unstage

# The base patterns and how many characters make a match.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
ASSIGN_VALUE = 6
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "markov")

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Tokens that are learned from and judged.
TOKEN = "[A-Za-z0-9+/_=-]{12,}"
#: Least natural log of the odds of a token to be a secret; share of labelled strings held out for the margin, one in so many.
MARGIN, HELD_OUT = 12.0, 5
#: Share of the uniform choice in the random model, and limit of a single pair's ratio.
UNIFORM, CLAMP = 0.5, 6.0
#: Weight of the fall-back, as a share of what a first character is seen on average.
FALLBACK = 0.05
#: Shares of ordinary tokens and of labelled strings that the margin leaves beyond it; width of the bins of ratios.
ORDINARY_TAIL, SECRET_TAIL, BIN = 0.1, 0.05, 0.05

_SPANS = "array<struct<s:int,e:int,v:string>>"


def _spans(text: str, pattern: str, group: int) -> str:
    """SQL for the matches of a pattern: start, end and one group, in one pass over gaps and matches.

    Gaps and matches alternate, so running lengths give the places.
    """
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    value = "v.m[i - 1]" if group == 0 else "v.x[i - 1]"
    start = "a.at + char_length(v.g[i - 1])"
    end = f"{start} + char_length(v.m[i - 1])"
    extra = "" if group == 0 else f", 'x', regexp_extract_all({text}, {p}, {group})"
    return f"""element_at(transform(array(named_struct('m', regexp_extract_all({text}, {p}, 0), 'g', split({text}, {p}, -1){extra})), v ->
        CASE WHEN size(v.m) = 0 THEN CAST(array() AS {_SPANS}) ELSE aggregate(
          sequence(1, size(v.m)), named_struct('at', 0, 'out', CAST(array() AS {_SPANS})),
          (a, i) -> named_struct('at', {end}, 'out', concat(a.out, array(named_struct('s', {start}, 'e', {end}, 'v', {value})))),
          a -> a.out) END), 1)"""


def _base(text: str) -> dict[str, Column]:
    """assign, access and hex (spans) of a text column."""
    empty = F.expr(f"CAST(array() AS {_SPANS})")
    low = F.lower(text)
    named = F.lit(False)
    for k in KEYWORDS:
        named = named | F.contains(low, F.lit(k))
    return {
        "assign": F.when(named, F.filter(F.expr(_spans(text, ASSIGN, 2)), lambda s: F.char_length(s["v"]) >= ASSIGN_VALUE)).otherwise(empty),
        "access": F.when(F.contains(text, F.lit("AKIA")), F.expr(_spans(text, ACCESS, 0))).otherwise(empty),
        "hex": F.when(F.col(text).rlike(HEX), F.expr(_spans(text, HEX, 0))).otherwise(empty),
    }


def _found(docs: DataFrame, text: str) -> DataFrame:
    """What the models learn from: ``secrets`` (strings of the fixed patterns) and ``words`` (tokens of texts without any)."""
    d = docs.select(whole_text(text).alias("t"))
    d = d.select("t", F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)).alias("words"), *[c.alias(k) for k, c in _base("t").items()])
    secrets = F.transform(F.concat("assign", "access", "hex"), lambda x: x["v"])
    d = d.select(secrets.alias("secrets"), "words").filter((F.size("secrets") > 0) | (F.size("words") > 0))
    return d.select("secrets", F.when(F.size("secrets") > 0, F.array().cast("array<string>")).otherwise(F.col("words")).alias("words"))


def _pair_counts(strings: DataFrame) -> dict[str, int]:
    """How often each pair of characters occurs in column ``s``: at most the square of the alphabet."""
    chars = strings.filter(F.char_length("s") > 1).select(F.regexp_extract_all("s", F.lit("(?s)."), F.lit(0)).alias("c"))
    pairs = chars.select(F.explode(F.expr("zip_with(slice(c, 1, size(c) - 1), slice(c, 2, size(c) - 1), (x, y) -> concat(x, y))")).alias("p"))
    letters = F.translate(F.col("p"), ALPHABET, "") == ""
    return {r.p: r.n for r in pairs.filter(letters).groupBy("p").agg(F.count(F.lit(1)).alias("n")).collect()}


def pair_weights(random: dict[str, int], ordinary: dict[str, int]) -> list[float]:
    """Log-likelihood ratio of every pair of the alphabet, a single one limited to ``CLAMP``.

    A pair's chance falls back on that of its second character where the first
    is rare: what a few unlabelled secrets among the ordinary tokens hold
    teaches the ordinary model little.
    """
    size = len(ALPHABET)

    def chances(counts: dict[str, int], uniform: float) -> list[float]:
        single = {b: 1 + sum(counts.get(a + b, 0) for a in ALPHABET) for b in ALPHABET}
        every = sum(single.values())
        belief = max(1.0, FALLBACK * every / size)
        out = []
        for a in ALPHABET:
            total = belief + sum(counts.get(a + b, 0) for b in ALPHABET)
            out += [uniform / size + (1 - uniform) * (counts.get(a + b, 0) + belief * single[b] / every) / total for b in ALPHABET]
        return out

    if not random:
        return [0.0] * (size * size)
    ratios = (math.log(x / y) for x, y in zip(chances(random, UNIFORM), chances(ordinary, 0.0), strict=True))
    return [round(max(-CLAMP, min(CLAMP, r)), 6) for r in ratios]


def _ratio(weights: list[float]) -> Callable[[Column], Column]:
    """Summed log-likelihood ratio of a token, over its pairs of characters."""
    places = [0] * 128
    for i, c in enumerate(ALPHABET):
        places[ord(c)] = i
    table, place = (F.expr("array(" + ", ".join(f"{x!r}{kind}" for x in values) + ")") for values, kind in ((weights, "D"), (places, "")))

    def ratio(token: Column) -> Column:
        codes = F.transform(F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0)), lambda c: F.get(place, F.ascii(c)))
        # walks the characters once: (last place, sum)
        start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("sum"))
        step = lambda a, c: F.struct(
            c.alias("last"), (a["sum"] + F.when(a["last"] < 0, F.lit(0.0)).otherwise(F.get(table, a["last"] * len(ALPHABET) + c))).alias("sum"))
        return F.aggregate(codes, start, step, lambda a: a["sum"])

    return ratio


def _quantile(bins: dict[int, int], share: float) -> float:
    """Lower edge of the bin in which the given share of all is passed."""
    passed, total = 0, sum(bins.values())
    for b in sorted(bins):
        passed += bins[b]
        if passed >= share * total:
            return b * BIN
    return 0.0


@dataclass(frozen=True)
class Judge:
    """Weights of pairs, the least sum and the least mean of a token that counts as random; no mean where nothing was learned."""

    weights: tuple[float, ...]
    least_sum: float
    least_mean: float | None

    def ratio(self, token: Column) -> Column:
        return _ratio(list(self.weights))(token)

    def passes(self, token: Column, ratio: Column) -> Column:
        if self.least_mean is None:
            return F.lit(False)
        return (ratio > self.least_sum) & (ratio >= self.least_mean * (F.char_length(token) - 1))


def learn(docs: DataFrame, text: str, margin: float = MARGIN) -> Judge:
    """Models and margin from a corpus."""
    found = stage(_found(docs, text), "secrets")
    secrets = found.select(F.explode("secrets").alias("s"))
    held = F.pmod(F.xxhash64("s"), F.lit(HELD_OUT)) == 0
    random = _pair_counts(secrets.filter(~held))
    ordinary = found.select(F.explode("words").alias("s"))
    weights = pair_weights(random, _pair_counts(ordinary))
    least = None
    if random:
        ratio = _ratio(weights)(F.col("s")) / (F.char_length("s") - 1)
        kinds = secrets.filter(held & (F.char_length("s") > 1)).withColumn("secret", F.lit(True)).unionByName(ordinary.withColumn("secret", F.lit(False)))
        counted = kinds.groupBy("secret", F.floor(ratio / BIN).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()  # bins are few: ratios are limited
        known = {k: {r.bin: r.n for r in counted if r.secret == k} for k in (True, False)}
        top = _quantile(known[False], 1 - ORDINARY_TAIL) + BIN
        least = max(top, (top + _quantile(known[True], SECRET_TAIL)) / 2 if known[True] else 2 * top)
    unstage(found)
    return Judge(tuple(weights), margin, least)


def _scanned(docs: DataFrame, text: str, judge: Judge) -> DataFrame:
    """``row`` (all columns of ``docs``), ``t`` (the whole text) and ``spans``, by start and kind."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), whole_text(text).alias("t"))
    d = d.select("row", "t", *[c.alias(k) for k, c in _base("t").items()], F.regexp_extract_all("t", F.lit(TOKEN), F.lit(0)).alias("tokens"))
    if judge.least_mean is None:
        markov = F.expr(f"CAST(array() AS {_SPANS})")
    else:
        # only texts with a token that passes are cut into gaps and tokens
        some = F.exists("tokens", lambda x: judge.passes(x, judge.ratio(x)))
        base = F.concat("assign", "access", "hex")
        free = lambda x: ~F.exists(base, lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))
        markov = F.when(some, F.filter(F.expr(_spans("t", TOKEN, 0)), free)).otherwise(F.expr(f"CAST(array() AS {_SPANS})"))
    d = d.select("row", "t", "assign", "access", "hex", markov.alias("free"))
    rated = F.transform("free", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["v"].alias("v"), judge.ratio(x["v"]).alias("r")))
    d = d.select("row", "t", "assign", "access", "hex", F.filter(rated, lambda x: judge.passes(x["v"], x["r"])).alias("added"))
    spans = [F.transform(k, _as_span(k)) for k in KINDS[:3]]
    added = F.transform("added", lambda x: _span("markov", x, x["r"]))
    return d.select("row", "t", F.array_sort(F.concat(*spans, added)).alias("spans"))


def scan(docs: DataFrame, text: str, margin: float = MARGIN) -> DataFrame:
    """``docs`` without the text and with ``spans``: an array of (kind, s, e, ratio), by start and kind."""
    found = _scanned(docs, text, learn(docs, text, margin))
    keep = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in (text, "spans")]
    return found.select(*keep, F.transform("spans", lambda x: F.struct(x["kind"], x["s"], x["e"], x["ratio"])).alias("spans"))


def _span(kind: str, x: Column, r: Column) -> Column:
    return F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"), r.alias("ratio"))


def _as_span(kind: str) -> Callable[[Column], Column]:
    return lambda x: _span(kind, x, F.lit(None).cast("double"))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan_report(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Counts, digest of the base spans and list of all spans per row."""
    found = scan(docs.select(key, text), text)

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = listed(F.filter("spans", lambda x: x["kind"] != "markov"))
    return found.select(key, *map(count, KINDS[:3]), F.sha2(base.cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count("markov"))


def redact(docs: DataFrame, text: str, mask: str = "[secret]") -> DataFrame:
    """``docs`` with every span, overlapping ones taken together, replaced by a mask."""
    found = _scanned(docs, text, learn(docs, text))
    cut = F.expr("""aggregate(spans, named_struct('at', 0, 'out', ''), (a, x) -> CASE
        WHEN x.e <= a.at THEN a
        WHEN x.s < a.at THEN named_struct('at', x.e, 'out', a.out)
        ELSE named_struct('at', x.e, 'out', concat(a.out, substring(t, a.at + 1, x.s - a.at), '{mask}')) END,
        a -> concat(a.out, substring(t, a.at + 1)))""".replace("{mask}", mask.replace("\\", "\\\\").replace("'", "\\'")))
    old = F.col("row").getField(text)
    return found.select(*[F.when(F.size("spans") > 0, cut).otherwise(old).alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns])
