"""URL filter: rules first, else a host's reputation by empirical Bayes.

Labelled page outcomes are counted per host. Each level borrows from the one
above: the prior of a host is the posterior of its registered domain, that one's
prior is the posterior of its suffix, and that one's is the rate over all
labelled pages. How strongly a level holds on to its prior is estimated from how
far its groups scatter around their parents (beta-binomial moments). A host is
blocked if the lower bound of its posterior bad rate is above a limit; hosts
without outcomes are judged by the level above.

Where no other outcomes are given, the pages that a rule decides are the
labelled ones. All steps are DataFrame functions.

Defined results: a null url, or one without ``://``, has an empty host and path;
repeated rows count once each; no outcomes at all means that nothing is blocked
but by a rule; columns of the input with clashing names are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from movelens.sources.staging import stage

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):  # the longest is asked first
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, r.text).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def levels_of(host: Column) -> dict[str, Column]:
    """Registered domain (the last two labels) and suffix (the last label)."""
    labels = F.split(host, "\\.")
    return {
        "domain": F.array_join(F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2), "."),
        "suffix": F.element_at(labels, -1),
    }


def _strength(groups: DataFrame, least: float, most: float) -> float:
    """Prior strength of a level (n, bad, prior): from the scatter of its groups around their priors."""
    m = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), F.col("prior")))
    scatter = F.col("n") * F.pow(F.col("bad") / F.col("n") - m, 2) / (m * (1 - m))
    row = groups.filter("n > 0").agg(F.sum(scatter).alias("s"), F.count(F.lit(1)).alias("g"), F.sum(F.col("n") - 1).alias("d")).first()
    if not row.g or not row.d:
        return least
    rho = (row.s - row.g) / row.d
    return min(most, max(least, 1 / rho - 1)) if rho > 0 else most


def reputations(outcomes: DataFrame, least: float = 2.0, most: float = 1000.0) -> DataFrame:
    """Posterior (a, b) of the bad rate for every level and name of ``outcomes`` (host, bad 0/1).

    Rows: level (all, suffix, domain, host), name, a, b.
    """
    hosts = stage(outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").alias("bad")).withColumns(levels_of(F.col("host"))), "hosts")
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad")).first()
    # one good and one bad page more, so that a rate of 0 or 1 is never certain
    rate = (total.bad + 1) / (total.n + 2)
    out = outcomes.sparkSession.range(1).select(
        F.lit("all").alias("level"), F.lit("").alias("name"), F.lit(float(total.bad + 1)).alias("a"), F.lit(float(total.n - total.bad + 1)).alias("b"))
    above, parent = None, None
    for level in ("suffix", "domain", "host"):
        keys = [level] if parent is None else [level, parent]
        groups = hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")) if level != "host" else hosts.select("host", "domain", "n", "bad")
        if above is None:
            groups = groups.withColumn("prior", F.lit(rate))
        else:
            groups = groups.join(above.select(F.col("name").alias(parent), (F.col("a") / (F.col("a") + F.col("b"))).alias("prior")), parent)
        groups = stage(groups, level)
        k = _strength(groups, least, most)
        above = groups.select(
            F.lit(level).alias("level"), F.col(level).alias("name"), (F.col("bad") + F.col("prior") * k).alias("a"),
            (F.col("n") - F.col("bad") + (1 - F.col("prior")) * k).alias("b"))
        out = out.unionByName(above)
        parent = level
    return stage(out, "reputations")


def lower_bound(a: Column, b: Column, z: float) -> Column:
    """Mean less z standard deviations of a beta distribution."""
    return a / (a + b) - z * F.sqrt(a * b / (F.pow(a + b, 2) * (a + b + 1)))


def judge_urls(
    pages: DataFrame, url: str, rules: Sequence[Rule], outcomes: DataFrame | None = None, limit: float = 0.75, z: float = 1.645,
) -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``outcomes`` (host, bad 0/1) are the labelled pages; without them the pages
    decided by a rule are. ``limit`` and ``z``: a host is blocked if its mean bad
    rate less z standard deviations is above the limit.
    """
    parsed = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    name, ruled = rule_of(F.col("host"), F.col("path"), rules)
    parsed = parsed.withColumns({"rule": name, "_ruled": ruled})
    if outcomes is None:
        outcomes = parsed.filter(F.col("_ruled").isNotNull()).select("host", (F.col("_ruled") == "block").cast("int").alias("bad"))
    known = reputations(outcomes).withColumn("_bound", lower_bound(F.col("a"), F.col("b"), z))
    parsed = parsed.withColumns({f"_{k}": v for k, v in levels_of(F.col("host")).items()})
    bound = F.lit(known.filter("level = 'all'").first()["_bound"])
    for level, column in (("suffix", "_suffix"), ("domain", "_domain"), ("host", "host")):
        own = known.filter(F.col("level") == level).select(F.col("name").alias("_name"), F.col("_bound").alias(f"_b_{level}"))
        parsed = parsed.join(own, parsed[column] == own["_name"], "left").drop("_name")
        bound = F.coalesce(F.col(f"_b_{level}"), bound)
    judged = parsed.withColumn("verdict", F.coalesce("_ruled", F.when(bound > limit, "block").otherwise("allow")))
    return judged.drop("_ruled", "_suffix", "_domain", "_b_suffix", "_b_domain", "_b_host")
