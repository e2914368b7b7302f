"""URL filter: path rules first, then empirical-Bayes host reputation.

Labelled page outcomes (bad or not) are counted per host.  A host's rate is
shrunk towards its registered domain, the domain's towards its public suffix,
the suffix's towards the whole: at each level a node has a beta prior around
the parent's mean.  That mean is taken without the node's own pages, and it is
uncertain itself: with t pages' worth of evidence behind it and strength s, the
prior is worth s t / (t + 1 + s) pages, which has the variance of both, and
``WEAK`` pages at least.  The strength is the one nearest to ``WEAK`` that the
level's labelled counts, under the beta-binomial, leave as likely as the best
of a grid within ``SLACK``, so counts that say nothing (one page a host, one
suffix) give a weak prior.  A host without labels is a node with no pages: it
is judged by the prior of its nearest labelled domain, suffix or, failing both,
the whole.  A host is blocked where the lower ``1 - confidence`` quantile of
its posterior exceeds ``threshold``.

Reputation belongs to the host without port, user or trailing dot; an address
in numbers is its own domain and suffix.  The ``host`` column keeps all that
the url says.

Scale: pages are only counted by host (partial aggregates) and joined once with the
host table, which is a written table, so adaptive execution can split a hot
host's rows.  What reaches the driver is one sum per grid point and level.

Defined results: a null url, or one without ``://``, has an empty host and
path; it fits no rule, has no reputation and is allowed.  Repeated pages are
judged each; labels repeated for a document count once, bad if any is.  Of
rules that are equally long the first in their order wins.  Very long urls are
single values of one row; no pages give no rows, no outcomes block nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.plans.materialize import materialize

#: (verdict, host, path) (fixed values).
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
#: Second labels under which countries register names, as in co.uk (fixed values).
SECOND_LABELS = ["ac", "co", "com", "edu", "gob", "gov", "go", "mil", "ne", "net", "nom", "or", "org", "sch"]
#: The number of the document that a page shows, at the end of its path (fixed value).
SHOWN = r"/([0-9]+)(?:\.[a-z]+)?/?\z"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Prior strengths, in pages, that are tried: from a sixteenth to a million by factors of the square root of two.
STRENGTHS = [2.0 ** (j / 2) for j in range(-8, 41)]
#: Pages that a prior is worth at least, and a strength where counts say nothing.
WEAK = 2.0
#: Log likelihood that a strength may lack (half of the 95 % point of chi-squared with one degree).
SLACK = 1.92
#: Points at which posterior densities are summed, within so many standard deviations of the mean.
POINTS, DEVIATIONS = 400, 12.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host (A-Z lower-cased) and path of a url; empty where there is no ``://``."""
    has = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.substring_index(url, "://", 1)
    rest = F.substr(url, F.length(rest) + F.lit(4))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def rule_columns(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for kind, h, p in sorted(RULES if rules is None else rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    null = F.lit(None).cast("string")
    return (rule if rule is not None else null), (verdict if verdict is not None else null)


def reputation_host(host: Column) -> Column:
    """The host without user, port and trailing dot."""
    return F.regexp_replace(host, r"(?s)^.*@|\.?:[0-9]*\z|\.\z", "")


_NUMBERS = r"^(?:[0-9]+(?:\.[0-9]+){3}|\[.*\])\z"


def _two_label(host: Column) -> Column:
    return host.rlike(rf"(?:^|\.)(?:{'|'.join(SECOND_LABELS)})\.[a-z]{{2}}\z")


def registered_domain(host: Column) -> Column:
    named = F.when(_two_label(host), F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))
    return F.when(host.rlike(_NUMBERS), host).otherwise(named)


def suffix(host: Column) -> Column:
    named = F.when(_two_label(host), F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))
    return F.when(host.rlike(_NUMBERS), host).otherwise(named)


def log_gamma(x: Column) -> Column:
    """log of the gamma function of x > 0: Stirling's series at x + 7."""
    product = x
    for i in range(1, 7):
        product = product * (x + i)
    y = x + 7
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + series - F.log(product)


def log_likelihood(n: Column, k: Column, m: Column, s: Column) -> Column:
    """Beta-binomial log likelihood of k bad of n pages, prior mean m and strength s, without the binomial factor."""
    a, b = s * m, s * (1 - m)
    return log_gamma(a + k) - log_gamma(a) + log_gamma(b + n - k) - log_gamma(b) + log_gamma(s) - log_gamma(s + n)


def _strength(nodes: DataFrame) -> float:
    """Strength of the beta prior of nodes (n, k, m): of the grid's values as likely as the likeliest within ``SLACK``, the one nearest to ``WEAK``."""
    seen = nodes.where("n > 0 AND m > 0 AND m < 1").select(
        *[F.col(c).cast("double").alias(c) for c in ("n", "k", "m")], F.explode(F.array(*map(F.lit, STRENGTHS))).alias("s")
    )
    sums = seen.groupBy("s").agg(F.sum(log_likelihood(*map(F.col, ("n", "k", "m", "s")))).alias("ll")).collect()  # one row a grid point
    top = max((x["ll"] for x in sums), default=0.0)
    near = [x["s"] for x in sums if x["ll"] >= top - SLACK] or STRENGTHS
    return min(near, key=lambda s: (abs(math.log(s / WEAK)), s))


def host_reputation(outcomes: DataFrame, unseen: DataFrame | None = None) -> DataFrame:
    """(host, a, b): beta posterior of each host of ``outcomes`` (host, bad) and of ``unseen`` (host); empty hosts have none.

    Hosts come as :func:`reputation_host` gives them.  Those that only
    ``unseen`` has count as no pages, none bad: strengths and means of the
    levels stay as they are, and a and b are those of the prior.
    """
    counted = outcomes.where("bad IS NOT NULL").select("host", F.lit(1).cast("long").alias("n"), F.col("bad").cast("long").alias("k"))
    if unseen is not None:
        none = F.lit(0).cast("long")
        counted = counted.unionByName(unseen.select("host", none.alias("n"), none.alias("k")))
    hosts = materialize(
        counted.where("host <> ''").groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        .select("host", registered_domain(F.col("host")).alias("domain"), suffix(F.col("host")).alias("suffix"), "n", "k"),
        "hosts",
    )
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    up = [F.lit(float(x)) for x in (0.5, 0.5, total["n"], total["k"])]
    parent = None
    for key, above in (("suffix", None), ("domain", "suffix"), ("host", "domain")):
        level = hosts.groupBy(key, *([above] if above else [])).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
        if parent is not None:
            level = level.join(parent, above)
            up = [F.col(c) for c in ("pa", "pb", "pn", "pk")]
        # what is known of the parent without this node: its own prior and the other nodes below it
        a, b = up[0] + up[3] - F.col("k"), up[1] + (up[2] - up[3]) - (F.col("n") - F.col("k"))
        level = materialize(level.select(key, "n", "k", (a / (a + b)).alias("m"), (a + b).alias("t")), "level")
        s = F.lit(_strength(level))
        held = F.greatest(F.lit(WEAK), s * F.col("t") / (F.col("t") + 1 + s))
        prior = level.select(key, "n", "k", (held * F.col("m")).alias("pa"), (held * (1 - F.col("m"))).alias("pb"))
        parent = prior.select(key, "pa", "pb", F.col("n").cast("double").alias("pn"), F.col("k").cast("double").alias("pk"))
    return prior.select("host", (F.col("pa") + F.col("k")).alias("a"), (F.col("pb") + F.col("n") - F.col("k")).alias("b"))


def chance_above(a: Column, b: Column, threshold: float) -> Column:
    """The probability that a beta(a, b) rate lies above ``threshold``.

    Sums the density over the angle t of rate = sin(t) ** 2, which is smooth at
    both ends, at the middles of ``POINTS`` equal steps around the mean.
    """
    mean = a / (a + b)
    reach = F.lit(DEVIATIONS) * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    low, high = (F.asin(F.sqrt(x)) for x in (F.greatest(F.lit(0.0), mean - reach), F.least(F.lit(1.0), mean + reach)))
    # both sums in one pass: the logarithm of the density is taken relative to its value at the mean
    level = (2 * a - 1) * F.log(F.sqrt(mean)) + (2 * b - 1) * F.log(F.sqrt(1 - mean))

    def step(sums: Column, i: Column) -> Column:
        t = low + (high - low) * (i + 0.5) / POINTS
        d = F.exp((2 * a - 1) * F.log(F.sin(t)) + (2 * b - 1) * F.log(F.cos(t)) - level)
        above = F.sin(t) * F.sin(t) > threshold
        return F.struct((sums["all"] + d).alias("all"), (sums["above"] + F.when(above, d).otherwise(0.0)).alias("above"))

    zero = F.struct(F.lit(0.0).alias("all"), F.lit(0.0).alias("above"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(POINTS - 1)), zero, step, lambda s: s["above"] / s["all"])


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bad) of labelled pages: bad where a label says toxic or of low quality.

    A page's url ends in the number of the document that it shows; that
    document's label is the page's outcome.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max(F.greatest(F.coalesce("toxic", F.lit(0)), 1 - F.coalesce("quality", F.lit(1)))).alias("bad")
    )
    host, path = host_and_path(F.col("url"))
    number = F.expr("try_cast(shown AS bigint)")
    shown = pages.select(reputation_host(host).alias("host"), F.regexp_extract(path, SHOWN, 1).alias("shown"))
    return shown.select("host", number.alias("doc_id")).join(marks, "doc_id").select("host", "bad")


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=None, confidence: float = 0.95, threshold: float = 0.5) -> DataFrame:
    """Judge every row of ``pages`` (page_id, url); ``outcomes``: (host, bad), hosts without port or user."""
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("named", reputation_host(F.col("host")))
    reputation = host_reputation(outcomes, judged.select(F.col("named").alias("host")))
    bad = chance_above(F.col("a"), F.col("b"), threshold) >= confidence
    blocked = materialize(reputation.where(bad).select(F.col("host").alias("named"), F.lit("block").alias("learned")), "blocked")
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return (
        judged.join(blocked, "named", "left")
        .select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "learned", F.lit("allow")).alias("verdict"))
    )
