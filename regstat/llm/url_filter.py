"""URL filter: explicit rules first, then empirical-Bayes host reputation.

Labelled page outcomes (1 good, 0 bad) are counted per host. Reputations are
shrunk down the name hierarchy: the suffix (last label) towards the overall
rate, the registered domain (last two labels) towards its suffix, the host
towards its domain. Each level has a beta-binomial prior whose mean is the
parent's posterior mean and whose strength is estimated from the spread of
the children (method of moments). A host is blocked if the upper posterior
bound of its good rate, mean + z * sd, is below ``min_good``.

Pages are aggregated to hosts before anything is joined, so a host with a
third of all pages is one partial count per task; the join back to the
pages is on the host with only the blocked hosts on the other side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
MIN_GOOD, Z = 0.5, 1.6448536269514722
STRENGTH_MIN, STRENGTH_MAX = 1.0, 1000.0


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rule(host: Column, path: Column, rules) -> Column:
    """The longest fitting rule as a struct (rule, verdict), or null."""
    chosen = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        chosen = F.when(fits, value) if chosen is None else chosen.when(fits, value)
    return chosen if chosen is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _strength(level: DataFrame) -> float:
    """Strength a + b of the beta prior from children (k, n) and the parent
    mean m: the excess of the children's spread over binomial noise."""
    row = level.agg(
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), F.lit(2))).alias("spread"),
        F.sum(F.col("m") * (1 - F.col("m"))).alias("noise"),
        F.sum((F.col("n") - 1) * F.col("m") * (1 - F.col("m"))).alias("room")).first()
    if row.room is None or row.room <= 0:
        return STRENGTH_MAX
    rho = (row.spread - row.noise) / row.room
    if rho <= 0:
        return STRENGTH_MAX
    return min(STRENGTH_MAX, max(STRENGTH_MIN, (1 - min(rho, 0.999)) / rho))


def host_reputation(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """Posterior of every labelled host: host, n, k, mean, upper.

    ``labels``: (doc_id, quality), an outcome of the page with that id;
    a null id or outcome is no outcome, several outcomes all count.
    """
    outcome = (labels.select(F.col("doc_id").alias("_id"), F.col("quality").cast("long").alias("_q"))
               .filter("_id is not null and _q is not null"))
    seen = pages.select(F.col("page_id").alias("_id"), host_of(F.col("url")).alias("host"))
    hosts = (seen.join(outcome, "_id").filter("host <> ''")
             .groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("_q").alias("k"))
             .withColumn("domain", F.substring_index("host", ".", -2))
             .withColumn("suffix", F.substring_index("host", ".", -1)))
    from regstat.llm.common import written
    hosts = written(hosts, "hosts")
    total = hosts.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    m0 = (total.k + 1.0) / (total.n + 2.0) if total.n else 0.5

    def shrunk(level: DataFrame) -> DataFrame:
        s = _strength(level)
        return (level.withColumn("a", F.col("k") + F.lit(s) * F.col("m"))
                .withColumn("b", F.col("n") - F.col("k") + F.lit(s) * (1 - F.col("m")))
                .withColumn("mean", F.col("a") / (F.col("a") + F.col("b"))))

    counts = [F.sum("k").alias("k"), F.sum("n").alias("n")]
    suffixes = shrunk(hosts.groupBy("suffix").agg(*counts).withColumn("m", F.lit(m0)))
    domains = shrunk(hosts.groupBy("domain", "suffix").agg(*counts)
                     .join(suffixes.select("suffix", F.col("mean").alias("m")), "suffix"))
    leaves = shrunk(hosts.join(domains.select("domain", F.col("mean").alias("m")), "domain"))
    sd = F.sqrt(F.col("a") * F.col("b")
                / (F.pow(F.col("a") + F.col("b"), F.lit(2)) * (F.col("a") + F.col("b") + 1)))
    return leaves.select("host", "n", "k", "mean",
                         (F.col("mean") + F.lit(Z) * sd).alias("upper"))


def filter_urls(pages: DataFrame, labels: DataFrame, rules=RULES,
                min_good: float = MIN_GOOD) -> DataFrame:
    """Judge every page url: page_id, host, path, rule, verdict.

    The longest fitting rule decides; without one a host whose upper bound is
    below ``min_good`` is blocked and every other url is allowed, unlabelled
    hosts too. A null url, or one without "://", has an empty host and path
    and is allowed. Repeated pages are judged each; a null page_id has no
    outcome; extra columns are ignored; empty tables give empty results.
    """
    rep = host_reputation(pages, labels)
    blocked = rep.filter(F.col("upper") < min_good).select(F.col("host").alias("_blocked"))
    judged = (pages.select("page_id", host_of(F.col("url")).alias("host"),
                           path_of(F.col("url")).alias("path"))
              .withColumn("_rule", _rule(F.col("host"), F.col("path"), rules)))
    return (judged.join(blocked, F.col("host") == F.col("_blocked"), "left")
            .select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                    F.coalesce(F.col("_rule.verdict"),
                               F.when(F.col("_blocked").isNotNull(), F.lit("block"))
                               .otherwise(F.lit("allow"))).alias("verdict")))
