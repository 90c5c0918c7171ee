"""URL filter: rules first, then empirical-Bayes reputation of the host.

A host's labelled page outcomes (bad or not) are shrunk by beta-binomial priors: the suffix towards the mean of all,
the registered domain towards its suffix, the host towards its domain. Each level's prior strength comes from the spread
of its groups by the method of moments. A page is blocked if its host's bad rate is over the limit with the wanted
probability: the lower quantile of the Beta posterior is compared with excess times the bad rate of all outcomes. Counts are
summed up from host to domain to suffix, so a hot host is one row after the first sum.

The registered domain is a public suffix and the label before it; suffixes of several labels are a parameter, any last label is
one. A port belongs to no name, and an IPv4 or IPv6 address is its own domain and suffix.

Defined cases: a null url or one without :// has empty host and path and is allowed unless its (empty) host's
outcomes say otherwise; a page without outcome counts for nothing; several labels of a page are averaged; repeated rows of a page
count its outcome once; without outcomes nothing is blocked but by rule; columns of pages besides the id and the url are left
out; an empty table gives no rows. An outcome of a page is the label of the document with the page's number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm._common import durable

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    rule: str
    verdict: str

    @property
    def host(self) -> str:
        return self.rule.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.rule.partition("/")[2]


RULES = (UrlRule("net/", "block"), UrlRule("example.net/en/", "allow"), UrlRule("example.com/de/", "block"), UrlRule("org/fr/", "allow"))


#: Public suffixes of two labels that are common in web corpora; a whole list can be given instead.
SUFFIXES = ("ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "org.au", "org.uk")
ADDRESS = r"^(?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}|\[[0-9a-f:.]+\])$"


@dataclass(frozen=True)
class Reputation:
    """probability: of a bad rate under the bound. A host is blocked if the bound is over excess times the rate of all."""

    probability: float = 0.05
    excess: float = 1.0
    suffixes: tuple[str, ...] = SUFFIXES
    least_strength: float = 0.5
    most_strength: float = 1000.0


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(u, pattern, 1), UPPER, LOWER), F.regexp_extract(u, pattern, 2)


def matching_rule(host: Column, path: Column, rules: tuple[UrlRule, ...] = RULES) -> Column:
    """The longest rule that fits, else null."""
    found = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.rule)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        found = F.when(fits, F.lit(r.rule)).otherwise(found)
    return found


def _strength(groups: DataFrame, rep: Reputation) -> tuple[float, float]:
    """Mean bad rate, and prior strength by moments, of groups (n, k)."""
    g = groups.where("n > 0").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("m"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk")).first()
    if not g.n:
        return 0.0, rep.least_strength
    mean = g.k / g.n
    within, size = mean * (1 - mean), g.n / g.m
    spread = g.kk / g.n - mean * mean
    if within <= 0 or size <= 1:
        return mean, rep.most_strength
    rho = (spread - within / size) / (within * (1 - 1 / size))
    return mean, min(rep.most_strength, max(rep.least_strength, 1 / rho - 1 if rho > 0 else rep.most_strength))


def registered(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, which may have a port."""
    name = F.regexp_replace(host, r":[0-9]*$", "")
    labels = F.split(name, r"\.")
    last = lambda n: F.concat_ws(".", F.slice(labels, F.greatest(F.lit(1), F.size(labels) - n + 1), n))
    address, two = name.rlike(ADDRESS), last(2).isin(*suffixes) if suffixes else F.lit(False)
    domain = F.when(address, name).when(two, last(3)).otherwise(last(2))
    return domain, F.when(address, name).when(two, last(2)).otherwise(last(1))


def beta_quantile(p: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The p quantile of Beta(a, b), by bisection of the regularised incomplete beta function (continued fraction)."""
    ln = np.vectorize(math.lgamma, otypes=[float])
    a, b = np.asarray(a, float), np.asarray(b, float)
    front = ln(a + b) - ln(a) - ln(b)

    def fraction(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        tiny = 1e-300
        c, d = np.ones_like(x), 1 - (a + b) * x / (a + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d
        for m in range(1, 300):
            for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d, c = 1 + term * d, 1 + term / c
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = np.where(np.abs(c) < tiny, tiny, c)
                h = h * d * c
        return h

    def below(x: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", over="ignore", under="ignore", invalid="ignore"):
            weight = np.exp(front + a * np.log(x) + b * np.log1p(-x))
            swap = x > (a + 1) / (a + b + 2)
            at, s, t = np.where(swap, 1 - x, x), np.where(swap, b, a), np.where(swap, a, b)
            part = weight * fraction(at, s, t) / s
        return np.where(swap, 1 - part, part)

    lo, hi = np.zeros_like(a), np.ones_like(a)
    for _ in range(50):
        mid = (lo + hi) / 2
        less = below(mid) < p
        lo, hi = np.where(less, mid, lo), np.where(less, hi, mid)
    return (lo + hi) / 2


def _bounds(probability: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
            out, fit = np.zeros(len(a)), (a > 0) & (b > 0)
            out[b <= 0] = 1.0  # all mass at one
            out[a <= 0] = 0.0
            if fit.any():
                out[fit] = beta_quantile(probability, a[fit], b[fit])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*batch.schema.names, "lower"])

    return run


def host_reputation(pages: DataFrame, outcomes: DataFrame, rep: Reputation = Reputation()) -> tuple[DataFrame, float]:
    """(host, n, k, a, b, lower), of which Beta(a, b) is the posterior of the bad rate and lower its quantile, and the bad rate
    of all outcomes. pages: page_id, host; outcomes: page_id, bad (0 to 1)."""
    one = outcomes.where("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.avg("bad").alias("bad"))
    hosts = durable(pages.distinct().join(one, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("k")))
    domain, suffix = registered(F.col("host"), rep.suffixes)
    hosts = hosts.withColumn("domain", domain).withColumn("suffix", suffix)
    up = lambda df, *by: durable(df.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    domains = up(hosts, "domain", "suffix")
    suffixes = up(domains, "suffix")
    mean, s0 = _strength(suffixes, rep)
    (_, s1), (_, s2) = _strength(domains, rep), _strength(hosts, rep)
    suffixes = suffixes.select("suffix", ((mean * s0 + F.col("k")) / (s0 + F.col("n"))).alias("prior"))
    domains = durable(domains.join(suffixes, "suffix").select("domain", ((F.col("prior") * s1 + F.col("k")) / (s1 + F.col("n"))).alias("prior")))
    a = F.col("prior") * s2 + F.col("k")
    posterior = hosts.join(domains, "domain").select("host", "n", "k", a.alias("a"), (s2 + F.col("n") - a).alias("b"))
    return posterior.mapInArrow(_bounds(rep.probability), "host string, n long, k double, a double, b double, lower double"), mean


def judge(pages: DataFrame, outcomes: DataFrame, rules: tuple[UrlRule, ...] = RULES, rep: Reputation = Reputation(), url_col: str = "url", id_col: str = "page_id") -> DataFrame:
    """(page_id, host, path, rule, verdict, bad_rate_bound) of each page."""
    host, path = parts(F.col(url_col))
    split = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    found, mean = host_reputation(split.select("page_id", "host"), outcomes, rep)
    known = durable(found.select("host", "lower"))
    verdicts = F.create_map(*[x for r in rules for x in (F.lit(r.rule), F.lit(r.verdict))]) if rules else F.create_map().cast("map<string,string>")
    out = split.join(known, "host", "left").withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when((F.lit(mean) > 0) & (F.col("lower") > rep.excess * mean), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.element_at(verdicts, F.col("rule"))).otherwise(own).alias("verdict"), F.round("lower", 6).alias("bad_rate_bound"))


def op7(pages: DataFrame, labels: DataFrame) -> DataFrame:
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1.0).when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0.0)
    return judge(pages.select("page_id", "url"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))
