"""URL filter: explicit rules first, empirical-Bayes host reputation for the rest.

Labelled page outcomes are shrunk through beta-binomial priors: a suffix
towards all pages, a registered domain towards its suffix, a host towards its
domain.  The strength of each prior is the moment estimate of the beta-binomial
concentration among the groups of that level.  A host passes if the lower
bound of its posterior (normal approximation) reaches a threshold.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, join_narrow, stash

#: Second-level suffixes below which names are registered.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "or.jp", "co.nz", "com.br", "co.in", "co.za", "com.cn", "com.mx", "com.tr")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_host(host: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", "")


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more; an address stays whole."""
    name = bare_host(host)
    last2, last3 = F.substring_index(name, ".", -2), F.substring_index(name, ".", -3)
    return F.when(name.rlike(r"^[0-9.]+$"), name).when(last2.isin(*TWO_LABEL_SUFFIXES), last3).otherwise(last2)


def suffix_of(host: Column) -> Column:
    name = bare_host(host)
    last2 = F.substring_index(name, ".", -2)
    return F.when(name.rlike(r"^[0-9.]+$"), F.lit("address")).when(last2.isin(*TWO_LABEL_SUFFIXES), last2).otherwise(F.substring_index(name, ".", -1))


def matched_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest rule ``(verdict, host, path)`` that fits, as a struct of rule and verdict, or null.

    Of rules with one text, a blocking one wins.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "block"))
    fits = [F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for v, h, p in ordered]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _moments(groups: DataFrame) -> Column:
    """The beta-binomial concentration of groups with ``n`` trials and ``x`` successes, by moments.

    Null stands for an infinite one: the groups differ no more than chance lets them, so they have their parent's mean.
    A prior is worth one page at least (the unit information of a page), or else a host's only page would settle it without any variance.
    """
    n, x, m = F.sum("n"), F.sum("x"), F.count("*")
    p = x / n
    spread = F.sum(F.col("x") * F.col("x") / F.col("n")) - p * x
    room = n - F.sum(F.col("n") * F.col("n")) / n - (m - 1)
    rho = F.try_divide(spread - p * (1 - p) * (m - 1), p * (1 - p) * room)
    return F.when(rho > 0, F.round(F.greatest(F.lit(1.0), 1 / rho - 1), 6))


def host_reputation(outcomes: DataFrame, z: float = 1.645, threshold: float = 0.5) -> DataFrame:
    """``outcomes(host, good)``, a row for each page, to a row for each host.

    ``good`` is 1 or 0, or null for a page without a label; hosts without any
    label get the posterior of their domain.  Columns: host, domain, suffix, n,
    x, mean, bound, verdict.  Without any label at all the prior is 0.5.
    """
    hosts = stash(outcomes.groupBy("host").agg(F.count("good").alias("n"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("x")).select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), "n", "x"))
    domains = stash(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
    suffixes = stash(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")))
    strength = {name: level.filter("n > 0").agg(_moments(level).alias("k")).first()["k"] for name, level in (("host", hosts), ("domain", domains), ("suffix", suffixes))}
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    base = ((total["x"] or 0) + 1) / ((total["n"] or 0) + 2)

    shrunk = lambda k, prior: prior if k is None else F.coalesce(F.try_divide(F.col("x") + F.lit(k) * prior, F.col("n") + F.lit(k)), prior)
    by_suffix = suffixes.select("suffix", shrunk(strength["suffix"], F.lit(base)).alias("m_suffix"))
    by_domain = domains.join(by_suffix, "suffix").select("domain", "suffix", shrunk(strength["domain"], F.col("m_suffix")).alias("m_domain"))
    mean = shrunk(strength["host"], F.col("m_domain"))
    spread = F.lit(0.0) if strength["host"] is None else F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + strength["host"] + 1))
    bound = F.col("mean") - z * spread
    return hosts.join(by_domain, ["domain", "suffix"]).withColumn("mean", mean).withColumn("bound", bound).withColumn("verdict", F.when(F.col("bound") >= threshold, "allow").otherwise("block")).drop("m_domain")


def judge_urls(pages: DataFrame, outcomes: DataFrame, rules: Sequence[tuple[str, str, str]] = (), id_col: str = "page_id", url_col: str = "url", **options) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, bound.

    ``outcomes(id, good)`` has the labels of some pages, at most one of each.
    A null url, or one without ``://``, has an empty host and path: no rule
    fits it and it is judged as the host ``''``.  Very long urls are read whole.
    Repeated rows are judged alike, and outcomes without a page count for
    nothing.  Columns of ``pages`` other than id and url are ignored.  No rows
    give no rows.
    """
    named = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    labelled = named.select("id", "host").join(outcomes.select(F.col("id"), F.col("good")), "id", "left")
    known = stash(host_reputation(labelled, **options).select("host", "bound", F.col("verdict").alias("judged")))
    ruled = named.withColumn("fit", matched_rule(F.col("host"), F.col("path"), rules))
    return join_narrow(ruled, known, "host", "left").select(F.col("id").alias(id_col), "host", "path", F.col("fit.rule").alias("rule"), F.coalesce("fit.verdict", "judged").alias("verdict"), F.round("bound", 6).alias("bound"))
