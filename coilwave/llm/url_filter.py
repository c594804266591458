"""URL filters: rules by host and path, and empirical-Bayes reputation of hosts (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: One-sided bound: so many standard deviations of the posterior below its mean (95 %).
BOUND = 1.645
#: A host is blocked if even the lower bound of its rate of bad pages is above this.
RATE = 0.5
#: The correlation of outcomes within a group is kept inside these, so that a prior is worth 1/rho - 1 outcomes: 0.25 to 99.
RHO = (0.01, 0.8)

#: Hosts whose bounds are broadcast, and their longest name: 13 MB. Each other host has at most as many pages as all pages divided by this.
BROADCAST_HOSTS, HOST_BYTES = 50_000, 256

Rules = list[tuple[str, str]]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end. Without :// both are empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Rules) -> tuple[Column, Column]:
    """The rule (like `example.com/en/`) that fits and is longest, and its verdict; null if none fits. Of equally long ones the longer host wins."""
    found, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0].find("/"))):
        at, slash, rest = rule.partition("/")
        fits = ((host == at) | F.endswith(host, F.lit("." + at))) & F.startswith(path, F.lit(slash + rest))
        found, verdict = F.when(fits, rule).otherwise(found), F.when(fits, says).otherwise(verdict)
    return found, verdict


def _with_prior(groups: DataFrame, mean: str) -> DataFrame:
    """groups (n outcomes, x bad, `mean` of the parent): adds post_a and post_b, the posterior Beta of each group.

    All groups of a level share one correlation rho, from the moments of the beta-binomial: how much more the counts
    scatter around the parents' means than independent outcomes would."""
    m = F.col(mean)
    sums = groups.agg(F.sum((F.col("x") - F.col("n") * m) ** 2 - F.col("n") * m * (1 - m)).alias("over"), F.sum(F.col("n") * (F.col("n") - 1) * m * (1 - m)).alias("pairs")).first()
    rho = min(max(sums.over / sums.pairs, RHO[0]), RHO[1]) if sums.pairs else RHO[1]
    worth = 1 / rho - 1
    return groups.withColumns({"post_a": F.lit(worth) * m + F.col("x"), "post_b": F.lit(worth) * (1 - m) + F.col("n") - F.col("x")})


def registered_domain(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """hosts (host, ...) with domain and suffix. A user and a port do not count. The suffix is the longest of `suffixes` (suffix: like
    `co.uk`) that the host ends in, else the last label, and the domain one label more. A numeric address is its own
    domain, of the suffix `""`; so is a host that is a suffix as a whole."""
    bare = F.regexp_replace(F.regexp_replace("host", "^.*@", ""), ":[0-9]*$", "")
    named = hosts.withColumn("_labels", F.split(bare, "[.]")).withColumn("_n", F.size("_labels"))
    tail = lambda k: F.array_join(F.slice("_labels", F.greatest(F.col("_n") - k + 1, F.lit(1)), F.greatest(k, F.lit(1))), ".")
    longest = F.lit(1)
    if suffixes is not None:
        tails = named.select("host", "_labels", "_n", F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_k")).select("host", "_k", tail(F.col("_k")).alias("suffix"))
        found = tails.join(suffixes.select(F.lower("suffix").alias("suffix")).distinct(), "suffix").groupBy("host").agg(F.max("_k").alias("_k"))
        named = named.join(found, "host", "left")
        longest = F.coalesce("_k", F.lit(1))
    numeric = bare.rlike("^[0-9]{1,3}([.][0-9]{1,3}){3}$|^\\[.*\\]$")
    return named.withColumns({"domain": F.when(numeric, bare).otherwise(tail(longest + 1)), "suffix": F.when(numeric, "").otherwise(tail(longest))}).drop("_labels", "_n", "_k")


def reputation(outcomes: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """(host, n, x, post_a, post_b, bound) from outcomes (host, bad: 1, 0, or null where unknown).

    A host's Beta prior has the posterior mean of its registered domain (see registered_domain), a domain's that of its
    suffix, a suffix's that of all pages. Hosts of no known outcome rest on their prior. bound is the lower posterior
    bound of the rate of bad pages. Outcomes are summed by host before anything else."""
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("x"))
    hosts = written(registered_domain(hosts, suffixes), "hosts")
    whole = hosts.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    level = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).withColumn("mean", F.lit(((whole.x or 0) + 1) / ((whole.n or 0) + 2)))
    for of, key in ((hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x")), "suffix"), (hosts, "domain")):
        parent = _with_prior(level, "mean").select(key, (F.col("post_a") / (F.col("post_a") + F.col("post_b"))).alias("mean"))
        level = of.join(parent, key)
    a, b = F.col("post_a"), F.col("post_b")
    bound = a / (a + b) - BOUND * F.sqrt(a * b / ((a + b) ** 2 * (a + b + 1)))
    return _with_prior(level, "mean").select("host", "n", "x", "post_a", "post_b", bound.alias("bound"))


def _with_bounds(parsed: DataFrame, bounds: DataFrame) -> DataFrame:
    """parsed (host, ...) with the bound of each host. Hosts of many pages are broadcast, as their number is bounded, so their pages
    stay where they are; only pages of the other hosts are shuffled, of which none has more than a fair part."""
    pages = parsed.groupBy("host").agg(F.count("*").alias("pages"))
    hosts = written(bounds.join(pages, "host"), "bounds")
    total = hosts.agg(F.sum("pages").alias("pages")).first().pages or 0
    many = (F.col("pages") * BROADCAST_HOSTS > total) & (F.octet_length("host") <= HOST_BYTES)
    named = lambda rows: rows.select("host", "bound")
    often, seldom = named(hosts.where(many)), named(hosts.where(~many))
    if seldom.isEmpty():
        return parsed.join(F.broadcast(often), "host")
    rest = parsed.join(F.broadcast(often), "host", "left_anti").join(seldom, "host")
    return parsed.join(F.broadcast(often), "host").unionByName(rest)


def judge_urls(pages: DataFrame, rules: Rules, outcomes: DataFrame | None = None, suffixes: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row.

    A rule fits its host and all subdomains if the path starts with the rule's path; the longest fitting rule decides.
    Other pages are blocked if the reputation of their host is surely bad (see reputation), else allowed. `outcomes`
    (url, bad) are labelled pages; by default the pages that a rule decides are (1: blocked), the only labels that
    pages have here. A null url, or one without ://, has an empty host and path; such pages are one host. Repeated rows
    and null page_ids are rows like any other. Without any outcome all hosts have the rate 0.5 and nothing is blocked.
    `suffixes` (suffix) lists the suffixes of several labels under which domains are registered. Other columns are ignored."""
    host, path = host_and_path(F.col("url"))
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    parsed = pages.select("page_id", host.alias("host"), path.alias("path")).select("page_id", "host", "path", rule.alias("rule"), verdict.alias("said"))
    if outcomes is None:
        known = parsed.select("host", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0).alias("bad"))
    else:
        known = outcomes.select(host_and_path(F.col("url"))[0].alias("host"), F.col("bad").cast("int").alias("bad")).unionByName(parsed.select("host", F.lit(None).cast("int").alias("bad")))
    judged = _with_bounds(parsed, reputation(known, suffixes).select("host", "bound"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("bound") > RATE, "block").otherwise("allow")).alias("verdict"))
