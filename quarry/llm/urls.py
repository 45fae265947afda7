"""URL filters by host reputation, with DataFrame functions only.

Explicit rules come first: a rule (host, path) fits its host and all subdomains if the path of the url starts with
the rule's; the longest rule wins. Where none fits, an empirical-Bayes reputation decides. Labelled page outcomes (the
rules' own verdicts, else a content check of the page) are counted by host; a beta-binomial prior shrinks them from
host to registered domain to suffix to the whole table, each level with a strength estimated by moments; a page is
blocked when the lower posterior bound of its host's share of bad pages is above a threshold.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule and belongs to the empty
host; null html teaches nothing, empty html is bad; a null page_id keeps its row; repeated rows each keep their row and
count each time; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import Scratch, pick

#: host, path, verdict
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of two labels; a parameter, as the public list changes.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "ac.jp", "com.br", "co.in", "co.nz", "co.za", "co.kr", "com.cn", "com.mx", "com.tr", "com.tw")
#: A host that is an address belongs to itself, and its suffix is this.
ADDRESS = "address"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, else null."""
    out = None
    for h, p, _ in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.lit(h + p)) if out is None else out.when(fits, F.lit(h + p))
    return F.lit(None).cast("string") if out is None else out


def bad_page(html: Column) -> Column:
    """The content check: true where over 2 % of the characters are symbols of decoration, or under 200 characters."""
    n = F.length(html)
    return (n < 200) | (50 * (n - F.length(F.translate(html, "*$%#|~^", ""))) > n)


def _level(host: Column, labels: int, two: tuple[str, ...], address: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":\d*$", "")
    last = lambda n: F.substring_index(bare, ".", -n)
    is_address = bare.rlike(r"^(\d{1,3}(\.\d{1,3}){3}|\[.*\])$")
    return F.when(is_address, address).when(last(2).isin(*two), last(labels + 1)).otherwise(last(labels))


def domain_of(host: Column, two=TWO_LABEL_SUFFIXES) -> Column:
    """The registered domain: the suffix and one label, without port and user; an address is its own."""
    return _level(host, 2, two, host)


def suffix_of(host: Column, two=TWO_LABEL_SUFFIXES) -> Column:
    return _level(host, 1, two, F.lit(ADDRESS))


def _strength(df: DataFrame, level: str) -> DataFrame:
    """One row: the prior's strength at a level, by moments over its members with at least two outcomes. Between
    1 and 1000; 10 where members do not tell."""
    m = df.where("n >= 2").select((F.col("bad") / F.col("n")).alias("p"), "n")
    m = m.agg(F.avg("p").alias("m"), F.var_samp("p").alias("v"), F.avg(1 / F.col("n")).alias("r"))
    within = F.col("m") * (1 - F.col("m"))
    between = F.greatest(F.col("v") - within * F.col("r"), F.lit(1e-6))
    return m.select(F.coalesce(F.least(F.greatest(within / between - 1, F.lit(1.0)), F.lit(1000.0)), F.lit(10.0)).alias(f"k_{level}"))


def reputations(outcomes: DataFrame, scratch: Scratch, two=TWO_LABEL_SUFFIXES) -> DataFrame:
    """host, n, bad, alpha, beta, bound: posterior by host of outcomes(host, bad). bound is the lower end of the
    posterior's central interval of two standard deviations."""
    counts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0)).alias("bad"))
    hosts = scratch.keep(counts.withColumns({"domain": domain_of(F.col("host"), two), "suffix": suffix_of(F.col("host"), two)}), "hosts")
    domains = scratch.keep(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = scratch.keep(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")
    ks = [_strength(df, level).first()[0] for df, level in ((hosts, "host"), (domains, "domain"), (suffixes, "suffix"))]
    n, bad = suffixes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    prior = (bad + 1) / (n + 2)
    shrunk = lambda mean, k: (F.col("bad") + k * mean) / (F.col("n") + k)
    s = suffixes.select("suffix", shrunk(F.lit(prior), ks[2]).alias("suffix_mean"))
    d = scratch.keep(domains.join(s, "suffix").select("domain", "suffix", shrunk(F.col("suffix_mean"), ks[1]).alias("domain_mean")), "domain_means")
    h = hosts.join(d, ["domain", "suffix"])
    h = h.withColumns({"alpha": F.col("bad") + ks[0] * F.col("domain_mean"), "beta": F.col("n") - F.col("bad") + ks[0] * (1 - F.col("domain_mean"))})
    total = F.col("alpha") + F.col("beta")
    sd = F.sqrt(F.col("alpha") * F.col("beta") / (total * total * (total + 1)))
    return scratch.keep(h.select("host", "n", "bad", "alpha", "beta", (F.col("alpha") / total - 2 * sd).alias("bound")), "reputations")


def filter_urls(pages: DataFrame, rules=RULES, threshold: float = 0.5, outcome: Column | None = None, two=TWO_LABEL_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule, verdict, bound for every page. outcome: true for pages known to be bad, false for good
    ones, null where unknown; a column of pages, by default the content check of html."""
    with Scratch(pages.sparkSession, "urls") as scratch:
        p = pick(pages.withColumn("__bad", bad_page(F.col("html")) if outcome is None else outcome), page_id="long", url="string", __bad="boolean")
        p = p.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("__bad").alias("known_bad"))
        p = p.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
        ruled = F.lit(None).cast("string")
        for h, q, v in rules:
            ruled = F.when(F.col("rule") == h + q, F.lit(v)).otherwise(ruled)
        p = scratch.keep(p.withColumn("ruled", ruled).withColumn("bad", F.coalesce(F.col("ruled") == "block", F.col("known_bad"))), "pages")
        # by host of both sides straight from files: Spark broadcasts a small side by its size, else it can split a hot host
        judged = p.join(reputations(p.select("host", "bad"), scratch, two).select("host", "bound"), "host", "left")
        verdict = F.coalesce("ruled", F.when(F.col("bound") > threshold, "block").otherwise("allow"))
        return scratch.finish(judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "bound"))
