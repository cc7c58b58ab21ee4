"""URL filters by empirical-Bayes reputations of hosts, of DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.llm.common import cut, lower_ascii

#: (host, path, verdict)
Rule = tuple[str, str, str]
#: Public suffixes of two labels, fixed values; a caller may declare others.
SUFFIXES = tuple("co.uk org.uk ac.uk gov.uk com.au net.au org.au co.nz co.jp ne.jp or.jp com.br com.cn com.mx com.tr co.in co.kr co.za com.ar com.sg com.hk com.tw".split())


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty if there is none or url is null."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end; empty if there is no host part or url is null."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def bare_host(host: Column) -> Column:
    """A host without user, port and last dot."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r"(:[0-9]*)?\.?$", "")


def _address(bare: Column) -> Column:
    return bare.rlike(r"^[0-9.]+$|^\[")


def suffix(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The last two labels where they are a declared suffix, else the last; an address is its own."""
    bare = bare_host(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(_address(bare), bare).when(two.isin(*suffixes), two).otherwise(F.substring_index(bare, ".", -1))


def registered_domain(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """The suffix and the label before it; a host of fewer labels, and an address, is its own."""
    bare = bare_host(host)
    two = F.substring_index(bare, ".", -2)
    return F.when(_address(bare), bare).when(two.isin(*suffixes), F.substring_index(bare, ".", -3)).otherwise(two)


def longest_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; a rule fits its host and subdomains where the path starts with its own.

    The list of rules is a parameter, so it becomes one expression. Longer: by host and path together.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, v).otherwise(verdict)
    return rule, verdict


def _strength(based: DataFrame) -> float:
    """How many outcomes the prior of (n, bad, m) rows is worth: one row of moments that executors add up.

    Fitted to the excess of the variance of the rates around their parents' means m over what binomial draws would
    give: E[S] = V0 + rho (V1 - V0) with rho = 1 / (strength + 1). No excess, or fewer than two keys with outcomes,
    gives the most strength, 999; strengths are kept between 1 and that.
    """
    n, m = F.col("n"), F.col("m")
    spread = m * (1 - m)
    got = based.where("n > 0").agg(F.count("*").alias("k"), F.sum(n * F.pow(F.col("bad") / n - m, 2.0)).alias("s"), F.sum(spread).alias("v0"), F.sum(n * spread).alias("v1")).first()
    rho = (got.s - got.v0) / (got.v1 - got.v0) if got.k > 1 and got.v1 > got.v0 else 0.0
    return min(max(1 / max(rho, 1e-3) - 1, 1.0), 999.0)


def _posterior(based: DataFrame) -> DataFrame:
    """Rows (..., n, bad, m) with the beta posterior's parameters a and b."""
    k = F.lit(_strength(based))
    return based.withColumns({"a": F.col("m") * k + F.col("bad"), "b": (1 - F.col("m")) * k + F.col("n") - F.col("bad")})


def _mean(fitted: DataFrame, key: str) -> DataFrame:
    return fitted.select(key, (F.col("a") / (F.col("a") + F.col("b"))).alias("m"))


def reputations(pages: DataFrame, url_col: str = "url", bad_col: str = "bad", z: float = 1.645, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """(host, domain, suffix, n, n_bad, rate, low, high) for each host of the pages.

    bad is 1 or 0 for a labelled page and null for others. Outcomes are counted by host, by registered domain and
    by suffix; each level's beta prior has the mean of the level above, the suffixes' that of all pages. rate is
    the posterior mean of a bad page, low and high its bounds at z standard deviations of the beta posterior.
    Pages are read once: levels are summed from the hosts' counts, which a checkpoint keeps; what reaches the driver
    is one row of moments for each level. Without any outcome all rates are 0.
    """
    counted = pages.select(host_of(F.col(url_col)).alias("host"), F.col(bad_col).cast("int").alias("bad")).groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = cut(counted.select("host", registered_domain(F.col("host"), suffixes).alias("domain"), suffix(F.col("host"), suffixes).alias("suffix"), "n", "bad"))
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    by_suffix = cut(hosts.groupBy("suffix").agg(*sums))
    total = by_suffix.agg(*sums).first()
    prior = (total.bad + 1) / (total.n + 2) if total.n else 0.0
    by_suffix = _posterior(by_suffix.withColumn("m", F.lit(prior)))
    by_domain = _posterior(cut(hosts.groupBy("domain", "suffix").agg(*sums).join(_mean(by_suffix, "suffix"), "suffix")))
    fitted = _posterior(cut(hosts.join(_mean(by_domain, "domain"), "domain")))
    a, b = F.col("a"), F.col("b")
    mean, dev = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return fitted.select("host", "domain", "suffix", "n", F.col("bad").alias("n_bad"), mean.alias("rate"), F.greatest(F.lit(0.0), mean - z * dev).alias("low"), F.least(F.lit(1.0), mean + z * dev).alias("high"))


def judge(pages: DataFrame, rules: list[Rule], url_col: str = "url", bad_col: str = "bad", z: float = 1.645, limit: float = 0.25, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """All columns with host, path, rule, verdict, rate and low added, replacing columns of these names.

    The longest fitting rule decides; elsewhere a page is blocked if its host's rate of bad pages is above `limit`
    with the posterior's confidence, that is, if the lower bound is. A host with few outcomes keeps near its
    domain's rate, so it is blocked only where its domain or suffix is bad. Null urls have an empty host, which is
    judged like any other. A repeated row gives a row each time, and its outcome counts each time; a table without rows gives
    none, and without outcomes every host's rate is 0.
    """
    base = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "rate", "low")]
    placed = pages.select(*base, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    known = reputations(pages, url_col, bad_col, z, suffixes).select("host", "rate", "low")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("low") > limit, "block").otherwise("allow")
    joined = placed.join(known, "host", "left")
    return joined.select(*base, "host", "path", rule.alias("rule"), F.coalesce(verdict, learned).alias("verdict"), "rate", "low")
