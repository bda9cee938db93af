"""URL filter: host reputation by empirical Bayes, under explicit allow and block rules.

Labelled page outcomes (bad or not) are counted per host. Each level (suffix, registered
domain, host) gets a beta-binomial prior whose mean is the posterior mean of the level
above and whose strength is fitted by moments over all groups of the level:

    Q = sum n (p - m)^2 / (m (1 - m)),  E[Q] = K + rho * sum (n - 1),  M = 1/rho - 1

A url is blocked if the lower bound of its host's posterior bad rate (mean less `z`
standard deviations) exceeds `most_bad`. Hosts without outcomes inherit their domain.

Edge cases: a null url, or one without "://", has empty host and path and is judged by
the group of empty hosts; a null page_id stays null; repeated pages count once each; urls of any
length are read whole; other columns of the input play no part, whatever their names; with no
labels at all every host has the flat prior and is allowed; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = (
    "ac.jp", "ac.nz", "ac.uk", "ac.za", "co.id", "co.il", "co.in", "co.jp", "co.kr", "co.nz", "co.th", "co.uk",
    "co.za", "com.ar", "com.au", "com.br", "com.cn", "com.hk", "com.mx", "com.my", "com.sg", "com.tr", "com.tw",
    "gov.au", "gov.uk", "ne.jp", "net.au", "net.br", "or.jp", "org.au", "org.br", "org.nz", "org.uk", "org.za",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed values of the query: (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
Z, MOST_BAD = 1.2816, 0.25
#: Bad rate of the one page that stands above all others.
PRIOR_BAD = 0.1
LEAST_RHO, MOST_RHO = 1e-4, 0.999


def split_url(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.expr("substring(url, locate('://', url) + 3)")).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as (rule, verdict); null without one."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def with_names(hosts: DataFrame) -> DataFrame:
    """Adds the registered domain and the suffix of each host."""
    labels = F.split("host", r"\.")
    last_two = F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2))
    wide = last_two.isin(*TWO_LABEL_SUFFIXES).cast("int")
    return (
        hosts.withColumn("_n", F.least(F.size(labels), 2 + wide))
        .withColumn("domain", F.concat_ws(".", F.slice(labels, F.size(labels) - F.col("_n") + 1, F.col("_n"))))
        .withColumn("suffix", F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - wide, F.lit(1)), 1 + wide)))
        .drop("_n")
    )


def shrink(groups: DataFrame, name: str) -> DataFrame:
    """groups has n, bad and the parent's posterior mean `up`; adds the posterior's mean and deviation. They are stored: two passes read them."""
    groups = common.stored(groups, name)
    has, spread = F.col("n") > 0, F.col("up") * (1 - F.col("up"))
    q, k, free = groups.agg(
        F.sum(F.when(has, F.col("n") * F.pow(F.col("bad") / F.col("n") - F.col("up"), 2) / spread)),
        F.sum(has.cast("long")),
        F.sum(F.when(has, F.col("n") - 1)),
    ).first()
    rho = (q - k) / free if free and free > 0 else LEAST_RHO
    strength = F.lit(1 / min(MOST_RHO, max(LEAST_RHO, rho)) - 1)
    mean = (strength * F.col("up") + F.col("bad")) / (strength + F.col("n"))
    return groups.withColumn("mean", mean).withColumn("deviation", F.sqrt(F.col("mean") * (1 - F.col("mean")) / (strength + F.col("n") + 1))).drop("up")


def host_reputation(outcomes: DataFrame) -> DataFrame:
    """outcomes: one row per host with pages, n (labelled pages) and bad; adds mean and deviation."""
    hosts = common.stored(with_names(outcomes), "op1-hosts")
    n, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()
    everything = F.lit(((bad or 0) + PRIOR_BAD) / ((n or 0) + 1))
    sums = (F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("hosts"))
    by_domain = common.stored(hosts.groupBy("suffix", "domain").agg(*sums), "op1-domain-sums")
    by_suffix = by_domain.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("domains"))
    suffixes = shrink(by_suffix.withColumn("up", everything), "op1-suffixes")
    # a domain's name tells its suffix; large suffixes and domains are dealt out
    up = suffixes.select("suffix", "domains", F.col("mean").alias("up"))
    domains = shrink(common.join_on_hot_key(by_domain, up, "suffix", "domains", F.col("domain")), "op1-domains")
    up = domains.select("domain", "hosts", F.col("mean").alias("up"))
    return shrink(common.join_on_hot_key(hosts, up, "domain", "hosts", F.col("host")), "op1-posteriors")


def judge(pages: DataFrame, bad_docs: DataFrame, rules=RULES, z: float = Z, most_bad: float = MOST_BAD) -> DataFrame:
    """pages (page_id, url) and bad_docs (number, bad 0/1), the outcome of the document in a url's path."""
    host, path = split_url(F.col("url"))
    read = pages.select("page_id", host.alias("host"), path.alias("path"))
    number = F.regexp_extract("path", "/([0-9]{1,18})", 1)
    counted = read.groupBy("host", F.when(number != "", number.cast("long")).alias("number")).agg(F.count("*").alias("pages"))
    counted = common.stored(counted, "op1-numbers")
    numbered = counted.where("number is not null")
    seen = numbered.groupBy("number").agg(F.count("*").alias("rows")).join(bad_docs, "number")
    known = common.join_on_hot_key(numbered, seen, "number", "rows", F.col("host")).unionByName(counted.where("number is null"), allowMissingColumns=True)
    outcomes = known.groupBy("host").agg(
        F.sum("pages").alias("pages"),
        F.sum(F.when(F.col("bad").isNotNull(), F.col("pages")).otherwise(F.lit(0))).alias("n"),
        F.sum(F.when(F.col("bad") == 1, F.col("pages")).otherwise(F.lit(0))).alias("bad"),
    )
    facts = common.stored(host_reputation(outcomes), "op1-reputation").select("host", "pages", F.col("n").alias("labelled"), "mean", "deviation")
    judged = common.join_on_hot_key(read, facts, "host", "pages", F.col("page_id"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    low = F.greatest(F.lit(0.0), F.col("mean") - z * F.col("deviation"))
    return judged.select(
        "page_id",
        "host",
        "path",
        rule.alias("rule"),
        F.coalesce(verdict, F.when(low > most_bad, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.round("mean", 6).alias("bad_rate"),
        F.round(low, 6).alias("bad_rate_low"),
        F.col("labelled").cast("long").alias("labelled"),
    )


def op1_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = common.table(sf_dir, "labels", spark).where(F.col("doc_id").isNotNull())
    bad = labels.groupBy(F.col("doc_id").alias("number")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad")
    )
    return judge(common.table(sf_dir, "pages", spark).select("page_id", "url"), bad)


_IN = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)


def _level(name: str, groups: str, keys: str) -> str:
    fitted = f"""{name}_fit AS (SELECT 1 / least({MOST_RHO}, greatest({LEAST_RHO}, CASE WHEN coalesce(sum(CASE WHEN n > 0 THEN n - 1 END), 0) > 0
        THEN (sum(CASE WHEN n > 0 THEN n * pow(bad / n - up, 2) / (up * (1 - up)) END) - sum((n > 0)::int)) / sum(CASE WHEN n > 0 THEN n - 1 END)
        ELSE {LEAST_RHO} END)) - 1 AS strength FROM {groups})"""
    return f"""{fitted},
    {name} AS (SELECT {keys}, n, (strength * up + bad) / (strength + n) AS mean, strength FROM {groups}, {name}_fit)"""


_FITS = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
_BY_LENGTH = sorted(RULES, key=lambda r: -len(r[1] + r[2]))
_RULE = "CASE " + " ".join(f"WHEN {_FITS.format(h, p)} THEN '{h + p}'" for _, h, p in _BY_LENGTH) + " END"
_VERDICT = "CASE " + " ".join(f"WHEN {_FITS.format(h, p)} THEN '{k}'" for k, h, p in _BY_LENGTH) + " END"
SQL = f"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
read AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
numbered AS (SELECT *, try_cast(nullif(regexp_extract(path, '/([0-9]{{1,18}})', 1), '') AS BIGINT) AS number FROM read),
bad_docs AS (SELECT doc_id AS number, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
hosts AS (SELECT host, count(b.bad)::DOUBLE AS n, coalesce(sum(b.bad), 0)::DOUBLE AS bad FROM numbered LEFT JOIN bad_docs b USING (number) GROUP BY 1),
parts AS (SELECT *, string_split(host, '.') AS l, (array_to_string(string_split(host, '.')[-2:], '.') IN ({_IN}))::int AS wide FROM hosts),
named AS (SELECT host, n, bad, array_to_string(l[greatest(len(l) - 1 - wide, 1):], '.') AS domain, array_to_string(l[greatest(len(l) - wide, 1):], '.') AS suffix FROM parts),
a0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (coalesce(sum(bad), 0) + {PRIOR_BAD}) / (coalesce(sum(n), 0) + 1) FROM named) AS up FROM named GROUP BY 1),
{_level("suffixes", "a0", "suffix")},
b0 AS (SELECT suffix, domain, sum(d.n) AS n, sum(d.bad) AS bad, any_value(s.mean) AS up FROM named d JOIN suffixes s USING (suffix) GROUP BY 1, 2),
{_level("domains", "b0", "suffix, domain")},
c0 AS (SELECT h.host, h.n, h.bad, d.mean AS up FROM named h JOIN domains d USING (suffix, domain)),
{_level("reputation", "c0", "host")},
scored AS (SELECT page_id, host, path, n, mean, greatest(0.0, mean - {Z} * sqrt(mean * (1 - mean) / (strength + n + 1))) AS low FROM read JOIN reputation USING (host))
SELECT page_id, host, path, {_RULE} AS rule, coalesce({_VERDICT}, CASE WHEN low > {MOST_BAD} THEN 'block' ELSE 'allow' END) AS verdict,
  round(mean, 6) AS bad_rate, round(low, 6) AS bad_rate_low, n::BIGINT AS labelled FROM scored
"""
