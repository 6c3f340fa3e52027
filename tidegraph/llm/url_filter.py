"""URL filters: rules by host suffix and path prefix, and beyond them a host's reputation by empirical Bayes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: (verdict, host, path)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Suffixes of two labels under which domains are registered; all others have one label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "com.au", "co.jp", "com.br")
BOUND_Z = 1.645
MAX_BAD = 0.5


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = None
    for what, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)) if rule is None else rule.when(fits, F.lit(h + p))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    return (F.lit(None).cast("string"),) * 2 if rule is None else (rule, verdict)


def suffix_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*TWO_LABEL_SUFFIXES), F.substring_index(host, ".", -3)).otherwise(two)


def _strength(groups: DataFrame, parent_rate: str) -> DataFrame:
    """One row: the prior's strength m at this level, by moments of the groups' rates around their parents' rates.

    With rates p of n pages each under a parent's rate q, sum n(p-q)^2 has the expectation
    sum q(1-q) + rho * sum (n-1) q(1-q); the prior's strength is (1-rho)/rho, held between 1 and 1000.
    """
    q = F.col(parent_rate)
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - q, 2))
    base = F.sum(q * (1 - q))
    extra = F.sum((F.col("n") - 1) * q * (1 - q))
    rho = F.greatest(F.lit(0.001), F.least(F.lit(0.5), F.coalesce(F.try_divide(spread - base, extra), F.lit(0.5))))
    return groups.agg(((1 - rho) / rho).alias("m"))


def host_reputation(pages: DataFrame, outcomes: DataFrame) -> DataFrame:
    """host, n, bad, alpha, beta of each host that has pages: its Beta posterior for the share of bad pages.

    pages: page_id, host. outcomes: page_id, bad (0 or 1), a row for each labelled page. A suffix shrinks to the rate
    of all pages, a registered domain to its suffix, a host to its domain; each level's prior strength is fitted to
    the labelled outcomes. The sums of each level are written once. Each level is a grouped sum, so a host with a third of all pages is added up map-side.
    """
    by_host = pages.join(outcomes, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = stored(by_host, "hosts").withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    domains = stored(hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "suffixes")

    # the driver gets one number for each level: the rate of all pages, then the three strengths
    one = lambda df: F.lit(df.first()[0])
    level = suffixes.withColumn("all_rate", one(suffixes.agg((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2))))
    m = one(_strength(level.where("n > 0"), "all_rate"))
    below = domains.join(level.select("suffix", ((F.col("bad") + m * F.col("all_rate")) / (F.col("n") + m)).alias("suffix_rate")), "suffix")
    m = one(_strength(below.where("n > 0"), "suffix_rate"))
    last = hosts.join(below.select("domain", ((F.col("bad") + m * F.col("suffix_rate")) / (F.col("n") + m)).alias("domain_rate")), "domain")
    m = one(_strength(last.where("n > 0"), "domain_rate"))
    return last.select("host", "n", "bad", (F.col("bad") + m * F.col("domain_rate")).alias("alpha"), (F.col("n") - F.col("bad") + m * (1 - F.col("domain_rate"))).alias("beta"))


def reputation_verdict(alpha: Column, beta: Column, z: float = BOUND_Z, max_bad: float = MAX_BAD) -> Column:
    """block where even the lower bound of the posterior share of bad pages is over max_bad, else allow."""
    mean = alpha / (alpha + beta)
    sd = F.sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1)))
    return F.when(mean - z * sd > max_bad, F.lit("block")).otherwise(F.lit("allow"))


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict for each page. A rule's verdict stands; the reputation judges the rest.

    Edge cases: a null url, or one without `://`, has an empty host and path and the reputation of the empty host;
    repeated pages each get a row; repeated outcomes of a page count once (the worst); without any outcome nothing is
    blocked but by a rule; of two rules that fit the longer one stands, of equally long ones the first
    given; a long url is parsed whole; columns of pages besides page_id and url play no part; an empty table gives none.
    """
    outcomes = outcomes.where("page_id is not null and bad is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    known = host_reputation(rows.select("page_id", "host"), outcomes).select("host", reputation_verdict(F.col("alpha"), F.col("beta")).alias("_own"))
    return rows.join(known, "host", "left").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, "_own", F.lit("allow")).alias("verdict"))


def document_of(path: Column) -> Column:
    """The number of the document that a page shows: what its path ends with, null where that is no number."""
    return F.regexp_extract(path, r"/([0-9]{1,18})(?:/|\.[a-z]+)?$", 1).try_cast("bigint")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's labelled outcome is the label of the document that it shows: bad if its quality is 0 or it is toxic."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)).alias("bad"))
    outcomes = pages.select("page_id", document_of(path_of(F.col("url"))).alias("doc_id")).join(labels, "doc_id").select("page_id", "bad")
    return filter_urls(pages, outcomes)


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
p AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
outcomes AS (
  SELECT page_id, max(bad) AS bad FROM p JOIN l ON TRY_CAST(regexp_extract(path, '/([0-9]{1,18})(?:/|\.[a-z]+)?$', 1) AS BIGINT) = l.doc_id
  WHERE page_id IS NOT NULL GROUP BY 1),
hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0)::BIGINT AS bad,
         array_to_string(string_split(host, '.')[-2:], '.') AS two
  FROM p LEFT JOIN outcomes USING (page_id) GROUP BY host),
h AS (
  SELECT host, n, bad,
         CASE WHEN two IN ('co.uk', 'org.uk', 'com.au', 'co.jp', 'com.br') THEN two ELSE string_split(host, '.')[-1] END AS suffix,
         CASE WHEN two IN ('co.uk', 'org.uk', 'com.au', 'co.jp', 'com.br') THEN array_to_string(string_split(host, '.')[-3:], '.') ELSE two END AS domain
  FROM hosts),
d AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
t AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS q FROM s),
m1 AS (SELECT greatest(0.001, least(0.5, coalesce((sum(n * (bad / n - q) ** 2) - sum(q * (1 - q))) / nullif(sum((n - 1) * q * (1 - q)), 0), 0.5))) AS rho FROM s, t WHERE n > 0),
s1 AS (SELECT suffix, (bad + (1 - rho) / rho * q) / (n + (1 - rho) / rho) AS q FROM s, t, m1),
d0 AS (SELECT domain, n, bad, q FROM d JOIN s1 USING (suffix)),
m2 AS (SELECT greatest(0.001, least(0.5, coalesce((sum(n * (bad / n - q) ** 2) - sum(q * (1 - q))) / nullif(sum((n - 1) * q * (1 - q)), 0), 0.5))) AS rho FROM d0 WHERE n > 0),
d1 AS (SELECT domain, (bad + (1 - rho) / rho * q) / (n + (1 - rho) / rho) AS q FROM d0, m2),
h0 AS (SELECT host, n, bad, q FROM h JOIN d1 USING (domain)),
m3 AS (SELECT greatest(0.001, least(0.5, coalesce((sum(n * (bad / n - q) ** 2) - sum(q * (1 - q))) / nullif(sum((n - 1) * q * (1 - q)), 0), 0.5))) AS rho FROM h0 WHERE n > 0),
h1 AS (SELECT host, bad + (1 - rho) / rho * q AS a, n - bad + (1 - rho) / rho * (1 - q) AS b FROM h0, m3),
v AS (SELECT host, CASE WHEN a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) > 0.5 THEN 'block' ELSE 'allow' END AS own FROM h1),
r(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
hit AS (
  SELECT page_id, host, path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
  FROM p LEFT JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.p)
  GROUP BY page_id, host, path)
SELECT page_id, host, path, rule, coalesce(hit.verdict, v.own, 'allow') AS verdict FROM hit LEFT JOIN v USING (host)
"""
