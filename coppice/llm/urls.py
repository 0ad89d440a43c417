"""URL filters: explicit rules first, else empirical-Bayes host reputation. Native.

Labelled page outcomes (1: bad) are counted by host, registered domain and suffix. Bad rates are shrunk downwards
through the tree: the suffix's towards the overall rate, the registered domain's towards its suffix's, the host's
towards its domain's, each as the mean of a beta-binomial posterior. How strongly (the prior's sample size) is
estimated at each level from the spread of its groups' rates by the method of moments. A url is blocked if even the
lower bound of its host's posterior bad rate (mean minus ``Z`` standard deviations) is over ``BAD``; doubt allows.

For the tree, user info and port are no part of a host. Its suffix is its last label; two labels if they are among
``SUFFIXES``, or if the last one has two letters and the one before is a usual second level (``SECOND``: co.kr, com.tr, ...);
the registered domain has one label more. This is not the whole public-suffix list: what it doesn't know counts as one
registered domain. Numeric addresses are domains of their own under the suffix "ip".

The outcomes of hosts are counted once and stored; the three levels are read from there. Suffixes are joined by broadcast
up to ``BROADCAST`` rows; domains with many hosts and hosts with many pages by broadcast of these alone.

Defined cases: a null url or one without "://" has empty host and path, fits no rule and takes the posterior of the
empty host; null labels are no outcome; without labels every url is allowed unless a rule blocks it; repeated rows and
repeated labels count as they stand; urls of any length are read whole; other columns, whatever their names, play no part;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import discard, join_with_hot_keys, stored

BAD, Z = 0.5, 1.645
#: Prior sample sizes are kept within these bounds.
WEAK, STRONG = 1.0, 10_000.0
#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Second levels under which countries register, and other suffixes of two labels.
SECOND = ("ac", "co", "com", "edu", "go", "gob", "gov", "gouv", "ltd", "me", "mil", "ne", "net", "nom", "or", "org", "plc", "sch")
SUFFIXES = (
    "appspot.com", "azurewebsites.net", "blogspot.com", "cloudfront.net", "firebaseapp.com", "fly.dev", "github.io", "gitlab.io", "herokuapp.com", "netlify.app", "pages.dev",
    "readthedocs.io", "translate.goog", "vercel.app", "web.app", "weebly.com", "wixsite.com", "wordpress.com", "workers.dev",
)
BROADCAST = 1 << 17


def host_of(url: Column) -> Column:
    """Between the first "://" and the next /, ?, # or the end, A-Z lower-cased; "" without one."""
    after = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(after, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, null without one; equally long ones in the given order."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def name_of(host: Column) -> Column:
    """A host without user info and port."""
    return F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", "")


def _levels(name: Column) -> tuple[Column, Column]:
    """(registered domain, suffix)."""
    two, last = F.substring_index(name, ".", -2), F.substring_index(name, ".", -1)
    double = two.isin(*SUFFIXES) | ((F.length(last) == 2) & F.substring_index(two, ".", 1).isin(*SECOND) & two.contains("."))
    address = name.rlike(r"^[0-9.]+$")
    domain = F.when(address, name).when(double, F.substring_index(name, ".", -3)).otherwise(two)
    return domain, F.when(address, "ip").when(double, two).otherwise(last)


def _strength(groups: DataFrame, mean: Column) -> float:
    """Prior sample size at a level, from groups (n, bad) whose parents' mean is given."""
    spread = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, 2))
    sampling = F.sum(mean * (1 - mean))
    weight = F.sum("n") - F.sum(F.col("n") * F.col("n")) / F.sum("n")
    between = F.when(weight > 0, F.greatest(F.lit(0.0), (spread - sampling + sampling / F.count("*")) / weight)).otherwise(0.0)
    k = F.when(between > 0, sampling / F.count("*") / between - 1).otherwise(STRONG)
    return groups.where("n > 0").agg(F.coalesce(F.greatest(F.lit(WEAK), F.least(F.lit(STRONG), k)), F.lit(STRONG)).alias("k")).first()["k"]


def reputation(outcomes: DataFrame) -> DataFrame:
    """(host, low, _n), stored: lower posterior bound of the bad rate of each host in outcomes (host, n, bad, _n), one row a host."""
    domain, suffix = _levels(F.col("name"))
    rows = stored(outcomes.withColumn("name", name_of(F.col("host"))).select("host", "n", "bad", "_n", domain.alias("domain"), suffix.alias("suffix")))
    shrunk = lambda up, k: (F.col("bad") + k * up) / (F.col("n") + k)
    total = rows.agg(F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()
    mean = F.lit((total["bad"] + 1.0) / (total["n"] + 2.0))
    suffixes = stored(rows.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")))
    above = suffixes.select("suffix", shrunk(mean, F.lit(_strength(suffixes, mean))).alias("m1"))
    above = F.broadcast(above) if suffixes.count() <= BROADCAST else above
    domains = rows.groupBy("domain").agg(F.min("suffix").alias("suffix"), F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count("*").alias("_n"))
    domains = stored(domains.join(above, "suffix"))
    over = domains.select("domain", shrunk(F.col("m1"), F.lit(_strength(domains, F.col("m1")))).alias("m2"), "_n")
    hosts = stored(join_with_hot_keys(rows, over, "domain"))
    k = F.lit(_strength(hosts, F.col("m2")))
    a, b = F.col("bad") + k * F.col("m2"), F.col("n") - F.col("bad") + k * (1 - F.col("m2"))
    mean, deviation = a / (a + b), F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    out = stored(hosts.select("host", (mean - Z * deviation).alias("low"), "_n"))
    discard(rows, suffixes, domains, hosts)
    return out


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, bad: float = BAD) -> DataFrame:
    """page_id, host, path, rule, verdict. ``labels``: page_id, outcome (1 bad, 0 good)."""
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    parsed = parsed.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = labels.where("outcome is not null").groupBy("page_id").agg(F.count("*").alias("n"), F.sum("outcome").alias("bad"))
    seen = parsed.join(known, "page_id", "left")
    by_host = seen.groupBy("host").agg(F.count("*").alias("_n"), F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).cast("double").alias("bad"))
    judged = join_with_hot_keys(parsed, reputation(by_host), "host")  # a host may have a third of all pages
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("low") > bad, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def page_outcomes(labels: DataFrame) -> DataFrame:
    """Outcomes from the labels table: a page shares the id of its document; bad: toxic or of low quality."""
    toxic, quality = F.col("toxic"), F.col("quality")
    bad = F.when((toxic == 1) | (quality == 0), 1).when(toxic.isNotNull() | quality.isNotNull(), 0)
    return labels.select(F.col("doc_id").alias("page_id"), bad.alias("outcome"))


ORACLE = f"""
WITH parsed AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
known AS (SELECT doc_id AS page_id, count(*) AS n, sum(CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END) AS bad
  FROM labels WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
hosts AS (SELECT host, CAST(coalesce(sum(n), 0) AS DOUBLE) AS n, CAST(coalesce(sum(bad), 0) AS DOUBLE) AS bad
  FROM parsed LEFT JOIN known USING (page_id) GROUP BY host),
parts AS (SELECT *, string_split(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '.') AS p FROM hosts),
two AS (SELECT *, array_to_string(p[-2:], '.') AS last2, array_to_string(p, '.') AS name FROM parts),
marked AS (SELECT *, last2 IN {SUFFIXES} OR (length(p[-1]) = 2 AND len(p) > 1 AND p[-2] IN {SECOND}) AS double_, regexp_matches(name, '^[0-9.]+$') AS address FROM two),
named AS (SELECT host, n, bad,
  CASE WHEN address THEN 'ip' WHEN double_ THEN last2 ELSE p[-1] END AS suffix,
  CASE WHEN address THEN name WHEN double_ THEN array_to_string(p[-3:], '.') ELSE last2 END AS domain FROM marked),
total AS (SELECT (coalesce(sum(bad), 0) + 1.0::DOUBLE) / (coalesce(sum(n), 0) + 2.0::DOUBLE) AS m FROM named),
s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM named, total GROUP BY suffix),
"""
ORACLE += "".join(
    f"""
k{i}v AS (SELECT sum(n) - sum(n * n) / sum(n) AS w, sum(n * pow(bad / n - m, 2)) AS q, sum(m * (1 - m)) AS e, count(*) AS c FROM {table} WHERE n > 0),
k{i}b AS (SELECT e / c AS usual, CASE WHEN w > 0 THEN greatest(0.0::DOUBLE, (q - e + e / c) / w) ELSE 0.0::DOUBLE END AS between_ FROM k{i}v),
k{i} AS (SELECT coalesce(greatest({WEAK}::DOUBLE, least({STRONG}::DOUBLE, CASE WHEN between_ > 0 THEN usual / between_ - 1 ELSE {STRONG}::DOUBLE END)), {STRONG}::DOUBLE) AS k FROM k{i}b),
{after}"""
    for i, table, after in (
        (1, "s0", "m1 AS (SELECT suffix, (bad + k * m) / (n + k) AS m FROM s0, k1),\nd0 AS (SELECT suffix, domain, sum(n) AS n, sum(bad) AS bad, any_value(m) AS m FROM named JOIN m1 USING (suffix) GROUP BY suffix, domain),"),
        (2, "d0", "m2 AS (SELECT suffix, domain, (bad + k * m) / (n + k) AS m FROM d0, k2),\nh0 AS (SELECT host, n, bad, m FROM named JOIN m2 USING (suffix, domain)),"),
        (3, "h0", "ab AS (SELECT host, bad + k * m AS a, n - bad + k * (1 - m) AS b FROM h0, k3),"),
    )
)


def _oracle_rules() -> str:
    rule = verdict = "NULL"
    for kind, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
        rule, verdict = f"CASE WHEN {fits} THEN '{h + p}' ELSE {rule} END", f"CASE WHEN {fits} THEN '{kind}' ELSE {verdict} END"
    low = f"a / (a + b) - {Z}::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))"
    return f"""
low AS (SELECT host, {low} AS low FROM ab)
SELECT page_id, host, path, CAST({rule} AS VARCHAR) AS rule, coalesce({verdict}, CASE WHEN low > {BAD} THEN 'block' ELSE 'allow' END) AS verdict
FROM parsed JOIN low USING (host)"""


ORACLE += _oracle_rules()
