"""URL filters: rules on host suffix and path prefix, then empirical-Bayes host reputation.

Labelled page outcomes are shrunk through beta-binomial priors: the corpus rate is the prior mean of a suffix, the
suffix posterior mean that of its registered domains, and the domain posterior mean that of its hosts. How strongly a
level is shrunk is estimated from the data, by moments: the more the children of a level differ beyond binomial
chance, the fewer pseudo-observations they inherit. A host is blocked if the lower posterior bound of its bad rate is
above a limit; the bound is the normal approximation of the beta posterior. DataFrame functions only.

Defined cases: a null url, or one without ``://``, has empty host and path and fits no rule; all of these share the
reputation of the host ``''``; an address of four numbers is its own domain, without a suffix; an unlabelled host takes
its domain's or suffix's posterior; a label without an outcome is none; repeated rows are judged alike and their
outcomes count once for each row; without any label the prior is PRIOR_RATE; a level of which no parent has two
labelled children keeps its STRENGTH; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialize, read

#: Host suffix and path prefix -> verdict.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Second-level names under which a country registers domains.
SECOND_LEVEL = ["ac", "co", "com", "edu", "gov", "net", "org"]
#: Pseudo-observations that a level inherits from the one above where the data can't tell, and bounds of the estimate.
STRENGTH, WEAKEST, STRONGEST = {"suffix": 50.0, "domain": 20.0, "host": 10.0}, 1.0, 1000.0
PRIOR_RATE, BAD_RATE, Z = 0.1, 0.25, 1.6448536269514722


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*(/[^?#]*)", 1)


_IPV4 = r"^[0-9]+(\.[0-9]+){3}$"


def suffix_of(host: Column) -> Column:
    """The last label, or the last two where a country code follows a second-level name; ports are cut."""
    name = F.regexp_replace(host, r":\d*$", "")
    return F.when(name.rlike(_IPV4), "").otherwise(F.regexp_extract(name, rf"(?:^|\.)((?:(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})|[^.]*)$", 1))


def domain_of(host: Column) -> Column:
    """The suffix and one label before it."""
    name = F.regexp_replace(host, r":\d*$", "")
    return F.when(name.rlike(_IPV4), name).otherwise(F.regexp_extract(name, rf"(?:^|\.)([^.]*\.(?:(?:(?:{'|'.join(SECOND_LEVEL)})\.[a-z]{{2}})|[^.]*))$", 1))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits. Rules are few and become one CASE."""
    name = verdict = None
    for suffix, prefix, says in sorted(rules, key=lambda r: (-len(r[0]) - len(r[1]), r)):
        fits = ((host == suffix) | host.endswith("." + suffix)) & path.startswith(prefix)
        name = F.when(fits, suffix + prefix) if name is None else name.when(fits, suffix + prefix)
        verdict = F.when(fits, says) if verdict is None else verdict.when(fits, says)
    return (F.lit(None).cast("string"),) * 2 if name is None else (name, verdict)


def strength(children: DataFrame, n: str, bad: str, mean: str, siblings: str, default: float, name: str) -> DataFrame:
    """One row: the pseudo-observations of a level, by moments over children that have labelled siblings.

    A child of n outcomes around the mean m has squared deviation n m (1 - m) (1 + (n - 1) / (strength + 1)) on average.
    """
    n, bad, mean = F.col(n), F.col(bad), F.col(mean)
    chance = n * mean * (1 - mean)
    beyond = F.sum((bad - n * mean) * (bad - n * mean) - chance)
    per = F.sum((n - 1) * chance)
    share = (beyond / per).alias("share")
    told = children.where((F.col(siblings) > 1) & (n > 0)).agg(F.when(per > 0, share).alias("share"))
    estimate = F.round(F.least(F.lit(STRONGEST), F.greatest(F.lit(WEAKEST), F.when(F.col("share") > 0, 1 / F.col("share") - 1).otherwise(STRONGEST))), 6)
    return told.select(F.when(F.col("share").isNull(), default).otherwise(estimate).alias(name))


def reputation(outcomes: DataFrame, fixed: dict[str, float] | None = None) -> DataFrame:
    """outcomes(host, n, bad): additive counts of labelled pages by host, one row for each host (n may be 0).

    Returns host, domain, suffix, n, bad, alpha and beta of the host's posterior, rate and lower (its bound). The
    levels are small aggregates of one another; windows would gather a suffix in one task, so they are joined. fixed
    sets the strength of levels that are not to be estimated. What is broadcast has one row.
    """
    fixed = fixed or {}
    spark = outcomes.sparkSession
    given = lambda level: spark.range(1).select(F.lit(float(fixed[level])).alias(f"k_{level}")) if level in fixed else None
    hosts = outcomes.select("host", domain_of(F.col("host")).alias("domain"), suffix_of(F.col("host")).alias("suffix"), F.col("n").cast("double").alias("n"), F.col("bad").cast("double").alias("bad"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("bad").alias("db"), F.count_if(F.col("n") > 0).alias("told_hosts"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("db").alias("sb"), F.count_if(F.col("dn") > 0).alias("told_domains"))
    rate = F.when(F.sum("sn") > 0, (F.sum("sb") + 0.5) / (F.sum("sn") + 1)).otherwise(PRIOR_RATE)
    suffixes = suffixes.crossJoin(F.broadcast(suffixes.agg(rate.alias("crate"), F.count_if(F.col("sn") > 0).alias("told_suffixes"))))
    suffixes = suffixes.crossJoin(F.broadcast(given("suffix") or strength(suffixes, "sn", "sb", "crate", "told_suffixes", STRENGTH["suffix"], "k_suffix")))
    suffixes = suffixes.select("suffix", "told_domains", ((F.col("sb") + F.col("k_suffix") * F.col("crate")) / (F.col("sn") + F.col("k_suffix"))).alias("srate"))
    domains = domains.join(suffixes, "suffix")
    domains = domains.crossJoin(F.broadcast(given("domain") or strength(domains, "dn", "db", "srate", "told_domains", STRENGTH["domain"], "k_domain")))
    domains = domains.select("domain", "suffix", "told_hosts", ((F.col("db") + F.col("k_domain") * F.col("srate")) / (F.col("dn") + F.col("k_domain"))).alias("drate"))
    hosts = hosts.join(domains, ["domain", "suffix"])
    hosts = hosts.crossJoin(F.broadcast(given("host") or strength(hosts, "n", "bad", "drate", "told_hosts", STRENGTH["host"], "k_host")))
    alpha, beta = F.col("bad") + F.col("k_host") * F.col("drate"), F.col("n") - F.col("bad") + F.col("k_host") * (1 - F.col("drate"))
    mean, total = F.col("alpha") / (F.col("alpha") + F.col("beta")), F.col("alpha") + F.col("beta")
    return (
        hosts.select("host", "domain", "suffix", "n", "bad", alpha.alias("alpha"), beta.alias("beta"))
        .withColumn("rate", mean)
        .withColumn("lower", F.greatest(F.lit(0.0), F.col("rate") - Z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (total + 1))))
    )


def filter_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] | None = None, bad_rate: float = BAD_RATE) -> DataFrame:
    """pages(page_id, url) and labels(page_id, bad 0/1) -> one row for each page with its rule and verdict.

    Labels are counted by page before they meet pages; hosts are counted with partial sums before the shuffle; the
    reputation of a hot host is joined to its pages by a sort-merge join, which AQE splits.
    """
    rules = RULES if rules is None else rules
    page = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    label = labels.where(F.col("page_id").isNotNull() & F.col("bad").isNotNull()).groupBy(F.col("page_id").cast("long").alias("page_id")).agg(F.max(F.col("bad").cast("double")).alias("bad"))
    counts = page.join(label, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"))
    counts = materialize(counts, "hosts", fold=True)  # every level is made of these, so urls are read and cut once for them
    known = reputation(counts).select("host", "rate", "lower")
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    return page.join(known, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(says, F.when(F.col("lower") > bad_rate, "block").otherwise("allow")).alias("verdict"),
        F.round("rate", 9).alias("bad_rate"), F.round("lower", 9).alias("bad_rate_lower"),
    )


def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is bad if the labelled document of the same id is toxic or of low quality, and unknown if neither is known."""
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    return filter_urls(read(spark, sf_dir, "pages"), labels)


SQL = r"""
WITH page AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s).*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s).*?://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
label AS (SELECT doc_id AS page_id, max(CASE WHEN toxic = 1 OR quality = 0 THEN 1.0::DOUBLE WHEN toxic IS NOT NULL OR quality IS NOT NULL THEN 0.0::DOUBLE END) AS bad FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
host0 AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad FROM page LEFT JOIN label USING (page_id) GROUP BY host),
hosts AS (SELECT host, n, bad,
    CASE WHEN regexp_matches(name, '^[0-9]+(\.[0-9]+){3}$') THEN '' ELSE regexp_extract(name, '(?:^|\.)((?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2})|[^.]*)$', 1) END AS suffix,
    CASE WHEN regexp_matches(name, '^[0-9]+(\.[0-9]+){3}$') THEN name ELSE regexp_extract(name, '(?:^|\.)([^.]*\.(?:(?:(?:ac|co|com|edu|gov|net|org)\.[a-z]{2})|[^.]*))$', 1) END AS domain
  FROM host0),
domain0 AS (SELECT domain, suffix, sum(n) AS dn, sum(bad) AS db, count(*) FILTER (WHERE n > 0) AS told_hosts FROM hosts GROUP BY domain, suffix),
suffix0 AS (SELECT suffix, sum(dn) AS sn, sum(db) AS sb, count(*) FILTER (WHERE dn > 0) AS told_domains FROM domain0 GROUP BY suffix),
corpus AS (SELECT CASE WHEN sum(sn) > 0 THEN (sum(sb) + 0.5::DOUBLE) / (sum(sn) + 1) ELSE 0.1::DOUBLE END AS crate, count(*) FILTER (WHERE sn > 0) AS told_suffixes FROM suffix0),
moment_s AS (SELECT sum((sb - sn * crate) * (sb - sn * crate) - sn * crate * (1 - crate)) AS beyond, sum((sn - 1) * (sn * crate * (1 - crate))) AS per FROM suffix0, corpus WHERE told_suffixes > 1 AND sn > 0),
level_s AS (SELECT CASE WHEN per > 0 THEN round(least(1000.0::DOUBLE, greatest(1.0::DOUBLE, CASE WHEN beyond / per > 0 THEN 1 / (beyond / per) - 1 ELSE 1000.0::DOUBLE END)), 6) ELSE 50.0::DOUBLE END AS ks FROM moment_s),
suffixes AS (SELECT suffix, told_domains, (sb + ks * crate) / (sn + ks) AS srate FROM suffix0, corpus, level_s),
domain1 AS (SELECT * FROM domain0 JOIN suffixes USING (suffix)),
moment_d AS (SELECT sum((db - dn * srate) * (db - dn * srate) - dn * srate * (1 - srate)) AS beyond, sum((dn - 1) * (dn * srate * (1 - srate))) AS per FROM domain1 WHERE told_domains > 1 AND dn > 0),
level_d AS (SELECT CASE WHEN per > 0 THEN round(least(1000.0::DOUBLE, greatest(1.0::DOUBLE, CASE WHEN beyond / per > 0 THEN 1 / (beyond / per) - 1 ELSE 1000.0::DOUBLE END)), 6) ELSE 20.0::DOUBLE END AS kd FROM moment_d),
domains AS (SELECT domain, suffix, told_hosts, (db + kd * srate) / (dn + kd) AS drate FROM domain1, level_d),
host1 AS (SELECT * FROM hosts JOIN domains USING (domain, suffix)),
moment_h AS (SELECT sum((bad - n * drate) * (bad - n * drate) - n * drate * (1 - drate)) AS beyond, sum((n - 1) * (n * drate * (1 - drate))) AS per FROM host1 WHERE told_hosts > 1 AND n > 0),
level_h AS (SELECT CASE WHEN per > 0 THEN round(least(1000.0::DOUBLE, greatest(1.0::DOUBLE, CASE WHEN beyond / per > 0 THEN 1 / (beyond / per) - 1 ELSE 1000.0::DOUBLE END)), 6) ELSE 10.0::DOUBLE END AS kh FROM moment_h),
posterior AS (SELECT host, bad + kh * drate AS alpha, n - bad + kh * (1 - drate) AS beta FROM host1, level_h),
bound AS (SELECT host, alpha / (alpha + beta) AS rate, alpha + beta AS total FROM posterior),
known AS (SELECT host, rate, greatest(0.0::DOUBLE, rate - 1.6448536269514722::DOUBLE * sqrt(rate * (1 - rate) / (total + 1))) AS lower FROM bound),
ruled AS (SELECT p.*, rate, lower,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
         WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
         WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
  FROM page p JOIN known USING (host))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN lower > 0.25::DOUBLE THEN 'block' ELSE 'allow' END AS verdict,
  round(rate, 9) AS bad_rate, round(lower, 9) AS bad_rate_lower
FROM ruled
"""
