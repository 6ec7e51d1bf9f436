"""Host reputation by empirical Bayes, under URL rules; built-in functions only.

Labelled page outcomes are counted per host. A beta prior is fitted to the spread of hosts at
each level by the method of moments, and the estimate is shrunk from the whole table to the
public suffix, from there to the registered domain, and from there to the host. A host is blocked
when even the upper bound of its posterior of good pages is below the wanted share. Rules
override the estimate.
"""

from pyspark.sql import DataFrame, functions as F

from driftgate.llm.common import text_or_empty
from driftgate.session import materialize

# (rule, verdict); a rule is a host and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"),
         ("org/fr/", "allow"))
MIN_GOOD = 0.5
Z = 1.645
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1000.0
_LEVELS = ("all", "suffix", "domain", "host")


def url_parts(url="url"):
    """(host, path): both empty for null or a text without `://`. The host keeps a port."""
    rest = F.regexp_extract(text_or_empty(url), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1),
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def domain_levels(host="host"):
    """(suffix, domain): the last label and the last two; a port is not part of either."""
    labels = F.split(F.regexp_replace(F.col(host), r":\d*$", ""), r"\.")
    return (F.element_at(labels, -1), F.array_join(F.slice(
        labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), "."))


def fitting_rule(rules=RULES, host="host", path="path"):
    """(rule, verdict) of the longest rule that fits, or nulls. Rules are a parameter of the
    call, tried in order of length."""
    rule = verdict = F.lit(None).cast("string")
    for text, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        rule_host, slash, rest = text.partition("/")
        fits = ((F.col(host) == rule_host) | F.col(host).endswith("." + rule_host)) & \
            F.col(path).startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def host_reputation(outcomes: DataFrame, min_good=MIN_GOOD, z=Z) -> DataFrame:
    """One row per host of `outcomes` (host, good: 0, 1 or null): pages, labelled, good_pages,
    mean, upper, verdict. Hosts without labels get their domain's estimate.

    Pages are counted per host before anything is exchanged, so a host with most pages costs no
    more than another. The three tables of levels are counts, not pages.
    """
    suffix, domain = domain_levels()
    hosts = materialize(
        outcomes.groupBy("host").agg(
            F.count("*").alias("pages"), F.count("good").alias("n"),
            F.coalesce(F.sum("good"), F.lit(0)).cast("long").alias("k"))
        .withColumns({"suffix": suffix, "domain": domain, "all": F.lit("")}), "hosts")
    counts = {level: hosts.groupBy(*[f"`{x}`" for x in _LEVELS[:i + 1]]).agg(
        F.sum("n").alias("n"), F.sum("k").alias("k")) for i, level in enumerate(_LEVELS)}
    at = counts["all"].withColumn("mean", (F.col("k") + 1) / (F.col("n") + 2)).withColumn(
        "strength", F.lit(MIN_STRENGTH))
    for above, level in zip(_LEVELS, _LEVELS[1:]):
        keys = [f"`{x}`" for x in _LEVELS[:_LEVELS.index(level)]]
        names = [k.strip("`") for k in keys]
        prior = at.select(*keys, F.col("mean").alias("p"))
        joined = counts[level].join(prior, names)
        spread = joined.groupBy(*keys).agg(
            F.sum("n").alias("_n"), F.sum((F.col("n") * F.col("n")).cast("long")).alias("_nn"),
            F.count(F.when(F.col("n") > 0, 1)).alias("_g"),
            F.sum(F.when(F.col("n") > 0, (F.col("k") - F.col("n") * F.col("p"))
                         * (F.col("k") - F.col("n") * F.col("p")) / F.col("n")))
            .alias("_s"), F.max("p").alias("_p"))
        # Method of moments: between-group variance from the weighted squared deviations.
        noise = F.col("_p") * (1 - F.col("_p"))
        share = F.col("_n") - F.col("_nn") / F.nullif(F.col("_n"), F.lit(0))
        between = (F.col("_s") - F.col("_g") * noise) / F.nullif(share, F.lit(0.0))
        fitted = F.when(between > 0, noise / between - 1)
        strength = F.round(F.least(F.lit(MAX_STRENGTH), F.greatest(
            F.lit(MIN_STRENGTH), F.coalesce(fitted, F.lit(MAX_STRENGTH)))), 6)
        strengths = spread.select(*keys, strength.alias("strength"))
        at = joined.join(strengths, names).withColumn(
            "mean", (F.col("k") + F.col("strength") * F.col("p"))
            / (F.col("n") + F.col("strength")))
    a = F.col("n") + F.col("strength")
    upper = F.least(F.lit(1.0), F.col("mean") + z * F.sqrt(
        F.col("mean") * (1 - F.col("mean")) / (a + 1)))
    return materialize(
        at.join(hosts.select("host", "pages"), "host")
        .select("host", "pages", F.col("n").alias("labelled"), F.col("k").alias("good_pages"),
                "mean", upper.alias("upper"),
                F.when(F.round(upper, 9) < min_good, "block").otherwise("allow")
                .alias("verdict")), "host-reputation")


def filter_urls(pages: DataFrame, outcomes: DataFrame, rules=RULES, id_col="page_id",
                url_col="url", min_good=MIN_GOOD, z=Z) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, and the host's mean and upper bound.

    `outcomes` has one row per labelled page: the id, and good as 0, 1 or null. A page with
    several outcomes counts with each. Null urls and urls without `://` have an empty host, which
    is judged like any other.
    """
    host, path = url_parts("_url")
    parsed = (pages.select(F.col(id_col), F.col(url_col).alias("_url"))
              .withColumns({"host": host, "path": path}).drop("_url"))
    labelled = outcomes.select(F.col(id_col), F.col("good"))
    reputation = host_reputation(
        parsed.select(id_col, "host").join(labelled, id_col, "left"), min_good, z)
    rule, said = fitting_rule(rules)
    judged = parsed.join(reputation.select(
        "host", "mean", "upper", F.col("verdict").alias("_own")), "host", "left")
    return judged.select(
        id_col, "host", "path", rule.alias("rule"),
        F.coalesce(said, F.col("_own"), F.lit("allow")).alias("verdict"), "mean", "upper")


SQL = r"""
WITH parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0
               THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
outcomes AS (SELECT doc_id AS page_id, CASE WHEN quality = 1 AND toxic = 0 THEN 1
                    WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END AS good
             FROM labels),
hosts AS (
  SELECT host, count(good) AS n, coalesce(sum(good), 0) AS k,
         regexp_replace(host, ':\d*$', '') AS bare
  FROM parsed LEFT JOIN outcomes USING (page_id) GROUP BY host),
level3 AS (
  SELECT host, n, k, string_split(bare, '.')[-1] AS suffix,
         array_to_string(string_split(bare, '.')[-2:], '.') AS domain FROM hosts),
level0 AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS mean FROM level3),
s1 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, (SELECT mean FROM level0) AS p
       FROM level3 GROUP BY suffix),
t1 AS (SELECT {strength} AS strength FROM s1),
m1 AS (SELECT suffix, (k + strength * p) / (n + strength) AS mean FROM s1, t1),
s2 AS (SELECT l.suffix, domain, sum(n) AS n, sum(k) AS k, max(mean) AS p
       FROM level3 l JOIN m1 ON l.suffix = m1.suffix GROUP BY l.suffix, domain),
t2 AS (SELECT suffix, {strength} AS strength FROM s2 GROUP BY suffix),
m2 AS (SELECT s2.suffix, domain, (k + strength * p) / (n + strength) AS mean
       FROM s2 JOIN t2 ON s2.suffix = t2.suffix),
s3 AS (SELECT l.suffix, l.domain, host, n, k, mean AS p
       FROM level3 l JOIN m2 ON l.suffix = m2.suffix AND l.domain = m2.domain),
t3 AS (SELECT suffix, domain, {strength} AS strength FROM s3 GROUP BY suffix, domain),
m3 AS (SELECT host, n + strength AS a, (k + strength * p) / (n + strength) AS mean
       FROM s3 JOIN t3 ON s3.suffix = t3.suffix AND s3.domain = t3.domain),
own AS (SELECT host, CASE WHEN round(least(1, mean + {z} * sqrt(mean * (1 - mean) / (a + 1))), 9)
                          < {min_good} THEN 'block' ELSE 'allow' END AS verdict FROM m3)
SELECT page_id, host, path, rule, CASE rule WHEN 'net/' THEN 'block'
         WHEN 'example.net/en/' THEN 'allow' WHEN 'example.com/de/' THEN 'block'
         WHEN 'org/fr/' THEN 'allow' ELSE verdict END AS verdict
FROM (SELECT p.page_id, p.host, p.path, verdict, CASE
        WHEN '.' || p.host LIKE '%.example.net' AND path LIKE '/en/%' THEN 'example.net/en/'
        WHEN '.' || p.host LIKE '%.example.com' AND path LIKE '/de/%' THEN 'example.com/de/'
        WHEN '.' || p.host LIKE '%.org' AND path LIKE '/fr/%' THEN 'org/fr/'
        WHEN '.' || p.host LIKE '%.net' AND path LIKE '/%' THEN 'net/' END AS rule
      FROM parsed p JOIN own ON p.host = own.host)""".replace("{strength}", """round(least(1000.0, greatest(2.0,
    coalesce(CASE WHEN (sum(CASE WHEN n > 0 THEN (k - n * p) * (k - n * p) / n END)
      - count(CASE WHEN n > 0 THEN 1 END) * max(p) * (1 - max(p)))
      / nullif(sum(n) - sum(n * n) / nullif(sum(n), 0), 0) > 0
    THEN max(p) * (1 - max(p)) / ((sum(CASE WHEN n > 0 THEN (k - n * p) * (k - n * p) / n END)
      - count(CASE WHEN n > 0 THEN 1 END) * max(p) * (1 - max(p)))
      / nullif(sum(n) - sum(n * n) / nullif(sum(n), 0), 0)) - 1 END, 1000.0))), 6)""").replace(
    "{z}", str(Z)).replace("{min_good}", str(MIN_GOOD))
