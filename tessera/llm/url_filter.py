"""URL filters: rules first, then empirical-Bayes reputation of hosts.

Labelled page outcomes are counted by host, registered domain (last two labels) and suffix (last label). Each level's
rate is shrunk towards the level above by a beta prior whose strength is the method-of-moments estimate over the
level's groups; a host passes if the lower bound of its posterior (mean less z standard deviations) reaches a floor.
All of it is DataFrame functions; only hosts, one row each, are joined back, with hot hosts broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_join

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path) of the registered query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://`."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(text, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(text, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule, as `host` + `path`, and its verdict; of equal lengths the first listed."""
    name = verdict = F.lit(None).cast("string")
    for said, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def strength(groups: DataFrame) -> DataFrame:
    """(kappa) from groups (k of n): m(1-m) over the rates' variance beyond chance, less one, held in 1 to 1000."""
    m = F.sum("k") / F.sum("n")
    s = groups.agg(m.alias("m"), F.sum("n").alias("t"), F.count("*").alias("g"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("q"))
    pq = F.col("m") * (1 - F.col("m"))
    between = F.greatest((F.col("q") / F.col("t") - F.col("m") * F.col("m")) - pq * F.col("g") / F.col("t"), F.lit(0.0))
    return s.select(F.when(F.col("t") > 0, F.greatest(F.lit(1.0), F.least(F.lit(1000.0), F.coalesce(F.when(between > 0, pq / between - 1), F.lit(1000.0))))).otherwise(F.lit(1000.0)).alias("kappa"))


def reputation(hosts: DataFrame, z: float = 1.645) -> DataFrame:
    """hosts (host, pages, n labelled, k good), one row each, with `bound`, the posterior's lower bound."""
    spark = hosts.sparkSession
    label = F.split("host", r"\.")
    h = hosts.withColumn("suffix", F.element_at(label, -1)).withColumn("domain", F.when(F.size(label) > 1, F.concat_ws(".", F.element_at(label, -2), F.element_at(label, -1))).otherwise(F.col("host")))
    seen = h.where("n > 0")
    total = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k")).first()
    kappa = {}
    for level in ("suffix", "domain", "host"):
        kappa[level] = strength(seen.groupBy(level).agg(F.sum("n").alias("n"), F.sum("k").alias("k"))).first().kappa
    base = (total.k + 1) / (total.n + 2)
    counts = lambda level, to: h.groupBy(level).agg(F.sum("n").alias(f"n_{to}"), F.sum("k").alias(f"k_{to}"))
    # hosts of one suffix are many: suffixes and domains are few rows beside them, AQE splits what is left uneven
    h = h.join(counts("domain", "d"), "domain").join(counts("suffix", "s"), "suffix")
    up = (F.col("k_s") + kappa["suffix"] * base) / (F.col("n_s") + kappa["suffix"])
    mid = (F.col("k_d") + kappa["domain"] * up) / (F.col("n_d") + kappa["domain"])
    a = F.col("k") + kappa["host"] * mid
    t = F.col("n") + F.lit(kappa["host"])
    mean = a / t
    return h.select("host", "pages", (mean - z * F.sqrt(mean * (1 - mean) / (t + 1))).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", floor: float = 0.7, z: float = 1.645) -> DataFrame:
    """(page_id, host, path, rule, verdict), one row for each row of pages.

    outcomes: (page_id, good), good 1 or 0; rows with a null in either are left out, several of a page count each.
    Null addresses and those without `://` have an empty host and path and are judged as that host; null ids keep
    their row but have no outcome; other columns are ignored; an empty table gives no rows.
    """
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    good = outcomes.where(F.col("page_id").isNotNull() & F.col("good").isNotNull()).groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("k"))
    hosts = (
        rows.select("page_id", "host").join(good, "page_id", "left").groupBy("host")
        .agg(F.count("*").alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("k"), F.lit(0)).alias("k"))
    )
    known = reputation(hosts, z)
    judged = hot_join(rows, known, "host", "pages", rows.count())
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bound") >= floor, F.lit("allow")).otherwise(F.lit("block"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"))


def sql(rules: list[tuple[str, str, str]] = RULES, floor: float = 0.7, z: float = 1.645) -> str:
    """The registered query in DuckDB's SQL, with quality labels as outcomes."""
    case = "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in sorted(enumerate(rules), key=lambda x: -len(x[1][1] + x[1][2]))) + " END"
    name, said = (case.format(*x) for x in ([h + p for _, h, p in rules], [v for v, _, _ in rules]))
    kappa = lambda level: f"(SELECT greatest(1.0, least(1000.0, coalesce(CASE WHEN b > 0 THEN m * (1 - m) / b - 1 END, 1000.0))) FROM (SELECT m, greatest(q / t - m * m - m * (1 - m) * g / t, 0.0) AS b FROM (SELECT sum(k) / sum(n) AS m, sum(n) AS t, count(*) AS g, sum(k * k / n) AS q FROM (SELECT sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM h WHERE n > 0 GROUP BY {level}))))"
    return f"""
WITH r AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)\\A.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '(?s)\\A.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
g AS (SELECT doc_id AS page_id, count(*) AS n, sum(quality) AS k FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY 1),
h AS (SELECT host, list_extract(string_split(host, '.'), -1) AS suffix,
             CASE WHEN contains(host, '.') THEN list_extract(string_split(host, '.'), -2) || '.' || list_extract(string_split(host, '.'), -1) ELSE host END AS domain,
             coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k FROM r LEFT JOIN g USING (page_id) GROUP BY 1),
c AS (SELECT {kappa('suffix')} AS ks, {kappa('domain')} AS kd, {kappa('host')} AS kh, (sum(k) + 1) / (sum(n) + 2) AS base FROM h),
d AS (SELECT domain, sum(n) AS n_d, sum(k) AS k_d FROM h GROUP BY 1), s AS (SELECT suffix, sum(n) AS n_s, sum(k) AS k_s FROM h GROUP BY 1),
m AS (SELECT host, n + kh AS t, (k + kh * (k_d + kd * (k_s + ks * base) / (n_s + ks)) / (n_d + kd)) / (n + kh) AS mean FROM h JOIN d USING (domain) JOIN s USING (suffix) CROSS JOIN c)
SELECT page_id, host, path, {name} AS rule, coalesce({said}, CASE WHEN mean - {z} * sqrt(mean * (1 - mean) / (t + 1)) >= {floor} THEN 'allow' ELSE 'block' END) AS verdict
FROM r JOIN m USING (host)"""
