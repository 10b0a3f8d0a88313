"""URL filter by empirical-Bayes host reputation, under a list of rules.

Labelled page outcomes (bad or not) are counted per host and shrunk level by
level: the whole -> public suffix -> registered domain -> host.  Each level's
rate is the mean of a beta posterior whose prior has the level above as mean
and a strength fitted by the method of moments (Kleinman's estimator of the
beta-binomial's intra-class correlation).  A host is blocked when the lower
bound of its posterior bad rate is over the limit; the bound is the normal
approximation, mean less Z standard deviations of the beta posterior.  Rules come
before that.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path)
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]

#: Suffixes of two labels under which names are registered.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "org.uk")

MAX_BAD_RATE = 0.5
Z = 1.645
RHO_BOUNDS = (1e-4, 0.9)


def url_parts(url):
    """(host, path) columns; both empty for null or a url without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"://([^/?#]*)", 1), common.UPPER, common.LOWER)
    return host, F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1)


def rule_column(host, path, rules=RULES):
    """Struct (verdict, rule) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(h + p).alias("rule"))).otherwise(out)
    return out


def with_domains(hosts: DataFrame, suffixes: DataFrame | None = None) -> DataFrame:
    """Adds ``suffix`` and ``domain`` (registered domain) to rows of distinct ``host``.

    ``suffixes`` has a column suffix, of any number of labels: the longest that a
    host ends with counts.  Without it, and for hosts that end with none, a suffix
    is the last label, or one of TWO_LABEL_SUFFIXES.
    """
    labels = F.split("host", r"\.")
    two = F.substring_index("host", ".", -2)
    is_two = two.isin(*TWO_LABEL_SUFFIXES)
    suffix = F.when(is_two, two).otherwise(F.substring_index("host", ".", -1))
    domain = F.when(is_two & (F.size(labels) > 2), F.substring_index("host", ".", -3)).otherwise(two)
    if suffixes is None:
        return hosts.withColumn("suffix", suffix).withColumn("domain", domain)
    tails = hosts.select("host", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("at", "tail"))
    found = tails.join(suffixes.select(F.col("suffix").alias("tail")).distinct(), "tail").groupBy("host").agg(F.min("at").alias("at"))
    out = hosts.join(found, "host", "left").withColumn("known", F.col("at").isNotNull())
    tail = lambda i: F.array_join(F.slice(labels, F.greatest(F.lit(1), i), F.size(labels)), ".")
    return out.withColumn("suffix", F.when(F.col("known"), tail(F.col("at") + 1)).otherwise(suffix)).withColumn("domain", F.when(F.col("known"), tail(F.col("at"))).otherwise(domain)).drop("at", "known")


def _strength(groups: DataFrame) -> tuple[float, float]:
    """(overall rate, prior strength) from per-group counts n and bad: one row."""
    r = groups.agg(
        F.sum("n").alias("w"), F.sum("bad").alias("b"), F.sum(F.col("n") * F.col("n")).alias("q"), F.sum(F.col("bad") * F.col("bad") / F.col("n")).alias("s"), F.count("*").alias("g")
    ).first()
    w, g = float(r["w"] or 0), r["g"]
    mean = (r["b"] or 0) / w if w else 0.0
    spread, inner = (r["s"] or 0.0) - w * mean * mean, mean * (1 - mean)
    free = w - (r["q"] or 0) / w - (g - 1) if w else 0.0
    rho = (spread - inner * (g - 1)) / (inner * free) if inner > 0 and free > 0 else RHO_BOUNDS[0]
    rho = min(max(rho, RHO_BOUNDS[0]), RHO_BOUNDS[1])
    return mean, 1 / rho - 1


def reputation(outcomes: DataFrame, z: float = Z, suffix_table: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
    """Posterior tables (host), (domain), (suffix) from (host, bad 0/1) rows.

    Each has its key, ``rate`` and ``low``, the posterior mean and lower
    bound.  Rows with a null outcome don't count.  The dict has the overall
    mean and the three prior strengths: four numbers are all that the driver
    gets.
    """
    counted = outcomes.filter(F.col("bad").isNotNull()).groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("long")).alias("bad"))
    hosts = common.stash(with_domains(counted, suffix_table), "hosts")
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains, suffixes = hosts.groupBy("domain", "suffix").agg(*sums), hosts.groupBy("suffix").agg(*sums)
    mean, k_suffix = _strength(suffixes)
    (_, k_domain), (_, k_host) = _strength(domains), _strength(hosts)

    def post(df, prior, k):
        a, n = F.col("bad") + prior * k, F.col("n") + F.lit(float(k))
        rate = a / n
        return df.withColumn("rate", rate).withColumn("low", F.greatest(F.lit(0.0), rate - z * F.sqrt(rate * (1 - rate) / (n + 1))))

    suffixes = post(suffixes, F.lit(mean), k_suffix).select("suffix", "rate", "low")
    domains = post(domains.join(suffixes.select("suffix", F.col("rate").alias("above")), "suffix"), F.col("above"), k_domain).select("domain", "rate", "low")
    hosts = post(hosts.join(domains.select("domain", F.col("rate").alias("above")), "domain"), F.col("above"), k_host).select("host", "rate", "low")
    return hosts, domains, suffixes, {"mean": mean, "suffix": k_suffix, "domain": k_domain, "host": k_host}


def judge(pages: DataFrame, outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, limit: float = MAX_BAD_RATE, suffix_table: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    ``outcomes`` is (host, bad).  A host without outcomes is judged by its
    domain, then its suffix; without any, it is allowed, as it is when no
    outcomes exist at all.  Null urls have empty host and path.  Repeated rows
    are judged alike, null ids are kept; other columns of ``pages`` are ignored; an
    empty table gives an empty result.  ``suffix_table`` as in ``with_domains``.
    """
    hosts, domains, suffixes, _ = reputation(outcomes, suffix_table=suffix_table)
    host, path = url_parts(F.col("url"))
    rows = common.clean_names(pages, {"page_id": id_col, "url": url_col}).select("page_id", host.alias("host"), path.alias("path"))
    rows = common.stash(rows, "urls")
    total = rows.count()
    # one lookup per distinct host, then one verdict per host: pages meet only that
    seen = with_domains(rows.groupBy("host").agg(F.count("*").alias("n_rows")), suffix_table)
    look = (
        seen.join(hosts.select("host", F.col("low").alias("l1")), "host", "left")
        .join(domains.select("domain", F.col("low").alias("l2")), "domain", "left")
        .join(suffixes.select("suffix", F.col("low").alias("l3")), "suffix", "left")
        .select("host", "n_rows", F.coalesce("l1", "l2", "l3", F.lit(0.0)).alias("low"))
    )
    judged = common.join_groups(rows, common.stash(look, "verdicts"), ["host"], "n_rows", total)
    rule = rule_column(F.col("host"), F.col("path"), rules)
    return judged.select(
        "page_id", "host", "path", rule["rule"].alias("rule"), F.coalesce(rule["verdict"], F.when(F.col("low") > limit, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict")
    )


def op7_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a page is bad if the label of its number is low quality or toxic."""
    pages = common.table(spark, sf_dir, "pages")
    labels = common.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    host, _ = url_parts(F.col("url"))
    return judge(pages, pages.select("page_id", host.alias("host")).join(labels, "page_id").select("host", "bad"))


_TWO = ", ".join(f"'{s}'" for s in TWO_LABEL_SUFFIXES)
_LEVEL = """
{name}_m AS (SELECT CAST(sum(bad) AS DOUBLE) / sum(n) AS mean, CAST(sum(n) AS DOUBLE) AS w, CAST(sum(n * n) AS DOUBLE) AS q, sum(CAST(bad * bad AS DOUBLE) / n) AS s, count(*) AS g FROM {name}_c),
{name}_k AS (SELECT mean, 1 / least(greatest(CASE WHEN mean * (1 - mean) > 0 AND w - q / w - (g - 1) > 0 THEN (s - w * mean * mean - mean * (1 - mean) * (g - 1)) / (mean * (1 - mean) * (w - q / w - (g - 1))) ELSE {lo} END, {lo}), {hi}) - 1 AS k FROM {name}_m),
{name}_p AS (SELECT {key}, n, (bad + {prior} * k) / (n + k) AS rate, k FROM {name}_c {join} CROSS JOIN {name}_k),
{name} AS (SELECT {key}, rate, greatest(0.0, rate - {z} * sqrt(rate * (1 - rate) / (n + k + 1))) AS low FROM {name}_p)"""


def _level(name, key, prior, join):
    return _LEVEL.format(name=name, key=key, prior=prior, join=join, lo=RHO_BOUNDS[0], hi=RHO_BOUNDS[1], z=Z)


def _sql() -> str:
    rule = lambda what: "CASE " + " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{v if what == 'verdict' else h + p}'"
        for v, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r))
    )
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{common.UPPER}', '{common.LOWER}') AS host,
                  regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
d AS (SELECT *, array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') AS two, len(string_split(host, '.')) AS k FROM u),
r AS (SELECT page_id, host, path, CASE WHEN two IN ({_TWO}) THEN two ELSE list_extract(string_split(host, '.'), -1) END AS suffix,
             CASE WHEN two IN ({_TWO}) AND k > 2 THEN array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') ELSE two END AS domain FROM d),
hosts_c AS (SELECT host, domain, suffix, count(*) AS n, sum(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad
            FROM r JOIN labels ON doc_id = page_id WHERE ((quality = 0) OR (toxic = 1)) IS NOT NULL GROUP BY ALL),
domains_c AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts_c GROUP BY ALL),
suffixes_c AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts_c GROUP BY ALL),
{_level("suffixes", "suffixes_c.suffix", "mean", "")},
{_level("domains", "domains_c.domain", "s.rate", "JOIN suffixes s USING (suffix)").replace("SELECT domains_c.domain, rate", "SELECT domain, rate")},
{_level("hosts", "hosts_c.host", "d.rate", "JOIN domains d USING (domain)").replace("SELECT hosts_c.host, rate", "SELECT host, rate")}
SELECT page_id, host, path, {rule("rule")} END AS rule,
       {rule("verdict")} WHEN coalesce(hosts.low, domains.low, suffixes.low, 0.0) > {MAX_BAD_RATE} THEN 'block' ELSE 'allow' END AS verdict
FROM r LEFT JOIN hosts USING (host) LEFT JOIN domains USING (domain) LEFT JOIN suffixes USING (suffix)
"""


OP7_SQL = _sql().replace("SELECT suffixes_c.suffix, rate", "SELECT suffix, rate")
