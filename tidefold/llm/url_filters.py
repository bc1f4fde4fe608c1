"""URL filtering by host reputation, by DataFrame functions alone.

Labelled page outcomes are counted per host. A host's rate of bad pages has a beta
prior around its registered domain's rate, that one around its suffix's, and that
one around the overall rate; how firmly each level holds to the one above is
estimated from the counts (moments of the beta-binomial distribution). A host is
blocked if the lower bound of its posterior rate exceeds a limit, so hosts about
which little is known are let through unless their domain is bad. Explicit rules
come first.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.llm.shared import table, written

RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
#: Suffixes of two labels under which names are registered, for want of the whole public list; callers may give their own.
LONG_SUFFIXES = ["ac.uk", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.au", "com.br", "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk"]
Z, LIMIT = 1.645, 0.5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): both empty without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def matching_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits as (rule, verdict), or null. Rules are a short list held in the plan."""
    fits = []
    for rule, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        own = (host == name) | F.endswith(host, F.lit(f".{name}"))
        fits.append(F.when(own & F.startswith(path, F.lit(slash + rest)), F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _firmness(groups: DataFrame) -> float:
    """How many observations the level above is worth, from counts n, y and the rates m expected from above."""
    v = F.col("m") * (1 - F.col("m"))
    row = groups.agg(
        F.sum(F.round(F.pow(F.col("y") - F.col("n") * F.col("m"), 2) - F.col("n") * v, 6).cast("decimal(30,6)")).alias("extra"),
        F.sum(F.round(F.col("n") * (F.col("n") - 1) * v, 6).cast("decimal(30,6)")).alias("scale"),
    ).first()
    extra, scale = float(row["extra"] or 0), float(row["scale"] or 0)
    rho = min(0.5, max(0.001, extra / scale)) if scale > 0 else 0.1
    return (1 - rho) / rho


def host_reputation(outcomes: DataFrame, z: float = Z, suffixes: list[str] = LONG_SUFFIXES) -> DataFrame:
    """outcomes: (host, bad), bad null where unlabelled. Returns (host, labelled, bad_pages, mean, lower) for every host.

    suffixes: those of two labels; any other suffix is the last label. lower is z standard
    deviations of the posterior below its mean, which stands for its quantile.
    """
    hosts = outcomes.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("y"))
    name = F.regexp_replace("host", r":\d*$", "")
    number = name.rlike(r"^[0-9.]+$|^\[")
    two = F.regexp_extract(name, r"([^.]+\.[^.]+)$", 1)
    suffix = F.when(number, name).when(two.isin(suffixes), two).otherwise(F.regexp_extract(name, r"([^.]*)$", 1))
    labels = F.when(number, name).when(two.isin(suffixes), F.regexp_extract(name, r"([^.]+\.[^.]+\.[^.]+)$", 1)).otherwise(two)
    hosts = written(hosts.select("host", "n", "y", suffix.alias("suffix"), F.when(labels == "", name).otherwise(labels).alias("domain")), "hosts")
    all_ = hosts.agg(F.sum("n").alias("n"), F.sum("y").alias("y")).first()
    top = ((all_["y"] or 0) + 0.5) / ((all_["n"] or 0) + 1)

    def shrunk(level: DataFrame) -> DataFrame:
        s = _firmness(level)
        rate = (F.col("y") + s * F.col("m")) / (F.col("n") + s)
        return level.withColumns({"rate": rate, "weight": F.col("n") + s})

    def counts(*keys: str) -> DataFrame:
        return hosts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("y").alias("y"))

    suffixes = written(shrunk(counts("suffix").withColumn("m", F.lit(top))), "suffixes")
    domains = counts("domain", "suffix").join(suffixes.select("suffix", F.col("rate").alias("m")), "suffix")
    domains = written(shrunk(written(domains, "domains")), "domains")
    rated = hosts.join(domains.select("domain", "suffix", F.col("rate").alias("m")), ["domain", "suffix"])
    rated = shrunk(written(rated, "rated"))
    lower = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("weight") + 1))
    return rated.select("host", F.col("n").alias("labelled"), F.col("y").alias("bad_pages"), F.col("rate").alias("mean"), lower.alias("lower"))


def judge_urls(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", limit: float = LIMIT, suffixes: list[str] = LONG_SUFFIXES) -> DataFrame:
    """(id, host, path, rule, verdict, lower) for every page.

    labels: (doc_id, quality, toxic) of some pages; one is bad if any of its labels
    has quality 0 or toxic 1. Null urls and urls without '://' have an empty host and
    path and are judged by the reputation of the empty host; urls of any length are
    taken whole. Of rules that fit the longest counts, of equally long ones the first by name. Rows without an id have
    no label; repeated rows are all judged and counted. An empty table gives an
    empty table; other columns are not looked at.
    """
    host, path = split_url(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    bad = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(((F.col("quality") == 0) | (F.coalesce("toxic", F.lit(0)) == 1)).cast("int")).alias("bad"))
    outcomes = parsed.select("id", "host").join(bad, "id", "left").select("host", "bad")
    reputation = written(host_reputation(outcomes, suffixes=suffixes).select("host", "lower"), "reputation")
    out = parsed.join(reputation, "host", "left").withColumn("hit", matching_rule(F.col("host"), F.col("path"), rules))
    own = F.when(F.col("lower") > limit, "block").otherwise("allow")
    return out.select("id", "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", own).alias("verdict"), "lower")


def op1(spark, sf_dir: str) -> DataFrame:
    out = judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))
    return out.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def _level(name: str, of: str, keys: str, mean: str, source: str) -> str:
    return f"""
{name}_c AS (SELECT {keys}, sum(n) AS n, sum(y) AS y, {mean} AS m FROM {source} GROUP BY {of}),
{name}_f AS (SELECT sum(CAST(round(pow(y - n * m, 2) - n * m * (1 - m), 6) AS DECIMAL(30, 6))) AS e, sum(CAST(round(n * (n - 1) * m * (1 - m), 6) AS DECIMAL(30, 6))) AS s FROM {name}_c),
{name}_r AS (SELECT (1 - r) / r AS k FROM (SELECT CASE WHEN s > 0 THEN least(0.5, greatest(0.001, CAST(e AS DOUBLE) / CAST(s AS DOUBLE))) ELSE CAST(0.1 AS DOUBLE) END AS r FROM {name}_f)),
{name} AS (SELECT c.*, (y + k * m) / (n + k) AS rate, n + k AS weight FROM {name}_c c, {name}_r)"""


OP1_SQL = (
    r"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(coalesce(rest, ''), length(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1)) + 1), '^([^?#]*)', 1) AS path FROM r),
b AS (SELECT doc_id, max(CASE WHEN quality = 0 OR coalesce(toxic, 0) = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS y FROM p LEFT JOIN b ON page_id = doc_id GROUP BY host),
h1 AS (SELECT *, regexp_replace(host, ':\d*$', '') AS nm FROM h0),
h2 AS (SELECT *, regexp_matches(nm, '^[0-9.]+$|^\[') AS num, regexp_extract(nm, '([^.]+\.[^.]+)$', 1) AS two FROM h1),
h3 AS (SELECT *, two IN ("""
    + ", ".join(f"'{s}'" for s in LONG_SUFFIXES)
    + r""") AS lng FROM h2),
h4 AS (SELECT host, n, y, nm, CASE WHEN num THEN nm WHEN lng THEN two ELSE regexp_extract(nm, '([^.]*)$', 1) END AS suffix,
       CASE WHEN num THEN nm WHEN lng THEN regexp_extract(nm, '([^.]+\.[^.]+\.[^.]+)$', 1) ELSE two END AS dom FROM h3),
hosts AS (SELECT host, n, y, suffix, CASE WHEN dom = '' THEN nm ELSE dom END AS domain FROM h4),
top AS (SELECT (sum(y) + 0.5) / (sum(n) + 1) AS m FROM hosts),"""
    + _level("sfx", "suffix, m", "suffix", "m", "(SELECT hosts.*, CAST(m AS DOUBLE) AS m FROM hosts, top)")
    + ","
    + _level("dmn", "d.domain, d.suffix, s.rate", "d.domain, d.suffix", "s.rate", "(SELECT domain, suffix, n AS n, y AS y FROM hosts) d JOIN (SELECT suffix, rate FROM sfx) s ON d.suffix = s.suffix")
    + ","
    + _level("hst", "h.host, d.rate", "h.host", "d.rate", "hosts h JOIN (SELECT domain, suffix, rate FROM dmn) d ON h.domain = d.domain AND h.suffix = d.suffix")
    + f""",
v AS (SELECT host, CASE WHEN rate - {Z} * sqrt(rate * (1 - rate) / (weight + 1)) > {LIMIT} THEN 'block' ELSE 'allow' END AS own FROM hst),
q AS (SELECT p.*, own,
      CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
           WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
           WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
           WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM p JOIN v USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' ELSE own END AS verdict FROM q
"""
)
