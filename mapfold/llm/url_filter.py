"""URL filter: rules on host and path, and trust that spreads over the links between hosts.

A url that a rule fits takes the longest fitting rule's verdict. For the rest the host decides: trust starts at
the hosts whose pages the rules allow and follows the links (personalised PageRank); distrust starts at the hosts
whose pages the rules block and follows the links backwards, to those that link there. A host whose distrust is
more than `ratio` times its trust is blocked. Only DataFrame operations are used.

Null urls and urls without :// have an empty host and path, and are allowed. Links come from href targets in the
html that name a host, with or without a scheme (a <base> counts as one link to its host); null html has none. Of
rules equally long the last one given wins. Repeated rows are judged alike. Very long urls and pages are read whole.
Empty tables give empty results. Extra columns are kept; host, path, rule and verdict are replaced, and names that begin with
two underscores are the operator's own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
HREF = r"""(?i)href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]*)"""
#: The ranks are settled when the rounds since the last cut change no more than this part of all mass.
TOLERANCE = 1e-9
#: The rules of the query: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Longer lists of rules are joined by host rather than written into one expression.
INLINE_RULES = 500


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest fitting rule as struct(rule, verdict), or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffixes(host: Column) -> Column:
    """A host and the domains it is in: a.b.c, b.c and c."""
    labels = F.split(host, r"\.")
    return F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels) - i), "."))


def with_rules(df: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """df (host, path, ...) with __rule: the longest fitting rule, or null.

    Many rules, or rules in a DataFrame (host, path, verdict), meet the distinct hosts and paths by an equi-join on
    the host's domains. A domain that many urls are in is a hot key; Spark broadcasts few rules and splits others.
    """
    if not isinstance(rules, DataFrame) and len(rules) <= INLINE_RULES:
        return df.withColumn("__rule", rule_of(F.col("host"), F.col("path"), rules))
    if not isinstance(rules, DataFrame):
        numbered = [(h, p, v, i) for i, (h, p, v) in enumerate(rules)]
        rules = df.sparkSession.createDataFrame(numbered, "host string, path string, verdict string, turn long")
    turn = F.col("turn") if "turn" in rules.columns else F.xxhash64("host", "path", "verdict")
    held = rules.select(F.col("host").alias("__domain"), F.col("path").alias("__start"), F.col("verdict").alias("__says"), turn.alias("__turn"))
    own = df.select("host", "path").distinct()
    fits = own.withColumn("__domain", F.explode(suffixes(F.col("host")))).join(held, "__domain").where(F.col("path").startswith(F.col("__start")))
    rule = F.struct(F.concat("__domain", "__start").alias("rule"), F.col("__says").alias("verdict"))
    best = fits.groupBy(F.col("host").alias("__h"), F.col("path").alias("__p")).agg(F.max_by(rule, F.struct(F.length("__domain") + F.length("__start"), "__turn")).alias("__rule"))
    return df.join(best, (F.col("host") == F.col("__h")) & (F.col("path") == F.col("__p")), "left").drop("__h", "__p")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = TOLERANCE, cut_every: int = 4) -> DataFrame:
    """Personalised PageRank: (host, mass) over weighted edges (src, dst, n) from seeds (host, seed), which sum to 1.

    Each round joins the ranks with the out-shares by src and sums by dst, with partial sums before the shuffle.
    Every cut_every rounds the ranks are written, and the rounds end once these changed masses by at most `tolerance`
    in sum; what a round changes shrinks by the damping at least, so they do end.
    Mass of hosts without links starts again at the seeds. That is the same as to drop it and scale the result to a sum
    of 1, as is done here: both solve the same equation up to a factor. Hosts without mass are absent.
    """
    total = edges.groupBy("src").agg(F.sum("n").alias("total"))
    shares = materialize(edges.join(total, "src").select("src", "dst", (F.col("n") / F.col("total")).alias("share")), "shares")
    rank = seeds.select("host", F.col("seed").alias("mass"))
    if shares.isEmpty():
        return rank
    base, written = seeds.select("host", (F.col("seed") * (1 - damping)).alias("part")), None
    while True:
        held = rank.select("host", F.lit(0.0).alias("mass"), F.col("mass").alias("old"))
        for _ in range(cut_every):
            moved = shares.join(rank, shares["src"] == rank["host"]).select(F.col("dst").alias("host"), (F.col("mass") * F.col("share") * damping).alias("part"))
            rank = moved.unionByName(base).groupBy("host").agg(F.sum("part").alias("mass"))
        rank = materialize(rank, "rank")
        both = rank.withColumn("old", F.lit(0.0)).unionByName(held).groupBy("host").agg(F.sum("mass").alias("mass"), F.sum("old").alias("old"))
        change = both.agg(F.sum(F.abs(F.col("mass") - F.col("old")))).first()[0] or 0.0
        if written is not None:
            discard(written)
        written = rank
        if change <= tolerance:
            total = rank.agg(F.sum("mass")).first()[0] or 1.0
            return rank.select("host", (F.col("mass") / F.lit(total)).alias("mass"))


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): how often pages of one host link to another host."""
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all(F.col("html"), F.lit(HREF), F.lit(1))).alias("link"))
    whole = F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link"))
    links = links.select("src", host_of(whole).alias("dst")).where("src <> '' and dst <> '' and src <> dst")
    return links.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def host_scores(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(host, trust, distrust) of every host with either; seeds weigh as many pages as rules allow or block there."""
    judged = pages.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = with_rules(judged, rules).select("host", F.col("__rule.verdict").alias("verdict")).where("verdict is not null")
    counts = materialize(ruled.groupBy("host").agg(F.count_if(F.col("verdict") == "allow").alias("allow"), F.count_if(F.col("verdict") == "block").alias("block")), "seeds")
    sums = counts.agg(F.sum("allow"), F.sum("block")).first()
    edges = materialize(host_links(pages) if edges is None else edges, "links")

    def seeds(column: str, total: int | None) -> DataFrame:
        return counts.where(F.col(column) > 0).select("host", (F.col(column) / F.lit(float(total or 1))).alias("seed"))

    trust = propagate(edges, seeds("allow", sums[0])).withColumnRenamed("mass", "trust")
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    distrust = propagate(back, seeds("block", sums[1])).withColumnRenamed("mass", "distrust")
    return trust.join(distrust, "host", "full").na.fill(0.0, ["trust", "distrust"])


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] | DataFrame = RULES, ratio: float = 1.0, edges: DataFrame | None = None) -> DataFrame:
    """pages with host, path, rule and verdict; the hosts' scores are a table of one row per host."""
    hosts = materialize(host_scores(pages, rules, edges).where(F.col("distrust") > F.lit(ratio) * F.col("trust")).select(F.col("host").alias("__bad")), "bad-hosts")
    out = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    out = with_rules(out, rules).join(hosts, F.col("host") == F.col("__bad"), "left")
    verdict = F.coalesce(F.col("__rule.verdict"), F.when(F.col("__bad").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.withColumns({"rule": F.col("__rule.rule"), "verdict": verdict}).drop("__rule", "__bad")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


#: Rounds of the SQL, which can't stop by itself.
SQL_ROUNDS = 24


def _sql() -> str:
    host, path = "regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1)", "regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    lower = lambda u: f"translate({host.format(u=u)}, '{UPPER}', '{LOWER}')"
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN {{{i}}}" for i, (h, p, _) in enumerate(sorted(RULES, key=lambda r: -len(r[0] + r[1]))))
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = "CASE " + fits.format(*[f"'{h}{p}'" for h, p, _ in ordered]) + " END"
    verdict = "CASE " + fits.format(*[f"'{v}'" for *_, v in ordered]) + " END"
    href = r"href\s*=\s*[\x22\x27]?((?:[a-z][a-z0-9+.-]*:)?//[^\x22\x27\s>]*)"
    parts = [
        f"p AS (SELECT page_id, html, {lower('url')} AS host, {path} AS path FROM pages)",
        f"j AS (SELECT page_id, host, path, {rule} AS rule, {verdict} AS ruled FROM p)",
        f"l AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {lower("CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '{href}', 1, 'i')) AS link FROM p)) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL)",
    ]
    for kind, src, dst in (("allow", "src", "dst"), ("block", "dst", "src")):
        parts.append(f"s_{kind} AS (SELECT host, count(*) / (SELECT count(*) FROM j WHERE ruled = '{kind}') AS seed FROM j WHERE ruled = '{kind}' GROUP BY host)")
        parts.append(f"e_{kind} AS (SELECT {src} AS a, {dst} AS b, n / sum(n) OVER (PARTITION BY {src}) AS share FROM l)")
        parts.append(f"r_{kind}_0 AS (SELECT host, seed AS mass FROM s_{kind})")
        for i in range(1, SQL_ROUNDS + 1):
            parts.append(f"r_{kind}_{i} AS (SELECT host, sum(part) AS mass FROM (SELECT b AS host, mass * share * 0.85 AS part FROM e_{kind} JOIN r_{kind}_{i - 1} ON a = host UNION ALL SELECT host, seed * 0.15 FROM s_{kind}) GROUP BY host)")
        parts.append(f"m_{kind} AS (SELECT host, mass / (SELECT sum(mass) FROM r_{kind}_{SQL_ROUNDS}) AS mass FROM r_{kind}_{SQL_ROUNDS})")
    return "WITH " + ",\n".join(parts) + "\nSELECT j.page_id, j.host, j.path, j.rule, coalesce(ruled, CASE WHEN coalesce(d.mass, 0) > coalesce(t.mass, 0) THEN 'block' ELSE 'allow' END) AS verdict FROM j LEFT JOIN m_allow t ON j.host = t.host LEFT JOIN m_block d ON j.host = d.host"


OP9_SQL = _sql()
