"""Line deduplication by distinct-site spread.

Lines that many sites carry are boilerplate. Each distinct line (trimmed, not blank) gets a HyperLogLog sketch of
the sites it stands on; sketches merge by aggregation. Lines whose estimate is clearly over or under the
threshold are settled by it; those near it get an exact distinct count.

A document's copies on many sites prove nothing about its lines, so copies count once: a text stands for its smallest
site, however many carry it. Lines that are under the threshold on all their sites are under it with fewer, so a first sketch
over all rows leaves few lines, and only their texts are looked up. A line that is boilerplate goes from every text, whatever
else the text holds; a text of nothing else is left empty. Only DataFrame operations are used.

Nulls: a null site is a site of its own; a null text has no lines and stays null. Blank lines are never removed.
Repeated rows are treated alike. Very long texts and lines are hashed in their task; what is shuffled of them but once
are hashes and positions. Ties don't arise. An empty table gives an empty result. Extra columns are kept, whatever their names; n_lines and n_removed are
replaced, and names that begin with two underscores are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, pair_hash, table

#: Sites from which a line is boilerplate; log2 of the sketch's registers; relative margin of the near-threshold band (4 standard errors of 1.04 / sqrt(2^10)).
SITES, LG_REGISTERS, BAND = 5, 10, 0.13


def trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def lines_of(text: Column) -> Column:
    return F.split(text, "\n")


def spread(stands: DataFrame, sites: int, lg: int) -> DataFrame:
    """(h1, h2, about): the estimated number of sites of lines that at least `sites` rows of (h1, h2, site) have."""
    found = stands.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.hll_sketch_agg("site", lg).alias("sketch")).where(F.col("n") >= sites)
    return found.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("about"))


def boilerplate(documents: DataFrame, site: str = "source", sites: int = SITES, lg: int = LG_REGISTERS, band: float = BAND) -> DataFrame:
    """(h1, h2): hashes of the trimmed lines that stand on at least `sites` distinct sites, a text standing on its smallest."""
    own = F.coalesce(F.col(site), F.lit("\x00none")).alias("site")
    texts = [h.alias(f"t{i}") for i, h in enumerate(pair_hash(F.coalesce("text", F.lit(""))), 1)]
    each = documents.select(own, *texts, F.explode(F.array_distinct(F.transform(lines_of(F.col("text")), trimmed))).alias("line")).where("line <> ''")
    each = each.select("site", "t1", "t2", *[h.alias(f"h{i}") for i, h in enumerate(pair_hash(F.col("line")), 1)])
    # tables of their own: joins with a hot line or text get an exchange on either side that Spark can split
    wide = materialize(spread(each, sites, lg).where(F.col("about") >= int(sites * (1 - band))).select("h1", "h2"), "wide")
    homes = materialize(documents.select(own, *texts).groupBy("t1", "t2").agg(F.min("site").alias("site")), "homes")
    stands = materialize(each.join(wide, ["h1", "h2"], "left_semi").select("h1", "h2", "t1", "t2").distinct().join(homes, ["t1", "t2"]).select("h1", "h2", "site"), "stands")
    discard(wide)
    discard(homes)
    found = materialize(spread(stands, sites, lg), "spread")
    sure = found.where(F.col("about") > sites * (1 + band)).select("h1", "h2")
    near = found.where(F.col("about").between(int(sites * (1 - band)), sites * (1 + band))).select("h1", "h2")
    exact = stands.join(near, ["h1", "h2"], "left_semi").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= sites)
    bad = materialize(sure.unionByName(exact.select("h1", "h2")), "boilerplate")
    discard(stands)
    discard(found)
    return bad


def removals(docs: DataFrame, bad: DataFrame) -> DataFrame:
    """(__u1, __u2, __bad): the positions of the lines that go, of each text (__t1, __t2) that loses any."""
    spots = docs.select(F.col("__t1").alias("__u1"), F.col("__t2").alias("__u2"), F.posexplode(F.transform(lines_of(F.col("__text")), trimmed)).alias("pos", "line")).where("line <> ''")
    spots = spots.select("__u1", "__u2", "pos", *[h.alias(f"h{i}") for i, h in enumerate(pair_hash(F.col("line")), 1)])
    found = spots.join(bad, ["h1", "h2"], "left_semi").groupBy("__u1", "__u2").agg(F.collect_set("pos").alias("__bad"))
    # a table of its own: the join of a hot text then has an exchange on either side, which Spark can split
    return materialize(found, "removals")


def dedup_lines(documents: DataFrame, site: str = "source", sites: int = SITES) -> DataFrame:
    """documents with boilerplate lines taken out of text, and n_lines and n_removed beside it.

    The lines of a text decide what goes, so removals are gathered by the text's hash: copies of a document
    share them, and their rows are summed up before the shuffle.
    """
    kept = [c for c in documents.columns if c not in ("n_lines", "n_removed")]
    docs = documents.select(*kept, *[h.alias(f"__t{i}") for i, h in enumerate(pair_hash(F.coalesce("text", F.lit(""))), 1)])
    bad = boilerplate(documents.select("text", site), site, sites)
    spots = removals(docs.select("__t1", "__t2", F.col("text").alias("__text")), bad)
    discard(bad)
    out = docs.join(spots, (F.col("__t1") == F.col("__u1")) & (F.col("__t2") == F.col("__u2")), "left")
    lines, goes = lines_of(F.col("text")), F.col("__bad").isNotNull()
    rest = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("__bad"), i)), "\n")
    return out.select(
        *[F.when(goes, rest).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in kept],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).alias("n_lines"),
        F.when(goes, F.size("__bad")).otherwise(0).alias("n_removed"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("kept_md5"))


OP5_SQL = f"""
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
x AS (SELECT doc_id, unnest(parts) AS raw, unnest(range(0, len(parts))) AS pos FROM l),
y AS (SELECT *, regexp_replace(raw, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS line FROM x),
h AS (SELECT text, min(coalesce(source, chr(0) || 'none')) AS site FROM documents GROUP BY text),
s AS (SELECT site, regexp_replace(unnest(string_split(text, chr(10))), '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') AS line FROM h),
b AS (SELECT line FROM s WHERE line <> '' GROUP BY line HAVING count(DISTINCT site) >= {SITES}),
g AS (SELECT y.*, b.line IS NOT NULL AS bad FROM y LEFT JOIN b ON y.line = b.line),
d AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (bad) AS n_bad, coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT bad), '') AS rest FROM g GROUP BY doc_id)
SELECT l.doc_id, coalesce(n_lines, 0)::INT AS n_lines, coalesce(n_bad, 0)::INT AS n_removed, md5(CASE WHEN n_bad > 0 THEN rest ELSE coalesce(text, '') END) AS kept_md5
FROM l LEFT JOIN d USING (doc_id)
"""
