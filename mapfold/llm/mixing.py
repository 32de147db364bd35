"""Mixing sources to target weights by temperature.

The token shares of the sources are raised to an exponent a in [0, 1] and normalised: a = 1 keeps the shares,
a = 0 makes them equal. a is bisected to a target: the largest value with an entropy of at least `entropy` times
the greatest possible, or the smallest (flattest) that shows no source more than `max_repeats` times. The weights
are then realised under a token budget as block permutations: the documents of a source fall into blocks of about
`block_tokens` tokens by a hash, each block gets its part of the source's tokens, gives whole permutations of
itself while the tokens last (epochs 0, 1, ...) and then the first documents of a further permutation, as far
as they fit. A block is small whatever the source's size, so no task holds a source. Only DataFrame operations
are used; the driver sees one row per candidate exponent.

Nulls: documents of null source form a source of their own; null and empty texts have 0 tokens. Documents of
0 tokens go along with each whole permutation of their block (once, if the source has no tokens). Repeated rows
are documents of their own; documents are ordered by a hash of doc_id and text, so null and repeated doc_ids don't share a place
unless their texts are equal, and the same rows are drawn however the input is dealt out. Very long texts: one longer than a block is a
block's greater part, and is left out of a last part that it doesn't fit. An empty table gives an empty result. Extra
columns are kept, whatever their names; n_tokens, weight, block, epoch and slot are replaced, and names that begin with
two underscores are the operator's own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, table

#: Passes over the shares, and halvings of the exponent's range in each.
PASSES, HALVINGS = 5, 6


def token_count(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_tokens(documents: DataFrame, key: str = "source", tokens: str = "n_tokens") -> DataFrame:
    return documents.groupBy(F.col(key).alias("source")).agg(F.sum(tokens).alias("tokens"))


def exact_sum(c: Column, digits: int = 18) -> Column:
    """The sum of doubles as decimals, which doesn't depend on the order of the rows."""
    return F.sum(c.cast(f"decimal(38,{digits})"))


def bisect_exponent(shares: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget: float | None = None) -> float:
    """The exponent that meets the target, over shares (source, tokens): one of entropy and max_repeats.

    entropy: least entropy of the weights, as part of the log of the number of sources that have tokens.
    max_repeats: greatest weight x budget / tokens of a source; without a budget, the budget at which the
    source least repeated is seen just once. Each pass scores all midpoints of the next HALVINGS halvings at
    once, so a pass is one small aggregation and the driver gets 2^HALVINGS - 1 rows of it.
    """
    if (entropy is None) == (max_repeats is None):
        raise ValueError("one target is needed: entropy or max_repeats")
    used = shares.where("tokens > 0")
    n, total, least, most = used.agg(F.count(F.lit(1)), F.sum("tokens"), F.min("tokens"), F.max("tokens")).first()
    if not n:
        return 1.0
    low, high = 0.0, 1.0
    log_share = F.ln(F.col("tokens") / F.lit(float(total)))

    def up(z: float, e: float, a: float) -> bool:
        """Whether the exponent sought is a or more."""
        if entropy is not None:
            return math.log(z) - a * e / z >= entropy * math.log(n) - 1e-12
        if budget is None:
            return (most / least) ** (1 - a) > max_repeats
        return (least / total) ** a / z * budget / least > max_repeats

    for _ in range(PASSES):
        points = [low + (high - low) * i / 2**HALVINGS for i in range(1, 2**HALVINGS)]
        at = used.select(log_share.alias("l"), F.posexplode(F.array(*map(F.lit, points))).alias("k", "a"))
        power = F.exp(F.col("a") * F.col("l"))
        found = at.groupBy("k").agg(exact_sum(power).alias("z"), exact_sum(power * F.col("l")).alias("e")).collect()
        met = {r["k"] + 1: up(float(r["z"]), float(r["e"]), points[r["k"]]) for r in found}
        left, right = 0, 2**HALVINGS
        for _ in range(HALVINGS):
            mid = (left + right) // 2
            left, right = (mid, right) if met[mid] else (left, mid)
        low, high = low + (high - low) * left / 2**HALVINGS, low + (high - low) * right / 2**HALVINGS
    return low if entropy is not None else high


def digest(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def permutation_key(ident: Column, *salt: Column) -> Column:
    """A hash of the salt, the id and the document's digest."""
    return F.md5(F.concat_ws(":", *[s.cast("string") for s in salt], ident.cast("string"), F.col("__content")))


def plan_sources(shares: DataFrame, exponent: float, budget: float | None, block_tokens: int) -> DataFrame:
    """(source, tokens, weight, target, blocks): target is the source's tokens in the mix.

    Without a budget, the mix is as large as it takes for every source to be seen at least once.
    """
    used = shares.where("tokens > 0")
    z = used.agg(exact_sum(F.pow(F.col("tokens").cast("double"), F.lit(exponent)), 12)).first()[0]
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent)) / F.lit(float(z or 1))).otherwise(F.lit(0.0))
    out = shares.withColumn("weight", weight)
    if budget is None:
        budget = out.where("tokens > 0").agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
    return out.withColumns({"target": F.round(F.col("weight") * F.lit(float(budget))).cast("long"), "blocks": F.greatest(F.lit(1), F.ceil(F.col("tokens") / F.lit(block_tokens))).cast("long")})


def realise(documents: DataFrame, plan: DataFrame, ident: str = "doc_id", seed: int = 11) -> DataFrame:
    """The mix: documents with n_tokens and __content (a digest of the text, which isn't returned), once for each epoch they are drawn in, with weight, block, epoch and slot.

    plan: as plan_sources() gives it, a row per source; it joins on the source, null with null.
    """
    plan = plan.select(F.col("source").alias("__source"), F.col("tokens").alias("__tokens"), "weight", F.col("target").alias("__target"), F.col("blocks").alias("__blocks"))
    held = documents.join(plan, documents["source"].eqNullSafe(plan["__source"]))
    spot = F.conv(F.substring(permutation_key(F.col(ident), F.lit(seed), F.lit("block")), 1, 12), 16, 10).cast("long")
    held = held.withColumn("block", F.pmod(spot, F.col("__blocks")))
    part = [F.col("__source"), F.col("block")]
    sizes = held.groupBy(F.col("__source").alias("__s"), F.col("block").alias("__b")).agg(F.sum("n_tokens").alias("__in_block"))
    quota = F.floor(F.col("__target") * (F.col("__in_block") / F.col("__tokens"))).cast("long")
    sizes = sizes.join(plan.select("__source", "__target", "__tokens"), F.col("__s").eqNullSafe(F.col("__source")))
    # a ratio a hair under a whole number is that number: else a source's single epoch could lose a document
    ratio = F.col("__target") / F.col("__tokens")
    whole = F.when(F.col("__in_block") > 0, F.floor(ratio + F.lit(1e-9))).otherwise(F.greatest(F.lit(1), F.floor(ratio + F.lit(1e-9))))
    whole = F.coalesce(whole, F.lit(1)).cast("long")
    sizes = sizes.select("__s", "__b", whole.alias("__whole"), F.greatest(F.lit(0), F.coalesce(quota, F.lit(0)) - whole * F.col("__in_block")).alias("__rest"))
    held = held.join(sizes, held["__source"].eqNullSafe(sizes["__s"]) & (held["block"] == sizes["__b"]))
    drawn = held.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__whole") - F.when(F.col("__rest") > 0, 0).otherwise(1))))
    # a document longer than what is left for its block's last part can't be drawn there, and doesn't end it
    drawn = drawn.where((F.col("epoch") >= 0) & ((F.col("epoch") < F.col("__whole")) | (F.col("n_tokens") <= F.col("__rest")))).withColumn("__key", permutation_key(F.col(ident), F.lit(seed), F.col("epoch")))
    order = Window.partitionBy(*part, "epoch").orderBy("__key", ident, "__content", "n_tokens")
    drawn = drawn.withColumn("slot", F.row_number().over(order) - 1).withColumn("__sum", F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = drawn.where((F.col("epoch") < F.col("__whole")) | ((F.col("__sum") <= F.col("__rest")) & (F.col("n_tokens") > 0)))
    return out.select(*[f"`{c}`" for c in documents.columns if c != "__content"], "weight", "block", "epoch", F.col("slot").cast("int").alias("slot"))


def mix_sources(documents: DataFrame, entropy: float | None = None, max_repeats: float | None = None, budget_share: float | None = None, block_tokens: int = 2_000_000) -> DataFrame:
    """documents (doc_id, text, source, ...) mixed; budget_share: tokens of the mix over those of the input."""
    kept = [c for c in documents.columns if c not in ("n_tokens", "weight", "block", "epoch", "slot")]
    counted = documents.select(*kept, token_count(F.col("text")).alias("n_tokens"), digest(F.col("text")).alias("__content"))
    shares = materialize(source_tokens(counted), "shares")
    total = shares.agg(F.sum("tokens")).first()[0] or 0
    budget = None if budget_share is None else budget_share * total
    exponent = bisect_exponent(shares, entropy, max_repeats, budget)
    return realise(counted, plan_sources(shares, exponent, budget, block_tokens))


#: Parameters of the query.
ENTROPY, BLOCK_TOKENS = 0.97, 2_000_000


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # texts stay out of the shuffles: only the ids, counts and digests are drawn
    counted = docs.select("doc_id", "source", token_count(F.col("text")).alias("n_tokens"), digest(F.col("text")).alias("__content"))
    shares = materialize(source_tokens(counted), "shares")
    total = shares.agg(F.sum("tokens")).first()[0] or 0
    plan = plan_sources(shares, bisect_exponent(shares, entropy=ENTROPY), float(total), BLOCK_TOKENS)
    return realise(counted, plan).select("doc_id", "source", "n_tokens", F.round("weight", 6).alias("weight"), "block", "epoch", "slot")


OP4_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens, md5(coalesce(text, '')) AS content FROM documents),
s AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
t AS (SELECT sum(tokens)::DOUBLE AS total, count(*) FILTER (tokens > 0) AS n, list(tokens) FILTER (tokens > 0) AS l FROM s),
b(step, lo, hi) AS (SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, CASE WHEN ok THEN (lo + hi) / 2 ELSE lo END, CASE WHEN ok THEN hi ELSE (lo + hi) / 2 END FROM
  (SELECT step, lo, hi, ln(list_sum(list_transform(l, lambda x: exp((lo + hi) / 2 * ln(x / total))))) - (lo + hi) / 2
    * list_sum(list_transform(l, lambda x: exp((lo + hi) / 2 * ln(x / total)) * ln(x / total))) / list_sum(list_transform(l, lambda x: exp((lo + hi) / 2 * ln(x / total)))) >= {ENTROPY} * ln(n) - 1e-12 AS ok
   FROM b, t WHERE step < {PASSES * HALVINGS})),
a AS (SELECT lo AS a FROM b WHERE step = {PASSES * HALVINGS}),
w AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, a) / sum(CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, a) END) OVER () ELSE 0.0 END AS weight,
  greatest(1, ceil(tokens / {BLOCK_TOKENS}))::BIGINT AS blocks FROM s, a),
p AS (SELECT w.*, round(weight * total)::BIGINT AS target FROM w, t),
h AS (SELECT d.*, weight, target, tokens, ('0x' || substr(md5(concat_ws(':', '11:block', doc_id, content)), 1, 12))::BIGINT % blocks AS block FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
z AS (SELECT *, sum(n_tokens) OVER (PARTITION BY source, block) AS in_block FROM h),
q AS (SELECT *, coalesce(CASE WHEN in_block > 0 THEN floor(target / tokens + 1e-9) ELSE greatest(1, floor(target / tokens + 1e-9)) END, 1)::BIGINT AS whole FROM z),
r AS (SELECT *, greatest(0, coalesce(floor(target * (in_block / tokens)), 0) - whole * in_block) AS rest FROM q),
e AS (SELECT *, unnest(range(0, whole + CASE WHEN rest > 0 THEN 1 ELSE 0 END)) AS epoch FROM r),
k AS (SELECT *, md5(concat_ws(':', 11, epoch, doc_id, content)) AS key FROM e WHERE epoch < whole OR n_tokens <= rest),
f AS (SELECT *, row_number() OVER o - 1 AS slot, sum(n_tokens) OVER (PARTITION BY source, block, epoch ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS cum FROM k WINDOW o AS (PARTITION BY source, block, epoch ORDER BY key, doc_id))
SELECT doc_id, source, n_tokens, round(weight, 6) AS weight, block, epoch, slot::INT AS slot FROM f WHERE epoch < whole OR (cum <= rest AND n_tokens > 0)
"""
