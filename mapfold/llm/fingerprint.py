"""Document fingerprints: threshold-scaled sketches of word shingles.

A text's sketch is every distinct hash of its five-word shingles that lies below a fixed fraction of the hash
range. Which hashes stay doesn't depend on the text's length, so the union of sketches is the sketch of the union
and containment can be estimated between very unequal documents. A text of fewer than five words has one shingle,
all its words. Only DataFrame operations are used.

A sketch may be empty: of a short text by chance (of n shingles, with the probability (1 - 1/SCALE)^n), of nulls and
texts without words always. Two empty sketches tell nothing: their likeness is null, or, where it must be a number, 1 of equal
texts and 0 of others. Of texts of few words, take a smaller scale. Repeated rows and equal texts have equal sketches. Very long texts are sketched
whole, in their task. Rows of one doc_id follow each other in the order of their contents' hash. Empty tables give
empty results. Extra columns play no part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

#: Words of a shingle; one in so many hashes is kept.
WORDS, SCALE = 5, 4
#: A hot id falls into two to the power of so many ranges.
SPLIT_BITS = 4
SPACE = r"[\x20\x09-\x0D]+"


def with_sketch(df: DataFrame, text: str, name: str, scale: int = SCALE) -> DataFrame:
    """df with the sketch of a text column.

    The steps are columns of their own, each used more than once by the next, so that Spark doesn't inline them
    into the loops over the words.
    """
    hashes, n, all_ = f"_{name}_hashes", f"_{name}_n", f"_{name}_all"
    word_hashes = F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))
    h = F.col(hashes)
    each = F.transform(F.sequence(F.lit(0), F.col(n) - WORDS), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WORDS)]))
    short = F.when(F.col(n) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))
    out = df.withColumn(hashes, word_hashes).withColumn(n, F.size(h)).withColumn(all_, F.when(F.col(n) >= WORDS, each).otherwise(short))
    return out.withColumn(name, sketch_of(F.col(all_), scale)).drop(hashes, n, all_)


def sketch_of(hashes: Column, scale: int = SCALE) -> Column:
    """Sorted distinct hashes below 1/scale of the unsigned range."""
    limit = F.lit((1 << 63) // scale * 2 - (1 << 63)) if scale > 1 else F.lit((1 << 63) - 1)
    flip = lambda h: h.bitwiseXOR(F.lit(-(1 << 63)))  # noqa: E731  unsigned order as signed order
    return F.sort_array(F.transform(F.array_distinct(F.filter(hashes, lambda h: flip(h) < limit)), flip))


def jaccard(a: Column, b: Column, same: Column | None = None) -> Column:
    """Estimated likeness; of two empty sketches null, or what `same` says of their texts."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, F.lit(None).cast("double") if same is None else F.when(same, F.lit(1.0)).otherwise(0.0)).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Estimated part of a's shingles that b has; null if a's sketch is empty."""
    return F.when(F.size(a) == 0, F.lit(None).cast("double")).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def as_string(sketch: Column) -> Column:
    """16 hex digits for each hash, in order."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), "")


def with_next(docs: DataFrame, ident: str, carried: list[str], parts: int | None = None, derive: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs with, for each carried column c, next_c: its value in the row next by ident (after the last: the first).

    derive adds further columns, made from the carried ones, which are carried too: it runs once a row, before the shuffle.

    The ids are cut into `parts` ranges at approximate quantiles; each range is a window of its own. An id that ends a
    range may have very many rows, and so may null: these go by the top bits of their contents' hash into ranges of
    their own. What follows a range is the first row of the next one, which joins it as an extra last row. The
    driver sees the quantiles alone, a number of values set by `parts`; the table of the ranges' first keys, which is
    broadcast, has at most 2^SPLIT_BITS + 1 rows for each of `parts`, whatever the input.
    """
    spark = docs.sparkSession
    parts = parts or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(ident, [i / parts for i in range(1, parts)], 100 * parts)).first()[0]
    cuts = sorted(set(cuts or []))
    steps = [1 << k for k in reversed(range(max(1, len(cuts)).bit_length()))]
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    past = lambda a, s: (a + s <= F.lit(len(cuts))) & (F.col(ident) > F.get(bounds, a + s - 1))
    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda a, s: F.when(past(a, s), a + s).otherwise(a))
    docs = docs.withColumns({"__hash": F.xxhash64(*carried), "__place": F.when(F.col(ident).isNull(), -1).otherwise(place)})
    top = F.shiftright("__hash", 64 - SPLIT_BITS) + (1 << SPLIT_BITS - 1)  # 0 and up, in the order of the hash
    hot = F.col(ident).isNull() | (F.col(ident) == F.get(bounds, F.greatest(F.col("__place"), F.lit(0))))
    docs = docs.withColumn("__range", F.struct("__place", F.when(F.coalesce(hot, F.lit(False)), top + 1).otherwise(F.lit(0)).alias("__sub"))).drop("__place")
    key = F.struct(F.col(ident).isNotNull().alias("known"), F.col(ident).alias("id"), F.col("__hash").alias("hash"))
    # one row for each range: the first key, and the range before it (of the first: the last)
    firsts = docs.groupBy("__range").agg(F.min(key).alias("first"))
    line, whole = Window.orderBy("__range"), Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select(F.col("__range").alias("__own"), "first", F.coalesce(F.lag("__range").over(line), F.last("__range").over(whole)).alias("__before"))
    same = (F.col("__range") == F.col("__own")) & F.col(ident).eqNullSafe(F.col("first.id")) & (F.col("__hash") == F.col("first.hash"))
    heads = docs.join(F.broadcast(firsts), same).groupBy("__before").agg(F.first(ident).alias(ident), *[F.first(c).alias(c) for c in carried], F.first("__hash").alias("__hash"))
    both = docs.withColumn("__extra", F.lit(0)).unionByName(heads.withColumnRenamed("__before", "__range").withColumn("__extra", F.lit(1)), allowMissingColumns=True)
    if derive:
        known = set(both.columns)
        both = derive(both)
        carried = [*carried, *[c for c in both.columns if c not in known]]
    window = Window.partitionBy("__range").orderBy("__extra", F.col(ident).asc_nulls_first(), "__hash")
    return both.withColumns({f"next_{c}": F.lead(c).over(window) for c in carried}).where("__extra = 0").drop("__range", "__extra", "__hash")


def edited(text: Column, following: Column) -> Column:
    """text, its last quarter (in code points, rounded down) replaced by as many of the following text's first, or all it has."""
    cut = F.floor(F.char_length(text) / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - cut), F.substring(following, F.lit(1), cut))


def fingerprint_edits(documents: DataFrame, scale: int = SCALE) -> DataFrame:
    """doc_id, text, edited, sketch, edited_sketch, next_sketch and next_same (whether the next text is equal) of every document."""
    docs = documents.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    docs = with_next(docs, "doc_id", ["text"], derive=lambda rows: with_sketch(rows, "text", "sketch", scale))
    docs = docs.withColumns({"edited": edited(F.col("text"), F.col("next_text")), "next_same": F.col("text") == F.col("next_text")}).drop("next_text")
    return with_sketch(docs, "edited", "edited_sketch", scale)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fingerprint_edits(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("sketch")).alias("fingerprint"),
        as_string(F.col("edited_sketch")).alias("edited_fingerprint"),
        jaccard(F.col("sketch"), F.col("edited_sketch"), F.col("text") == F.col("edited")).alias("near_edited"),
        jaccard(F.col("sketch"), F.col("next_sketch"), F.col("next_same")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("held_by_edited"),
    )
