"""Divergence of sources: how the words of each source of a language depart from those of the others and of the language.

A language keeps the terms of at least `least_docs` of its documents. Each of its sources gives every kept term a smoothed
share p in parts of a thousand million, all integers; two sources differ by the sum over all kept terms of
floor((p - q)^2 / q).

No pair of sources reads all terms. Terms that many of a language's sources have are heavy: they fill dense tiles of sources
x terms, of which numpy takes all pairs at once. All others are light. A pair of sources starts from what it would be worth if
neither had any term, one value times the number of terms. A tile puts its terms' values in the place of that; light terms correct it by
postings alone: for a term that one of both has (by how many terms it has with each count, so that equal counts are one correction), and
once more for terms that both have. Heavy and light sums are integers and simply add up.

Sources are cut into blocks and terms into tiles, a task sees the postings of a tile in two blocks, and no task holds all
terms, or all sources of a language with many. Term counts are summed in the task that reads the texts and once more by
Spark, so a source with most of the rows is no hot key. A posting goes to the pairs of blocks that have its term.

Null text, lang and source are ''. Sources without terms, and languages that keep none, have their rows. Repeated rows count as
often as they stand there, as documents of their own. Very long texts are counted whole. Ties in value go by the item's bytes.
An empty table gives an empty result. Other columns play no part, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

#: Whole of the shares; documents that a kept term has at least; ranks of terms.
WHOLE, LEAST_DOCS, TERM_RANKS = 1_000_000_000, 3, 200
#: Part of a language's sources from which a term is heavy; terms of a tile; sources of a block.
HEAVY, TILE, BLOCK = 1 / 3, 4096, 256
#: (lang, source, term) counts that a task holds at most before it hands them on.
HELD = 300_000
#: Bytes of a text whose terms are listed together.
STEP = 1 << 20
#: Bytes as they stand in terms: letters lowered, other ASCII a blank, the rest unchanged.
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: What a row of a tile is: a posting of a heavy or a light term, a number of light terms with one count, a source.
HEAVY_TERM, LIGHT_TERM, LIGHT_COUNT, SOURCE = range(4)


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    text, at = text.translate(LOWERED), 0
    while at < len(text):
        to = text.find(b" ", at + STEP)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def term_counts(documents: DataFrame, held_most: int = HELD) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; a row with a null term for each (lang, source)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                names = [pa.array([v] * (len(n) + 1), pa.string()) for v in (lang, source)]
                counts = [pa.array([0, *c], pa.int64()) for c in (n.values(), map(docs.__getitem__, n))]
                yield pa.RecordBatch.from_arrays([*names, pa.array([None, *n], pa.binary()), *counts], ["lang", "source", "term", "n", "docs"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                before, seen = len(n), set()
                for words in words_of(text):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                size += len(n) - before
                if size > held_most:
                    yield from told()
                    size = 0
        yield from told()

    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = documents.select(blank("lang").alias("lang"), blank("source").alias("source"), blank("text").cast("binary").alias("text"))
    found = rows.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return found.groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: str, total: str) -> Column:
    """1 + floor(WHOLE x (n + 1) / total), exactly; of an empty total, 1."""
    return F.expr(f"1 + if({total} = 0, 0, (cast({n} + 1 as decimal(19,0)) * {WHOLE}) div cast({total} as decimal(19,0)))").cast("long")


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q): at most 10^18."""
    d = p - q
    return d * d // q


def tile_sums(key: tuple, rows: pa.Table) -> pa.Table:
    """What a tile's terms add to the pairs of two blocks' sources; a tile 0 tells of every pair, and has what all terms are worth to a pair that has none."""
    lang, a, b, tile = (v.as_py() for v in key)
    what = rows["what"].to_numpy()
    sources = rows.filter(pa.array(what == SOURCE)).sort_by([("block", "ascending"), ("source", "ascending")])
    names, low, block, terms = sources["source"].combine_chunks(), sources["low"].to_numpy(), sources["block"].to_numpy(), sources["m"].to_numpy()
    ours, others = np.flatnonzero(block == a), np.flatnonzero(block == b)
    if not len(ours) or not len(others):  # a block that no source's hash falls into
        return pa.table({"lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "item": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
    ways = [(ours, others)] if a == b else [(ours, others), (others, ours)]
    sums = np.zeros((len(low), len(low)), np.int64)

    def of(kind: int) -> tuple[np.ndarray, np.ndarray, pa.Table]:
        part = rows.filter(pa.array(what == kind))
        return pc.index_in(part["source"], value_set=names).to_numpy(), part["p"].to_numpy(), part

    def numbered(part: pa.Table) -> np.ndarray:
        return part["term"].combine_chunks().dictionary_encode().indices.to_numpy()

    # heavy terms: a dense tile
    at, p, part = of(HEAVY_TERM)
    if len(at):
        term = numbered(part)
        dense = np.repeat(low[:, None], term.max() + 1, axis=1)
        dense[at, term] = p
        for i, j in ways:
            q = dense[j]
            for s in i:
                sums[s, j] += apart(dense[s], q).sum(axis=1) - dense.shape[1] * apart(low[s], low[j])
    # light terms that two sources have: the pair's value instead of what either alone and neither would make
    at, p, part = of(LIGHT_TERM)
    if len(at):
        term = numbered(part)
        order = np.lexsort((at, term))
        at, p, term = at[order], p[order], term[order]
        for k in range(1, len(at)):
            both = term[k:] == term[:-k]
            if not both.any():
                break
            if a != b:
                both &= block[at[k:]] != block[at[:-k]]
            i, j, pi, pj = at[:-k][both], at[k:][both], p[:-k][both], p[k:][both]
            for s, t, ps, pt in ((i, j, pi, pj), (j, i, pj, pi)):
                np.add.at(sums, (s, t), apart(ps, pt) - apart(ps, low[t]) - apart(low[s], pt) + apart(low[s], low[t]))
    # light terms that one source has, those of equal counts together
    at, p, part = of(LIGHT_COUNT)
    m = part["m"].to_numpy()
    for i, j in ways:
        none = apart(low[i][:, None], low[j])
        for k in range(len(low)):
            own = at == k
            if own.any() and block[k] == block[i[0]]:
                sums[k, j] += (m[own][:, None] * apart(p[own][:, None], low[j])).sum(axis=0) - m[own].sum() * none[i == k][0]
            if own.any() and block[k] == block[j[0]]:
                sums[i, k] += (m[own] * apart(low[i][:, None], p[own])).sum(axis=1) - m[own].sum() * none[:, j == k][:, 0]
        if tile == 0:
            sums[np.ix_(i, j)] += none * terms[i][:, None]
    wanted = np.zeros(sums.shape, bool)
    for i, j in ways:
        wanted[np.ix_(i, j)] = True
    np.fill_diagonal(wanted, False)
    s, t = np.nonzero(wanted if tile == 0 else wanted & (sums != 0))
    return pa.table([pa.array([lang] * len(s), pa.string()), names.take(pa.array(s)), names.take(pa.array(t)), pa.array(sums[s, t])], ["lang", "source", "item", "value"])


def postings_of(documents: DataFrame, least_docs: int, heavy: float) -> tuple[DataFrame, DataFrame]:
    """Two tables: of (lang, source, term) with a kept term, and of all (lang, source)."""
    counts = materialize(term_counts(documents), "terms")
    sources = counts.where("term is null").groupBy("lang").agg(F.count(F.lit(1)).alias("sources"))
    sources = materialize(sources.withColumn("blocks", F.ceil(F.col("sources") / BLOCK)), "langs")  # a row for each language
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    counts = counts.join(sources, "lang").select("lang", "source", "term", "n", "docs", "sources", "blocks", block)
    of_term = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.count(F.lit(1)).alias("d"), F.min("source").alias("owner"), F.collect_set("block").alias("there"))
    of_term = of_term.where(F.col("docs") >= least_docs).drop("docs")
    kept = counts.drop("docs").join(of_term, ["lang", "term"])
    kept = materialize(kept.select("lang", "source", "term", "n", "lang_n", "block", "there", (F.col("source") == F.col("owner")).alias("owned"), (F.col("d") > F.col("sources") * heavy).alias("heavy")), "postings")
    # a term counts as its first source's, so that no distinct count is needed
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n_all"), F.count_if("owned").alias("v"))
    groups = counts.where("term is null").select("lang", "source", "block", "blocks").join(sums, ["lang", "source"], "left").fillna(0, ["n_all", "v"])
    of_lang = Window.partitionBy("lang")  # at most as many rows as a language has sources
    groups = groups.select("lang", "source", "block", "blocks", "n_all", F.sum("n_all").over(of_lang).alias("lang_all"), F.sum("v").over(of_lang).alias("v"))
    groups = groups.withColumns({"total": F.col("n_all") + F.col("v"), "none": F.lit(0), "tiles": F.greatest(F.lit(1), F.ceil(F.col("v") / TILE)).cast("int")})
    return kept, materialize(groups.withColumn("low", share("none", "total")).drop("none"), "sources")


def pairs_of(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every pair of a language's sources."""
    every = F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))
    placed = kept.join(groups.select("lang", "source", "blocks", "total", "tiles"), ["lang", "source"]).withColumn("p", share("n", "total"))
    light = placed.where("not heavy").groupBy("lang", "source", "block", "blocks", "tiles", "n", "p").agg(F.count(F.lit(1)).alias("m"))

    def rows(df: DataFrame, what: Column, others: Column, tile: Column, term: str | None = None, p: str | None = None, m: str | None = None, low: str | None = None) -> DataFrame:
        given = lambda c, kind: (F.col(c) if c else F.lit(None)).cast(kind)
        found = df.select("lang", "block", F.explode(others).alias("other"), tile.cast("int").alias("tile"), what.alias("what"), "source", given(term, "string").alias("term"), given(p, "long").alias("p"), given(m, "long").alias("m"), given(low, "long").alias("low"))
        return found.withColumns({"a": F.least("block", "other"), "b": F.greatest("block", "other")}).drop("other")

    tiled = rows(placed, F.when(F.col("heavy"), HEAVY_TERM).otherwise(LIGHT_TERM), F.when(F.col("heavy"), every).otherwise(F.col("there")), F.pmod(F.xxhash64("term"), F.col("tiles")), "term", "p")
    tiled = tiled.unionByName(rows(light, F.lit(LIGHT_COUNT), every, F.pmod("n", F.col("tiles")), p="p", m="m"))
    each_tile = groups.withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.unionByName(rows(each_tile, F.lit(SOURCE), every, F.col("tile"), m="v", low="low"))
    sums = tiled.groupBy("lang", "a", "b", "tile").applyInArrow(tile_sums, "lang string, source string, item string, value long")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def terms_of(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms of which a source has a larger share than its language."""
    placed = kept.join(groups.select("lang", "source", "total", (F.col("lang_all") + F.col("v")).alias("lang_total")), ["lang", "source"])
    placed = placed.where("n > 0").select("lang", "source", F.col("term").alias("item"), share("n", "total").alias("p"), share("lang_n", "lang_total").alias("q")).where("p > q")
    return placed.select("lang", "source", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))


def audit(documents: DataFrame, least_docs: int = LEAST_DOCS, term_ranks: int = TERM_RANKS, heavy: float = HEAVY) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair`, how far each other source is; `term`, the `term_ranks` terms of a source that depart most from its language."""
    kept, groups = postings_of(documents, least_docs, heavy)
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    columns = lambda df, part: df.withColumn("rank", order).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return columns(pairs_of(kept, groups), "pair").unionByName(columns(terms_of(kept, groups), "term").where(F.col("rank") <= term_ranks))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT rid, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS v, sum(c)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT w.lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
n AS (SELECT g.lang, g.source, coalesce(sum(c), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, 1 + {WHOLE}::HUGEINT * (coalesce(c.c, 0) + 1) // (n.n + v) AS p, 1 + {WHOLE}::HUGEINT * (k.c + 1) // (v.n + v) AS q
  FROM n JOIN k ON k.lang = n.lang JOIN v ON v.lang = n.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM r WHERE part = 'pair' OR rank <= {TERM_RANKS}
"""
