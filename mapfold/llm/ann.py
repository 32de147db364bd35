"""Approximate nearest neighbours of largest inner product, by multiprobe p-stable hashing.

Vectors are brought to unit length at most and get one more entry, so that the largest inner product is the least
Euclidean distance. Each table hashes a vector by `HASHES` Gaussian (2-stable) projections, shifted and cut into
steps of a width: its bucket. A query visits its own bucket and then perturbed ones, each hash moved one step or not, in the
order of their estimated success: the sum of the squared distances to the bucket's sides (Lv et al., 2007). Sets of
moves come from a heap over expected distances, and each query sorts them by its own. How many buckets a query visits in a table is
fitted on a bounded sample of FIT_ROWS rows, so that the wanted recall is met for the sample's neighbours of the same
quantile; the steps widen if no number does. Every row is indexed. Only the rows of visited buckets are candidates: their
products are the only ones computed. Candidates of all tables merge and are ranked by their exact inner products, in
double precision, summed entry by entry, on the original vectors.

Equal vectors are one candidate with its smallest ids. Buckets are dealt out in groups by their first hashes; a query goes
to a group once, with the list of the buckets it visits there. A group of more than BLOCK rows or queries is split
into blocks of both, each pair of which is one task's work, so no task grows with a hot bucket and no candidate is dropped.

Vectors that are null, zero, of another length than most or hold nulls or values that aren't finite take no part.
Repeated rows count once. Of an id with several vectors, each is a candidate and, of a query, each is searched for; the id has
one list and is in a list once, with its best score. Products are computed on vectors scaled by the largest norm, so
finite vectors of any size are searched; a score that overflows is infinite, one that is no number counts as the least. Ties go to the smaller id. Fewer candidates than wanted: all found. Empty tables give empty
results. Extra columns play no part.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, pair_hash, table

TABLES, HASHES, WIDTH = 2, 8, 2.0
#: Rows the probing is fitted on, queries among them, and the recall it is fitted to.
FIT_ROWS, FIT_QUERIES, FIT_RECALL = 8192, 400, 0.95
#: Rows and queries of a block; rows wanted in a group of buckets.
BLOCK = 16_384
#: Queries whose buckets are listed at a time.
LISTED = 128


def probing_sequence(hashes: int, most: int) -> np.ndarray:
    """Sets of moves (set, 2 x hashes), at most `most`, in the order of their expected scores.

    A query's 2 x hashes distances to its bucket's sides are ranked; a set picks ranks, never both sides of a hash:
    ranks j and 2 x hashes + 1 - j. From a set, the heap goes on to the set with its last rank moved on by one, and to the set with the
    next rank added, which reaches every set once.
    """
    ranks = 2 * hashes
    j = np.arange(1, hashes + 1)
    low = j * (j + 1) / (4 * (hashes + 1) * (hashes + 2))
    back = ranks + 1 - np.arange(hashes + 1, ranks + 1)
    high = 1 - back / (hashes + 1) + back * (back + 1) / (4 * (hashes + 1) * (hashes + 2))
    expected = np.concatenate((low, high)).tolist()
    out, heap = [()], [(expected[0], (0,))]
    while heap and len(out) < most:
        score, chosen = heapq.heappop(heap)
        if len({min(c, ranks - 1 - c) for c in chosen}) == len(chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < ranks:
            heapq.heappush(heap, (score - expected[last] + expected[last + 1], (*chosen[:-1], last + 1)))
            heapq.heappush(heap, (score + expected[last + 1], (*chosen, last + 1)))
    sets = np.zeros((len(out), ranks), np.float64)
    for row, chosen in zip(sets, out, strict=True):
        row[list(chosen)] = 1
    return sets


@dataclass
class Index:
    """Projections (table, dim + 1, hash), shifts (table, hash), largest norm, step width, buckets a query visits in a table, hashes that make a group."""

    project: np.ndarray
    shift: np.ndarray
    norm: float
    width: float = WIDTH
    probes: int = 1 << 62
    lead: int = 1
    sets: np.ndarray | None = None

    @classmethod
    def new(cls, dim: int, norm: float, tables: int = TABLES, seed: int = 3) -> Index:
        r = np.random.default_rng(seed)
        return cls(r.standard_normal((tables, dim + 1, HASHES)), r.uniform(0, 1, (tables, HASHES)), norm, sets=probing_sequence(HASHES, 3**HASHES))

    def rows(self, x: np.ndarray) -> np.ndarray:
        x = x / self.norm
        return np.concatenate((x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]), axis=1)

    def queries(self, q: np.ndarray) -> np.ndarray:
        return np.concatenate((unit(q), np.zeros((len(q), 1))), axis=1)

    def places(self, vectors: np.ndarray, t: int) -> np.ndarray:
        """Places on the hashes' lines, in bucket widths; the bucket is their floor."""
        return vectors @ self.project[t] / self.width + self.shift[t]

    @staticmethod
    def codes(buckets: np.ndarray) -> np.ndarray:
        """One number for each bucket (last axis); should two share one, both are candidates."""
        odd = np.random.default_rng(17).integers(1, 1 << 62, buckets.shape[-1], dtype=np.int64) | 1
        return (buckets.astype(np.int64) * odd).sum(axis=-1)

    def visited(self, places: np.ndarray) -> np.ndarray:
        """(query, visit, hash): the buckets that queries visit in a table, in order."""
        n, m = places.shape
        inside = places - np.floor(places)
        gaps = np.concatenate((inside, 1 - inside), axis=1) ** 2  # down, up
        order = np.argsort(gaps, axis=1, kind="stable")
        ranked = np.take_along_axis(gaps, order, axis=1)
        score = ranked @ self.sets.T
        first = np.argsort(score, axis=1, kind="stable")[:, : self.probes]
        moves = np.zeros((n, 2 * m, m), np.float64)
        moves[np.arange(n)[:, None], np.arange(2 * m)[None], order % m] = np.where(order < m, -1, 1)
        return np.floor(places)[:, None] + np.einsum("nsr,nrm->nsm", self.sets[first], moves, optimize=True)

    def fit(self, sample: np.ndarray, rows: int, k: int, recall: float = FIT_RECALL) -> None:
        """Sets how many buckets are visited by the sample, and how many hashes make a group by the number of rows."""
        self.lead = min(5, max(1, math.ceil(math.log(max(2.0, rows / BLOCK)) / math.log(4))))
        k = max(1, round(k * len(sample) / max(rows, 1)))
        picked = sample[:FIT_QUERIES]
        if len(sample) <= k + 1:
            return
        inner = unit(picked) @ (sample / self.norm).T
        inner[np.arange(len(picked)), np.arange(len(picked))] = -np.inf
        near = np.argsort(-inner, axis=1)[:, :k]
        x, q = self.rows(sample), self.queries(picked)
        while True:
            visit = np.full(near.shape, np.inf)
            for t in range(len(self.project)):
                held, p = self.codes(np.floor(self.places(x, t))), self.places(q, t)
                for i in range(len(p)):
                    seen = self.codes(self.visited(p[i : i + 1])[0])
                    order = np.argsort(seen, kind="stable")
                    at = order[np.minimum(np.searchsorted(seen[order], held[near[i]]), len(seen) - 1)]
                    visit[i] = np.minimum(visit[i], np.where(seen[at] == held[near[i]], at, np.inf))
            most = np.quantile(visit, recall, method="higher")
            if np.isfinite(most):
                self.probes = int(most) + 1
                return
            self.width *= 1.5  # too many neighbours lie more than a step off

    def key(self, t: int, lead: np.ndarray) -> np.ndarray:
        """Group keys of the first hashes' buckets (last axis)."""
        out = np.full(lead.shape[:-1], t, np.int64)
        for c in np.moveaxis(lead, -1, 0):
            out = out * 2048 + (c.astype(np.int64) + 1024)
        return out

    def routes(self, places: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Queries, the groups they go to and the codes of the buckets they visit there, in order."""
        who, keys, lists = [], [], []
        for at in range(0, len(places), LISTED):
            buckets = self.visited(places[at : at + LISTED])
            codes, groups = self.codes(buckets), self.key(t, buckets[..., : self.lead])
            for i, (c, g) in enumerate(zip(codes, groups, strict=True), at):
                order = np.argsort(g, kind="stable")
                cuts = np.flatnonzero(np.diff(g[order])) + 1
                lists += np.split(c[order], cuts)
                keys.append(g[order][np.concatenate(([0], cuts))])
                who.append(np.full(len(cuts) + 1, i))
        return np.concatenate(who), np.concatenate(keys), lists


def exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of pairs, summed in the order of the entries: the same in whatever task. What is no number is the least."""
    out = np.zeros(len(q))
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(q.shape[1]):
            out += q[:, j] * x[:, j]
    return np.where(np.isnan(out), -np.inf, out)


def unit(q: np.ndarray) -> np.ndarray:
    """Vectors of length one, by their largest entries first, whose squares neither overflow nor vanish."""
    q = q / np.abs(q).max(axis=1)[:, None]
    return q / np.linalg.norm(q, axis=1)[:, None]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def usable(vectors: DataFrame, ident: str, vector: str) -> tuple[DataFrame, int]:
    """Rows that take part, as (vec_id, v), and the vectors' length."""
    v = F.col(vector)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    out = vectors.where(v.isNotNull() & F.col(ident).isNotNull()).where(~F.exists(v, bad) & F.exists(v, lambda x: x != 0)).select(F.col(ident).cast("long").alias("vec_id"), v.alias("v"))
    sizes = out.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = sizes["dim"] if sizes else 1
    return out.where(F.size("v") == dim), dim


def _spread(df: DataFrame, counts: DataFrame, own: str, other: str, ident: Column) -> DataFrame:
    """Rows of a group dealt to its blocks: one of its own side, by hash, with each of the other side."""
    joined = df.join(counts, "key").withColumn(own, F.pmod(F.xxhash64(ident), F.col(f"n_{own}")).cast("int"))
    return joined.withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1))).drop("n_bx", "n_bq")


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, ident: str = "vec_id", vector: str = "embedding", tables: int = TABLES, recall: float = FIT_RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: of each query row the k nearest other rows found, ties to the smaller id."""
    rows, dim = usable(vectors, ident, vector)
    hashed = rows.select("vec_id", "v", *[h.alias(f"h{i}") for i, h in enumerate(pair_hash(F.col("v")), 1)])
    # of equal vectors the k + 1 smallest ids: enough for any list, and few before the shuffle
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    first = hashed.withColumn("r", F.dense_rank().over(order)).where(F.col("r") <= k + 1)
    classes = first.groupBy("h1", "h2").agg(F.min("vec_id").alias("c"), F.sort_array(F.collect_set("vec_id")).alias("ids"), F.first("v").alias("v"))
    # u tells classes apart: numbers that are fixed by being written
    classes = materialize(classes.withColumn("u", F.monotonically_increasing_id()), "classes")
    most = F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))
    length = F.col("most") * F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x / F.col("most") * (x / F.col("most"))))
    norm, n = classes.withColumn("most", most).agg(F.max(F.least(length, F.lit(1.7e308))), F.count(F.lit(1))).first()
    index = Index.new(dim, float(norm or 1.0), tables)
    sample = classes.orderBy(F.xxhash64("c", "h1")).limit(FIT_ROWS).select("v").toArrow()
    if sample.num_rows:
        index.fit(_matrix(sample.column(0)), n, k, recall)

    queries = materialize(hashed.where(is_query).select(F.col("vec_id").alias("query_id"), "h1", "h2").distinct().join(classes.select("h1", "h2", "u"), ["h1", "h2"]).select("query_id", "u"), "queries")
    asked = classes.join(queries.select("u").distinct(), "u", "left_semi").select("u", "v")
    vec = "array<double>" if dict(rows.dtypes)["v"] == "array<double>" else "array<float>"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = index.rows(_matrix(b.column(2))) if b.num_rows else None
            for t in range(len(index.project)) if b.num_rows else ():
                yield pa.RecordBatch.from_arrays([pa.array(index.key(t, np.floor(index.places(x, t)[:, : index.lead]))), *b.columns], ["key", "u", "c", "v"])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, LISTED):
                part = b.slice(at, LISTED)
                q = index.queries(_matrix(part.column(1)))
                for t in range(len(index.project)):
                    who, keys, lists = index.routes(index.places(q, t), t)
                    ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
                    visits = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))
                    yield pa.RecordBatch.from_arrays([pa.array(keys), *[col.take(pa.array(who)) for col in part.columns], visits], ["key", "u", "v", "visits"])

    placed = classes.select("u", "c", "v").mapInArrow(place, f"key long, u long, c long, v {vec}")
    routed = asked.mapInArrow(route, f"key long, u long, v {vec}, visits array<long>")
    size = lambda df, name: df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(name))
    counts = materialize(size(placed.select("key"), "n_bx").join(size(routed.select("key"), "n_bq"), "key"), "groups")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"q": pa.array([], pa.int64()), "u": pa.array([], pa.int64()), "c": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        t = int(left.column("key")[0].as_py()) >> (11 * index.lead)
        x, q = _matrix(left.column("v")), _matrix(right.column("v"))
        xu, xc, qu = left.column("u").to_numpy(), left.column("c").to_numpy(), right.column("u").to_numpy()
        codes = index.codes(np.floor(index.places(index.rows(x), t)))
        order = np.lexsort((xc, codes))  # the rows of a bucket lie together
        x, xu, xc, codes = x[order], xu[order], xc[order], codes[order]
        scaled = x / index.norm
        buckets, starts = np.unique(codes, return_index=True)
        starts = np.append(starts, len(codes))
        visits = right.column("visits").combine_chunks()
        flat, ends = visits.values.to_numpy(), visits.offsets.to_numpy()
        out = []
        for at in range(0, len(q), 256):
            part = q[at : at + 256]
            asked_ = unit(part)
            score = np.full((len(part), len(x)), -np.inf)
            visit = flat[ends[at] : ends[at + len(part)]]
            of = np.repeat(np.arange(len(part)), np.diff(ends[at : at + len(part) + 1]))
            bucket = np.minimum(np.searchsorted(buckets, visit), len(buckets) - 1)
            hit = buckets[bucket] == visit
            bucket, of = bucket[hit], of[hit]
            order = np.argsort(bucket, kind="stable")
            bucket, of = bucket[order], of[order]
            cuts = np.flatnonzero(np.diff(bucket)) + 1
            for b, who in zip(bucket[np.concatenate(([0], cuts))] if len(bucket) else [], np.split(of, cuts), strict=False):
                score[who, starts[b] : starts[b + 1]] = asked_[who] @ scaled[starts[b] : starts[b + 1]].T
            most = min(k + 1, score.shape[1])
            least = -np.partition(-score, most - 1, axis=1)[:, most - 1]
            least = np.where(np.isfinite(least), least - 1e-9 * (1 + np.abs(least)), -np.inf)
            rows_, cols = np.nonzero((score >= least[:, None]) & np.isfinite(score))
            out.append((qu[at + rows_], xu[cols], xc[cols], exact(part[rows_], x[cols])))
        return pa.table(dict(zip(("q", "u", "c", "score"), (np.concatenate(z) for z in zip(*out, strict=True)), strict=True)))

    left = _spread(placed, counts, "bx", "bq", F.col("u")).select("key", "bx", "bq", "u", "c", "v")
    right = _spread(routed, counts, "bq", "bx", F.col("u")).select("key", "bx", "bq", "u", "v", "visits")
    found = left.groupBy("key", "bx", "bq").cogroup(right.groupBy("key", "bx", "bq")).applyInArrow(meet, "q long, u long, c long, score double")

    merged = found.groupBy("q", "u").agg(F.max("score").alias("score"), F.min("c").alias("c"))
    top = Window.partitionBy("q").orderBy(F.desc("score"), "c", "u")
    merged = merged.withColumn("r", F.row_number().over(top)).where(F.col("r") <= k + 1)
    ids = merged.select("q", "u", "score").join(classes.select("u", "ids"), "u").select("q", "score", F.explode("ids").alias("vec_id"))
    found = queries.join(ids, queries["u"] == ids["q"]).where("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
