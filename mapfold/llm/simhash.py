"""SimHash near-duplicates by a self-join over binary tries.

A text's 64-bit fingerprint has a bit set if it is set in over half the hashes of its word shingles. Fingerprints
that differ in at most `budget` bits link; linked texts form components.

The join works on distinct fingerprints. Cut into four blocks of 16 bits, two that differ in at most 2 bits agree on
two blocks: each fingerprint is dealt out under six keys of 32 bits (and likewise for larger budgets), so that a
task's tries are small however many near copies a text has. Inside a key the sorted fingerprints
are a binary trie, whose nodes are ranges. Pairs of nodes are followed together from the root, bit by bit; a pair
carries the number of bits that differ so far and is dropped as soon as that exceeds the budget. What arrives at
the leaves are the links. Links inside a key that don't change its components are left out.

Nulls and texts without words have the fingerprint 0, which links like any other. Repeated rows and equal texts
share a fingerprint. Of a component, the smallest doc_id names it, so ties don't matter. Very long texts are hashed whole, in their
task. Empty tables give empty results. Extra columns play no part. Copies with more edits than so few
bits show are the matter of near_copies.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import materialize, table
from .components import components

SEED, WORDS, BUDGET = 42, 3, 2


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; fewer words make one shingle, none make none."""
    tokens = (text or "").encode().lower().split()
    joined, hash_of = b" ".join(tokens), xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return np.array([hash_of(joined, SEED)] if tokens else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.fromiter((hash_of(joined[a:b], SEED) for a, b in spans), np.uint64, len(tokens) - words + 1)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):  # a very long text doesn't unpack at once
        part = hashes[at : at + 65536].astype(">u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(bits * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of one text, unsigned."""
    return majority(shingle_hashes(text, words))


def fingerprints(text: str, words: int = WORDS) -> Column:
    """The fingerprints of a text column, as signed longs."""

    @F.pandas_udf(LongType())
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(np.array([fingerprint(t, words) for t in batch], np.uint64).view(np.int64))

    return of(text)


def blocks(budget: int = BUDGET) -> list[tuple[int, ...]]:
    """Bit positions on whose values two fingerprints agree in at least one entry if they differ in at most `budget` bits.

    Of budget + r blocks, r agree at least: each choice of r blocks is an entry.
    """
    r = 2 if budget <= 3 else 3
    return [tuple(map(int, np.concatenate(some))) for some in itertools.combinations(np.array_split(np.arange(64), budget + r), r)]


def block_masks(budget: int = BUDGET) -> list[int]:
    """The bits of each entry of blocks(), as signed longs."""
    masks = [sum(1 << (63 - b) for b in bits) for bits in blocks(budget)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def trie_pairs(values: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i < j) of sorted distinct uint64 values that differ in at most `budget` bits.

    A trie node is the range [lo, hi) of values that share a prefix. A pair of nodes (with itself or a later one)
    splits at each bit into the pairs of their children.
    """
    n = len(values)
    alo = blo = np.zeros(1, np.int64)
    ahi = bhi = np.full(1, n, np.int64)
    spent = np.zeros(1, np.int64)
    for bit in range(63, -1, -1):
        before = np.concatenate(([0], np.cumsum((values >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)))
        amid = ahi - (before[ahi] - before[alo])
        bmid = bhi - (before[bhi] - before[blo])
        same = alo == blo
        parts = []
        for al, ah, bl, bh, cost in ((alo, amid, blo, bmid, 0), (amid, ahi, bmid, bhi, 0), (alo, amid, bmid, bhi, 1), (amid, ahi, blo, bmid, 1)):
            keep = (al < ah) & (bl < bh) & (spent + cost <= budget)
            if cost and al is amid:
                keep &= ~same  # of a node with itself, the two children meet once
            if not cost:
                keep &= ~(same & (ah - al == 1))  # one value alone has no partner in itself
            parts.append((al[keep], ah[keep], bl[keep], bh[keep], spent[keep] + cost))
        alo, ahi, blo, bhi, spent = map(np.concatenate, zip(*parts, strict=True))
    return alo, blo


def _forest(n: int, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Those pairs that join two components so far."""
    parent, kept = list(range(n)), []

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        if (x := root(a)) != (y := root(b)):
            parent[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _links_of_tasks(budget: int):
    """For sorted rows (key, fp) of a task, the links within each key."""

    def close(fps: list[np.ndarray]) -> list[tuple[int, int]]:
        values = np.unique(np.concatenate(fps).view(np.uint64))
        if len(values) < 2:
            return []
        signed = values.view(np.int64)
        return [(int(signed[a]), int(signed[b])) for a, b in _forest(len(values), *trie_pairs(values, budget))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        names = ["src", "dst"]
        out = lambda links: pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names)
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in (0, 1)], axis=1)
            fps = batch.column(2).to_numpy()
            if not len(fps):
                continue
            starts = np.concatenate(([0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(fps)]))
            links, last_group = [], len(starts) - 2
            # a key that begins and ends in this batch with one fingerprint has no links
            worth = np.flatnonzero(starts[1:] - starts[:-1] > 1)
            for g in np.union1d(worth, [0, last_group]).tolist():
                a, b = starts[g], starts[g + 1]
                key = (int(keys[a, 0]), int(keys[a, 1]))
                if key != last:
                    if held:
                        links += close(held)
                    held, last = [], key
                held.append(fps[a:b])
            yield out(links)
        if held:
            yield out(close(held))

    return run


def fingerprint_links(fingerprints: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(src, dst): links between distinct fingerprints (column fp) that join all that differ in at most `budget` bits.

    Of the links within one key, those that its components don't need are left out.
    """
    keys = F.array(*[F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(block_masks(budget))])
    dealt = fingerprints.select(F.explode(keys).alias("x"), "fp").select(F.col("x.k").alias("k"), F.col("x.key").alias("key"), "fp")
    dealt = dealt.repartition("k", "key").sortWithinPartitions("k", "key")
    return dealt.mapInArrow(_links_of_tasks(budget), "src long, dst long")


def simhash_components(documents: DataFrame, budget: int = BUDGET, words: int = WORDS) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links."""
    prints = materialize(documents.select("doc_id", fingerprints("text", words).alias("fp")), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    groups = materialize(components(fingerprint_links(distinct.select("fp"), budget)), "groups")
    # of each fingerprint the smallest doc_id, and of each component the smallest of those
    rooted = distinct.join(groups, distinct["fp"] == groups["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = materialize(rooted.join(smallest, "root").select("fp", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_components(table(spark, sf_dir, "documents"))
    return out.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")
