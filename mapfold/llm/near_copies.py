"""Near copies of a shingle similarity of about 0.8 and more, by wide SimHash fingerprints.

At that similarity two 64-bit fingerprints differ in some ten bits, give or take three: too many for keys of equal
bits, too few to tell a near copy from a looser likeness. Here a fingerprint has four words of 64 bits, each the
majority of the text's five-word shingles under a hash of its own, and texts link whose words differ in at most
BITS of the 256 bits. BITS lies where a similarity of 0.7 is expected, so that nearly all pairs of 0.8 link.

Like op8's, fingerprints are dealt out under keys of equal bits (two of four blocks of the first word), so that texts
whose first words differ in two bits at most always meet. At 0.8 they differ in more, so they are dealt out under
further keys too, the smallest shingle hash under each of the four hashes: two texts share one
with the probability of their similarity, so a pair of 0.8 has none in common in one case of six hundred. Inside a
key, the sorted fingerprints are a binary trie, whose nodes are ranges. A text is followed from the root, bit by bit, with the
number of bits that differ so far, and a branch is let go as soon as they exceed the budget; components are followed from
text to text, so that those found are in no later trie. A key of more than BLOCK texts is split into blocks, and each pair
of blocks is a trie by itself, so that no task holds a hot key and no text is left out.

With a `similarity`, links are exact: tries of fingerprints (here of the sets of shingles) only find candidates, with a budget
of WIDE bits and eight smallest hashes, of which a pair of 0.8 has none in common in one case of 390,000. The sets of the texts
that have a candidate join them in their blocks, and a pair links if its Jaccard similarity is at least that. A pair is
looked at under its first common key only; equal sets are one from the start.

Equal fingerprints are one from the start. Nulls and texts without words are copies of each other. Repeated rows are
copies; if such rows differ in other columns, the one whose hash is smallest stays. Very long texts: their sets of
shingles are made in a task, and shuffled only if they have a candidate. Empty tables give empty results. Extra columns
are kept, whatever their names; those that begin with two underscores are the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import components
from .simhash import block_masks, majority, shingle_hashes

WORDS, BITS, BLOCK = 5, 48, 1024
#: Groups of up to so many texts are compared together.
FEW = 12
#: Texts of a larger group that are followed in a trie at a time.
FRONT = 64
#: Odd steps that tell the four hashes apart.
STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
PRINT = ["f0", "f1", "f2", "f3"]
#: For exact links: differing bits of candidates (0.8 is expected at 39, give or take 6), and the hashes that give the keys.
WIDE = 80
MORE_STEPS = (*STEPS, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
MORE_KEYS = [f"k{i}" for i in range(len(MORE_STEPS))]
#: The first word's bits that texts have in common under one of the first keys.
MASKS = block_masks()
BLOCK_KEYS = [f"b{i}" for i in range(len(MASKS))]


def scrambled(hashes: np.ndarray, step: int) -> np.ndarray:
    """Another hash of the same shingles."""
    x = hashes + np.uint64(step)
    for shift in (32, 29, 32):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def wide_fingerprint(text: str | None, words: int = WORDS) -> tuple[list[int], list[int]]:
    """The four words of a text's fingerprint, and its four keys; zeros for a text without words."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return [0] * 4, [0] * 4
    each = [scrambled(hashes, s) for s in STEPS]
    return [majority(h) for h in each], [int(h.min()) for h in each]


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = np.array([sum(wide_fingerprint(x, words), []) for x in part.column(2).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *[pa.array(c) for c in rows.view(np.int64).T.copy()]], ["d", "t", *PRINT, "k0", "k1", "k2", "k3"])

    return run


def within(prints: np.ndarray, one: np.ndarray, other: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs one[i], other[i] of rows differ in at most `bits` bits; a pair is let go at the word that exceeds them."""
    left, spent = np.arange(len(one)), np.zeros(len(one), np.int64)
    for word in prints.T:
        spent = spent + np.bitwise_count(word[one[left]] ^ word[other[left]])
        left, spent = left[spent <= bits], spent[spent <= bits]
    return left


def trie_search(prints: np.ndarray, rows: np.ndarray, asked: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs asked[q], row of the rows rows[low[q]:high[q]] whose prints differ in at most `bits` bits; in that range, rows are sorted by their prints.

    Such a range is a trie, and a node of it the range of rows that share a prefix. Each asked print goes down from the
    root, to both children of a node; what it has spent is the number of bits in which it differs from the prefix.
    """
    q = np.flatnonzero(low < high)
    lo, hi, spent = low[q], high[q], np.zeros(len(q), np.int64)
    one, leaf = [], []
    for bit in range(64 * prints.shape[1]):
        alone = hi - lo == 1
        one.append(q[alone])
        leaf.append(lo[alone])
        q, lo, hi, spent = (x[~alone] for x in (q, lo, hi, spent))
        if not len(q):
            break
        of = (prints[:, bit // 64] >> np.uint64(63 - bit % 64)).astype(np.int64) & 1
        before = np.concatenate(([0], np.cumsum(of[rows])))
        mid, own = hi - (before[hi] - before[lo]), of[asked[q]]
        left, right = (lo < mid) & (spent + own <= bits), (mid < hi) & (spent + 1 - own <= bits)
        q, lo, hi, spent = np.concatenate((q[left], q[right])), np.concatenate((lo[left], mid[right])), np.concatenate((mid[left], hi[right])), np.concatenate(((spent + own)[left], (spent + 1 - own)[right]))
    size = hi - lo  # rows of one print
    one.append(np.repeat(q, size))
    leaf.append(np.repeat(lo, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    one, other = asked[np.concatenate(one)], rows[np.concatenate(leaf)]
    near = within(prints, one, other, bits)  # what leaves have beyond their prefix
    return one[near], other[near]


def sorted_rows(prints: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Rows by group, and by print in each."""
    return np.lexsort((*prints.T[::-1], group))


def every(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.arange(len(one))


def follow(prints: np.ndarray, rows: np.ndarray, bits: int, maybe=every, exact=every) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join each component of sorted rows: they link if they are within `bits` bits and both maybe and exact leave them.

    maybe is asked about many pairs at once, exact about those of one row and rows that are in no component yet.
    """
    alive, many = np.zeros(len(prints), bool), 1
    alive[rows] = True
    front, one, other = np.zeros(0, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    while len(rows := rows[alive[rows]]):
        fresh = not len(front)
        asked, front = (rows[:many], front) if fresh else (front[:FRONT], front[FRONT:])
        many = min(2 * many, FRONT)
        a, b = trie_search(prints, rows, asked, np.zeros(len(asked), np.int64), np.full(len(asked), len(rows)), bits)
        left = maybe(a, b)
        order = left[np.argsort(a[left], kind="stable")]
        a, b = a[order], b[order]
        starts, ends = np.searchsorted(a, asked), np.searchsorted(a, asked, side="right")
        for i, s, e in zip(asked.tolist(), starts.tolist(), ends.tolist(), strict=True):
            alive[i] = False
            near = b[s:e][alive[b[s:e]]]
            if len(near) and len(near := near[exact(np.full(len(near), i), near)]):
                alive[near] = False
                one.append(np.full(len(near), i))
                other.append(near)
                front = np.concatenate((front, near))
                if fresh:  # its component is followed to its end before another one is begun
                    many = 1
                    break
    return np.concatenate(one), np.concatenate(other)


def joined(prints: np.ndarray, starts: np.ndarray, bits: int, maybe=every, exact=every) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that join the components of each group of rows, as in follow(); starts: where groups start, and the end."""
    size = np.diff(starts)
    rows, few = sorted_rows(prints, np.repeat(np.arange(len(size)), size)), np.repeat(size <= FEW, size)
    at = np.flatnonzero(few)  # each row of a small group meets those behind it
    a, b = trie_search(prints, rows, rows, np.arange(len(rows)) + 1, np.where(few, np.repeat(starts[1:], size), 0), bits) if len(at) else (at, at)
    left = maybe(a, b)
    order = left[np.argsort(a[left], kind="stable")]
    a, b = a[order], b[order]
    cuts = np.flatnonzero(np.diff(a)) + 1
    good = [exact(x, y) + s for x, y, s in zip(np.split(a, cuts), np.split(b, cuts), [0, *cuts], strict=True)] if exact is not every else [every(a, b)]
    pairs = [(a[g], b[g]) for g in good] + [follow(prints, rows[starts[g] : starts[g + 1]], bits, maybe, exact) for g in np.flatnonzero(size > FEW)]
    return np.concatenate([x for x, _ in pairs]), np.concatenate([y for _, y in pairs])


def chains(prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that join each component of rows that differ in at most `bits` bits."""
    return follow(prints, sorted_rows(prints, np.zeros(len(prints), np.int64)), bits)


def _ordered(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["src", "dst"])


def _links(bits: int):
    """For rows sorted by group (i, key, x, y), then node and fingerprint: links within each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches):
            prints, node = _column(table, PRINT).view(np.uint64), table.column("node").to_numpy()
            one, other = joined(prints, starts, bits)
            yield _ordered(node[one], node[other])

    return run


def _blocks_of(nodes: DataFrame) -> DataFrame:
    """nodes, with the keys of equal bits of their first word."""
    return nodes.withColumns({c: F.col("f0").bitwiseAND(F.lit(m)) for c, m in zip(BLOCK_KEYS, MASKS, strict=True)})


def _dealt(rows: DataFrame, keys: list[str], carried: list[str], block: int) -> DataFrame:
    """(i, key, x, y, node, *carried), grouped and sorted: rows under each of their keys, in each pair of blocks they belong to."""
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.col(k).alias("key")) for i, k in enumerate(keys)]))
    dealt = rows.select(each.alias("k"), "node", *carried).select("k.i", "k.key", "node", *carried)
    # blocks grow with the root of a group, so that its rows don't grow with its square
    blocks = F.least(F.ceil(F.col("n") / block), F.ceil(F.sqrt(F.col("n") / (block // 16)))).cast("long")
    sizes = materialize(dealt.groupBy("i", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i", "key", F.greatest(F.lit(1), blocks).alias("blocks")), "sizes")
    dealt = dealt.join(sizes, ["i", "key"]).withColumn("own", F.pmod("node", "blocks"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return _grouped(dealt.select("i", "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "node", *carried))


def _grouped(dealt: DataFrame) -> DataFrame:
    return dealt.repartition("i", "key", "x", "y").sortWithinPartitions("i", "key", "x", "y")


def wide_links(prints: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """(src, dst): links that join the nodes (node, f0 to f3, k0 to k3) which share a key and differ in at most `bits` bits."""
    return _dealt(_blocks_of(prints), [*BLOCK_KEYS, "k0", "k1", "k2", "k3"], PRINT, block).mapInArrow(_links(bits), "src long, dst long")


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(shingle_hashes(text, words))


def set_row(text: str | None, words: int = WORDS) -> list[int]:
    """node, size, fingerprint and keys of a text's set of shingles; zeros for a text without words."""
    hashes = shingle_set(text, words)
    if not len(hashes):
        return [0] * (2 + len(PRINT) + len(MORE_KEYS))
    each = [scrambled(hashes, s) for s in MORE_STEPS]
    return [xxhash.xxh64_intdigest(hashes.tobytes()), len(hashes), *[majority(h) for h in each[: len(PRINT)]], *[int(h.min()) for h in each]]


SET_COLUMNS = ["node", "size", *PRINT, *MORE_KEYS]


def _set_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                rows = np.array([set_row(x, words) for x in part.column(2).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *[pa.array(c) for c in rows.view(np.int64).T.copy()]], ["d", "t", *SET_COLUMNS])

    return run


def _sets(words: int):
    """For rows (node, text): node and the set of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                sets = [np.sort(shingle_set(x, words).view(np.int64)) for x in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))
                yield pa.RecordBatch.from_arrays([part.column(0), held], ["node", "hashes"])

    return run


def whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of rows sorted by group (the first four columns), cut between groups, with where groups start and the end."""

    def starts(table: pa.RecordBatch) -> np.ndarray:
        group = np.stack([c.to_numpy() for c in table.columns[:4]], axis=1)
        return np.concatenate(([0], np.flatnonzero((group[1:] != group[:-1]).any(axis=1)) + 1, [len(group)]))

    held = None
    for batch in batches:
        if batch.num_rows:
            held = batch if held is None else pa.concat_batches([held, batch])
            at = starts(held)
            if len(at) > 2:  # the last group may go on
                yield held.slice(0, at[-2]), at[:-1]
                held = held.slice(at[-2])
    if held is not None:
        yield held, starts(held)


def _column(table: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([table.column(c).to_numpy() for c in names], axis=1)


def _candidate(table: pa.RecordBatch, prints: np.ndarray, similarity: float):
    """Tells which pairs one[i], other[i] of rows may be of that similarity and have no key before this one in common."""
    size, turn = table.column("size").to_numpy(), table.column("i").to_numpy()
    keys = np.concatenate((prints[:, :1].view(np.int64) & np.array(MASKS), _column(table, MORE_KEYS)), axis=1)

    def maybe(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        a, b = size[one], size[other]
        left = np.flatnonzero(np.minimum(a, b) / np.maximum(a, b) >= similarity)
        met = (keys[one[left]] == keys[other[left]]) & (np.arange(keys.shape[1]) < turn[one[left]][:, None])
        return left[~met.any(axis=1)]

    return maybe


def _candidates(similarity: float):
    """For dealt rows: the rows (i, key, x, y, node) that have a candidate in their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches):
            prints, marked = _column(table, PRINT).view(np.uint64), np.zeros(table.num_rows, bool)
            one, other = joined(prints, starts, WIDE, _candidate(table, prints, similarity))
            marked[one] = marked[other] = True
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(marked)) for c in table.columns[:5]], ["i", "key", "x", "y", "node"])

    return run


def shared(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of the sorted set `one` each of the others holds."""
    together = np.concatenate(others)
    found = one[np.minimum(np.searchsorted(one, together), len(one) - 1)] == together
    return np.add.reduceat(found.astype(np.int64), np.cumsum([0, *map(len, others)])[:-1])


def _exact_links(similarity: float):
    """For candidates with their sets: links that join the nodes of each group whose similarity is enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches):
            prints, node, hashes = _column(table, PRINT).view(np.uint64), table.column("node").to_numpy(), table.column("hashes")
            values, ends = hashes.values.to_numpy(), hashes.offsets.to_numpy()

            def exact(one, others, values=values, ends=ends):  # one is the same in all pairs
                if not len(one):
                    return one
                sets = [values[ends[k] : ends[k + 1]] for k in others.tolist()]
                own = values[ends[one[0]] : ends[one[0] + 1]]
                both = shared(own, sets)
                return np.flatnonzero(both / (len(own) + np.array([len(x) for x in sets]) - both) >= similarity)

            a, b = joined(prints, starts, WIDE, _candidate(table, prints, similarity), exact)
            yield _ordered(node[a], node[b])

    return run


def exact_links(nodes: DataFrame, texts: DataFrame, similarity: float, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """(src, dst): links that join the nodes (d, t and SET_COLUMNS) of at least that similarity; texts: d, t, text."""
    carried = ["size", *PRINT, *MORE_KEYS]
    places = "i long, key long, x long, y long, node long"
    near = materialize(_dealt(_blocks_of(nodes.where("size > 0")), [*BLOCK_KEYS, *MORE_KEYS], carried, block).mapInArrow(_candidates(similarity), places), "candidates")
    asked = nodes.join(near.select("node").distinct(), "node", "left_semi")
    found = texts.join(asked.select("d", "t", "node"), ["d", "t"]).select("node", "text").mapInArrow(_sets(words), "node long, hashes array<long>")
    asked = asked.select("node", *carried).join(found.dropDuplicates(["node"]), "node")
    dealt = near.join(asked, "node").select("i", "key", "x", "y", "node", *carried, "hashes")
    return _grouped(dealt).mapInArrow(_exact_links(similarity), "src long, dst long")


def _named(prints: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """d, t, low_d, low_t of prints; nodes: node and its least (d, t)."""
    groups = materialize(components(links), "groups")
    rooted = nodes.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    rooted = materialize(rooted, "rooted")
    low = rooted.groupBy("root").agg(F.min("least").alias("low"))
    named = materialize(rooted.join(low, "root").select("node", "low"), "named")
    return prints.join(named, "node").select("d", "t", F.col("low.d").alias("low_d"), F.col("low.t").alias("low_t"))


def exact_copies(documents: DataFrame, similarity: float, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """near_copies() by exact similarity of the sets of shingles."""
    d, t = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")
    fields = ", ".join(f"{c} long" for c in ["d", "t", *SET_COLUMNS])
    prints = materialize(documents.select(d, t, "text").mapInArrow(_set_rows(words), fields), "set-prints")
    nodes = prints.groupBy("node").agg(F.min(F.struct("d", "t")).alias("least"), *[F.min(c).alias(c) for c in SET_COLUMNS[1:]])
    nodes = materialize(nodes, "nodes")
    links = exact_links(nodes.select("least.d", "least.t", *SET_COLUMNS), documents.select(d, t, "text"), similarity, words, block)
    return _named(prints.select("d", "t", "node"), nodes.select("node", "least"), links)


def near_copies(documents: DataFrame, bits: int = BITS, words: int = WORDS, block: int = BLOCK) -> DataFrame:
    """d, t, low_d, low_t of every row: its doc_id (null: the smallest long) and text hash, and the smallest of its component."""
    d, t = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t")
    fields = ", ".join(f"{c} long" for c in ["d", "t", *PRINT, "k0", "k1", "k2", "k3"])
    prints = documents.select(d, t, "text").mapInArrow(_prints(words), fields)
    prints = materialize(prints.withColumn("node", F.xxhash64(*PRINT)), "wide-prints")
    nodes = materialize(prints.groupBy("node").agg(F.min(F.struct("d", "t")).alias("least")), "nodes")
    # texts of one fingerprint may have other keys: each combination is dealt out
    keyed = prints.select("node", *PRINT, "k0", "k1", "k2", "k3").distinct()
    return _named(prints, nodes, wide_links(keyed, bits, block))


def drop_near_copies(documents: DataFrame, bits: int = BITS, words: int = WORDS, similarity: float | None = None) -> DataFrame:
    """documents, of each component the row of smallest doc_id kept (one, if it is repeated); a similarity makes links exact."""
    found = near_copies(documents, bits, words) if similarity is None else exact_copies(documents, similarity, words)
    keep = found.where("d = low_d and t = low_t").select(F.col("d").alias("__d"), F.col("t").alias("__t")).distinct()
    keyed = documents.withColumns({"__d": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__t": F.xxhash64(F.coalesce("text", F.lit("")))})
    row = [F.col(f"`{c}`") for c in documents.columns]
    one = F.min_by(F.struct(*row), F.xxhash64(*row)).alias("__row")
    return keyed.join(keep, ["__d", "__t"], "left_semi").groupBy("__d", "__t").agg(one).select("__row.*")
