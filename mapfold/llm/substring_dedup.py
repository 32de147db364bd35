"""Exact removal of long token passages that occur more than once, by de Bruijn compaction.

A passage is `window` consecutive words. Of every window, the k-mer of smallest hash is an anchor; windows of equal
words have equal anchors, so anchors are the nodes of a sparse de Bruijn graph of the corpus. An edge leads from an
anchor over the words up to the anchor that completes every window which starts before the next anchor; its key is
a 128-bit hash of those words. The steps, all keyed joins and sums over anchors, about one for each fourteen words:

1. Nodes that occur once are dropped: no window around them repeats.
2. Edges between the other nodes are counted; those that occur twice make the graph. Which edge follows which is
   counted too: where one edge alone leads on to one edge alone, the path doesn't branch. Such paths compact by
   pointer doubling: joins of the edges with themselves, until each knows its path's first edge and its place on it.
3. A document's edges that follow each other on a path, along one other document, its source, compact into a long
   span. Of each span, the words at the source's coordinates are digested (SHA-256) and compared with the
   document's own; only a span of the same words is removed.
4. What is left are windows whose smallest k-mer is a repeated node but that lie on no repeated edge, at the ends of
   passages and where paths branch. These are looked up one by one, among themselves and among the windows of
   one source, the representative, of each repeated edge, each read at its own coordinates: they too are the same only if
   the digests (SHA-256) of their words are. So the shuffled windows grow with distinct repeated text, not with the
   number of its copies.
5. The words that a repeated window covers go.

Texts move twice: to those of their windows and spans that are looked up, and to what is found. A hot passage is one
row per task after partial sums. Joins on hot keys have an exchange on either side, so that Spark's adaptive skew handling
can split them. Spans are cut every CUT edges of a path, so the parts of a source that are asked for grow with its length only.
Lineage is cut by tables in the shared folder; those that the result doesn't read are deleted.

Nulls and empty texts have no words. Texts shorter than a window lose nothing. Repeated rows are copies of each
other, and lose what they repeat. Of equal smallest k-mers in a window all are anchors. A very long text is one row, of
which a task holds its hashes too. An empty table gives an empty result. Extra columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial
from itertools import compress, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table
from .common import materialize as write_table

#: Words of a window and of an anchor.
WINDOW, K = 35, 8
#: Odd multipliers of the two word-sequence hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
#: Edges after which a span is cut.
CUT = 8
#: A table whose shuffle files go at once: there are over a dozen, and the disk would hold the files of all.
materialize = partial(write_table, free=True)
#: Bytes of texts that are read together; a longer text is read by itself.
TOGETHER = 1 << 20
#: Which bytes are white space.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: The first n bytes of a word of eight.
FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def slide(a: np.ndarray, size: int, op: np.ufunc) -> np.ndarray:
    """op (minimum or maximum) over each run of `size` entries."""
    width = 1
    while 2 * width <= size:
        a = op(a[:-width], a[width:])
        width *= 2
    return op(a[: len(a) - (size - width)], a[size - width :]) if size > width else a


def hash_words(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words joined[start:end], of eight bytes at a time: words of one length of up to eight differ in theirs."""
    padded = np.concatenate((joined, np.zeros(8, np.uint8)))
    eight = np.ndarray((len(joined) + 1,), "<u8", padded, 0, (1,))  # at each place, the eight bytes from there on
    at, left = starts, ends - starts
    out = left.astype(np.uint64) * np.uint64(BASES[0])
    live = np.arange(len(starts))
    while len(live):
        x = out[live] ^ (eight[at] & FIRST[np.minimum(left, 8)])
        for shift, factor in ((32, 0xBEA225F9EB34556D), (29, 0xD6E8FEB86659FD93)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(factor)
        out[live] = x ^ (x >> np.uint64(32))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def read_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of texts whose words are apart by one space, where each word starts and ends, and each text's first word, with the number of all."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    space = SPACE[data]
    before = np.concatenate(([True], space))  # at each byte: whether no word leads up to it
    before[offsets] = True
    after = np.concatenate((space, [True]))
    after[offsets] = True
    starts, ends = np.flatnonzero(~space & before[:-1]), np.flatnonzero(~space & after[1:]) + 1
    first = np.searchsorted(starts, offsets)
    dropped = space & before[:-1]
    gone = np.flatnonzero(dropped)
    joined = np.where(space, np.uint8(0x20), data)
    if len(gone):
        joined, starts, ends = joined[~dropped], starts - np.searchsorted(gone, starts), ends - np.searchsorted(gone, ends)
    return joined, starts, ends, first


def parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts of up to TOGETHER bytes, or of one text."""
    sizes, a, held = pc.fill_null(pc.binary_length(texts), 0).to_pylist(), 0, 0
    for i, size in enumerate(sizes):
        if i > a and held + size > TOGETHER:
            yield a, i
            a, held = i, 0
        held += size
    if a < len(sizes):
        yield a, len(sizes)


class Hasher:
    """Hashes of all word sequences of a text from running sums."""

    def __init__(self):
        self.powers = [(np.ones(1, np.uint64), np.ones(1, np.uint64)) for _ in BASES]

    def words(self, tokens: list[bytes]) -> np.ndarray:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
        return hash_words(np.frombuffer(b" ".join(tokens), np.uint8), np.concatenate(([0], ends[:-1] + 1))[: len(tokens)], ends)

    def sums(self, words: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
        """Running sums of word x base^-i, and base^i."""
        base, n = BASES[which], len(words) + 1
        if len(self.powers[which][0]) < n:
            size = max(n, 2 * len(self.powers[which][0]))
            up, down = np.full(size, base, np.uint64), np.full(size, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.powers[which] = (np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64))
        up, down = self.powers[which]
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * down[: n - 1], dtype=np.uint64))), up

    @staticmethod
    def spans(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the words [start, end), by their content alone."""
        total, up = sums
        x = (total[end] - total[start]) * up[start] + (end - start).astype(np.uint64)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xBEA225F9EB34556D)
        return x ^ (x >> np.uint64(29))


def anchors_of(hashes: np.ndarray, window: int = WINDOW, k: int = K) -> np.ndarray:
    """Positions of k-mers that are smallest in some window, by the k-mers' hashes; ties are all taken."""
    width = window - k + 1
    least = slide(hashes, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    return np.flatnonzero(slide(np.concatenate((edge, least, edge)), width, np.maximum) == hashes)


def graph_rows(words: np.ndarray, first: np.ndarray, hasher: Hasher, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Of texts' anchors: how many each text has; positions, ends of the window starts their edges cover, node hashes and both edge hashes.

    words: hashes of all texts' words, of which text i has first[i] to first[i + 1] - 1. A text's start counts as an anchor. The edge at an
    anchor covers every window that starts there or later, before the next anchor; near the text's end there may be none.
    """
    n, size = len(words), np.diff(first)
    if not (size >= window).any():
        return (np.zeros(len(size), np.int64), *[np.zeros(0, np.int64)] * 2, *[np.zeros(0, np.uint64)] * 3)
    stop, begin = np.repeat(first[1:], size), np.repeat(first[:-1], size)
    one, two, at = hasher.sums(words, 0), hasher.sums(words, 1), np.arange(n - k + 1)
    nodes = hasher.spans(one, at, at + k)
    width = window - k + 1
    least = slide(nodes, width, np.minimum)
    least[at[: len(least)] + window > stop[: len(least)]] = 0  # no window goes over a text's end
    edge = np.zeros(width - 1, np.uint64)
    inside = (at + k <= stop[: len(at)]) & (stop - begin >= window)[: len(at)]
    every = np.flatnonzero((slide(np.concatenate((edge, least, edge)), width, np.maximum) == nodes) & inside)
    pos = np.union1d(every, first[:-1][size >= window])
    low, high = begin[pos], stop[pos]
    until = np.minimum(np.append(pos[1:], n), high)
    need = np.minimum(until - 1, high - window) + window
    j = np.searchsorted(every + k, need)
    end = np.minimum(np.append(every + k, n)[j], high)
    count = np.bincount(np.searchsorted(first, pos, side="right") - 1, minlength=len(size))
    return count, pos - low, np.minimum(until, high - window + 1) - low, nodes[pos], hasher.spans(one, pos, end), hasher.spans(two, pos, end)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.astype(np.uint64).view(np.int64)


def _extents(starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[list[int], list[int]]:
    """Where each text's words start and end; both 0 for a text without words."""
    some = np.diff(first) > 0
    low, high = np.zeros(len(some), np.int64), np.zeros(len(some), np.int64)
    low[some], high[some] = starts[first[:-1][some]], ends[first[1:][some] - 1]
    return low.tolist(), high.tolist()


def _scan(window: int, k: int):
    """Per document: words, digest of its words, and its anchors that start a window, with all nodes of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            for low, high in parts(batch.column(3)):
                part = batch.slice(low, high - low)
                joined, starts, ends, first = read_words(part.column(3))
                n_words, text = np.diff(first), memoryview(joined)
                digests = [hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(*_extents(starts, ends, first), strict=True)]
                count, *lists = graph_rows(hash_words(joined, starts, ends), first, hasher, window, k)
                offsets = np.concatenate(([0], np.cumsum(count))).astype(np.int32)
                columns = [_signed(x) for x in lists]
                last = offsets[1:][np.diff(offsets) > 0] - 1
                for c in (3, 4):  # of each edge the one that follows
                    columns.append(np.append(columns[c][1:], 0)[: len(columns[c])])
                    columns[-1][last] = 0
                arrays = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in columns]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n_words, pa.int64()), pa.array(digests, pa.string()), *arrays], ["doc_id", "d", "t", "n_words", "digest", "pos", "until", "h", "s1", "s2", "n1", "n2"])

    return run


def digest_of(words: bytes) -> tuple[int, int]:
    """128 bits of SHA-256, as two signed longs."""
    found = np.frombuffer(hashlib.sha256(words).digest(), "<i8", 2)
    return int(found[0]), int(found[1])


def digests_of(text: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """digest_of each part text[start:end], one row each."""
    every = b"".join([hashlib.sha256(text[a:b]).digest()[:16] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)])
    return np.frombuffer(every, "<i8").reshape(-1, 2)


def values_of(lists: pa.ListArray, field: str | None = None) -> list[np.ndarray]:
    """The values of each list, or those of a field of them; none for null."""
    values, ends = (lists.values.field(field) if field else lists.values).to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    empty = values[:0]
    return [values[a:b] if ok else empty for a, b, ok in zip(ends[:-1].tolist(), ends[1:].tolist(), lists.is_valid().to_pylist(), strict=True)]


LOOKED = ["w1", "w2", "n", "d", "t", "start", "what"]
ASK, SHOW, SLICE = 1, 0, 2


#: Documents and rows after which a task hands on what it has looked up.
HANDED = 500, 50_000


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of the places 0 to size - 1 lie in one of the intervals [start, end)."""
    steps = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(steps)[:size] > 0


def _windows(window: int, k: int):
    """What is looked up of a document, as digests of n windows that start one after the other: its undecided windows (what:
    ASK; n is 1), those that others may ask for (SHOW), and its slices that others' spans are compared with (SLICE)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, held, digests, rows, docs = Hasher(), [], [], 0, 0

        def looked() -> pa.RecordBatch:
            size, d, t, what = (np.array(c, np.int64) for c in zip(*[x[:4] for x in held], strict=True))
            start, n = (np.concatenate(c) for c in zip(*[x[4:] for x in held], strict=True))
            types = [np.int64] * 5 + [np.int32] * 2
            columns = [*np.concatenate(digests).T, n, np.repeat(d, size), np.repeat(t, size), start, np.repeat(what, size)]
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c, ty)) for c, ty in zip(columns, types, strict=True)], LOOKED)

        for batch in batches:
            owners = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            marked, span_a, span_b, show_a, show_b = map(values_of, batch.columns[3:8])
            slice_a, slice_n = values_of(batch.column(8), "a"), values_of(batch.column(8), "n")
            for low, high in parts(batch.column(2)):
                joined, every_start, every_end, first = read_words(batch.column(2).slice(low, high - low))
                text = memoryview(joined)
                for i, f, l in zip(range(low, high), first[:-1].tolist(), first[1:].tolist(), strict=True):
                    starts, ends = every_start[f:l], every_end[f:l]
                    n, picks = l - f, []
                    if len(marked[i]):  # a window whose smallest k-mer is a node that occurs once can't repeat
                        at = np.arange(n - k + 1)
                        words = hash_words(joined[starts[0] : ends[-1]], starts - starts[0], ends - starts[0])
                        hashes = hasher.spans(hasher.sums(words, 0), at, at + k)
                        known, least = np.sort(hashes[marked[i]]), slide(hashes, window - k + 1, np.minimum)
                        asked = known[np.minimum(np.searchsorted(known, least), len(known) - 1)] == least
                        picks.append((np.flatnonzero(asked & ~covered(n - window + 1, span_a[i], span_b[i])), 1, ASK))
                    if len(show_a[i]):
                        picks.append((np.flatnonzero(covered(n - window + 1, show_a[i], show_b[i])), 1, SHOW))
                    picks.append((slice_a[i], slice_n[i], SLICE))
                    for begin, size, what in picks:
                        if m := len(begin):
                            digests.append(digests_of(text, starts[begin], ends[begin + size + window - 2]))
                            held.append((m, *owners[i], what, begin, np.full(m, size) if what != SLICE else size))
                            rows += m
                    docs += 1
                    if held and (docs >= HANDED[0] or rows >= HANDED[1]):
                        yield looked()
                        held, digests, rows, docs = [], [], 0, 0
        if held:
            yield looked()

    return run


def _strip(window: int, keep_text: bool):
    """What is left of documents, by their spans of the source's words and their repeated single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                claimed, fields = part.column(3), [pc.list_flatten(part.column(3)).field(c).to_pylist() for c in ("a", "b", "w1", "w2")]
                claims = zip(*fields, strict=True)
                sizes = pc.fill_null(pc.list_value_length(claimed), 0).to_pylist()
                for d, t, text, n_spans, starts in zip(*[c.to_pylist() for c in part.columns[:3]], sizes, values_of(part.column(4)), strict=True):
                    tokens = text.encode().split()
                    spans = [(a, b - 1 + window) for a, b, *digest in islice(claims, n_spans) if digest_of(b" ".join(tokens[a : b - 1 + window])) == tuple(digest)]
                    whole = np.array(spans, np.int64).reshape(-1, 2)
                    left = ~covered(len(tokens), np.concatenate((whole[:, 0], starts)), np.concatenate((whole[:, 1], starts + window)))
                    kept = list(compress(tokens, left.tolist()))
                    left = b" ".join(kept)
                    out.append((d, t, len(tokens) - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if keep_text else None))
                columns = list(zip(*out, strict=True))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(columns, types, strict=True)], ["d", "t", "n_removed", "digest", "kept"])

    return run


MARK = ["pos", "until", "h", "state", "path", "place", "sd", "st", "sp"]
SPAN_TYPE = "array<struct<a:int,b:int,sd:long,st:long,sa:int>>"


def _lists(owner: np.ndarray, rows: int, values: pa.Array) -> pa.ListArray:
    """One list for each of `rows` rows, of values in the order of the rows that own them."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)), values)


def _structs(**fields: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields))


def _spans(window: int, k: int):
    """Of documents' repeated nodes: what the lookup of spans and single windows needs.

    state: 0 the node's edge occurs once, 1 it repeats, 2 that and this is its representative. path, place: where on
    the graph the edge lies; sd, st, sp: its source.
    nodes: positions. spans: window starts on repeated edges, with the source's first; edges that follow each other on a path and
    along the source as one. asked: nodes in windows still undecided. shown: window starts along represented
    edges, by each node that such windows hold.
    """
    reach = window - k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, lists = batch.num_rows, batch.column(3)
            marks = lists.flatten()
            get = lambda c: pa.array(marks.field(c)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: E731, B023
            owner = np.repeat(np.arange(rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            order = np.lexsort((get("pos"), owner))
            owner, (pos, until, h, state, path, place, sd, st, sp) = owner[order], (get(c)[order] for c in MARK)
            key = (owner << 32) + pos  # positions are under 2**31

            # spans and what they cover, of the edges that repeat
            v = np.flatnonzero((state > 0) & (until > pos))
            before, here = v[:-1], v[1:]
            joins = (owner[before] == owner[here]) & (until[before] == pos[here])
            same = joins & (place[here] % CUT != 0) & (path[before] == path[here]) & (place[before] == place[here] - 1)
            same &= (sd[before] == sd[here]) & (st[before] == st[here]) & ((sp - pos)[before] == (sp - pos)[here])
            runs = lambda on: (v[np.flatnonzero(np.concatenate(([True], ~on))[: len(v)])], v[np.flatnonzero(np.concatenate((~on, [True]))[: len(v)])])  # noqa: E731, B023
            first, last = runs(same)
            spans = _lists(owner[first], rows, _structs(a=pos[first].astype(np.int32), b=until[last].astype(np.int32), sd=sd[first], st=st[first], sa=sp[first].astype(np.int32)))

            # nodes in windows outside of all spans
            first, last = runs(joins)
            stop = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)[owner]
            low, high = np.maximum(0, pos - reach), np.minimum(pos + 1, stop)
            j = np.searchsorted((owner[last] << 32) + until[last], (owner << 32) + high)
            over = np.append(first, 0)[j]
            open_ = (j == len(first)) | (owner[over] != owner) | (pos[over] > low)

            # represented edges under each node that their windows hold
            r = v[state[v] == 2]
            count = np.searchsorted(key, (owner[r] << 32) + until[r] - 1 + reach, side="right") - r
            edge = np.repeat(r, count)
            node = edge + np.arange(len(edge)) - np.repeat(np.cumsum(count) - count, count)
            shown = _structs(h=h[node], a=np.maximum(pos[edge], pos[node] - reach).astype(np.int32), b=np.minimum(until[edge], pos[node] + 1).astype(np.int32))

            arrays = [_lists(owner, rows, pa.array(pos.astype(np.int32))), spans, _lists(owner[open_], rows, pa.array(h[open_])), _lists(owner[edge], rows, shown)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *arrays], ["d", "t", "nodes", "spans", "asked", "shown"])

    return run


def compact_paths(links: DataFrame) -> DataFrame:
    """(s1, s2, p1, p2, place) of the edges that lie behind another on a path that doesn't branch: the path's first edge, and the place behind it.

    links: the distinct pairs (s1, s2, n1, n2) of an edge and one that follows it. Every round doubles how far an edge has
    looked back, so the rounds grow with the logarithm of the longest path. Edges on a ring that nothing leads into find no
    first edge, however far they look: once only such edges move on, they stay apart.
    """
    out = links.groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("s1", "s2")
    into = links.groupBy("n1", "n2").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("n1", "n2")
    only = links.join(out, ["s1", "s2"], "left_semi").join(into, ["n1", "n2"], "left_semi").where("s1 <> n1 or s2 <> n2")
    back = materialize(only.select(F.col("n1").alias("s1"), F.col("n2").alias("s2"), F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.lit(1).cast("long").alias("place"), F.lit(True).alias("moved")), "paths")
    before = back.count()
    while True:
        further = back.select(F.col("s1").alias("p1"), F.col("s2").alias("p2"), F.col("p1").alias("r1"), F.col("p2").alias("r2"), F.col("place").alias("more"))
        step = back.drop("moved").join(further, ["p1", "p2"], "left")
        step = step.select("s1", "s2", F.coalesce("r1", "p1").alias("p1"), F.coalesce("r2", "p2").alias("p2"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"), F.col("more").isNotNull().alias("moved"))
        then = materialize(step, "paths")
        discard(back)
        back, moved = then, then.where("moved").count()
        if moved == before or not moved:  # each round settles some edges of every path, and none of a ring
            return back.where("not moved").drop("moved")
        before = moved


def remove_repeats(documents: DataFrame, window: int = WINDOW, k: int = K, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, kept: the words that are left, joined by a space."""
    docs = documents.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("d"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"), "text")
    names = ["pos", "until", "h", "s1", "s2", "n1", "n2"]
    lists = ", ".join(f"{c} array<long>" for c in names)
    scanned = materialize(docs.mapInArrow(_scan(window, k), f"doc_id long, d long, t long, n_words long, digest string, {lists}"), "anchors")

    # 1. nodes that occur more than once
    each = scanned.select("d", "t", (F.col("n_words") - window + 1).cast("int").alias("stop"), F.explode(F.arrays_zip(*names)).alias("x"))
    each = each.select("d", "t", "stop", F.col("x.pos").cast("int").alias("pos"), F.col("x.until").cast("int").alias("until"), *[F.col(f"x.{c}") for c in names[2:]])
    # the sums are tables of their own, so that joins on a hot key have an exchange on either side and Spark can split it
    twice = materialize(each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "twice")
    nodes = materialize(each.join(twice, "h", "left_semi"), "nodes")
    discard(twice)

    # 2. edges that do, each with its first and last place, and the paths they lie on
    spot = F.struct("d", "t", "pos")
    edges = nodes.where("until > pos").groupBy("s1", "s2").agg(F.count(F.lit(1)).alias("n"), F.min(spot).alias("first"), F.max(spot).alias("last")).where("n > 1").drop("n")
    edges = materialize(edges, "edges")
    ends = edges.select("s1", "s2")
    links = nodes.where("until > pos").select("s1", "s2", "n1", "n2").distinct().join(ends, ["s1", "s2"], "left_semi")
    links = materialize(links.join(ends.toDF("n1", "n2"), ["n1", "n2"], "left_semi"), "follow")
    paths = compact_paths(links)
    placed = edges.join(paths, ["s1", "s2"], "left").select("s1", "s2", "first", "last", F.xxhash64(F.coalesce("p1", "s1"), F.coalesce("p2", "s2")).alias("path"), F.coalesce("place", F.lit(0)).alias("place"))
    placed = materialize(placed, "placed")
    for done in (links, paths, edges):
        discard(done)

    # 3. each document's spans, with a source: the first place, of the first itself the last
    state = F.when(F.col("first").isNull(), 0).when(F.col("first") == spot, 2).otherwise(1)
    source = F.when(F.col("first") == spot, F.col("last")).otherwise(F.col("first"))
    mark = F.struct("pos", "until", "h", state.alias("state"), "path", "place", source["d"].alias("sd"), source["t"].alias("st"), source["pos"].alias("sp"))
    marked = nodes.join(placed, ["s1", "s2"], "left").select("d", "t", "stop", mark.alias("mark"))
    marked = marked.groupBy("d", "t", "stop").agg(F.collect_set("mark").alias("marks"))
    marks = marked.mapInArrow(_spans(window, k), f"d long, t long, nodes array<int>, spans {SPAN_TYPE}, asked array<long>, shown array<struct<h:long,a:int,b:int>>")
    marks = materialize(marks, "marks")
    for done in (nodes, placed):
        discard(done)
    claims = marks.select("d", "t", F.explode("spans").alias("x")).select("d", "t", "x.*").withColumn("n", F.col("b") - F.col("a"))

    # 4. digests of the sources' words, and single windows at the ends of passages and at branches
    slices = claims.select(F.col("sd").alias("d"), F.col("st").alias("t"), F.struct(F.col("sa").alias("a"), "n").alias("s")).distinct().groupBy("d", "t").agg(F.collect_list("s").alias("slices"))
    asked = materialize(marks.select(F.explode("asked").alias("h")).distinct(), "asked")
    shown = marks.select("d", "t", F.explode("shown").alias("x")).select("d", "t", F.col("x.h").alias("h"), F.struct("x.a", "x.b").alias("s"))
    wanted = shown.join(asked, "h", "left_semi").groupBy("d", "t").agg(F.collect_list("s").alias("wanted"))
    lookup = marks.select("d", "t", F.when(F.size("asked") > 0, F.col("nodes")).alias("nodes"), F.col("spans.a").alias("a"), F.col("spans.b").alias("b")).join(wanted, ["d", "t"], "left").join(slices, ["d", "t"], "left")
    lookup = lookup.where("nodes is not null or wanted is not null or slices is not null")  # others are decided by their spans alone
    texts = docs.select("d", "t", "text").join(lookup, ["d", "t"]).select("d", "t", "text", "nodes", "a", "b", F.col("wanted.a").alias("from"), F.col("wanted.b").alias("to"), "slices")
    looked = materialize(texts.mapInArrow(_windows(window, k), "w1 long, w2 long, n long, d long, t long, start int, what int"), "windows")
    discard(asked)
    window_key = ["w1", "w2"]
    found = looked.where(F.col("what") != SLICE).groupBy(*window_key).agg(F.count(F.lit(1)).alias("times"), F.max("what").alias("asked")).where(f"times > 1 and asked = {ASK}").select(*window_key)
    found = materialize(found, "found")
    starts = looked.where(F.col("what") == ASK).join(found, window_key, "left_semi").groupBy("d", "t").agg(F.collect_set("start").alias("starts"))
    words = looked.where(F.col("what") == SLICE).select(F.col("d").alias("sd"), F.col("t").alias("st"), F.col("start").alias("sa"), F.col("n").cast("int").alias("n"), "w1", "w2").distinct()
    words = materialize(words, "words")
    spans = claims.join(words, ["sd", "st", "sa", "n"]).groupBy("d", "t").agg(F.collect_set(F.struct("a", "b", "w1", "w2")).alias("spans"))

    # 5. the words left
    decided = materialize(spans.join(starts, ["d", "t"], "full"), "decided")
    for done in (marks, looked, found, words):
        discard(done)
    left = docs.select("d", "t", "text").join(decided, ["d", "t"]).select("d", "t", "text", "spans", "starts")
    left = left.mapInArrow(_strip(window, keep_text), "d long, t long, n_removed long, digest string, kept string")
    left = left.groupBy("d", "t").agg(F.max("n_removed").alias("n_removed"), F.max("digest").alias("left_digest"), F.max("kept").alias("kept"))
    out = scanned.select("doc_id", "d", "t", "n_words", "digest").join(left, ["d", "t"], "left")
    columns = ["doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("left_digest", "digest").alias("kept_sha256")]
    if keep_text:
        out = out.join(docs.select("d", "t", "text").dropDuplicates(["d", "t"]), ["d", "t"])
        whole = F.array_join(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
        columns.append(F.when(F.col("left_digest").isNull(), whole).otherwise(F.col("kept")).alias("kept"))
    return out.select(*columns)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
