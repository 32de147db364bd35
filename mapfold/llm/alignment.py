"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

Both tokenizers read the same bytes, a space and the text. Tokens are byte intervals. The intervals of the B tokens of
a text, which follow each other, are a static index; one bisection of each A token's start and end lists the B tokens
that it overlaps (its links). Where no B token spans the gap between two A tokens, a group ends: groups are the finest
cut of a text at places where tokens of both end.

A link's pair of ids (a, b) has a count over the whole corpus. It is one number, a x |B| + b, and a document keeps each
of its pairs once, with how often it has it. Counts are summed before they are shuffled. A document's links are then
valued by their pairs' counts: the `most_kept` most frequent pairs are sent to all tasks, a table of that size whatever
the input; pairs beyond them are joined by the pair, so every link is valued exactly, and the pairs that all documents
have are never shuffled with them.

Nulls, empty texts, and texts of which the joined bytes of either tokenizer aren't the text's (a tokenizer that drops or
changes characters, bytes that aren't UTF-8) have no tokens: their numbers are zero and their groups ''. Special tokens'
strings are plain text. Very long texts are tokenised and aligned whole, in their task; their groups' digest is made in
steps. Repeated rows, repeated and null doc_ids are documents of their own, and count as often as they stand there. Ties:
all pairs of a B id that share its highest count are its best ones. An empty table gives an empty result. Other columns
play no part, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, materialize, table

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: The most frequent pairs of ids, which every task gets: 16 bytes each.
MOST_KEPT = 500_000
#: Chunks whose ids a worker remembers; texts tokenised at a time; tokens whose numbers are written at a time.
REMEMBERED, TEXTS, STEP = 100_000, 200, 1_000_000
#: What stands for a space in pieces.
PIECE_SPACE = "▁"
DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
LINKS = f"uid long, {DIGEST}, pairs array<long>, times array<long>"


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies write bytes as letters: printable ones of Latin-1 stand for themselves, others for letters from 256 on, in order."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The bytes of each id, and their lengths."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.lengths = pieces, np.array([len(p) for p in pieces], np.int64)

    def __len__(self) -> int:
        return len(self.pieces)

    def joined(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


class ByteTokenizer(Vocabulary):
    """Byte-level BPE from a tokenizer's JSON file, of which the ids are in the order of the merges."""

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        letters, special = byte_of_letter(), {t["content"] for t in whole["added_tokens"]}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in whole["model"]["vocab"].items() if t not in special}
        pieces = [b""] * (max(ranks.values()) + 1)
        for p, i in ranks.items():
            pieces[i] = p
        super().__init__(pieces)
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.encoding.encode_ordinary(f" {t}"), np.int64) for t in texts]


class PieceTokenizer(Vocabulary):
    """Piece BPE with byte fallback, which puts a space before the text.

    No piece has a space after anything else, so that words apart by single spaces are tokenised by themselves, each once
    while it is remembered.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model, self.known = SentencePieceProcessor(model_file=path), {}
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        super().__init__([bytes([int(p[1:-1], 16)]) if self.model.is_byte(i) else p.replace(PIECE_SPACE, " ").encode() for i, p in enumerate(names)])
        self.apart = not any(PIECE_SPACE in p.lstrip(PIECE_SPACE) for p in names)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.split(" ") for t in texts]
        whole = [not self.apart or "" in s for s in split]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list(set().union(*[s for s, w in zip(split, whole, strict=True) if not w]).difference(self.known))
        self.known.update((c, np.array(ids, "<i4").tobytes()) for c, ids in zip(new, self.model.encode(new, num_threads=1), strict=True))
        one = lambda s: np.frombuffer(b"".join(map(self.known.__getitem__, s)), "<i4").astype(np.int64)
        return [np.array(self.model.encode(t), np.int64) if w else one(s) for t, s, w in zip(texts, split, whole, strict=True)]


class IntervalIndex:
    """A static index of byte intervals that follow each other: the ends of tokens of these lengths."""

    def __init__(self, lengths: np.ndarray):
        self.ends = np.cumsum(lengths)
        self.starts = self.ends - lengths

    def stab(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first interval that each of [starts, ends) overlaps, and the one after the last."""
        return np.searchsorted(self.ends, starts, "right"), np.searchsorted(self.starts, ends, "left")


class Alignment(NamedTuple):
    first: np.ndarray  # of each A token, the first B token that it overlaps
    after: np.ndarray  # and the one after the last
    a_ends: np.ndarray  # of each group, the number of A tokens up to its end
    b_ends: np.ndarray  # and of B tokens

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of the A and the B token of each link."""
        n = self.after - self.first
        a = np.repeat(np.arange(len(n)), n)
        return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first, n)


def align(a_lengths: np.ndarray, b_lengths: np.ndarray) -> Alignment:
    """The alignment of two sequences of tokens over the same bytes, by their lengths."""
    a = IntervalIndex(a_lengths)
    first, after = IntervalIndex(b_lengths).stab(a.starts, a.ends)
    gaps = np.flatnonzero(first[1:] >= after[:-1])  # gaps after these A tokens are spanned by no B token
    return Alignment(first, after, np.append(gaps + 1, len(a_lengths)), np.append(first[gaps + 1], len(b_lengths)))


class GroupWriter:
    """Digests of groups, written as `a1,a2|b1;a3|b2,b3`."""

    def __init__(self, n_a: int, n_b: int):
        ends = [(n_a, b","), (n_a, b"|"), (n_b, b","), (n_b, b";")]
        self.n_a, self.n_b, self.words = n_a, n_b, [b"%d%s" % (i, end) for n, end in ends for i in range(n)]

    def digest(self, a: np.ndarray, b: np.ndarray, found: Alignment) -> str:
        in_a, in_b = np.diff(found.a_ends, prepend=0), np.diff(found.b_ends, prepend=0)
        words = np.empty(len(a) + len(b), np.int64)
        a_words, b_words = a.copy(), b + 2 * self.n_a
        a_words[found.a_ends - 1] += self.n_a
        b_words[found.b_ends - 1] += self.n_b
        words[np.arange(len(a)) + np.repeat(found.b_ends - in_b, in_a)] = a_words
        words[np.arange(len(b)) + np.repeat(found.a_ends, in_b)] = b_words
        made = hashlib.sha256()
        for at in range(0, len(words), STEP):
            text = b"".join(map(self.words.__getitem__, words[at : at + STEP].tolist()))
            made.update(text if at + STEP < len(words) else text[:-1])
        return made.hexdigest()


class Aligner:
    """Both tokenizers of a worker, and what it makes of a text."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = ByteTokenizer(a_path), PieceTokenizer(b_path)
        self.writer = GroupWriter(len(self.a), len(self.b))

    def tokens(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of both for each text; None for those without tokens."""
        read = [(t or b"").decode("utf-8", "replace") for t in texts]
        for data, a, b in zip(texts, self.a.encode(read), self.b.encode(read), strict=True):
            whole = b" " + data if data else None
            yield (a, b) if whole and self.a.joined(a) == whole == self.b.joined(b) else None

    def row(self, ids: tuple[np.ndarray, np.ndarray] | None) -> tuple:
        """n_a, n_b, n_groups, n_links, groups_sha256, pairs, times."""
        if ids is None:
            return 0, 0, 0, 0, "", [], []
        a, b = ids
        found = align(self.a.lengths[a], self.b.lengths[b])
        at_a, at_b = found.links()
        pairs, times = np.unique(a[at_a] * len(self.b) + b[at_b], return_counts=True)
        return len(a), len(b), len(found.a_ends), len(at_a), self.writer.digest(a, b, found), pairs, times


@functools.cache
def worker_aligner(a_path: str | None, b_path: str | None) -> Aligner:
    """The aligner of this Python worker, which keeps what it has learnt; the tokenizers' places are looked up where it runs."""
    import public_tokenizers

    return Aligner(a_path or public_tokenizers.path(A_FILE), b_path or public_tokenizers.path(B_FILE))


def links(documents: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """uid (of a row), doc_id, the numbers and the groups' digest of each document, and its pairs of ids with how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, uid = worker_aligner(a_path, b_path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                part = batch.slice(at, TEXTS)
                rows = list(zip(*map(aligner.row, aligner.tokens(part.column(1).to_pylist())), strict=True))
                ends = np.cumsum([0, *map(len, rows[5])])
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(r).astype(np.int64))) for r in rows[5:]]
                numbers = [pa.array(r, pa.int64()) for r in rows[:4]]
                uids = pa.array(np.arange(uid, uid + len(part)), pa.int64())
                yield pa.RecordBatch.from_arrays([uids, part.column(0), *numbers, pa.array(rows[4]), *lists], [c.split()[0] for c in LINKS.split(", ")])
                uid += len(part)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, LINKS)


def pair_counts(found: DataFrame, n_b: int) -> DataFrame:
    """(pair, count, best): how many links hold each pair of ids, and whether that is the highest of its B id."""
    each = found.select(F.explode(F.arrays_zip("pairs", "times")).alias("x"))
    counted = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.times").alias("count"))
    most = F.max("count").over(Window.partitionBy(F.col("pair") % n_b))  # at most as many rows as A has ids
    return counted.withColumn("best", F.col("count") == most)


def valued(found: DataFrame, counts: DataFrame, most_kept: int = MOST_KEPT) -> DataFrame:
    """The rows of links() with n_best and count_sum. counts: a table of pair_counts()."""
    spark = found.sparkSession
    top = counts.orderBy(F.desc("count"), "pair").limit(most_kept).toArrow().sort_by("pair")
    kept = spark.sparkContext.broadcast([top.column(c).to_numpy() for c in ("pair", "count", "best")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = kept.value
        for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, len(b), TEXTS)):
            pairs, times = batch.column("pairs"), batch.column("times").flatten().to_numpy()
            ends = np.cumsum([0, *(pairs.value_lengths().to_numpy())])
            pairs = pairs.flatten().to_numpy()
            at = np.searchsorted(keys, pairs)
            at[at == len(keys)] = 0
            there = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            own = np.where(there, times, 0)
            summed = lambda x: pa.array(np.diff(np.concatenate([[0], np.cumsum(x)])[ends]), pa.int64())
            rest = pa.array(np.concatenate([[0], np.cumsum(~there)])[ends], pa.int32())
            lists = [pa.ListArray.from_arrays(rest, pa.array(x[~there], pa.int64())) for x in (pairs, times)]
            sums = [summed(own * best[at]), summed(own * n[at])] if len(keys) else [summed(own), summed(own)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *sums, *lists], [*batch.schema.names[:-2], "n_best", "count_sum", "pairs", "times"])

    part = materialize(found.mapInArrow(run, f"uid long, {DIGEST}, n_best long, count_sum long, pairs array<long>, times array<long>"), "valued")
    rest = part.select("uid", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("uid", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rest.join(counts, "pair").groupBy("uid").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("count")).alias("_sum"))
    more = lambda c, d: (F.col(c) + F.coalesce(F.col(d), F.lit(0))).alias(c)
    return part.drop("pairs", "times").join(rest, "uid", "left").select("uid", *[c.split()[0] for c in DIGEST.split(", ")], more("n_best", "_best"), more("count_sum", "_sum"))


def align_documents(documents: DataFrame, a_path: str | None = None, b_path: str | None = None, most_kept: int = MOST_KEPT) -> DataFrame:
    """One row for each document: its numbers of tokens, groups and links, how many links are of their B id's best pair, and the sum of their counts."""
    found = materialize(links(documents, a_path, b_path), "links")
    counts = materialize(pair_counts(found, len(worker_aligner(a_path, b_path).b)), "pairs")
    out = valued(found, counts, most_kept)
    discard(found)
    return out.drop("uid")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
