"""Best-fit packing of tokenised documents into sequences.

Every document's ids (and a separator after them) are cut into pieces of at most `length` tokens; only documents
longer than that are cut. Pieces are packed by bounded-space online best fit: a task keeps a fixed number of open
sequences in a bitset keyed by free space. A piece goes to the open sequence with the least free space that holds
it; if none does, a new one is opened, and where all places are taken the fullest closes first.

Tokenising is the costly part and needs no shuffle. What is packed are rows of piece sizes, dealt out by document;
Spark merges small partitions, so a task packs very many pieces and what stays open at its end weighs little.

Nulls are empty texts: one piece, the separator. Repeated rows are packed as documents of their own. An empty table
gives an empty result. Very long texts are tokenised whole, in their task. Of sequences with equal free space any takes a piece, and all are
equally full then. Extra columns play no part.
"""

from __future__ import annotations

import re
import sys
import types
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

LENGTH, OPEN, SEPARATOR = 2048, 512, 0
#: Most chunks whose ids a worker remembers.
REMEMBERED = 600_000
#: Mark of a word's last token.
WORD_END = "</w>"
#: Punctuation that stands between letters, digits and space; apostrophes and the marks of special tokens are no part of it.
_P, _SPACE = r"[.,;:!?()\[\]{}*#%$&+=/\"~@-]", r"\x20\x09-\x0D"
APART = re.compile(rf"({_P}(?<=[^\W_]{_P}|[{_SPACE}]{_P}){_P}*)(?=[^\W_]|[{_SPACE}])")
NAMES, TYPES = ["doc_id", "piece", "start", "length", "ids_crc32"], [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class ChunkTokenizer:
    """Ids of whole texts, as little-endian 32-bit bytes, from a tokenizer that drops white space and case.

    ASCII white space always ends a token, so texts are split there and each chunk is tokenised once while it is
    remembered. To have fewer different chunks, texts in Latin-1 are lowered and plain punctuation between letters,
    digits and space is set apart first: the tokenizer splits there anyway, and lowers letter by letter. New chunks
    of letters alone are one word to the tokenizer and go through it together; others go by themselves.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.last = np.zeros(self.tokenizer.get_vocab_size(), bool)  # ids that end a word
        self.last[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(WORD_END)]] = True

    def _split(self, text: str) -> list[bytes]:
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text.encode("utf-8", "replace").split()
        return APART.sub(r" \1 ", f" {text.lower()} ").encode().split()

    def _learn(self, new: list[bytes]) -> None:
        known, words, odd = self.known, [], []
        for c in new:
            w = c.decode()
            (words if w.isalpha() else odd).append(w)
        for at in range(0, len(words), 10_000):
            part = words[at : at + 10_000]
            ids = self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids
            ends = (np.flatnonzero(self.last[ids]) + 1) * 4
            if len(ends) != len(part):
                odd += part
                continue
            data, ends = array("I", ids).tobytes(), ends.tolist()
            known.update((w.encode(), data[a:b]) for w, a, b in zip(part, [0, *ends[:-1]], ends, strict=True))
        for at in range(0, len(odd), 10_000):
            part = odd[at : at + 10_000]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w.encode()] = array("I", e.ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        split = list(map(self._split, texts))
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        new = set().union(*split).difference(known)
        if new:
            self._learn(list(new))
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]


def worker_tokenizer(path: str) -> ChunkTokenizer:
    """The tokenizer of this Python worker, which keeps what it has learnt for the worker's further tasks."""
    kept = sys.modules.setdefault("_packing_worker", types.ModuleType("_packing_worker")).__dict__
    if path not in kept:
        kept[path] = ChunkTokenizer(path)
    return kept[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(documents: DataFrame, path: str, length: int = LENGTH, separator: int = SEPARATOR) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = worker_tokenizer(path), np.array([separator], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 200):  # few documents' ids at a time
                out = []
                part = [t or "" for t in texts.slice(at, 200).to_pylist()]
                for doc, data in zip(ids[at : at + 200], tokenizer.encode(part), strict=True):
                    data += end
                    for k, b in enumerate(range(0, len(data), 4 * length)):
                        piece = data[b : b + 4 * length]
                        out.append((doc, k, b // 4, len(piece) // 4, zlib.crc32(piece)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], NAMES)

    return documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


class BestFit:
    """Bounded-space best fit: at most `most_open` open bins, found by free space in a bitset (an int)."""

    def __init__(self, length: int = LENGTH, most_open: int = OPEN):
        self.length, self.most_open = length, most_open
        self.bits, self.bins, self.open, self.opened = 0, [[] for _ in range(length + 1)], 0, 0

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset) for a piece of `size` tokens."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.most_open:  # the fullest closes
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, free = self.opened, self.length
            self.opened += 1
        left = free - size
        if left:  # a full bin closes by itself
            self.bins[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.length - free

    def _take(self, free: int) -> int:
        bin_ = self.bins[free].pop()
        if not self.bins[free]:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_


def pack(rows: DataFrame, length: int = LENGTH, most_open: int = OPEN) -> DataFrame:
    """rows (doc_id, piece, start, length, ...) with sequence_id and offset.

    Rows are dealt out by document and sorted in a task, so a task that runs again gives the same sequences.
    """
    dealt = rows.repartition("doc_id", "start", "ids_crc32").sortWithinPartitions("doc_id", "start", "ids_crc32")
    at = rows.columns.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = BestFit(length, most_open), TaskContext.get().partitionId() << 40
        for batch in batches:
            spots = [packer.place(n) for n in batch.column(at).to_pylist()]
            more = [pa.array([first + b for b, _ in spots], pa.int64()), pa.array([o for _, o in spots], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.mapInArrow(run, f"{fields}, sequence_id long, offset long")


def pack_documents(documents: DataFrame, path: str | None = None, length: int = LENGTH, most_open: int = OPEN) -> DataFrame:
    return pack(pieces(documents, path or default_path(), length), length, most_open)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
