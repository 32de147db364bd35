"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is a sequence of words (lower case, ASCII punctuation set apart). Each word goes in as a word vector, found
by hash, plus the mean of the vectors of its character n-grams and the greatest of their first entries, so that unseen words
get a vector from their spelling. The network reads overlapping windows of `SPAN` words, every `STEP` words, in both directions; attention
over the states pools a window into one logit. A document's score is that of its most toxic window. Training is
numpy, by backpropagation through time and Adam, on a bounded sample of labelled documents on the driver: at most
MOST_TRAINED labelled rows of at most LONGEST_TRAINED characters, those of smallest hash of doc_id. The first entry of
a word's or n-gram's vector is counted, not trained: the smoothed log-odds of the label in the sample. The other entries start
at random and are trained with the network, by Adagrad on the rows a batch holds; vectors of words and n-grams that the
sample doesn't hold stay random. Scoring runs in tasks over all windows of whole texts.

Nulls and empty texts have one window without words and get the score of the bias. Without labels of both kinds,
every score is 0. Repeated rows get equal scores. Empty tables give empty results. Extra columns are kept; a column
score is replaced. Very long texts: every window is scored, a bounded number at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import table

SPAN, STEP = 64, 32
#: Hash buckets of words and of n-grams, their lengths, entries of a vector, states in each direction.
WORDS, GRAMS, GRAM_LENGTHS, DIM, STATES = 1 << 16, 1 << 16, (3, 4, 5, 6), 6, 8
MOST_TRAINED, LONGEST_TRAINED, EPOCHS, BATCH, RATE = 4000, 100_000, 5, 48, 0.02
#: A small sample is gone through more often, for so many steps at least.
LEAST_STEPS, MOST_EPOCHS = 400, 40
#: Step of the trained entries of word and n-gram vectors.
VECTOR_RATE = 0.02
#: Most words whose inputs a task remembers.
REMEMBERED = 200_000
#: Punctuation counts as space.
APART = bytes.maketrans(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)), b" " * 32)  # 15 + 7 + 6 + 4


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(APART).split()


def grams_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams of words with their ends marked, and the number of the word each is of."""
    marked = [b"<" + w + b">" for w in words]
    length = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(words)), length)
    left = np.repeat(np.cumsum(length), length) - np.arange(len(codes))  # bytes up to the word's end
    buckets, owners = [], []
    for n in GRAM_LENGTHS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = (h ^ codes[at + i]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        buckets.append((h % np.uint64(GRAMS)).astype(np.int64))
        owners.append(owner[at])
    return np.concatenate(buckets), np.concatenate(owners)


def word_bucket(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word) % WORDS


class Model:
    """The network's weights, its forward pass over windows, and its training."""

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        d, s = 2 * DIM + 1, STATES
        scale = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.w = {"word": 0.1 * scale(WORDS, DIM) * np.sqrt(WORDS, dtype=np.float32), "gram": 0.1 * scale(GRAMS, DIM) * np.sqrt(GRAMS, dtype=np.float32)}
        for side in "fb":
            self.w |= {f"x{side}": scale(d, 3 * s), f"u{side}": scale(s, 3 * s), f"c{side}": np.zeros(3 * s, np.float32)}
        self.w |= {"a": scale(2 * s, 1)[:, 0], "v": scale(2 * s, 1)[:, 0], "k": np.zeros(1, np.float32)}

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Input vectors of distinct words, a bounded number at a time."""
        if len(words) > 20_000:
            return np.concatenate([self.inputs(words[at : at + 20_000]) for at in range(0, len(words), 20_000)])
        out = np.zeros((len(words), 2 * DIM + 1), np.float32)
        if words:
            out[:, :DIM] = self.w["word"][[word_bucket(w) for w in words]]
            bucket, owner = grams_of(words)
            vectors, many = self.w["gram"][bucket], np.maximum(np.bincount(owner, minlength=len(words)), 1)
            for k in range(DIM):
                out[:, DIM + k] = np.bincount(owner, vectors[:, k], len(words)) / many
            np.maximum.at(out[:, 2 * DIM], owner, vectors[:, 0])
        return out

    def logits(self, x: np.ndarray, mask: np.ndarray, back: bool = False):
        """Of windows: x[side] (time, windows, 3 states) inputs times weights, mask (time, windows)."""
        steps, many = mask.shape
        s = STATES
        states, saved = np.zeros((2, steps, many, s), np.float32), []
        for i, side in enumerate("fb"):
            h, u = np.zeros((many, s), np.float32), self.w[f"u{side}"]
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                m = mask[t][:, None]
                g = x[i][t]
                zr = 1 / (1 + np.exp(-(g[:, : 2 * s] + h @ u[:, : 2 * s])))
                z, r = zr[:, :s], zr[:, s:]
                n = np.tanh(g[:, 2 * s :] + (r * h) @ u[:, 2 * s :])
                new = h + m * z * (n - h)
                if back:
                    saved.append((i, t, h, z, r, n))
                states[i, t] = h = new
        both = np.concatenate(states, axis=2)
        e = both @ self.w["a"]
        e = np.exp(np.where(mask > 0, e - e.max(axis=0), -50.0)) * mask
        weight = e / np.maximum(e.sum(axis=0), 1e-9)
        worth = both @ self.w["v"]
        out = (weight * worth).sum(axis=0) + self.w["k"][0]
        return (out, both, weight, worth, saved) if back else out

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the weights and of x for mean log loss."""
        out, both, weight, worth, saved = self.logits(x, mask, True)
        p = 1 / (1 + np.exp(-out))
        d_out = (p - labels) / len(labels)
        s, w = STATES, self.w
        pooled = out - w["k"][0]
        d_worth, d_e = weight * d_out, weight * (worth - pooled) * d_out
        d_both = d_worth[..., None] * w["v"] + d_e[..., None] * w["a"]
        g = {"v": np.einsum("tn,tns->s", d_worth, both), "a": np.einsum("tn,tns->s", d_e, both), "k": np.array([d_out.sum()])}
        g |= {f"u{side}": np.zeros_like(w[f"u{side}"]) for side in "fb"}
        d_x, d_h, last = np.zeros_like(x), 0.0, None
        for i, t, h, z, r, n in reversed(saved):
            if i != last:
                d_h, last = 0.0, i
            u, m = w["u" + "fb"[i]], mask[t][:, None]
            d_new = d_both[t][:, i * s : (i + 1) * s] + d_h
            d_z, d_n = d_new * m * (n - h) * z * (1 - z), d_new * m * z * (1 - n * n)
            d_rh = d_n @ u[:, 2 * s :].T
            d_r = d_rh * h * r * (1 - r)
            d_zr = np.concatenate((d_z, d_r), axis=1)
            g["u" + "fb"[i]][:, : 2 * s] += h.T @ d_zr
            g["u" + "fb"[i]][:, 2 * s :] += (r * h).T @ d_n
            d_h = d_new * (1 - m * z) + d_rh * r + d_zr @ u[:, : 2 * s].T
            d_x[i, t] = np.concatenate((d_zr, d_n), axis=1)
        return g, d_x, float(-np.mean(np.log(np.clip(np.where(labels > 0, p, 1 - p), 1e-6, 1))))


def windows_of(n: int) -> list[tuple[int, int]]:
    """Overlapping windows over n words: all of them, every STEP words; the last one ends with the text."""
    if n <= SPAN:
        return [(0, n)]
    starts = list(range(0, n - SPAN, STEP)) + [n - SPAN]
    return [(a, a + SPAN) for a in starts]


def _layout(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts as rows of words: all rows in a line, and each window's first row, length and text."""
    spans = [windows_of(len(t)) for t in texts]
    ends = np.cumsum([0] + [len(t) for t in texts])
    first = np.array([ends[i] + a for i, s in enumerate(spans) for a, _ in s], np.int64)
    length = np.array([b - a for s in spans for a, b in s], np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in spans])
    return np.concatenate([*texts, np.zeros(1, np.int32)]), first, length, owner


def _steps(flat: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and mask (time, windows) of windows in the line."""
    t = np.arange(max(1, int(length.max(initial=0))))[:, None]
    return flat[np.minimum(first + t, len(flat) - 1)], (t < length).astype(np.float32)


class Scorer:
    """Scores texts; remembers what words contribute to the network's input."""

    def __init__(self, model: Model):
        self.model, self.rows, self.made = model, {}, np.zeros((2, 1024, 3 * STATES), np.float32)

    def _look(self, tokens: list[list[bytes]]) -> list[np.ndarray]:
        if len(self.rows) > REMEMBERED:
            self.rows.clear()
        rows = self.rows
        new = list({w for ws in tokens for w in ws if w not in rows})
        if new:
            at = len(rows)
            if at + len(new) > self.made.shape[1]:
                grown = np.zeros((2, 2 * (at + len(new)), 3 * STATES), np.float32)
                grown[:, :at] = self.made[:, :at]
                self.made = grown
            for a in range(0, len(new), 20_000):
                part, w = new[a : a + 20_000], self.model.w
                x = self.model.inputs(part)
                for i, side in enumerate("fb"):
                    self.made[i, at + a : at + a + len(part)] = x @ w[f"x{side}"] + w[f"c{side}"]
            rows.update(zip(new, range(at, at + len(new)), strict=True))
        return [np.fromiter(map(rows.__getitem__, ws), np.int64, len(ws)) for ws in tokens]

    def logits(self, texts: list[str | None]) -> np.ndarray:
        flat, first, length, owner = _layout(self._look([words_of(t) for t in texts]))
        out = np.full(len(texts), -np.inf)
        order = np.argsort(length, kind="stable")  # windows of like length together
        for at in range(0, len(order), 2000):
            pick = order[at : at + 2000]
            rows, mask = _steps(flat, first[pick], length[pick])
            np.maximum.at(out, owner[pick], self.model.logits(self.made[:, rows], mask))
        return out


class Vectors:
    """Training of the word and n-gram vectors behind the inputs of known words."""

    def __init__(self, model: Model, words: list[bytes]):
        self.model, self.word = model, np.fromiter(map(word_bucket, words), np.int64, len(words))
        grams, many = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            bucket, owner = grams_of(part)
            grams.append(bucket[np.argsort(owner, kind="stable")].astype(np.int32))
            many.append(np.bincount(owner, minlength=len(part)))
        self.gram, self.start = np.concatenate(grams), np.cumsum(np.concatenate(many))
        self.seen = {k: np.zeros((len(model.w[k]), DIM - 1), np.float32) for k in ("word", "gram")}

    def grams(self, picked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """n-gram buckets of the picked words, the place in picked each is of, and 1 over their number by word."""
        many = self.start[picked + 1] - self.start[picked]
        owner = np.repeat(np.arange(len(picked)), many)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        return self.gram[self.start[picked][owner] + within], owner, (1 / np.maximum(many, 1)).astype(np.float32)

    def refresh(self, x: np.ndarray, picked: np.ndarray) -> None:
        """Puts the trained entries of the picked words into x (fold, word, entry)."""
        x[:, picked, 1:DIM] = self.model.w["word"][self.word[picked], 1:]
        bucket, owner, share = self.grams(picked)
        vectors = self.model.w["gram"][bucket, 1:]
        for k in range(DIM - 1):
            x[:, picked, DIM + 1 + k] = np.bincount(owner, vectors[:, k], len(picked)) * share

    def gradients(self, picked: np.ndarray, d: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Rows of the tables and the gradients of their trained entries, from those of the picked words' inputs."""
        bucket, owner, share = self.grams(picked)
        out = {}
        for name, at, g in (("word", self.word[picked], d[:, 1:DIM]), ("gram", bucket, (d[:, DIM + 1 : 2 * DIM] * share[:, None])[owner])):
            rows, to = np.unique(at, return_inverse=True)
            out[name] = rows, np.stack([np.bincount(to, g[:, k], len(rows)) for k in range(DIM - 1)], axis=1)
        return out

    def step(self, picked: np.ndarray, d: np.ndarray, rate: float) -> None:
        for name, (rows, g) in self.gradients(picked, d).items():
            self.seen[name][rows] += g * g
            self.model.w[name][rows, 1:] -= rate * g / (np.sqrt(self.seen[name][rows]) + 1e-6)


def input_gradients(model: Model, rows: np.ndarray, d_x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct words of rows (time, window) and the gradients of their inputs."""
    d_v = sum(d_x[i] @ model.w[f"x{side}"].T for i, side in enumerate("fb"))
    picked, to = np.unique(rows, return_inverse=True)
    d_v, to = d_v.reshape(-1, d_v.shape[-1]), to.reshape(-1)
    return picked, np.stack([np.bincount(to, c, len(picked)) for c in d_v.T], axis=1)


def _odds(pos: np.ndarray, neg: np.ndarray, p: int, q: int) -> np.ndarray:
    """Smoothed log-odds of the label by bucket, from the numbers of texts (p labelled 1, q labelled 0) that hold it; 0 for buckets of fewer than two texts."""
    prior, p, q = 2.0, max(1, p), max(1, q)
    odds = np.log((pos + prior * p / (p + q)) / (p + prior)) - np.log((neg + prior * q / (p + q)) / (q + prior))
    return np.where(pos + neg >= 2, np.clip(odds, -4, 4), 0).astype(np.float32)


def train(texts: list[str | None], labels: list[int], seed: int = 5) -> Model:
    """The model for texts and labels (0, 1).

    The log-odds that a text's words go in with come from the other folds, so the network learns how far to trust
    them. Each round trains on every text's window of highest logit, and on one more of each text labelled 0.
    """
    model, rng = Model(seed), np.random.default_rng(seed)
    y = np.array(labels, np.int64)
    if not len(y) or y.min() == y.max():
        model.w["v"][:] = 0
        model.w["k"][:] = -20
        return model
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in words_of(t)], np.int32) for t in texts]
    words = list(number)
    del number
    folds = rng.permutation(len(y)) % 4
    sides = {"word": np.zeros((4, 2, WORDS), np.int32), "gram": np.zeros((4, 2, GRAMS), np.int32)}
    for own, f, label in zip(ids, folds, y, strict=True):  # texts that hold a bucket, by fold and label
        distinct = [words[i] for i in np.unique(own)]
        if distinct:
            sides["word"][f, label][np.unique([word_bucket(w) for w in distinct])] += 1
            sides["gram"][f, label][np.unique(grams_of(distinct)[0])] += 1

    def inputs_without(fold: int | None) -> np.ndarray:
        rest = np.flatnonzero(folds != fold) if fold is not None else np.arange(len(y))
        for name, counts in sides.items():
            neg, pos = counts.sum(axis=0) - (counts[fold] if fold is not None else 0)
            model.w[name][:, 0] = _odds(pos, neg, int(y[rest].sum()), int((1 - y[rest]).sum()))
        return model.inputs(words)

    x = np.empty((4, len(words), 2 * DIM + 1), np.float32)
    for f in range(4):
        x[f] = inputs_without(f)
    inputs_without(None)
    table = Vectors(model, words)
    flat, first, length, owner = _layout(ids)
    fold = folds[owner]
    vectors = lambda rows, pick: x[fold[pick][None, :], rows]
    small = [k for k in model.w if k not in ("word", "gram")]
    mean, square, step = {k: 0.0 for k in small}, {k: 0.0 for k in small}, 0

    def project(v: np.ndarray) -> np.ndarray:
        return np.stack([v @ model.w[f"x{side}"] + model.w[f"c{side}"] for side in "fb"])

    epochs = min(MOST_EPOCHS, max(EPOCHS, math.ceil(LEAST_STEPS * BATCH / (2 * len(y)))))
    for epoch in range(epochs):
        if epoch:
            for at in range(0, len(words), 20_000):
                table.refresh(x, np.arange(at, min(at + 20_000, len(words))))
        worth = np.zeros(len(first))
        for at in range(0, len(first), 1000):
            pick = np.arange(at, min(at + 1000, len(first)))
            rows, mask = _steps(flat, first[pick], length[pick])
            v = vectors(rows, pick)
            worth[pick] = model.logits(project(v), mask) if epoch else ((v[..., 0] + v[..., 2 * DIM]) * mask).max(axis=0)
        best = np.lexsort((-worth, owner))
        best = best[np.concatenate(([True], owner[best][1:] != owner[best][:-1]))]
        extra = rng.permutation(len(first))
        extra = extra[np.unique(owner[extra], return_index=True)[1]]
        chosen = rng.permutation(np.concatenate((best, extra[y[owner[extra]] == 0])))
        for at in range(0, len(chosen), BATCH):
            pick = chosen[at : at + BATCH]
            rows, mask = _steps(flat, first[pick], length[pick])
            table.refresh(x, np.unique(rows))
            v = vectors(rows, pick)
            g, d_x, _ = model.gradients(project(v), mask, y[owner[pick]])
            for i, side in enumerate("fb"):
                g[f"x{side}"] = np.einsum("tnd,tnk->dk", v, d_x[i])
                g[f"c{side}"] = d_x[i].sum(axis=(0, 1))
            step += 1
            slower = 1 if 2 * epoch < epochs else 0.5 if 4 * epoch < 3 * epochs else 0.2
            table.step(*input_gradients(model, rows, d_x), VECTOR_RATE * slower)
            for k in small:
                mean[k] = 0.9 * mean[k] + 0.1 * g[k]
                square[k] = 0.99 * square[k] + 0.01 * g[k] ** 2
                change = (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)
                model.w[k] = (model.w[k] - RATE * slower * change).astype(np.float32)
    return model


def held_out() -> Column:
    """Documents whose labels are never learnt from: crc32 of doc_id as text divides by 5."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def training_sample(documents: DataFrame, labels: DataFrame, most: int = MOST_TRAINED, longest: int = LONGEST_TRAINED) -> tuple[list[str], list[int]]:
    """Texts and labels of at most `most` labelled documents that aren't held out, none longer than `longest` characters; of a repeated id the smallest text."""
    labelled = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    some = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # a row of two numbers each: small enough to send anywhere
    rows = documents.select("doc_id", "text").join(F.broadcast(some), "doc_id").where(F.char_length("text") <= longest).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """documents with score."""
    kept = [c for c in documents.columns if c != "score"]
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            for a in range(0, batch.num_rows, 100):
                part = batch.slice(a, 100)
                logits = np.clip(scorer.logits(part.column(at).to_pylist()).astype(float), -30, 30)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-logits)))], [*part.schema.names, "score"])

    schema = StructType([*documents.select(*kept).schema.fields, StructField("score", DoubleType())])
    return documents.select(*kept).mapInArrow(run, schema)


def toxicity(documents: DataFrame, labels: DataFrame, most: int = MOST_TRAINED) -> DataFrame:
    return score_documents(documents, train(*training_sample(documents, labels, most)))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
