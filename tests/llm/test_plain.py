"""Operators against a plain, slow writing of the same: the network word by word, best fit over a list of bins, what discard() may delete."""

import math
import os
import random
from itertools import pairwise

import numpy as np
import pytest
from mapfold.llm import common, packing, toxicity


def plain_score(model, text):
    """A text's logit: each window is read word by word, forward and back, and its states are weighed one by one."""
    w, words = model.w, toxicity.words_of(text)
    sigmoid = lambda v: 1 / (1 + math.exp(-v))

    def vector(word):
        marked = b"<" + word + b">"
        grams = []
        for n in toxicity.GRAM_LENGTHS:
            for i in range(len(marked) - n + 1):
                h = n
                for c in marked[i : i + n]:
                    h = (h ^ (c + 1)) * 0x100000001B3 % 2**64
                    h ^= h >> 29
                grams.append(w["gram"][h % toxicity.GRAMS].astype(float))
        mean = sum(grams) / len(grams) if grams else np.zeros(toxicity.DIM)
        return np.concatenate([w["word"][toxicity.word_bucket(word)].astype(float), mean, [max([0.0, *(g[0] for g in grams)])]])

    def direction(inputs, side):
        s, h, out = toxicity.STATES, np.zeros(toxicity.STATES), []
        for x in inputs:
            g = x @ w[f"x{side}"].astype(float) + w[f"c{side}"]
            u = w[f"u{side}"].astype(float)
            z, r = (np.array([sigmoid(v) for v in g[a : a + s] + h @ u[:, a : a + s]]) for a in (0, s))
            h = (1 - z) * h + z * np.tanh(g[2 * s :] + (r * h) @ u[:, 2 * s :])
            out.append(h)
        return out

    scores = []
    for a in sorted({*range(0, max(1, len(words) - toxicity.SPAN), toxicity.STEP), max(0, len(words) - toxicity.SPAN)}):
        inputs = [vector(x) for x in words[a : a + toxicity.SPAN]]
        both = [np.concatenate(p) for p in zip(direction(inputs, "f"), direction(inputs[::-1], "b")[::-1], strict=True)]
        weights = [math.exp(h @ w["a"]) for h in both]
        scores.append(sum(e * (h @ w["v"]) for e, h in zip(weights, both, strict=True)) / (sum(weights) or 1) + w["k"][0])
    return max(scores)


def test_scores_are_those_of_the_network_word_by_word():
    model, r = toxicity.Model(), random.Random(3)
    for k in ("a", "v", "k", "cf", "cb"):
        model.w[k] = np.random.default_rng(4).standard_normal(model.w[k].shape).astype(np.float32)
    texts = ["", "!", "one", "Two words", "Ünïcode 漢字 x's, a-b"] + [" ".join("".join(r.choice("abcdé") for _ in range(r.randint(1, 9))) for _ in range(n)) for n in (63, 64, 65, 96, 97, 200)]
    got = toxicity.Scorer(model).logits(texts)
    assert np.allclose(got, [plain_score(model, t) for t in texts], atol=2e-3)


@pytest.mark.parametrize("length, most", [(20, 3), (50, 8), (7, 1), (2048, 512)])
def test_best_fit_over_a_list(length, most):
    """The bin with the least free space that holds a piece, else a new one; where all places are taken, the fullest closes."""
    r, packer, bins, opened, closed = random.Random(length), packing.BestFit(length, most), [], 0, {}
    for _ in range(3000):
        size = min(length, int(r.expovariate(4 / length)) + 1)
        number, offset = packer.place(size)
        fitting = [free for free in bins if free >= size]
        free = min(fitting) if fitting else length
        if fitting:
            bins.remove(free)
        else:
            if len(bins) == most:
                bins.remove(min(bins))
            opened += 1
        if free > size:
            bins.append(free - size)
        assert offset == length - free and packer.opened == opened and packer.open == len(bins)
        closed.setdefault(number, []).append((offset, size))
    for pieces in closed.values():  # gapless from 0
        assert pieces[0][0] == 0 and all(a + n == b for (a, n), (b, _) in pairwise(pieces)) and sum(n for _, n in pieces) <= length


def test_discard_deletes_only_what_was_made_here(spark, tmp_path):
    own = str(tmp_path / "own")
    spark.range(3).write.parquet(own)
    common.discard(spark.read.parquet(own))
    assert os.path.exists(own)
    made = common.materialize(spark.range(3), "some")
    path = made.inputFiles()[0].removeprefix("file://")
    common.discard(made)
    assert not os.path.exists(os.path.dirname(path))
    left = common.materialize(spark.range(3), "left")
    path = left.inputFiles()[0].removeprefix("file://")
    common.clear(spark)
    assert not os.path.exists(path)
