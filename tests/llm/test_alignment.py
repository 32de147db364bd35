"""Cross-tokenizer alignment: tokens of whole texts, overlaps by brute force, counts over the corpus."""

import collections
import hashlib
import json

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from mapfold.llm import alignment
from mapfold.llm.queries import QUERIES
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"
ALIGNER = alignment.worker_aligner(None, None)
A = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
    NAMES = {i: t for t, i in json.load(f)["model"]["vocab"].items()}
LETTERS = alignment.byte_of_letter()
TEXTS = ["a", "Hello world", "  two  spaces ", "x\ny\r\n\tz", "Zß ΣΑΣ İ", "漢字かな", "😀🏳️‍🌈", "<|endoftext|>", "<s> </s> <unk> <0x41>", "▁ under", "it's we'll 'RE", "é é", "\x00\x01\x7f", "\xa0 ​", "3.14159 10000000", "ﬁ ａ ²", "....!!??", "the " * 300, "ab" * 4000, "don't stop"]
PIECES = [*TEXTS[:17], " ", "  ", "\n", "word", "▁", "'", "s"]


def brute(text):
    """Ids of both tokenizers, and the links' places, by looking at all pairs of tokens."""
    if not text:
        return [], [], []
    a, b = A.encode(f" {text}", add_special_tokens=False).ids, B.encode(text)
    a_bytes = [bytes(LETTERS[c] for c in NAMES[i]) for i in a]
    b_bytes = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(a_bytes) == b"".join(b_bytes) == f" {text}".encode():
        return [], [], []
    spans = []
    for tokens in (a_bytes, b_bytes):
        ends = np.cumsum([len(t) for t in tokens])
        spans.append((ends - [len(t) for t in tokens], ends))
    (s, e), (u, v) = spans
    return a, b, np.argwhere((s[:, None] < v) & (u < e[:, None])).tolist()


def groups(a, b, links):
    """Groups as components of tokens that overlap."""
    out, last = [], (-1, -1)
    for i, j in links:
        if i > last[0] and j > last[1]:
            out.append((set(), set()))
        out[-1][0].add(i)
        out[-1][1].add(j)
        last = (i, j)
    return ";".join(",".join(str(a[i]) for i in sorted(x)) + "|" + ",".join(str(b[j]) for j in sorted(y)) for x, y in out), len(out)


def expected(rows):
    found = [(d, *brute(t)) for d, t in rows]
    count = collections.Counter((a[i], b[j]) for _, a, b, links in found for i, j in links)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for d, a, b, links in found:
        text, n = groups(a, b, links)
        own = [count[a[i], b[j]] for i, j in links]
        out.append((d, len(a), len(b), n, len(links), sum(c == best[b[j]] for c, (_, j) in zip(own, links, strict=True)), sum(own), hashlib.sha256(text.encode()).hexdigest() if links else ""))
    return sorted(out, key=str)


def same_tokens(text):
    got = next(ALIGNER.tokens([text.encode()]))
    a, b, _ = brute(text)
    assert ([], []) == (a, b) if got is None else (got[0].tolist(), got[1].tolist()) == (a, b)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_tokens_of_awkward_texts(text):
    same_tokens(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_tokens_of_any_text(text):
    same_tokens(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=30), st.lists(st.integers(1, 4), min_size=1, max_size=30))
def test_alignment_of_lengths(x, y):
    short = min(sum(x), sum(y))
    cut = lambda z: np.diff(np.unique(np.minimum(np.cumsum([0, *z]), short)))
    x, y = cut(x), cut(y)
    found = alignment.align(x, y)
    ends, others = np.cumsum(x), np.cumsum(y)
    want = [(i, j) for i in range(len(x)) for j in range(len(y)) if ends[i] - x[i] < others[j] and others[j] - y[j] < ends[i]]
    assert list(zip(*(z.tolist() for z in found.links()), strict=True)) == want
    common = sorted(set(ends) & set(others))
    assert ends[found.a_ends - 1].tolist() == others[found.b_ends - 1].tolist() == common


@pytest.mark.parametrize("kept", [0, 5, 500_000])
def test_documents(spark, kept):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1]), (1, "another text"), (None, "Hello there"), (50, None), (51, "")]
    df = spark.createDataFrame([(d, t, 1, "x", 2) for d, t in rows], "doc_id long, text string, uid int, pairs string, n_a int").repartition(3)
    assert sorted(map(tuple, alignment.align_documents(df, most_kept=kept).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str) == expected(rows)
    assert alignment.align_documents(df.where("false"), most_kept=kept).count() == 0


def test_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(1, b"ab\xff c"), (2, b"fine")], "doc_id long, b binary").selectExpr("doc_id", "cast(b as string) AS text")
    assert sorted((r["doc_id"], r["n_a"]) for r in alignment.align_documents(df).collect()) == [(1, 0), (2, 1)]


def test_steps_of_the_digest_and_megabytes(monkeypatch):
    text = ("lorem ipsum dolor 漢 sit\n" * 60_000).encode()
    ids = next(ALIGNER.tokens([text]))
    whole = ALIGNER.row(ids)
    monkeypatch.setattr(alignment, "STEP", 1000)
    assert ALIGNER.row(ids)[:5] == whole[:5] and whole[0] > 300_000


def test_op11(spark):
    df = QUERIES["op11_alignment"](spark, SF)
    assert df.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", "string")]
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    # all pairs of tokens of the longest texts take too much memory here; their counts are the corpus's, so all texts are linked by lengths
    def lined(text):
        a, b, _ = brute(text) if len(text or "") < 3000 else (None, None, None)
        if a is None:
            a, b = next(ALIGNER.tokens([text.encode()]))
            return a.tolist(), b.tolist(), list(zip(*(z.tolist() for z in alignment.align(ALIGNER.a.lengths[a], ALIGNER.b.lengths[b]).links()), strict=True))
        return a, b, brute(text)[2]
    found = [(d, *lined(t)) for d, t in rows]
    count = collections.Counter((a[i], b[j]) for _, a, b, links in found for i, j in links)
    best = {}
    for (_, j), n in count.items():
        best[j] = max(best.get(j, 0), n)
    want = []
    for d, a, b, links in found:
        text, n = groups(a, b, links)
        want.append((d, len(a), len(b), n, len(links), sum(count[a[i], b[j]] == best[b[j]] for i, j in links), sum(count[a[i], b[j]] for i, j in links), hashlib.sha256(text.encode()).hexdigest() if links else ""))
    assert sorted(map(tuple, df.collect())) == sorted(want)
