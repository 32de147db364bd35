"""Chunked tokenisation gives the ids of whole-text tokenisation."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from mapfold.llm.packing import ChunkTokenizer, default_path

CHUNKED, WHOLE = ChunkTokenizer(default_path()), Tokenizer.from_file(default_path())
PIECES = ["a", "Zß", "é", "é", "́", "Σ", "ΣΑΣ", "İ", "ǆ", "漢", "😀", "1", "²", "½", "ª", "_", "'", "'s", "'RE", "’s", ".", ",", "...", "!?", "(", ")", "-", "--", "/", "<|endoftext|>", "<|", "|>", "<", ">", "&amp;", "«", "»", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0", " ", "​", "\x00", "﻿", "ʼ", "ͅ", "가", "Ǆ", " ", "\n", "\t", "\r"]


def same(text):
    want = np.array(WHOLE.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert CHUNKED.encode([text]) == [want]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_awkward_pieces(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "word,", "(word)", "3.5%", "a.,b .. c", "x'.y", "it's, don't!", "Word,Word;WORD", "." * 5000, "a" * 5000, "end."])
def test_plain_punctuation(text):
    same(text)
