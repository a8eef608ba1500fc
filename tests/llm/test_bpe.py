"""BPE against the tokenizers library."""

from __future__ import annotations

import os

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tracewell.llm.bpe import ByteBpe
from tracewell.llm.token_store import WordEncoder

PIECES = ["a", "A", "the", " ", "  ", "\n", "\t", "é", "ß", "É", "İ", "Σ", "漢", "😀", "\xa0", "\x1c", "\x85", "1", "٣", "'s", "'ll", "!", "!!!", "<|endoftext|>", "<|startoftext|>", "\x00", "́", "Ⅷ", "_", "-", "ǅ", ",", "."]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=40).map("".join) | st.text(max_size=60)


@pytest.fixture(scope="module")
def byte():
    path = public_tokenizers.path("byte_bpe_50k.json")
    return ByteBpe(path, bound=50), Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def word():
    path = public_tokenizers.path("word_bpe_49k.json")
    return WordEncoder(path, bound=50), Tokenizer.from_file(path)


@given(st.lists(TEXTS, max_size=5))
@settings(max_examples=150, deadline=None)
def test_byte_level(byte, texts):
    own, library = byte
    got = own.encode(texts)
    assert [g.tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [own.decode(g).decode() for g in got] == [library.decode(g.tolist(), skip_special_tokens=False) for g in got]


@given(st.lists(TEXTS, max_size=5))
@settings(max_examples=150, deadline=None)
def test_word_level(word, texts):
    own, library = word
    assert [g.tolist() for g in own.encode([t.encode() for t in texts])] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["a" * 5000, "!" * 3001, " " * 999, "ab" * 2000, "x\n" * 700])
def test_long_runs(byte, word, text):
    assert byte[0].encode([text])[0].tolist() == byte[1].encode(text, add_special_tokens=False).ids
    assert word[0].encode([text.encode()])[0].tolist() == word[1].encode(text, add_special_tokens=False).ids


def test_cut_off_bytes_decode_to_replacement(byte):
    own, library = byte
    ids = own.encode(["漢"])[0][:1]
    assert own.decode(ids).decode() == library.decode(ids.tolist(), skip_special_tokens=False)
