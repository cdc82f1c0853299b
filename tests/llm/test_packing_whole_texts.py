"""Ids of whole texts against the tokenizers library with its default settings."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from glyphweave.llm.packing import BLANK, VOCABULARY, has_long_blank, pack, tokeniser


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(public_tokenizers.path(VOCABULARY))
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("blank", [" ", "\n"])
def test_runs_of_two_million_blanks(reference, blank):
    encode = tokeniser(VOCABULARY)
    for text in ("a" + blank * 2_000_000, "a" + blank * 2_000_000 + "b c"):
        assert encode(text) == reference(text)


def test_long_blanks_are_found():
    for n in (2 * BLANK - 1, 3 * BLANK):
        for lead in (0, 1, BLANK - 1, BLANK, 3 * BLANK + 7):
            assert has_long_blank("x" * lead + "\u3000" * n + "x") and has_long_blank("x" * lead + "\t" * n)
    assert not has_long_blank("x" * BLANK + " " * (BLANK - 1)) and not has_long_blank("") and not has_long_blank("a " * 3 * BLANK)


def test_added_tokens_have_their_own_id(reference):
    encode = tokeniser(VOCABULARY)
    assert encode("one doc ends <|endoftext|> next") == [505, 2205, 5645, 220, 50256, 1306]
    end = "<|endoftext|>"
    for text in (end, end * 3, f"a{end}b", f" {end} ", f"x \n\n{end}\n\n y", f"<{end}>", "<|endoftext|", f"<|endof{end}text|>", f"  {end}{end}  z", f"a {end}" + " " * 2_000_000 + f"{end} b"):
        assert encode(text) == reference(text), text[:80]


def test_added_tokens_are_packed(spark, reference):
    text = "one doc ends <|endoftext|> next"
    ids = np.array([*reference(text), 0], dtype="<u4")
    assert [(r.length, r.doc_tokens, r.ids_crc32) for r in pack(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()] == [(7, 7, zlib.crc32(ids.tobytes()))]


def test_a_long_blank_is_packed(spark, reference):
    text = "one" + "\n" * 1_200_000 + "two"
    got = sorted(pack(spark.createDataFrame([(1, text), (2, "three")], "doc_id long, text string")).collect(), key=lambda r: (r.doc_id, r.start))
    ids = np.array([*reference(text), 0], dtype="<u4")
    own = [r for r in got if r.doc_id == 1]
    assert sum(r.length for r in own) == len(ids) and {r.doc_tokens for r in own} == {len(ids)}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own)
    assert [r.length for r in got if r.doc_id == 2] == [len(reference("three")) + 1]
