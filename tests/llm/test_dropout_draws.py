"""Each occurrence of a word draws its own skips, and what is remembered changes no result."""

from __future__ import annotations

import numpy as np
import pytest

from dayslice.llm import dropout
from dayslice.llm.queries import tokenizer_path

from .corpus import documents


@pytest.fixture(scope="module")
def proto():
    with open(tokenizer_path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


@pytest.mark.parametrize("share", [0.1, 0.5, 1.0])
def test_each_occurrence_equals_its_own_merge(proto, monkeypatch, share):
    monkeypatch.setattr(dropout, "CACHE_NODES", 60)
    own = dropout.Segmenter(proto, 9, share)
    for number, text in documents():
        units = [" " + u for u in (text or "").split(" ")] if text and "  " not in f" {text}" and text[-1] != " " else dropout._units.findall(f" {text}") if text else []
        alone = b"".join(own.segment(u, own._key(number or 0, i)) for i, u in enumerate(units))
        assert own.encode(text or "", number or 0) == alone


def test_a_frequent_word_has_more_than_four_forms(proto):
    own = dropout.Segmenter(proto, 2026, 0.1)
    word, times = " internationalization", 20_000
    plain = dropout.Segmenter(proto, 2026, 0.0).segment(word, 0)
    forms = [own.encode(word[1:], d) for d in range(times)]
    assert len(set(forms)) > 20
    # All candidates of the plain merge come through with probability 0.9 each; other ways may lead there too.
    assert sum(f == plain for f in forms) / times > 0.9 ** own.candidates(word) - 0.02
    # A word of one merge is split in a tenth of its occurrences, within one text too.
    pair = next(p for p in own.ids if len(p) == 2 and p.isascii() and p.isalpha() and own.segment(p, 0))
    assert own.candidates(pair) == 1
    keys = own._keys(77, np.arange(times, dtype=np.uint64)).tolist()
    assert 0.09 < sum(len(own.segment(pair, k)) > 4 for k in keys) / times < 0.11
    many = np.frombuffer(own.encode("of " * times + "of", 7), dtype="<u4")
    assert len(many) > times * (1 + 0.09)
