"""FM-index and decontamination against plain search."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest

from dayslice.llm import decontam, fmindex

from .corpus import documents, frame, prose


def lowered(text):
    return text.translate(str.maketrans(decontam.UPPER, decontam.LOWER))


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text or ""))


def plain(docs, items, size=10):
    grams = set()
    for item, text in items:
        own = words(text)
        grams |= {(item, tuple(own[i : i + size])) for i in range(max(1, len(own) - size + 1)) if own}
    out = []
    for doc, text in docs:
        own = words(text)
        hit, found = set(), set()
        for item, gram in grams:
            for i in range(len(own) - len(gram) + 1):
                if tuple(own[i : i + len(gram)]) == gram:
                    hit |= set(range(i, i + len(gram)))
                    found |= {str(item)} if item is not None else set()
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(own), len(hit), len(found), digest, bool(hit)))
    return sorted(out, key=str)


def bench_items():
    long = prose(21, 40)
    return [
        (1, prose(5, 30)), (2, prose(9, 120).upper()), (10, "one two"), (11, "Children, sang!"), (12, long), (13, long), (14, None), (15, ""),
        (16, " .\n"), (17, "nowhere said words stand in this sentence at all my friends of old"), (18, "Ünïcödé äö"), (19, "x" * 3000), (None, "old stones"), (2, "two texts of one item"),
    ]


def docs_with_passages():
    return [*documents(), (400, "lead in. " + prose(21, 40) + " and after"), (401, "nowhere said WORDS, stand in this sentence at all"), (402, "Ünïcödé ÄÖ stays"), (403, "ünïcödé äö")]


@pytest.mark.parametrize(("shard", "block", "cut_at"), [(1 << 20, 100_000, 1 << 20), (150, 100_000, 400), (400, 9, 400)])
def test_hits_equal_plain_search(spark, monkeypatch, shard, block, cut_at):
    monkeypatch.setattr(decontam, "SLICE_BYTES", cut_at)
    docs, items = docs_with_passages(), bench_items()
    benchmark = spark.createDataFrame([(i, t, "w", 1) for i, t in items], "item_id bigint, text string, window string, block int")
    index = decontam.build_index(frame(spark, docs), shard_words=shard)
    found = decontam.find(index, decontam.windows(benchmark), block_windows=block)
    assert sorted((tuple(r) for r in decontam.digests(found).collect()), key=str) == plain(docs, items)


@pytest.mark.parametrize("block", [100_000, 5])
def test_texts_lose_the_passages_only(spark, block):
    docs = [(1, "Keep this: one TWO three four! then rest"), (2, "one two"), (3, None), (4, "nothing here, one")]
    items = spark.createDataFrame([(7, "one two three"), (8, "Three four"), (9, "one two"), (10, "gone"), (11, "gone too"), (12, "away")], "item_id bigint, text string")
    index = decontam.build_index(frame(spark, docs), keep_text=True)
    got = {r.doc_id: (r.text, r["items"], [tuple(s) for s in r.spans]) for r in decontam.find(index, decontam.windows(items), block_windows=block).collect()}
    assert got == {1: ("Keep this: ! then rest", ["7", "8", "9"], [(2, 6)]), 2: ("", ["9"], [(0, 2)]), 3: ("", [], []), 4: ("nothing here, one", [], [])}


def test_empty_tables(spark):
    docs = frame(spark, [(1, "a b c")])
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert decontam.decontaminate(docs.limit(0), items).count() == 0
    none = decontam.decontaminate(docs, items.limit(0)).collect()
    assert [(r.doc_id, r.n_words, r.spans, r["items"], r.text) for r in none] == [(1, 3, [], [], "a b c")]


def test_words_equal_the_pattern():
    texts = [t or "" for _, t in documents()] + ["", "a", "ab", "A1-b2", "äb ÄB", "\x7fq\x00q", "joined", "joined"]
    data, breaks = decontam._texts(pa.array(texts))
    starts, ends, hashes = decontam.words_of(data, breaks)
    got = [bytes(data[a:b]).lower().decode() for a, b in zip(starts, ends, strict=True)]
    assert got == [w for t in texts for w in words(t)]
    assert len(set(hashes.tolist())) == len(set(got)) == len(set(zip(hashes.tolist(), got, strict=True)))
    sliced = decontam._texts(pa.array(texts).slice(3, 5))
    assert bytes(sliced[0]) == "".join(texts[3:8]).encode() and sliced[1][-1] == len(sliced[0])


@pytest.mark.parametrize("seed", range(12))
def test_index_equals_a_plain_scan(seed):
    rng = np.random.default_rng(seed)
    text = np.append(np.tile([2, 3, 1], 60) if seed == 0 else rng.integers(1, 4 + seed * 3, rng.integers(0, 400)), 0)
    assert fmindex.suffix_order(text).tolist() == sorted(range(len(text)), key=lambda i: tuple(text[i:]))
    index = fmindex.FMIndex.load(fmindex.FMIndex.of(text).dump())
    for length in (1, 2, 5):
        phrases = rng.integers(1, max(2, int(text.max()) + 1), (30, length))
        phrases = phrases[(phrases <= text.max()).all(1)]
        for phrase, low, high in zip(phrases, *index.ranges(phrases), strict=True):
            places = [i for i in range(len(text) - length + 1) if (text[i : i + length] == phrase).all()]
            assert sorted(index.locate(np.arange(low, high)).tolist()) == places
