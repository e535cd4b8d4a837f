"""Token ids: against the library, exact round trips, packing rules."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dayslice.llm import bitpack, dropout, packing, tokens
from dayslice.llm.queries import tokenizer_path

from .corpus import documents, frame

PATH = tokenizer_path()
PIECES = tokenizer_path("piece_bpe_32k.model")
TEXT = st.text(alphabet=st.sampled_from(" \n\t abcXY'sé.,1▁日\x1c"), max_size=60)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    with open(PATH, encoding="utf-8") as file:
        return tokens.Encoder(file.read())


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=4))
def test_units_give_the_ids_of_the_whole_text(library, own, texts):
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == [ids_of(library, t) for t in texts]


def test_special_strings_and_long_units(library, own, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_UNITS", 3)
    texts = ["a<|endoftext|> b <|endoftext|>", "x" * 500 + " y " + "z" * 200, "  two", *[t or "" for _, t in documents()]]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == [ids_of(library, t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(bits=st.integers(1, 32), data=st.data())
def test_bit_packing_is_exact(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=70)), dtype="<u4")
    packed = bitpack.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert bitpack.unpack(packed, bits, len(ids)).tolist() == ids.tolist()


def test_file_reads_any_range():
    parts = [np.arange(n, dtype="<u4").tobytes() for n in (5, 0, 130, 1)]
    file = bitpack.IdFile(bitpack.to_bytes([7, None, 9, 9], parts, 17, block=16))
    every = np.concatenate([np.frombuffer(p, "<u4") for p in parts])
    assert file.doc_ids.tolist()[2:] == [9, 9] and file.missing.tolist() == [0, 1, 0, 0]
    for a, b in ((0, 136), (15, 17), (16, 32), (100, 101), (4, 4)):
        assert file.range(a, b).tolist() == every[a:b].tolist()
    assert [file.document(i).tobytes() for i in range(4)] == parts
    with pytest.raises(ValueError, match="fit"):
        bitpack.pack(np.array([4], dtype="<u4"), 2)
    with pytest.raises(ValueError, match="packed"):
        bitpack.IdFile(b"x" * 200)


def test_written_ids_equal_the_library(spark, library):
    rows = documents()
    got = bitpack.packed(frame(spark), PATH).collect()
    assert len(got) == len(rows)
    start = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
    def crc(text):
        return zlib.crc32(np.array(ids_of(library, text) + [0], dtype="<u4").tobytes())
    want = sorted((-1 if i is None else i, crc(t)) for i, t in rows)
    assert [w[0] for w in want] == [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert want == sorted((-1 if r.doc_id is None else r.doc_id, r.ids_crc32) for r in got)
    assert bitpack.packed(frame(spark).limit(0), PATH).count() == 0


def test_many_files_keep_the_order(spark, root):
    manifest = bitpack.write(frame(spark), root + "/ids", PATH, file_ids=500, block=64)
    assert manifest.count() > 5
    small = sorted(tuple(r) for r in bitpack.read_digests(spark, root + "/ids", manifest).fillna(-1).collect())
    assert small == sorted(tuple(r) for r in bitpack.packed(frame(spark), PATH).fillna(-1).collect())


def test_pieces_are_whole_and_sequences_gapless(spark, library):
    rows = documents()
    got = packing.pack(frame(spark), PATH, sequence=256).collect()
    lengths = sorted(len(ids_of(library, t)) + 1 for _, t in rows)
    assert sum(r.length for r in got) == sum(lengths)
    by_sequence: dict[int, list] = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    assert len(by_sequence) <= 1.05 * -(-sum(lengths) // 256)
    long = np.array(ids_of(library, dict(rows)[110]) + [0], dtype="<u4")
    pieces = sorted((r for r in got if r.doc_id == 110), key=lambda r: r.piece)
    assert [r.length for r in pieces] == packing.cut(len(long), 256) and [r.piece for r in pieces] == list(range(len(pieces)))
    for r in pieces:
        assert r.ids_crc32 == zlib.crc32(long[r.start : r.start + r.length].tobytes())
    assert packing.pack(frame(spark).limit(0), PATH).count() == 0


@settings(max_examples=100, deadline=None)
@given(lengths=st.lists(st.integers(1, 20), max_size=80), open_bins=st.integers(1, 9))
def test_best_fit_takes_the_fullest_open_bin(lengths, open_bins):
    bins, free, closed, used = packing.BestFit(20, open_bins), {}, set(), 0
    for n in lengths:
        number, place = bins.add(n)
        fitting = [f for b, f in free.items() if f >= n and b not in closed]
        if fitting:
            assert free[number] == min(fitting) and number not in closed
        else:
            assert number == used
            used += 1
        assert place == 20 - free.get(number, 20)
        free[number] = free.get(number, 20) - n
        still = [b for b, f in free.items() if f and b not in closed]
        if len(still) > open_bins:
            # One of the fullest closed; the object tells which by not having it any more.
            held = {b for group in bins.bins for b in group}
            gone = [b for b in still if b not in held]
            assert len(gone) == 1 and free[gone[0]] == min(free[b] for b in still)
            closed.add(gone[0])


@settings(max_examples=30, deadline=None)
@given(lengths=st.lists(st.integers(1, 20), min_size=1, max_size=60), order=st.randoms())
def test_groups_are_packed_in_the_order_of_the_input(lengths, order):
    rows = [(i, 0, 0, n, 0, i // 7, i % 7, 3) for i, n in enumerate(lengths)]
    bins = packing.BestFit(20, 4)
    want = {i: bins.add(n) for i, n in enumerate(lengths)}
    order.shuffle(rows)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "serial", "bucket"]
    got = packing._pack_group(20, 4)(pd.DataFrame(rows, columns=names))
    assert {r.doc_id: (r.sequence_id - (3 << 32), r.offset) for r in got.itertuples()} == want


@pytest.fixture(scope="module")
def proto():
    with open(PIECES, "rb") as file:
        return file.read()


@settings(max_examples=300, deadline=None)
@given(text=TEXT, seed=st.integers(0, 1 << 40), document=st.integers(-5, 1 << 62))
def test_dropout_decodes_without_loss(proto, text, seed, document):
    own = dropout.segmenter(proto, 7, 0.5)
    own.seed = seed
    own.fresh, own.old = [{} for _ in range(3)], [{} for _ in range(3)]
    ids = np.frombuffer(own.encode(text, document), dtype="<u4")
    assert own.decode(ids) == text


def test_without_dropout_the_ids_are_the_library_s(proto):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_proto=proto), dropout.Segmenter(proto, 0, 0.0)
    for text in ["", " ", "  a   b ", "x\ty\nz", "日本 𝒳 \x00", "<s> </s> <0x0A>", "a" * 300, *(t for _, t in documents() if t and "▁" not in t)]:
        assert np.frombuffer(own.encode(text, 3), "<u4").tolist() == library.encode(text)
    # Both ways to run the agenda skip alike.
    skipping = dropout.Segmenter(proto, 3, 0.3)
    for text in {w for _, t in documents() for w in (t or "").split() if len(w) <= dropout.SCANNED}:
        assert skipping._scan(list(text), 12345) == skipping._agenda(list(text), 12345)


def test_dropout_share_varies_and_repeats(spark, proto):
    own = dropout.Segmenter(proto, 3, 0.2)
    skips = [own._skips(own._key(f"w{i}", i % 4), i % 9, 300 + i) for i in range(20_000)]
    assert 0.18 < sum(skips) / len(skips) < 0.22
    first = dropout.encode(frame(spark), PIECES, seed=5, check=True).collect()
    assert len(first) == len(documents())
    for r in first:
        assert r.text_sha256 == r.decoded_sha256 and r.n_ids == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, dtype="<u4").tobytes())
    def plain(rows):
        return sorted((str(r.doc_id), r.ids_crc32, r.text_sha256) for r in rows)
    assert plain(first) == plain(dropout.encode(frame(spark).repartition(2), PIECES, seed=5, check=True).collect())
    assert plain(first) != plain(dropout.encode(frame(spark), PIECES, seed=6, check=True).collect())
    copies = {r.ids_crc32 for r in first if r.doc_id in (107, 108)}
    assert len(copies) == 2  # equal texts of two documents differ in their segmentation
    texts = sorted((str(r.doc_id), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in dropout.decode(dropout.encode(frame(spark), PIECES), PIECES).collect())
    assert texts == sorted((str(i), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in documents())
    assert dropout.encode(frame(spark).limit(0), PIECES).count() == 0
