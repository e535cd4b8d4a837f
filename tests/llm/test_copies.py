"""SimHash groups, line de-duplication and sketches against brute force."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dayslice.llm import lines, simhash, sketch

from .corpus import documents, frame, prose


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def plain_groups(values, budget):
    """Least index reachable over pairs within the budget."""
    label = list(range(len(values)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= budget:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(values))]


def test_groups_equal_brute_force(spark):
    rows = documents()
    fps = [plain_fingerprint(t) for _, t in rows]
    roots = plain_groups(fps, 2)
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in set(roots)}
    want = sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, roots, strict=True)), key=str)
    got = sorted((tuple(r) for r in simhash.group(frame(spark)).collect()), key=str)
    assert got == want and len({w[2] for w in want}) < len(want) - 5
    assert simhash.group(frame(spark).limit(0)).count() == 0


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = prose(3, 2000).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "SLICE_SHINGLES", 7)
    assert simhash.fingerprint(text) == whole == plain_fingerprint(text.decode())


@pytest.mark.parametrize(("budget", "parts"), [(1, 2), (2, 4), (3, 5), (2, 3), (7, 10)])
def test_links_join_what_brute_force_joins(spark, monkeypatch, budget, parts):
    monkeypatch.setattr(simhash, "FRONTIER", 16)
    monkeypatch.setattr(simhash, "BUFFER_ROWS", 64)
    rng = np.random.default_rng(budget)
    values = {int(v) for v in rng.integers(0, 1 << 64, 60, dtype=np.uint64)} | {0, (1 << 64) - 1}
    for v in list(values):
        for _ in range(6):
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                v ^= 1 << int(b)
            values.add(v)
    ordered = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in ordered]
    edges = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"), budget, parts)
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    want = plain_groups(ordered, budget)
    groups = defaultdict(set)
    for v, r in zip(signed, want, strict=True):
        groups[r].add(v)
    mine = defaultdict(set)
    for v in signed:
        mine[found.get(v, v)].add(v)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in mine.values()}


@settings(max_examples=60, deadline=None)
@given(values=st.sets(st.integers(0, 255).map(lambda x: x << 56 | x), min_size=1, max_size=60), budget=st.integers(0, 4))
def test_trie_finds_every_pair_once(values, budget):
    ordered = np.array(sorted(values), dtype=np.uint64)
    a, b = simhash.trie_links(ordered, budget, np.array([0]), np.array([len(ordered)]))
    found = sorted(zip(a.tolist(), b.tolist(), strict=True))
    want = [(i, j) for i in range(len(ordered)) for j in range(i + 1, len(ordered)) if (int(ordered[i]) ^ int(ordered[j])).bit_count() <= budget]
    assert found == want


def test_a_family_of_copies_is_folded_piece_by_piece(monkeypatch):
    """Many values within the budget of each other: pieces of pairs come and go, components stay."""
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    values = np.array(sorted({1 << a | 1 << b for a in range(40) for b in range(a)}), dtype=np.uint64)
    largest = 0
    for a, _ in simhash.trie_pairs(values, 4, np.array([0]), np.array([len(values)])):
        largest = max(largest, len(a))
    assert largest <= 64 * 4
    assert set(simhash.trie_roots(values, 4, np.array([0]), np.array([len(values)])).tolist()) == {0}
    apart = np.array([0, 3, 15 << 40, 15 << 40 | 1, (1 << 64) - 1], dtype=np.uint64)
    assert simhash.trie_roots(apart, 2, np.array([0]), np.array([5])).tolist() == [0, 0, 2, 2, 4]


def test_components_of_a_long_chain_and_of_none(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)]
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert {found.get(i, i) for i in range(301)} == {0} and found[1001] == 1000
    assert simhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_lines(rows, least):
    white = " \t\n\x0b\f\r"

    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(white))

    seen = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            seen[key(line)].add(i)
    out = []
    for i, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if not key(x) or len(seen[key(x)]) < least]
        out.append((i, len(every), len(every) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_common_lines_leave_all_documents(spark):
    rows = documents() + [(400 + i, "ÄÖ Line\r\n\n own %d" % i) for i in range(11)] + [(500, "äö line")]
    got = sorted((tuple(r) for r in lines.digests(frame(spark, rows)).collect()), key=str)
    want = plain_lines(rows, 10)
    assert got == want and sum(w[2] for w in want) > 20
    assert lines.digests(frame(spark).limit(0)).count() == 0


def test_lines_keep_other_columns_and_need_enough_characters(spark):
    docs = frame(spark).withColumn("n_lines", F.lit("own"))
    kept = lines.drop_common_lines(docs, least_documents=3, least_chars=4)
    assert set(kept.columns) == {*docs.columns, "n_dropped"}
    assert dict(kept.dtypes)["n_lines"] == "bigint" and kept.count() == len(documents())
    assert {r.score for r in kept.collect()} == {1.5}
    assert {r.text for r in kept.where("doc_id between 200 and 211 and n_dropped <> 2").collect()} == set()


def shingles(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def ordered(rows):
    """Descending ids, null last; ids of the fixture that repeat are left out."""
    seen = defaultdict(int)
    for i, _ in rows:
        seen[i] += 1
    single = [(i, t or "") for i, t in rows if i is not None and seen[i] == 1]
    return sorted(single, key=lambda r: -r[0])


def test_sketches_follow_the_next_document(spark):
    rows = ordered(documents())
    got = {r.doc_id: r for r in sketch.fingerprint(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    errors = []
    for (i, text), (_, following) in zip(rows, rows[1:] + rows[:1], strict=True):
        changed = sketch.edited(text, following)
        r = got[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == sketch.sketches([text])[0].text() and r.edited_fingerprint == sketch.sketches([changed])[0].text()
        own, new, other = shingles(text), shingles(changed), shingles(following)
        if own:
            errors.append(abs(r.near_edited - len(own & new) / len(own)))
            assert abs(r.near_next - len(own & other) / len(own)) < 0.35
        else:
            assert r.near_next == float(not other)
    assert np.mean(errors) < 0.06
    assert got[107].fingerprint == got[108].fingerprint == got[109].fingerprint and got[109].near_next == 1.0


def test_sketch_edge_cases(spark):
    assert sketch.fingerprint(frame(spark).limit(0)).count() == 0
    one = sketch.fingerprint(frame(spark, [(5, "abc def")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abc dab").hexdigest() and one.near_next == 1.0
    assert sketch.fingerprint(frame(spark)).count() == len(documents())
    nulls = {r.doc_id: r for r in sketch.fingerprint(frame(spark, [(None, "last of all"), (1, "first")])).collect()}
    assert nulls[1].edited_sha256 == hashlib.sha256(b"firsl").hexdigest()


def test_sketches_merge_and_compare_unequal_sizes(monkeypatch):
    small, large = prose(1, 400), prose(1, 400) + " " + prose(2, 9000)
    a, b, c = sketch.sketches([small, large, prose(3, 400)])
    assert a.contained(b) > 0.95 > 0.2 > b.contained(a) and c.contained(b) < 0.2
    merged = sketch.sketches([prose(2, 9000)])[0].merge(a)
    assert merged.contained(b) > 0.95 and sketch.Sketch.parse(merged.text()).text() == merged.text()
    whole = [s.text() for s in sketch.sketches([small, large])]
    monkeypatch.setattr(sketch, "SLICE_BYTES", 500)
    assert [s.text() for s in sketch.sketches([small, large])] == whole


def test_short_texts_tell_when_nothing_was_compared():
    whole = [f"w{i}" for i in range(5000)]
    long_one = " ".join(whole)
    texts = [" ".join(whole[7 * i : 7 * i + 9]) for i in range(200)]
    big = sketch.sketches([long_one])[0]
    found = [(s.compared(big), s.contained(big)) for s in sketch.sketches(texts)]
    # All are contained: with evidence the answer is 1, without it is 0 and says so.
    assert {c for n, c in found if n} == {1.0} and {c for n, c in found if not n} == {0.0}
    assert 0.2 < sum(1 for n, _ in found if not n) / 200 < 0.8 and len(long_one) > 20_000
