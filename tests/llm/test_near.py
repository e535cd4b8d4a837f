"""The near-copy stage against the Jaccard similarity of all pairs."""

from __future__ import annotations

import random

import corpus_pipeline
import numpy as np
import pytest
import xxhash

from dayslice.llm import near, simhash

from .corpus import documents, frame
from .test_copies import shingles


def plain_components(rows, over=4, under=5):
    """Least index reachable over pairs whose five-word shingles have a similarity of at least over / under."""
    sets, label = [shingles(t or "") for _, t in rows], list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if under * len(sets[i] & sets[j]) >= over * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(rows))]


def edited(count: int, families: int) -> list[tuple[int, str]]:
    """Families of texts with a few words changed: similarities on both sides of 0.8, a passage that all share."""
    dice, out = random.Random(5), []
    passage = " ".join(f"common{i}" for i in range(12))
    for f in range(families):
        base = [f"w{dice.randrange(10_000)}" for _ in range(dice.randrange(20, 160))]
        for _ in range(count):
            own = list(base)
            for _ in range(dice.randrange(0, 2 + len(base) // 25)):
                own[dice.randrange(len(own))] = f"x{dice.randrange(10_000)}"
            out.append((len(out) + 1000, " ".join(own) + " " + passage))
    return out


@pytest.mark.parametrize("least_texts", [1, near.LEAST_TEXTS])
def test_groups_equal_brute_force_jaccard(spark, monkeypatch, least_texts):
    monkeypatch.setattr(near, "LEAST_TEXTS", least_texts)
    rows = documents() + edited(8, 25)
    roots = plain_components(rows)
    least = {r: min((rows[i][0] for i in range(len(rows)) if roots[i] == r and rows[i][0] is not None), default=None) for r in set(roots)}
    want = sorted(((i, least[r]) for (i, _), r in zip(rows, roots, strict=True)), key=str)
    assert sorted((tuple(r) for r in near.group(frame(spark, rows)).collect()), key=str) == want
    assert 30 < len({c for i, c in want if i and i >= 1000}) < 190


def mark(text):
    value = xxhash.xxh64_intdigest((text or "").encode(), 42)
    return value - (1 << 64) if value >> 63 else value


def plain_kept(rows, over=4, under=5):
    """Rows that stay: in the order of ids (null last, then by mark) those similar to none that stays."""
    kept = []
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, mark(r[1]))):
        own = shingles(t or "")
        if not any(under * len(own & k) >= over * len(own | k) for _, _, k in kept):
            kept.append((i, t or "", own))
    return sorted(((i, t) for i, t, _ in kept), key=str)


def staying(df):
    return sorted(((r.doc_id, r.text or "") for r in df.select("doc_id", "text").collect()), key=str)


def chain(n, words=400, step=9):
    """Each text is 0.85 like its neighbour; the similarity falls along the chain."""
    pool = [f"c{i}" for i in range(words + n * 40)]
    return [(5000 + i, " ".join(pool[i * 33 : i * 33 + words])) for i in range(n)]


@pytest.mark.parametrize("nodes", [near.GREEDY_NODES, 1])
def test_stage_equals_the_greedy_rule(spark, monkeypatch, nodes):
    """Texts that are left of a component are ended in one task, or, above a size, in further rounds."""
    monkeypatch.setattr(near, "GREEDY_NODES", nodes)
    rows = edited(6, 12) + chain(8)
    rows += documents() if nodes > 1 else []
    # One id on a text of its own and on a copy of another; copies without an id.
    rows += [(1000, "a text that stands alone under an id that is used twice"), (1001, rows[0][1]), (None, rows[9][1]), (None, "only without an id"), (None, "only without an id")]
    kept = staying(corpus_pipeline.drop_near_copies(spark, frame(spark, rows), ""))
    assert kept == plain_kept(rows)


def test_chain_keeps_what_is_not_similar_to_a_kept_text(spark):
    rows = chain(8)
    sets = [shingles(t) for _, t in rows]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets, sets[1:], strict=False)]
    assert min(alike) >= 0.8 and len(sets[0] & sets[-1]) / len(sets[0] | sets[-1]) < 0.4
    kept = staying(corpus_pipeline.drop_near_copies(spark, frame(spark, rows), ""))
    assert [i for i, _ in kept] == [5000, 5002, 5004, 5006]


def templated(n):
    """Texts of 100 shared and 14 own words: similarities of 0.75, no link."""
    shared = [f"t{i}" for i in range(100)]
    return [(i, " ".join([f"o{i}x{j}" for j in range(14)] + shared)) for i in range(n)]


@pytest.mark.parametrize("seed", range(5))
def test_greedy_equals_all_comparisons(seed):
    dice = random.Random(seed)
    sets = [set(dice.sample(range(14), dice.randrange(0, 14))) for _ in range(80)]
    kept = []
    for i, own in enumerate(sets):
        if not any(5 * len(own & sets[k]) >= 4 * len(own | sets[k]) for k in kept):
            kept.append(i)
    assert near.greedy([np.array(sorted(s), dtype=np.int64) for s in sets]) == kept


def test_templates_make_no_pairs(spark, monkeypatch):
    """What a family shares lies behind the prefix of the smaller set, so no pair of it is looked at."""
    made = []
    real = near.materialize

    def noted(df, label):
        out = real(df, label)
        if label == "pairs":
            made.append(out.count())
        return out

    monkeypatch.setattr(near, "materialize", noted)
    monkeypatch.setattr(near, "SAMPLED", 1)
    rows = templated(300)
    assert len(staying(corpus_pipeline.drop_near_copies(spark, frame(spark, rows), ""))) == 300
    assert made == [0]


def test_nothing_and_empty_texts(spark):
    assert near.keep(frame(spark, [(1, "a")]).limit(0)).count() == 0
    rows = [(3, ""), (2, None), (None, " \n"), (5, "a b"), (4, "A B")]
    assert staying(corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "")) == [(2, ""), (4, "A B")]


def test_simhash_finds_pairs_of_the_stage(spark, monkeypatch):
    """All fingerprints go through the SimHash search and it makes pairs; what it misses is found too."""
    made = []
    real = near.links

    def noted(distinct):
        out = real(distinct)
        made.append((distinct.count(), out.count()))
        return out

    monkeypatch.setattr(near, "links", noted)
    base = [f"w{i}" for i in range(600)]
    rows = [(i, " ".join([*base[: 599 - i], f"end{i}"])) for i in range(4)] + edited(4, 6)
    assert staying(corpus_pipeline.drop_near_copies(spark, frame(spark, rows), "")) == plain_kept(rows)
    # Each round sees every fingerprint that is left.
    prints = {simhash.of_hashes(near.shingles(t.encode()).view(np.uint64)) for _, t in rows}
    assert made[0][0] == len(prints) and made[0][1] >= 1
    nodes = [(near.node_of(s), len(s), simhash.of_hashes(s.view(np.uint64))) for s in (near.shingles(t.encode()) for _, t in rows)]
    signed = [(n, z, f - (1 << 64) if f >> 63 else f) for n, z, f in nodes]
    pairs = near.simhash_pairs(spark.createDataFrame(signed, "node bigint, size int, fp bigint")).collect()
    assert pairs and all(r.a < r.b for r in pairs)


def test_simhash_of_hashes_equals_that_of_the_text():
    for text in (b"", b"one", b"a b c d e f g h i j k l m n o p"):
        assert simhash.of_hashes(near.shingles(text, simhash.WORDS).view(np.uint64)) == simhash.fingerprint(text)


@pytest.mark.parametrize("size", [0, 1, 40, 600, 5_000])
def test_parities_bound_the_difference_of_two_sets(size):
    dice = np.random.default_rng(size)
    bits = lambda s: int.from_bytes(near.parity(s).tobytes(), "little")
    draw = lambda n: dice.integers(-(1 << 63), (1 << 63) - 1, n)
    base = np.unique(draw(size))
    for gone in {0, 1, size // 20, size // 4, size}:
        other = np.unique(np.concatenate((base[min(gone, len(base)) :], draw(gone))))
        differing = (bits(base) ^ bits(other)).bit_count()
        assert differing <= len(np.setxor1d(base, other))
        if 0 < gone <= 20 and size >= 40:
            assert differing >= len(np.setxor1d(base, other)) * 0.8
    assert bits(base) == bits(base[::-1])
