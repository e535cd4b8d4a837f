"""PPM against a plain trie, the label model and classifier on planted words."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from dayslice.llm import ppm, toxicity

from .corpus import documents, frame, prose


def held(i, modulus, rest=2):
    return i is not None and zlib.crc32(str(i).encode()) % modulus == rest


def brute_ppm(rows):
    """log10 probability of a text under the contexts of all rows that are learned."""
    trie = [defaultdict(Counter) for _ in range(6)]
    for i, text in rows:
        if not held(i, 7):
            data = b"\xfe" * 5 + (text or "").encode().lower() + b"\xff"
            for p in range(5, len(data)):
                for order in range(6):
                    trie[order][data[p - order : p]][data[p]] += 1

    def of(text):
        data, total = b"\xfe" * 5 + (text or "").encode().lower() + b"\xff", 0.0
        for p in range(5, len(data)):
            excluded = set()
            for order in range(5, -1, -1):
                counts = {k: n for k, n in trie[order].get(data[p - order : p], {}).items() if k not in excluded}
                if not counts:
                    continue
                whole = sum(counts.values()) + len(counts)
                if data[p] in counts:
                    total += math.log10(counts[data[p]] / whole)
                    break
                total += math.log10(len(counts) / whole)
                excluded |= set(counts)
            else:
                total -= math.log10(256 - len(excluded))
        return total

    return of


def test_ppm_equals_a_plain_trie(spark):
    rows = documents()
    of = brute_ppm(rows)
    counts = Counter()
    for i, text in rows:
        if not held(i, 7):
            counts.update((text or "").encode().lower().split() + [b""])
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, text in rows:
        tokens = (text or "").encode().lower().split() + [b""]
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens)
        want.append((str(i), held(i, 7), len(tokens), sum(counts[w] > 0 for w in tokens), n, base, of(text)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ppm.score(frame(spark)).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-5)


def test_ppm_does_not_depend_on_shards_or_slices(spark, monkeypatch):
    rows = [(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 2)) for r in ppm.score(frame(spark), shards=3).collect()]
    # A text longer than a slice is cut into pieces of one chunk.
    texts = [(t or "").encode().lower() for _, t in documents()]
    whole = sorted(x for b, p, _ in ppm._pieces(texts, 1 << 20) for x in ppm._grams(b, p).tolist())
    parts = sorted(x for b, p, _ in ppm._pieces(texts, 1000) for x in ppm._grams(b, p).tolist())
    assert whole == parts
    again = [(r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 2)) for r in ppm.score(frame(spark)).collect()]
    assert sorted(rows, key=str) == sorted(again, key=str)


def test_ppm_without_rows_and_without_training(spark):
    assert ppm.score(frame(spark).limit(0)).count() == 0
    only = frame(spark, [(i, "abc") for i in range(200) if held(i, 7)][:1])
    row = ppm.score(only).first()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0
    assert row.score == pytest.approx(-4 * math.log10(256)) and row.base_score == 0.0


BAD = ["vaxolit", "vaxorun", "vaxomel", "vaxotan", "snerk", "blorg"]


def toxic_rows(n=400):
    """Every fourth text holds bad words; in the held-out ones some have endings never labelled."""
    out = []
    for i in range(n):
        bad = i % 4 == 0
        words = prose(i + 1, 60).split(" ")
        if bad:
            words[5:5] = [BAD[(i // 4 + k) % len(BAD)] for k in range(3)]
            if held(i, 4):
                words[30:30] = [f"vaxo{i}en", "vaxoquil"]
        out.append((i, " ".join(words), int(bad)))
    return out


def test_toxicity_finds_held_out_rows_and_leaves_clean_ones(spark):
    rows = toxic_rows()
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id bigint, quality int, toxic int")
    docs = frame(spark, [(i, t) for i, t, _ in rows] + [(9000, None), (9001, ""), (None, "blorg snerk blorg vaxolit"), (0, rows[0][1])])
    got = toxicity.score(docs, labels)
    assert set(got.columns) == {*docs.columns, "held_out", "predicted"} - {"text"}
    truth = {i: y for i, _, y in rows}
    found = [(r.doc_id, r.held_out, r.score, r.predicted) for r in got.collect()]
    assert len(found) == len(rows) + 4
    for i, is_held, score, predicted in found:
        assert 0 <= score <= 1 and predicted == int(score >= 0.3) and is_held == held(i, 4)
        if i in truth:
            assert predicted == truth[i]
    by = {i: p for i, _, _, p in found}
    assert by[9000] == by[9001] == 0 and by[None] == 1


def test_labels_of_held_out_rows_change_nothing(spark):
    rows = toxic_rows(200)
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    turned = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id, r.score) for r in toxicity.score(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    empty = spark.createDataFrame([(None, 1), (1, None)], "doc_id bigint, toxic int")
    assert toxicity.score(frame(spark).limit(0), none).count() == 0
    for labels in (none, empty):
        assert {r.predicted for r in toxicity.score(frame(spark), labels).collect()} == {0}


def test_label_model_does_not_count_copies_of_a_voter_as_evidence():
    import numpy as np

    rng = np.random.default_rng(5)
    n = 20_000
    truth = rng.random(n) < 0.2
    good = np.where(truth, rng.random(n) < 0.8, rng.random(n) < 0.02)
    weak = np.where(truth, rng.random(n) < 0.4, rng.random(n) < 0.2)
    votes = np.zeros(n, dtype=np.int64)
    for j in (0, 1):
        own = np.where(truth, rng.random(n) < 0.8, rng.random(n) < 0.02)
        votes |= own.astype(np.int64) << j
    votes |= good.astype(np.int64) << 2
    for j in (3, 4, 5, 6):
        votes |= weak.astype(np.int64) << j  # four copies of one weak voter
    masks, inverse = np.unique(votes, return_inverse=True)
    counts = np.bincount(inverse).astype(float)
    gold = np.zeros((len(masks), 2))
    for y in (0, 1):
        gold[:, y] = np.bincount(inverse[:1000], weights=truth[:1000] == y, minlength=len(masks))
    model = toxicity.LabelModel(masks, counts, gold)
    copies_only = model.toxic(np.array([0b1111000]))[0]
    strong = model.toxic(np.array([0b0000111]))[0]
    assert copies_only < 0.3 < 0.9 < strong
    assert sum(model.parent[j] in (3, 4, 5, 6) for j in (3, 4, 5, 6)) >= 3


def test_posterior_equals_plain_products():
    rng = np.random.default_rng(6)
    masks = np.unique(rng.integers(0, 1 << toxicity.VOTERS, 60))
    counts = rng.integers(1, 50, len(masks)).astype(float)
    gold = np.stack([np.minimum(counts, rng.integers(0, 4, len(masks))) * (i == (masks & 1)) for i in (0, 1)], axis=1).astype(float)
    model = toxicity.LabelModel(masks, counts, gold)
    for mask, got in zip(masks.tolist(), model.toxic(masks), strict=True):
        chance = []
        for y in (0, 1):
            p = float(model.prior[y])
            for j in range(toxicity.VOTERS):
                above = mask >> int(model.parent[j]) & 1 if model.parent[j] >= 0 else 0
                on = float(model.rate[y, above, j])
                p *= on if mask >> j & 1 else 1 - on
            chance.append(p)
        assert got == pytest.approx(chance[1] / sum(chance), rel=1e-9)


def test_training_equals_a_plain_regression(spark):
    rng = np.random.default_rng(8)
    rows = []
    for n in range(60):
        bad = n % 6 == 0
        own = sorted({int(x) for x in rng.integers(0, 30, 8)} | ({100, 101} if bad else set()) | ({-5} if n % 3 == 0 else set()))
        rows.append((n * 7 - 50, 0.9 if bad else 0.05, own))
    sample = spark.createDataFrame(rows, "n bigint, chance double, features array<bigint>").repartition(3)
    weights, bias = toxicity.train(spark, sample)
    share = sum(c for _, c, _ in rows) / len(rows)
    mass = {f: [c for _, c, own in rows if f in own] for f in {f for _, _, own in rows for f in own}}
    telling = sorted(f for f, c in mass.items() if sum(c) >= toxicity.LEAST_MASS and sum(c) / len(c) >= min(toxicity.LEAST_SHARE * share, 0.9))
    assert {100, 101} <= set(telling) and sorted(w - (1 << 64) if w >> 63 else w for w in weights) == telling
    # The plain form: a dense matrix and the same steps.
    x, t = np.array([[f in own for f in telling] for _, _, own in rows], dtype=float), np.array([c for _, c, _ in rows])
    w, b, squares, square = np.zeros(len(telling)), math.log(share / (1 - share)), np.full(len(telling), 1e-8), 1e-8
    for _ in range(300):
        error = 1 / (1 + np.exp(-(x @ w + b))) - t
        slope = x.T @ error + 0.05 * w
        squares, square = squares + slope**2, square + error.sum() ** 2
        w, b = w - 0.3 * slope / np.sqrt(squares), b - 0.3 * error.sum() / math.sqrt(square)
    assert [weights[f % (1 << 64)] for f in telling] == pytest.approx(w.tolist(), abs=1e-6) and bias == pytest.approx(b, abs=1e-6)


def test_score_is_the_sum_of_the_weights_of_distinct_features(spark):
    texts = ["Bad word here", "bad bad BAD", "", None, "nothing"]
    frame_of = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    weights = {xxhash.xxh64_intdigest(f.encode()): 0.5 + i for i, f in enumerate(sorted(toxicity.features("bad")))}
    model = spark.sparkContext.broadcast((weights, -1.0))
    got = {r.doc_id: r.score for r in frame_of.mapInArrow(toxicity._scored(model, ["doc_id"], "text"), "doc_id bigint, score double").collect()}
    for i, t in enumerate(texts):
        found = {xxhash.xxh64_intdigest(f.encode()) for w in (t or "").lower().split() for f in toxicity.features(w)}
        assert got[i] == pytest.approx(1 / (1 + math.exp(1.0 - sum(weights[h] for h in found if h in weights))))
