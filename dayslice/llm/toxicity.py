"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Words and word beginnings that labelled rows show to be telling are dealt to lexicon voters; pattern voters add
   repeated hits, dense hits, shouting and exclamation marks.
2. All texts vote. Spark counts each combination of votes, at most 2**VOTERS rows whatever the corpus.
3. A two-class model of the votes is fitted to these counts by expectation maximization: each voter has its accuracy in
   each class, and voters that agree beyond their class are tied in a tree of conditional probabilities, so that ten copies
   of one signal do not count as ten. Labels only start it and stand for themselves.
4. A logistic regression learns the posterior of a bounded sample of texts from words and word beginnings.
5. All texts are scored by it.

Two bounded samples are parameters: labelled rows for the lexicons and texts for the classifier. The votes and scores cover all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import id_bucket, ship, slices, whole_text

LABELLED_ROWS = 20_000
#: A feature is learned from a posterior mass of so many toxic texts, and from a share of so many times the average.
LEAST_MASS, LEAST_SHARE = 2.0, 4.0
TRAINING_TEXTS = 8_000
THRESHOLD = 0.3
#: Telling words and beginnings: at most so many, each in several toxic rows and far more often there than elsewhere.
LEXICON = 400
LEAST_TOXIC, LEAST_LIFT, LEAST_PRECISION = 4, 8.0, 0.75
WORD_LISTS, STEM_LISTS = 4, 4
TWICE, DENSE, SHOUT, MARKS = (WORD_LISTS + STEM_LISTS + i for i in range(4))
VOTERS = WORD_LISTS + STEM_LISTS + 4
DENSE_SHARE, SHOUT_SHARE = 0.01, 0.3
STEMS = (3, 4, 5)
EDGE = ".,;:!?\"'()[]{}*#%$&-_"
UPPER = bytes(range(65, 91))
#: Bytes of text that a task turns into Python strings at once.
SLICE_BYTES = 2 << 20
#: Words a worker remembers.
CACHE_WORDS = 150_000


def features(word: str) -> list[str]:
    """The word without marks at its ends, and its beginnings of three to five letters."""
    word = word.strip(EDGE)
    if not word:
        return []
    return ["w" + word, *(f"{n}{word[:n]}" for n in STEMS if len(word) > n)]


class Remembered(dict):
    """Values of words by a function, kept up to a bound."""

    def __init__(self, value):
        super().__init__()
        self.value = value

    def __missing__(self, word):
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = self.value(word)
        return found


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic) of every distinct feature of each labelled text."""
    for rows in slices(batches, "text", SLICE_BYTES):
        found, toxic = [], []
        for text, label in zip(rows["text"], rows["toxic"], strict=True):
            own = {f for w in set(text.lower().split()) for f in features(w)}
            found += own
            toxic += [label] * len(own)
        yield pa.RecordBatch.from_pydict({"feature": pa.array(found, pa.string()), "toxic": pa.array(toxic, pa.int32())})


def lexicon(labelled: DataFrame, most: int = LEXICON) -> list[tuple[str, int]]:
    """(feature, voter) of the telling words and beginnings, the most frequent first; at most `most` of either kind."""
    totals = labelled.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("rows")).first()
    toxic, clean = int(totals.toxic or 0), int(totals.rows) - int(totals.toxic or 0)
    if not toxic or not clean:
        return []
    counts = labelled.mapInArrow(_listed, "feature string, toxic int").groupBy("feature").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
    )
    lift = (F.col("bad") / toxic) / ((F.col("good") + 0.5) / clean)
    telling = counts.where(
        (F.col("bad") >= LEAST_TOXIC) & (lift >= LEAST_LIFT) & (F.col("bad") / (F.col("bad") + F.col("good")) >= LEAST_PRECISION)
    )
    out = []
    for first, lists, kind in ((0, WORD_LISTS, F.col("feature").startswith("w")), (WORD_LISTS, STEM_LISTS, ~F.col("feature").startswith("w"))):
        best = telling.where(kind).orderBy(F.desc("bad"), "good", "feature").limit(most).select("feature").collect()
        out += [(r.feature, first + i % lists) for i, r in enumerate(best)]
    return out


def voter(entries: list[tuple[str, int]]):
    """Function from a text to its votes as bits."""
    table = {feature: 1 << number for feature, number in entries}

    def of_word(word: str) -> int:
        bits = 0
        for feature in features(word):
            bits |= table.get(feature, 0)
        return bits

    known = Remembered(of_word)

    def vote(text: str) -> int:
        words = set(text.lower().split())
        hits = [b for b in map(known.__getitem__, words) if b]
        votes = 0
        for bits in hits:
            votes |= bits
        if len(hits) > 1:
            votes |= 1 << TWICE
        if hits and len(hits) >= DENSE_SHARE * len(words):
            votes |= 1 << DENSE
        data = text.encode("utf-8", "surrogatepass")
        if len(data) >= 20 and len(data) - len(data.translate(None, UPPER)) > SHOUT_SHARE * len(data):
            votes |= 1 << SHOUT
        if "!!" in text:
            votes |= 1 << MARKS
        return votes

    return vote


def _vote(entries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = voter(entries.value)
        for rows in slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_pydict({"votes": pa.array([vote(t) for t in rows["text"]], pa.int64())})

    return run


class LabelModel:
    """Two classes, binary voters; each voter depends on the class and on at most one other voter."""

    def __init__(self, votes: np.ndarray, counts: np.ndarray, gold: np.ndarray, rounds: int = 60):
        """`votes` are distinct combinations as bits, `counts` how often each occurs, `gold` (combinations x 2) how often
        with a known label; the known ones are part of the counts."""
        self.bits = ((votes[:, None] >> np.arange(VOTERS)) & 1).astype(np.int64)
        # Known labels start the model.
        share = np.clip(gold[:, 1].sum() / max(1.0, gold.sum()), 0.001, 0.999)
        rates = [(gold.T @ self.bits + 1.0) / (gold.sum(0)[:, None] + np.array([2.0, 2.0])[:, None])]
        self.parent = np.full(VOTERS, -1)
        self.prior = np.array([1 - share, share])
        # Index: class, value of the parent, voter.
        self.rate = np.stack([np.stack([rates[0][y]] * 2) for y in (0, 1)])
        unknown = counts - gold.sum(1)
        weight = gold + unknown[:, None] * self.posterior(self.bits)
        self.parent = self._tree(weight)
        for _ in range(rounds):
            self._fit(weight)
            weight = gold + unknown[:, None] * self.posterior(self.bits)

    def _tree(self, weight: np.ndarray, least: float = 1e-4) -> np.ndarray:
        """Parents by the largest mutual information of two voters given the class."""
        total = weight.sum()
        strength = np.zeros((VOTERS, VOTERS))
        for y in (0, 1):
            w = weight[:, y]
            mass = w.sum() + 1e-9
            one = w @ self.bits / mass
            both = (self.bits * w[:, None]).T @ self.bits / mass
            for a_on in (0, 1):
                for b_on in (0, 1):
                    pa_, pb_ = (one if a_on else 1 - one), (one if b_on else 1 - one)
                    joint = both if a_on and b_on else one[:, None] - both if a_on else one[None, :] - both if b_on else 1 - one[:, None] - one[None, :] + both
                    joint = np.clip(joint, 1e-12, 1)
                    strength += mass / total * joint * np.log(joint / np.clip(pa_[:, None] * pb_[None, :], 1e-12, 1))
        parent, inside = np.full(VOTERS, -1), {0}
        while len(inside) < VOTERS:
            value, child, from_ = max((strength[i, j], j, i) for i in inside for j in range(VOTERS) if j not in inside)
            parent[child] = from_ if value >= least else -1
            inside.add(child)
        return parent

    def _fit(self, weight: np.ndarray) -> None:
        self.prior = np.clip(weight.sum(0) / weight.sum(), 1e-6, 1)
        for y in (0, 1):
            for j in range(VOTERS):
                for value in (0, 1):
                    w = weight[:, y] if self.parent[j] < 0 else weight[:, y] * (self.bits[:, self.parent[j]] == value)
                    self.rate[y, value, j] = (w @ self.bits[:, j] + 0.1) / (w.sum() + 0.2)

    def posterior(self, bits: np.ndarray) -> np.ndarray:
        """Probability of each class (columns) for rows of votes."""
        log = np.log(np.broadcast_to(self.prior, (len(bits), 2))).copy()
        for y in (0, 1):
            for j in range(VOTERS):
                given = bits[:, self.parent[j]] if self.parent[j] >= 0 else np.zeros(len(bits), dtype=np.int64)
                p = self.rate[y, given, j]
                log[:, y] += np.log(np.where(bits[:, j] == 1, p, 1 - p))
        log -= log.max(1, keepdims=True)
        odds = np.exp(log)
        return odds / odds.sum(1, keepdims=True)

    def toxic(self, votes: np.ndarray) -> np.ndarray:
        return self.posterior(((votes[:, None] >> np.arange(VOTERS)) & 1).astype(np.int64))[:, 1]


def _hashes(word: str) -> tuple[int, ...]:
    return tuple(xxhash.xxh64_intdigest(f.encode("utf-8", "surrogatepass")) for f in features(word))


def _sampled(entries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote, known = voter(entries.value), Remembered(_hashes)
        for rows in slices(batches, "text", SLICE_BYTES):
            found = [{h for w in set(t.lower().split()) for h in known[w]} for t in rows["text"]]
            data = [np.sort(np.fromiter(f, dtype=np.uint64, count=len(f))).view(np.int64) for f in found]
            ends = np.cumsum([0, *map(len, data)]).astype(np.int32)
            names = [xxhash.xxh64_intdigest(f"{d}|{m}") - (1 << 63) for d, m in zip(rows["_doc"], rows["_mark"], strict=True)]
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *data])))
            yield pa.RecordBatch.from_pydict({"n": pa.array(names, pa.int64()), "votes": pa.array([vote(t) for t in rows["text"]], pa.int64()), "features": listed})

    return run


def fit(row: np.ndarray, column: np.ndarray, features: int, target: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression of soft labels on the presence of features: (weights, bias); `row` and `column` are the ones of the matrix."""
    share = float(np.clip(target.mean() if len(target) else 0.0, 1e-6, 1 - 1e-6))
    bias = float(np.log(share / (1 - share)))
    weight, squares, square = np.zeros(features), np.full(features, 1e-8), 1e-8
    for _ in range(rounds if features else 0):
        margin = np.bincount(row, weights=weight[column], minlength=len(target)) + bias
        error = 1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target
        slope = np.bincount(column, weights=error[row], minlength=features) + 0.05 * weight
        squares += slope**2
        square += error.sum() ** 2
        weight -= 0.3 * slope / np.sqrt(squares)
        bias -= 0.3 * float(error.sum()) / np.sqrt(square)
    return weight, bias


def leaning(sample: DataFrame, share: float, least: float = LEAST_MASS, lift: float = LEAST_SHARE) -> np.ndarray:
    """Features of the sample (n, chance, features) that lean to the toxic class, ascending; mass and frequency are summed in Spark."""
    mass = sample.select(F.explode("features").alias("feature"), "chance").groupBy("feature").agg(F.sum(F.round("chance", 9).cast("decimal(20,9)")).cast("double").alias("mass"), F.count("*").alias("n"))
    kept = mass.where((F.col("mass") >= least) & (F.col("mass") / F.col("n") >= min(lift * share, 0.9)))
    return np.sort(kept.select("feature").toArrow().column("feature").to_numpy())


def _rows_of(features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = features.value
        for batch in batches:
            ends = np.concatenate([[0], np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))])
            own = pa.concat_arrays([batch.column(1)]).flatten().to_numpy()
            at = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
            used = known[at] == own if len(known) else np.zeros(len(own), bool)
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[used])), pa.array(at[used].astype(np.int32))], names=["n", "feature"])

    return run


def train(spark: SparkSession, sample: DataFrame) -> tuple[dict[int, float], float]:
    """(weight of each leaning feature, bias) for a written sample (n, chance, features).

    The driver gets the leaning features and, for each text of the sample, which of them it has; the features of whole texts stay in Spark.
    """
    rows = sample.select("n", "chance").orderBy("n").toArrow()
    numbers, target = rows.column("n").to_numpy(), rows.column("chance").to_numpy()
    share = float(target.mean()) if len(target) else 0.0
    features = leaning(sample, share) if target.sum() >= LEAST_MASS else np.zeros(0, np.int64)
    ones = sample.select("n", "features").mapInArrow(_rows_of(spark.sparkContext.broadcast(features)), "n bigint, feature int").orderBy("n", "feature").toArrow()
    row = np.searchsorted(numbers, ones.column("n").to_numpy())
    weight, bias = fit(row, ones.column("feature").to_numpy(), len(features), target)
    return dict(zip(features.view(np.uint64).tolist(), weight.tolist(), strict=True)), bias


def _scored(model, kept: list[str], text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        telling = Remembered(lambda word: tuple(h for h in _hashes(word) if h in weights))
        for batch in batches:
            for rows in slices([batch], text, SLICE_BYTES):
                margins = []
                for one in rows[text]:
                    found = {h for hs in map(telling.__getitem__, set((one or "").lower().split())) if hs for h in hs}
                    margins.append(bias + sum(weights[h] for h in sorted(found)))
                score = 1 / (1 + np.exp(-np.clip(np.array(margins), -50, 50)))
                columns = [pa.array(rows[n], batch.schema.field(n).type) for n in kept]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[*kept, "score"])

    return run


def score(
    docs: DataFrame,
    labels: DataFrame,
    held_out: Column | None = None,
    text: str = "text",
    doc_id: str = "doc_id",
    labelled_rows: int = LABELLED_ROWS,
    training_texts: int = TRAINING_TEXTS,
    keep_text: bool = False,
) -> DataFrame:
    """`docs` without their text (or with it), and columns held_out, score and predicted.

    `labels` has doc_id and toxic (0 or 1; rows with a null in either are not used; of several rows for one id the highest
    label counts). Rows that `held_out` marks (default: crc32 of the id modulo 4 is 2) lend no label. A null text is
    empty and gets the score of a text without telling words; null ids are scored. Without labels of both kinds all scores
    are the share of toxic rows. Repeated rows come out as often as they came in; own columns named held_out, score or predicted are
    replaced. An empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    held = F.coalesce(id_bucket(doc_id, 4) == 2, F.lit(False)) if held_out is None else held_out
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # The rows of the least hashes are a sample that does not depend on how the table is cut.
    wanted = known.where(~F.coalesce(id_bucket("doc_id", 4) == 2, F.lit(False))) if held_out is None else known
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled_rows).withColumnRenamed("doc_id", "_id")
    plain = docs.select(F.col(doc_id).alias("_doc"), whole_text(text).alias("text"), held.alias("_held"))
    # At most `labelled_rows` rows of two numbers are broadcast.
    labelled = plain.where(~F.col("_held")).join(F.broadcast(wanted), F.col("_doc") == F.col("_id")).select("text", "toxic")
    labelled = labelled.persist()
    entries = spark.sparkContext.broadcast(lexicon(labelled))
    own = labelled.select("toxic", "text")
    gold_rows = own.mapInArrow(_labelled_votes(entries), "votes bigint, toxic int").groupBy("votes", "toxic").count().collect()
    labelled.unpersist()
    counted = plain.select("text").mapInArrow(_vote(entries), "votes bigint").groupBy("votes").count().collect()
    votes = np.array(sorted({r.votes for r in counted} | {r.votes for r in gold_rows}), dtype=np.int64)
    at = {v: i for i, v in enumerate(votes.tolist())}
    counts, gold = np.zeros(len(votes)), np.zeros((len(votes), 2))
    for r in counted:
        counts[at[r.votes]] += r["count"]
    for r in gold_rows:
        gold[at[r.votes], int(r.toxic > 0)] += r["count"]
    counts = np.maximum(counts, gold.sum(1))
    # The rows of the least hashes of id and text, so that many rows of one id, or without one, are no block; alike rows count once.
    marked = plain.where(~F.col("_held")).withColumn("_mark", F.xxhash64("text"))
    least = marked.select("_doc", "_mark").orderBy(F.xxhash64("_doc", "_mark"), "_doc", "_mark").limit(training_texts)
    least = least.distinct().select(F.col("_doc").alias("_id"), F.col("_mark").alias("_chosen"))
    texts = marked.join(F.broadcast(least), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_mark") == F.col("_chosen")), "left_semi")
    seen = texts.select("_doc", "_mark", "text").mapInArrow(_sampled(entries), "n bigint, votes bigint, features array<bigint>").dropDuplicates(["n"])
    sample = materialize(seen, "toxicity-sample")
    met = np.array(sorted(r.votes for r in sample.select("votes").distinct().collect()), dtype=np.int64)
    if len(votes) and entries.value:
        chance = LabelModel(votes, counts, gold).toxic(met)
    else:
        chance = np.full(len(met), gold[:, 1].sum() / max(1.0, gold.sum()))
    # A row for each combination of votes, at most 2^VOTERS.
    chances = spark.createDataFrame(list(zip(met.tolist(), chance.tolist(), strict=True)), "votes bigint, chance double")
    learned = spark.sparkContext.broadcast(train(spark, sample.join(F.broadcast(chances), "votes").select("n", "chance", "features")))
    names = [c for c in docs.columns if c not in ("held_out", "score", "predicted") and (keep_text or c != text)]
    # A text that is kept travels once.
    own_text = text if keep_text else "_text"
    extra = [] if keep_text else [whole_text(text).alias("_text")]
    marked = docs.select(*names, held.alias("held_out"), *extra)
    kept = [*names, "held_out"]
    schema = marked.select(*kept, F.lit(0.0).alias("score")).schema
    scored = marked.mapInArrow(_scored(learned, kept, own_text), schema)
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def _labelled_votes(entries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vote = voter(entries.value)
        for rows in slices(batches, "text", SLICE_BYTES):
            yield pa.RecordBatch.from_pydict(
                {"votes": pa.array([vote(t) for t in rows["text"]], pa.int64()), "toxic": pa.array(rows["toxic"], pa.int32())}
            )

    return run
