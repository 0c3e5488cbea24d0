"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation estimates how the labellers vote on good and on bad
documents from the counts of all vote patterns, and so the probability that a
pattern is good.  These labels train a linear scorer over hashed features,
which decides.  No given label is used.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from couponmill.llm.shipping import ship
from couponmill.llm.words import mix, slices, utf8, words

GOOD, BAD, NONE = 1, 0, 2
# The scorer is fitted on about this many documents, picked by a hash of their texts.
TRAIN_ROWS = 6_000
BUCKETS = 1_024
# A document is rejected if the scorer's probability of good is below this.
KEEP = 0.5

_CLASS = np.full(256, 9, np.uint8)  # any other sign
for _number, _bytes in enumerate((b" \t", b"\n\r", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b"!?", b"'\"()-/", b"|")):
    _CLASS[list(_bytes)] = _number
_CLASSES = 10
BLANK, LINE, LOWER, UPPER, DIGIT, STOP, LOUD, SOFT, BAR, OTHER = range(_CLASSES)


# Class of a code point beyond ASCII by the first letters of its Unicode category; others are other signs.
_CATEGORIES = {"Lu": UPPER, "Lt": UPPER, "L": LOWER, "M": LOWER, "N": DIGIT, "P": SOFT, "Z": BLANK}


@lru_cache(maxsize=1)
def _class_of_code_points() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    table[:128] = _CLASS[:128]
    for point in range(128, 0x110000):
        category = unicodedata.category(chr(point))
        table[point] = _CATEGORIES.get(category, _CATEGORIES.get(category[0], OTHER))
    return table


def signs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of every character of UTF-8 texts, and where each text's characters begin."""
    if not (data & 0x80).any():
        return _CLASS[data], offsets
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    begun = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return _class_of_code_points()[points], begun[offsets]


@dataclass(frozen=True)
class Labeller:
    """Votes ``vote`` if its quantity lies above ``above`` and below ``below``, else nothing."""

    name: str
    vote: int
    above: float = -1.0
    below: float = 1e9
    least_words: int = 5


LABELLERS = (
    Labeller("signs", BAD, above=0.10),
    Labeller("capitals", BAD, above=0.50),
    Labeller("repeats", BAD, above=0.25),
    Labeller("bars", BAD, above=0.20),
    Labeller("shouts", BAD, above=0.25),
    Labeller("not_letters", BAD, above=0.10, least_words=15),
    Labeller("same_words", BAD, above=0.80, least_words=50),
    Labeller("plain", GOOD, below=0.07),
    Labeller("sentences", GOOD, above=0.02, below=0.50, least_words=20),
    Labeller("varied", GOOD, below=0.05),
)


def _per_text(values: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Sum of ``values`` within each text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[index[1:]] - total[index[:-1]]


@dataclass
class Reading:
    """What one look at some texts gives: classes of characters, and words."""

    kind: np.ndarray
    offsets: np.ndarray
    value: np.ndarray
    index: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Reading:
        data, offsets = utf8(column)
        return cls(*signs_of(data, offsets), *words(data, offsets))

    def repeats(self) -> np.ndarray:
        """Words that equal the word before them in the same text."""
        same = np.zeros(len(self.value), bool)
        same[1:] = self.value[1:] == self.value[:-1]
        same[self.index[:-1][self.index[:-1] < len(same)]] = False
        return same


def _distinct_words(r: Reading) -> np.ndarray:
    """Number of different words of each text."""
    text = np.repeat(np.arange(len(r.index) - 1, dtype=np.uint64), np.diff(r.index))
    # The text number replaces the low bits, so one sort serves all texts.
    bits = np.uint64(max(int(len(r.index)).bit_length(), 1))
    pair = np.sort((text << (np.uint64(64) - bits)) | (r.value >> bits))
    fresh = np.ones(len(pair), bool)
    fresh[1:] = pair[1:] != pair[:-1]
    return _per_text(fresh, r.index)


def measures(r: Reading) -> tuple[np.ndarray, np.ndarray]:
    """One row per text with the quantity each labeller looks at, and the word counts."""
    size = np.diff(r.offsets)
    text = np.repeat(np.arange(len(size), dtype=np.int32) * _CLASSES, size)
    counts = np.bincount(text + r.kind, minlength=len(size) * _CLASSES).reshape(-1, _CLASSES).T
    n_words = np.diff(r.index)
    of_words = np.maximum(n_words, 1)
    visible = size - counts[BLANK] - counts[LINE]
    repeats = _per_text(r.repeats(), r.index) / of_words
    not_letters = 1 - (counts[LOWER] + counts[UPPER] + counts[DIGIT]) / np.maximum(visible, 1)
    table = np.column_stack([
        counts[OTHER] / np.maximum(visible, 1),
        counts[UPPER] / np.maximum(counts[UPPER] + counts[LOWER], 1),
        repeats,
        counts[BAR] / of_words,
        counts[LOUD] / of_words,
        not_letters,
        1 - _distinct_words(r) / of_words,
        not_letters,
        counts[STOP] / of_words,
        repeats,
    ])
    return table, n_words


def votes(r: Reading) -> np.ndarray:
    """One row per text, one vote per labeller."""
    table, n_words = measures(r)
    out = np.full(table.shape, NONE, np.int8)
    for j, labeller in enumerate(LABELLERS):
        x = table[:, j]
        out[(n_words >= labeller.least_words) & (x > labeller.above) & (x < labeller.below), j] = labeller.vote
    return out


def patterns(v: np.ndarray) -> np.ndarray:
    """Votes as one number in base three."""
    return v.astype(np.int64) @ (3 ** np.arange(v.shape[1]))


def unpack(pattern: np.ndarray, labellers: int) -> np.ndarray:
    return (pattern[:, None] // 3 ** np.arange(labellers)) % 3


@dataclass
class VoteModel:
    """Share of good documents, and how often each labeller votes on bad and on good documents."""

    prior: float
    rate: np.ndarray  # class (bad, good) x labeller

    def posterior(self, pattern: np.ndarray) -> np.ndarray:
        """Probability of good for each vote pattern; the prior where nobody votes."""
        cast = unpack(pattern, self.rate.shape[1]) != NONE
        log = np.log([1 - self.prior, self.prior]) + cast @ np.log(self.rate).T + ~cast @ np.log(1 - self.rate).T
        return np.where(cast.any(axis=1), 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60))), self.prior)

    def accuracy(self) -> np.ndarray:
        """Share of each labeller's votes that are right."""
        of_all = self.rate * np.array([[1 - self.prior], [self.prior]])
        return of_all[[label.vote for label in LABELLERS], range(len(LABELLERS))] / of_all.sum(axis=0)


def no_votes() -> VoteModel:
    return VoteModel(0.5, np.full((2, len(LABELLERS)), 0.5))


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, rounds: int = 100) -> VoteModel:
    """Fit to the counts of all patterns, starting from one bad vote meaning bad.

    A labeller that looks worse than chance counts as chance.
    """
    v = unpack(pattern, len(LABELLERS))
    belief = np.where((v == BAD).any(axis=1), 0.1, 0.9)
    own = np.array([label.vote for label in LABELLERS])
    model = no_votes()
    for _ in range(rounds):
        weight = np.stack([(1 - belief) * count, belief * count])
        prior = np.clip((weight[1].sum() + 1) / (count.sum() + 2), 0.01, 0.99)
        rate = (weight @ (v != NONE) + 0.1) / (weight.sum(axis=1, keepdims=True) + 0.2)
        mean = rate.mean(axis=0)
        worse = rate[own, range(len(own))] < rate[1 - own, range(len(own))]
        rate[:, worse] = mean[worse]
        model = VoteModel(float(prior), rate)
        belief = model.posterior(pattern)
    return model


def features(r: Reading) -> np.ndarray:
    """Hashed features: square-rooted shares of character-class trigrams and of word repetition patterns."""
    n = len(r.offsets) - 1
    size, n_words = np.diff(r.offsets), np.diff(r.index)
    kind = r.kind.astype(np.int32)
    trigram = (kind[:-2] * _CLASSES + kind[1:-1]) * _CLASSES + kind[2:]
    text = np.repeat(np.arange(n, dtype=np.int32), size)
    whole = text[:-2] == text[2:]
    out = _shares(n, text[:-2][whole], trigram[whole], _CLASSES**3, 1)
    same = r.repeats().astype(np.int32)
    shape = np.zeros(len(same), np.int32)
    for back in range(3):
        shape[back:] += same[: len(same) - back] << back
    out += _shares(n, np.repeat(np.arange(n, dtype=np.int32), n_words), shape, 8, 2)
    return np.sqrt(out)


def _shares(n: int, text: np.ndarray, feature: np.ndarray, kinds: int, seed: int) -> np.ndarray:
    """Share of each hash bucket among the features of every text."""
    counts = np.bincount(text * np.int32(kinds) + feature, minlength=n * kinds).reshape(n, kinds)
    bucket = mix(np.arange(kinds, dtype=np.uint64) + np.uint64(seed * 1_000_003)) % np.uint64(BUCKETS)
    out = np.zeros((n, BUCKETS), np.float32)
    total = np.maximum(counts.sum(axis=1), 1)
    for kind in np.flatnonzero(counts.any(axis=0)):
        out[:, bucket[kind]] += counts[:, kind] / total
    return out


def train(x: np.ndarray, target: np.ndarray, rounds: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient descent."""
    used = np.flatnonzero(x.any(axis=0))
    x = np.ascontiguousarray(np.column_stack([x[:, used], np.ones(len(x))]), np.float32)
    target = target.astype(np.float32)
    w = before = np.zeros(x.shape[1], np.float32)
    step = np.float32(4 / (x**2).sum(axis=1).max(initial=1))
    for i in range(rounds):
        at = w + np.float32(i / (i + 3)) * (w - before)
        error = 1 / (1 + np.exp(-np.clip(x @ at, -60, 60))) - target
        before, w = w, at - step * (error @ x / np.float32(len(x)) + np.float32(ridge) * at)
    weights = np.zeros(BUCKETS)
    weights[used] = w[:-1]
    return weights, float(w[-1])


@dataclass
class QualityModel:
    votes: VoteModel
    weights: np.ndarray
    bias: float
    documents: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good; the prior for texts without features."""
        scored = 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -60, 60)))
        return np.where(x.any(axis=1), scored, self.votes.prior)


def fit(docs: DataFrame, text: str = "text", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Votes of all documents, then a scorer on about ``train_rows`` of the different texts (all of them, if fewer).

    The driver gets the counts of the vote patterns (at most 3^labellers rows)
    and the features of the training rows.  An empty table gives a model that
    keeps everything.
    """
    spark = docs.sparkSession
    ship(spark)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                pattern, count = np.unique(patterns(votes(Reading.of(part.column(text)))), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(count)], names=["pattern", "n"])

    counted = docs.select(text).mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    rows = counted.collect()
    mark = F.xxhash64(F.coalesce(text, F.lit("")), F.lit("train"))
    pattern = np.array([r["pattern"] for r in rows], np.int64)
    count = np.array([r["n"] for r in rows], np.float64)
    if not len(rows):
        return QualityModel(no_votes(), np.zeros(BUCKETS), 1.0, 0)
    model = expectation_maximisation(pattern, count)
    total = int(count.sum())

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                r = Reading.of(part.column(text))
                x = [row.tobytes() for row in features(r).astype(np.float16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(patterns(votes(r))), pa.array(x, pa.binary())], names=["pattern", "features"]
                )

    # A part of the different texts, whose number is estimated: of few texts in many copies all are taken.
    million = 1_000_000
    texts = docs.agg(F.approx_count_distinct(mark, 0.02)).first()[0]
    share = min(million, -(-train_rows * million // max(texts, 1)))
    picked = docs.select(text).where(F.pmod(mark, F.lit(million)) < share)
    # Copies of one text carry one label; one row of each is enough.
    sample = picked.distinct().mapInArrow(featured, "pattern long, features binary").limit(2 * train_rows).collect()
    x = np.stack([np.frombuffer(r["features"], np.float16) for r in sample]).astype(np.float32)
    target = model.posterior(np.array([r["pattern"] for r in sample], np.int64))
    return QualityModel(model, *train(x, target), total)


RESULT = (("votes", T.StringType()), ("weak_label", T.DoubleType()), ("score", T.DoubleType()), ("kept", T.BooleanType()))


def classify(docs: DataFrame, model: QualityModel | None = None, text: str = "text", keep: float = KEEP) -> DataFrame:
    """``docs`` with ``votes``, ``weak_label``, ``score`` and ``kept``.

    ``votes`` has one sign per labeller (+, -, 0), ``weak_label`` is the
    probability of good given the votes, ``score`` the scorer's.  NULL and empty
    texts have no features and get the share of good documents as their score,
    so they stay where most documents are good.  Equal texts get equal scores, an empty
    table stays empty, and columns of the same names are replaced.
    """
    model = model or fit(docs, text)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c not in dict(RESULT)]
    schema = T.StructType([*[docs.schema[c] for c in names], *[T.StructField(n, t) for n, t in RESULT]])
    signs = np.array(["-", "+", "0"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in slices(batch, text):
                r = Reading.of(part.column(text))
                v = votes(r)
                score = m.score(features(r))
                made = [
                    pa.array(["".join(signs[row]) for row in v], pa.string()),
                    pa.array(m.votes.posterior(patterns(v))),
                    pa.array(score.astype(np.float64)),
                    pa.array(score >= keep),
                ]
                yield pa.RecordBatch.from_arrays([*map(part.column, names), *made], names=schema.names)

    return docs.mapInArrow(run, schema)
