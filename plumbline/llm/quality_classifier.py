"""Quality classifier from weak labels: EM over labellers, then a hashed linear scorer.

Overlapping heuristics vote good, bad or nothing on every text.  How often each combination
of votes occurs is counted over all documents; expectation-maximisation on these counts (at
most 3 to the number of labellers rows) estimates the share of good documents and, for each
labeller, how it votes on good and on bad ones.  The posterior of a combination is the soft
label of its documents.  A linear scorer over hashed word and shape features is then trained
on soft labels, so that it also judges texts on which the labellers are silent or disagree.

No human label is read.  ``training_rows`` bounds the documents that the scorer is trained on
(chosen by a hash of doc_id); vote counts and scores cover all documents and whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored, table, whole_row

TRAINING_ROWS = 12_000
ROUNDS_EM, STEPS = 50, 40
BUCKETS = 1 << 15
PENALTY = 1e-4
REJECT_BELOW = 0.5
CACHED_WORDS = 300_000
GOOD, BAD, SILENT = 1, 0, 2

#: fixed values: frequent function words of the languages at hand
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for with are was this be on at by it as from "
    "der die und das in den von zu mit ist auf für nicht ein eine sich des dem "
    "de la le les et des en un une du que est pour dans il qui pas sur "
    "el los las y del se por con no su para es al lo como una".split()
)


@dataclass
class Text:
    """What the labellers look at."""

    data: bytes
    words: list[bytes]

    def share(self, characters: bytes) -> float:
        """How many of the bytes are among ``characters``, per word."""
        return (len(self.data) - len(self.data.translate(None, characters))) / max(1, len(self.words))


def _vote(value: float, good_up_to: float, bad_from: float) -> int:
    return BAD if value >= bad_from else GOOD if value <= good_up_to else SILENT


def _repeated(text: Text) -> int:
    """Share of 3-word windows that occurred before."""
    w = text.words
    if len(w) < 20:
        return SILENT
    return _vote(1 - len(set(zip(w, w[1:], w[2:]))) / (len(w) - 2), 0.25, 0.5)


def _distinct(text: Text) -> int:
    """Few different words; long texts repeat more, so the first thousands weigh less."""
    n = len(text.words)
    return SILENT if n < 20 else _vote(1 - len(set(text.words)) / min(n, 2000), 0.65, 0.85)


def _upper(text: Text) -> int:
    letters = len(text.data) - len(text.data.translate(None, LETTERS))
    upper = len(text.data) - len(text.data.translate(None, UPPER))
    return SILENT if letters < 20 else _vote(upper / letters, 0.15, 0.5)


def _function_words(text: Text) -> int:
    if len(text.words) < 20:
        return SILENT
    known = sum(w in FUNCTION_BYTES for w in text.data.lower().split())
    return _vote(1 - known / len(text.words), 0.85, 0.98)


def _word_length(text: Text) -> int:
    mean = (len(text.data) - len(text.words)) / max(1, len(text.words))
    return SILENT if not text.words else GOOD if 3 <= mean <= 9 else BAD if mean < 2 or mean > 14 else SILENT


def _lines(text: Text) -> int:
    lines = [x for x in text.data.split(b"\n") if x.strip()]
    return SILENT if len(lines) < 3 else _vote(1 - len(set(lines)) / len(lines), 0.2, 0.5)


LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
UPPER = LETTERS[:26]
FUNCTION_BYTES = frozenset(w.encode() for w in FUNCTION_WORDS)

LABELLERS: dict[str, Callable[[Text], int]] = {
    "symbols": lambda t: _vote(t.share(b"#*$%&|<>"), 0.02, 0.3) if t.words else BAD,
    "marks": lambda t: _vote(t.share(b"!?|{}=~^"), 0.1, 0.6) if t.words else SILENT,
    "repeated": _repeated,
    "distinct": _distinct,
    "upper": _upper,
    "function_words": _function_words,
    "word_length": _word_length,
    "lines": _lines,
}


def votes_of(data: bytes) -> int:
    """All votes as one number in base three."""
    text = Text(data, data.split())
    code = 0
    for label in LABELLERS.values():
        code = 3 * code + label(text)
    return code


def unpacked(codes: np.ndarray) -> np.ndarray:
    """(codes, labellers) votes."""
    powers = 3 ** np.arange(len(LABELLERS) - 1, -1, -1)
    return codes[:, None] // powers % 3


@dataclass
class LabelModel:
    """P(good), and P(vote | class) per labeller that votes: shape (2 classes, labellers, 3 votes).

    Silence says nothing about the class (short texts silence many labellers), so its factor is 1.
    """

    good: float
    chance: np.ndarray

    def posterior(self, codes: np.ndarray) -> np.ndarray:
        """P(good | votes)."""
        votes = unpacked(codes)
        place = np.arange(votes.shape[1])
        logs = [np.log(self.chance[c, place, votes]).sum(axis=1) for c in (BAD, GOOD)]
        odds = np.log(self.good) - np.log1p(-self.good) + logs[GOOD] - logs[BAD]
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))

    def accuracy(self) -> dict[str, float]:
        """How often each labeller is right when it votes, by the share of each class."""
        right = (1 - self.good) * self.chance[BAD, :, BAD] + self.good * self.chance[GOOD, :, GOOD]
        return dict(zip(LABELLERS, right.tolist()))


def fit_labellers(codes: np.ndarray, counts: np.ndarray) -> LabelModel:
    """EM from the share of good votes; a labeller is taken to be right more often than not at first."""
    votes = unpacked(codes)
    good, bad = (votes == GOOD).sum(axis=1), (votes == BAD).sum(axis=1)
    belief = (good + 1) / (good + 3 * bad + 2)
    model = LabelModel(0.5, np.ones((2, len(LABELLERS), 3)))
    one_hot = votes[:, :, None] == np.arange(3)
    for _ in range(ROUNDS_EM if len(codes) else 0):
        weight = np.stack([counts * (1 - belief), counts * belief])
        seen = np.einsum("cn,nlv->clv", weight, one_hot) + 0.1
        share = float(np.clip(weight[GOOD].sum() / counts.sum(), 1e-3, 1 - 1e-3))
        chance = seen / seen[:, :, :SILENT].sum(axis=2, keepdims=True)
        chance[:, :, SILENT] = 1
        model = LabelModel(share, chance)
        belief = model.posterior(codes)
    return model


class _Slots(dict):
    """word -> slots of the word and of its shape."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        shape = SHAPE_RUN.sub(rb"\1", word.translate(SHAPES))
        found = tuple(xxhash.xxh3_64_intdigest(x) % BUCKETS for x in (b"w" + word.lower(), b"s" + shape))
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = found
        return found


SHAPES = bytes(
    ord("A") if 65 <= c <= 90 else ord("a") if 97 <= c <= 122 or c >= 128 else ord("0") if 48 <= c <= 57 else c
    for c in range(256)
)
SHAPE_RUN = re.compile(rb"(.)\1+", re.S)
_SLOTS = _Slots()


def features(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values (unit length) of a text: words, shapes, shape pairs and repeated windows."""
    words = data.split()
    if not words:
        return np.zeros(1, np.int64), np.ones(1)
    pairs = np.array(list(map(_SLOTS.__getitem__, words)), np.int64)
    shape, word = pairs[:, 1], pairs[:, 0]
    again = len(words) - len(set(words)), len(words) - len(set(zip(words, words[1:])))
    repeats = [1 + k * 16 + min(15, 16 * n // len(words)) for k, n in enumerate(again)]
    runs = (shape[:-1] * 31 + shape[1:]) % BUCKETS
    slots, counts = np.unique(np.concatenate([word, shape, runs]), return_counts=True)
    values = np.log1p(counts)
    values = values / np.linalg.norm(values)
    return np.concatenate([[0], repeats, slots]), np.concatenate([[0.3] * 3, values])


def _binary(docs: DataFrame) -> DataFrame:
    return docs.select(whole_row(docs).alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))


def count_votes(docs: DataFrame) -> pd.DataFrame:
    """code, n over all documents: at most 3 to the number of labellers rows."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, counts = np.unique([votes_of(x.as_py()) for x in batch.column(0)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(codes.astype(np.int64)), pa.array(counts)], names=["code", "n"])

    parts = _binary(docs).select("data").mapInArrow(vote, "code long, n long")
    return parts.groupBy("code").agg(F.sum("n").alias("n")).orderBy("code").toPandas()


def training_sample(docs: DataFrame, rows: int, training_rows: int) -> DataFrame:
    """code, slots, values of about ``training_rows`` documents."""
    share = min(1.0, training_rows / max(1, rows))
    drawn = docs.where(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.as_py() for x in batch.column(0)]
            found = [features(x) for x in texts]
            columns = [
                pa.array([votes_of(x) for x in texts], pa.int64()),
                pa.array([s for s, _ in found], pa.list_(pa.int64())),
                pa.array([v for _, v in found], pa.list_(pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["code", "slots", "values"])

    return _binary(drawn).select("data").mapInArrow(describe, "code long, slots array<long>, values array<double>")


def train(sample: DataFrame, labels: LabelModel) -> np.ndarray:
    """Weights by averaged descent: every task walks its part of the sample, Spark adds them up.

    One pass over the sample per call of the job; each task runs ``STEPS`` epochs of adaptive
    gradient steps on its rows, and the weights are averaged by rows (parameter mixing).
    """

    def descend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        rows = pd.concat(parts)
        slots = np.concatenate(rows["slots"].to_numpy())
        values = np.concatenate(rows["values"].to_numpy())
        row = np.repeat(np.arange(len(rows)), rows["slots"].str.len())
        target = labels.posterior(rows["code"].to_numpy(np.int64))
        # both classes weigh the same in total
        mean = float(np.clip(target.mean(), 0.02, 0.98))
        balance = target / (2 * mean) + (1 - target) / (2 * (1 - mean))
        weights, speed = np.zeros(BUCKETS), np.full(BUCKETS, 1e-8)
        for _ in range(STEPS):
            logit = np.bincount(row, weights[slots] * values, len(rows))
            miss = balance * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - target)
            slope = np.bincount(slots, miss[row] * values, BUCKETS) / len(rows) + PENALTY * weights
            speed += slope**2
            weights -= 0.5 * slope / np.sqrt(speed)
        used = np.flatnonzero(weights)
        yield pd.DataFrame({"slot": used, "weight": weights[used] * len(rows), "rows": float(len(rows))})

    parts = sample.mapInPandas(descend, "slot long, weight double, rows double")
    total = sample.count()
    found = parts.groupBy("slot").agg(F.sum("weight").alias("weight")).toPandas()  # one row per slot at most
    weights = np.zeros(BUCKETS)
    weights[found["slot"]] = found["weight"] / max(1, total)
    return weights


@dataclass
class Classifier:
    labels: LabelModel
    weights: np.ndarray


def learn(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> Classifier:
    votes = count_votes(docs)
    labels = fit_labellers(votes["code"].to_numpy(np.int64), votes["n"].to_numpy(float))
    sample = stored(training_sample(docs, int(votes["n"].sum()), training_rows).repartition(4), "classifier-sample")
    return Classifier(labels, train(sample, labels))


def judge(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc, weak (posterior of the votes), score (of the linear scorer) and kept of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            texts = [x.as_py() for x in batch.column(1)]
            weak = model.labels.posterior(np.array([votes_of(x) for x in texts], np.int64).reshape(-1))
            logits = np.array([float(model.weights[s] @ v) for s, v in map(features, texts)]).reshape(-1)
            score = 1 / (1 + np.exp(-np.clip(logits, -30, 30)))
            columns = [batch.column(0), pa.array(weak), pa.array(score), pa.array(score >= REJECT_BELOW)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "weak", "score", "kept"])

    rows = _binary(docs)
    figures = T.StructType.fromDDL("weak double, score double, kept boolean")
    return rows.mapInArrow(rate, T.StructType([rows.schema["doc"], *figures.fields]))


def classify(docs: DataFrame, training_rows: int = TRAINING_ROWS) -> DataFrame:
    """The judged rows of ``docs``.

    A null text is the empty text, which has no feature but the constant.  Null doc_ids and
    repeated rows are judged like others; columns of ``docs`` stay inside ``doc``, whatever
    their names; an empty table gives an empty result.
    """
    return judge(docs, learn(docs, training_rows))


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc.doc_id", "weak", "score", "kept")
