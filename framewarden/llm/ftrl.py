"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, lower-cased. The features of a text are the distinct hashes of its words, of their stems (the
first five bytes, so that endings not seen in training count), of word pairs, and of pairs with one or two words between.
Each coordinate has its own rate and an L1 threshold below which its weight is zero (McMahan et al., 2013), so the weights
that go out to the executors are few. L1 pulls the scores of rare classes down; so a fifth of the training rows is held
back once to find the cut of best F1, which the bias then moves to 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, sample
from .staging import text_batches
from .words import NOT_LETTER, give_back, mix, span_hashes, text_slices, word_spans

BITS = 20
STEM = 5


@dataclass
class Settings:
    alpha: float = 0.8
    beta: float = 1.0
    l1: float = 2.0
    l2: float = 0.5
    epochs: int = 4
    #: One row in so many is held back to find the cut.
    hold_back: int = 5
    #: Labelled rows to fit on, at most, and bytes of each.
    rows: int = 8192
    row_bytes: int = 1 << 20


def features(texts: list[str], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the features of all texts, one text after the other (with repeats), and the offsets of the texts."""
    data, starts, ends, first = word_spans(texts, apart=NOT_LETTER)
    words = span_hashes(data, starts, ends)
    owner = np.repeat(np.arange(len(texts)), np.diff(first))
    long = ends - starts > STEM
    stems = mix(span_hashes(data, starts[long], starts[long] + STEM) + np.uint64(STEM))
    keys, owners = [words, stems], [owner, owner[long]]
    for gap in (1, 2, 3):
        if len(words) > gap:
            same = owner[gap:] == owner[:-gap]
            keys.append(mix(words[:-gap][same] * np.uint64(0xD6E8FEB86659FD93) + words[gap:][same] + np.uint64(gap)))
            owners.append(owner[gap:][same])
    key = np.concatenate(keys) >> np.uint64(64 - bits)
    owner = np.concatenate(owners)
    return key.astype(np.int64), owner


class Ftrl:
    """The learner: state z and n by coordinate; coordinate 2**bits is the bias."""

    def __init__(self, settings: Settings, bits: int = BITS) -> None:
        self.s, self.size = settings, (1 << bits) + 1
        self.z, self.n = np.zeros(self.size), np.zeros(self.size)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n, s = self.z[at], self.n[at], self.s
        out = -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2)
        return np.where(np.abs(z) <= s.l1, 0.0, out)

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.s.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def distinct(texts: list[str], bits: int = BITS) -> list[np.ndarray]:
    """The distinct features of each text and the bias, as a learner takes them."""
    key, owner = features(texts, bits)
    pairs = np.unique((owner << bits) | key)
    ends = np.searchsorted(pairs >> bits, np.arange(len(texts) + 1))
    at = (pairs & ((1 << bits) - 1)).astype(np.int32)
    return [np.append(at[a:b], np.int32(1 << bits)) for a, b in zip(ends, ends[1:], strict=False)]


def learn_all(rows: list[np.ndarray], labels: list[int], settings: Settings, bits: int = BITS) -> np.ndarray:
    model = Ftrl(settings, bits)
    for _ in range(settings.epochs):
        for at, label in zip(rows, labels, strict=True):
            model.learn(at, label)
    return model.weights(slice(None))


def best_cut(logits: np.ndarray, labels: np.ndarray) -> float:
    """The middle of the cuts of best F1 (0 if there is no row of either kind)."""
    order = np.argsort(-logits, kind="stable")
    z, y = logits[order], labels[order]
    if not 0 < y.sum() < len(y):
        return 0.0
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    last = np.append(z[1:] < z[:-1], False)  # a cut lies between two different logits
    f1[~last] = -1
    best = int(f1.argmax())
    return float(z[best] + z[best + 1]) / 2 if f1[best] >= 0 else 0.0


def fit(rows: list[np.ndarray], labels: list[int], settings: Settings, bits: int = BITS) -> np.ndarray:
    """Weights by coordinate, float32; the last is the bias. ``rows``: the `distinct` features of each text."""
    n, part = len(rows), settings.hold_back
    rest = [i for i in range(n) if i % part]
    trial = learn_all([rows[i] for i in rest], [labels[i] for i in rest], settings, bits)
    cut = best_cut(np.array([trial[at].sum() for at in rows[::part]]), np.array(labels[::part]))
    weights = learn_all(rows, labels, settings, bits)
    weights[-1] -= cut
    return weights.astype(np.float32)


def score(texts: list[str], weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    key, owner = features(texts, bits)
    live = np.flatnonzero(weights[key])  # most features have no weight: only the others are made distinct
    pairs = np.unique((owner[live] << bits) | key[live])
    total = np.bincount(pairs >> bits, weights[pairs & ((1 << bits) - 1)], minlength=len(texts)) + float(weights[-1])
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def toxicity(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, label: str = "toxic", cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The model is fitted in one task on a sample of ``settings.rows`` labelled texts at most, of ``settings.row_bytes`` bytes
    at most each. A null text counts as empty; a
    text without words gets the score of the bias alone; without labels all scores are 0.5. A null doc_id is scored and
    not held out; rows that repeat are scored each; other columns are not read.
    """
    text_batches(docs.sparkSession)
    settings = settings or Settings()

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, marks = [], []
        for batch in batches:
            for part, texts in text_slices(batch):
                rows += distinct(texts)
                marks += part.column("label").to_pylist()
        if rows:
            weights = fit(rows, marks, settings)
            at = np.flatnonzero(weights)
            yield pa.record_batch([pa.array(at), pa.array(weights[at])], ["at", "weight"])

    learnt = sample(docs, labels, label, settings.rows, settings.row_bytes, id_col, text_col).mapInArrow(train, "at long, weight float").toArrow()
    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[learnt.column("at").to_numpy()] = learnt.column("weight").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast((np.flatnonzero(weights), weights[np.flatnonzero(weights)]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << BITS) + 1, np.float32)
        dense[sent.value[0]] = sent.value[1]
        for batch in batches:
            for part, texts in text_slices(batch):
                yield pa.record_batch([part.column("doc_id"), pa.array(score(texts, dense))], ["doc_id", "score"])
        give_back()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = base.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
