"""Quality by attention-based multiple-instance learning (Ilse et al., 2018).

A document is a bag of passages of 64 words. Each passage is encoded from its bytes and words: shares of letters, cases,
digits and marks, lengths and repeats of words. A small network maps it to a vector h; gated attention gives it the weight
softmax(w . (tanh(V h) * sigmoid(U h))) among the passages of its document; the weighted sum of the h is the document,
which a logistic layer scores. All of it is learnt from document labels, by Adam, from a fixed start.
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
from .words import give_back, span_hashes, text_slices, word_spans

PASSAGE = 64
MARKS = b"!*$%&#|+.,;:?@/()-_\"'<>=[]{}\\~^`"


@dataclass
class Settings:
    hidden: int = 16
    attention: int = 8
    epochs: int = 40
    batch: int = 64
    rate: float = 0.01
    decay: float = 1e-4
    #: Labelled rows to fit on, at most, and bytes of each.
    rows: int = 4096
    row_bytes: int = 1 << 18


def _classes() -> np.ndarray:
    """The class of each byte: upper, lower, digit, blank, line end, beyond ASCII, other, then one for each mark."""
    out = np.full(256, 6, np.int64)
    out[65:91], out[97:123], out[48:58], out[32], out[10], out[128:] = 0, 1, 2, 3, 4, 5
    for i, mark in enumerate(MARKS):
        out[mark] = 7 + i
    return out


CLASSES = _classes()
N_CLASSES = 7 + len(MARKS)
N_FEATURES = N_CLASSES + 7


def passages(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, one row each, and the offsets of the texts in them. A text without words has one passage."""
    data, starts, ends, first = word_spans(texts, lower=False)
    counts = np.diff(first)
    per_text = np.maximum(1, -(-counts // PASSAGE))
    offsets = np.concatenate([[0], np.cumsum(per_text)])
    n = int(offsets[-1])
    # number of the passage of each word
    place = np.arange(len(starts)) - np.repeat(first[:-1], counts)
    passage = np.repeat(offsets[:-1], counts) + place // PASSAGE
    length = ends - starts
    words = np.bincount(passage, minlength=n)
    out = np.zeros((n, N_FEATURES))
    # byte classes: running counts at the first and last byte of each passage
    begin, end = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(starts):
        new = np.flatnonzero(np.diff(passage, prepend=-1))
        begin[passage[new]] = starts[new]
        end[passage[new]] = ends[np.append(new[1:], len(starts)) - 1]
    size = np.maximum(end - begin, 1)
    mark = np.zeros(len(data) + 1, np.int64)
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, begin[end > begin], 1)
    np.add.at(inside, end[end > begin], -1)
    covered = np.cumsum(inside[:-1]) > 0
    np.add.at(mark, begin[end > begin], 1)
    in_order = np.flatnonzero(end > begin)  # passages follow each other in the data
    number = in_order[np.maximum(np.cumsum(mark[:-1])[covered] - 1, 0)] if len(in_order) else np.zeros(0, np.int64)
    table = np.bincount(number * N_CLASSES + CLASSES[data[covered]], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    out[:, :N_CLASSES] = np.sqrt(table / size[:, None])
    share = lambda x: np.bincount(passage, x, minlength=n) / np.maximum(words, 1)
    mean = share(length.astype(float))
    out[:, N_CLASSES] = mean / 10
    out[:, N_CLASSES + 1] = np.sqrt(np.maximum(share(length.astype(float) ** 2) - mean**2, 0)) / 10
    out[:, N_CLASSES + 2] = words / PASSAGE
    if len(starts):
        key = span_hashes(data, starts, ends)
        order = np.lexsort((key, passage))
        again = np.zeros(len(key))
        again[order[1:]] = (key[order[1:]] == key[order[:-1]]) & (passage[order[1:]] == passage[order[:-1]])
        out[:, N_CLASSES + 3] = share(again)
        # words that the whole text has already had before: repeats from passage to passage
        text = np.repeat(np.arange(len(texts)), counts)
        whole = np.lexsort((place, key, text))
        seen = np.zeros(len(key))
        seen[whole[1:]] = (key[whole[1:]] == key[whole[:-1]]) & (text[whole[1:]] == text[whole[:-1]])
        out[:, N_CLASSES + 4] = share(seen)
        pair = key[:-1] * np.uint64(31) + key[1:]
        rank = np.lexsort((np.arange(len(pair)), pair, text[:-1]))
        twice = np.zeros(len(key))
        twice[rank[1:]] = (pair[rank[1:]] == pair[rank[:-1]]) & (text[rank[1:]] == text[rank[:-1]])
        out[:, N_CLASSES + 5] = share(twice)
    out[:, N_CLASSES + 6] = np.repeat(np.log1p(counts), per_text) / 10
    return out, offsets


class Model:
    """The network; parameters in a dictionary, so that they can be sent as arrays."""

    def __init__(self, parameters: dict[str, np.ndarray]) -> None:
        self.p = parameters

    @staticmethod
    def new(settings: Settings, x: np.ndarray) -> Model:
        rng = np.random.default_rng(7)
        h, a, f = settings.hidden, settings.attention, x.shape[1]
        start = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        return Model({"mean": x.mean(0), "std": x.std(0) + 0.02, "W": start(f, h), "b": np.zeros(h), "V": start(h, a), "U": start(h, a), "w": start(a), "c": start(h), "d": np.zeros(1)})

    def forward(self, x: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict]:
        p = self.p
        z = np.clip((x - p["mean"]) / p["std"], -8, 8)
        h = np.tanh(z @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        e = np.exp(e - np.maximum.reduceat(e, offsets[:-1])[bag])
        a = e / np.add.reduceat(e, offsets[:-1])[bag]
        m = np.add.reduceat(a[:, None] * h, offsets[:-1], axis=0)
        out = 1 / (1 + np.exp(-np.clip(m @ p["c"] + p["d"][0], -35, 35)))
        return out, {"z": z, "h": h, "t": t, "s": s, "a": a, "m": m, "bag": bag}

    def gradients(self, x: np.ndarray, offsets: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        out, k = self.forward(x, offsets)
        g = (out - y) / len(y)
        bag, h, a, t, s = k["bag"], k["h"], k["a"], k["t"], k["s"]
        dm = g[:, None] * p["c"]
        da = (dm[bag] * h).sum(1)
        de = a * (da - np.add.reduceat(a * da, offsets[:-1])[bag])
        dt, ds = de[:, None] * p["w"] * s * (1 - t * t), de[:, None] * p["w"] * t * s * (1 - s)
        dh = a[:, None] * dm[bag] + dt @ p["V"].T + ds @ p["U"].T
        dz = dh * (1 - h * h)
        return {"W": k["z"].T @ dz, "b": dz.sum(0), "V": h.T @ dt, "U": h.T @ ds, "w": ((t * s) * de[:, None]).sum(0), "c": k["m"].T @ g, "d": np.array([g.sum()])}


def fit(x: np.ndarray, offsets: np.ndarray, y: np.ndarray, settings: Settings) -> Model:
    model = Model.new(settings, x)
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    rng, step, n = np.random.default_rng(11), 0, len(y)
    sizes = np.diff(offsets)
    for epoch in range(settings.epochs):
        order = rng.permutation(n)
        rate = settings.rate * (1 - epoch / settings.epochs)
        for i in range(0, n, settings.batch):
            some = order[i : i + settings.batch]
            rows = np.concatenate([np.arange(offsets[j], offsets[j + 1]) for j in some])
            g = model.gradients(x[rows], np.concatenate([[0], np.cumsum(sizes[some])]), y[some])
            step += 1
            for k, v in g.items():
                v = v + settings.decay * model.p[k]
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.999 * second[k] + 0.001 * v * v
                model.p[k] = model.p[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def quality(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, label: str = "quality", cut: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    The model is fitted in one task on a sample of ``settings.rows`` labelled texts at most, of ``settings.row_bytes`` bytes
    at most each. A null text counts as empty; a text without words is one passage of zeros; without labels all scores are 0.5. A null doc_id is
    scored and not held out; rows that repeat are scored each; other columns are not read.
    """
    score = scorer(docs, labels, settings, label, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                yield pa.record_batch([part.column("doc_id"), pa.array(score(texts))], ["doc_id", "score"])
        give_back()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = base.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def scorer(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, label: str = "quality", id_col: str = "doc_id", text_col: str = "text"):
    """Fit the model; a function from texts to scores that tasks can call."""
    text_batches(docs.sparkSession)
    settings = settings or Settings()

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xs, sizes, ys = [], [np.zeros(1, np.int64)], []
        for batch in batches:
            for part, texts in text_slices(batch):
                x, offsets = passages(texts)
                xs.append(x)
                sizes.append(np.diff(offsets))
                ys += part.column("label").to_pylist()
        if ys:
            model = fit(np.concatenate(xs), np.cumsum(np.concatenate(sizes)), np.array(ys, float), settings)
            yield pa.record_batch([pa.array(list(model.p)), pa.array([v.ravel().tolist() for v in model.p.values()]), pa.array([list(v.shape) for v in model.p.values()])], ["name", "value", "shape"])

    rows = sample(docs, labels, label, settings.rows, settings.row_bytes, id_col, text_col).mapInArrow(train, "name string, value array<double>, shape array<bigint>").collect()
    parameters = {r.name: np.array(r.value).reshape(r.shape) for r in rows}  # of the network's size, whatever the table's

    def score(texts: list[str]) -> np.ndarray:
        if not parameters:
            return np.full(len(texts), 0.5)
        x, offsets = passages(texts)
        return Model(parameters).forward(x, offsets)[0]

    return score
