import math
import random
import re
import zlib

import numpy as np
import pytest

from framewarden.llm import ftrl, mil
from framewarden.llm.labelled import sample


def make(spark, kind):
    rng = random.Random(6)
    rows, labels = [], []
    for d in range(900):
        text = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(10, 150))]
        y = int(rng.random() < 0.3)
        if y and kind == "toxic":
            text[rng.randrange(len(text))] = rng.choice(["vilest", "rotten"])
        if not y and kind == "quality":
            text = [t.upper() + "!!" for t in text] if rng.random() < 0.5 else [t + "###" for t in text]
        rows.append((d, " ".join(text), 0.5))
        labels.append((d, y))
    return spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3), spark.createDataFrame(labels, f"doc_id long, {kind} int"), dict(labels)


@pytest.mark.parametrize("kind, run", [("quality", mil.quality), ("toxic", ftrl.toxicity)])
def test_held_out_accuracy(spark, kind, run):
    docs, labels, truth = make(spark, kind)
    got = run(docs, labels).collect()
    assert len(got) == 900 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    # labels of held-out rows teach nothing
    from pyspark.sql import functions as F

    from framewarden.llm.labelled import held_out

    other = labels.withColumn(kind, F.when(held_out(F.col("doc_id")), 1 - F.col(kind)).otherwise(F.col(kind)))
    assert sorted((r.doc_id, r.score) for r in run(docs, other).collect()) == sorted((r.doc_id, r.score) for r in got)


@pytest.mark.parametrize("kind, run", [("quality", mil.quality), ("toxic", ftrl.toxicity)])
def test_awkward(spark, awkward, awkward_rows, empty, kind, run):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (4, 0), (None, 1), (6, None), (10, 1), (77, 0)], f"doc_id long, {kind} int")
    got = run(awkward, labels).collect()
    assert len(got) == len(awkward_rows) and all(0 <= r.score <= 1 for r in got)
    assert run(empty, labels).count() == 0
    assert {r.score for r in run(awkward, labels.limit(0)).collect()} == {0.5}


def test_gradients():
    rng = np.random.default_rng(2)
    x, offsets, y = rng.normal(size=(9, 5)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    model = mil.Model.new(mil.Settings(hidden=4, attention=3), x)
    loss = lambda: (lambda p: -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())(model.forward(x, offsets)[0])
    for name, g in model.gradients(x, offsets, y).items():
        for i in np.ndindex(g.shape):
            old = model.p[name][i]
            model.p[name][i] = old + 1e-6
            up = loss()
            model.p[name][i] = old - 1e-6
            down = loss()
            model.p[name][i] = old
            assert g[i] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_l1_keeps_weights_few():
    weights = ftrl.fit(ftrl.distinct(["good words here", "bad words here"] * 200), [0, 1] * 200, ftrl.Settings())
    assert 0 < np.count_nonzero(weights) < 40
    assert ftrl.score(["bad"], weights)[0] > 0.5 > ftrl.score(["good"], weights)[0]


def plain_ftrl(rows, labels, s):
    """The learner coordinate by coordinate, as it is published."""
    z, n = {}, {}

    def weight(i):
        if abs(z.get(i, 0.0)) <= s.l1:
            return 0.0
        return -(z[i] - math.copysign(s.l1, z[i])) / ((s.beta + math.sqrt(n[i])) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for row, y in zip(rows, labels, strict=True):
            w = {i: weight(i) for i in row}
            p = 1 / (1 + math.exp(-sum(w.values())))
            for i in row:
                g = p - y
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / s.alpha
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return weight


def grams(text):
    """The words, stems, pairs and skip-pairs of a text, as strings."""
    w = re.findall(r"[^\x00-@\[-`{-\x7f]+", text.lower())
    out = {("word", x) for x in w} | {("stem", x[:5]) for x in w if len(x.encode()) > 5}
    return out | {("pair", g, a, b) for g in (1, 2, 3) for a, b in zip(w, w[g:], strict=False)}


def test_toxicity_against_plain_ftrl(spark):
    docs, labels, truth = make(spark, "toxic")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in ftrl.toxicity(docs, labels).collect()}
    order = [r.doc_id for r in sample(docs, labels, "toxic", 8192, 1 << 20).collect()]
    assert set(order) == {d for d in texts if zlib.crc32(str(d).encode()) % 5}
    # grams that share a coordinate are one feature
    known = {d: ftrl.distinct([t])[0].tolist() for d, t in texts.items()}
    assert all(len(np.unique(ftrl.features([t], 62)[0])) == len(grams(t)) for t in [*texts.values(), "ß İ x 日本 aé'b", "", "a a a a", "Abcdef abcdeg"])
    rows = [known[d] for d in order]
    y = [truth[d] for d in order]
    s = ftrl.Settings()
    trial = plain_ftrl([r for i, r in enumerate(rows) if i % 5], [v for i, v in enumerate(y) if i % 5], s)
    logits = sorted(((sum(map(trial, rows[i])), y[i]) for i in range(0, len(rows), 5)), reverse=True)
    positives = sum(v for _, v in logits)
    f1 = [(2 * sum(v for _, v in logits[: k + 1]) / (k + 1 + positives), -k) for k in range(len(logits) - 1) if logits[k][0] > logits[k + 1][0]]
    k = -max(f1)[1]
    cut = (logits[k][0] + logits[k + 1][0]) / 2
    weight = plain_ftrl(rows, y, s)
    for d in texts:
        assert got[d] == pytest.approx(1 / (1 + math.exp(cut - sum(map(weight, known[d])))), abs=1e-5)


def test_quality_against_a_plain_forward_pass(spark):
    """Scores of the operator against the network written out passage by passage."""
    docs, labels, _ = make(spark, "quality")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in mil.quality(docs, labels).collect()}
    rows = sample(docs, labels, "quality", 4096, 1 << 18).collect()
    parts = [mil.passages([r.text]) for r in rows]
    sizes = [p[1][-1] for p in parts]
    model = mil.fit(np.concatenate([p[0] for p in parts]), np.concatenate([[0], np.cumsum(sizes)]), np.array([r.label for r in rows], float), mil.Settings())
    p = model.p
    for d, text in list(texts.items())[:200]:
        weights, states = [], []
        for x in mil.passages([text])[0]:
            z = [max(-8.0, min(8.0, (x[i] - p["mean"][i]) / p["std"][i])) for i in range(len(x))]
            h = [math.tanh(sum(z[i] * p["W"][i, j] for i in range(len(z))) + p["b"][j]) for j in range(p["W"].shape[1])]
            gate = [math.tanh(sum(h[i] * p["V"][i, j] for i in range(len(h)))) / (1 + math.exp(-sum(h[i] * p["U"][i, j] for i in range(len(h))))) for j in range(p["V"].shape[1])]
            weights.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
            states.append(h)
        bag = [sum(w * h[j] for w, h in zip(weights, states, strict=True)) / sum(weights) for j in range(len(states[0]))]
        score = 1 / (1 + math.exp(-(sum(m * c for m, c in zip(bag, p["c"], strict=True)) + p["d"][0])))
        assert got[d] == pytest.approx(score, abs=1e-6)


def test_passage_features_against_a_plain_count():
    text = "Aa bb! CC\n12 aa bb é"
    (x,), offsets = mil.passages([text])
    data = text.encode()
    assert offsets.tolist() == [0, 1]
    share = lambda c: math.sqrt(sum(c(b) for b in data) / len(data))
    assert x[0] == pytest.approx(share(lambda b: 65 <= b <= 90)) and x[2] == pytest.approx(share(lambda b: 48 <= b <= 57)) and x[5] == pytest.approx(share(lambda b: b >= 128))
    words = text.split()
    assert x[mil.N_CLASSES] == pytest.approx(np.mean([len(w.encode()) for w in words]) / 10) and x[mil.N_CLASSES + 2] == pytest.approx(len(words) / 64)
    assert x[mil.N_CLASSES + 3] == 0 and mil.passages(["a b a a"])[0][0][mil.N_CLASSES + 3] == pytest.approx(2 / 4)


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "x" * 100), (3, None), (4, "c"), (6, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 0), (4, 1), (4, 0)], "doc_id long, toxic int")
    ids = {d for d in (1, 2, 3, 4) if zlib.crc32(str(d).encode()) % 5}
    got = {r.doc_id: (r.text, r.label) for r in sample(docs, labels, "toxic", 10, 50).collect()}
    assert got == {d: v for d, v in {1: ("b", 1), 3: ("", 0), 4: ("c", 1)}.items() if d in ids}
    assert sample(docs, labels, "toxic", 1, 50).count() <= 1
