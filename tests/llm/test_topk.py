import math
import random

import pytest
from pyspark.sql import functions as F

from framewarden.llm.topk import top_k


def brute(rows, k):
    good = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((i, [int(x) * 1024 if abs(x) >= 2**53 else math.floor(1024 * x) for x in v]))
    out = []
    for n, (q, a) in enumerate(good):
        if q % 10 == 0:
            scores = [(-sum(x * y for x, y in zip(a, b, strict=False)), c) for j, (c, b) in enumerate(good) if j != n]
            scores = sorted(s for s in scores if -(2**63) < s[0] <= 2**63)
            out += [(q, n, c, -s) for n, (s, c) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("lists, block, sent", [(1, 512, 1 << 20), (2, 3, 500), (5, 512, 1 << 20)])
def test_against_all_pairs(spark, lists, block, sent):
    rng = random.Random(lists)
    rows = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(150)]
    rows += [(i, [float(rng.randint(-1, 1)) for _ in range(8)]) for i in range(150, 220)]  # many ties
    rows += [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (303, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (310, []), (320, [0.5]), (330, [1e6] * 8), rows[0], rows[10]]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, v int").repartition(3)
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0, k=7, lists=lists, block=block, sent=sent).collect())
    assert got == brute(rows, 7)


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0).collect()) == [(0, 1, 1, 2 * 1024 * 1024), (0, 2, 2, -1024 * 1024)]
    assert top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert top_k(df.where("vec_id > 0"), F.col("vec_id") % 10 == 0).count() == 0


@pytest.mark.parametrize("top", [6, 9, 12, 15, 20, 300])
def test_large_components(spark, top):
    rng = random.Random(top)
    number = lambda: rng.choice([-1, 1]) * 10 ** rng.uniform(0, top)
    rows = [(i % 90, [number() for _ in range(4)]) for i in range(120)]
    rows += [(200, [1e300, 1.0, 0.0, 0.0]), (210, [2.0**52, 1.0, 0.0, 0.0]), (211, [2.0**52, 3.0, -1.0, 0.0]), (212, [-(2.0**52), 3.0, -1.0, 0.0])]
    rows += [(220, [2.0**44, 2.0**44, 1.0, 0.0]), (221, [2.0**44, -(2.0**44), 5.0, 0.0]), (222, [2.0**44, -(2.0**44), 7.0, 0.0])]  # parts that cancel
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 10 == 0, k=5).collect())
    assert got == brute(rows, 5)
