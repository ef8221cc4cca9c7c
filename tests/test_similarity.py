"""Cosine joins by pivots, components, and linking by component against plain versions."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewarden.functions.vectors import l2_normalize
from framewarden.operators import linking as L
from framewarden.operators import similarity as SIM
from framewarden.operators.components import components

SIDE = "grp struct<run_id:string>, row struct<key:long>, v array<double>"


def vectors(rng, n, width=12, centres=6):
    middle = rng.normal(size=(centres, width))
    rows = middle[rng.integers(0, centres, n)] + rng.normal(size=(n, width)) * 0.35
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def side(spark, data):
    return spark.createDataFrame([((g,), (i,), v.tolist()) for g, i, v in data], SIDE).repartition(3)


@pytest.mark.parametrize("min_sim, pivots, block", [(0.65, 16, 1024), (0.9, 4, 7), (0.2, 1, 50), (0.65, 3, 1)])
def test_all_pairs_and_no_others(spark, min_sim, pivots, block):
    rng = np.random.default_rng(int(min_sim * 100) + pivots)
    data = [(g, i, v) for g, n in (("a", 150), ("b", 40), ("c", 1)) for i, v in enumerate(vectors(rng, n))]
    other = [(g, 1000 + i, v) for g, n in (("a", 60), ("b", 80), ("d", 5)) for i, v in enumerate(vectors(rng, n))]
    got = {(r.a.key, r.b.key): r.similarity for r in SIM.similar_pairs(side(spark, data), side(spark, other), min_sim, pivots, block).collect() if r.a.key >= 0}
    want = {(i, j): float(v @ w) for (g, i, v), (h, j, w) in itertools.product(data, other) if g == h and v @ w >= min_sim}
    keyed = SIM.similar_pairs(side(spark, data), side(spark, other), min_sim, pivots, block)
    assert keyed.count() == sum(1 for (g, _, v), (h, _, w) in itertools.product(data, other) if g == h and v @ w >= min_sim)
    assert set(got) == set(want)


def test_visitors_go_to_few_cells(spark):
    """Of like vectors in clusters a visitor meets its own cluster, not its run."""
    rng = np.random.default_rng(9)
    middle = np.eye(8)
    data = [("r", i, (w := middle[i % 8] + rng.normal(size=8) * 0.05) / np.linalg.norm(w)) for i in range(400)]
    blocks = SIM.blocks_of(side(spark, data), side(spark, data), 0.9, 32, 25)
    met = blocks.groupBy("grp", "cell", "block").agg(F.count_if(F.col("role") == 0).alias("residents"), F.count_if(F.col("role") == 1).alias("visitors"))
    rows = met.collect()
    assert sum(r.residents for r in rows) == 400
    assert sum(r.residents * r.visitors for r in rows) < 400 * 400 / 4  # candidates, where the join on the run has them all
    assert max(r.residents for r in rows) < 60


def test_the_length_is_not_taken_for_every_component(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "a array<double>")
    plan = df.select(l2_normalize(F.col("a")))._jdf.queryExecution().analyzed().toString()
    inner = plan[plan.rindex("transform(a#") :]
    assert "aggregate(" not in inner.split("AS")[0]
    assert [r[0] for r in df.select(l2_normalize(F.col("a"))).collect()] == [[0.6, 0.8], None, None, None]


def test_small_groups_are_one_block(spark):
    """A visitor of a group that a block can hold is not copied into cells."""
    rng = np.random.default_rng(2)
    data = [(f"g{g}", i, v) for g in range(3) for i, v in enumerate(vectors(rng, 85))] + [("big", i, v) for i, v in enumerate(vectors(rng, 300))]
    blocks = SIM.blocks_of(side(spark, data), side(spark, data), 0.2, 16, 100)
    assert blocks.where("grp.run_id != 'big'").count() == 3 * 2 * 85
    assert blocks.where("grp.run_id = 'big' and role = 0").count() == 300


def test_nearest_with_ties_and_exclusions(spark):
    rng = random.Random(4)
    known = [("r", i, [1.0, 0.0, 0.0] if i < 3 else [rng.gauss(0, 1) for _ in range(3)]) for i in range(40)] + [("s", 7, [1.0, 0.0, 0.0])]
    gallery = spark.createDataFrame([(g, i, v, 100 - i) for g, i, v in known], "run_id string, object_id long, embedding array<double>, insert_order int")
    asked = [("r", q, [rng.gauss(0, 1) for _ in range(3)]) for q in range(30)] + [("r", 100, [2.0, 0.0, 0.0]), ("s", 101, [1.0, 0.1, 0.0]), ("r", 102, [0.0, 0.0, 0.0]), ("r", 103, None), ("r", 104, [1.0, 0.0])]
    queries = spark.createDataFrame(asked, "run_id string, query_id long, embedding array<double>")
    exclude = spark.createDataFrame([(100, 2), (5, 1)], "query_id long, object_id long")
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for out, floor in ((None, 0.3), (exclude, 0.3), (exclude, 0.9)):
        gone = {(100, 2), (5, 1)} if out is not None else set()
        want = {}
        for g, q, v in asked:
            if v is None or len(v) != 3 or not any(v):
                continue
            best = max(((float(unit(v) @ unit(w)), i) for h, i, w in known if h == g and (q, i) not in gone), key=lambda x: (round(x[0], 12), x[1]))
            if best[0] >= floor:
                want[q] = best[1]
        got = {r.query_id: r.object_id for r in L.gallery_query(queries, gallery, out, floor).collect()}
        assert got == want


def test_components(spark):
    rng = random.Random(8)
    edges = [(g, *rng.sample(range(300), 2)) for g in "xy" for _ in range(220)] + [("z", i + 1, i) for i in range(60)] + [("x", 1, 2)] * 3
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for g, u, v in edges:
        a, b = find((g, u)), find((g, v))
        root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "grp string, u long, v long").repartition(5)
    assert sorted((r.grp, r.node, r.component) for r in components(df).collect()) == sorted((*x, find(x)[1]) for x in list(root))
    assert components(df.where("grp = 'none'")).count() == 0


def plain_links(tracklets, edges):
    """Greedy merging in one list of clusters, all pairs of members compared."""
    cluster = {t: {t} for t in tracklets}
    for _, a, b in sorted(edges, key=lambda e: (-e[0], tracklets[e[1]][0], tracklets[e[2]][0], e[1], e[2])):
        one, two = cluster[a], cluster[b]
        if one is not two and all(tracklets[x][1] < tracklets[y][0] or tracklets[y][1] < tracklets[x][0] for x in one for y in two):
            joined = one | two
            for x in joined:
                cluster[x] = joined
    return {t: min(c) for t, c in cluster.items()}


def test_linking_by_component_equals_plain_merging(spark):
    rng = random.Random(6)
    tracklets, edges, want = [], [], []
    for run in ("a", "b"):
        own = {i: (s := rng.randint(0, 300), s + rng.randint(0, 40)) for i in range(1, 80)}
        pairs = [(round(rng.random(), 2), a, b) for a in own for b in own if own[a][1] < own[b][0] and rng.random() < 0.05]
        tracklets += [(run, i, 1) for i in own]
        edges += [(run, a, b, s, own[a][0], own[a][1], own[b][0], own[b][1]) for s, a, b in pairs]
        want += [(run, i, f) for i, f in plain_links(own, pairs).items()]
    df = spark.createDataFrame(tracklets, "run_id string, object_id long, n_frames long")
    cand = spark.createDataFrame(edges, "run_id string, id_a long, id_b long, score double, start_a long, end_a long, start_b long, end_b long").repartition(4)
    linked = L.link_tracklets(df, cand)
    assert sorted((r.run_id, r.object_id, r.final_id) for r in linked.collect()) == sorted(want)
    assert L.link_tracklets(df, cand.where("false")).where("final_id <> object_id").count() == 0


def test_any_gap_with_and_without_vectors(spark):
    rng = np.random.default_rng(2)
    vs = vectors(rng, 30, 4, 3)
    rows = [("r", i, 10 * i, 10 * i + 4, (0.0, 0.0, 10.0, 10.0), (5.0, 0.0, 15.0, 10.0), None if i % 7 == 0 else [0.0] * 4 if i % 11 == 0 else vs[i].tolist()) for i in range(30)]
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    df = spark.createDataFrame(rows, f"run_id string, object_id long, start_frame long, end_frame long, first_box {box}, last_box {box}, embedding array<double>")
    for required in (True, False):
        want = set()
        for a, b in itertools.product(rows, rows):
            gap = b[2] - a[3] - 1
            if a[1] == b[1] or gap < 0:
                continue
            if a[6] is None or b[6] is None:
                if not required and gap <= 5:
                    want.add((a[1], b[1]))
            elif any(a[6]) and any(b[6]) and np.dot(a[6], b[6]) >= 0.6:
                want.add((a[1], b[1]))
        assert {(r.id_a, r.id_b) for r in L.link_candidates(df, max_gap=0, min_sim=0.6, require_embedding=required).collect()} == want
