"""Masks as run lengths against pixels."""

import random

import pytest
from pyspark.sql import functions as F

from framewarden.operators import masks as M
from framewarden.operators import reports as R


def pixels(counts, size):
    out = []
    for i, n in enumerate(counts or []):
        out += [i % 2] * n
    return (out + [0] * size)[:size]


def runs(bits):
    if not any(bits):
        return []
    out, now = [], 0
    n = 0
    for b in bits:
        if b != now:
            out.append(n)
            now, n = b, 0
        n += 1
    return [*out, n]


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        h, w = rng.randint(1, 6), rng.randint(1, 7)
        make = lambda: rng.choice([None, [], [0, h * w], [h * w], [3, 500], [rng.randint(0, 5) for _ in range(rng.randint(1, 9))]])  # noqa: B023, E731
        rows.append((i, h, w, make(), make()))
    return rows


def test_overlap_and_combination(spark, pairs):
    df = spark.createDataFrame(pairs, "n long, height int, width int, a array<long>, b array<long>").repartition(3)
    got = {r.n: r for r in M.mask_overlap(df).collect()}
    parts = {how: {r.n: r.counts for r in M.mask_combine(df, how).collect()} for how in ("intersection", "union", "difference")}
    for n, h, w, a, b in pairs:
        x, y = pixels(a, h * w), pixels(b, h * w)
        both, either = [p & q for p, q in zip(x, y, strict=True)], [p | q for p, q in zip(x, y, strict=True)]
        r = got[n]
        assert (r.area_a, r.area_b, r.inter_px, r.union_px) == (sum(x), sum(y), sum(both), sum(either))
        assert r.iou == (sum(both) / sum(either) if any(either) else 0.0)
        assert parts["intersection"][n] == runs(both) and parts["union"][n] == runs(either)
        assert parts["difference"][n] == runs([p & (1 - q) for p, q in zip(x, y, strict=True)])
    assert M.mask_overlap(df.where("false")).count() == 0


def test_rectangles_in_closed_form(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(200):
        h, w = rng.randint(1, 6), rng.randint(1, 6)
        x, y = rng.randrange(w), rng.randrange(h)
        rows.append((x, y, rng.randint(1, w - x), rng.randint(1, h - y), h, w))
    rows += [(0, 0, 4, 3, 3, 4), (0, 1, 4, 2, 3, 4), (3, 2, 1, 1, 3, 4)]
    df = spark.createDataFrame(rows, "x int, y int, w int, h int, height int, width int")
    for r in df.withColumn("counts", M.rect_runs(*(F.col(c) for c in ("x", "y", "w", "h", "height", "width")))).collect():
        want = [int(r.x <= i % r.width < r.x + r.w and r.y <= i // r.width < r.y + r.h) for i in range(r.height * r.width)]
        assert pixels(r.counts, len(want)) == want and sum(r.counts) == len(want)


def test_runs_of_boxes_are_made_after_the_joins(spark):
    """A box of many lines has some numbers a line; no join may carry them."""
    instances = spark.createDataFrame([("r", 0, i, i + 1, 10.0, 20.0, 60.0, 400.0, 0.5, "person") for i in range(3)], "run_id string, frame_idx long, inst_idx int, object_id long, x0 double, y0 double, x1 double, y1 double, score double, label string")
    runs = spark.createDataFrame([("r", 1280, 720)], "run_id string, width int, height int")
    judged = spark.createDataFrame([("r", 0, 0, True, None)], "run_id string, frame_idx long, inst_idx int, ok boolean, warning string")
    points = spark.createDataFrame([], "run_id string, frame_idx long, inst_idx int, id int, x double, y double, conf double")
    masks = spark.createDataFrame([("r", 0, 1, 720, 1280, [5, 3])], "run_id string, frame_idx long, inst_idx int, height int, width int, counts array<long>")
    out = R.assemble_instances(instances, judged, points, runs, masks)
    lines = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    first = next(i for i, line in enumerate(lines) if "Join" in line)
    assert any("array_repeat" in line for line in lines[:first]) and not any("array_repeat" in line for line in lines[first:])
    got = {r.inst_idx: r for r in out.collect()}
    assert sorted(got) == [0, 1, 2] and got[1].mask.counts == [5, 3] and got[1].area_px == 3
    assert got[0].mask.counts[0] == 20 * 1280 + 10 and sum(got[0].mask.counts[1::2]) == got[0].area_px and sum(got[0].mask.counts) == 720 * 1280
