"""Hand cases for the rules that are easy to get wrong."""

import json
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from framewarden.functions import text as T
from framewarden.operators import detections as D
from framewarden.operators import linking as L
from framewarden.operators import masks as M
from framewarden.operators import places
from framewarden.operators import reports as R
from framewarden.operators import runs as U
from framewarden.operators import verdicts as V
from framewarden.plans.queries import ORACLE_SQL, QUERIES
from framewarden.sources import hooks, io

PERSON = "run_id string, frame_idx long, inst_idx int, object_id long, x0 double, y0 double, x1 double, y1 double"
ACC = "run_id string, frame_idx long, acc_idx int, x0 double, y0 double, x1 double, y1 double, label string, conf double"
DET = "run_id string, frame_idx long, det_idx int, x0 double, y0 double, x1 double, y1 double, label string, conf double, motion_id long"
JUDGED = "run_id string, frame_idx long, inst_idx int, object_id long, ok boolean, warning string"


def test_verdict_winner_and_misses(spark):
    people = spark.createDataFrame([("r", 0, 0, 1, 0.0, 0.0, 10.0, 10.0), ("r", 1, 0, 1, 0.0, 0.0, 10.0, 10.0)], PERSON)
    acc = spark.createDataFrame([("r", 0, 0, 0.0, 0.0, 2.0, 2.0, "h", 0.9), ("r", 0, 1, 0.0, 0.0, 4.0, 4.0, "h", 0.9), ("r", 0, 2, 0.0, 0.0, 9.0, 9.0, "h", 0.1)], ACC)
    got = {r.frame_idx: r for r in V.verdicts(people, acc, 10, 0, 0.3).collect()}
    assert got[0].ok and got[0].best_intersection_px == 16 and (got[0].hx1, got[0].hy1) == (4, 4)
    assert not got[1].ok and got[1].best_intersection_px == 0 and got[1].best_iou == 0 and got[1].hy1 == pytest.approx(3.5)
    miss = {r.frame_idx: r for r in V.verdicts(people, acc, 100, 0, 0.3).collect()}
    assert not miss[0].ok and miss[0].best_intersection_px == 16


def test_smoothing_counts_rows_of_the_identity_only(spark):
    rows = [("r", f, 0, 1, ok, "" if ok else "NO HELMET") for f, ok in [(0, True), (4, False), (9, False), (10, True), (11, False)]]
    got = [r.ok for r in V.smooth_verdicts(spark.createDataFrame(rows, JUDGED), 2).orderBy("frame_idx").collect()]
    assert got == [True, True, False, True, True]
    assert [r.ok for r in V.smooth_verdicts(spark.createDataFrame(rows, JUDGED), 1).orderBy("frame_idx").collect()] == [r[4] for r in rows]


def test_gate_and_null_verdicts(spark):
    rows = [("r", f, 0, 1, False, "") for f in range(4)] + [("r", f, 1, 2, False, "") for f in range(2)] + [("r", f, 2, 3, None, "") for f in range(9)]
    v = spark.createDataFrame(rows, JUDGED)
    assert [(r.object_id, r.threshold) for r in R.qualified_violators(v).collect()] == [(1, 3)]
    assert {r.object_id: r.threshold for r in R.report_violators(v, 9).collect()} == {1: 0, 2: 0}


def greedy(rows, limit):
    def iou(a, b):
        w, h = min(a[5], b[5]) - max(a[3], b[3]), min(a[6], b[6]) - max(a[4], b[4])
        i = max(0, w) * max(0, h)
        return i / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - i)

    kept = []
    for r in sorted(rows, key=lambda r: (-r[8], r[2])):
        if not any(k[7].lower() == r[7].lower() and iou(k, r) >= limit for k in kept):
            kept.append(r)
    return {r[2] for r in kept}


def test_dedupe_against_a_loop(spark):
    rng = random.Random(2)
    frames = {}
    for f in range(30):
        frames[f] = [("r", f, i, x := float(rng.randint(0, 20)), 0.0, x + 10, 10.0, rng.choice(["a", "A", "b"]), rng.choice([0.5, 0.9]), -1) for i in range(rng.randint(1, 7))]
    got = D.dedupe(spark.createDataFrame([r for rows in frames.values() for r in rows], DET)).collect()
    for f, rows in frames.items():
        assert {r.det_idx for r in got if r.frame_idx == f} == greedy(rows, 0.55)


def test_segments_match_one_to_one(spark):
    rng = random.Random(4)
    det = [("r", f, i, x := float(rng.randint(0, 20)), 0.0, x + 10, 10.0, "a", 0.9, -1) for f in range(20) for i in range(4)]
    seg = [("r", f, i, x := float(rng.randint(0, 20)), 0.0, x + 10, 10.0, "A", 0.9) for f in range(20) for i in range(4)]
    found = D.match_segments(spark.createDataFrame(det, DET), spark.createDataFrame(seg, ACC.replace("acc_idx", "seg_idx"))).collect()
    assert len(found) == len(det)
    pairs = [(r.frame_idx, r.seg_idx) for r in found if r.seg_idx is not None]
    assert len(pairs) == len(set(pairs)) and pairs


def test_prompt_of_separators_is_itself(spark):
    df = spark.createDataFrame([(" a. A;b\nc ..",), ("..",), ("",)], "p string").select(T.prompt_terms(F.col("p")).alias("t"))
    assert [r.t for r in df.collect()] == [["a", "b c"], [".."], []]


def test_slug_and_formats(spark):
    df = spark.createDataFrame([("  Hard-Hat (X) ", 1536, 61.0)], "s string, n long, sec double")
    r = df.select(T.label_slug(F.col("s")), T.fmt_bytes(F.col("n")), T.fmt_sec(F.col("sec")), T.fmt_bytes(F.lit(None).cast("long"))).first()
    assert tuple(r) == ("hard_hat_x", "1.50 KB", "1 мин 1 с", "—")


def test_seconds_on_ties_and_beyond_an_hour(spark, tmp_path):
    """The prices of jobs as their times: in the middle of two digits, below 0, null and long ones; Spark, DuckDB and Python agree."""

    def text(s):
        if s is None or s < 0:
            return "—"
        m, r = int(s // 60), s - int(s // 60) * 60
        return f"{s:.1f} с" if s < 60 else f"{m} мин {r:.0f} с" if m < 60 else f"{m // 60} ч {m % 60} мин"

    secs = [k / 20 for k in range(1300)] + [12.349999999999998, 59.96, 60.0, 3599.4, 3600.0, 90061.0, -1.0, None]
    rows = [(i, None if s is None else s * 1000) for i, s in enumerate(secs)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").selectExpr("*", "1L o_custkey", "'F' o_orderstatus", "timestamp'2024-01-01' o_orderdate", "'1' o_orderpriority")
    orders.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    want = {i: text(None if p is None else p / 1000) for i, p in rows}
    assert {r.job_id: r.elapsed for r in QUERIES["fmt_texts"](spark, str(tmp_path)).collect()} == want
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert dict(duck.execute(ORACLE_SQL["fmt_texts"]).fetchall()) == want


def test_runs_and_geometry_round_trip(spark):
    rng = random.Random(1)
    masks = {m: [int(rng.random() < p) for _ in range(35)] for m, p in enumerate([0, 1, 0.5, 0.2, 0.8])}
    pixels = spark.createDataFrame([(m, p, v) for m, bits in masks.items() for p, v in enumerate(bits)], "mask_id int, p int, v int")
    runs = {r.mask_id: r.counts for r in M.encode_runs(pixels).collect()}
    assert runs[1] == [0, 35] and runs[0] == [35]
    for m, bits in masks.items():
        out = [v for i, n in enumerate(runs[m]) for v in [i % 2] * n]
        assert out == bits
    geometry = M.mask_geometry(M.encode_runs(pixels).withColumns({"height": F.lit(5), "width": F.lit(7)})).collect()
    for r in geometry:
        bits = np.array(masks[r.mask_id]).reshape(5, 7)
        assert r.area_px == bits.sum()
        if bits.any():
            assert r.bbox_y == np.flatnonzero(bits.any(1))[0]


def test_overlong_runs_are_cut(spark):
    df = spark.createDataFrame([(1, 2, 3, [1, 100]), (2, 2, 3, [])], "mask_id int, height int, width int, counts array<long>")
    got = {r.mask_id: r for r in M.mask_geometry(df).collect()}
    assert got[1].area_px == 5 and got[1].bbox_w == 3 and got[2].area_px == 0 and got[2].bbox_x is None


def test_linking_keeps_clusters_apart():
    c = L.Clusters()
    for oid, a, b in [(5, 0, 9), (6, 20, 29), (7, 5, 19), (8, 40, 50)]:
        c.add(oid, a, b)
    assert c.merge(5, 6) and not c.merge(6, 7) and c.merge(7, 8) and not c.merge(5, 8)
    assert [c.final(i) for i in (5, 6, 7, 8)] == [5, 5, 7, 7]


def test_even_samples(spark):
    rows = [("r", f, 0, 1, 0.0, 0.0, 1.0, 1.0) for f in range(10)]
    inst = spark.createDataFrame(rows, PERSON)
    assert sorted(r.frame_idx for r in L.sample_tracklets(inst, 1).collect()) == [5]
    assert sorted(r.frame_idx for r in L.sample_tracklets(inst, 3).collect()) == [0, 4, 9]


def test_throttle_against_a_loop(spark):
    rng = random.Random(9)
    ticks, t, cur = [], 0.0, 0
    for i in range(60):
        t += rng.choice([0.1, 0.2, 0.6])
        cur += rng.randint(0, 6)
        ticks.append((1, i, cur, 150, t))
    want, last = [], None
    for x in ticks:
        if last is None or x[2] >= 150 or x[2] - last[2] >= 8 or x[4] - last[4] >= 0.5:
            want.append(x)
            last = x
    got = U.throttle(spark.createDataFrame(ticks, "job_id int, tick int, current int, total int, ts double")).orderBy("tick").collect()
    assert [tuple(r) for r in got] == want


def test_results_round_trip(spark, tmp_path):
    runs = spark.createDataFrame([("r1", "a", 25.0)], "run_id string, prompt string, fps double")
    inst = spark.createDataFrame([("r1", 4, 0, 9, [1, 2, 3, 4], 0.5), ("r1", 2, 0, 8, [1, 2, 3, 4], 0.25)], "run_id string, frame_idx long, inst_idx int, object_id long, bbox_xywh array<int>, score double")
    io.write_results(runs, inst, str(tmp_path / "out"))
    got_runs, got = io.read_results(spark, str(tmp_path / "out"))
    assert [r.run_id for r in got_runs.collect()] == ["r1"]
    assert [(r.frame_idx, r.object_id, r.score) for r in got.orderBy("frame_idx").collect()] == [(2, 8, 0.25), (4, 9, 0.5)]


def test_readers_skip_what_is_broken(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text('{"frame": 1, "fps": 2.5}\n\nnot json\n{"frame": 2}\n')
    assert sorted(r.frame for r in io.read_metrics(spark, str(tmp_path / "m.jsonl")).collect() if r.frame is not None) == [1, 2]
    assert io.read_runs_index(spark, str(tmp_path / "missing.json")).count() == 0
    (tmp_path / "i.json").write_text(json.dumps({"runs": [{"run_id": "a", "models": {"detect": "d"}, "frames": 3}]}))
    index = io.read_runs_index(spark, str(tmp_path / "i.json"))
    flat = io.flatten_runs(index).first()
    assert flat.run_id == "a" and flat.detect_model == "d" and flat.frames == "3" and len(flat) == 24
    (tmp_path / "s.json").write_text(json.dumps([{"t_sec": 0.5, "gpu_util_pct": 3}, {"t_sec": 1}]))
    assert io.read_samples(spark, str(tmp_path / "s.json")).count() == 2
    assert {r.name for r in io.file_table(spark, str(tmp_path)).collect()} >= {"m.jsonl", "i.json"}


def test_chunks_prune(spark, tmp_path):
    frames = spark.createDataFrame([("r", f, f * 2) for f in range(0, 1000, 2)], "run_id string, frame_idx long, n long")
    io.write_chunks(frames, str(tmp_path / "c"), 100)
    store = spark.read.parquet(str(tmp_path / "c"))
    part = io.keyframes_between(store, 150, 260, 100)
    assert part.count() == 56
    assert "PartitionFilters: [isnotnull(chunk_idx" in part._jdf.queryExecution().explainString(part.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert io.compact_chunks(store, 2).count() == 500


def test_report_line(spark):
    lines = spark.createDataFrame([("a", 1, "x"), ("a", 2, "Cross-check violations: 7"), ("a", 3, "Cross-check violations: 9"), ("b", 1, "Cross-check violations: n/a")], "run_id string, line_no int, line string")
    assert {r.run_id: r.violations for r in io.report_violations(lines).collect()} == {"a": 7, "b": 0}


def test_hooks(spark):
    frames = spark.createDataFrame([("r", f) for f in range(10)], "run_id string, frame_idx long")

    def detect(pdf):
        assert len(pdf) <= 3
        return pd.DataFrame({"run_id": pdf.run_id, "frame_idx": pdf.frame_idx, "det_idx": 0, "x0": 0.0, "y0": 0.0, "x1": 1.0, "y1": 1.0, "label": "p", "conf": 0.5, "motion_id": -1})

    assert hooks.score_frames(frames, detect, 3).count() == 10
    crops = spark.createDataFrame([("ab",), ("",)], "crop string")
    got = hooks.embed_crops(crops, lambda s: np.array([[len(x), 0.0] for x in s])).collect()
    assert got[0].embedding == [1.0, 0.0] and got[1].embedding is None


def test_places_over_all_rows(spark):
    rng = random.Random(3)
    values = [rng.choice([None, rng.uniform(0, 3), 1e9, 0.5]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v double").repartition(5)
    got = [r.id for r in places.with_place(df, [F.col("v").asc_nulls_last(), F.col("id")]).orderBy("place").collect()]
    assert got == sorted(range(500), key=lambda i: (values[i] is None, values[i] or 0, i))


def test_points_beyond_the_named_ones(spark):
    df = spark.createDataFrame([("r", 0, i, 1.0, 2.0, 0.9) for i in (0, 16, 17, 99, -1)], "run_id string, frame_idx long, id int, x double, y double, conf double")
    assert [r["name"] for r in M.keypoints_long(df).orderBy("id").collect()] == ["kpt_-1", "nose", "right_ankle", "kpt_17", "kpt_99"]


def test_crops_that_are_too_small_fill_nothing(spark):
    box = lambda oid, f, w: ("r", f, 0, oid, 100.0, 100.0, 100.0 + w, 100.0 + 2 * w)
    inst = spark.createDataFrame([box(1, 0, 10), box(1, 1, 60), box(2, 2, 10)], PERSON)
    emb = spark.createDataFrame([("r", 0, 0, [0.0, 2.0]), ("r", 1, 0, [3.0, 0.0]), ("r", 2, 0, [1.0, 0.0])], "run_id string, frame_idx long, inst_idx int, embedding array<double>")
    tracks = spark.createDataFrame([("r", 1, None), ("r", 2, None), ("r", 3, [9.0, 9.0])], "run_id string, object_id long, embedding array<double>")
    runs = spark.createDataFrame([("r", 640, 480)], "run_id string, width int, height int")
    got = {r.object_id: (r.embedding, r.filled) for r in L.enrich_tracklets(tracks, inst, emb, 8, runs).collect()}
    assert got == {1: ([1.0, 0.0], True), 2: (None, False), 3: ([9.0, 9.0], False)}


def test_gap_bins_lose_no_pair(spark):
    rng = random.Random(4)
    rows = []
    for oid in range(1, 80):
        a = rng.randint(0, 300)
        rows.append(("r", oid, a, a + rng.randint(0, 40), 5, (0.0, 0.0, 9.0, 9.0), (0.0, 0.0, 9.0, 9.0), [1.0, rng.uniform(0, 0.2)], 0))
    corner = "struct<x0: double, y0: double, x1: double, y1: double>"
    t = spark.createDataFrame(rows, f"run_id string, object_id long, start_frame long, end_frame long, n_frames long, first_box {corner}, last_box {corner}, embedding array<double>, first_inst_idx int")
    for gap in (0, 1, 7, 50):
        got = [(r.id_a, r.id_b) for r in L.link_candidates(t, max_gap=gap).collect()]
        want = [(a[1], b[1]) for a in rows for b in rows if a[1] != b[1] and a[3] < b[2] and (gap == 0 or b[2] - a[3] - 1 <= gap)]
        assert sorted(got) == sorted(want)


def test_a_result_is_one_document_for_each_run(spark, tmp_path):
    runs = spark.createDataFrame([("r1", "a", 25.0), ("r2", None, 5.0)], "run_id string, prompt string, fps double")
    inst = spark.createDataFrame([("r1", f, i, 9, 0.5) for f in range(50) for i in range(2)], "run_id string, frame_idx long, inst_idx int, object_id long, score double").repartition(7)
    io.write_results(runs, inst, str(tmp_path / "out"))
    docs = [json.loads(f.read_text()) for f in (tmp_path / "out").glob("run=*/part-*")]
    by = {d["run_id"]: d for d in docs}
    assert len(docs) == 2 and [f["frame_idx"] for f in by["r1"]["frames"]] == list(range(50)) and by["r2"]["frames"] == []
