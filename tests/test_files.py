"""Result documents of our own and foreign ones, listings of a folder tree, exact quantiles, rules of small functions."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewarden.functions import text as T
from framewarden.operators import prompts as P
from framewarden.operators import runs as U
from framewarden.sources import io


def test_results_own_and_foreign(spark, tmp_path):
    runs = spark.createDataFrame([("a", "p", 25.0), ("b, c", 'q"{', 30.0)], "run_id string, prompt string, fps double")
    rows = [(r, f, i, 10 * f + i, "person", [f, i, 1, 1]) for r in ("a", "b, c") for f in range(40) for i in range(f % 3 + 1)]
    instances = spark.createDataFrame(rows, "run_id string, frame_idx long, inst_idx int, object_id long, prompt_label string, bbox_xywh array<int>")
    io.write_results(runs, instances, str(tmp_path / "own"))
    foreign = {"schema": "x", "run_id": "f", "prompt": "z", "fps": 5.0, "frames": [{"frame_idx": 3, "instances": [{"object_id": 9, "bbox_xywh": [1, 2, 3, 4], "prompt_label": "person"}]}, {"frame_idx": 4, "instances": []}]}
    other = tmp_path / "other"
    other.mkdir()
    (other / "one_line.json").write_text(json.dumps(foreign))
    (other / "pretty.json").write_text(json.dumps(foreign | {"run_id": "g"}, indent=2))
    want = sorted((r, f, i, o) for r, f, i, o, *_ in rows)
    got_runs, got = io.read_results(spark, str(tmp_path / "own"))
    assert sorted((r.run_id, r.frame_idx, r.inst_idx, r.object_id) for r in got.collect()) == want
    assert sorted((r.run_id, r.prompt, r.fps) for r in got_runs.collect()) == [("a", "p", 25.0), ("b, c", 'q"{', 30.0)]
    got_runs, got = io.read_results(spark, str(other))
    assert sorted((r.run_id, r.frame_idx, r.object_id) for r in got.collect()) == [("f", 3, 9), ("g", 3, 9)]
    assert sorted(r.run_id for r in got_runs.collect()) == ["f", "g"]


def test_one_document_is_read_by_many_tasks(spark, tmp_path):
    runs = spark.createDataFrame([("a",)], "run_id string")
    instances = spark.range(20000).select(F.lit("a").alias("run_id"), F.col("id").alias("frame_idx"), F.lit(0).alias("inst_idx"), F.col("id").alias("object_id"), F.lit("person").alias("prompt_label"))
    io.write_results(runs, instances, str(tmp_path))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        _, got = io.read_results(spark, str(tmp_path))
        assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 3
        assert got.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_listing_of_a_tree(spark, tmp_path):
    for n, (run, name) in enumerate([("r1", "r1_result.json"), ("r2", "r2_packets_manifest.json"), ("r1", "r1_source.mp4"), ("r3", "notes.txt"), ("r2", "a.bin")]):
        path = tmp_path / run / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x" * (n + 1))
        os.utime(path, (1000 + n, 1000 + n))
    files = io.file_table(spark, str(tmp_path))
    plan = U.list_runs(files)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    assert [r.dir for r in U.list_runs(files).collect()] == ["r2", "r1"]
    assert [(r.name, r.bytes) for r in U.list_artifacts(files, "r1").collect()] == [("r1_result.json", 1), ("r1_source.mp4", 3)]
    runs = spark.createDataFrame([("r1", "/gone/x.mp4", None), ("r3", None, None)], "run_id string, input_path string, override string")
    found = {r.run_id: r.path for r in U.resolve_sources(runs, files).collect()}
    assert found["r1"].endswith("r1/r1_source.mp4") and found["r3"] is None


def test_quantiles(spark):
    rng = random.Random(2)
    data = {"a": [rng.gauss(0, 1) for _ in range(501)], "b": [rng.randint(0, 3) for _ in range(400)], "c": [5.0] * 9, "d": [1.0], "e": [1e300, -1e300, 0.0, 1.0]}
    rows = [(k, float(x)) for k, xs in data.items() for x in xs] + [("a", None), ("z", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(3)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r.q for r in U.quantiles(df, ["k"], "x", shares).collect()}
    assert set(got) == set(data)
    for k, xs in data.items():
        assert got[k] == pytest.approx(np.quantile(xs, shares).tolist(), rel=1e-12, abs=1e-12)


def test_prompts_of_separators_and_blank_labels(spark):
    df = spark.createDataFrame([(";.;",), (" \t.; \n",), ("\t\n ",), ("a;\tB \n.c",)], "prompt string")
    assert [r[0] for r in df.select(T.prompt_segments(F.col("prompt"))).collect()] == [[";.;"], [".;"], [], ["a", "B", "c"]]
    rows = [("r", 0, 0, ""), ("r", 0, 1, None), ("r", 0, 2, "vest"), ("r", 0, 3, " \t"), ("r", 0, 4, "Person"), ("r", 0, 5, "glove"), ("r", 0, 6, "VEST ")]
    instances = spark.createDataFrame(rows, "run_id string, frame_idx long, inst_idx int, label string")
    lookup = spark.createDataFrame([("person", 1), ("helmet", 2)], "term string, term_id int")
    got = {r.inst_idx: r.prompt_ref for r in P.resolve_prompt_id(instances, lookup).collect()}
    assert got == {0: None, 1: None, 2: 3, 3: None, 4: 1, 5: 4, 6: 3}
    with pytest.raises(ValueError):
        P.resolve_prompt_id(instances, spark.range(P.MOST_TERMS + 1).selectExpr("cast(id as string) AS term", "cast(id as int) AS term_id"))


def test_active_job_by_start(spark):
    jobs = spark.createDataFrame([(1, "running", 50.0, 10.0), (2, "queued", 0.0, 40.0), (3, "done", 90.0, 90.0), (4, "running", None, 45.0)], "job_id long, status string, started_at double, created_at double")
    assert U.active_job(jobs).first().job_id == 1
    assert U.active_job(jobs.where("job_id <> 1")).first().job_id == 4
