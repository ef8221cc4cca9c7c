"""Detection tables derived from the star-schema test data, as SQL text that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("events", "orders", "part", "pages", "embeddings")

SQL = {
    # four runs for every 10,000 events
    "fx_runs": """SELECT CONCAT('run_', n) AS run_id, CAST(25 AS DOUBLE) AS fps, 1280 AS width, 720 AS height, 2 AS frame_stride,
 CASE n % 4 WHEN 3 THEN 0 WHEN 2 THEN 1001 ELSE 1000 END AS source_frame_count, CONCAT('/videos/run_', n, '.mp4') AS input_path, 'person' AS prompt
 FROM (SELECT DISTINCT CAST(event_id % 4 + 4 * FLOOR(event_id / 10000) AS BIGINT) AS n FROM events) t""",
    "fx_order_runs": """SELECT CONCAT('run_', o_orderkey) AS run_id, o_orderkey AS k, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE 25 END AS DOUBLE) AS fps,
 CASE WHEN o_orderkey % 2 = 0 THEN 1280 ELSE 1920 END AS width, CASE WHEN o_orderkey % 2 = 0 THEN 720 ELSE 1080 END AS height, CAST(o_orderkey % 4 AS INT) AS frame_stride,
 o_custkey AS source_frame_count, CONCAT('/videos/', o_orderkey, '.mp4') AS input_path, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'person' END AS prompt, o_orderpriority AS priority FROM orders""",
    "fx_base": """SELECT run_id, frame_idx, slot, user_id, event_id, label,
 CASE WHEN label = 'person' THEN 40 + slot * 230 + (frame_idx * 3) % 120 ELSE 60 + ((slot + user_id) % 5) * 230 + (frame_idx * 3) % 120 END AS x0,
 CASE WHEN label = 'person' THEN 60 + frame_idx % 40 ELSE 50 + frame_idx % 40 END AS y0,
 CASE WHEN label = 'person' THEN 90 + user_id % 30 ELSE 40 END AS w,
 CASE WHEN label = 'person' THEN 200 + user_id % 40 ELSE 40 END AS h,
 CAST(20 + user_id % 80 AS DOUBLE) / 100 AS score,
 CASE WHEN user_id % 10 = 0 THEN -1 ELSE slot + 5 * CAST(FLOOR(frame_idx / 100) AS BIGINT) END AS motion_id,
 slot + 1 + 5 * CAST(FLOOR(frame_idx / 60) AS BIGINT) AS object_id
 FROM (SELECT event_id, user_id, CONCAT('run_', r) AS run_id, CAST(FLOOR(q / 5) AS BIGINT) * 2 AS frame_idx, CAST(q % 5 AS INT) AS slot,
  CASE WHEN event_type = 'error' THEN 'helmet' ELSE 'person' END AS label
  FROM (SELECT event_id, user_id, event_type, CAST(event_id % 4 + 4 * FLOOR(event_id / 10000) AS BIGINT) AS r, CAST(FLOOR(event_id / 4) AS BIGINT) % 2500 AS q FROM events) k) g""",
    "fx_detections": """SELECT run_id, frame_idx, slot AS det_idx, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0,
 CAST(x0 + w AS DOUBLE) AS x1, CAST(y0 + h AS DOUBLE) AS y1, label, score AS conf, motion_id FROM fx_base WHERE label = 'person'
 UNION ALL SELECT run_id, frame_idx, slot + 5 AS det_idx, CAST(x0 + 4 AS DOUBLE), CAST(y0 AS DOUBLE),
 CAST(x0 + 4 + w AS DOUBLE), CAST(y0 + h AS DOUBLE), UPPER(label), score / 2, -1 FROM fx_base WHERE label = 'person' AND user_id % 7 = 0""",
    "fx_accessories": """SELECT run_id, frame_idx, slot AS acc_idx, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0,
 CAST(x0 + w AS DOUBLE) AS x1, CAST(y0 + h AS DOUBLE) AS y1, label, score AS conf FROM fx_base WHERE label = 'helmet'""",
    "fx_segments": """SELECT run_id, frame_idx, slot AS seg_idx, CAST(x0 + user_id % 90 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0,
 CAST(x0 + w + user_id % 90 AS DOUBLE) AS x1, CAST(y0 + h AS DOUBLE) AS y1, label, score AS conf FROM fx_base WHERE label = 'person' AND user_id % 3 <> 0""",
    "fx_instances": """SELECT run_id, frame_idx, CAST(ROW_NUMBER() OVER (PARTITION BY run_id, frame_idx ORDER BY slot) - 1 AS INT) AS inst_idx,
 object_id, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x0 + w AS DOUBLE) AS x1, CAST(y0 + h AS DOUBLE) AS y1, score, label
 FROM fx_base WHERE label = 'person'""",
    "fx_frames": """SELECT run_id, frame_idx, SUM(CASE WHEN label = 'person' THEN 1 ELSE 0 END) AS n_inst,
 CAST(SUM(user_id) AS DOUBLE) / 10 AS detect_ms, CAST(MIN(user_id) AS DOUBLE) / 10 AS reid_ms, CAST(MAX(user_id) AS DOUBLE) / 20 AS cross_ms,
 CAST(SUM(user_id) + 40 AS DOUBLE) / 10 AS infer_ms, SUM(CASE WHEN user_id % 50 = 0 THEN 1 ELSE 0 END) AS reid_recoveries
 FROM fx_base GROUP BY run_id, frame_idx""",
    "fx_observations": """SELECT CONCAT('run_', CAST(vec_id % 4 + 4 * FLOOR(vec_id / 2000) AS BIGINT)) AS run_id, vec_id AS frame_idx, CAST(label + 1 AS BIGINT) AS object_id, embedding FROM embeddings""",
    "fx_samples": """SELECT CONCAT('run_', CAST(event_id % 4 + 4 * FLOOR(event_id / 10000) AS BIGINT)) AS run_id, CAST(FLOOR(event_id / 4) AS DOUBLE) / 2 AS t_sec,
 CAST(user_id % 101 AS DOUBLE) AS gpu_util_pct, value * 10 AS mem_used_mb,
 CASE WHEN user_id % 9 = 0 THEN CAST(0 AS DOUBLE) ELSE value * 4 END AS process_rss_mb FROM events""",
    "fx_jobs": """SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'queued' END AS status,
 CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'inference' ELSE 'queued' END AS phase, o_custkey AS current_frames,
 CAST(2000 AS BIGINT) AS total_frames, o_orderdate AS created_at, o_totalprice / 1000 AS elapsed_sec FROM orders""",
    "fx_job_states": """SELECT o_orderkey AS job_id, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'running' ELSE 'queued' END AS status,
 CASE o_custkey % 4 WHEN 0 THEN 'inference' WHEN 1 THEN 'staging' WHEN 2 THEN 'Pass2' ELSE '' END AS phase, o_custkey AS current_frames,
 CAST(CASE WHEN o_orderkey % 6 = 0 THEN 0 ELSE 2000 END AS BIGINT) AS total_frames, CAST(o_orderkey % 7000 * 10 AS DOUBLE) AS created_at,
 CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(o_orderkey % 7000 * 10 + o_custkey % 97 AS DOUBLE) END AS started_at,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 7 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(o_orderkey % 7000 * 10 + o_custkey % 97 + 8 AS DOUBLE) END AS infer_started_at,
 CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 7000 * 10 + 500 AS DOUBLE) END AS finished_at, CAST(o_orderkey % 100 AS DOUBLE) AS stored_percent FROM orders""",
    "fx_requests": """SELECT event_id AS request_id, CASE WHEN event_type = 'click' THEN 'POST' ELSE 'GET' END AS method,
 CONCAT('/v1/', event_type) AS path, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value * 100 AS duration_ms, ts FROM events""",
    "fx_classes": """SELECT p_partkey AS class_id, CONCAT(p_name, ' ', p_type) AS name FROM part""",
    "fx_prompts": """SELECT p_partkey AS prompt_id, CASE WHEN p_partkey % 40 = 0 THEN ' ;.; ' WHEN p_partkey % 40 = 1 THEN '  ' ELSE CONCAT(' ', p_name, '. ', UPPER(p_name), ';', p_type, CASE WHEN p_size % 2 = 0 THEN '..' ELSE '' END) END AS prompt FROM part""",
    "fx_ticks": """SELECT user_id AS job_id, row_number() OVER w AS tick, CAST(2 * row_number() OVER w AS BIGINT) AS current, CAST(2 * count(*) OVER (PARTITION BY user_id) AS BIGINT) AS total,
 CAST(event_id % 1000 AS DOUBLE) / 10000 + CAST(row_number() OVER w AS DOUBLE) * 7 / 100 AS ts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""",
    "fx_files": """SELECT page_id AS file_id, CONCAT('run_', CAST(page_id % 20 AS INT)) AS dir, CONCAT('run_', CAST(page_id % 20 AS INT),
 CASE CAST(page_id % 5 AS INT) WHEN 0 THEN '_result.json' WHEN 1 THEN '_source.mp4' WHEN 2 THEN '_metrics.jsonl' WHEN 3 THEN '_packets_manifest.json' ELSE '_annotated.mp4' END) AS name,
 html AS content FROM pages""",
}

#: Where array syntax differs: the Spark text; DUCK has the other.
SPARK = {
    "fx_tracklet_vectors": """SELECT t.run_id, t.object_id, zip_with(a.embedding, b.embedding, (x, y) -> CAST(x AS DOUBLE) + CAST(y AS DOUBLE) / 2) AS embedding
 FROM (SELECT run_id, object_id, (object_id - 1) % 5 AS slot FROM fx_instances GROUP BY run_id, object_id) t
 JOIN embeddings a ON a.vec_id = t.slot JOIN embeddings b ON b.vec_id = (50 + t.object_id) % 500""",
    "fx_pixels": "SELECT vec_id AS mask_id, pos AS p, CASE WHEN val > 0 THEN 1 ELSE 0 END AS v FROM embeddings LATERAL VIEW posexplode(embedding) e AS pos, val",
    "fx_keypoints": """SELECT CONCAT('run_', CAST(vec_id % 4 + 4 * FLOOR(vec_id / 2000) AS BIGINT)) AS run_id, vec_id AS frame_idx, i AS id, 640 + 1000 * CAST(embedding[i] AS DOUBLE) AS x,
 360 + 500 * CAST(embedding[i + 17] AS DOUBLE) AS y, LEAST(1, 4 * ABS(CAST(embedding[i + 34] AS DOUBLE))) AS conf FROM embeddings LATERAL VIEW explode(sequence(0, 16)) e AS i""",
}
DUCK = {
    "fx_tracklet_vectors": """SELECT t.run_id, t.object_id, list_transform(list_zip(a.embedding, b.embedding), lambda z: CAST(z[1] AS DOUBLE) + CAST(z[2] AS DOUBLE) / 2) AS embedding
 FROM (SELECT run_id, object_id, (object_id - 1) % 5 AS slot FROM fx_instances GROUP BY run_id, object_id) t
 JOIN embeddings a ON a.vec_id = t.slot JOIN embeddings b ON b.vec_id = (50 + t.object_id) % 500""",
    "fx_pixels": "SELECT vec_id AS mask_id, CAST(i - 1 AS INT) AS p, CASE WHEN embedding[i] > 0 THEN 1 ELSE 0 END AS v FROM embeddings, generate_series(1, 64) AS g(i)",
    "fx_keypoints": """SELECT CONCAT('run_', CAST(vec_id % 4 + 4 * FLOOR(vec_id / 2000) AS BIGINT)) AS run_id, vec_id AS frame_idx, CAST(i AS INT) AS id, 640 + 1000 * CAST(embedding[i + 1] AS DOUBLE) AS x,
 360 + 500 * CAST(embedding[i + 18] AS DOUBLE) AS y, LEAST(1, 4 * ABS(CAST(embedding[i + 35] AS DOUBLE))) AS conf FROM embeddings, generate_series(0, 16) AS g(i)""",
}
ORDER = [*SQL, *SPARK]


class Fixtures:
    """The views over the tables of one folder, as attributes: ``fx.instances`` is the view fx_instances."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.view(f"fx_{name}")

    def view(self, name: str) -> DataFrame:
        text = SQL.get(name) or SPARK[name]
        for table in TABLES:
            if re.search(rf"\b{table}\b", text):
                self.spark.read.parquet(f"{self.sf_dir}/{table}.parquet").createOrReplaceTempView(table)
        for other in ORDER:
            if other != name and re.search(rf"\b{other}\b", text):
                self.view(other).createOrReplaceTempView(other)
        return self.spark.sql(text)


def with_fixtures(sql: str, more: dict[str, str] | None = None) -> str:
    """DuckDB text with the views that it needs in front, as common table expressions. ``more``: further ones by name."""
    texts = {**SQL, **DUCK, **(more or {})}
    needed: list[str] = []

    def need(text: str, inside: tuple[str, ...] = ()) -> None:
        for name, body in texts.items():
            if name not in needed and name not in inside and re.search(rf"\b{name}\b", text):
                need(body, (*inside, name))  # a recursive view names itself
                if name not in needed:
                    needed.append(name)

    need(sql)
    return (f"WITH RECURSIVE {', '.join(f'{n} AS ({texts[n]})' for n in needed)} " if needed else "") + sql
