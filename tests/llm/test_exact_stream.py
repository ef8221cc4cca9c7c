import hashlib
import shutil
from collections import defaultdict

from pyspark.sql import functions as F

from framewarden.llm.exact_stream import exact_duplicates, locator, run_stream, sha256


def check(got, rows):
    ids = defaultdict(list)
    for d, t in rows:
        ids[t or ""].append(d)
    assert len(got) == len(rows)
    assert sorted(got, key=repr) == sorted(
        [(d, max((x for x in ids[t or ""] if x is not None), default=None), len(ids[t or ""]), d == max((x for x in ids[t or ""] if x is not None), default=None), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows],
        key=repr,
    )


def test_awkward(awkward, awkward_rows, empty):
    check([tuple(r) for r in exact_duplicates(awkward).collect()], [(r[0], r[1]) for r in awkward_rows])
    assert exact_duplicates(empty).count() == 0


def test_from_a_folder_and_a_file(spark, awkward, awkward_rows, tmp_path):
    awkward.write.parquet(str(tmp_path / "d.parquet"))
    awkward.coalesce(1).write.parquet(str(tmp_path / "one"))
    part = next((tmp_path / "one").glob("part-*.parquet"))
    odd = tmp_path / "a [x] {y} b.parquet"
    shutil.copytree(tmp_path / "d.parquet", odd)
    read = spark.read.schema(awkward.schema)
    for path in (tmp_path / "d.parquet", part, odd):
        docs = read.parquet(str(path)) if path != odd else read.option("recursiveFileLookup", True).parquet(str(odd).replace("[", "\\[").replace("]", "\\]").replace("{", "\\{").replace("}", "\\}"))
        got = exact_duplicates(docs, path=str(path), max_bytes_per_trigger="2000").collect()
        check([tuple(r) for r in got], [(r[0], r[1]) for r in awkward_rows])
    # a plain scan without its path: the locators are those of the scan
    check([tuple(r) for r in exact_duplicates(read.parquet(str(tmp_path / "d.parquet"))).collect()], [(r[0], r[1]) for r in awkward_rows])


def test_a_digest_that_clashes(spark):
    rows = [(1, "aa"), (2, "ba"), (3, "aa"), (4, "c"), (5, "ba")]
    weak = lambda t: F.encode(F.substring(t, -1, 1), "UTF-8")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), digest=weak).collect()}
    assert got == {1: (3, 2), 3: (3, 2), 2: (5, 2), 5: (5, 2), 4: (4, 1)}


def test_state_outlives_the_run(spark, tmp_path):
    schema = "doc_id long, text string"

    def add(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"n={n}"))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        stream = stream.select("doc_id", sha256(F.col("text")).alias("digest"), locator())
        return {r.keep_id: r.copies for r in run_stream(stream, f"file://{tmp_path}/state").collect()}

    add(0, [(1, "x"), (2, "y")])
    assert run() == {1: 1, 2: 1}
    add(1, [(9, "x"), (3, "z")])
    assert run() == {9: 2, 2: 1, 3: 1}
