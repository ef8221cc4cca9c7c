"""Each stage on its own input, against a plain version."""

import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline as C  # noqa: E402
from framewarden.llm.staging import stage  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r for r in docs.collect()}
    for name, function in C.STAGES:
        out = stage(function(spark, docs, SF), name.replace(" ", "-"))
        rows = out.collect()
        if name == "packing":
            assert {r.doc_id for r in rows} == set(before) and all(r.offset + r.length <= 4096 for r in rows)
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r for r in rows}
        assert set(after) <= set(before)
        if name == "quality":
            known = [d for d in before if d in truth]
            assert sum((d in after) == bool(truth[d]) for d in known) >= 0.95 * len(known)
        if name == "exact dedup":
            last = {}
            for d, r in before.items():
                last[r.text] = max(d, last.get(r.text, d))
            assert set(after) == set(last.values())
        if name == "near dedup":
            from .test_bagminhash import brute

            assert set(after) == set(brute([(d, r.text) for d, r in before.items()]).values())
        if name == "substring dedup":
            seen = set()
            for d in sorted(after):
                w = after[d].text.lower().split()
                windows = {tuple(w[i : i + 51]) for i in range(len(w) - 50)}
                assert not windows & seen
                seen |= windows
                assert after[d].n_chars == len(after[d].text)
        docs, before = out, after


STAGES = dict(C.STAGES)
DOCS = "doc_id long, text string, lang string, source string, n_chars int, spans int, digest string, of long"


def edge_rows():
    p = " ".join(f"word{i}" for i in range(80))
    texts = [(1, "aaa bbb"), (1, "only here"), (2, "aaa bbb"), (2, "aaa bbb"), (3, None), (4, ""), (None, "aaa bbb"), (None, None), (None, "no id"), (None, "no id"), (5, p), (5, p), (6, p + " more"), (6, "another text of six"), (None, p + " end"), (7, "x" * 200_000)]
    return [(i, t, "en", "s", len(t or ""), n, "d", 9) for n, (i, t) in enumerate(texts)]


def kept(spark, tmp, name, rows):
    out = STAGES[name](spark, spark.createDataFrame(rows, DOCS).repartition(3), tmp)
    if name != "packing":
        assert out.columns == [c.split()[0] for c in DOCS.split(", ")]
    return out.collect()


def test_stages_go_by_row(spark, tmp_path):
    tmp = str(tmp_path)
    spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int").limit(0).write.parquet(f"{tmp}/labels.parquet")
    rows = edge_rows()
    assert len(kept(spark, tmp, "quality", rows)) == len(rows)  # without labels nothing is rejected
    for name in ("quality", "exact dedup", "near dedup", "substring dedup", "packing"):
        assert kept(spark, tmp, name, rows[:0]) == []
    # one of each text, of the largest id
    got = kept(spark, tmp, "exact dedup", rows)
    last = {}
    for r in rows:
        last[r[1] or ""] = max(last.get(r[1] or "", -1), -1 if r[0] is None else r[0])
    assert sorted(((r.text or "", -1 if r.doc_id is None else r.doc_id) for r in got)) == sorted(last.items())
    # one of each class, of the smallest id; what shares an id only stays
    got = kept(spark, tmp, "near dedup", rows)
    assert sorted((r.text or "", r.doc_id or 0) for r in got) == sorted([("aaa bbb", 1), ("only here", 1), ("", 3), ("no id", 0), (rows[10][1], 5), ("another text of six", 6), (rows[15][1], 7)])
    got = kept(spark, tmp, "substring dedup", rows)
    by = {r.spans: r for r in got}
    assert set(by) == set(range(16)) and by[12].text == "more" and by[12].n_chars == 4 and by[14].text == "end" and by[10].text == by[11].text == rows[10][1] and by[4].text is None
    pieces = kept(spark, tmp, "packing", rows)
    assert sum(r.piece == 0 for r in pieces) == len(rows)
