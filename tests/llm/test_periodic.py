import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from framewarden.llm.periodic import collapse, largest_divisors, periodic_runs, run_digests, z_function
from framewarden.llm.queries import op12_periodic_runs


def brute(words):
    """All runs (start, length, period), period by period; a stretch that a smaller period has too is left out."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    x = np.array([number[w] for w in words], np.int64)
    out = {}
    for q in range(1, len(x) // 2 + 1):
        same = np.concatenate([[False], x[:-q] == x[q:], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        for start, stop in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            length = stop - start + q
            if length >= max(12, 2 * q):
                out.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_text(rng, most=260):
    n, kind = rng.randint(0, most), rng.random()
    if kind < 0.4:
        return [str(rng.randint(0, rng.choice([1, 3, 30]))) for _ in range(n)]
    words = []
    while len(words) < n:
        part = [str(rng.randint(0, rng.choice([1, 2, 9]))) for _ in range(rng.randint(1, 60))]
        words += (part * rng.randint(1, 8))[: rng.randint(1, 200)]
    return words


@pytest.mark.parametrize("spread, tile", [(1 << 18, 1 << 16), (0, 16), (100, 64)])
def test_against_all_periods(spark, spread, tile):
    rng = random.Random(spread + tile)
    texts = [some_text(rng) for _ in range(400)] + [["a"] * 700, ["a", "b"] * 400, ["a"] * 11, ["a"] * 12, [*"abcdefghijk"] * 2, [*"abcde"] * 2, [str(i % 300) for i in range(1000)]]
    rows = [(i % 390, rng.choice([" ", "\n", "\t \r"]).join(w)) for i, w in enumerate(texts)]  # ids come twice
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, key int").repartition(3)
    got = sorted((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df, texts=True, spread=spread, tile=tile).collect())
    want = []
    for (i, _), words in zip(rows, texts, strict=True):
        runs = brute(words)
        want.append((i, runs, collapsed(words, runs)))
    assert got == sorted(want)


def test_helpers():
    rng = random.Random(2)
    for _ in range(300):
        s = [rng.randint(0, 1) for _ in range(rng.randint(1, 30))]
        assert z_function(s)[1:] == [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]
    assert largest_divisors(1) == () and sorted(largest_divisors(12)) == [4, 6] and largest_divisors(7) == (1,)
    assert collapse([b"a"] * 13, [(0, 13, 1)]) == b"a" and collapse([], []) == b""


def test_rows(spark, awkward, awkward_rows, empty):
    got = sorted((r.doc_id is None, r.doc_id or 0, [tuple(x) for x in r.runs], r.collapsed_sha256) for r in periodic_runs(awkward).collect())
    want = []
    for i, text, *_ in awkward_rows:
        words = [w.decode() for w in (text or "").encode().split()]
        runs = brute(words)
        want.append((i is None, i or 0, runs, hashlib.sha256(collapsed(words, runs).encode()).hexdigest()))
    assert got == sorted(want) and any(r[2] for r in got)
    assert periodic_runs(empty).count() == 0 and run_digests(periodic_runs(empty)).count() == 0


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    want = []
    for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        words = [w.decode() for w in (r["text"] or "").encode().split()]
        n, h = len(words), zlib.crc32(str(r["doc_id"]).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute(words)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else None
        told = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        want.append((r["doc_id"], len(runs), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(words, runs).encode()).hexdigest()))
    got = [tuple(r) for r in op12_periodic_runs(spark, sf).collect()]
    assert sorted(got) == sorted(want) and sum(r[1] > 0 for r in got) > 10
