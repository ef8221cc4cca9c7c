import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from framewarden.llm import collocations as C


def brute(rows, longest, often, covered, best):
    """lang -> phrases, counted in plain dictionaries."""
    f, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, *words[i : i + k]) for i in range(len(words) - k + 1))
    frequent = {p: n for p, n in f.items() if len(p) > 2 and n >= often}
    out = {}
    for (lang, *w), a in frequent.items():
        k = len(w)
        if any(p[0] == lang and len(p) - 1 > k and 100 * n >= covered * a and any(list(p[i : i + k]) == w for i in range(1, len(p) - k + 1)) for p, n in frequent.items()):
            continue
        score, _, left, right = min((1000000 * a * a // (f[lang, *w[:c]] * f[lang, *w[c:]]), c, f[lang, *w[:c]], f[lang, *w[c:]]) for c in range(1, k))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    rows = []
    for lang, found in out.items():
        rows += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:best], 1)]
    return sorted(rows)


def some_rows(rng, n):
    rows = []
    for _ in range(n):
        words = [rng.choice(["A", "a", "b", "B", "c", "é", "É", "dd", "Dd", "the", "of", "x\x0bY", "z"]) + rng.choice(["", "", "", "", "", ".", ",", "\n", "\t", ";"]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), " ".join(words)))
    return rows


@pytest.mark.parametrize("longest, often, covered, best, block", [(3, 10, 50, 2000, 1 << 21), (2, 2, 50, 10, 50), (4, 3, 80, 30, 200), (5, 4, 50, 2000, 1)])
def test_against_plain_counts(spark, monkeypatch, longest, often, covered, best, block):
    monkeypatch.setattr(C, "BLOCK", block)
    rows = some_rows(random.Random(longest), 250)
    df = spark.createDataFrame([(i, *r, 1) for i, r in enumerate(rows)], "n long, lang string, text string, w1 int").repartition(3)
    got = sorted(tuple(r) for r in C.collocations(df, longest, often, covered, best).collect())
    assert got == brute(rows, longest, often, covered, best) and got


def test_large_counts_are_exact(spark):
    big = 10**15 - 3
    one = spark.createDataFrame([("en", 1, 2, big - 1)], "lang string, w1 long, w2 long, n long")
    words = spark.createDataFrame([("en", 1, big, "a"), ("en", 2, big, "b")], "lang string, w1 long, n long, word string")
    totals = spark.createDataFrame([("en", 2 * big)], "lang string, total long")
    row = C.scored(C.Levels(totals, words, {2: one}, {0: 1, 1: 2, 2: 1}), 2).first()
    assert row.score == 1000000 * (big - 1) ** 2 // big**2 and (row.l, row.r, row.n) == (big, big, 2 * big)


def test_words_that_share_a_hash_are_hashed_anew(spark, monkeypatch):
    own = C.first_relation
    seeds = []

    def relation(docs, lang, text_col, seed):
        seeds.append(seed)
        df = own(docs, lang, text_col, seed)
        if seed == 1:  # as if all words had one hash
            import pyspark.sql.functions as F

            df = df.withColumn("words", F.transform("words", lambda x: F.lit(5).cast("long")))
        return df

    monkeypatch.setattr(C, "first_relation", relation)
    rows = [("en", "a b c a b c a b")] * 5
    got = sorted(tuple(r) for r in C.collocations(spark.createDataFrame(rows, "lang string, text string"), 3, 5).collect())
    assert got == brute(rows, 3, 5, 50, 2000) and seeds == [1, 2]


def test_bitmap_forms_agree():
    words = np.random.default_rng(3).integers(-(2**62), 2**62, (500, 2))
    bits = 1 << 20
    at = np.unique(C.phrase_hashes(words[:250]) & (bits - 1))
    packed = np.zeros(bits // 64, np.int64)
    np.bitwise_or.at(packed, at >> 6, np.int64(1) << (at & 63))
    flat = np.unpackbits(packed.view(np.uint8), bitorder="little").view(bool)
    assert C.in_bitmap(packed, words)[:250].all() and (C.in_bitmap(packed, words) == C.in_bitmap(flat, words)).all()


def test_rows(spark, awkward, awkward_rows, empty):
    got = sorted(tuple(r) for r in C.collocations(awkward, often=2).collect())
    assert got == brute([(r[5], r[1]) for r in awkward_rows], 3, 2, 50, 2000) and got
    assert C.collocations(empty).count() == 0


def test_a_bitmap_lets_as_few_others_through_for_many_hashes(spark):
    rng = np.random.default_rng(5)
    others = rng.integers(-(2**62), 2**62, 200_000)
    for n in (10_000, 120_000):
        own = rng.integers(-(2**62), 2**62, n)
        found = C.bitmap(spark.createDataFrame(pa.table({"h": own})), n)
        assert C.marked(found, own).all() and C.marked(found, others).mean() < 0.03


def test_packed_counts_take_few_bytes():
    rng = np.random.default_rng(1)
    for size in (0, 1, 5, 300_000):
        h = np.unique(rng.integers(0, 2**32, size))
        n = rng.integers(1, 3, len(h))
        n[:1] = 2**33
        batch = C.packed(h, n)
        got = list(C.unpacked([batch.slice(0, 3), batch.slice(3)]))
        assert np.array_equal(np.concatenate([x for x, _ in got] or [h]), h) and np.array_equal(np.concatenate([x for _, x in got] or [n]), n)
    assert batch.nbytes < 5 * len(h)


def test_blocks_are_written_in_few_bytes():
    rng = np.random.default_rng(2)
    for k, n in ((1, 1), (1, 70_000), (2, 300), (3, 70_000)):
        vocabulary = rng.integers(-(2**62), 2**62, 1 + n // 20)
        words = vocabulary[rng.integers(0, len(vocabulary), (n, k))]
        block = C.Block(np.cumsum(rng.integers(1, 70_000, 2 * n)), rng.integers(0, n, 2 * n), words)
        row = pa.record_batch(block.row("en"), C.COLUMNS)
        again = C.Block.of(row, 0, k)
        assert np.array_equal(again.at, block.at) and np.array_equal(again.phrase, block.phrase) and np.array_equal(again.words, words)
    assert row.nbytes < 0.7 * (8 * 2 * n + 8 * k * n)


def test_the_relation_of_words_holds_the_frequent_ones(spark):
    common, rare = "a b. " * 400, " ".join(f"rare{i}" for i in range(20_000))
    docs = spark.createDataFrame([("en", common), ("en", rare), ("de", "x y")], "lang string, text string").coalesce(1)
    frequent = docs.where("text like 'a b.%'")
    first = C.first_relation(frequent, C.F.col("lang"), "text", 1).select(C.F.explode("words").alias("w1"))
    keep = spark.sparkContext.broadcast(C.bitmap(C.hashes_of(first, 1), 2))
    rows = C.frequent_relation(docs, C.F.col("lang"), "text", 1, keep).collect()
    assert {r.lang: r.total for r in rows} == {"en": 20_800, "de": 2}
    assert sum(len(r.words) for r in rows) < 20 and sum(len(r.steps) + len(r.phrase) for r in rows) < 2_000


def test_no_shuffle_files_stay(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = disk.getAllFiles()
        return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, there = spark.conf.get(key), files()
    C.mine(docs := spark.createDataFrame([("en", "a b c d. " * 30)], "lang string, text string"), 3, 10, C.F.col("lang"), "text")
    assert files() - there
    there = files()
    found = C.collocations(docs)
    assert not files() - there and spark.conf.get(key) == before and found.count()
