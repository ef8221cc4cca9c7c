import hashlib
import random
from collections import Counter

import numpy as np

from framewarden.llm.bagminhash import components, near_duplicates, signatures


def multiset(text):
    w = (text or "").lower().split()
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows, threshold=0.8):
    """Connected components of all pairs at or above the threshold, and of equal texts."""
    ids = sorted({d for d, _ in rows})
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(d, t or "", multiset(t)) for d, t in rows]
    for i, (a, ta, sa) in enumerate(sets):
        for b, tb, sb in sets[:i]:
            both, either = sum((sa & sb).values()), sum((sa | sb).values())
            if ta == tb or (either and both >= threshold * either):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def test_signatures_are_unbiased():
    rng = np.random.default_rng(1)
    values = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    a[:3], b[:3] = [40, 7, 1000], [35, 8, 900]
    owner = np.repeat([0, 1], 60)
    counts = np.concatenate([a, b])
    keep = counts > 0
    s = signatures(np.concatenate([values, values])[keep], counts[keep], owner[keep], 2, 4096)
    true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((s[0] == s[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / 4096)


def test_against_all_pairs(spark):
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(12):
        base = ["w%d" % rng.randint(0, 400) for _ in range(rng.randint(30, 150))]
        for _ in range(rng.randint(1, 8)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = "x%d" % rng.randint(0, 99)
            rows.append((n, " ".join(text)))
            n += 1
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows)


def test_chains_of_near_copies(spark):
    # each is near the next only: the least one alone doesn't link them
    base = ["w%d" % i for i in range(120)]
    rows = []
    for n in range(8):
        text = list(base)
        for j in range(n * 2):
            text[5 + j * 7] = f"v{j}"
        rows.append((n, " ".join(text)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute(rows)


def test_awkward(awkward, awkward_rows, empty):
    rows = [*awkward_rows, (1, "another text of id one", 1, "x", 0.0, "en")]
    docs = awkward.sparkSession.createDataFrame(rows, awkward.schema).repartition(3)
    got = near_duplicates(docs).collect()
    classes = brute([(i, r[1]) for i, r in enumerate(rows)])
    members = {c: [i for i in classes if classes[i] == c] for c in classes.values()}
    want = []
    for i, r in enumerate(rows):
        mates = members[classes[i]]
        first = min(((rows[j][0] is None, rows[j][0] or 0, sha(rows[j][1])), rows[j][0]) for j in mates)
        want.append((r[0], first[1], len(mates), (r[0], sha(r[1])) == (first[1], first[0][2]), sha(r[1])))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert near_duplicates(empty).count() == 0


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def test_groups_near_the_threshold(spark):
    """Many copies of one passage, each edited at random, most pairs of them just below the threshold."""
    rng = random.Random(12)
    base = ["w%d" % i for i in range(140)]
    rows, n = [], 0
    for version in range(3):
        mine = list(base)
        for j in rng.sample(range(140), 6):
            mine[j] = f"v{version}-{j}"
        for _ in range(70):
            text = list(mine)
            for j in rng.sample(range(140), rng.randint(0, 6)):
                text[j] = f"x{rng.randint(0, 3)}"
            rows.append((n, " ".join(text)))
            n += 1
    rows += [(n + i, " ".join(["la la ho"] * (100 + 9 * i) + base[:i])) for i in range(40)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = brute(rows)
    assert {r.doc_id: r.class_id for r in got} == want
    assert len(set(want.values())) > 20


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(40)] + [(100 + rng.randint(0, 50), 100 + rng.randint(0, 50)) for _ in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.class_id for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
