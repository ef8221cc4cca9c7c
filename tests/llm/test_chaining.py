import random

import numpy as np

from framewarden.llm.chaining import Settings, best_spans, chains, covered, cut_words, minimizers, repeated_passages, without_repeats
from framewarden.llm.words import word_hashes


def brute_chain(xs, ys, s):
    n = len(xs)
    best = [float(s.k)] * n
    for i in range(n):
        for j in range(i):
            if xs[j] < xs[i] and ys[j] < ys[i]:
                best[i] = max(best[i], best[j] + s.k - s.gap_cost * ((xs[i] - xs[j]) + (ys[i] - ys[j])))
    return max(best)


def test_chains_have_the_best_score():
    rng, s = random.Random(7), Settings(max_gap=10**9)
    for _ in range(100):
        pts = sorted({(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(rng.randint(1, 25))})
        xs, ys = [p[0] for p in pts], [p[1] for p in pts]
        found = chains(xs, ys, s)
        assert sorted(i for c in found for i in c) == list(range(len(xs)))
        for c in found:
            assert all(xs[a] < xs[b] and ys[a] < ys[b] for a, b in zip(c, c[1:], strict=False))
        score = max(s.k * len(c) - s.gap_cost * (xs[c[-1]] - xs[c[0]] + ys[c[-1]] - ys[c[0]]) for c in found)
        assert abs(score - brute_chain(xs, ys, s)) < 1e-6


def test_every_window_has_a_seed():
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randint(0, 50)}" for _ in range(n)) for n in (0, 3, 8, 20, 23, 24, 200, 7)]
    words, first = word_hashes(texts)
    owner, at, _ = minimizers(words, first, 8, 16)
    for i, text in enumerate(texts):
        kmers, mine = max(0, len(text.split()) - 7), np.sort(at[owner == i])
        assert (len(mine) > 0) == (kmers > 0)
        assert all(((mine >= a) & (mine < a + 16)).any() for a in range(kmers - 15))


def corpus(rng):
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(5))
    prose = lambda n: [word() for _ in range(n)]
    passages, sentence, rows = [prose(n) for n in (51, 60, 140)], prose(13), []
    for d in range(60):
        text, inside = prose(rng.randint(5, 80)), None
        if d % 3 == 0:
            text = sentence + text
        if d % 4 == 0:
            inside = rng.choice(passages)
            copy = list(inside)
            if d % 8 == 0 and len(copy) > 100:
                copy[70] = "edited"
            text = text + copy + prose(rng.randint(0, 40))
        rows.append((d, " ".join(text), inside))
    return rows


def test_planted_passages(spark):
    rows = corpus(random.Random(8))
    df = spark.createDataFrame([(d, t, "x") for d, t, _ in rows], "doc_id long, text string, hash string").repartition(4)
    got = repeated_passages(df).collect()
    seen, clean = set(), {d for d, _, p in rows if p is None}
    for d, text, p in rows:
        if p is None:
            continue
        key = tuple(p)
        spans = [(r.start_word, r.end_word) for r in got if r.doc_id == d]
        start = next(i for i in range(len(text.split())) if text.split()[i : i + 40] == p[:40])
        if key in seen:
            assert any(a <= start and b >= start + len(p) for a, b in spans), (d, spans)
        seen.add(key)
    assert not {r.doc_id for r in got} & clean
    left = {r.doc_id: r.text for r in without_repeats(df).collect()}
    assert sum(" ".join(rows[0][2]) in t for t in left.values()) <= 1
    assert all(left[d] == t for d, t, p in rows if p is None)


def test_cutting():
    assert cut_words("  a b\n c  dé e ", [(1, 3)]) == "a dé e"
    assert cut_words("a b", [(0, 2)]) == ""


def test_awkward(awkward, awkward_rows, empty):
    got = repeated_passages(awkward).collect()
    pairs = {(r.doc_id, r.other_doc_id) for r in got}
    assert (1, 0) in pairs and (2, 0) in pairs and (12, 0) in pairs and not any(a is None for a, _ in pairs)
    assert {a for a, _ in pairs} == {1, 2, 12}
    out = without_repeats(awkward)
    assert out.columns == awkward.columns
    assert repeated_passages(empty).count() == 0 and without_repeats(empty).count() == 0


def test_a_passage_whose_parts_lie_in_smaller_ids(spark):
    rng = random.Random(3)
    prose = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    for n, cut in ((60, 30), (50, 25)):
        p = prose(n)
        texts = {1: prose(40) + p[:cut] + prose(40), 2: prose(30) + p[cut:] + prose(40), 5: prose(20) + p + prose(9), 6: prose(60) + p[:cut], 7: p[cut:] + prose(60), 9: prose(35) + p + prose(11)}
        df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
        got = [tuple(r)[:7] for r in repeated_passages(df).collect()]
        assert got == [(9, 35, 35 + n, 5, 20, 20 + n, n)]
        assert {r.doc_id: r.text for r in without_repeats(df).collect()}[9].split() == texts[9][:35] + texts[9][-11:]


def test_best_parts_of_a_path():
    rng, s = random.Random(5), Settings(min_words=20)
    for _ in range(300):
        path, x = [], 0
        for _ in range(rng.randint(1, 14)):
            n = rng.randint(4, 15)
            path.append((x, x, n))
            x += n + rng.randint(1, 6)
        got = best_spans(path, s)
        want = [path[j][0] + path[j][2] - path[i][0] for i in range(len(path)) for j in range(i, len(path)) if sum(p[2] for p in path[i : j + 1]) >= s.min_alike * (path[j][0] + path[j][2] - path[i][0]) - 1e-9]
        longest = max((n for n in want if n >= 20), default=0)
        assert max((b - a for a, b, *_ in got), default=0) == longest
        assert all(n >= s.min_alike * (b - a) - 1e-9 for a, b, _, _, n in got)


def test_an_equal_passage_beside_a_template(spark):
    rng = random.Random(4)
    prose = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    p, label = prose(60), prose(4)
    record = lambda: prose(3) + label
    one, two = (p + [w for _ in range(15) for w in record()] for _ in range(2))
    df = spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "doc_id long, text string")
    (row,) = repeated_passages(df).collect()
    assert (row.doc_id, row.other_doc_id, row.start_word, row.other_start) == (2, 1, 0, 0) and row.end_word >= 60
    assert row.words_alike >= 0.8 * row.end_word


def test_recall_of_changed_passages(spark):
    rng = random.Random(6)
    prose = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    rows, least = [], {0.88: 0.75, 0.9: 0.85, 0.95: 0.95}
    for c, (rate, regular) in enumerate((r, g) for r in least for g in (True, False)):
        for i in range(60):
            p = prose(100)
            q = list(p)
            for x in [int(m / (1 - rate)) - 1 for m in range(1, round(100 * (1 - rate)) + 1)] if regular else rng.sample(range(100), round(100 * (1 - rate))):
                q[x] = "changed"
            rows += [(c * 1000 + 2 * i, " ".join(prose(30) + p + prose(30))), (c * 1000 + 2 * i + 1, " ".join(prose(30) + q + prose(30)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id for r in repeated_passages(df).collect() if r.other_doc_id == r.doc_id - 1}
    for c, rate in enumerate(r for r in least for _ in range(2)):
        assert sum(d // 1000 == c for d in got) >= 60 * least[rate], (rate, c)


def alike(a, b):
    """Words of a common subsequence, plainly."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            row[j], last = (last + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_the_whole_query_against_brute_force(spark):
    """Every run of 50 equal words of a smaller id is inside a passage, and every passage is one by a plain alignment."""
    rng = random.Random(21)
    word = lambda: f"w{rng.randint(0, 400)}"
    pool = [[word() for _ in range(n)] for n in (50, 52, 70, 90, 130)]
    rows = []
    for d in range(70):
        text = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(pool))
            a = rng.choice([0, 0, rng.randint(0, 20)])
            p = p[a:]
            if rng.random() < 0.4 and len(p) > 60:
                p[rng.randrange(len(p))] = "changed"
            text += p + [word() for _ in range(rng.randint(0, 30))]
        rows.append((d // 2 * 2 if d > 60 else d, " ".join(text)))  # some ids repeat with other texts
    rows += [rows[5], (None, rows[7][1] + " tail"), (None, rows[8][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeated_passages(df).collect()
    import hashlib

    order = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256(r[1].encode()).hexdigest())
    texts = {order(r): r[1].split() for r in rows}
    seen = {}
    for key in sorted(texts):
        words = texts[key]
        mine = [r for r in got if (r.doc_id is None, r.doc_id or 0, r.text_sha256) == key]
        for i in range(len(words) - 49):
            if tuple(words[i : i + 50]) in seen:
                covered = set().union(*[range(r.start_word, r.end_word) for r in mine], set())
                assert set(range(i, i + 50)) <= covered, (key, i)
        for r in mine:
            others = [w for k, w in texts.items() if k < key and (None if k[0] else k[1]) == r.other_doc_id]
            a = words[r.start_word : r.end_word]
            assert len(a) >= 50 and any(alike(a, w[r.other_start : r.other_end]) >= 0.8 * len(a) for w in others)
        for i in range(len(words) - 49):
            seen[tuple(words[i : i + 50])] = key
    left = without_repeats(df).collect()
    assert sum(r.doc_id is None for r in left) <= 2 and len(left) <= len(rows)


def test_rows_go_by_id_and_text(spark):
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randint(0, 10**9)}" for _ in range(n))
    p = prose(60)
    rows = [(1, p + " " + prose(20), 1), (5, prose(30) + " " + p, 2), (5, "only here", 3), (None, p, 4)]
    out = without_repeats(spark.createDataFrame(rows, "doc_id long, text string, spans int"))
    assert out.columns == ["doc_id", "text", "spans"]
    assert sorted((r.spans, r.text) for r in out.collect()) == [(1, rows[0][1]), (2, rows[1][1][: -len(p) - 1]), (3, "only here")]


def test_links_whose_hubs_hold_only_parts(spark):
    """A changed passage whose seeds lie in several smaller ids, none of which holds enough of it."""
    rng = random.Random(12)
    prose = lambda n: [f"w{rng.randint(0, 10**9)}" for _ in range(n)]
    p = prose(60)
    changed = lambda text, at: [f"x{i}" if i in at else w for i, w in enumerate(text)]
    texts = {1: prose(40) + p[:30] + prose(40), 2: prose(30) + p[30:] + prose(40), 5: prose(20) + p + prose(9), 9: prose(35) + changed(p, {15, 44}) + prose(11)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(3)
    got = sorted(tuple(r)[:7] for r in repeated_passages(df).collect())
    assert got == [(9, 35, 95, 5, 20, 80, 58)]


def test_seeds_inside_spans():
    rng = random.Random(9)
    for _ in range(200):
        spans = [(a, a + rng.randint(1, 30)) for a in (rng.randint(0, 80) for _ in range(rng.randint(0, 5)))]
        x = np.array(sorted(rng.sample(range(100), 20)))
        starts, ends = np.array(spans, np.int64).reshape(-1, 2).T
        assert covered(x, starts, ends, 5).tolist() == [any(a <= p and p + 5 <= b for a, b in spans) for p in x.tolist()]
