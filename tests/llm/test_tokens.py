import hashlib
import math
import random
import unicodedata
import zlib

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")

from tokenizers import Tokenizer  # noqa: E402

from framewarden.llm.bpe import Automaton, Encoder, WordTokenizer, encode_digests  # noqa: E402
from framewarden.llm.packing import best_fit, pack_documents  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def dense_arcs(n, base, merges):
    """The gadgets written out: arcs[q, t] tells whether t may follow q."""
    arcs = np.zeros((n, n), bool)
    arcs[np.ix_(base, base)] = True
    for a, b, c in merges:
        if not arcs[a, b]:
            continue
        arcs[c, :] = arcs[b, :]
        arcs[a, b] = False
        arcs[:, c] = arcs[:, a]
    return arcs


def test_the_tables_are_the_gadgets():
    rng = random.Random(2)
    for _ in range(30):
        spell = [[i] for i in range(3)]
        known, merges = {tuple(s): i for i, s in enumerate(spell)}, []
        while len(merges) < 8:
            a, b = rng.randrange(len(spell)), rng.randrange(len(spell))
            new = tuple(spell[a] + spell[b])
            if new not in known:
                known[new] = len(spell)
                merges.append((a, b, len(spell)))
                spell.append(list(new))
        arcs = dense_arcs(len(spell), [0, 1, 2], merges)
        machine = Automaton(spell, merges)
        q, t = np.divmod(np.arange(len(spell) ** 2), len(spell))
        live = machine.ends[machine.ends >= 0]
        ok = np.isin(q, live) & np.isin(t, live)
        assert (machine.has_arc(q, t) == arcs[q, t])[ok].all()


def pieces():
    return ["aaaa", "the", "ing", "é", "日本", "'", "'s", "'re", "!", "<|endoftext|>", " ", "\n", "\x1c", "　", "İ", "Σ", "ΑΣ", "ß", "é", "123", "½", "😀", "x", "hello", "-", "힣", "ﬁ", "Ⅷ", "\x00", "\x85"]


def test_encodes_and_decodes_as_the_library(library):
    rng, encoder = random.Random(3), Encoder(WordTokenizer(PATH), decode=True)
    texts = ["".join(rng.choice(pieces()) for _ in range(rng.randint(0, 20))) for _ in range(1500)]
    texts += ["a" * n for n in range(80)] + ["ab" * n for n in range(60)] + ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 90))) for _ in range(1500)]
    for text, (ids, decoded) in zip(texts, encoder(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_digests(awkward, awkward_rows, library, empty):
    want = []
    for r in awkward_rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted((tuple(r) for r in encode_digests(awkward, PATH).collect()), key=repr) == sorted(want, key=repr)
    assert encode_digests(empty, PATH).count() == 0


def test_best_fit_rule():
    rng = random.Random(4)
    for _ in range(100):
        sizes = [rng.randint(1, 50) for _ in range(rng.randint(0, 60))]
        bins = best_fit(sizes, 50)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= 50 for b in bins)
        rooms = []
        for size in sorted(sizes, reverse=True):
            fits = [r for r in rooms if r >= size]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - size)
            else:
                rooms.append(50 - size)
        assert len(rooms) == len(bins)


def test_packing(awkward, awkward_rows, library, empty):
    for capacity in (64, 4096):
        got = pack_documents(awkward, PATH, capacity=capacity).collect()
        want, total = [], 0
        for r in awkward_rows:
            ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
            total += len(ids)
            want += [(r[0], n, at, len(ids[at : at + capacity]), zlib.crc32(ids[at : at + capacity].tobytes())) for n, at in enumerate(range(0, len(ids), capacity))]
        assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == sorted(want, key=repr)
        bins = {}
        for r in got:
            bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
        for members in bins.values():
            at = 0
            for offset, length in sorted(members):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(bins) <= math.ceil(total / capacity) + 1
    assert pack_documents(empty, PATH).count() == 0


def test_every_character_is_split_as_the_library_does(library):
    """All planes that hold letters, digits or marks, and some of the others; then awkward ones at random, in words."""
    encoder = Encoder(WordTokenizer(PATH))
    codes = [*range(0xD800), *range(0xE000, 0x40000), *range(0x40000, 0xE0000, 997), *range(0xE0000, 0xF0000, 7), *range(0xF0000, 0x110000, 997)]
    texts = [f"a{chr(c)}b1" for c in codes]
    rng = random.Random(4)
    odd = [chr(c) for c in codes if unicodedata.category(chr(c)) in ("Cn", "Mn", "Mc", "Lm")]
    texts += ["".join(rng.choice(odd) if rng.random() < 0.6 else rng.choice("aAéÉΣσßİ ıǅ's1") for _ in range(rng.randint(1, 12))) for _ in range(5000)]
    for a in range(0, len(texts), 20000):
        some = texts[a : a + 20000]
        want = [np.array(e.ids, "<u4").tobytes() for e in library.encode_batch(some, add_special_tokens=False)]
        assert [ids for ids, _ in encoder(some)] == want


def test_runs_are_encoded_a_bounded_number_at_a_time():
    from framewarden.llm import bpe

    tokenizer = WordTokenizer(PATH)
    sizes, whole = [], tokenizer.encode_runs
    tokenizer.encode_runs = lambda runs: sizes.append(len(runs)) or whole(runs)
    texts = [" ".join(f"w{i}" for i in range(20_000)), "w1 w2 w19999"]
    got = [ids for ids, _ in Encoder(tokenizer)(texts)]
    assert max(sizes) <= bpe.STEP and sum(sizes) == 20_000
    assert got == [b"".join(whole(t.split())) for t in texts]


def test_arcs_asked_for_again_are_not_looked_up_again(monkeypatch):
    automaton = Automaton([[0], [1], [0, 1], [1, 1], [0, 1, 1]], [(0, 1, 2), (1, 1, 3), (2, 1, 4)])
    q, t = (np.array(v) for v in zip(*[(q, t) for q in range(5) for t in range(5)], strict=True))
    want = automaton.has_arc(q, t)
    monkeypatch.setattr("framewarden.llm.bpe.ASKED", 4)  # arcs push each other out
    crowded = Automaton([[0], [1], [0, 1], [1, 1], [0, 1, 1]], [(0, 1, 2), (1, 1, 3), (2, 1, 4)])
    for _ in range(3):
        assert (crowded.follows(q, t) == want).all() and (crowded.follows(q[:2], t[:2]) == want[:2]).all()
    monkeypatch.undo()
    assert (automaton.follows(q, t) == want).all()
    monkeypatch.setattr(automaton, "has_arc", lambda *a: 1 / 0)
    last = automaton.asked[automaton.asked >= 0] >> 1
    assert len(last) and (automaton.follows(last // 5, last % 5) == automaton.asked[automaton.asked >= 0] % 2).all()
