"""Byte-pair encoding with an automaton compiled from the merges, for tokenizer files with word ends.

Compilation. The automaton reads tokens: its state is the token just read, and it has an arc q -t-> t while t may follow
q. It starts with the base symbols, each of which may follow each, and the merges are applied in their order, each as one
gadget. The gadget of (a, b) -> c
  - makes the state c, whose arcs out are those of b at that time;
  - takes the arc a -b-> away: after the merge b never follows a;
  - gives an arc labelled c to each state that now has one labelled a.
What is left accepts exactly the token sequences that the merges produce. Written out, the arcs of a large vocabulary are
hundreds of millions; the copies are therefore kept as they are made, by reference and date: right[c] = b for the arcs
out, left[c] = a for the arcs in, birth[c] for the date, and a table of the arcs taken away with their dates. Whether an
arc exists is looked up in these tables along the chain of copies (`Automaton.has_arc`); `dense_arcs` in the tests writes
the gadgets out and is compared with it.

Encoding. Each prefix of a word has one encoding, so exactly one state is reached at each place of a word. From each place
the automaton goes along a trie of token spellings and takes the arcs that exist; all words of a slice go in step.
Decoding emits the labels of the arcs.

Characters are classed as the tokenizers library classes them (`Characters`): its tables and Python's are of different versions of
Unicode. Where they differ in lower case or normal form, the library's own normaliser is called.

Texts are cut at white space first, and what is between is encoded once per slice, however often it comes.
Answers about arcs are kept in a table of fixed size.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import text_batches
from .words import give_back, text_slices

NEVER = np.int64(1 << 40)
#: Runs between white space kept encoded by a task; when there are more, only those that the last slice had again stay.
KEPT = 1 << 19
#: Runs encoded in step; more would only take more memory.
STEP = 1 << 14
#: Arcs whose answers a task keeps, by place of their hash: the last one asked for. A power of two.
ASKED = 1 << 20
#: Words of more bytes are encoded one by one.
LONG = 64
#: Bytes of text in a slice.
SLICE = 8 << 20


class Table:
    """A fixed map from non-negative int64 keys to int32 values with array look-ups (open addressing)."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift = np.uint64(64 - bits)
        self.mask = (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.full(1 << bits, -1, np.int32)
        at = self._home(keys)
        left = np.arange(len(keys))
        while len(left):
            free = self.keys[at[left]] < 0
            slots, first = np.unique(at[left[free]], return_index=True)
            placed = left[free][first]
            self.keys[slots], self.values[slots] = keys[placed], values[placed]
            left = np.setdiff1d(left, placed, assume_unique=True)
            taken = self.keys[at[left]] >= 0
            at[left[taken]] = (at[left[taken]] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys; -1 where there is none."""
        at = self._home(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        more = np.flatnonzero((there != keys) & (there >= 0))
        while len(more):
            at[more] = (at[more] + 1) & self.mask
            there = self.keys[at[more]]
            hit = there == keys[more]
            out[more[hit]] = self.values[at[more[hit]]]
            more = more[~hit & (there >= 0)]
        return out


class Automaton:
    """The compiled merges. ``tokens`` are spelt in symbols: a byte, or 256 + a byte for the last of a word."""

    def __init__(self, spellings: list[list[int]], merges: list[tuple[int, int, int]]) -> None:
        n = len(spellings)
        self.n = n
        self.left = np.full(n, -1, np.int64)
        self.right = np.full(n, -1, np.int64)
        self.birth = np.full(n, -1, np.int64)
        for date, (a, b, c) in enumerate(merges):
            if self.birth[c] < 0:
                self.left[c], self.right[c], self.birth[c] = a, b, date
        pairs = np.array([(a, b) for a, b, _ in merges], np.int64).reshape(-1, 2)
        self.taken = Table(pairs[:, 0] * n + pairs[:, 1], np.arange(len(merges), dtype=np.int32))
        # A gadget whose arc a -b-> was gone already can never fire: its state has no way in.
        made = np.flatnonzero(self.birth >= 0)
        usable = np.ones(n, bool)
        usable[made] = self.has_arc(self.left[made], self.right[made], self.birth[made])
        for a, b, c in merges:  # in order, so that parts are settled before what is made of them
            usable[c] &= bool(usable[a] and usable[b])
        # the trie of the spellings: arcs (node, symbol) -> node, and the token that ends in a node
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for token, spelling in enumerate(spellings):
            if usable[token] and spelling:
                node = 0
                for symbol in spelling:
                    node = nodes.setdefault((node, symbol), len(nodes) + 1)
                ends[node] = token
        self.trie = Table(np.array([a * 512 + s for a, s in nodes], np.int64), np.fromiter(nodes.values(), np.int32, len(nodes)))
        self.ends = np.full(len(nodes) + 1, -1, np.int64)
        for node, token in ends.items():
            self.ends[node] = token

    def has_arc(self, q: np.ndarray, t: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether t may follow q once the merges dated before ``until`` (default: all) are applied."""
        out = np.ones(len(q), bool)
        at = np.arange(len(q))
        until = np.full(len(q), NEVER) if until is None else until.astype(np.int64)
        while len(at):
            date = self.taken.find(q * self.n + t)
            gone = (date >= 0) & (date < until)
            out[at[gone]] = False
            born_q, born_t = self.birth[q], self.birth[t]
            on = ~gone & ((born_q >= 0) | (born_t >= 0))
            at, q, t, born_q, born_t = at[on], q[on], t[on], born_q[on], born_t[on]
            # the younger of the two was copied: q from right[q] at its birth, t from left[t] just after its gadget
            copied = born_q > born_t
            until = np.where(copied, born_q, born_t + 1)
            q, t = np.where(copied, self.right[q], q), np.where(copied, t, self.left[t])
        return out

    def follows(self, q: np.ndarray, t: np.ndarray) -> np.ndarray:
        """`has_arc` once all merges are applied, with the answers kept: the same arcs are asked for again and again."""
        if not hasattr(self, "asked"):
            self.asked = np.full(ASKED, -1, np.int64)  # twice the arc, and 1 more if it exists
        arc = q * self.n + t
        at = (arc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(65 - ASKED.bit_length())).astype(np.int64)
        known = self.asked[at]
        new = np.flatnonzero(known >> 1 != arc)
        if len(new):
            known[new] = self.asked[at[new]] = 2 * arc[new] + self.has_arc(q[new], t[new])
        return known & 1 == 1

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words (non-empty, without line ends) one after the other, and the offsets of the words in them."""
        data = np.frombuffer(("\n".join(words) + "\n").encode("utf-8", "surrogatepass"), np.uint8) if words else np.zeros(0, np.uint8)
        ends = np.flatnonzero(data == 10)
        sizes = np.diff(ends, prepend=-1) - 1
        symbols = data[data != 10].astype(np.int64)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        symbols[offsets[1:] - 1] += 256
        long = np.flatnonzero(sizes > LONG)
        if not len(long):
            return self._in_step(symbols, offsets)
        # long words one by one: in step with the others they would leave the rest behind
        short = np.flatnonzero(sizes <= LONG)
        kept = np.repeat(sizes <= LONG, sizes)
        ids, at = self._in_step(symbols[kept], np.concatenate([[0], np.cumsum(sizes[short])]))
        parts: list = [None] * len(words)
        for i, a, b in zip(short.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
            parts[i] = ids[a:b]
        for i in long.tolist():
            parts[i] = self._alone(symbols[offsets[i] : offsets[i + 1]].tolist())
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])

    def _alone(self, symbols: list[int]) -> np.ndarray:
        """One word, place by place, on the same tables."""
        if not hasattr(self, "dicts"):
            self.dicts = [dict(zip(t.keys[t.keys >= 0].tolist(), t.values[t.keys >= 0].tolist(), strict=True)) for t in (self.trie, self.taken)]
        trie, taken = self.dicts
        n, left, right, birth, ends = self.n, self.left, self.right, self.birth, self.ends

        def arc(q: int, t: int) -> bool:
            until = int(NEVER)
            while True:
                if taken.get(q * n + t, until) < until:
                    return False
                born_q, born_t = int(birth[q]), int(birth[t])
                if born_q < 0 and born_t < 0:
                    return True
                if born_q > born_t:
                    q, until = int(right[q]), born_q
                else:
                    t, until = int(left[t]), born_t + 1

        reached, step = [-1] * (len(symbols) + 1), [0] * (len(symbols) + 1)
        for s in range(len(symbols)):
            if s and reached[s] < 0:
                continue
            node = 0
            for e in range(s, len(symbols)):
                node = trie.get(node * 512 + symbols[e], -1)
                if node < 0:
                    break
                token = int(ends[node])
                if token >= 0 and reached[e + 1] < 0 and (not s or arc(reached[s], token)):
                    reached[e + 1], step[e + 1] = token, e + 1 - s
        out, at = [], len(symbols)
        while at:
            out.append(reached[at])
            at -= step[at]
        return np.array(out[::-1], np.int64)

    def _in_step(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.diff(offsets)
        # reached[p]: the token that ends before symbol p of its word; one entry more per word for its end
        reached = np.full(len(symbols) + len(sizes), -1, np.int64)
        step = np.zeros(len(reached), np.int64)
        home = offsets[:-1] + np.arange(len(sizes))
        order = np.argsort(-sizes, kind="stable")
        by_size = -sizes[order]
        for s in range(int(sizes.max(initial=0))):
            active = order[: np.searchsorted(by_size, -s, "left")]  # words longer than s
            at, end = offsets[active] + s, offsets[active] + sizes[active]
            place, state = home[active] + s, reached[home[active] + s]
            if s:
                there = state >= 0
                at, end, place, state = at[there], end[there], place[there], state[there]
            node, length = np.zeros(len(at), np.int64), 0
            while len(at):
                node = self.trie.find(node * 512 + symbols[at + length]).astype(np.int64)
                length += 1
                on = node >= 0
                node, at, end, place, state = node[on], at[on], end[on], place[on], state[on]
                token = self.ends[node]
                full = np.flatnonzero(token >= 0)
                if s and len(full):
                    full = full[self.follows(state[full], token[full])]
                reached[place[full] + length] = token[full]
                step[place[full] + length] = length
                on = at + length < end
                node, at, end, place, state = node[on], at[on], end[on], place[on], state[on]
        # back along the arcs, all words in step
        out, owner, number = [], [], []
        place = home + sizes
        who, k = np.arange(len(sizes)), 0
        while len(who):
            out.append(reached[place])
            owner.append(who)
            number.append(np.full(len(who), -k))
            place = place - step[place]
            k += 1
            on = place > home[who]
            who, place = who[on], place[on]
        ids, owner, number = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out, owner, number))
        order = np.lexsort((number, owner))
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])


def byte_symbols() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones as they are, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Planes that hold letters, digits or marks; what lies beyond is neither in any version of Unicode, which the tests hold against the
#: library.
PLANES = (*range(0x40000), *range(0xE0000, 0xF0000))


def code_ranges(codes: np.ndarray) -> str:
    """Ascending code points as the inside of a character class."""
    breaks = np.flatnonzero(np.diff(codes) != 1)
    first, last = codes[np.concatenate([[0], breaks + 1])], codes[np.concatenate([breaks, [len(codes) - 1]])]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first.tolist(), last.tolist(), strict=True)) if len(codes) else ""


class Characters:
    """How the tokenizers library classes and normalises characters, read off it once, on the driver: its tables are of another
    version of Unicode than Python's or the regex module's."""

    def __init__(self, pattern: str) -> None:
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split

        split = Split(Regex(pattern), "removed", invert=True)
        codes = np.array([c for c in PLANES if not 0xD800 <= c < 0xE000])
        kind = np.zeros(len(codes), "U1")
        for a in range(0, len(codes), 1 << 15):
            # a letter joins the a before it, a number stands alone, other signs join the ! behind, white space is in no piece
            part = codes[a : a + (1 << 15)].tolist()
            spans = np.array([at for _, at in split.pre_tokenize_str("".join(f"a{chr(c)}{chr(c)}! " for c in part))])
            at, size = spans[:, 0], spans[:, 1] - spans[:, 0]
            kind[a : a + len(part)] = "S"
            for which, place, length in (("L", 0, 3), ("N", 1, 1), ("O", 1, 3)):
                kind[a + at[(at % 5 == place) & (size == length)] // 5] = which
        self.classes = {"\\p{L}": code_ranges(codes[kind == "L"]), "\\p{N}": code_ranges(codes[kind == "N"]), "\\s": code_ranges(codes[kind == "S"])}
        others = self._odd([chr(c) for c in codes[kind != "S"].tolist() if c])
        whole = "".join(map(chr, codes.tolist()))
        for name in self.classes:
            own = np.zeros(len(codes), bool)
            own[[m.start() for m in regex.finditer(name, whole)]] = True
            others.update(codes[own != (kind == {"\\p{L}": "L", "\\p{N}": "N", "\\s": "S"}[name])].tolist())
        at = np.array(sorted(others))
        breaks = np.flatnonzero(np.diff(at) != 1)
        #: First and last code points of the ranges in which the library does something else than Python and the regex module.
        self.others = np.stack([at[np.concatenate([[0], breaks + 1])], at[np.concatenate([breaks, [len(at) - 1]])]], axis=1)

    @staticmethod
    def _odd(chars: list[str]) -> set[int]:
        """Characters that Python doesn't know, or that it lower-cases, composes or orders in another way."""
        library = library_normal_form()
        out = {ord(c) for c in chars if unicodedata.category(c) == "Cn"}
        marked = [c for c in chars if unicodedata.combining(c)]
        probes = [(c, c) for c in chars] + [(c, "x\u0345" + c) for c in marked] + [(c, "x" + c + "\u0334") for c in marked]
        probes += [(c, d) for c in chars if (d := unicodedata.normalize("NFD", c)) != c]
        whole = "\0".join([text for _, text in probes])
        for (c, _), a, b in zip(probes, library(whole).split("\0"), python_normal_form(whole).split("\0"), strict=True):
            if a != b:
                out.add(ord(c))
        return out

    def pattern(self, text: str) -> str:
        """The pattern with the library's classes in place of their names."""
        for name, ranges in self.classes.items():
            text = text.replace(name, ranges)
        return text


def python_normal_form(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # lower case goes by character here


def library_normal_form() -> Callable[[str], str]:
    from tokenizers.normalizers import NFC, Lowercase, Sequence

    return Sequence([NFC(), Lowercase()]).normalize_str


class WordTokenizer:
    """What a tokenizer file of this kind says, compiled: special tokens, word pattern, automaton, labels."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        symbols = byte_symbols()
        spellings: list[list[int]] = [[] for _ in self.labels]
        for token, i in vocab.items():
            self.labels[i] = token
            if token not in self.special:
                body = token.removesuffix(suffix)
                spelling = [symbols[ch] for ch in body]
                if body != token and spelling:
                    spelling[-1] += 256
                spellings[i] = spelling
        for token, i in self.special.items():
            self.labels[i] = token
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # a merge joins the spellings; the word end stays on the right part
        self.automaton = Automaton(spellings, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        characters = Characters(split["pattern"]["Regex"])
        self.pattern, self.others = split["pattern"]["Regex"], characters.others
        self.library_pattern = characters.pattern(self.pattern)

    def compiled(self) -> WordTokenizer:
        """With the patterns, which are left out when the object is sent."""
        if "find" not in self.__dict__:
            self.find = regex.compile(self.pattern + "|\n").findall
            self.library_find = re.compile(self.library_pattern + "|\n").findall
            self.is_other = np.zeros(0x110000, bool)
            for a, b in self.others.tolist():
                self.is_other[a : b + 1] = True
            self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        return self

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "library_find", "is_other", "cut")}

    def encode_runs(self, runs: list[str]) -> list[bytes]:
        """The ids, as little-endian unsigned 32-bit integers, of each run of text without white space."""
        whole = "\n".join(runs)
        if self.special and any(t in whole for t in self.special):
            return [self._with_special(r) for r in runs]
        return self._plain(whole, len(runs))

    def _with_special(self, run: str) -> bytes:
        parts = self.cut(run)
        return b"".join(self.special[p].to_bytes(4, "little") if i % 2 else self._plain(p, 1)[0] for i, p in enumerate(parts) if p)

    def _plain(self, whole: str, n: int) -> list[bytes]:
        """n runs, one on each line."""
        if whole.isascii():
            return self._found(self.find(whole.lower() + "\n"), n)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        other = self.is_other[codes]
        if not other.any():
            return self._found(self.find(python_normal_form(whole) + "\n"), n)
        # the runs that the library treats in another way go by its tables, which is slower
        runs = whole.split("\n")
        apart = np.unique(np.cumsum(codes == 10)[other]).tolist()
        out = dict(zip(apart, self._found(self.library_find(library_normal_form()("\n".join(runs[i] for i in apart)) + "\n"), len(apart)), strict=True))
        rest = [i for i in range(n) if i not in out]
        if rest:
            out.update(zip(rest, self._plain("\n".join(runs[i] for i in rest), len(rest)), strict=True))
        return [out[i] for i in range(n)]

    def _found(self, found: list[str], n: int) -> list[bytes]:
        """The ids of the words of n lines."""
        line = np.flatnonzero(np.fromiter((w == "\n" for w in found), bool, len(found)))
        ids, offsets = self.automaton.encode([w for w in found if w != "\n"])
        data = ids.astype("<u4").tobytes()
        ends = (4 * offsets[line - np.arange(n)]).tolist()
        return [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        """The labels of the arcs, with a space between."""
        labels = self.labels
        return " ".join([labels[i] for i in ids.tolist()])


#: White space that str.split knows and the tokenizer's pattern doesn't.
CONTROL = regex.compile("[\x1c-\x1f]")
SPACES = regex.compile(r"\s+")


def runs_of(text: str) -> list[str]:
    if CONTROL.search(text):
        return [r for r in SPACES.split(text) if r]  # the regex module's \s leaves the four separators out
    return text.split()


class Encoder:
    """Encodes texts and keeps the runs that it has seen, in bounded memory: run -> (ids as bytes, what else is wanted)."""

    def __init__(self, tokenizer: WordTokenizer, decode: bool = False) -> None:
        self.tokenizer, self.decode = tokenizer.compiled(), decode
        self.kept: dict = {}

    def __call__(self, texts: list[str]) -> Iterator[tuple[bytes, str | None]]:
        split = [runs_of(t) for t in texts]
        runs = set().union(*split)
        new = list(runs.difference(self.kept))
        if len(self.kept) + len(new) > KEPT:  # only what has come again stays
            self.kept = {r: self.kept[r] for r in runs.intersection(self.kept)}
        for at in range(0, len(new), STEP):
            some = new[at : at + STEP]
            ids = self.tokenizer.encode_runs(some)
            if self.decode:
                decode = self.tokenizer.decode
                self.kept.update((r, (x, decode(np.frombuffer(x, "<u4")))) for r, x in zip(some, ids, strict=True))
            else:
                self.kept.update(zip(some, ids, strict=True))
        kept = self.kept
        for runs in split:
            if self.decode:
                found = [kept[r] for r in runs]
                yield b"".join([x for x, _ in found]), " ".join([x for _, x in found])
            else:
                yield b"".join(map(kept.__getitem__, runs)), None


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256, decoded_sha256.

    ``path`` is a tokenizer file. Null texts count as empty: no tokens, digests of nothing. Rows that repeat are encoded
    each; a null doc_id is carried through; other columns are not read.
    """
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(WordTokenizer(path))  # its size is that of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value, decode=True)
        for batch in batches:
            for part, texts in text_slices(batch, most=SLICE):
                counts, digests, decoded = [], [], []
                for ids, text in encoder(texts):
                    counts.append(len(ids) // 4)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(text.encode()).hexdigest())
                yield pa.record_batch([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        del encoder
        give_back()

    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
