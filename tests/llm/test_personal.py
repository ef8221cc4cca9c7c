import hashlib
import random
import re

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from framewarden.llm.personal import KINDS, Normalised, added_spans, personal_data, plain_spans, span_digests
from framewarden.llm.queries import op11_pii_deobfuscation

#: The contract's patterns, as they are written there.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def good(kind, found):
    digits = re.sub("[^0-9]", "", found)
    if kind == "ip":
        return all(int(part) <= 255 for part in found.split("."))
    if kind == "card":
        total = sum(sum(map(int, str(int(d) * (2 if i % 2 else 1)))) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, kind in enumerate(KINDS) for m in PATTERNS[kind].finditer(text) if good(kind, m[0])]


def test_plain_spans_on_random_texts():
    rng = random.Random(1)
    for alphabet in ("a.@-1", "12. ", "1 -", "+1 ().-", "a1.@+ -%_\n", "0a@.25 -+(é"):
        for _ in range(1500):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 70)))
            assert plain_spans(text) == brute(text), text


@pytest.mark.parametrize(
    "kind, disguised, clear",
    [
        ("email", "ann.90 at mail2 dot example dot com", "ann.90@mail2.example.com"),
        ("email", "ann[at]mail2[dot]example[dot]com", "ann@mail2.example.com"),
        ("email", "ann (at) mail.example.com", "ann@mail.example.com"),
        ("email", "ann {AT} mail {DOT} example {DOT} com", "ann@mail.example.com"),
        ("email", "ann @ example . com", "ann@example.com"),
        ("email", "ann_at_example_dot_org", "ann@example.org"),
        ("email", "ann@example[.]com", "ann@example.com"),
        ("email", "ann dot lee at example dot org", "ann.lee@example.org"),
        ("email", "аnn@exаmple.com", "ann@example.com"),  # Cyrillic a
        ("email", "ａｎｎ＠ｅｘａｍｐｌｅ．ｃｏｍ", "ann@example.com"),
        ("email", "an​n@exam­ple.com", "ann@example.com"),
        ("email", "ann&#64;example&period;com", "ann@example.com"),
        ("email", "ann arroba example punto com", "ann@example.com"),
        ("ip", "161 dot 17 dot 88 dot 162", "161.17.88.162"),
        ("ip", "161[.]17[.]88[.]162", "161.17.88.162"),
        ("ip", "one six one dot one seven dot eight dot two", "161.17.8.2"),
        ("ip", "١٦١.17.88.162", "161.17.88.162"),
        ("card", "four one one one one one one one one one one one one one one one", "4111111111111111"),
        ("card", "4I11 l111 1111 1111", "4111 1111 1111 1111"),
        ("card", "4111–1111–1111–1111", "4111-1111-1111-1111"),
        ("card", "vier eins eins eins 1111 1111 1111", "4111 1111 1111 1111"),
        ("phone", "plus one (zero one seven) five five five dash seven seven one three", "+1 (017) 555-7713"),
        ("phone", "+1 (０１７) 555-7713", "+1 (017) 555-7713"),
        ("phone", "+un 017 cinq cinq cinq 7713", "+1 017 555 7713"),
    ],
)
def test_disguises_are_mapped_back(kind, disguised, clear):
    for before, after in (("", ""), ("é said, ", ", end"), ("ⓐ ", "\nnext"), ("x" * 50 + "\n", " (ok)")):
        text = before + disguised + after
        plain = plain_spans(text)
        found = [(KINDS[k], text[a:b], value) for k, a, b, value in added_spans(text, plain)]
        assert found == [(kind, disguised, clear)], text


@pytest.mark.parametrize(
    "text",
    [
        "We met at noon. The dot on the map is red at the edge.", "look at example.com", "he was at home . No one came", "one, two and three", "two plus two is four",
        "un 9807915762804490 deux", "write to ann@example.com at once. Dot", "meet @ the.corner now", "the point at issue dot dot dot", "1.5 plus 2.5", "", " ", "pos[at] = f(a)[dot]",
    ],
)
def test_prose_is_left_alone(text):
    assert added_spans(text, plain_spans(text)) == []


def test_every_rewritten_place_has_a_source():
    text = "é one two at b dot c ​[at] 4I1 plus five dash x"
    new = Normalised(text)
    assert new.text.startswith("é 12") and "@" in new.text
    spans = [new.back(i, i + 1) for i in range(len(new.text))]
    assert all(0 <= a < b <= len(text) for a, b in spans) and [a for a, _ in spans] == sorted(a for a, _ in spans)


def test_marks_in_a_text_are_no_signs():
    assert plain_spans("ab.com 1234") == [] and added_spans("ab.com 1234", []) == []


def test_long_texts_take_linear_time():
    for part in ("a", "1", "1 ", "+1 ", "one ", " ", "at ", "a dot ", "@", "a@", "((", "O1", "1.", " . "):
        text = part * (200_000 // len(part))
        added_spans(text, plain_spans(text))


def test_rows(spark, awkward, awkward_rows, empty):
    got = personal_data(awkward).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((r[0] is None, r[0] or 0) for r in awkward_rows)
    assert all(r.spans == [] for r in got)
    assert personal_data(empty).count() == 0
    told = spark.createDataFrame([(1, "a@b.co or c at d dot com, 1.2.3.4"), (1, None), (None, "a@b.co")], "id long, body string")
    rows = {(r.doc_id, r.spans): r for r in span_digests(personal_data(told, "id", "body")).collect()}
    first = rows[1, "email:0:6,email:10:24,ip:26:33"]
    assert (first.n_email, first.n_ip, first.n_card, first.n_phone, first.n_added) == (2, 1, 0, 0, 1)
    assert first.base_sha256 == hashlib.sha256(b"email:0:6,ip:26:33").hexdigest()
    assert rows[1, ""].base_sha256 == hashlib.sha256(b"").hexdigest() and rows[None, "email:0:6"].n_email == 1


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = {r["doc_id"]: ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in brute(r["text"] or "")) for r in texts}
    got = op11_pii_deobfuscation(spark, sf).select("doc_id", "spans", F.col("base_sha256") == F.sha2("spans", 256)).collect()
    assert {r[0]: r[1] for r in got} == want and all(r[2] for r in got)
