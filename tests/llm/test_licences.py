import os
import textwrap

import duckdb
import pytest
from pyspark.sql import functions as F

from framewarden.llm.licences import DIGESTS, TEXTS, canonical, oracle_sql, scan_licences

SCHEMA = "doc_id long, text string, digest string, licence string, words string, line int, row long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", 1, 2) for r in rows], SCHEMA).repartition(2)


def variants(text):
    """A licence text as it is found: wrapped, spelt, marked and decorated otherwise."""
    wrapped = "\n\n".join(textwrap.fill(p, 72) for p in text.split("\n\n"))
    yield wrapped
    yield "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + text.upper().replace(" ", "  ")
    yield "/*\n * Copyright 1999-2004 The Authors <a@b.c>\n *\n" + "\n".join(" * " + x for x in wrapped.split("\n")) + "\n */"
    yield "\n".join(textwrap.fill(p, 50) for p in text.split("\n\n")).replace('"', "''").replace(" license", " licence").replace("\n", "\r\n")
    yield text.replace("1. ", "* ").replace("2. ", "* ").replace("3. ", "* ").replace("0. ", "  ")


def test_whole_texts_as_they_are_found(spark):
    rows, want = [], {}
    for licence, text in TEXTS:
        for v in variants(text):
            rows.append((len(rows), v))
            want[len(rows) - 1] = licence
        rows.append((len(rows), text + " and more"))
        want[len(rows) - 1] = None
    rows += [(9000, "The MIT License (MIT)\n\nCopyright (c) <year> <copyright holders>\n\n" + TEXTS[0][1])]
    want[9000] = "MIT"
    got = {r.doc_id: r.licence for r in scan_licences(frame(spark, rows)).collect()}
    assert got == want


def test_published_files(spark):
    """The files that Debian ships, whole and without their appendix."""
    found = [(n, f"/usr/share/common-licenses/{f}") for n, f in enumerate(("Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "MPL-2.0", "CC0-1.0")) if os.path.exists(f"/usr/share/common-licenses/{f}")]
    if not found:
        pytest.skip("no licence files here")
    rows = [(n, open(f).read()) for n, f in found]
    got = {r.doc_id: r.licence for r in scan_licences(frame(spark, rows)).collect()}
    names = ["Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"]
    assert got == {n: names[n] for n, _ in found}
    assert len({d for _, d in DIGESTS}) == len(DIGESTS)


LINES = [
    (1, "prose\nLicensed under the Apache Licence, Version 2.0.\nReleased under the MIT License.\nmore"), (2, None), (3, ""), (4, "Licensed under the Apache License, Version 2.0."), (None, "Licensed under CC0 1.0."), (4, "Licensed under the Apache License, Version 2.0."),
    (5, "licence licence licence per cent per cent percent sub-licence sub licence non-commercial non commercial"), (6, "Copyright notice and this\ncopyright holders text\ncopyright (c) 2000 gone\n(c) 1999 gone\n(c) stays\nAll rights reserved.\n1. one\n(b) two\n12) three"),
    (7, "\n\n \n"), (8, "a\rb\r\nCopyright 2020 x\r\nc"), (9, "word " * 30_000), (10, "licence\n" * 3000), (11, "per\ncent copyright\nowner non\ncommercial sub license license sub license"),
]


def test_lines_and_edges(spark):
    got = {r.doc_id: (r.licence, r.notices, r.n_notice_lines) for r in scan_licences(frame(spark, LINES)).collect()}
    assert got[1] == (None, "Apache-2.0,MIT", 2) and got[2] == got[3] == got[7] == (None, "", 0)
    assert got[4] == ("Apache-2.0", "Apache-2.0", 1) and got[None] == ("CC0-1.0", "CC0-1.0", 1)
    assert scan_licences(frame(spark, LINES)).count() == len(LINES)


def test_canonical_form_is_stable(spark):
    df = frame(spark, LINES + [(100 + n, t) for n, (_, t) in enumerate(TEXTS)]).select("text", canonical(F.col("text")).alias("a")).where("text is not null")
    # list markers aside, nothing changes a second time
    assert df.select("a", canonical("a").alias("b")).where("a <> b and not a rlike '^([a-z]|[0-9]{1,2}) '").count() == 0
    got = {r.text: r.a for r in df.collect()}
    assert got[LINES[6][1]] == "license license license per cent per cent per cent sublicense sublicense noncommercial noncommercial"
    assert got[LINES[7][1]] == "copyright notice and this copyright holders text stays one two three"


def test_equals_the_sql(spark, awkward):
    rows = [(r[0], r[1]) for r in awkward.select("doc_id", "text").collect() if r[1] is None or r[1].isascii()] + LINES + [(50 + n, v) for n, (_, t) in enumerate(TEXTS) for v in variants(t)]
    df = frame(spark, rows)
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = con.execute(oracle_sql()).fetchall()
    got = [tuple(r) for r in scan_licences(df).collect()]
    clean = lambda rows: sorted([tuple(None if x != x else x for x in r) for r in rows], key=repr)
    assert clean(got) == clean([(None if r[0] is None or r[0] != r[0] else int(r[0]), *r[1:]) for r in want])


def test_empty(empty):
    assert scan_licences(empty).count() == 0
