"""Licence scan by canonical digest: normalise a whole text, then hash-join its digest to those of known licences.

All of it is DataFrame expressions. The canonical form follows the public SPDX matching guidelines in the points that a
digest can honour: case, punctuation, white space, list markers, copyright lines, equivalent spellings, titles. Known are
the short licences by their texts, here, and the long ones by the digests of their published texts. A line of a document
is a text too, so notices of one line are found by the same join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings that count as equal (from, to), on lower-cased words.
SPELLINGS = [
    ("acknowledgement", "acknowledgment"), ("analyse", "analyze"), ("artefact", "artifact"), ("authorisation", "authorization"), ("authorised", "authorized"),
    ("cancelled", "canceled"), ("catalogue", "catalog"), ("centre", "center"), ("favour", "favor"), ("fulfil", "fulfill"), ("fulfilment", "fulfillment"), ("honour", "honor"),
    ("https", "http"), ("judgement", "judgment"), ("labour", "labor"), ("licence", "license"), ("licenced", "licensed"), ("licences", "licenses"), ("organisation", "organization"),
    ("percent", "per cent"), ("programme", "program"), ("recognise", "recognize"), ("sublicence", "sublicense"), ("utilisation", "utilization"), ("whilst", "while"), ("wilful", "willful"),
]

# The same for pairs of words; after those above.
PAIRS = [("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"), ("sub license", "sublicense")]

# Whole licence texts, by SPDX identifier.
TEXTS = [
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("MIT-0", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n\n3. This notice may not be removed or altered from any source distribution."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Unlicense", "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <http://unlicense.org/>"),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:\n\nThe copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.\n\nDO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nTERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION\n\n0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
]

# Notices of one line, by SPDX identifier.
NOTICES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Licensed under CC0 1.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
]

# Titles that may stand above a text.
TITLES = [
    ("MIT", "MIT License"),
    ("MIT", "The MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("MIT-0", "MIT No Attribution"),
    ("ISC", "ISC License"),
    ("ISC", "The ISC License"),
    ("0BSD", "BSD Zero Clause License"),
    ("0BSD", "Zero-Clause BSD"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "The 2-Clause BSD License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "The 3-Clause BSD License"),
    ("BSD-3-Clause", "New BSD License"),
    ("Zlib", "zlib License"),
    ("Zlib", "The zlib/libpng License"),
    ("Unlicense", "The Unlicense"),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("WTFPL", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE\nVersion 2, December 2004"),
]

#: All texts that are known, each also under each of its titles.
KNOWN = TEXTS + NOTICES + [(i, f"{title}\n\n{text}") for i, text in TEXTS for j, title in TITLES if i == j]

# SHA-256 of the canonical forms of published texts, by SPDX identifier; of those with an appendix on how to
# apply the licence, also without it.
DIGESTS = [
    ("Apache-2.0", "af57b3d3af31b79b2ce0da0c77ced889558124d1a461fa355d3f8fe9e3cd1076"),
    ("Apache-2.0", "f51d0e1754d22b858f9b754494aa37a083a6b9b99ac4fd6aa2b46425d72413eb"),
    ("Apache-2.0", "d72ec85587a685fb57c1b3bad977a4f7823f4a45c8850dcd01c70922cead9a0c"),
    ("Artistic-1.0-Perl", "b06eda62b7e0c69e6f8a5960610095b69349654af941a79eca834edcd5e64e49"),
    ("CC0-1.0", "888ab175b43ed137ae3c3f8f32a1f0e1677fe31f7a9f09890c39b11b1934ad6c"),
    ("GFDL-1.2", "7bd3a9b625b0b9c72d575e34948a31aa1d9a92600e54323c0abd84a9844ce82d"),
    ("GFDL-1.3", "3e03599855be6f5154c1bba1c4189768a3518f5863527559438fa78fa2262af5"),
    ("GPL-1.0", "ac910954c3184907f3947de0193b0169b8c69656ff2de7f3330438f6ba4fb746"),
    ("GPL-1.0", "0460830f1601ab5f615dd93818221b48820590af661686bdf540c70fe3d696a4"),
    ("GPL-1.0", "e865a0dda2da3969652b87fd53fdbacbc9c971447325f465df48971826e5f97c"),
    ("GPL-2.0", "2e8e378a3d24393c0f3fd1439ffbe84e750886c09715e622426a6a0e54fa1bee"),
    ("GPL-2.0", "80edaf5771a2ca5e7df6a5c023beb15391e60cf1bbae81a82600bb184fecef39"),
    ("GPL-2.0", "724499132592c4e4c95c8d0a0a79e0045822f797839536a7338312694e3341bc"),
    ("GPL-3.0", "3695e90f7fe4b461853cec533de5675ab2b6b1fcafcb504d6c64ded76f675d64"),
    ("GPL-3.0", "8c24ccf35998bd73317aa0801f6e6cbd865514baf55f246a48a8e890d1abc3d1"),
    ("GPL-3.0", "a7d16b580457c566303df373fd362c5bfbfbc013734bed4e4cf732a569a5598e"),
    ("LGPL-2.0", "4a1b1cb15d45262f049457ae26945909d0e5af93e2e3fb5de82c9f72ac6bebe2"),
    ("LGPL-2.0", "2894b2cb46a2c83844eec54a57337498c55bc0779fe2dbdd14bc94a567a3c32e"),
    ("LGPL-2.0", "9445838f80c534db1f71155f4c93f1464bf680d2a091792f3f2146f5cefef806"),
    ("LGPL-2.1", "f2755dc4b609b314faab32d30ca6d0466b60adc931cece2ea4f0b61f483bfc98"),
    ("LGPL-2.1", "303c35384a2d8ff561e8480f4d8bc87bd79ea2d92d62ba0b24d22e2c1f88f1e3"),
    ("LGPL-2.1", "70a277553f5f0e974016dfc6aed9adda07c554792c5f1f3d75acb63053de3f89"),
    ("LGPL-3.0", "cb8c0f424bdd5c42a0b18285893829d988e9fb9a00d0cd604a59ebe8da7eeb45"),
    ("MPL-1.1", "7bc8199bca0039e12f8f05dc5dd19d02da70b9ca410525438466f2b7903bff8a"),
    ("MPL-2.0", "3396674f524513dd89f0361b5650798a6dbfd04c9a0ee01e739472f2397cc3b0"),
]

#: A line that states a copyright (by its sign, a year or a placeholder; not one that speaks of a "copyright notice"), or a
#: list marker at the start of a line.
LINE_HEAD = (
    r"^[^a-z0-9\n©(]*(?:(?:copyright[ \t]*(?:\(c\)|©|[0-9]{4}|by[ \t]|[<\[{])|©|\(c\)[ \t]*[0-9]{4})[^\n]*$|all rights reserved[^a-z0-9\n]*$|\(?(?:[0-9]{1,2}|[a-z])[.)][ \t])"
)
#: Characters of a line that are not of a word; each run becomes two blanks, one for the word on either side.
NOT_WORD = r"[^\p{L}\p{N}\n]+"


def _replace(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Words (with a blank of their own on either side) by their equivalents."""
    for old, new in pairs:
        text = F.replace(text, F.lit(f" {old.replace(' ', '  ')} "), F.lit(f" {new.replace(' ', '  ')} "))
    return text


def canonical_lines(text: Column) -> Column:
    """The canonical words of each line, lines kept apart by line ends: for `lines_of` and `whole_of`."""
    out = F.regexp_replace(F.lower(text), "(?dm)" + LINE_HEAD, " ")
    out = F.replace(F.regexp_replace(out, NOT_WORD, "  "), F.lit("\n"), F.lit(" \n "))
    return _replace(F.concat(F.lit(" "), out, F.lit(" ")), SPELLINGS)


def whole_of(lines: Column) -> Column:
    return F.trim(F.replace(_replace(F.regexp_replace(lines, "[ \n]+", "  "), PAIRS), F.lit("  "), F.lit(" ")))


def lines_of(lines: Column) -> Column:
    """Lines with words, each as if it were a text of its own."""
    one = lambda x: F.trim(F.replace(_replace(F.concat(F.lit(" "), F.trim(x), F.lit(" ")), PAIRS), F.lit("  "), F.lit(" ")))
    return F.transform(F.split(lines, "\n"), one)


def canonical(text: Column | str) -> Column:
    """Lower case, copyright lines and list markers out, punctuation and white space as single blanks, spellings made equal."""
    return whole_of(canonical_lines(F.col(text) if isinstance(text, str) else text))


def known_licences(spark: SparkSession, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> DataFrame:
    """(digest, licence): a row per distinct canonical text; as many as the fixed lists have."""
    rows = spark.createDataFrame(known, "licence string, text string").select(F.sha2(canonical("text"), 256).alias("digest"), "licence")
    if digests:
        rows = rows.unionByName(spark.createDataFrame(digests, "licence string, digest string"))
    return rows.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan_licences(docs: DataFrame, known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, canonical_sha256, licence, notices, n_notice_lines.

    ``licence`` is that of the known text to which the whole text is canonically equal, else null. Each line of the text
    is a whole text too: ``notices`` lists, sorted and separated by commas, the licences of the lines that are known
    ('' if none), ``n_notice_lines`` counts these lines. Null texts count as empty and match nothing; rows that
    repeat a doc_id are all returned, each with its own result; a null doc_id is carried through; other columns are not
    read. ``known`` and ``digests`` are lists of stated size; their digests, a row each, are broadcast.
    """
    table = known_licences(docs.sparkSession, known, digests)
    base = docs.select(F.col(id_col).alias("doc_id"), canonical_lines(F.coalesce(F.col(text_col), F.lit(""))).alias("words"))
    lines = F.filter(lines_of(F.col("words")), lambda x: x != "")
    item = lambda x, line: F.struct(F.sha2(x, 256).alias("digest"), F.lit(line).alias("line"))
    items = F.concat(F.array(item(whole_of(F.col("words")), False)), F.transform(lines, lambda x: item(x, True)))
    # the rows of a document lie together, so the aggregation is done before its exchange
    rows = base.withColumn("row", F.monotonically_increasing_id()).select("row", "doc_id", F.inline(items))
    found = rows.join(F.broadcast(table), "digest", "left")
    hit = F.col("line") & F.col("licence").isNotNull()
    out = found.groupBy("row", "doc_id").agg(
        F.max(F.when(~F.col("line"), F.col("digest"))).alias("canonical_sha256"), F.max(F.when(~F.col("line"), F.col("licence"))).alias("licence"),
        F.array_join(F.sort_array(F.collect_set(F.when(hit, F.col("licence")))), ",").alias("notices"), F.count_if(hit).cast("int").alias("n_notice_lines"),
    )
    return out.drop("row")


def oracle_sql(known: list[tuple[str, str]] = KNOWN, digests: list[tuple[str, str]] = DIGESTS) -> str:
    """The same result as DuckDB SQL, word by word: lists of words, looked up in a map of spellings."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = lambda rows: ", ".join(f"({quote(a)}, {quote(b)})" for a, b in rows)
    words = "map {" + ", ".join(f"{quote(a)}: {quote(b)}" for a, b in SPELLINGS) + "}"
    pairs = "map {" + ", ".join(f"{quote(a)}: {quote(b)}" for a, b in PAIRS) + "}"

    def canon(text: str) -> str:
        tidy = f"regexp_replace(lower({text}), {quote('(?m)' + LINE_HEAD)}, ' ', 'g')"
        single = f"list_filter(string_split(array_to_string(list_transform(regexp_extract_all({tidy}, '[\\p{{L}}\\p{{N}}]+'), lambda w: coalesce({words}[w], w)), ' '), ' '), lambda w: w <> '')"
        return f"(WITH l AS (SELECT {single} AS w) SELECT array_to_string(list_filter(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN i > 1 AND {pairs}[concat(w[i - 1], ' ', w[i])] IS NOT NULL THEN '' ELSE coalesce({pairs}[concat(w[i], ' ', w[i + 1])], w[i]) END), lambda x: x <> ''), ' ') FROM l)"

    return f"""
WITH texts(licence, body) AS (VALUES {values(known)}),
known AS (SELECT digest, min(licence) AS licence FROM (SELECT sha256({canon("body")}) AS digest, licence FROM texts {"UNION ALL SELECT digest, licence FROM (VALUES " + values(digests) + ") t(licence, digest)" if digests else ""}) u GROUP BY 1),
docs AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS body FROM documents),
lines AS (SELECT row_id, unnest(string_split(body, chr(10))) AS line FROM docs),
found AS (SELECT row_id, string_agg(DISTINCT licence, ',' ORDER BY licence) AS notices, count(*) AS n
          FROM (SELECT row_id, sha256({canon("line")}) AS digest FROM lines) JOIN known USING (digest) GROUP BY 1),
whole AS (SELECT row_id, doc_id, sha256({canon("body")}) AS digest FROM docs)
SELECT doc_id, digest AS canonical_sha256, licence, coalesce(notices, '') AS notices, CAST(coalesce(n, 0) AS INT) AS n_notice_lines
FROM whole LEFT JOIN known USING (digest) LEFT JOIN found USING (row_id)"""
