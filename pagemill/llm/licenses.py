"""Licence scan by canonical digests, in DataFrame functions only.

A text is brought to a canonical form (case, copyright lines, punctuation and white
space, equivalent spellings) and its SHA-256 is joined to the digests of known
licences: an entire text that is a licence, however it is typeset, is found by one
hash lookup. The same digests of single lines find licence notices inside documents.

Defined results: a null text is empty and matches nothing; repeated rows each get a
row; an empty table gives no rows; other columns are ignored. A known text listed
twice under two names matches under the lesser name.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_digests import DIGESTS

# --- fixed values: notices and short licence texts, as published -----------------
NOTICES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Licensed under CC0 1.0.", "This work is dedicated to the public domain under CC0 1.0 Universal."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."""
_ISC_END = """THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_1 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
_BSD_3 = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
_BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEXTS = {
    "MIT": [_MIT, "MIT License\n" + _MIT, "The MIT License\n" + _MIT, "The MIT License (MIT)\n" + _MIT],
    "ISC": [_ISC + "\n" + _ISC_END, "ISC License\n" + _ISC + "\n" + _ISC_END],
    "0BSD": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n" + _ISC_END],
    "BSD-2-Clause": [_BSD_1 + "\n" + _BSD_END, "BSD 2-Clause License\n" + _BSD_1 + "\n" + _BSD_END],
    "BSD-3-Clause": ["\n".join(x) for x in ((_BSD_1, _BSD_3, _BSD_END), ("BSD 3-Clause License", _BSD_1, _BSD_3, _BSD_END))],
}
#: Spellings taken as equal, after punctuation has gone.
SPELLINGS = {
    "licence": "license",
    "sub license": "sublicense",
    "non infringement": "noninfringement",
    "favour": "favor",
    "honour": "honor",
    "organisation": "organization",
    "authorisation": "authorization",
    "merchantibility": "merchantability",
    "copyright owner": "copyright holder",
}
# ----------------------------------------------------------------------------------
#: A line that names a year or a mark of copyright; "copyright notice" in a sentence is none.
COPYRIGHT = r"(^|\n)[ \t*#/]*(?:copyright[ \t]+(?:\(c\)|©|[0-9<{\[])|\(c\)|©|all rights reserved)[^\n]*"
#: Any other line that starts as a copyright statement; a wrapped sentence that goes on so is none.
STATEMENT = r"(^|\n)[ \t*#/]*copyright(?![a-z])(?![ \t]+(?:notices?|holders?|owners?|laws?|licen[cs]e[sd]?|interest|disclaimer|and|or|the|treaty|rights?|protection|permission|statements?|on|in|is|as|to|of|for|if|that|this|with|works?|status|act|infringement|material)(?![a-z]))[^\n]*"
PUNCTUATION = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F«»‘’“”„–—©•]+"


def canonical_text(text: str) -> str:
    """The canonical form of one text, for the fixed tables."""
    s = re.sub(PUNCTUATION, " ", re.sub(COPYRIGHT, r"\1", text.lower()))
    for a, b in SPELLINGS.items():
        s = s.replace(a, b)
    return s.strip(" ")


def canonical(text: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, "$1"), PUNCTUATION, " ")
    for a, b in SPELLINGS.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.trim(s)


def digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def bare(text: Column) -> Column:
    """A text without any line that starts as a copyright statement."""
    return F.regexp_replace(F.lower(text), STATEMENT, "$1")


def bare_text(text: str) -> str:
    return re.sub(STATEMENT, r"\1", text.lower())


def canonical_sql(text: str) -> str:
    """``canonical`` as a DuckDB expression."""
    s = f"regexp_replace(regexp_replace(lower({text}), '{COPYRIGHT}', '\\1', 'g'), '{PUNCTUATION}', ' ', 'g')"
    for a, b in SPELLINGS.items():
        s = f"replace({s}, '{a}', '{b}')"
    return f"trim({s}, ' ')"


def known_digests() -> dict[str, str]:
    """Digest to licence of the fixed tables, full texts and notices."""
    out: dict[str, str] = {}
    for source in (TEXTS, NOTICES):
        for name, forms in source.items():
            for form in forms:
                key = hashlib.sha256(canonical_text(form).encode()).hexdigest()
                out[key] = min(name, out.get(key, name))
    return out


def whole_digests() -> dict[str, str]:
    """Digest to licence of all that an entire text can be: the fixed tables, with and without copyright statements, and the long licences."""
    out = known_digests()
    for name, key in [(n, hashlib.sha256(canonical_text(bare_text(f)).encode()).hexdigest()) for n, forms in TEXTS.items() for f in forms]:
        out[key] = min(name, out.get(key, name))
    for name, keys in DIGESTS.items():
        for key in keys:
            out[key] = min(name, out.get(key, name))
    return out


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, digest, license_id and notice_ids of every row of ``docs``.

    ``license_id`` is the licence that the entire text is, by a hash join on digests, of
    the text or else of what is left without copyright statements of any form;
    ``notice_ids`` the sorted licences, comma-joined, that whole lines state.
    The fixed digests are looked up in a literal map, so nothing is exchanged for them.
    ``known`` (license_id, text) adds licences; that join's strategy is Spark's choice by
    their measured size.
    """
    as_map = lambda found: F.create_map(*(F.lit(x) for pair in sorted(found.items()) for x in pair))
    lookup, whole = as_map(known_digests()), as_map(whole_digests())
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.lower(x).rlike("licen[cs]e|dedicated to the public domain"))
    stated = F.array_compact(F.transform(lines, lambda x: lookup[digest(x)]))
    stripped = F.when(F.lower(text).rlike(STATEMENT), digest(bare(text)))
    made = docs.select("doc_id", digest(text).alias("digest"), stripped.alias("stripped"), F.array_join(F.array_sort(F.array_distinct(stated)), ",").alias("notice_ids"))
    first, second = whole[F.col("digest")], whole[F.col("stripped")]
    if known is None:
        return made.select("doc_id", "digest", F.coalesce(first, second).alias("license_id"), "notice_ids")
    own = F.coalesce("text", F.lit(""))
    table = known.select(F.explode(F.array(digest(own), digest(bare(own)))).alias("known"), "license_id").groupBy("known").agg(F.min("license_id").alias("license_id"))
    again = table.select(F.col("known").alias("bare"), F.col("license_id").alias("bare_id"))
    found = made.join(table, made.digest == table.known, "left").join(again, F.col("stripped") == F.col("bare"), "left")
    # of licences of one digest the least; the text itself comes before what is left of it
    return found.select("doc_id", "digest", F.coalesce(F.least("license_id", first), F.least("bare_id", second)).alias("license_id"), "notice_ids")


def scan_sql() -> str:
    """``scan`` of the whole table ``documents`` in DuckDB."""
    values = ", ".join(f"('{d}', '{n}')" for d, n in sorted(known_digests().items()))
    return f"""
WITH known(known, license_id) AS (VALUES {values}),
lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
stated AS (SELECT l.doc_id, string_agg(DISTINCT k.license_id, ',' ORDER BY k.license_id) AS ids
  FROM lines l JOIN known k ON sha256({canonical_sql("l.line")}) = k.known
  WHERE regexp_matches(lower(l.line), 'licen[cs]e|dedicated to the public domain') GROUP BY l.doc_id),
made AS (SELECT doc_id, sha256({canonical_sql("coalesce(text, '')")}) AS digest FROM documents)
SELECT m.doc_id, m.digest, k.license_id, coalesce(s.ids, '') AS notice_ids
FROM made m LEFT JOIN known k ON m.digest = k.known LEFT JOIN stated s ON m.doc_id = s.doc_id"""
