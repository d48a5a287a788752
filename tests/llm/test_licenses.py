from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from pagemill.llm import licenses


def test_equals_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(duckdb.sql(licenses.scan_sql()).fetchall())
    rows = licenses.scan(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "digest", "license_id", "notice_ids").collect()
    assert sorted(map(tuple, rows)) == want
    assert any(r.notice_ids for r in rows)


def test_forms_of_a_licence(spark):
    mit = licenses.TEXTS["MIT"][0]
    odd = "The MIT Licence\n\nCopyright (c) 2019 A. Person\n© 2020 Another\n\n" + mit.replace(", ", " ,\n   ").replace('"', "“").replace("sublicense", "sub-licence").upper()
    rows = [(1, mit, 0), (2, odd, 0), (2, odd, 0), (3, mit + " More.", 0), (4, None, 0), (5, "", 0), (None, "MIT License.\nReleased under the MIT License", 0), (7, "own terms", 0), (8, "x " * 90000 + "\nLicensed under CC BY-NC 4.0.", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    got = sorted((r.doc_id or 0, r.license_id, r.notice_ids) for r in licenses.scan(df).collect())
    assert got == [(0, None, "MIT"), (1, "MIT", ""), (2, "MIT", ""), (2, "MIT", ""), (3, None, ""), (4, None, ""), (5, None, ""), (7, None, ""), (8, None, "CC-BY-NC-4.0")]
    own = spark.createDataFrame([("Own", "Own terms."), ("Also", "OWN TERMS")], "license_id string, text string")
    assert {r.doc_id: r.license_id for r in licenses.scan(df, own).where("doc_id = 7").collect()} == {7: "Also"}
    assert licenses.scan(df.limit(0)).collect() == []


@pytest.mark.parametrize("text", ["A\tB  c", "Copyright 2020 X\nCopyright notice stays\nall rights reserved.\nyes", "l’été — Licence", "é*è"])
def test_one_canonical_form(spark, text):
    df = spark.createDataFrame([(text,)], "text string")
    assert df.select(licenses.canonical(F.col("text"))).first()[0] == licenses.canonical_text(text)
    assert duckdb.execute(f"SELECT {licenses.canonical_sql('t')} FROM (SELECT ? AS t)", [text]).fetchone()[0] == licenses.canonical_text(text)


def test_copyright_heads_and_long_licences(spark):
    """Whole licences under any form of copyright line, and the long ones by their digests."""
    mit = licenses.TEXTS["MIT"][0]
    heads = ["Copyright Foo contributors", "Copyright: 2020 X", "Copyright by X", " * Copyright, the Foo team"]
    rows = [(i, f"MIT License\n\n{h}\n\n{mit}") for i, h in enumerate(heads)]
    rows += [(10, "Copyright Foo\n" + mit.replace("above copyright", "above\ncopyright")), (11, "Copyright Foo\nmore terms\n" + mit)]
    free = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.\n\nIn jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.\n\nFor more information, please refer to <https://unlicense.org/>"
    rows.append((12, free))
    got = {r.doc_id: r.license_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: "MIT", 1: "MIT", 2: "MIT", 3: "MIT", 10: "MIT", 11: None, 12: "Unlicense"}
    common = Path("/usr/share/common-licenses")
    names = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    assert set(names.values()) <= set(licenses.DIGESTS)
    long = [(i, f"Copyright Foo contributors\n\n{(common / n).read_text()}", names[n]) for i, n in enumerate(names) if (common / n).exists()]
    df = spark.createDataFrame(long, "doc_id long, text string, want string")
    assert all(r.license_id == r.want for r in licenses.scan(df).join(df, "doc_id").collect())
