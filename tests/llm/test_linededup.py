"""Line dedup against a plain version, on odd rows and on the sample table."""

import hashlib
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.llm import linededup, queries
from tests.oracle import compare

LONG = "This very line stands in a great many documents, whatever they are."
SCHEMA = "doc_id long, text string, pos int, places string, line string, t1 int, last long"


def plain(rows, min_chars=40, min_docs=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    last = {k: max(-(10**9) if d is None else d for d in held) for k, held in holders.items() if len(held) >= min_docs}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **how):
    docs = spark.createDataFrame([(*r, 1, "x", "y", 2, 3) for r in rows], SCHEMA)
    got = linededup.drop_lines(docs, **how).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256))
    return sorted((tuple(r) for r in got.collect()), key=repr)


ROWS = [
    *((i, f"own line {i}\n{LONG}\n\t {LONG.upper()} \r\nend") for i in range(7)),
    (6, f"another text of the last id\n{LONG}"),
    (None, LONG), (None, f"{LONG}\n{LONG}"), (7, None), (8, ""), (9, "\n\n"), (3, f"{LONG}\n{LONG}"), (3, f"{LONG}\n{LONG}"),
    (10, "é" * 39), (11, "É" * 40 + "\n" + LONG[:39]), (2, "É" * 40), (1, "É" * 40), (0, "É" * 40), (5, "É" * 40), (4, "é" * 40),
    (12, "\n".join(f"{i} {LONG}" for i in range(5000))), *((i, f"7 {LONG}") for i in range(4)),
]


def test_equals_plain_version(spark):
    got = found(spark, ROWS)
    assert got == plain(ROWS)
    assert any(n for _, _, n, _ in got)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 6), st.lists(st.sampled_from(["a", "B", " b\t", "", "ab", "c\r"]), max_size=6).map("\n".join)), max_size=12))
def test_any_rows(spark, rows):
    assert found(spark, rows, min_chars=1, min_docs=2) == plain(rows, 1, 2)


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_nothing_to_drop(spark, rows):
    assert found(spark, rows) == plain(rows)


def test_query_equals_its_sql(spark, sf):
    compare(spark, sf, queries.QUERIES["op13_line_dedup"], queries.ORACLE_SQL["op13_line_dedup"])
