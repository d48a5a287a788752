"""Lines that many documents share are dropped, in DataFrame functions only.

Lines are exploded and normalised, each long one becomes a 128-bit hash, documents
are counted per hash, and lines whose hash too many documents hold leave all but the
last of them; what stays is put together by position. Only hashes and places are
exchanged before the last step: occurrences are written once, a hash is counted from
its distinct (hash, document) pairs, which Spark adds up in each task before they are
sent, and a text meets its dropped places (an ascending list, one row a text) in a
join that Spark broadcasts or shuffles by the written size of that list.

Defined results: a null or empty text is one empty line; a document is its doc_id, so
repeated rows count once and lose the same lines, each in its own row; null ids are
one document, lesser than any other, and lose their shared lines; a text of which
every line goes is empty; an empty table gives no rows; other columns are ignored,
whatever their names; texts and lines of any length are read whole. Rows are told
apart by id and a 128-bit hash of the text, so equal rows are one and no row is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, texts

#: A key of fewer code points is never dropped.
MIN_CHARS = 40
#: Documents that must hold a key before its lines go.
MIN_DOCS = 5
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _hashes(text: Column, names: tuple[str, str]) -> list[Column]:
    """128 bits of a text: two hashes, the second from another seed."""
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit(1), text).alias(names[1])]


def _lines(text: str | Column) -> Column:
    return F.split(text, "\n")


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, t1, t2, pos, h1, h2) of every line whose key is long enough."""
    named = texts(docs).select("doc_id", "text", *_hashes(F.col("text"), ("t1", "t2")))
    lines = named.select("doc_id", "t1", "t2", F.posexplode(_lines("text")).alias("pos", "line"))
    keys = lines.select("doc_id", "t1", "t2", "pos", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= min_chars)
    return keys.select("doc_id", "t1", "t2", "pos", *_hashes(F.col("key"), ("h1", "h2")))


def shared_keys(found: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, last): hashes held by ``min_docs`` documents or more, and the largest doc_id that holds each."""
    pairs = found.select("h1", "h2", "doc_id").distinct()
    counted = pairs.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last"))
    return counted.where(F.col("n_docs") >= min_docs).select("h1", "h2", "last")


def dropped_places(found: DataFrame, shared: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, places): where each text loses lines, ascending."""
    hits = found.join(shared, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("last")))
    return hits.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("places"))


def without(text: Column, places: Column) -> Column:
    """``text`` without its lines at ``places``: the runs between them, in a row."""
    bounds = F.concat(F.array(F.lit(-1)), places, F.array(F.size(_lines(text))))

    def kept(x: Column) -> Column:
        run = lambda k: F.slice(x["lines"], x["bounds"][k] + 2, x["bounds"][k + 1] - x["bounds"][k] - 1)
        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(x["bounds"]) - 2), run)), "\n")

    once = F.array(F.struct(_lines(text).alias("lines"), bounds.alias("bounds")))  # both are worked out once a text
    return F.get(F.transform(once, kept), 0)


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text without its shared lines, n_lines before and n_dropped, a row for each row of ``docs``."""
    found = durable(occurrences(docs, min_chars))
    lost = durable(dropped_places(found, durable(shared_keys(found, min_docs))))
    own = texts(docs).select("doc_id", "text", *_hashes(F.col("text"), ("t1", "t2"))).alias("own")
    lost = lost.alias("lost")
    same = F.col("own.doc_id").eqNullSafe(F.col("lost.doc_id")) & (F.col("own.t1") == F.col("lost.t1")) & (F.col("own.t2") == F.col("lost.t2"))
    text, places = F.col("own.text"), F.col("lost.places")
    return own.join(lost, same, "left").select(
        F.col("own.doc_id").alias("doc_id"),
        F.when(places.isNull(), text).otherwise(without(text, places)).alias("text"),
        F.size(_lines(text)).cast("long").alias("n_lines"),
        F.coalesce(F.size(places), F.lit(0)).cast("long").alias("n_dropped"),
    )


def line_dedup_sql() -> str:
    """The same for DuckDB, with production parameters and a digest of each kept text."""
    return """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, str_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM docs),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
),
shared AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT r, k.doc_id, pos, line, s.key IS NOT NULL AND k.doc_id IS DISTINCT FROM s.last AS gone FROM keyed k LEFT JOIN shared s ON k.key = s.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r
"""
