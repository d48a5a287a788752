"""Outputs: response rows, event-stream frames, log lines, stored images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frames import one_each
from ..functions import privacy

CONTENT_TYPES = {"html": "text/html; charset=utf-8", "text": "text/plain; charset=utf-8", "json": "application/json; charset=utf-8"}


def response(kind: Column, content: Column, method: Column, cached: Column, fallbacks: Column) -> Column:
    """struct(body, meta): the content and the headers that describe it."""
    content_type = F.lit("text/markdown; charset=utf-8")
    for name, value in CONTENT_TYPES.items():
        content_type = F.when(kind == name, value).otherwise(content_type)
    meta = F.create_map(F.lit("Content-Type"), content_type, F.lit("X-Markdown-Method"), method, F.lit("X-Cache-Status"), F.when(cached, "HIT").otherwise("MISS"), F.lit("X-Markdown-Fallbacks"), F.array_join(fallbacks, ","))
    return F.struct(content.alias("body"), F.map_filter(meta, lambda _, v: v != "").alias("meta"))


def event_frame(name: Column, data: Column) -> Column:
    """One server-sent event."""
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), F.to_json(data), F.lit("\n\n"))


def log_lines(rows: DataFrame, event: str) -> DataFrame:
    """Rows as JSON log lines."""
    return rows.select(F.to_json(F.struct(F.lit(event).alias("event"), *rows.columns)).alias("value"))


def stored_images(images: DataFrame, *owner: str) -> DataFrame:
    """(key, content_type, data) of images (url, content_type, data), one row a key; with columns ``owner``, of each owner one."""
    return one_each(images.select(*owner, privacy.image_key(F.col("url"), F.col("content_type")).alias("key"), "content_type", "data"), *owner, "key")


def images_by_key(requests: DataFrame, store: DataFrame, *owner: str) -> DataFrame:
    """Requests (key[, *owner]) with their image; a missing type is PNG."""
    return requests.join(store, [*owner, "key"], "left").withColumn("content_type", F.when(F.col("data").isNotNull(), F.coalesce("content_type", F.lit("image/png"))))
