"""Feed dumps in files: RSS items and Atom entries as article rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import source_of

ITEM = "title string, description string, link string, pubDate string"
ENTRY = "title string, summary string, content string, link string, published string"


def feed_time(text: Column) -> Column:
    """RSS dates with zone names or offsets, and ISO times; null where none fits."""
    bare = F.regexp_replace(F.trim(text), r"^\w+, *", "")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss zzz")), F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss xx")), F.try_to_timestamp(F.trim(text)))


def read_feed(spark: SparkSession, path: str, feed_url: str, row_tag: str = "item") -> DataFrame:
    """(title, content, source, url, published_at); entries without title or content are left out, broken ones too."""
    rows = spark.read.format("xml").option("rowTag", row_tag).option("mode", "DROPMALFORMED").schema(ITEM if row_tag == "item" else ENTRY).load(path)
    body, at = ("description", "pubDate") if row_tag == "item" else (F.coalesce("summary", "content"), "published")
    body = F.col(body) if isinstance(body, str) else body
    out = rows.select(F.trim("title").alias("title"), F.trim(body).alias("content"), source_of(F.lit(feed_url)).alias("source"), F.nullif(F.trim("link"), F.lit("")).alias("url"), feed_time(F.col(at)).alias("published_at"))
    return out.where("title <> '' and content <> ''")
