"""The news view: articles derived from the documents table, the same in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-02-01 00:00:00"
#: Headline fragments; an article's is chosen by doc_id.
FRAGMENTS = (
    "Oil prices surge due to supply disruption in Hormuz", "India central bank warns of inflation risk amid default concerns", "Chip maker unveils software platform after merger",
    "Russia sanctions trigger grain shortage across Europe", "Growth momentum sparks retail demand in Japan", "Defense ministry reports missile threat near Red Sea",
    "Hospital operator faces fraud crisis following regulation reform", "Factory output decline fuels recession warning in Germany", "UN calls for ceasefire because of border conflict in Gaza",
    "Port construction leads to expansion of trade for Egypt", "Oil prices surge due to supply disruption in Hormuz", "Bank merger could benefit fintech startup",
)


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    head = F.element_at(F.array(*map(F.lit, FRAGMENTS)), (F.col("doc_id") % len(FRAGMENTS) + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    published = F.timestamp_seconds(F.lit(1704067200) + (F.col("doc_id") % 720) * 3600)
    return docs.select(
        F.col("doc_id").alias("id"), F.concat(head, F.lit(" "), F.substring(text, 1, 80)).alias("title"), text.alias("content"), "source", F.lit(None).cast("string").alias("url"),
        F.when(F.col("doc_id") % 50 != 0, published).alias("published_at"), F.timestamp_seconds(F.lit(1706745600) + F.col("doc_id")).alias("created_at"),
    )


NEWS_SQL = f"""news AS (SELECT doc_id AS id, ([{', '.join(f"'{x}'" for x in FRAGMENTS)}])[doc_id % {len(FRAGMENTS)} + 1] || ' ' || substr(coalesce(text, ''), 1, 80) AS title,
  coalesce(text, '') AS content, source, CASE WHEN doc_id % 50 <> 0 THEN make_timestamp(1704067200000000 + (doc_id % 720) * 3600000000) END AS published_at,
  make_timestamp(1706745600000000 + doc_id * 1000000) AS created_at FROM documents)"""
