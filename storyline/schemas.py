"""Declared schemas of the nine tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TABLES = {
    "raw_news": "id long, unique_id string, title string, content string, source string, url string, published_at timestamp, created_at timestamp",
    "cleaned_news": "id long, raw_news_id long, cleaned_text string, normalized_text string, language string, created_at timestamp",
    "event_clusters": "id long, cluster_key string, main_topic string, created_at timestamp",
    "cluster_news_map": "id long, cluster_id long, cleaned_news_id long",
    "nodes": "id long, cluster_id long, entity string, entity_type string, event_type string, description string, timestamp timestamp, impact_type string, confidence_score double, is_anchor boolean, created_at timestamp",
    "edges": "id long, from_node_id long, to_node_id long, relation_type string, confidence_score double, created_at timestamp",
    "timeline": "id long, node_id long, position_index int, timeline_group_id string, created_at timestamp",
    "impact": "id long, node_id long, short_term_winners array<string>, short_term_losers array<string>, long_term_winners array<string>, long_term_losers array<string>, confidence_score double, created_at timestamp",
    "signals": "id long, node_id long, signal_type string, phrase string, entity string, source_count int, time_span string, confidence_score double, created_at timestamp",
}


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def write_table(df: DataFrame, root: str, name: str, mode: str = "append") -> None:
    fields = [f.strip().split(" ")[0] for f in TABLES[name].replace("array<string>", "array").split(",")]
    df.select(*fields).write.mode(mode).parquet(f"{root}/{name}")


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with the columns and types that TABLES declares for a table; columns that it lacks are null."""
    fields = StructType.fromDDL(TABLES[name]).fields
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
