"""Data-quality checks over the nine tables: one row (check, severity, issues) a check, and a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORPHANS = (("cleaned_news", "raw_news_id", "raw_news"), ("cluster_news_map", "cleaned_news_id", "cleaned_news"), ("cluster_news_map", "cluster_id", "event_clusters"), ("nodes", "cluster_id", "event_clusters"), ("timeline", "node_id", "nodes"))
DANGLING = (("edges", "from_node_id", "nodes"), ("edges", "to_node_id", "nodes"), ("impact", "node_id", "nodes"), ("signals", "node_id", "nodes"))
REPEATED = (("nodes", ["cluster_id"]), ("edges", ["from_node_id", "to_node_id"]), ("impact", ["node_id"]), ("timeline", ["timeline_group_id", "position_index"]))


def _row(df: DataFrame, check: str, severity: str) -> DataFrame:
    return df.agg(F.count("*").alias("issues")).select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), "issues")


def checks(t: dict[str, DataFrame]) -> DataFrame:
    out = []
    for child, key, parent in ORPHANS + DANGLING:
        lost = t[child].where(F.col(key).isNotNull()).join(t[parent].select(F.col("id").alias(key)), key, "left_anti")
        out.append(_row(lost, f"{child}.{key} without {parent}", "error"))
    for name, key in REPEATED:
        out.append(_row(t[name].groupBy(*key).count().where("count > 1"), f"{name} repeated {','.join(key)}", "warning"))
    for c in ("entity", "event_type"):
        out.append(_row(t["nodes"].where(F.coalesce(F.trim(c), F.lit("")) == ""), f"nodes.{c} empty", "warning"))
    for name in ("nodes", "edges", "impact", "signals"):
        out.append(_row(t[name].where("confidence_score < 0 or confidence_score > 1"), f"{name}.confidence_score out of range", "error"))
    out.append(_row(t["edges"].where("from_node_id = to_node_id"), "edges self-loop", "warning"))
    per = t["timeline"].groupBy("timeline_group_id").agg(F.max("position_index").alias("top"), F.count("*").alias("n"))
    out.append(_row(per.where("top > n - 1"), "timeline position gap", "info"))
    many = t["nodes"].where("is_anchor").agg(F.count("*").alias("n")).where("n > 1")
    out.append(_row(many, "nodes more than one anchor", "info"))
    out.append(_row(t["event_clusters"].join(t["cluster_news_map"].select(F.col("cluster_id").alias("id")), "id", "left_anti"), "event_clusters without news", "info"))
    lone = t["nodes"]
    for name in ("timeline", "impact", "signals"):
        lone = lone.join(t[name].select(F.col("node_id").alias("id")), "id", "left_anti")
    out.append(_row(lone, "nodes without timeline, impact and signal", "info"))
    whole = out[0]
    for r in out[1:]:
        whole = whole.unionByName(r)
    return whole


def repeated_keys(t: dict[str, DataFrame], most: int = 10) -> DataFrame:
    """(check, place, key, n): the `most` smallest keys that each check of repeated rows finds, and how many rows have them.

    A task hands on its smallest keys only, so no list of all of them is formed."""
    out = None
    for name, key in REPEATED:
        found = t[name].groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").orderBy(*key).limit(most)
        place = F.row_number().over(Window.orderBy(*key))  # of `most` rows
        own = found.select(F.lit(f"{name} repeated {','.join(key)}").alias("check"), place.alias("place"), F.concat_ws(",", *[F.col(k).cast("string") for k in key]).alias("key"), "n")
        out = own if out is None else out.unionByName(own)
    return out


def health(report: DataFrame) -> DataFrame:
    """One row: errors, warnings or healthy, with the issues by severity."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("severity") == s, F.col("issues"))), F.lit(0))
    out = report.agg(n("error").alias("errors"), n("warning").alias("warnings"), n("info").alias("infos"))
    return out.withColumn("health", F.when(F.col("errors") > 0, "errors").when(F.col("warnings") > 0, "warnings").otherwise("healthy"))


def row_counts(t: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in t.items():
        own = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = own if out is None else out.unionByName(own)
    return out
