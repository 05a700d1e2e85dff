"""Updates of stored tables: one timeline group replaced, nodes and impact rows updated in place by their key.

The results of upserts are new tables: write them beside the stored one and swap, or use settled() before overwriting.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_groups(rows: DataFrame, path: str, group: str = "timeline_group_id") -> None:
    """Replace the stored rows of the groups in `rows`; other groups' files stay untouched. Rows without a group form one of their own."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(group).parquet(path)


def upsert(stored: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("id", "created_at")) -> DataFrame:
    """stored with the fields of `new` where the key is known, and the other rows of `new` added.

    Columns are those of stored; a column that new lacks keeps its stored value (null in added rows), and so do those
    of `keep` where stored has one. Of rows in new with one key, the smallest id counts (any where there is no id).
    Rows of new with a null key are left out, and stored ones stay. One join on the key.
    """
    order = F.col("id") if "id" in new.columns else F.lit(0)
    first = new.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1")
    a, b = stored.withColumn("_old", F.lit(True)).alias("a"), first.withColumn("_new", F.lit(True)).alias("b")
    both = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    out = []
    for c in stored.columns:
        if c not in new.columns:
            value = F.col(f"a.{c}")
        elif c == key or c in keep:
            value = F.coalesce(f"a.{c}", f"b.{c}")
        else:
            value = F.when(F.col("b._new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
        out.append(value.cast(stored.schema[c].dataType).alias(c))
    return both.select(*out)


def upsert_nodes(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Nodes by cluster: derived fields are new, a known cluster's node keeps its id."""
    return upsert(stored, new, "cluster_id")


def upsert_impact(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Impact rows by node."""
    return upsert(stored, new, "node_id")


def with_impact_type(nodes: DataFrame, types: DataFrame) -> DataFrame:
    """nodes with the impact_type of types (node_id, impact_type); nodes that types lacks keep theirs."""
    own = types.groupBy(F.col("node_id").alias("id")).agg(F.max("impact_type").alias("_type"))
    return nodes.join(own, "id", "left").withColumn("impact_type", F.coalesce("_type", "impact_type")).select(*nodes.columns)
