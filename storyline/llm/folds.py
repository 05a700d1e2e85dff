"""Held-out fold and bounded training samples, as the classifiers use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's text is divisible by 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def bounded_sample(rows: DataFrame, label: str, per_label: int, spare: int = 4) -> DataFrame:
    """At most per_label rows of each non-null label: those whose id hashes lowest.

    The ids of a label are counted roughly first, which combines before the shuffle, and rows whose hash lies above the
    share that holds about spare * per_label ids are left out where they are read. So the task that ranks a label's rows
    gets about that many, however many partitions or rows there are. Repeated ids count once in that share.
    """
    share = F.xxhash64("doc_id") / F.lit(float(1 << 64)) + 0.5
    found = rows.groupBy(F.col(label).alias("_label")).agg(F.approx_count_distinct("doc_id").alias("_ids"))
    marked = rows.join(F.broadcast(found), F.col(label) == F.col("_label"))  # one row a label; the model on the driver has as many
    order = Window.partitionBy(label).orderBy(F.xxhash64("doc_id"), "doc_id", "text")
    marked = marked.where(share * F.col("_ids") <= spare * per_label)
    return marked.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_label).drop("_n", "_ids", "_label")
