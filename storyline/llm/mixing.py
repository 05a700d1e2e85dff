"""Operator 10: mixing sources to target weights with a splitting tree over blocks of documents.

Defined results. A null text has size 0; a null source is a source of its own, last in order. Rows that share doc_id and
text are drawn together. A source whose size is 0 has target 0 and its rows are never taken; an empty table
gives an empty result. Extra columns stay; in mix_plan's result one named like a result column is replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, cut, partitions

WEIGHTS = (5, 2, 1)
RESULT = ("size", "source_size", "target", "copies", "taken", "shard_1", "shard_2", "shuffle_key")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE}]+")).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) by water filling; one row a source.

    Sources in code point order weigh 5, 2, 1 in turn. A source gets weight * level; one that would pass cap * size stops
    there, and the level rises for the others, round after round, until none passes. No task sees all sources: they are
    sorted by range and numbered within a partition, behind the partitions before.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = F.col("source").asc_nulls_last()
    per = cut(per.repartitionByRange(partitions(sizes.sparkSession), by).withColumn("_part", F.spark_partition_id()), "mix-sources")
    past = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    past = per.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_past"))
    place = F.pmod(F.row_number().over(Window.partitionBy("_part").orderBy(by)) - 1 + F.col("_past"), F.lit(len(weights))) + 1
    per = per.join(F.broadcast(past), "_part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), place.cast("int")).cast("double"))
    per = cut(per.select("source", "source_size", "weight", (cap * F.col("source_size")).alias("cap")), "mix-sources")
    level, full = 0.0, -1
    while True:
        open_ = F.col("cap") > F.col("weight") * level
        state = per.agg(F.sum("source_size"), F.sum(F.when(~open_, F.col("cap"))), F.sum(F.when(open_, F.col("weight"))), F.count_if(~open_)).first()
        if state[3] == full or not state[2]:  # no further source is full, or all are
            break
        level, full = (share * state[0] - (state[1] or 0.0)) / state[2], state[3]
    rest = F.lit(level) if state[2] else F.lit(float("inf"))
    return per.select("source", "source_size", F.least(F.col("cap"), F.col("weight") * rest).alias("target"))


def _numbered(rows: DataFrame, group: str, seed: int, key: list[str], slots: int) -> DataFrame:
    """rows with _rank, from 1, in the order of a seeded hash of key within each group, and _size, the group's rows.

    The hash range is cut into slots; a task numbers one slot of one group, behind the slots before.
    """
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), *key)).withColumn("_slot", F.floor((F.col("_h") / F.lit(2.0**64) + 0.5) * slots))
    counts = rows.groupBy(group, "_slot").agg(F.count("*").alias("_n"))
    past = Window.partitionBy(group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(group, "_slot", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_past"), F.sum("_n").over(Window.partitionBy(group)).alias("_size"))
    at = F.row_number().over(Window.partitionBy(group, "_slot").orderBy("_h", *key))
    return rows.withColumn("_rank", at).join(counts, [group, "_slot"]).withColumn("_rank", F.col("_rank") + F.col("_past")).drop("_h", "_slot", "_past")


def mix_plan(docs: DataFrame, shards: int = 8, seed: int = 17, rows_per_block: int = 50_000) -> DataFrame:
    """docs with size, source_size, target, copies (0 to 2), taken = copies * size, shard_1, shard_2, shuffle_key.

    1. Each source is cut into blocks by a hash of doc_id and text. A source takes floor(target / size) copies of every
       block, and of the rest whole blocks in permuted order until the target; the block on the border is cut at
       a hash value, so the decision for a row needs nothing but its block's row.
    2. The drawn block copies are dealt to `shards` (a power of two) by a binary tree: at each node the blocks are
       permuted and the first half goes left. What a source then has on the left is a draw from the multivariate
       hypergeometric distribution, and the quotas are exact: each block copy goes to exactly one shard.
    3. shuffle_key orders rows within a shard.
    The hash of the seed, doc_id and text decides everything, so runs agree.
    """
    docs = docs.drop(*RESULT)
    levels = int(math.log2(shards))
    if 1 << levels != shards:
        raise ValueError("shards must be a power of two")
    rolled = docs.withColumn("size", word_count(F.col("text"))).withColumn("_roll", F.xxhash64(F.lit(seed), "doc_id", "text"))
    sizes = cut(rolled.select("source", "size", "_roll"), "mix-sizes")
    n_blocks = max(64, -(-sizes.count() // rows_per_block))
    block = F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_roll")), F.lit(n_blocks)).cast("int")
    sizes = sizes.withColumn("_block", block)
    targets = cut(source_targets(sizes), "mix-targets")
    blocks = sizes.groupBy(F.col("source").alias("_s"), "_block").agg(F.sum("size").alias("_sum"))
    blocks = blocks.join(targets, F.col("_s").eqNullSafe(F.col("source"))).drop("source")
    base = F.when(F.col("source_size") == 0, 0).otherwise(F.floor(F.col("target") / F.col("source_size")).cast("int"))
    blocks = blocks.withColumn("_base", base).withColumn("_rest", F.col("target") - F.col("_base") * F.col("source_size"))
    order = Window.partitionBy("_s").orderBy(F.xxhash64(F.lit(seed + 2), "_s", "_block"), "_block")
    blocks = blocks.withColumn("_past", F.sum("_sum").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum"))
    state = F.when(F.col("_past") + F.col("_sum") <= F.col("_rest"), "all").when(F.col("_past") < F.col("_rest"), "part").otherwise("none")
    blocks = cut(blocks.withColumn("_extra", state), "mix-blocks")

    edge = blocks.where("_extra = 'part'").select(F.col("_s").alias("_es"), F.col("_block").alias("_eb"), (F.col("_rest") - F.col("_past")).alias("_left"))
    near = sizes.join(edge, F.col("source").eqNullSafe(F.col("_es")) & (F.col("_block") == F.col("_eb")))
    near = near.groupBy("_es", "_eb", "_left", "_roll").agg(F.sum("size").alias("size"))
    walk = Window.partitionBy("_es", "_eb").orderBy("_roll").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_before", F.sum("size").over(walk) - F.col("size"))
    cuts = near.where(F.col("_before") + F.col("size") / 2 <= F.col("_left")).groupBy("_es", "_eb").agg(F.max("_roll").alias("_cut"))

    drawn = blocks.select("_s", "_block", F.explode(F.array_compact(F.array(F.when((F.col("_base") > 0) | (F.col("_extra") != "none"), 1), F.when((F.col("_base") > 1) | ((F.col("_base") > 0) & (F.col("_extra") != "none")), 2)))).alias("_copy"))
    tree = cut(drawn.withColumn("_shard", F.lit(0)), "mix-drawn")
    slots = max(16, tree.count() // 20_000)
    for level in range(levels):
        tree = _numbered(tree, "_shard", seed + 3 + level, ["_s", "_block", "_copy"], slots)
        tree = tree.withColumn("_shard", F.col("_shard") * 2 + (F.col("_rank") > F.ceil(F.col("_size") / 2)).cast("int")).drop("_rank", "_size")
    shard = tree.groupBy(F.col("_s").alias("_ts"), F.col("_block").alias("_tb")).agg(F.max(F.when(F.col("_copy") == 1, F.col("_shard"))).alias("shard_1"), F.max(F.when(F.col("_copy") == 2, F.col("_shard"))).alias("shard_2"))
    plan = blocks.join(cuts, F.col("_s").eqNullSafe(F.col("_es")) & (F.col("_block") == F.col("_eb")), "left")
    plan = plan.join(shard, F.col("_s").eqNullSafe(F.col("_ts")) & (F.col("_block") == F.col("_tb")), "left")
    plan = cut(plan.select("_s", F.col("_block").alias("_b"), "source_size", "target", "_base", "_extra", "_cut", "shard_1", "shard_2"), "mix-plan")

    out = rolled.withColumn("_block", block).join(plan, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    extra = (F.col("_extra") == "all") | ((F.col("_extra") == "part") & F.coalesce(F.col("_roll") <= F.col("_cut"), F.lit(False)))
    out = out.withColumn("copies", F.col("_base") + extra.cast("int")).withColumn("taken", F.col("copies") * F.col("size"))
    keep = [docs[c] for c in docs.columns]
    return out.select(*keep, "size", "source_size", "target", "copies", "taken", F.when(F.col("copies") > 0, F.col("shard_1")).alias("shard_1"), F.when(F.col("copies") > 1, F.col("shard_2")).alias("shard_2"), F.xxhash64(F.lit(seed), "_roll").alias("shuffle_key"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, a row for each copy taken, dealt by shard and shuffled within it."""
    rows = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_doc"))
    drawn = mix_plan(rows, **options).select("_doc", "shuffle_key", F.explode(F.slice(F.array("shard_1", "shard_2"), F.lit(1), F.col("copies"))).alias("shard"))
    n = partitions(docs.sparkSession)  # a shard is as many files as its size needs, each shuffled
    dealt = drawn.repartition(n, "shard", F.pmod("shuffle_key", F.lit(n)))
    return dealt.sortWithinPartitions("shard", "shuffle_key").select("_doc.*")


def op10(docs: DataFrame) -> DataFrame:
    """What the mix takes of each document, and the shards and the order there that the splitting tree gives its copies."""
    plan = mix_plan(docs.select("doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "shard_1", "shard_2", "shuffle_key")
