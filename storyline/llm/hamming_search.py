"""Operator 1: exact top-k search over binary codes by incremental multi-index hashing.

A 64-bit code is cut into m segments; step t looks at segment t mod m with radius t div m, that is at the buckets
whose value differs from the query's in exactly that many bits. After step t every code within distance t has been met
(a code further off than the radius in every segment is further off than t in all), so a query stops as soon as k rows
are known within t. The search never ends on a guess.

Equal codes are searched once: a code keeps its row count and its k + 1 smallest ids, which is all that a top-k by
(distance, id) can need.

Defined results. A vector that is null, has not `bits` components, or holds a null or non-finite component has no code:
it is neither found nor searched for. Rows with a null id are left out; repeated rows are found each, and each asks. If there are fewer
than k other rows, all of them are returned. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spread_join

#: The steps that are taken together in one Spark job; each tuple is (first, past the last).
ROUNDS = ((0, 12), (12, 16), (16, 18), (18, 20), (20, 22), (22, 24), (24, 28), (28, 36), (36, 65))


def sign_code(embedding: Column, bits: int = 64) -> Column:
    """Bit i tells whether component i is above 0; null where there is no code."""
    whole = (F.size(embedding) == bits) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    signs = F.transform(embedding, lambda x: (x > 0).cast("long"))
    code = F.aggregate(signs, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    return F.when(whole, code)


def _prober(steps: tuple[int, int], segments: int, k: int):
    """Cogroup function: codes and queries of one part of one segment -> the k + 1 nearest of what the steps meet."""
    width = 64 // segments
    low = np.uint64((1 << width) - 1)

    def probe(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"q": np.zeros(0, np.int64), "code": np.zeros(0, np.int64), "dist": np.zeros(0, np.int32), "first_id": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)})
        if index.empty or asked.empty:
            return none
        seg = int(asked["seg"].iloc[0])
        radii = {t // segments for t in range(*steps) if t % segments == seg and t // segments <= width}
        every = np.arange(1 << width, dtype=np.uint64)
        masks = every[np.isin(np.bitwise_count(every), list(radii))]
        shift = np.uint64(seg * width)
        codes = index["code"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort((codes >> shift) & low, kind="stable")
        codes, ids, n = codes[order], index["first_id"].to_numpy(np.int64)[order], index["n"].to_numpy(np.int64)[order]
        starts = np.searchsorted((codes >> shift) & low, np.arange((1 << width) + 1, dtype=np.uint64))
        out = []
        for q, bound in zip(asked["q"].to_numpy(np.int64), asked["bound"].to_numpy(), strict=True):
            mine = np.int64(q).view(np.uint64)
            value = ((mine >> shift) & low) ^ masks
            a, c = starts[value], starts[value + np.uint64(1)] - starts[value]
            a, c = a[c > 0], c[c > 0]
            total = int(c.sum())
            if not total:
                continue
            at = np.repeat(a - np.r_[0, np.cumsum(c)[:-1]], c) + np.arange(total)
            dist = np.bitwise_count(codes[at] ^ mine).astype(np.int32)
            at, dist = at[dist <= bound], dist[dist <= bound]
            if len(at) > k + 1:
                near = dist <= np.partition(dist, k)[k]
                at, dist = at[near], dist[near]
            best = np.lexsort((ids[at], dist))[: k + 1]
            out.append((np.full(len(best), q), codes[at[best]].view(np.int64), dist[best], ids[at[best]], n[at[best]]))
        if not out:
            return none
        return pd.DataFrame(dict(zip(none.columns, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return probe


def _reach(steps: tuple[int, int], segments: int, part_bits: int) -> list[tuple[int, int]]:
    """(seg, flip): the parts that some bucket of these steps lies in, as bits to flip in the query's own part."""
    width, out = 64 // segments, []
    for seg in range(segments):
        radii = {t // segments for t in range(*steps) if t % segments == seg and t // segments <= width}
        for flip in range(1 << part_bits):
            n = flip.bit_count()
            if any(n <= r <= n + width - part_bits for r in radii):
                out.append((seg, flip))
    return out


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, segments: int = 4, part_codes: int = 500_000) -> DataFrame:
    """Rows (query_id, rank, vec_id, distance) for queries and vectors of (vec_id, code), a query's own id left out.

    Each segment's directory is cut by the low bits of its values into parts of about part_codes codes. A query still open
    goes to the parts that a bucket of the round's steps lies in, and a part hands on k + 1 codes for it. Between rounds
    only those and the open queries are kept.
    """
    spark = vectors.sparkSession
    has = vectors.where("code is not null and vec_id is not null").select("vec_id", "code")
    by_id = Window.partitionBy("code").orderBy("vec_id")
    heads = has.withColumn("_n", F.row_number().over(by_id)).where(F.col("_n") <= k + 1)
    heads = heads.groupBy("code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    sizes = has.groupBy("code").agg(F.count("*").alias("n"))
    index = cut(heads.join(sizes, "code").withColumn("first_id", F.element_at("ids", 1)), "codes")
    asked = cut(queries.where("code is not null and vec_id is not null").select("vec_id", "code"), "queries")
    width = 64 // segments
    part_bits = min(width, math.ceil(math.log2(max(1, index.count() / part_codes))))
    segment = F.explode(F.sequence(F.lit(0), F.lit(segments - 1)))

    def part(code: str):
        return F.expr(f"cast(shiftrightunsigned({code}, seg * {width}) & {(1 << part_bits) - 1} as int)")

    dealt = index.select("code", "first_id", "n", segment.alias("seg")).withColumn("part", part("code"))
    open_ = asked.groupBy(F.col("code").alias("q")).agg(F.count("*").alias("asks")).withColumn("bound", F.lit(64))
    asks = open_ = cut(open_, "open")
    best = None
    ranked = Window.partitionBy("q").orderBy("dist", "first_id")
    for steps in ROUNDS:
        reach = spark.createDataFrame(_reach(steps, segments, part_bits), "seg int, flip int")  # at most segments * 2^width rows
        sent = open_.select("q", "bound", segment.alias("seg")).withColumn("own", part("q")).join(F.broadcast(reach), "seg")
        sent = sent.select("q", "bound", "seg", F.col("own").bitwiseXOR(F.col("flip")).alias("part"))
        schema = "q long, code long, dist int, first_id long, n long"
        found = dealt.groupBy("seg", "part").cogroup(sent.groupBy("seg", "part")).applyInPandas(_prober(steps, segments, k), schema)
        if best is not None:
            found = found.unionByName(best)
        found = found.dropDuplicates(["q", "code"]).withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= k + 1).drop("_r")
        best = cut(found, "nearest")
        known = best.groupBy("q").agg(F.sum(F.when(F.col("dist") <= steps[1] - 1, F.col("n"))).alias("sure"), F.count("*").alias("c"), F.max("dist").alias("most"))
        open_ = open_.select("q").join(known, "q", "left").where(F.coalesce("sure", F.lit(0)) <= k)
        open_ = cut(open_.select("q", F.when(F.col("c") > k, F.col("most")).otherwise(64).alias("bound")), "open")
        if open_.isEmpty():
            break
    # a code counts while fewer than k + 1 rows, the query's own one among them, are nearer
    nearer = F.sum("n").over(Window.partitionBy("q").orderBy("dist").rangeBetween(Window.unboundedPreceding, -1))
    best = best.withColumn("_nearer", F.coalesce(nearer, F.lit(0))).where(F.col("_nearer") <= k).join(index.select("code", "ids"), "code")
    best = best.groupBy("q").agg(F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("dist"), i.alias("vec_id"))))).alias("near"))
    best = best.withColumn("near", F.slice(F.array_sort("near"), 1, k + 1)).join(asks, "q")  # k + 1 rows serve all that ask for a code
    found = spread_join(asked.select(F.col("vec_id").alias("query_id"), F.col("code").alias("q")), best, ["q"], "asks", asked.count())
    mine = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    found = found.select("query_id", F.posexplode(F.slice(mine, 1, k)).alias("at", "x"))
    return found.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.dist").alias("distance"))


def op1(embeddings: DataFrame) -> DataFrame:
    rows = embeddings.select("vec_id", sign_code(F.col("embedding")).alias("code"))
    return top_k(rows, rows.where("vec_id % 20 = 0"))


OP1_SQL = """
WITH v AS (SELECT vec_id, CAST(array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS BIT) AS code FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
d AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(bit_count(xor(q.code, v.code)) AS INTEGER) AS distance FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM d)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
