"""Helpers shared by the operators: tables, shared scratch space, word rules and graph components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every word rule here: space and U+0009 to U+000D.
SPACE = r"\x20\x09-\x0D"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In local mode only, where one machine is all there
    is, an own temporary folder stands in for an unset one, removed at exit; on a cluster an unset one is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("storyline.scratch.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="storyline-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        where = "file://" + own
        spark.conf.set("storyline.scratch.dir", where)
    return where.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once into the shared folder and read it back: later readers repeat no work, lost executors lose no data."""
    return cut_at(df, shared_path(df.sparkSession, name))


def cut_at(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table that cut_at() wrote and nothing will read again."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(rows: DataFrame, keyed: DataFrame, key: list[str], count: str, total: int, salts: int = 32) -> DataFrame:
    """rows inner-joined with keyed (one row a key, `count` of `total` rows of `rows` for each), hot keys spread over tasks.

    A key that holds more than a thousandth of the total is hot, so fewer than a thousand are, whatever the data: their
    keys alone are sent to all tasks. Rows of a hot key are dealt over `salts` tasks, to which its row in keyed is copied.
    """
    hot = keyed.where(F.col(count) * 1000 > total)
    tagged = rows.join(F.broadcast(hot.select(*key, F.lit(salts).alias("_salts"))), key, "left")
    tagged = tagged.withColumn("_salt", F.when(F.col("_salts") > 0, F.pmod(F.xxhash64(*rows.columns), F.lit(salts)).cast("int")).otherwise(0)).drop("_salts")
    last = F.when(F.col(count) * 1000 > total, F.lit(salts - 1)).otherwise(0)
    return tagged.join(keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))), [*key, "_salt"]).drop("_salt")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the smallest node reachable.

    Alternates large-star and small-star steps; a round leaves at most the edges it had, and every node ends
    with one edge to its component's smallest node. A round groups neighbours by node with min(), which
    combines before the shuffle, and joins that minimum back, a hub's edges spread over tasks, so no neighbour list is
    ever gathered. Self-loops and repeated edges are fine; an empty input gives an empty result.
    """

    def star(e: DataFrame, large: bool, total: int, hub: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")).withColumn("m", F.least("a", "m"))
        hit = spread_join(both, least, ["a"], "_n", 2 * total if large else total) if hub else both.join(least, "a")
        if large:
            return hit.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        moved = hit.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    spark, kind, written = edges.sparkSession, edges.schema["a"].dataType, []

    def stored(df: DataFrame, files: int | None = None) -> DataFrame:
        written.append(shared_path(spark, "edges"))
        return cut_at(df.coalesce(files) if files else df, written[-1])

    e = edges.select(F.greatest("a", "b").cast(kind).alias("a"), F.least("a", "b").cast(kind).alias("b"))
    e = stored(e.where("a <> b").distinct())
    for _ in range(max_rounds):
        # done once every node has one edge or is the end of others' edges, but not both
        ends = e.select(F.col("a").alias("node"), F.lit(1).alias("up")).unionByName(e.select(F.col("b").alias("node"), F.lit(0).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least"), F.count("*").alias("n"))
        left = F.count_if(F.expr("up > 1 or (up = 1 and least = 0)"))
        total, left, most = ends.agg(F.coalesce(F.sum("up"), F.lit(0)), left, F.coalesce(F.max("n"), F.lit(0))).first()
        while len(written) > 1:
            remove(spark, written.pop(0))
        if not left:
            out = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())
        files, hub = total // 500_000 + 1, most > 500 and most * 500 > total
        e = stored(star(stored(star(e, True, total, hub), files), False, total, hub), files)
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
