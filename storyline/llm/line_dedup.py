"""Operator 9: line de-duplication with levelled sorted runs of line hashes.

Defined results. A null or empty text is one empty line. A row counts as one document, so a doc_id that
occurs twice counts twice. A null doc_id is lower than any other; lines that only rows without an id hold stay. Lines
whose key is short, or found in too few documents, stay. Very long texts take their lines as one array; the lines that one
loses are found in a time that grows with their number, not with its square. An empty table
gives an empty result. Extra columns stay; one named like a result column is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, cut, partitions, shared_path, spread_join

KEY = ["h1", "h2"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(" \t\n\x0b\x0c\r")))


def _hash(key: Column) -> Column:
    """128 bits from two seeds; a chance match of two different lines is out of reach at any corpus size."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def _row() -> Column:
    return F.xxhash64("doc_id", "text", F.isnull("doc_id"))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, row, h1, h2, at, first): a row for each line with a long enough key, `at` its place in the text, `first` true for
    one of the lines of a text with the same key; row is a hash of the text and its id."""
    keys = F.filter(F.transform(_lines(F.col("text")), lambda x, i: F.struct(_key(x).alias("k"), i.alias("at"))), lambda s: F.length(s["k"]) >= min_chars)
    every = F.transform(keys, lambda s: F.struct(_hash(s["k"]).alias("h"), s["at"].alias("at")))
    lines = docs.select("doc_id", _row().alias("row"), F.sort_array(every).alias("s"))  # lines with one key are next to each other
    first = lambda s, i: (i == 0) | (F.get("s", i - 1)["h"] != s["h"])
    lines = lines.where(F.size("s") > 0).select("doc_id", "row", F.explode(F.transform("s", lambda s, i: F.struct(s["h"]["h1"].alias("h1"), s["h"]["h2"].alias("h2"), s["at"].alias("at"), first(s, i).alias("first")))).alias("l"))
    return lines.select("doc_id", "row", "l.*")


class LineRuns:
    """Sorted runs of (h1, h2, n_docs, keeper) in levels, filled from the largest doc_ids down.

    add() aggregates a batch by key and anti-joins it with the runs. A key that no run holds is fresh: it enters with its
    largest doc_id as keeper, and as later batches have smaller ids only, no one contests that. A key that is held enters
    with its count alone. The two parts are stored as a run of level 0; once a level holds `fanout` runs they are merged
    into one run of the next, so a key is rewritten a logarithmic number of times. Each run is dealt by key and sorted
    within its files, which keeps equal keys of a merge together; Spark still sorts for its joins, as plain files tell it no order.
    """

    def __init__(self, spark: SparkSession, fanout: int = 4):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]

    def _store(self, run: DataFrame) -> DataFrame:
        return cut(run.repartition(partitions(self.spark), *KEY).sortWithinPartitions(*KEY), "line-run")

    def runs(self) -> DataFrame | None:
        flat = [r for level in self.levels for r in level]
        out = None
        for r in flat:
            out = r if out is None else out.unionByName(r)
        return out

    @staticmethod
    def merged(runs: DataFrame) -> DataFrame:
        """One row a key; of its entries exactly one has a keeper, or none where all its ids are null."""
        return runs.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.min("keeper").alias("keeper"))

    def add(self, hashes: DataFrame) -> DataFrame:
        """Store a batch of line_hashes(), whose ids lie below those of all batches before; returns its fresh keys."""
        batch = hashes.groupBy(*KEY).agg(F.count_if("first").alias("n_docs"), F.max("doc_id").alias("keeper"))
        known = self.runs()
        if known is None:
            run = fresh = self._store(batch)
        else:
            batch, known = cut(batch, "line-batch"), known.select(*KEY)
            fresh = batch.join(known, KEY, "left_anti")
            held = batch.join(known, KEY, "left_semi").withColumn("keeper", F.lit(None).cast(batch.schema["keeper"].dataType))
            run = self._store(fresh.unionByName(held))
        self.levels[0].append(run)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            whole = self._merge(self.levels[level])
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(whole)
            level += 1
        return fresh

    def _merge(self, runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return self._store(self.merged(out))

    def totals(self) -> DataFrame:
        return self.merged(self.runs())


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, batches: int = 4) -> DataFrame:
    """docs with text reduced to its kept lines, and n_lines, n_dropped.

    Every line key of at least min_chars code points found in at least min_docs documents is dropped from all
    but the largest doc_id that holds it. The hashes are made once and enter the runs in `batches` deliveries, cut at
    approximate quantiles of doc_id, the largest ids first; every document is in exactly one of them.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    shares = [1 - (b + 1) / batches for b in range(batches - 1)]
    bounds = docs.agg(F.percentile_approx("doc_id", shares, 1000)).first()[0] if shares else None
    later = sum((F.coalesce(F.col("doc_id") < x, F.lit(True)).cast("int") for x in bounds or []), F.lit(0))
    path = shared_path(spark, "line-hashes")
    hashes = line_hashes(docs, min_chars).withColumn("batch", later)
    hashes.write.partitionBy("batch").parquet(path)
    hashes = spark.read.schema(hashes.schema).parquet(path)
    runs = LineRuns(spark)
    for b in range(batches):
        runs.add(hashes.where(F.col("batch") == b).drop("batch"))
    heavy = cut(runs.totals().where(F.col("n_docs") >= min_docs).where("keeper is not null"), "line-heavy")
    total = heavy.agg(F.sum("n_docs")).first()[0] or 0
    drops = spread_join(hashes.drop("batch"), heavy, KEY, "n_docs", total).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    drops = drops.groupBy(F.col("row").alias("_drop_row")).agg(F.collect_set("at").alias("_drop"))
    joined = docs.join(drops, _row() == F.col("_drop_row"), "left").withColumn("_lines", _lines(F.col("text")))
    # positions, as a set difference of whole numbers takes linear time; _lines is used twice, so it is split once
    places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_drop")
    kept = F.when(F.col("_drop").isNotNull(), F.transform(places, lambda i: F.get("_lines", i)))
    joined = joined.select(*[docs[c] for c in docs.columns], F.size("_lines").alias("n_lines"), F.when(F.col("_drop").isNull(), 0).otherwise(F.size("_lines") - F.size(places)).alias("n_dropped"), kept.alias("_kept"))
    return joined.withColumn("text", F.when(F.col("n_dropped") == 0, F.col("text")).otherwise(F.array_join("_kept", "\n"))).drop("_kept")


def op9(docs: DataFrame) -> DataFrame:
    out = dedup_lines(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents),
k AS (SELECT doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
h AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, h.key IS NOT NULL AND k.doc_id <> h.last_doc AS dropped FROM k LEFT JOIN h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
