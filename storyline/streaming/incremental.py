"""Incremental ingestion: arriving files are appended once by article key, and a batch reads only the stored keys it may repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.articles import new_articles
from ..operators.graph import settled
from ..sources.versions import Versions

DIGITS = 2  # leading hex digits of a key that name its part of the table: 256 parts
BITS = 1 << 23  # of the filter of a part, at most 1 MB; a whole number of bitmaps of 32,768 bits


class KeyFilter:
    """A Bloom filter with one hash for every part of a table: which keys may be stored there.

    Rows are bitmaps (key_part, bucket, bits), only those with a bit set. A batch adds a folder of them; when there are many, they are
    combined by or. A key without its bit is not stored; one with it may be, so only its part has to be read.
    """

    def __init__(self, spark: SparkSession, root: str, digits: int = DIGITS, bits: int = BITS, most_folders: int = 16):
        self.digits, self.bits, self.most_folders = digits, bits, most_folders
        self.store = Versions(spark, root, most_folders + 1)

    def part(self) -> Column:
        return F.concat(F.lit("k"), F.substring("unique_id", 1, self.digits))  # the letter keeps it a string when folders are read

    def _places(self, rows: DataFrame) -> DataFrame:
        at = F.pmod(F.xxhash64("unique_id"), F.lit(self.bits)) + 1
        return rows.select("unique_id", self.part().alias("key_part"), F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("place"))

    def maybe_stored(self, rows: DataFrame) -> list[str]:
        """The parts, of 16^digits at most, in which keys of rows may be stored."""
        known = self.store.tables().get("bits")
        if known is None:
            return []
        byte = F.conv(F.hex(F.substring("bits", (F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        is_set = F.call_function("shiftright", byte, (F.col("place") % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
        found = self._places(rows).join(known, ["key_part", "bucket"]).where(is_set)
        return sorted(r["key_part"] for r in found.select("key_part").distinct().collect())

    def add(self, rows: DataFrame) -> None:
        new = self._places(rows).groupBy("key_part", "bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
        known = self.store.tables().get("bits")
        if known is None or len(self.store.folders("bits")) < self.most_folders:
            self.store.publish({}, {"bits": new})
        else:
            self.store.publish({"bits": known.unionByName(new).groupBy("key_part", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))})


def append_new(rows: DataFrame, table: str, keys: KeyFilter) -> None:
    """Append the articles of rows whose key the Parquet table doesn't hold, partitioned by key_part, one file a part.

    The filter is published before the table is written: after a failure between the two it says `may be stored` of keys that
    are not, which costs a read, while the other order would add articles twice. Without an id, rows get a hash of their key.
    """
    spark = rows.sparkSession
    if "id" in rows.columns:
        own = settled(new_articles(rows), "batch")
    else:  # the id of an article is a hash of its key, the same in every batch
        own = settled(new_articles(rows.withColumn("id", F.lit(0).cast("long"))).withColumn("id", F.xxhash64("unique_id")), "batch")
    parts = keys.maybe_stored(own)
    if parts:
        try:
            stored = spark.read.schema("unique_id string, key_part string").parquet(table).where(F.col("key_part").isin(parts))
            own = settled(own.join(stored.select("unique_id"), "unique_id", "left_anti"), "new")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise  # else the first batch failed between its two steps: nothing is stored
    if own.isEmpty():
        return
    keys.add(own)
    own.withColumn("key_part", keys.part()).repartition("key_part").write.mode("append").partitionBy("key_part").parquet(table)


def ingest_available(spark: SparkSession, incoming: str, schema: str, table: str, checkpoint: str, digits: int = DIGITS) -> None:
    """Read all files that have arrived since the last call and append their new articles to the Parquet table.

    Keys are held against the whole table through its filter, kept in `<table>-keys`, so no watermark bounds the state and a batch that is
    replayed after a failure adds nothing twice. The table is one that this function made, with the same digits; there is one
    writer at a time. Nulls in title, content or source leave a row out, as in normalized_input.
    """

    def append(batch: DataFrame, _: int) -> None:
        append_new(batch, table, KeyFilter(batch.sparkSession, f"{table.rstrip('/')}-keys", digits))

    query = spark.readStream.schema(schema).parquet(incoming).writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
