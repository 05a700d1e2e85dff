"""From raw documents to packed sequences: five stages, each on all that the one before kept.

The last stage returns pieces as rows; the others return the columns of documents. Rows with the same doc_id are
judged each in stages 1 to 3, rows without one too; stage 3 keeps one row of each component of near copies, and every
row without words. Stage 4 repeats a document that it takes twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storyline.llm.common import cut, table
from storyline.llm.line_dedup import dedup_lines
from storyline.llm.mixing import mix
from storyline.llm.packing import pack
from storyline.llm.shingle_join import linked_rows, row_key
from storyline.llm.toxicity import learn_toxicity, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the model learned from labels predicts as toxic go. Null and empty texts stay unless the bias alone says
    toxic; without labelled rows of both kinds all stay. Equal texts are judged alike; extra columns stay."""
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).where("predicted = 0").select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that are kept elsewhere; a text may end empty. A null text becomes an empty one only
    if it loses lines, so it stays null. n_chars, where there is one, follows the text; other columns stay."""
    out = dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_rows: int = 500_000) -> DataFrame:
    """One row of each component: that of the smallest doc_id, and of several such the smallest row key. Rows without an
    id come after all others; rows without words stay, all of them. Extra columns count as parts of the row key."""
    each = linked_rows(docs).where("n_shingles > 0").groupBy("row", "component").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    each = cut(each, "rows")
    first = each.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "row")).alias("least"))
    first = first.select(F.col("least.row").alias("row"), F.lit(True).alias("again"))
    marks = each.join(first, "row", "left").where("again is null or n > 1").select(F.col("row").alias("_row"), F.coalesce("again", F.lit(False)).alias("again"))
    marks = cut(marks, "near-copies")
    hint = F.broadcast if marks.count() <= broadcast_rows else lambda df: df
    keyed = docs.withColumn("_row", row_key(docs))
    out = keyed.join(hint(marks.select("_row")), "_row", "left_anti")
    again = marks.where("again").select("_row")  # kept, but the row is there more than once
    if not again.isEmpty():
        out = out.unionByName(keyed.join(hint(again), "_row", "left_semi").dropDuplicates(["_row"]))
    return out.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them (0 to 2 times). A null source is one source; rows without words are of size 0
    and follow their block. Extra columns stay, whatever their names."""
    return mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row a piece of each row; a null or empty text is one piece of the end id. Columns other than doc_id and text end here."""
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The learned model and the tokens are out of SQL's reach; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
