"""Operator 11 [native]: exact copies by progressive refinement.

Lengths are grouped first, then a hash of the head of each text whose length repeats, then the SHA-256 of the texts whose
length and head repeat; a text that is alone in a group is settled there. The first read of the texts writes only
lengths and head hashes; the second one hashes the whole content of survivors. What survives a grouping is known to
each task by a bit set of a fixed number of bits, so its size does not grow with the rows: a bit that another group has
set only lets a text through to the next, finer grouping. Texts never move; rows of digests do, combined before the
shuffle, and the rows of a very large group are dealt over tasks.

Defined results. Texts are equal when they are identical after lower-casing A-Z; null counts as empty, and all empty
texts are one group. The row with the largest doc_id stays; rows without an id come after all others, and of
repeated rows with that id one stays. A table with one row or none has nothing to group. Very long texts are
hashed whole. Columns other than doc_id and text are not read by exact_groups and stay as they are in drop_copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, spread_join


def same_case(text: Column) -> Column:
    """text with A-Z lower-cased, null as empty; where all characters are ASCII, lower() does the same and is faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text))


def _place(key: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(bits))


def repeated(rows: DataFrame, key: list[str], bits: int) -> DataFrame:
    """The bit set of keys that more than one row holds: (word, flags), 64 bits a row, so at most bits / 64 rows."""
    found = rows.groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_at", _place(key, bits))
    return found.groupBy(F.shiftright("_at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_at & 63 as int))")).alias("flags"))


def surviving(rows: DataFrame, key: list[str], marks: DataFrame, bits: int) -> DataFrame:
    """rows with `survives`: whether the bit of their key is set in marks. The bit set is broadcast; `bits` bounds it."""
    out = rows.withColumn("_at", _place(key, bits))
    out = out.join(F.broadcast(marks), F.shiftright("_at", 6) == F.col("word"), "left")
    return out.withColumn("survives", F.coalesce(F.expr("(shiftright(flags, cast(_at & 63 as int)) & 1) = 1"), F.lit(False))).drop("_at", "word", "flags")


def _sketch(text: Column, head: int) -> tuple[Column, Column]:
    """Bytes of the text, and a hash of its first `head` characters."""
    return F.octet_length(F.coalesce(text, F.lit(""))).alias("bytes"), F.xxhash64(same_case(F.substring(text, 1, head))).alias("head")


def _suspects(docs: DataFrame, head: int, bits: int) -> tuple[DataFrame, list[str]]:
    """The bit set of (bytes, head) that more than one text has, and that key."""
    key = ["bytes", "head"]
    sketch = cut(docs.select(*_sketch(F.col("text"), head)), "sketch")
    alike = surviving(sketch, ["bytes"], repeated(sketch, ["bytes"], bits), bits).where("survives")
    return cut(repeated(alike, key, bits).coalesce(1), "suspects"), key  # at most bits / 64 rows


def exact_groups(docs: DataFrame, head: int = 256, bits: int = 1 << 24, all_digests: bool = False) -> DataFrame:
    """A row a row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    text_sha256 is null where the text was settled before its content was hashed, unless all_digests asks for it.
    """
    marks, key = _suspects(docs, head, bits)
    # the number of a row is fixed when the table is written, so that one of repeated rows can be told from the others
    rows = docs.select("doc_id", "text", *_sketch(F.col("text"), head), F.monotonically_increasing_id().alias("row"))
    rows = surviving(rows, key, marks, bits)
    digest = F.sha2(same_case(F.col("text")), 256)
    rows = cut(rows.select("doc_id", "bytes", "row", "survives", (digest if all_digests else F.when(F.col("survives"), digest)).alias("text_sha256")), "digests")
    alone = rows.where("not survives").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    last = rows.where("survives")
    same = ["bytes", "text_sha256"]
    groups = last.groupBy(*same).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"), F.coalesce(F.max_by("row", "doc_id"), F.min("row")).alias("first"))
    groups = cut(groups, "groups")
    total = groups.agg(F.coalesce(F.sum("group_size"), F.lit(0))).first()[0]
    met = spread_join(last, groups, same, "group_size", total)
    return alone.unionByName(met.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("first")).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, head: int = 256, bits: int = 1 << 24) -> DataFrame:
    """docs with one row of each group of equal texts: all columns, whatever their names."""
    marks, key = _suspects(docs, head, bits)
    rows = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), *_sketch(F.col("text"), head))
    rows = surviving(rows, key, marks, bits)
    last = rows.where("survives").withColumn("digest", F.sha2(same_case(F.col("doc.text")), 256))
    same = ["bytes", "digest"]
    keep = last.groupBy(*same).agg(F.max("id").alias("id"))
    one = last.dropDuplicates([*same, "id"]).alias("x").join(keep.alias("k"), [F.col(f"x.{c}").eqNullSafe(F.col(f"k.{c}")) for c in (*same, "id")], "left_semi")
    return rows.where("not survives").select("doc").unionByName(one.select("doc")).select("doc.*")


def op11(docs: DataFrame) -> DataFrame:
    return exact_groups(docs, all_digests=True)


OP11_SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
