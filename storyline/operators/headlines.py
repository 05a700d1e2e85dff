"""Near-duplicate headlines: an index of those that were kept, probed by new ones, and the ordered rule of which to keep.

Two headlines are compared when they share a blocking key, and are near copies when their trigrams overlap by the gate and
their sequence ratio reaches the threshold. The index has two tables, so that a later run reads it as it is:

- heads: every kept headline with bits of its trigrams and of its character counts, in longs;
- dealt: its blocking keys.

Headlines of one key meet in blocks, each pair of blocks in a task of its own: few operations on longs leave out nearly all
pairs, whatever a key is shared by, and what is left is decided where it met. Nothing but near copies is kept or shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import COUNTED, blocking_keys, char_counts, clean_text, near_copy, normalize_text, significant_tokens, trigrams
from .graph import greedy_dropped, settled

GATE = 0.75  # of the threshold
START = 16  # characters of the blocking key that every headline has, see blocking_keys
HOT = 8192  # headlines of one key up to which they meet in one task; more are cut into blocks
MOST = 64  # blocks of a key
WORDS = 8  # 64-bit words of trigram bits
#: How many of each character of COUNTED, then of all others together, have bits of their own: 384, as texts of these lengths hold them.
OWN = dict.fromkeys(COUNTED, 2) | {c: n for n, some in ((32, " e"), (20, "ntiaors"), (14, "hdlu"), (10, "cmfpg"), (8, "bvwky")) for c in some}
OWN = (*map(OWN.get, COUNTED), 6)
BITS, CHARS = [f"b{k}" for k in range(WORDS)], [f"c{k}" for k in range(-(-sum(OWN) // 64))]
TRAITS = ["n", "free", *BITS, "over", *CHARS]


@dataclass
class HeadlineIndex:
    heads: DataFrame
    dealt: DataFrame

    TABLES = ("headline_heads", "headline_dealt")


def headlines(rows: DataFrame) -> DataFrame:
    """rows (id, title, created_at) with their headline; one that cleaning leaves empty is no near copy of anything."""
    return rows.select("id", "created_at", normalize_text(clean_text(F.col("title"))).alias("head")).where("head <> ''")


def described(heads: DataFrame) -> DataFrame:
    """heads with their keys, n trigrams and the bits of these and of character counts: a count of 3 sets the first three bits of
    its character. Trigrams without a bit of their own are `free`, characters without one are `over`.
    Headlines are small and this is work, so they are dealt over all tasks first."""
    out = heads.repartition(_tasks(heads)).withColumn("grams", trigrams(F.col("head"))).withColumn("keys", blocking_keys(F.col("head"), significant_tokens(F.col("head"))))
    out = out.withColumn("gram_bits", F.array_distinct(F.transform("grams", lambda g: F.pmod(F.xxhash64(g), F.lit(64 * WORDS)).cast("int")))).withColumn("counts", char_counts(F.col("head")))
    own = lambda k: F.slice(F.sequence(F.lit(sum(OWN[:k])), F.lit(sum(OWN[: k + 1]) - 1)), 1, F.get("counts", k).cast("int"))
    out = out.withColumn("char_bits", F.flatten(F.array(*map(own, range(len(OWN))))))
    bit = lambda p: F.call_function("shiftleft", F.lit(1).cast("long"), p % 64)
    word = lambda c, w: F.aggregate(c, F.lit(0).cast("long"), lambda a, p: F.when(F.shiftright(p, 6) == w, a.bitwiseOR(bit(p))).otherwise(a))
    words = [word(c, w).alias(name) for c, names in (("gram_bits", BITS), ("char_bits", CHARS)) for w, name in enumerate(names)]
    return out.select(*heads.columns, "keys", F.size("grams").alias("n"), (F.size("grams") - F.size("gram_bits")).alias("free"), (F.length("head") - F.size("char_bits")).alias("over"), *words)


def dealt(heads: DataFrame) -> DataFrame:
    """(id, n, key) of described headlines, a row a blocking key."""
    return heads.select("id", "n", F.explode("keys").alias("key"))


def indexed(heads: DataFrame) -> HeadlineIndex:
    """The index of kept headlines (id, head)."""
    own = settled(described(heads.select("id", "head")), "heads")
    return HeadlineIndex(own.select("id", "head", *TRAITS), dealt(own))


def _tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _may_match(threshold: float) -> Column:
    """What bits and lengths of x and y leave open: they share no more trigrams or characters than bits and those without one.

    The first alone fails for nearly all pairs. All is kept short, as a method of over 8,000 bytes is not compiled by the JVM."""
    both = lambda cols, rest: reduce(Column.__add__, (F.bit_count(F.col(f"x.{c}").bitwiseAND(F.col(f"y.{c}"))) for c in cols)) + F.least(f"x.{rest}", f"y.{rest}")
    size = F.col("x.len") + F.col("y.len")
    return (both(BITS, "free") >= F.greatest("x.need", "y.need")) & (2 * both(CHARS, "over") >= size * F.lit(threshold - 1e-9))


def _blocks(rows: DataFrame, keys: DataFrame, heads: DataFrame, of: str, threshold: float) -> DataFrame:
    """The headlines behind rows (id, key) of the given keys, with the block that each is in for its key."""
    need = F.ceil(GATE * threshold * F.col("n") - F.lit(1e-9)).cast("int")
    sure = lambda c: F.coalesce(c, F.lit(0)).alias(c)  # noqa: E731 - never null, which the join then need not test
    own = heads.withColumns({"need": need, "len": F.length("head")})
    met = rows.select("id", "key").join(keys, "key").join(own.select("id", "created_at", "head", *map(sure, ("need", "len", "free", *BITS, "over", *CHARS))), "id")
    return met.withColumn("block", F.pmod(F.xxhash64("id"), F.col(of)))


def _near(x: DataFrame, dealt_x: DataFrame, threshold: float, y: DataFrame | None = None, dealt_y: DataFrame | None = None) -> DataFrame:
    """(id, before): near copies among headlines x, the later one first, or of x and headlines y before all of them.

    Both described, with created_at. A key other than the start is dealt only where headlines of several starts hold it, and tells
    of pairs of different starts only: those of one start meet there."""
    start = F.substring("head", 1, START)
    held = lambda d, own, n: d.join(own.select("id", start.alias("start")), "id").groupBy("key").agg(F.count("*").alias(n), F.min("start").alias(f"low_{n}"), F.max("start").alias(f"high_{n}"))
    blocks = lambda n: F.least(F.lit(MOST), F.ceil(F.col(n) / HOT)).cast("bigint")
    to = lambda low, high: F.explode(F.sequence(low, high))
    by_start = F.startswith("key", F.lit("p:"))
    if y is None:
        keys = held(dealt_x, x, "nx").where(F.col("nx") > 1).where(by_start | (F.col("low_nx") < F.col("high_nx"))).select("key", blocks("nx").alias("px"))
        rows = _blocks(dealt_x, settled(keys, "keys"), x, "px", threshold)
        left = rows.withColumn("i", F.col("block")).withColumn("j", to(F.col("block"), F.col("px") - 1))
        right = rows.withColumn("j", F.col("block")).withColumn("i", to(F.lit(0).cast("bigint"), F.col("block")))
        once = (F.col("i") < F.col("j")) | (F.col("x.id") < F.col("y.id"))
    else:
        keys = held(dealt_x, x, "nx").join(held(dealt_y, y, "ny"), "key")
        several = F.least("low_nx", "low_ny") < F.greatest("high_nx", "high_ny")
        keys = settled(keys.where(by_start | several).select("key", blocks("nx").alias("px"), blocks("ny").alias("py")), "keys")
        left = _blocks(dealt_x, keys, x, "px", threshold).withColumn("i", F.col("block")).withColumn("j", to(F.lit(0).cast("bigint"), F.col("py") - 1))
        right = _blocks(dealt_y, keys, y, "py", threshold).withColumn("j", F.col("block")).withColumn("i", to(F.lit(0).cast("bigint"), F.col("px") - 1))
        once = F.lit(True)
    # a fixed number of tasks: adaptive execution would merge them by bytes, and these are few to the pairs they form
    spread = lambda d: d.drop("block", "px", "py").repartition(4 * _tasks(x), "key", "i", "j")
    met = spread(left).alias("x").join(spread(right).alias("y"), ["key", "i", "j"]).where(once & _may_match(threshold))
    early = F.struct("x.created_at", "x.id") < F.struct("y.created_at", "y.id") if y is None else F.lit(False)
    later = lambda c: F.when(early, F.col(f"y.{c}")).otherwise(F.col(f"x.{c}"))
    former = lambda c: F.when(early, F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
    met = met.select(later("id").alias("id"), former("id").alias("before"), later("head").alias("hx"), former("head").alias("hy"), F.when(by_start, 0).otherwise(START).alias("apart"))
    return met.where(near_copy(GATE * threshold, threshold)("hx", "hy", "apart")).select("id", "before")


def duplicates(rows: DataFrame, threshold: float = 0.92, index: HeadlineIndex | None = None) -> tuple[DataFrame, HeadlineIndex]:
    """(ids of rows whose headline is a near copy of a kept earlier one, index rows of the headlines that are kept).

    Rows come in the order of created_at, then id, behind everything that the index holds; those of the index are kept
    whatever comes. Equal headlines are copies of the first of them. The ratio takes the later headline first.
    rows: id, title, created_at.
    """
    heads = headlines(rows)
    first = heads.groupBy("head").agg(F.min(F.struct("created_at", "id")).alias("first"))
    copies = heads.join(first, "head").where(F.col("id") != F.col("first.id")).select("id")
    own = settled(described(first.select(F.col("first.id").alias("id"), F.col("first.created_at").alias("created_at"), "head")), "heads")
    keys = dealt(own)
    edges = settled(_near(own, keys, threshold), "near")
    stored = None
    if index:
        same = own.join(index.heads.select("head"), "head", "left_semi").select("id")
        found = _near(own, keys, threshold, index.heads.withColumn("created_at", F.lit(None).cast("timestamp")), index.dealt)
        stored = settled(found.select("id").unionByName(same).distinct(), "near-stored")
        edges = edges.join(stored, "id", "left_anti").join(stored.select(F.col("id").alias("before")), "before", "left_anti")
    gone = greedy_dropped(edges)
    gone = gone if stored is None else gone.unionByName(stored)
    # a copy goes whether its first one is kept or goes, which it then does for a headline before both
    out = settled(gone.unionByName(copies).distinct(), "duplicates")
    kept = own.join(out, "id", "left_anti")
    return out, HeadlineIndex(kept.select("id", "head", *TRAITS), keys.join(out, "id", "left_anti"))
