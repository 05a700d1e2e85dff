"""Operator 6: packing token pieces into sequences by bin completion.

A document's tokens, closed by an end id, form one piece, or several of exactly `capacity` tokens with a shorter first
one. The packing problem depends on how many pieces there are of each length only, so a table of at most `capacity`
rows goes to the driver, which solves it once for the whole corpus. The answer is a list of fillings with
multiplicities; pieces of a length are numbered in Spark and meet their filling in a join.

Defined results. A null or empty text is the end id alone; `<|endoftext|>` in a text is one token. Repeated rows are
packed each, and of equal pieces any may take any of their places. An empty table gives an empty
result. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, partitions

PIECES = "doc_id {id}, piece int, start long, length long, ids_crc32 long"
_ENCODERS: dict[str, object] = {}
#: Fixed value: the token that the vocabulary's JSON form adds.
ADDED = {"<|endoftext|>": 50256}


def encoder(path: str, pattern: str, special: dict[str, int]):
    """The byte-level BPE vocabulary at path (token and id a line), with ids equal to those of its JSON form.

    tiktoken applies the same merges as the JSON file's library about seven times as fast; the JSON form's added token
    is cut out of a text before the rest is split, in both.
    """
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _ENCODERS[path]


def public_vocabulary() -> tuple[str, str, dict[str, int]]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ADDED


def token_pieces(docs: DataFrame, capacity: int, end_id: int, vocabulary: tuple[str, str, dict[str, int]]) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of docs."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(*vocabulary)
        for batch in batches:
            row, piece, begin, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text")):
                ids = np.r_[code.encode_to_numpy(text.as_py() or "", allowed_special="all", disallowed_special=()), end_id].astype("<u4")
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    row.append(i)
                    piece.append(k)
                    begin.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(begin, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(pieces, PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()))


# A filling is a tuple of (size, copies), largest first; a solution is a list of (filling, bins).


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple, int]]:
    """Best-fit decreasing on counts: bins that hold the same are one class, so the work doesn't grow with the items."""
    open_: dict[int, list] = {}  # room left -> [filling, bins]
    for s in sorted(counts, reverse=True):
        c = counts[s]
        while c:
            room = min((r for r in open_ if r >= s), default=0)
            if not room:
                q = capacity // s
                for copies, bins in ((q, c // q), (c % q, 1)):
                    if copies and bins:
                        open_.setdefault(capacity - copies * s, []).append([((s, copies),), bins])
                break
            filling, bins = open_[room].pop()
            k = min(bins, c)
            if k < bins:
                open_[room].append([filling, bins - k])
            if not open_[room]:
                del open_[room]
            more = (*filling[:-1], (s, filling[-1][1] + 1)) if filling[-1][0] == s else (*filling, (s, 1))
            open_.setdefault(room - s, []).append([more, k])
            c -= k
    return [(f, n) for classes in open_.values() for f, n in classes]


def completions(counts: dict[int, int], capacity: int, waste: int, limit: int, width: int) -> list[tuple[int, tuple]]:
    """(waste, filling) around the largest size, least waste first, none above `waste`, at most `width` of them.

    Fillings into which one more item fits are dominated and left out, as is any filling when a single item would fill
    the room exactly. `limit` bounds the search steps.
    """
    sizes = sorted(counts, reverse=True)
    s, room = sizes[0], capacity - sizes[0]
    left = {**counts, s: counts[s] - 1}
    sizes = [x for x in sizes if left[x] and x <= room]
    if not sizes:
        return [(room, ((s, 1),))] if room <= waste else []
    if left.get(room):
        return [(0, ((s, 2),) if room == s else ((s, 1), (room, 1)))]
    found, steps = {}, 0
    smallest = sizes[-1]
    stack: list[tuple[int, int, tuple]] = [(0, room, ())]
    while stack and steps < limit:
        i, r, taken = stack.pop()
        steps += 1
        while i < len(sizes) and sizes[i] > r:
            i += 1
        if i == len(sizes):
            used = dict(taken)
            if r <= waste and not any(used.get(x, 0) < left[x] for x in sizes if x <= r):
                found[taken] = r
                if r == 0 and sum(w == 0 for w in found.values()) >= width:
                    break
            continue
        x = sizes[i]
        if left.get(r) and r <= x and not dict(taken).get(r):
            found[(*taken, (r, 1))] = 0
            if sum(w == 0 for w in found.values()) >= width:
                break
            continue
        if r - waste <= 0 or smallest <= r:
            stack.append((i + 1, r, taken))
        for k in range(1, min(left[x], r // x) + 1):
            stack.append((i + 1, r - k * x, (*taken, (x, k))))
    out = []
    for taken, w in found.items():
        whole = {s: 1}
        for x, k in taken:
            whole[x] = whole.get(x, 0) + k
        out.append((w, tuple(sorted(whole.items(), reverse=True))))
    return sorted(out, key=lambda f: (f[0], [(-x, -k) for x, k in f[1]]))[:width]


def bin_completion(counts: dict[int, int], capacity: int, limit: int = 4000, width: int = 4, nodes: int = 6000) -> list[tuple[tuple, int]]:
    """Depth-first branch and bound over fillings of the largest item.

    The best-fit solution is the first incumbent. A branch ends when its waste exceeds what a better solution may
    waste in all; a filling is used for as many bins at once as its items allow. `nodes` bounds the search (the
    problem is NP-hard); the incumbent is always a whole solution.
    """
    counts = {s: c for s, c in counts.items() if c}
    total = sum(s * c for s, c in counts.items())
    least = -(-total // capacity)
    best = best_fit(counts, capacity)
    bins = sum(n for _, n in best)
    path: list[tuple[tuple, int]] = []
    used = wasted = 0

    def options(now: dict[int, int]) -> list[tuple[int, tuple]]:
        return completions(now, capacity, (bins - 1) * capacity - total - wasted, limit, width)[::-1]

    stack = [(counts, options(counts))] if counts and bins > least else []
    while stack and nodes and bins > least:
        now, todo = stack[-1]
        if not todo:
            stack.pop()
            if path and stack:
                f, n = path.pop()
                used -= n
                wasted -= n * (capacity - sum(x * k for x, k in f))
            continue
        waste, filling = todo.pop()
        nodes -= 1
        room = (bins - 1) * capacity - total - wasted
        n = min(now[x] // k for x, k in filling)
        n = min(n, room // waste) if waste else n
        if n < 1:
            continue
        after = dict(now)
        for x, k in filling:
            after[x] -= n * k
            if not after[x]:
                del after[x]
        path.append((filling, n))
        used += n
        wasted += n * waste
        if not after:
            if used < bins:
                best, bins = list(path), used
        elif used + -(-sum(x * c for x, c in after.items()) // capacity) < bins:
            stack.append((after, options(after)))
            continue
        path.pop()
        used -= n
        wasted -= n * waste
    return best


def pack(docs: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: tuple[str, str, dict[str, int]] | None = None) -> DataFrame:
    """A row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = cut(token_pieces(docs, capacity, end_id, vocabulary or public_vocabulary()), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots, first, taken = [], 0, dict.fromkeys(counts, 0)
    for filling, bins in sorted(bin_completion(counts, capacity), reverse=True):
        at = 0
        for size, copies in filling:
            slots.append((size, taken[size], taken[size] + bins * copies, first, copies, at))
            taken[size] += bins * copies
            at += size * copies
        first += bins
    slots = spark.createDataFrame(slots, "_size long, _lo long, _hi long, _first long, _each int, _at long")
    # number the pieces of each length: within salted groups, behind the groups before
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4 * partitions(spark))))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_past"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("_rank", F.row_number().over(within) - 1).join(groups, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_rank") + F.col("_past"))
    # slots has a few rows for each length up to the capacity, however many documents there are
    placed = ranked.join(F.broadcast(slots), (F.col("length") == F.col("_size")) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi")))
    nth = F.col("_rank") - F.col("_lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_first") + F.floor(nth / F.col("_each"))).cast("long").alias("sequence_id"),
        (F.col("_at") + (nth % F.col("_each")) * F.col("length")).cast("long").alias("offset"),
    )


def op6(docs: DataFrame) -> DataFrame:
    return pack(docs)
