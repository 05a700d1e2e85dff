"""Operator 4: repeated passages by distributed prefix doubling.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Strings get ranks, at 64, 128 and
`length` bytes; the rank at a greater length is that of the pair of ranks at a position and at an offset further on. Each
round Spark sorts the pairs of the positions that are left, and one whose rank is unique takes no part in the next.

1. 64 bytes. A string of `length` bytes is represented by the position, among its first 128, whose 64-byte rank is
   smallest; equal strings choose the same. So one position in about 65 is ranked, and strings represented by a unique
   one are unique. The same holds for the last 128 positions, so every window of 191 bytes of a text sends its
   representative, those in the last bytes of the text too.
2. 128 bytes: pairs at offset 64, from the representative on and up to its end. A string of `length` bytes holds one of
   the two in whole, so it is unique if that is.
3. `length` bytes: pairs of 128-byte ranks at offset length - 128, for all strings whose representatives are left. They
   travel as the bytes around their representative, dealt by its pair, so equal ones meet; equal stretches that a task
   holds several times (near copies) travel once with the list of their places. A task ranks and sorts them and
   compares the bytes of those with equal ranks.
4. The repeated strings of each text are merged into spans and cut out.

Texts that occur more than once are one text here: with `length` bytes or more they go whole, and they take part as a
source for others once. In rounds 1 and 2 a rank that very many positions share is spread over tasks; in round 3 equal
stretches are brought together before the shuffle, but the stretches around one representative meet in one task.

Defined results. A null text is empty. Texts shorter than `length` lose nothing. Repeated rows, whatever their ids, are
copies. Very long texts are ranked whole, in some 60 bytes of memory a byte. An empty table gives an empty result. Extra
columns stay; one named like a result column is replaced. Whole texts are told apart by 64-bit hashes; ranks only sort
out, as the bytes decide in round 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, spread_join

_U = np.uint64
_RANK = np.random.default_rng(4).integers(1, 1 << 63, 256, dtype=np.uint64)
GRAM, SPAN = 64, 128
WINDOW = GRAM + SPAN - 1  # bytes that decide a representative
CHUNK_BYTES = 400_000
RESULT = ("n_bytes", "n_removed", "n_spans", "kept")


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of a pair of ranks."""
    h = (a ^ (b * _U(0x9E3779B97F4A7C15))) * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(31)
    h += b
    return h * _U(0x94D049BB133111EB) ^ (h >> _U(27))


def ranks(raw: np.ndarray, length: int) -> np.ndarray:
    """Rank of the `length` bytes from each position of raw; shorter by length - 1."""
    h, n = _RANK[raw], 1
    while 2 * n <= length:
        h, n = _pair(h[:-n], h[n:]), 2 * n
    return _pair(h[: -(length - n)], h[length - n :]) if n < length else h


def representatives(raw: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts raw[bounds[i]:bounds[i + 1]]: starts of all strings of `length` bytes inside a text, the
    representative of the window from each position, and the ranks of GRAM bytes by position."""
    gram = ranks(raw, GRAM)
    best, n = np.arange(len(gram), dtype=np.int32), 1
    value = gram
    while n < SPAN:
        later = value[n:] < value[:-n]
        best = np.where(later, best[n:], best[:-n])
        value = np.where(later, value[n:], value[:-n])
        n *= 2
    size = np.maximum(np.diff(bounds) - length + 1, 0)
    start = np.repeat(bounds[:-1] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
    return start, best, gram


def _texts(batch: pa.RecordBatch, least: int, seen: set[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]]:
    """Long enough texts of a batch, each node once: (bytes, bounds, nodes, rows) in groups of about CHUNK_BYTES."""
    own, node, rows, size = [], [], [], 0

    def done():
        return np.frombuffer(b"".join(own), dtype=np.uint8), np.cumsum([0, *map(len, own)]), np.array(node, dtype=np.int64), rows

    nodes = batch.column("node").to_pylist()
    for i, x in enumerate(batch.column("text")):
        t = (x.as_py() or "").encode()
        if len(t) < least or seen is not None and nodes[i] in seen:
            continue
        if seen is not None:
            seen.add(nodes[i])
        own.append(t)
        node.append(nodes[i])
        rows.append(i)
        size += len(t)
        if size >= CHUNK_BYTES:
            yield done()
            own, node, rows, size = [], [], [], 0
    if own:
        yield done()


def _packed(bucket: np.ndarray, node: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows (bucket, nodes, counts, ...): the values of each bucket packed, runs of a node counted."""
    order = np.lexsort((node, bucket))
    bucket, node = bucket[order], node[order]
    first = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (node[1:] != node[:-1])]) if len(node) else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, len(node)]).astype("<u4")
    head = np.flatnonzero(np.r_[True, bucket[first][1:] != bucket[first][:-1]]) if len(first) else first
    stop = np.r_[head[1:], len(first)]
    lo, hi = first[head] if len(head) else head, np.r_[first, len(node)][stop] if len(head) else head
    arrays = [pa.array(bucket[lo], pa.int64())]
    arrays.append(pa.array([node[first[a:b]].astype("<i8").tobytes() for a, b in zip(head, stop, strict=len(head) > 0)], pa.binary()))
    arrays.append(pa.array([count[a:b].tobytes() for a, b in zip(head, stop, strict=len(head) > 0)], pa.binary()))
    for v in columns.values():
        v = v[order]
        arrays.append(pa.array([v[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", "nodes", "counts", *columns])


def _nodes(group: pa.Table) -> np.ndarray:
    pairs = zip(group.column("nodes").to_pylist(), group.column("counts").to_pylist(), strict=True)
    return np.concatenate([np.repeat(np.frombuffer(n, "<i8"), np.frombuffer(c, "<u4")) for n, c in pairs])


def _values(group: pa.Table, name: str, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(name).to_pylist()), dtype)


def _by_node(node: np.ndarray, buckets: int) -> np.ndarray:
    return (node.view(np.uint64) * _U(0x9E3779B97F4A7C15) >> _U(33)).astype(np.int64) % buckets


def _deal(length: int):
    """Texts -> the representatives of their windows with their ranks at 64 bytes."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for raw, bounds, nodes, _ in _texts(batch, length, seen):
                start, best, gram = representatives(raw, bounds, WINDOW)
                at = np.unique(best[start])
                text = np.searchsorted(bounds, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(gram[at].view(np.int64)), pa.array(nodes[text]), pa.array((at - bounds[text]).astype(np.int32))], names=["rank", "node", "pos"])

    return deal


def _known(batch: pa.RecordBatch, rows: list[int], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of some rows of a batch, and the text that each is in."""
    places = batch.column("places")
    offsets, values = places.offsets.to_numpy(), places.values.to_numpy()
    own = [values[offsets[r] : offsets[r + 1]].astype(np.int64) for r in rows]
    return np.concatenate(own), np.repeat(np.arange(len(rows)), [len(x) for x in own])


def _double(length: int):
    """Texts with the representatives that are left -> pairs of ranks at offset GRAM, after (side 1) and before (side 0) each."""

    def double(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for raw, bounds, nodes, rows in _texts(batch, length, seen):
                gram = ranks(raw, GRAM)
                pos, text = _known(batch, rows, bounds)
                for side in (0, 1):
                    at = bounds[text] + pos - (0 if side else GRAM)
                    ok = (at >= bounds[text]) & (at + 2 * GRAM <= bounds[text + 1])
                    n = int(ok.sum())
                    arrays = [gram[at[ok]].view(np.int64), gram[at[ok] + GRAM].view(np.int64), nodes[text[ok]], pos[ok].astype(np.int32), np.full(n, side, np.int32)]
                    yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), names=["rank", "further", "node", "pos", "side"])

    return double


def _repeated(ranked: DataFrame, key: list[str], start) -> DataFrame:
    """The rows of a round whose rank occurs at two different places (node, start) at least."""
    place = F.xxhash64("node", start)
    held = ranked.groupBy(*key).agg(F.count("*").alias("_n"), F.min(place).alias("_a"), F.max(place).alias("_b")).where("_a <> _b")
    return spread_join(ranked, held.select(*key, "_n"), key, "_n", ranked.count()).drop("_n")


def _stretches(length: int, buckets: int):
    """Texts with their repeated pairs (places 2 * pos + side) -> the bytes of the strings that each of them represents."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for raw, bounds, nodes, rows in _texts(batch, length, seen):
                held: dict[bytes, list[tuple[int, int]]] = {}
                where: dict[bytes, int] = {}
                start, best, gram = representatives(raw, bounds, length)
                known, text = _known(batch, rows, bounds)
                left = np.zeros((2, len(raw)), dtype=bool)
                left[known % 2, bounds[text] + known // 2] = True

                def pair(rep: np.ndarray, start: np.ndarray) -> np.ndarray:
                    """The side on which the pair of a representative lies in the string from start."""
                    return (rep + 2 * GRAM <= start + length).astype(np.int64)

                rep, second = best[start].astype(np.int64), best[start + length - WINDOW].astype(np.int64)
                side = pair(rep, start)
                ok = left[side, rep] & left[pair(second, start), second]
                start, rep, side = start[ok], rep[ok], side[ok]
                if not len(start):
                    continue
                head = np.flatnonzero(np.r_[True, (rep[1:] != rep[:-1]) | (side[1:] != side[:-1]) | (start[1:] != start[:-1] + 1)])
                last = np.r_[head[1:], len(start)] - 1
                text = np.searchsorted(bounds, start[head], side="right") - 1
                at = rep[head] - GRAM * (1 - side[head])
                rank = (_pair(gram[at], gram[at + GRAM]) % _U(buckets)).astype(np.int64)
                whole = raw.tobytes()
                for a, b, r, t in zip(start[head].tolist(), start[last].tolist(), rank.tolist(), text.tolist(), strict=True):
                    content = whole[a : b + length]
                    held.setdefault(content, []).append((int(nodes[t]), a - int(bounds[t])))
                    where[content] = r
                contents = list(held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([where[c] for c in contents], pa.int64()), pa.array(contents, pa.binary()), pa.array([np.array(held[c], dtype="<i8").tobytes() for c in contents], pa.binary())],
                    names=["bucket", "content", "places"],
                )

    return stretches


def _same_bytes(raw: np.ndarray, pos: np.ndarray, lead: np.ndarray, length: int) -> bool:
    """Whether the strings at pos equal those at lead. One that follows its neighbour, as lead does, differs in a byte only."""
    chain = np.r_[False, (pos[1:] == pos[:-1] + 1) & (lead[1:] == lead[:-1] + 1)] & (pos != lead)
    if (raw[pos + length - 1] != raw[lead + length - 1]).any():
        return False
    whole, span = np.flatnonzero(~chain & (pos != lead)), np.arange(length)
    return all((raw[pos[i][:, None] + span] == raw[lead[i][:, None] + span]).all() for i in np.split(whole, range(4096, len(whole), 4096)))


def _matches(length: int, buckets: int):
    """Stretches that may hold equal strings -> repeated strings as spans of their texts, dealt by text."""

    def matches(key: tuple, group: pa.Table) -> pa.Table:
        merged: dict[bytes, set[tuple[int, int]]] = {}
        for content, places in zip(group.column("content"), group.column("places"), strict=True):
            merged.setdefault(content.as_py(), set()).update(map(tuple, np.frombuffer(places.as_py(), "<i8").reshape(-1, 2).tolist()))
        contents = list(merged)
        raw = np.frombuffer(b"".join(contents), dtype=np.uint8)
        bounds = np.cumsum([0, *map(len, contents)])
        size = np.diff(bounds) - length + 1
        owner = np.repeat(np.arange(len(contents)), size)
        start = np.arange(size.sum()) - np.repeat(np.r_[0, np.cumsum(size)[:-1]], size)
        pos = bounds[owner] + start
        half, offset = ranks(raw, 2 * GRAM), length - 2 * GRAM
        name = _pair(half[pos], half[pos + offset])
        for exact in (False, True):
            if exact:  # different bytes had one rank: name strings by their bytes
                ids: dict[bytes, int] = {}
                name = np.array([ids.setdefault(raw[p : p + length].tobytes(), len(ids)) for p in pos.tolist()])
            order = np.argsort(name, kind="stable")
            first = np.flatnonzero(np.r_[True, name[order][1:] != name[order][:-1]])
            count = np.diff(np.r_[first, len(order)])
            lead = np.empty(len(pos), dtype=np.int64)
            lead[order] = np.repeat(pos[order[first]], count)
            if _same_bytes(raw, pos, lead, length):
                break
        times = np.array([len(merged[c]) for c in contents])
        total = np.repeat(np.add.reduceat(times[owner[order]], first), count)
        again = np.empty(len(name), dtype=bool)
        again[order] = total > 1
        owner, start = owner[again], start[again]
        head = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)]) if len(owner) else np.zeros(0, np.int64)
        last = np.r_[head[1:], len(owner)] - 1 if len(owner) else head
        node, lo, hi = [], [], []
        for c, a, b in zip(owner[head].tolist(), start[head].tolist(), start[last].tolist(), strict=True):
            for n, p in merged[contents[c]]:
                node.append(n)
                lo.append(p + a)
                hi.append(p + b + length)
        node = np.array(node, dtype=np.int64)
        span = np.array(lo, dtype=np.uint64) << _U(32) | np.array(hi, dtype=np.uint64)
        return pa.Table.from_batches([_packed(_by_node(node, buckets), node, {"pos": span.astype("<u8")})])

    return matches


def _spans(key: tuple, group: pa.Table) -> pa.Table:
    """The spans of each text, merged where they overlap or touch."""
    node, span = _nodes(group), _values(group, "pos", "<u8")
    order = np.lexsort((span, node))
    node, lo, hi = node[order], (span[order] >> _U(32)).astype(np.int64), (span[order] & _U(0xFFFFFFFF)).astype(np.int64)
    out: dict[int, list[list[int]]] = {}
    for n, a, b in zip(node.tolist(), lo.tolist(), hi.tolist(), strict=True):
        own = out.setdefault(n, [])
        if own and a <= own[-1][1]:
            own[-1][1] = max(own[-1][1], b)
        else:
            own.append([a, b])
    return pa.table({"node": pa.array(list(out), pa.int64()), "spans": pa.array([np.array(v, dtype="<u4").tobytes() for v in out.values()], pa.binary())})


def _small(df: DataFrame, size, limit: int) -> DataFrame:
    """df for a join with the texts: sent to all tasks where its size, checked here, allows; else the join deals both sides."""
    total = df.agg(F.sum(size + 16)).first()[0] or 0
    return F.broadcast(df) if total <= limit else df


def repeated_spans(docs: DataFrame, length: int = 200, broadcast_bytes: int = 64_000_000, bucket_bytes: int = 4_000_000) -> DataFrame:
    """(node, spans, copies): node = xxhash64 of a text; spans of its repeated bytes as packed pairs; copies for a text that occurs again."""
    if length < WINDOW:
        raise ValueError(f"length must be {WINDOW} bytes at least")
    text = F.coalesce("text", F.lit(""))
    texts = docs.select(text.alias("text"), F.xxhash64(text).alias("node"))
    whole = cut(texts.groupBy("node").agg(F.count("*").alias("n"), F.max(F.octet_length("text")).alias("size")).where(F.col("size") >= length), "texts")

    def asked(places: DataFrame, place) -> tuple[DataFrame, int]:
        """The texts that still have places, with those."""
        per = cut(places.groupBy("node").agg(F.collect_set(place).alias("places")), "places")
        n = per.agg(F.sum(F.size("places"))).first()[0] or 0
        return texts.join(_small(per, 4 * F.size("places"), broadcast_bytes), "node").select("node", "text", "places"), n

    ranked = cut(texts.mapInArrow(_deal(length), "rank long, node long, pos int"), "ranks-64")
    left, _ = asked(_repeated(ranked, ["rank"], F.col("pos")), F.col("pos"))
    ranked = cut(left.mapInArrow(_double(length), "rank long, further long, node long, pos int, side int"), "ranks-128")
    left, n = asked(_repeated(ranked, ["rank", "further"], F.col("pos") + GRAM * F.col("side")), 2 * F.col("pos") + F.col("side"))
    share = max(1, int(n * 270 // bucket_bytes))
    stretches = left.mapInArrow(_stretches(length, share), "bucket long, content binary, places binary")
    found = stretches.groupBy("bucket").applyInArrow(_matches(length, share), "bucket long, nodes binary, counts binary, pos binary")
    spans = found.groupBy("bucket").applyInArrow(_spans, "node long, spans binary")
    copies = whole.where("n > 1").select("node", F.lit(True).alias("copies"))
    return cut(spans.join(copies, "node", "full").select("node", F.coalesce("spans", F.lit(b"")).alias("spans"), F.coalesce("copies", F.lit(False)).alias("copies")), "spans")


def remove_repeats(docs: DataFrame, length: int = 200, broadcast_bytes: int = 64_000_000) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (the remaining bytes, which may cut a character)."""
    spans = repeated_spans(docs, length, broadcast_bytes).withColumnRenamed("node", "_node")
    docs = docs.drop(*RESULT)
    text = F.coalesce("text", F.lit(""))

    @F.pandas_udf("n_removed long, n_spans long, kept binary")
    def without(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, s in zip(texts, spans, strict=True):
            raw, at, removed, kept = t.encode(), 0, 0, []
            pairs = np.frombuffer(s, "<u4").reshape(-1, 2).tolist()
            for a, b in pairs:
                kept.append(raw[at:a])
                removed += b - a
                at = b
            rows.append((removed, len(pairs), b"".join([*kept, raw[at:]])))
        return pd.DataFrame(rows, columns=["n_removed", "n_spans", "kept"])

    joined = docs.join(_small(spans, F.length("spans"), broadcast_bytes), F.xxhash64(text) == F.col("_node"), "left")
    gone, some = F.coalesce("copies", F.lit(False)), F.length(F.coalesce("spans", F.lit(b""))) > 0
    own = F.when(some & ~gone, text).otherwise(F.lit(""))
    joined = joined.withColumn("_w", without(own, F.when(some & ~gone, F.col("spans")).otherwise(F.lit(b""))))
    size = F.octet_length(text).cast("long")
    return joined.select(
        *docs.columns, size.alias("n_bytes"),
        F.when(gone, size).when(some, F.col("_w.n_removed")).otherwise(0).cast("long").alias("n_removed"),
        F.when(gone, 1).when(some, F.col("_w.n_spans")).otherwise(0).cast("long").alias("n_spans"),
        F.when(gone, F.lit(b"")).when(some, F.col("_w.kept")).otherwise(text.cast("binary")).alias("kept"),
    )


def op4(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[str | None], length: int = 200) -> list[tuple[int, int, int, str]]:
    """(n_bytes, n_removed, n_spans, kept_sha256) by a table of all strings; for tests."""
    raw = [(t or "").encode() for t in texts]
    starts: dict[bytes, int] = {}
    for t in raw:
        for p in range(len(t) - length + 1):
            starts[t[p : p + length]] = starts.get(t[p : p + length], 0) + 1
    out = []
    for t in raw:
        gone = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if starts[t[p : p + length]] > 1:
                gone[p : p + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out
