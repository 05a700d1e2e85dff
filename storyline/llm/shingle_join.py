"""Operator 2: n-gram Jaccard join with signature trees.

Two documents link when their sets of distinct 5-word shingles have a Jaccard similarity of at least 0.75. The join is
exact, in these steps:

1. One scan gives each document its set size and the fingerprint of its set; documents with equal sets are one node.
2. Routing. Shingles are dealt by a shorter hash with the node that holds them, packed in arrays; one that no other node
   has is dropped there. A node needs a partner for at least 75 % of its shingles, less those that fell together by the
   shorter hash, so no link is lost to it and most nodes end here. Of the rest,
   two that link must share one of their rarest shingles (the prefix rule, with a global order by rarity class and
   hash); sharing one makes them neighbours, and connected neighbours form a cluster. No pair is listed: a shingle
   contributes an edge from each holder to its smallest.
3. Each cluster builds a signature tree: a leaf is a node's bitmap of shingle hashes, an inner node the OR of its
   children's bitmaps with the range of their sizes and the most shingles that share a bit. A dual traversal from the
   root against itself drops pairs of subtrees whose largest possible overlap is too small for their sizes, and pairs
   that are one component already; what is left is checked on the sets.
   A cluster above `block` nodes is cut into blocks, joined within, then by one node of each component and block, and
   last every node outside the cluster's largest component meets the blocks that hold one of its prefix tokens. So a
   huge group of near copies is linked in linear work, and only what stays apart meets others.
4. Links are reduced to spanning edges in the tasks; components over them give component_id.

Defined results. A document of one to four words has its whole sequence as only shingle; one without words has an empty
set and is its own component. Repeated rows, and copies, are one node, and each row is returned. Rows with a null
doc_id link as others do; the null is left out of the minimum, so a component of such rows only has a null id. Very long
texts are hashed slice by slice. An empty table gives an empty result. Extra columns are not read. Shingles and sets are
told apart by 64-bit hashes; with 1e9 different texts the chance that any two sets are mistaken for one is 3 %.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, cut, spread_join

SHINGLE = 5
CHUNK_BYTES = 400_000  # texts are hashed in groups of this size, a longer text in slices of it
_U = np.uint64
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
_BASE, _BACK = _U(0x9E3779B97F4A7C15), _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_GAP = re.compile(rb"[ \t-\r]")
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def mix(h: np.ndarray, salt: int = 0xBF58476D1CE4E5B9) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(salt)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.r_[_U(1), np.full(n, base, dtype=np.uint64)])


def _words(raw: np.ndarray, powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of raw."""
    edge = np.flatnonzero(np.diff(np.r_[True, _SPACE[raw], True].astype(np.int8)))
    start, stop = edge[0::2], edge[1::2]
    up, down = powers if len(raw) < len(powers[0]) else (_powers(_BASE, len(raw)), _powers(_BACK, len(raw)))
    sums = np.r_[_U(0), np.cumsum(_BYTE[_LOWER[raw]] * up[: len(raw)])]
    return mix((sums[stop] - sums[start]) * down[start] + (stop - start).astype(np.uint64)), start


def shingle_sets(texts: list[bytes], n_words: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; white space and letter case of A-Z don't count."""
    whole = b" ".join(texts)
    ends = np.cumsum([len(t) + 1 for t in texts])
    cuts = [0]
    while cuts[-1] < len(whole):
        gap = _GAP.search(whole, min(len(whole), cuts[-1] + CHUNK_BYTES))
        cuts.append(gap.start() if gap else len(whole))
    most = min(len(whole), CHUNK_BYTES + 4096)
    powers = _powers(_BASE, most), _powers(_BACK, most)
    parts = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own, at = _words(np.frombuffer(whole, dtype=np.uint8, count=b - a, offset=a), powers)
        parts.append((own, at + a))
    word, start = (np.concatenate(p) for p in zip(*parts, strict=True))
    last = np.searchsorted(start, ends)  # past the last word of each text
    grams = word[: max(0, len(word) - n_words + 1)].copy()
    for j in range(1, n_words):
        grams = mix(grams * _BASE + word[j : j + len(grams)])
    out, a = [], 0
    for b in last.tolist():
        if b - a >= n_words:
            out.append(np.unique(grams[a : b - n_words + 1]))
        elif b > a:
            short = np.array([b - a], dtype=np.uint64)
            for w in word[a:b]:
                short = mix(short * _BASE + w, 0xD6E8FEB86659FD93)
            out.append(short)
        else:
            out.append(np.zeros(0, dtype=np.uint64))
        a = b
    return out


def chunks(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, list[bytes]]]:
    """Whole texts of a batch in groups of at most CHUNK_BYTES, or one longer text: (position of the first, texts)."""
    own, size, at = [], 0, 0
    for i, x in enumerate(batch.column(column)):
        t = (x.as_py() or "").encode()
        if own and size + len(t) >= CHUNK_BYTES:
            yield at, own
            own, size, at = [], 0, i
        own.append(t)
        size += len(t)
    if own:
        yield at, own


def fingerprint(tokens: np.ndarray) -> int:
    if not len(tokens):
        return 0
    whole = np.array([mix(tokens).sum(dtype=np.uint64), len(tokens)], dtype=np.uint64)
    return int(mix(whole[:1] + whole[1:] * _BASE).view(np.int64)[0])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(len(s), fingerprint(s)) for _, texts in chunks(batch) for s in shingle_sets(texts)]
        size, node = zip(*found, strict=True) if found else ((), ())
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(node, pa.int64())], names=["row", "doc_id", "n_shingles", "node"])


# Arrays travel packed: per bucket one row with nodes, the tokens each needs, how many each has, and the tokens.


def _narrow(tokens: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _widen(raw: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(raw) // width, 8), dtype=np.uint8)
    out[:, :width] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


PACKED = "bucket long, nodes binary, needs binary, counts binary, tokens binary"


def _heads(*columns: np.ndarray) -> np.ndarray:
    """Where a new run of equal values starts in sorted columns; none where they are empty."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


def _pack(bucket: np.ndarray, node: np.ndarray, need: np.ndarray, token: np.ndarray, width: int) -> pa.RecordBatch:
    """Tokens with their node, dealt by bucket."""
    order = np.lexsort((node, bucket))
    bucket, node, need, token = bucket[order], node[order], need[order], token[order]
    first = np.r_[_heads(bucket, node), len(node)]  # each node's tokens in a bucket, and the end
    count = np.diff(first).astype("<u4")
    head = _heads(bucket[first[:-1]])
    rows = []
    for a, b in zip(head.tolist(), np.r_[head, len(count)][1:].tolist(), strict=True):
        at = first[a:b]
        rows.append((int(bucket[first[a]]), node[at].astype("<i8").tobytes(), need[at].astype("<u4").tobytes(), count[a:b].tobytes(), _narrow(token[first[a] : first[b]], width)))
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["bucket", "nodes", "needs", "counts", "tokens"])


def _unpack(group: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    node, need, token = [], [], []
    for n, s, c, t in zip(*[group.column(x) for x in ("nodes", "needs", "counts", "tokens")], strict=True):
        count = np.frombuffer(c.as_py(), "<u4")
        node.append(np.repeat(np.frombuffer(n.as_py(), "<i8"), count))
        need.append(np.repeat(np.frombuffer(s.as_py(), "<u4"), count))
        token.append(_widen(t.as_py(), width))
    return np.concatenate(node), np.concatenate(need), np.concatenate(token)


def _deal(buckets: int, width: int, bits: int):
    """Scan: every distinct set of a task once, its tokens (cut to `bits` bits) dealt into buckets.

    A node needs 75 % of its tokens; tokens that are one after the cut are taken off, so that no link is lost by it.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in chunks(batch):
                own = []
                for s in shingle_sets(texts):
                    f = fingerprint(s)
                    if len(s) and f not in seen:
                        seen.add(f)
                        short = np.unique(s & _U((1 << bits) - 1))
                        own.append((f, -(-3 * len(s) // 4) - (len(s) - len(short)), short))
                if own:
                    n = np.array([len(s) for *_, s in own])
                    token = np.concatenate([s for *_, s in own])
                    yield _pack((token % _U(buckets)).astype(np.int64), np.repeat(np.array([f for f, *_ in own]), n), np.repeat(np.maximum([k for _, k, _ in own], 1), n), token, width)

    return deal


def _shared(buckets: int, width: int, bits: int):
    """A bucket of tokens -> those held by two nodes at least, with their rarity class on top, dealt by node."""

    def shared(key: tuple, group: pa.Table) -> pa.Table:
        node, need, token = _unpack(group, width)
        order = np.lexsort((node, token))
        node, need, token = node[order], need[order], token[order]
        fresh = _heads(token, node)
        node, need, token = node[fresh], need[fresh], token[fresh]
        times = np.diff(np.r_[_heads(token), len(token)])
        held = np.repeat(times, times)
        keep = held > 1
        node, need, token, held = node[keep], need[keep], token[keep], held[keep]
        rank = np.minimum(np.log2(held).astype(np.uint64), _U(15)) << _U(bits) | token
        return pa.Table.from_batches([_pack((mix(node.view(np.uint64)) % _U(buckets)).astype(np.int64), node, need, rank, width)])

    return shared


def _prefix(width: int):
    """Nodes with enough shared tokens -> the tokens of which two that link must share one."""

    def prefix(key: tuple, group: pa.Table) -> pa.Table:
        node, need, token = _unpack(group, width)
        order = np.lexsort((token, node))
        node, need, token = node[order], need[order], token[order]
        first = _heads(node)
        count = np.diff(np.r_[first, len(node)])
        place = np.arange(len(node)) - np.repeat(first, count)
        keep = place < np.repeat(count - need[first].astype(np.int64) + 1, count)
        return pa.table({"token": pa.array(token[keep].view(np.int64)), "node": pa.array(node[keep])})

    return prefix


class SignatureTree:
    """Bitmaps of sets in a tree: `bits[l]`, sizes `lo[l]`..`hi[l]` and `extra[l]`, tokens beyond one a bit; level 0 holds the leaves."""

    FAN = 8

    def __init__(self, sets: list[np.ndarray], width: int):
        self.words = width // 64
        bits = np.zeros((len(sets), self.words), dtype=np.uint64)
        for row, s in zip(bits, sets, strict=True):
            at = s >> _U(12) & _U(width - 1)
            np.bitwise_or.at(row, (at >> _U(6)).astype(np.int64), _U(1) << (at & _U(63)))
        n = np.array([len(s) for s in sets])
        self.bits, self.lo, self.hi = [bits], [n], [n]
        self.extra = [n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)]
        while len(self.bits[-1]) > 1:
            at = np.arange(0, len(self.bits[-1]), self.FAN)
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], at, axis=0))
            for levels, f in ((self.lo, np.minimum), (self.hi, np.maximum), (self.extra, np.maximum)):
                levels.append(f.reduceat(levels[-1], at))

    def labels(self, label: np.ndarray) -> list[np.ndarray]:
        """The component of each subtree, -1 where it holds several."""
        out = [label]
        for level in range(1, len(self.bits)):
            at = np.arange(0, len(out[-1]), self.FAN)
            low, high = np.minimum.reduceat(out[-1], at), np.maximum.reduceat(out[-1], at)
            out.append(np.where(low == high, low, -1))
        return out


def dual_traversal(a: SignatureTree, b: SignatureTree, labels_a, labels_b, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Leaf pairs that the bounds leave; labels_x() gives the labels of now. A pair at different heights opens the higher one."""
    top_a, top_b = len(a.bits) - 1, len(b.bits) - 1
    stack = [(top_a, top_b, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    step = max(256, 2_000_000 // a.words)
    while stack:
        la, lb, i, j = stack.pop()
        if len(i) > step:
            stack.append((la, lb, i[step:], j[step:]))
            i, j = i[:step], j[:step]
        x, y = labels_a()[la][i], labels_b()[lb][j]
        ok = (x < 0) | (y < 0) | (x != y)
        ok &= (4 * a.hi[la][i] >= 3 * b.lo[lb][j]) & (4 * b.hi[lb][j] >= 3 * a.lo[la][i])
        i, j = i[ok], j[ok]
        most = np.bitwise_count(a.bits[la][i] & b.bits[lb][j]).sum(axis=1, dtype=np.int64) + np.minimum(a.extra[la][i], b.extra[lb][j])
        most = np.minimum(most, np.minimum(a.hi[la][i], b.hi[lb][j]))
        ok = 7 * most >= 3 * (a.lo[la][i] + b.lo[lb][j])
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        if la == lb == 0:
            yield (i[i < j], j[i < j]) if same else (i, j)
            continue
        open_a, open_b = la >= lb, lb >= la
        fan = np.arange(SignatureTree.FAN)
        if open_a:
            i, j = (i[:, None] * SignatureTree.FAN + fan).ravel(), np.repeat(j, SignatureTree.FAN)
            ok = i < len(a.bits[la - 1])
            i, j = i[ok], j[ok]
        if open_b:
            i, j = np.repeat(i, SignatureTree.FAN), (j[:, None] * SignatureTree.FAN + fan).ravel()
            ok = j < len(b.bits[lb - 1])
            i, j = i[ok], j[ok]
        la, lb = la - open_a, lb - open_b
        if same:
            i, j = i[i <= j], j[i <= j]
        stack.append((la, lb, i, j))


def link_sets(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray | None) -> list[tuple[int, int]]:
    """Spanning links among sets `left` (right None), or between left and right; sets of one label count as joined."""
    parent = {x: x for x in set(label.tolist())}
    links: list[tuple[int, int]] = []
    state = {"v": 0}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def check(i: int, j: int) -> None:
        x, y = root(label[i]), root(label[j])
        if x != y:
            a, b = sets[i], sets[j]
            if 4 * min(len(a), len(b)) < 3 * max(len(a), len(b)):
                return
            both = len(np.intersect1d(a, b, assume_unique=True))
            if 7 * both >= 3 * (len(a) + len(b)):
                parent[max(x, y)] = min(x, y)
                links.append((i, j))
                state["v"] += 1

    if len(left) == 0 or (right is not None and len(right) == 0):
        return links
    if right is None:
        for i, j in zip(left[:-1], left[1:], strict=True):  # neighbours share their smallest token: likely copies
            check(i, j)
    longest = max(len(sets[i]) for side in (left, right) if side is not None for i in side)
    width = min(1 << 15, max(512, 1 << int(np.ceil(np.log2(2 * longest)))))
    trees = [SignatureTree([sets[i] for i in side], width) for side in (left, right) if side is not None]
    memo: dict = {}

    def now(side: int):
        def get() -> list[np.ndarray]:
            if memo.get(side, (-1,))[0] != state["v"]:
                own = (left, right)[side]
                names, back = np.unique(label[own], return_inverse=True)
                memo[side] = (state["v"], trees[side].labels(np.array([root(x) for x in names.tolist()])[back]))
            return memo[side][1]

        return get

    same = right is None
    b, other = (trees[0], left) if same else (trees[1], right)
    for i, j in dual_traversal(trees[0], b, now(0), now(0 if same else 1), same):
        for x, y in zip(left[i].tolist(), other[j].tolist(), strict=True):
            check(x, y)
    return links


def _link_task(pdf: pd.DataFrame) -> pd.DataFrame:
    """Clusters (or one block of one, with the nodes from elsewhere that meet it) -> spanning links."""
    a, b = [], []
    for _, own in pdf.groupby("cluster", sort=False):
        sets = [np.frombuffer(t, "<u8") for t in own["tokens"]]
        node, side = own["node"].to_numpy(np.int64), own["side"].to_numpy()
        names, label = np.unique(own["cls"].to_numpy(np.int64), return_inverse=True)
        order = np.lexsort((node, [len(s) for s in sets], [int(s[0]) for s in sets]))
        left = order[side[order] == 0]
        right = order[side[order] == 1] if side.any() else None
        for i, j in link_sets(sets, label, left, right):
            a.append(node[i])
            b.append(node[j])
    return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns, the same for equal rows only; xxhash64 passes over nulls, so their places are hashed too."""
    return F.xxhash64(*docs.columns, *[F.isnull(c) for c in docs.columns])


def jaccard_components(docs: DataFrame, block: int = 2048, bucket_tokens: int = 500_000, broadcast_rows: int = 200_000) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text)."""
    out = linked_rows(docs.select("doc_id", "text"), block, bucket_tokens, broadcast_rows)
    return out.select("doc_id", "n_shingles", "component_id")


def linked_rows(docs: DataFrame, block: int = 2048, bucket_tokens: int = 500_000, broadcast_rows: int = 200_000) -> DataFrame:
    """row (its row_key), doc_id, n_shingles, component_id of every row of docs, and component, which names the
    component by a node where the set isn't empty, so also where no row has an id."""
    spark = docs.sparkSession
    docs = docs.select(row_key(docs).alias("row"), "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = cut(docs.mapInArrow(_measure, f"row long, doc_id {kind}, n_shingles long, node long"), "sets")
    some = rows.where("n_shingles > 0")
    nodes = some.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("row").alias("pick"), F.count("*").alias("_rows"))

    total, n_rows = some.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count("*")).first()
    buckets = max(1, -(-total // bucket_tokens))
    width = 6 if total < 1 << 34 else 8  # any width finds all links; a wider one forms fewer chance neighbours
    bits = 8 * width - 4
    dealt = docs.select("text").mapInArrow(_deal(buckets, width, bits), PACKED)
    shared = dealt.groupBy("bucket").applyInArrow(_shared(buckets, width, bits), PACKED)
    keys = cut(shared.groupBy("bucket").applyInArrow(_prefix(width), "token long, node long"), "prefixes")
    least = keys.groupBy("token").agg(F.min("node").alias("b"), F.count("*").alias("_n")).where("_n > 1")
    near = spread_join(keys, least, ["token"], "_n", keys.count()).select(F.col("node").alias("a"), "b").where("a <> b").distinct()
    clusters = cut(components(near).withColumnRenamed("component", "cluster"), "clusters")

    n_wanted = clusters.count()
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("_n"))
    wanted = spread_join(clusters, sizes, ["cluster"], "_n", n_wanted).join(nodes, "node")
    wanted = cut(wanted.select(F.col("pick").alias("_pick"), F.col("node").alias("_node"), "cluster", F.ceil(F.col("_n") / block).cast("int").alias("blocks")), "wanted")
    labels = spark.createDataFrame([], "node long, component long")
    if n_wanted:
        asked = F.broadcast(wanted) if n_wanted <= broadcast_rows else wanted
        picked = docs.join(asked, docs["row"] == F.col("_pick")).select("text", "_node", "cluster", "blocks")

        def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at, texts in chunks(batch):
                    part, own = batch.slice(at, len(texts)), shingle_sets(texts)
                    right = pa.array([fingerprint(s) == n for s, n in zip(own, part.column("_node").to_pylist(), strict=True)], pa.bool_())
                    yield pa.RecordBatch.from_arrays([part.column("_node"), part.column("cluster"), part.column("blocks"), pa.array([s.tobytes() for s in own], pa.binary())], names=["node", "cluster", "blocks", "tokens"]).filter(right)

        # rows that are equal throughout have one key; they are dropped here
        sets = picked.mapInArrow(tokens, "node long, cluster long, blocks int, tokens binary").dropDuplicates(["node"])
        sets = cut(sets.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "cluster-sets")
        labels = cut(_labels(sets, keys, max(1, n_wanted // 2000)), "labels")
    top = labels.join(nodes, "node").groupBy("component").agg(F.min("rep").alias("component_id"), F.count("*").alias("_n"))
    joined = spread_join(labels, top, ["component"], "_n", labels.count()).drop("_n")
    per = nodes.select("node", "rep", "_rows").join(joined, "node", "left")
    per = per.select("node", "_rows", F.coalesce("component", "node").alias("component"), F.when(F.col("component").isNull(), F.col("rep")).otherwise(F.col("component_id")).alias("component_id"))
    out = spread_join(some, per, ["node"], "_rows", n_rows).select("row", "doc_id", "n_shingles", "component", "component_id")
    alone = rows.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id"))
    return out.unionByName(alone)


def _labels(sets: DataFrame, keys: DataFrame, groups: int) -> DataFrame:
    """(node, component) of all clusters by the rounds of step 3; keys are the prefix tokens of nodes."""
    task = F.when(F.col("blocks") > 1, F.struct(F.col("cluster").alias("c"), F.col("block").alias("b"))).otherwise(F.struct(F.pmod(F.xxhash64("cluster"), F.lit(groups)).alias("c"), F.lit(-1).alias("b")))
    cols = ["node", "cluster", "tokens"]

    def run(rows: DataFrame, name: str) -> DataFrame:
        return cut(rows.groupBy("task").applyInPandas(_link_task, "a long, b long"), name)

    edges = run(sets.select(*cols, task.alias("task"), F.lit(0).alias("side"), F.col("node").alias("cls")), "links")
    labels = components(edges)
    large = sets.where("blocks > 1")
    if large.isEmpty():
        return labels
    stars = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))

    def classed() -> DataFrame:
        label = labels.withColumnRenamed("component", "_c")
        return large.join(label, "node", "left").withColumn("cls", F.coalesce("_c", "node")).drop("_c")

    # one node of each component and block; as many tasks as the cluster has blocks' worth of them
    heads = classed().groupBy("cluster", "block", "cls").agg(F.min_by(F.struct("node", "tokens"), "node").alias("h"))
    many = heads.groupBy("cluster").agg(F.ceil(F.count("*") / 4096).cast("int").alias("m"))
    heads = heads.join(F.broadcast(many), "cluster")  # clusters of more than a block only: fewer than nodes / block
    slot = F.struct(F.col("cluster").alias("c"), (F.lit(-2) - F.pmod(F.xxhash64("cls"), F.col("m")).cast("int")).alias("b"))
    more = run(heads.select("h.node", "cluster", "h.tokens", slot.alias("task"), F.lit(0).alias("side"), "cls"), "links-heads")
    if not more.isEmpty():
        stars = stars.unionByName(more)
        labels = components(stars)

    # what is not of the cluster's largest component meets the blocks that hold one of its prefix tokens
    known = cut(classed(), "classed")
    counts = known.groupBy("cluster", "cls").agg(F.count("*").alias("m"))
    largest = counts.groupBy("cluster").agg(F.max_by("cls", F.struct("m", "cls")).alias("main"))
    apart = cut(known.join(F.broadcast(largest), "cluster").where("cls <> main").drop("main", "block"), "apart")
    if apart.isEmpty():
        return labels
    asked = cut(keys.join(apart.select("node"), "node"), "apart-keys")
    where = keys.join(known.select("node", "block"), "node").groupBy("token").agg(F.collect_set("block").alias("at"))
    where = where.join(asked.groupBy("token").agg(F.count("*").alias("_n")), "token")
    meets = spread_join(asked, where, ["token"], "_n", asked.count()).select("node", F.explode("at").alias("block")).distinct()
    meets = apart.join(meets, "node")
    own = F.struct(F.col("cluster").alias("c"), F.col("block").alias("b")).alias("task")
    both = known.select(*cols, own, F.lit(0).alias("side"), "cls").unionByName(meets.select(*cols, own, F.lit(1).alias("side"), "cls"))
    more = run(both, "links-rest")
    return labels if more.isEmpty() else components(stars.unionByName(more))


def op2(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS inter FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * inter >= 75 * (a.n + b.n - inter)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id, doc_id AS seen FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen)
SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(seen) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
