"""Operator 12: the alignment of two tokenizers' tokens, with corpus-wide counts of aligned id pairs.

A byte-level BPE (A) and a piece BPE (B) cut the same bytes; wherever both end a token, a group of aligned tokens ends. The
places where either ends cut the text into stretches, each inside one token of A and one of B, and those two overlap:
the stretches are the links. Counts take two passes over the documents.

1. Tasks align their documents and keep how many of them hold each id pair linked: a partial table a task. The distinct pairs
   are dealt into shards of about 260,000; for each one task builds a minimal perfect hash (levels of bit arrays: a key
   that is alone on its bit stays there, the others try the next level; a key's index is the number of bits before
   its own). Partial tables become dense count vectors that are indexed by the hash, and those are summed in a
   tree, `FAN` at a time, until one vector a shard is left. Each shard stores its keys in that order.
2. Tasks align their documents again and look counts up by hash. Each key is held against the stored one, so an unknown
   pair is an error and never another pair's count.

Neither vocabulary joins a character with a space behind it, so both cut a text before every space that follows a character
that is neither white space nor U+2581, and such a word is aligned by itself. A process keeps the words it has aligned, up to
a bound beyond which the rarer ones go, so that a common word costs its tokenizers once and not at every place; an alignment is the sequence of its words'.

Tables go to all tasks only in turns of at most `most_shards` shards (about 16 bytes a pair); with more pairs, the
second pass takes several turns, each adding its share to the sums of a document, and nothing is left out.

Defined results. A text that is null or empty, or whose tokens' bytes do not join to space + text in both vocabularies
(U+2581 in it reads back as a space), has no tokens: zeros and an empty string. Rows are documents, so repeated
rows count each, with or without an id. Links whose counts tie for the highest of their A id are all best. An empty table gives an
empty result. Very long texts are aligned whole, at a few dozen bytes of memory a byte. Columns other than doc_id and
text are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

FAN = 16
SHARD = 1 << 18  # pairs
_SLICE = 2 << 20  # characters of text that are worked on at once, unless one text is longer
_KEPT = 24 << 20  # characters and links of aligned words that a task keeps
_ODD = re.compile(r"[\s▁] ")
_WORD_END = re.compile(r"(?<![\s▁]) (?!\Z)")
_HELD = 1 << 20  # distinct pairs that a task of the first pass holds before it gives out its counts
_LOADED: dict[tuple, Tokenizers] = {}
_WORDS: dict[tuple, Words] = {}


class Tokenizers:
    """Both vocabularies: ids of texts, byte lengths and bytes of tokens, and their decimal forms with separators."""

    def __init__(self, byte_ranks: str, pattern: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(byte_ranks, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        # no special tokens: their strings in a text are plain text, as in the JSON form when it encodes special tokens
        self.a = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_a[rank] = token
        n = self.b.get_piece_size()
        names = [self.b.id_to_piece(i) for i in range(n)]
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.len_a, self.len_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.size_b = n
        self.after_a = [np.array([b"%d%c" % (i, c) for i in range(len(self.bytes_a))], object) for c in b",|"]
        self.after_b = [np.array([b"%d%c" % (i, c) for i in range(n)], object) for c in b",;"]

    def ids(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of space + text by A and by B; both empty where a vocabulary does not give the bytes back."""
        found_a, found_b = [], []
        none = np.zeros(0, np.int64)
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            raw = (" " + text).encode()
            a = self.a.encode_to_numpy(" " + text, disallowed_special=())
            ok = b"".join(map(self.bytes_a.__getitem__, a.tolist())) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw
            found_a.append(a.astype(np.int64) if ok else none)
            found_b.append(np.array(b, np.int64) if ok else none)
        return found_a, found_b

    def ids_of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids by A, tokens before each word, ids by B, tokens before each word) of space + word.

        Words are given to the tokenizers joined, a few hundred at a time, as they cut between them anyway; a word that ends in
        white space or U+2581, and all of a group that does not give its bytes back, is given alone."""
        groups, group, size = [], [], 0
        for w in words:
            alone = not w or w[-1].isspace() or w[-1] == "▁"
            if alone or size > 4096:
                groups += [group] if group else []
                group, size = [], 0
            if alone:
                groups.append([w])
            else:
                group.append(w)
                size += len(w) + 1
        groups += [group] if group else []
        found_a, found_b = self.ids([" ".join(g) for g in groups])
        ids, counts = ([], []), ([], [])
        for g, *found in zip(groups, found_a, found_b, strict=True):
            if len(found[0]) or len(g) == 1:
                ends = np.cumsum([len(w.encode()) + 1 for w in g])
                for k, (own, size) in enumerate(zip(found, (self.len_a, self.len_b), strict=True)):
                    ids[k].append(own)
                    counts[k].append(np.diff(np.searchsorted(np.cumsum(size[own]), ends, "right"), prepend=0))
            else:
                for k, own in enumerate(self.ids(g)):
                    ids[k].extend(own)
                    counts[k].append(np.array([len(x) for x in own], np.int64))
        none = np.zeros(0, np.int64)
        ids, before = ([np.concatenate([none, *x]) for x in ids], [np.concatenate([[0], np.cumsum(np.concatenate([none, *x]))]) for x in counts])
        return ids[0], before[0], ids[1], before[1]


def tokenizers(paths: tuple[str, str, str]) -> Tokenizers:
    if paths not in _LOADED:
        _LOADED[paths] = Tokenizers(*paths)
    return _LOADED[paths]


def public_tokenizers_paths() -> tuple[str, str, str]:
    import public_tokenizers as p

    return p.path("byte_bpe_50k.tiktoken"), p.PATTERN, p.path("piece_bpe_32k.model")


class Alignment:
    """The links of some texts, whose bytes are laid end to end.

    a, b: ids; key: of each link; row_a, row_b, row: how many tokens and links there are before each row."""

    def __init__(self, kit: Tokenizers, texts: list[str]):
        self.kit = kit
        self.a, self.row_a, self.b, self.row_b = kit.ids_of_words(texts)
        self.end_a, self.end_b = np.cumsum(kit.len_a[self.a]), np.cumsum(kit.len_b[self.b])
        ends = _distinct(np.concatenate([self.end_a, self.end_b]))
        of_a, of_b = np.searchsorted(self.end_a, ends), np.searchsorted(self.end_b, ends)
        self.key = self.a[of_a] * kit.size_b + self.b[of_b]
        border = np.concatenate([[0], self.end_a])[self.row_a]
        self.row = np.searchsorted(ends, border, "right")
        self.row[0] = 0

    def groups(self) -> tuple[np.ndarray, list[str]]:
        """How many groups each row has, and their text: `a1,a2|b1;a3|b2`."""
        both = np.intersect1d(self.end_a, self.end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(both, self.end_a), np.searchsorted(both, self.end_b)
        last_a, last_b = (np.isin(e, both) for e in (self.end_a, self.end_b))
        text = np.empty(len(self.a) + len(self.b), object)
        # a token of A comes behind all tokens of B in groups before, one of B behind all of A up to its own group
        text[np.arange(len(self.a)) + np.searchsorted(group_b, group_a)] = np.where(last_a, self.kit.after_a[1][self.a], self.kit.after_a[0][self.a])
        text[np.arange(len(self.b)) + np.searchsorted(group_a, group_b, "right")] = np.where(last_b, self.kit.after_b[1][self.b], self.kit.after_b[0][self.b])
        parts, at = text.tolist(), self.row_a + self.row_b
        border = np.searchsorted(both, np.concatenate([[0], self.end_a])[self.row_a], "right")
        border[0] = 0
        return np.diff(border), [b"".join(parts[x:y])[:-1].decode() for x, y in zip(at[:-1], at[1:], strict=True)]


def _distinct(x: np.ndarray, counted: bool = False):
    """The distinct values of x in order, and how often each occurs if that is asked for."""
    x = np.sort(x)
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)
    return (x[first], np.diff(first, append=len(x))) if counted else x[first]


class Words:
    """The words that a task has aligned. number: of each word; per word ok, n_a, n_b, n_groups, its links from first[i] to
    first[i + 1] in key, and its groups as text."""

    def __init__(self, kit: Tokenizers):
        self.kit, self.cleared = kit, -1
        self.clear()

    def clear(self) -> None:
        self.cleared += 1
        self.number: dict[str, int] = {}
        self.sizes, self.first, self.key = np.zeros((4, 0), np.int64), np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.text: list[str] = []
        self.uses = np.zeros(0, np.int64)
        self.kept = 0

    def forget(self, least: int = 2) -> None:
        """Keep the words that were met `least` times or more since the last call, or more often ones if those take over half the room."""
        links = np.diff(self.first)
        cost = links + np.fromiter(map(len, self.text), np.int64, len(self.text))
        while cost[self.uses >= least].sum() * 2 > _KEPT:
            least *= 2
        keep = np.flatnonzero(self.uses >= least)
        words, text, held = list(self.number), self.text, np.repeat(self.uses >= least, links)
        sizes, first, key = self.sizes[:, keep], np.concatenate([[0], np.cumsum(links[keep])]), self.key[held]
        self.clear()
        self.number = {words[i]: k for k, i in enumerate(keep.tolist())}
        self.sizes, self.first, self.key, self.text = sizes, first, key, [text[i] for i in keep.tolist()]
        self.uses, self.kept = np.zeros(len(keep), np.int64), int(cost[keep].sum() + sum(map(len, self.number)))

    def links(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many links each of the words has, the keys of all these links in turn)."""
        sizes = self.first[word + 1] - self.first[word]
        return sizes, self.key[np.repeat(self.first[word] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))]

    def add(self, words: list[str]) -> None:
        new = list(set(words).difference(self.number))
        if not new:
            return
        own = Alignment(self.kit, new)
        n_groups, text = own.groups()
        self.number.update(zip(new, range(len(self.text), len(self.text) + len(new)), strict=True))
        n_a, n_b = np.diff(own.row_a), np.diff(own.row_b)
        self.sizes = np.concatenate([self.sizes, [n_a > 0, n_a, n_b, n_groups]], 1)
        self.first = np.concatenate([self.first, self.first[-1] + own.row[1:]])
        self.key = np.concatenate([self.key, own.key])
        self.text += text
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.kept += len(own.key) + sum(map(len, text)) + sum(map(len, new))


def words_of(paths: tuple[str, str, str]) -> Words:
    """The words that this Python process has aligned, in this task or in those before."""
    kit = tokenizers(paths)
    return _WORDS.setdefault(paths, Words(kit))


def _words(text: str) -> list[str]:
    if text[0] == " " or text[-1] == " " or _ODD.search(text):
        return _WORD_END.split(" " + text)[1:]
    return text.split(" ")


class Documents:
    """Some documents as sequences of words: at[row[i]:row[i + 1]] are numbers of words; a document without tokens has none."""

    def __init__(self, words: Words, texts: list[str | None]):
        parts = [_words(t) if t else [] for t in texts]
        words.add([w for p in parts for w in p])
        found = [list(map(words.number.__getitem__, p)) for p in parts]
        ok = words.sizes[0]
        self.found = [f if f and ok[f].all() else [] for f in found]
        self.row = np.cumsum([0, *map(len, self.found)])
        self.at = np.fromiter(chain.from_iterable(self.found), np.int64, int(self.row[-1]))
        words.uses += np.bincount(self.at, minlength=len(words.uses))

    def per_row(self, of_word: np.ndarray) -> np.ndarray:
        """Sum of a value of each word, a row."""
        total = np.concatenate([[0], np.cumsum(of_word[self.at], dtype=np.int64)])
        return total[self.row[1:]] - total[self.row[:-1]]

    def pairs(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys, how many of the documents hold each)."""
        n, span = len(words.text), len(words.kit.len_a) * words.kit.size_b
        once = _distinct(np.repeat(np.arange(len(self.found)), np.diff(self.row)) * n + self.at)
        document, word = once // max(n, 1), once % max(n, 1)
        sizes, key = words.links(word)
        return _distinct(_distinct(np.repeat(document, sizes) * span + key) % span, counted=True)


def _aligned(batches: Iterator[pa.RecordBatch], words: Words) -> Iterator[tuple[pa.RecordBatch, Documents]]:
    """Batches of about _SLICE characters of text, by words."""
    for batch in batches:
        texts = batch.column("text").to_pylist()
        first = size = 0
        for i, text in enumerate(texts):
            size += len(text or "")
            if size >= _SLICE or i == len(texts) - 1:
                yield batch.slice(first, i + 1 - first), Documents(words, texts[first : i + 1])
                first, size = i + 1, 0
                if words.kept > _KEPT:
                    words.forget()


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of whole numbers (splitmix64)."""
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct keys: levels of (bits, words); find() gives an index below n, or -1 for some unknown keys."""

    def __init__(self, words: list[np.ndarray]):
        self.words, self.ranks, before = words, [], 0
        for w in words:
            ones = np.bitwise_count(w).astype(np.int64)
            self.ranks.append(before + np.cumsum(ones) - ones)
            before += int(ones.sum())
        self.n = before

    @classmethod
    def of(cls, keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        words, left = [], keys
        while len(left):
            size = max(64, int(room * len(left)) + 63 & ~63)
            at = (_mixed(left, len(words)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        return cls(words)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, ranks) in enumerate(zip(self.words, self.ranks, strict=True)):
            at = _mixed(keys[left], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            hit = (words[word] >> bit) & np.uint64(1) == 1
            own = words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[left[hit]] = ranks[word[hit]] + np.bitwise_count(own)
            left = left[~hit]
        return out

    def blobs(self) -> list[bytes]:
        return [w.astype("<u8").tobytes() for w in self.words]

    @classmethod
    def load(cls, blobs: list[bytes]) -> PerfectHash:
        return cls([np.frombuffer(b, "<u8") for b in blobs])


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (_mixed(keys, 1 << 20) % np.uint64(shards)).astype(np.int32)


def partial_counts(docs: DataFrame, paths: tuple[str, str, str]) -> DataFrame:
    """(part, key, n): of some rows of docs, those of task `part`, how many hold the id pair linked. A key is a * size of B + b."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, keys, counts, added = TaskContext.get().partitionId(), np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            every = np.concatenate([keys, *(k for k, _ in added)])
            weight = np.concatenate([counts, *(c for _, c in added)])
            own, place = np.unique(every, return_inverse=True)
            return own, np.bincount(place, weights=weight, minlength=len(own)).astype(np.int64)

        def given() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(keys), 1 << 16):
                k = keys[i : i + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), part, np.int32)), pa.array(k), pa.array(counts[i : i + (1 << 16)])], names=["part", "key", "n"])

        words = words_of(paths)
        for _, docs in _aligned(batches, words):
            added.append(docs.pairs(words))
            if sum(len(k) for k, _ in added) >= _HELD:
                keys, counts = merged()
                added = []
                if len(keys) >= _HELD:
                    yield from given()
                    keys, counts = keys[:0], counts[:0]
        keys, counts = merged()
        yield from given()

    return docs.select("text").mapInArrow(count, "part int, key long, n long")


def hashed_pairs(partial: DataFrame, shards: int) -> DataFrame:
    """(shard, levels, keys): a minimal perfect hash of each shard's distinct keys, and these in its order."""

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        own = rows.column("key").to_numpy()
        h = PerfectHash.of(own)
        ordered = np.empty(len(own), np.int64)
        ordered[h.find(own)] = own
        return pa.table({"shard": rows.column("shard").slice(0, 1), "levels": pa.array([h.blobs()], pa.list_(pa.binary())), "keys": pa.array([ordered.tobytes()], pa.binary())})

    return partial.select("shard", "key").distinct().groupBy("shard").applyInArrow(build, "shard int, levels array<binary>, keys binary")


def summed_counts(partial: DataFrame, hashes: DataFrame, parts: int) -> DataFrame:
    """(shard, counts): the dense vector of a shard's counts, summed over partial tables in a tree of fan FAN."""
    vectors = "shard int, node int, counts binary"

    def dense(key: tuple, rows: pa.Table, function: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"shard": pa.array([], pa.int32()), "node": pa.array([], pa.int32()), "counts": pa.array([], pa.binary())})
        h = PerfectHash.load(function.column("levels")[0].as_py())
        own, stored = rows.column("key").to_numpy(), np.frombuffer(function.column("keys")[0].as_py(), np.int64)
        at = h.find(own)
        if (at < 0).any() or (stored[at] != own).any():
            raise ValueError("a pair is not in the hash of its shard")
        out = np.bincount(at, weights=rows.column("n").to_numpy(), minlength=h.n).astype(np.int64)
        return pa.table({"shard": rows.column("shard").slice(0, 1), "node": rows.column("node").slice(0, 1), "counts": pa.array([out.tobytes()], pa.binary())})

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in batch.column("counts"):
                own = np.frombuffer(blob.as_py(), np.int64)
                total = own.copy() if total is None else np.add(total, own, out=total)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["shard", "node", "counts"])

    nodes = -(-parts // FAN)
    leaves = partial.withColumn("node", F.floor(F.col("part") / FAN).cast("int"))
    functions = hashes.withColumn("node", F.explode(F.sequence(F.lit(0), F.lit(max(nodes - 1, 0)))))
    out = leaves.groupBy("shard", "node").cogroup(functions.groupBy("shard", "node")).applyInArrow(dense, vectors)
    while nodes > 1:
        nodes = -(-nodes // FAN)
        out = out.withColumn("node", F.floor(F.col("node") / FAN).cast("int")).groupBy("shard", "node").applyInArrow(add, vectors)
    return out.select("shard", "counts")


def pair_counts(docs: DataFrame, paths: tuple[str, str, str] | None = None, shard: int = SHARD) -> tuple[DataFrame, int]:
    """((shard, levels, keys, counts), number of shards): how many documents hold each id pair linked, by a minimal perfect hash."""
    partial = cut(partial_counts(docs, paths or public_tokenizers_paths()), "pair-parts")
    distinct, parts = partial.select(F.count_distinct("key"), F.coalesce(F.max("part") + 1, F.lit(0))).first()
    shards = max(1, -(-distinct // shard))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_shard(batch.column("key").to_numpy(), shards))], names=[*batch.schema.names, "shard"])

    marked = partial.mapInArrow(mark, "part int, key long, n long, shard int")
    hashes = cut(hashed_pairs(marked, shards), "pair-hashes")
    return cut(hashes.join(summed_counts(marked, hashes, parts), "shard"), "pair-counts"), shards


def best_counts(table: DataFrame, size_b: int) -> np.ndarray:
    """The highest count of each A id: shards give theirs, and as many rows as A has ids, at most, reach the driver."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
                k, c = (np.frombuffer(x.as_py(), np.int64) for x in (keys, counts))
                top = np.zeros(int(k.max() // size_b) + 1, np.int64)
                np.maximum.at(top, k // size_b, c)
                held = np.flatnonzero(top)
                yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(top[held])], names=["a", "n"])

    rows = table.select("keys", "counts").mapInArrow(best, "a long, n long").groupBy("a").agg(F.max("n").alias("n")).collect()
    out = np.zeros(max((r["a"] for r in rows), default=-1) + 1, np.int64)
    for r in rows:
        out[r["a"]] = r["n"]
    return out


class CountTable:
    """Some shards of the counts, for tasks: counts_of() gives the count of each key, 0 where its shard is not among them."""

    def __init__(self, shards: int, rows: list):
        self.shards = shards
        self.parts = [(r["shard"], [bytes(x) for x in r["levels"]], bytes(r["keys"]), bytes(r["counts"])) for r in rows]
        self._loaded = None

    def __getstate__(self) -> dict:
        return {"shards": self.shards, "parts": self.parts, "_loaded": None}

    def counts_of(self, keys: np.ndarray) -> np.ndarray:
        if self._loaded is None:
            self._loaded = [(s, PerfectHash.load(levels), np.frombuffer(k, np.int64), np.frombuffer(c, np.int64)) for s, levels, k, c in self.parts]
        out, shard = np.zeros(len(keys), np.int64), _shard(keys, self.shards)
        for s, h, stored, counts in self._loaded:
            own = np.flatnonzero(shard == s)
            at = h.find(keys[own])
            if (at < 0).any() or (stored[at] != keys[own]).any():
                raise ValueError("a linked pair was not counted in the first pass")
            out[own] = counts[at]
        return out


def _looked_up(table, best, paths: tuple[str, str, str], last: bool) -> Callable:
    """The second pass over batches with sums so far: adds what the table holds, and in the last turn gives the alignment."""

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, most, words = table.value, best.value, words_of(paths)
        of_word, cleared = np.zeros((2, 0), np.int64), words.cleared  # best links and sum of counts of each word, -1 if unknown
        for batch, docs in _aligned(batches, words):
            if cleared != words.cleared:
                of_word, cleared = of_word[:, :0], words.cleared
            of_word = np.concatenate([of_word, np.full((2, len(words.text) - of_word.shape[1]), -1)], 1)
            # only of words in these documents: others that the process keeps may come from another corpus
            new = _distinct(docs.at[of_word[0, docs.at] < 0])
            sizes, key = words.links(new)
            n = counts.counts_of(key)
            is_best = (n > 0) & (n == most[key // words.kit.size_b])
            for k, v in enumerate((is_best, n)):
                total = np.concatenate([[0], np.cumsum(v, dtype=np.int64)])
                of_word[k, new] = np.diff(total[np.concatenate([[0], np.cumsum(sizes)])])
            sums = [pa.array(batch.column(c).to_numpy() + docs.per_row(v)) for c, v in zip(("n_best", "count_sum"), of_word, strict=True)]
            if not last:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *sums], names=["doc_id", "text", "n_best", "count_sum"])
                continue
            sizes = [pa.array(docs.per_row(v)) for v in (*words.sizes[1:], np.diff(words.first))]
            groups = pa.array([";".join(map(words.text.__getitem__, f)) for f in docs.found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *sizes, *sums, groups], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])

    return look_up


def align_tokens(docs: DataFrame, paths: tuple[str, str, str] | None = None, shard: int = SHARD, most_shards: int = 16) -> DataFrame:
    """A row a row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups (ids of each group, as text)."""
    spark, paths = docs.sparkSession, paths or public_tokenizers_paths()
    table, shards = pair_counts(docs, paths, shard)
    best = spark.sparkContext.broadcast(best_counts(table, tokenizers(paths).size_b))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.lit(0).cast("long").alias("n_best"), F.lit(0).cast("long").alias("count_sum"))
    for first in range(0, shards, most_shards):
        last = first + most_shards >= shards
        own = table.where(F.col("shard").between(first, first + most_shards - 1)).collect()  # most_shards rows at most
        turn = spark.sparkContext.broadcast(CountTable(shards, own))
        sums = "n_best long, count_sum long"
        rows = rows.mapInArrow(_looked_up(turn, best, paths, last), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, {sums}, groups string" if last else f"doc_id {kind}, text string, {sums}")
        rows = rows if last else cut(rows, "turn")
    return rows


def op12(docs: DataFrame) -> DataFrame:
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return align_tokens(docs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))
