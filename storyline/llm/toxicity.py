"""Operator 3: toxicity from subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of its hashed character n-grams and of itself, so a misspelling shares most of its
vector with the word it comes from. A passage of `window` words is the mean of its words, and a linear softmax over it
gives the probability; a text is as toxic as its worst passage, so a few words in a long text count. All of it is one
model: vectors and softmax are trained together, with a soft maximum over passages that hardens as training goes on.

Training is bounded: at most `per_label` labelled rows of each label (those whose id hashes lowest) go to one task, which
sends back the model alone; no text reaches the driver.

Defined results. Null and empty texts, and texts without a word, get the probability of the bias alone. Repeated rows are
scored each; of texts that share a labelled doc_id the smallest is learned from. Very long texts are scored whole. Without
labelled rows of both kinds every score is 0. An empty table gives an empty result. Extra columns stay; one named like a
result column is replaced.

One average over a whole text was measured to call clean texts toxic (README), hence the short bags.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import bounded_sample, held_out

_WORD = re.compile(r"[^\s.,;:!?|()\"#&%*$\[\]{}<>/=+_~^-]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def subword_buckets(vocab: list[str], buckets: int, part: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """(word position, bucket) of every character 3- to 5-gram of <word>, and of the whole word, in word order."""
    words_, found = [], []
    for i in range(0, len(vocab), part):  # what a part needs on the way is many times its result
        w, b = _part_buckets(vocab[i : i + part], buckets)
        words_.append((w + i).astype(np.int32))
        found.append(b.astype(np.int32))
    return np.concatenate(words_), np.concatenate(found)


def _part_buckets(vocab: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    marked = [f"<{w}>" for w in vocab]
    chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    owner = np.repeat(np.arange(len(marked)), size)
    word, found = [], []
    h = np.full(len(chars), 0x9E3779B97F4A7C15, dtype=np.uint64)
    for n in range(1, 6):
        m = len(chars) - n + 1
        if m <= 0:
            break
        h = (h[:m] ^ chars[n - 1 :]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        if n >= 3:
            inside = owner[:m] == owner[n - 1 :]
            word.append(owner[:m][inside])
            found.append(h[inside])
    whole = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in vocab), dtype=np.uint64, count=len(vocab))
    word, found = np.concatenate([*word, np.arange(len(vocab))]), np.concatenate([*found, whole * np.uint64(0x9E3779B97F4A7C15)])
    order = np.argsort(word, kind="stable")
    return word[order], (found[order] >> np.uint64(20)) % np.uint64(buckets)


class Toxicity:
    def __init__(self, buckets: int = 1 << 16, dim: int = 8, window: int = 2, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.buckets, self.window = buckets, window
        self.vectors = rng.normal(0, 0.1, (buckets, dim))
        self.out = rng.normal(0, 0.5, (2, dim))
        self.bias = np.zeros(2)
        self.trained = False

    def _passages(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last-plus-one word of the passages of n words; they overlap by half."""
        at = np.arange(0, max(n - self.window // 2, 1), self.window // 2)
        return at, np.minimum(at + self.window, n)

    def fit(self, texts: list[str | None], labels: list[int], rounds: int = 70, rate: float = 0.1) -> "Toxicity":
        """Full-batch Adam on the log loss, both labels weighing the same.

        As the model is linear in the vectors once the softmax is given, and the other way round, a round needs each
        bucket's share of the logit and of the gradient only, not the vector of every word.
        """
        y = np.array(labels, dtype=float)
        if len(set(labels)) < 2:
            return self
        vocab: dict[str, int] = {}
        ids = [np.array([vocab.setdefault(w, len(vocab)) for w in words(t)], dtype=np.int64) for t in texts]
        if not vocab:
            return self
        of_sub, bucket = subword_buckets(list(vocab), self.buckets)
        count = np.bincount(of_sub, minlength=len(vocab))
        ends, doc, n = [], [], 0
        for d, x in enumerate(ids):
            a, b = self._passages(len(x))
            ends.append(np.stack([a, b]) + n)
            doc.append(np.full(len(a), d))
            n += len(x)
        tokens, (a, b), doc = np.concatenate(ids), np.concatenate(ends, axis=1), np.concatenate(doc)
        del ids, ends
        size, first = np.maximum(b - a, 1), np.r_[0, np.flatnonzero(np.diff(doc)) + 1]
        weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        state = {k: [0.0, 0.0] for k in ("vectors", "out", "bias")}
        for r in range(rounds):
            diff = self.out[1] - self.out[0]
            per_word = np.bincount(of_sub, (self.vectors @ diff)[bucket], len(vocab)) / count
            sums = np.r_[0.0, np.cumsum(per_word[tokens])]
            logit = (sums[b] - sums[a]) / size + self.bias[1] - self.bias[0]
            sharp = min(0.2 * 1.12**r, 50.0)
            pull = np.exp(np.clip(sharp * (logit - np.maximum.reduceat(logit, first)[doc]), -50, 0))
            pull /= np.add.reduceat(pull, first)[doc]
            z = np.add.reduceat(pull * logit, first)
            slope = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) * weight
            g = slope[doc] * pull
            share = np.zeros(len(tokens) + 1)
            np.add.at(share, a, g / size)
            np.subtract.at(share, b, g / size)
            per_vocab = np.bincount(tokens, np.cumsum(share)[:-1], len(vocab)) / count
            scale = np.bincount(bucket, per_vocab[of_sub], self.buckets)
            g_diff = scale @ self.vectors
            step = {"vectors": scale[:, None] * diff[None, :] + 1e-6 * self.vectors, "out": np.stack([-g_diff, g_diff]), "bias": np.array([-1, 1]) * g.sum()}
            for k, grad in step.items():
                m, v = state[k] = [0.9 * state[k][0] + 0.1 * grad, 0.99 * state[k][1] + 0.01 * grad * grad]
                getattr(self, k)[...] -= rate * (m / (1 - 0.9 ** (r + 1))) / (np.sqrt(v / (1 - 0.99 ** (r + 1))) + 1e-8)
        self.trained = True
        return self

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """A trained model by what each bucket adds to the logit; words it has met are kept in a bounded memo."""

    def __init__(self, model: Toxicity, memo: int = 50_000):
        self.model, self.memo, self.known = model, memo, {}
        self.linear = model.vectors @ (model.out[1] - model.out[0])
        self.bias = float(model.bias[1] - model.bias[0])

    def word_logits(self, own: list[str]) -> np.ndarray:
        new = list(set(own).difference(self.known))
        if new:
            word, bucket = subword_buckets(new, self.model.buckets)
            got = np.bincount(word, self.linear[bucket], len(new)) / np.bincount(word, minlength=len(new))
            if len(self.known) > self.memo:
                self.known = {w: self.known[w] for w in set(own).intersection(self.known)}
            self.known.update(zip(new, got.tolist(), strict=True))
        return np.fromiter(map(self.known.__getitem__, own), dtype=float, count=len(own))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.model.trained:
            return np.zeros(len(texts))
        split = [words(t) for t in texts]
        logits = self.word_logits([w for x in split for w in x])
        out, n = np.empty(len(texts)), 0
        for i, x in enumerate(split):  # each text is summed alone, so its score is the same in any batch
            a, b = self.model._passages(len(x))
            sums = np.r_[0.0, np.cumsum(logits[n : n + len(x)])]
            out[i] = ((sums[b] - sums[a]) / np.maximum(b - a, 1)).max()
            n += len(x)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -60, 60)))


def learn_toxicity(docs: DataFrame, labels: DataFrame, per_label: int = 700, **options) -> Toxicity:
    """Fit on rows that are not held out; a document with several labels counts once, toxic if any says so."""
    labels = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    labels = labels.where(~held_out(F.col("doc_id")))
    chosen = bounded_sample(labels.withColumn("text", F.lit(None).cast("string")), "toxic", per_label).drop("text")
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").cast("int").alias("toxic"))

    def train(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = sorted((t or "", y) for x in batches for t, y in zip(x["text"].tolist(), x["toxic"].tolist(), strict=True))
        yield pd.DataFrame({"model": [pickle.dumps(Toxicity(**options).fit([t for t, _ in own], [y for _, y in own]))]})

    model = rows.select("text", "toxic").repartition(1).mapInPandas(train, "model binary").first()
    return pickle.loads(model["model"]) if model else Toxicity(**options)  # no row: nothing to learn from


def score_toxicity(docs: DataFrame, model: Toxicity, threshold: float = 0.5) -> DataFrame:
    """docs with score and predicted."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model.scorer()
        for texts in batches:
            whole = texts.tolist()
            yield pd.Series(np.concatenate([own.scores(whole[i : i + 200]) for i in range(0, len(whole), 200)] or [np.zeros(0)]))

    docs = docs.drop("score", "predicted")
    return docs.withColumn("score", scored("text")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    out = score_toxicity(docs, learn_toxicity(docs, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
