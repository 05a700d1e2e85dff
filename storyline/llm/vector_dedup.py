"""Operator 5: near-duplicate vectors by Euclidean p-stable hashing and exact cosine checks.

A normalised vector gets, in each of `tables` tables, the bucket of `width_k` quantised random projections
floor((a.v + b) / w). Vectors that share a bucket of any table are compared by cosine in double precision. A pair is
counted in the first table where it meets only, so counts are exact without a table of pairs. Equal vectors are hashed
once and weigh as many as they are.

A bucket above `block` vectors is cut into blocks, and a task compares two of them: nothing is capped. The hash is
random but seeded. With 26 tables of 16 projections a pair at cosine 0.95, the worst place, is met with probability 0.95
to 0.96 and a closer one with more; the tests measure it there against brute force.

Defined results. Vectors that are null, zero, or hold null or non-finite components link with nothing and are their own
component; vectors of different length are never linked. Vectors of any finite magnitude count alike. A row counts as one
vector, so repeated rows link with each other, and rows that share a vec_id but not the vector are two. Rows with a null
vec_id link as others do; the null is left out of the minimum, and where only such rows are linked component_id is null.
An empty table gives an empty result. Other columns are not read. Vectors are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, spread_join

CHUNK = 512


def unit_rows(v: np.ndarray) -> np.ndarray:
    """Rows at length 1; the largest component goes to 1 first, so no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _hasher(tables: int, width_k: int, w: float, seed: int):
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple] = {}
        for batch in batches:
            flat = batch.column("vec")
            dims = np.diff(flat.offsets.to_numpy())
            out = np.zeros((len(dims), tables), dtype=np.int64)
            for dim in np.unique(dims):
                if dim not in planes:
                    rng = np.random.default_rng((seed, int(dim)))
                    planes[dim] = rng.normal(size=(int(dim), tables * width_k)), rng.uniform(0, w, tables * width_k), rng.integers(1, 1 << 62, width_k) | 1
                a, b, mix = planes[dim]
                rows = np.flatnonzero(dims == dim)
                v = flat.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                v = unit_rows(v)
                cell = np.floor((v @ a + b) / w).astype(np.int64).reshape(len(rows), tables, width_k)
                code = np.zeros((len(rows), tables), dtype=np.int64)
                for i in range(width_k):
                    code = (code ^ (cell[:, :, i] * mix[i])) * np.int64(0x2545F4914F6CDD1D)
                    code ^= code >> 29
                out[rows] = code ^ dim
            sig = pa.ListArray.from_arrays(np.arange(0, out.size + 1, tables, dtype=np.int32), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("n"), flat, sig], names=["node", "n", "vec", "sig"])

    return keys


def _links(threshold: float):
    """Group function: the vectors of whole buckets of one table (or of two blocks of one) -> links and a spanning edge a vector."""

    def check(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", kind="stable")
        t, x, y = int(pdf["t"].iloc[0]), int(pdf["x"].iloc[0]), int(pdf["y"].iloc[0])
        key, node, n, side = (pdf[c].to_numpy() for c in ("key", "node", "n", "b"))
        sig = np.stack(pdf["sig"].to_numpy())[:, :t]
        dims = pdf["vec"].map(len).to_numpy()
        links, parent = np.zeros(len(pdf), dtype=np.int64), np.arange(len(pdf))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        def hit(i: np.ndarray, j: np.ndarray) -> None:
            np.add.at(links, i, n[j])
            np.add.at(links, j, n[i])
            while len(i):  # a pair that joins nothing new costs no step of its own
                a, b = root(i[0]), root(j[0])
                parent[max(a, b)] = min(a, b)
                flat = np.arange(len(parent))
                while (parent[flat] != flat).any():
                    flat = parent[flat]
                parent[:] = flat
                new = flat[i] != flat[j]
                i, j = i[new], j[new]

        bounds = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
        small = []
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            unit = unit_rows(np.stack(pdf["vec"].to_numpy()[rows]).astype(np.float64))
            place = np.full(len(pdf), -1)
            place[rows] = np.arange(len(rows))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                if b - a < 2:
                    continue
                own = np.arange(a, b)[dims[a:b] == dim]
                if x != y:
                    left, right = own[side[own] == x], own[side[own] == y]
                elif len(own) <= 64:
                    i, j = np.triu_indices(len(own), 1)
                    small.append((own[i], own[j]))
                    continue
                else:
                    left = right = own
                for s in range(0, len(left), CHUNK):
                    part = left[s : s + CHUNK]
                    p, r = place[part], place[right]
                    cos = unit[p] @ unit[r].T
                    ok = cos >= threshold
                    if x == y:
                        ok &= part[:, None] < right[None, :]
                    for u in range(t):
                        ok &= sig[part, u][:, None] != sig[right, u][None, :]
                    i, j = np.nonzero(ok)
                    if len(i):
                        hit(part[i], right[j])
            if small:
                i, j = np.concatenate([s[0] for s in small]), np.concatenate([s[1] for s in small])
                small = []
                for s in range(0, len(i), 100_000):
                    a, b = i[s : s + 100_000], j[s : s + 100_000]
                    p, r = place[a], place[b]
                    cos = np.einsum("ij,ij->i", unit[p], unit[r])
                    ok = (cos >= threshold) & ~(sig[a] == sig[b]).any(axis=1)
                    if ok.any():
                        hit(a[ok], b[ok])
        at = np.flatnonzero(links)
        return pd.DataFrame({"node": node[at], "links": links[at], "root": node[[root(i) for i in at]] if len(at) else node[at]})

    return check


def near_vectors(vectors: DataFrame, threshold: float = 0.95, tables: int = 26, width_k: int = 16, w: float = 2.0, block: int = 4096, seed: int = 11) -> DataFrame:
    """vec_id, n_links, component_id, kept for vectors (vec_id, embedding)."""
    number = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.forall(number, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(number, lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(F.coalesce(fine, F.lit(False)), F.col("embedding")).alias("vec"))
    rows = rows.withColumn("node", F.xxhash64("vec"))
    valid = rows.where("vec is not null")
    classes = valid.groupBy("node").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("vec").alias("vec"))
    vec_kind = rows.schema["vec"].dataType.simpleString()
    hashed = classes.select("node", "n", "vec").mapInArrow(_hasher(tables, width_k, w, seed), f"node long, n long, vec {vec_kind}, sig array<long>")
    hashed = cut(hashed, "vector-keys")
    n_classes = hashed.count()
    groups = max(1, n_classes // 20_000)
    # keys travel without their vectors, and the many that only one vector has end here
    keys = hashed.select("node", F.posexplode("sig").alias("t", "key"))
    held = keys.groupBy("t", "key").agg(F.count("*").alias("c")).where("c > 1")
    met = spread_join(keys, held, ["t", "key"], "c", n_classes * tables)
    met = met.withColumn("nb", F.ceil(F.col("c") / block).cast("int")).withColumn("b", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    met = met.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    one = F.col("nb") == 1
    met = met.select("node", "t", "key", "b", F.when(one, F.pmod("key", F.lit(groups))).otherwise(F.col("key")).alias("g"), F.when(one, -1).otherwise(F.least("b", "o")).alias("x"), F.when(one, -1).otherwise(F.greatest("b", "o")).alias("y"))
    met = met.join(hashed, "node")
    found = cut(met.groupBy("t", "g", "x", "y").applyInPandas(_links(threshold), "node long, links long, root long"), "vector-links")
    linked = found.groupBy("node").agg(F.sum("links").alias("links"))
    labels = cut(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "vector-labels")
    known = classes.select("node", "rep", "n")
    top = labels.join(known, "node").groupBy("component").agg(F.min("rep").alias("least"), F.count("*").alias("_n"))
    joined = spread_join(labels, top, ["component"], "_n", labels.count()).select("node", "least")
    per = known.join(linked, "node", "left").join(joined, "node", "left")
    per = per.select("node", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "rep").alias("component_id"))
    out = spread_join(valid.select("vec_id", "node"), per, ["node"], "n", valid.count()).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.where("vec is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, own.isNull()).alias("kept"))


def op5(embeddings: DataFrame) -> DataFrame:
    return near_vectors(embeddings)
