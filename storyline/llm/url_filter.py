"""Operator 8: URL rules in a sorted digest array.

Keys (host + path of a rule) are hashed to 64 bits with xxhash and sorted; workers memory-map the array, probe it with
vectorised binary search and confirm each hit against the stored full string, so a digest collision decides nothing.

Defined results. A null url or one without '://' has an empty host and path and matches no rule. Repeated rows are judged
each. Of the rules that fit a url the longest key wins; of equally long ones the longer host. An empty table gives an
empty result. Extra columns stay; one named like a result column is replaced.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: The rules of the query, as (verdict, host and path).
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
RESULT = ("host", "path", "rule", "verdict")
_MAPPED: dict[int, tuple] = {}


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


class DigestIndex:
    """The rules as bytes: sorted digests, then the offsets and UTF-8 of their keys, and a verdict flag each."""

    def __init__(self, rules: Iterable[tuple[str, str]], digest=xxhash.xxh64_intdigest):
        keys = {k: v for v, k in rules}
        pairs = sorted((digest(k), k) for k in keys)
        text = [k.encode() for _, k in pairs]
        ends = np.cumsum([0, *map(len, text)]).astype("<u8")
        self.n, self.digest = len(pairs), digest
        self.lengths = sorted({len(k) - k.index("/") if "/" in k else 0 for k in keys})
        self.block = np.array([keys[k] == "block" for _, k in pairs], dtype=np.uint8)
        self.blob = np.array([d for d, _ in pairs], dtype="<u8").tobytes() + ends.tobytes() + b"".join(text)

    def mapped(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The arrays, mapped from a file without a name that ends with the worker."""
        key = hash(self.blob)
        if key not in _MAPPED:
            file = tempfile.TemporaryFile()
            file.write(self.blob or b"\0")
            file.flush()
            whole = np.memmap(file, dtype=np.uint8, mode="r")
            a, b = 8 * self.n, 8 * (2 * self.n + 1)
            _MAPPED[key] = (whole[:a].view("<u8"), whole[a:b].view("<u8"), whole[b:])
        return _MAPPED[key]

    def find(self, keys: list[str]) -> np.ndarray:
        """Position of each key, or -1."""
        digests, ends, text = self.mapped()
        probe = np.fromiter(map(self.digest, keys), dtype=np.uint64, count=len(keys))
        at = np.searchsorted(digests, probe)
        out = np.full(len(keys), -1)
        for i in np.flatnonzero(at < self.n):
            j = at[i]
            while j < self.n and digests[j] == probe[i]:  # equal digests are neighbours
                if text[int(ends[j]) : int(ends[j + 1])].tobytes() == keys[i].encode():
                    out[i] = j
                    break
                j += 1
        return out

    def key(self, j: int) -> str:
        _, ends, text = self.mapped()
        return text[int(ends[j]) : int(ends[j + 1])].tobytes().decode()


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES, default: str = "allow", max_rules: int = 2_000_000) -> DataFrame:
    """pages with host, path, rule and verdict. The index goes to each task; its size is checked against max_rules,
    and a longer list is to be given to judge_urls_by_join, which has no limit."""
    rules = list(rules)
    if len(rules) > max_rules:
        raise ValueError(f"{len(rules)} rules; use judge_urls_by_join beyond {max_rules}")
    index = DigestIndex(rules)

    @F.pandas_udf("rule string, verdict string")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        keys, owner = [], []
        for i, (h, p) in enumerate(zip(host, path, strict=True)):
            part = h.split(".") if h else []
            heads = [p[:n] for n in index.lengths if n <= len(p)]
            found = [".".join(part[k:]) + head for k in range(len(part)) for head in heads]
            keys += found
            owner += [i] * len(found)
        rule, verdict = [None] * len(host), [default] * len(host)
        hits = index.find(keys)
        for c in np.flatnonzero(hits >= 0):  # longer hosts come first
            i, k = owner[c], keys[c]
            if rule[i] is None or len(k) > len(rule[i]):
                rule[i], verdict[i] = k, "block" if index.block[hits[c]] else "allow"
        return pd.DataFrame({"rule": rule, "verdict": verdict})

    pages = pages.drop(*RESULT)
    host, path = host_and_path(F.col("url"))
    out = pages.withColumn("host", host).withColumn("path", path).withColumn("_j", judged("host", "path"))
    return out.select(*pages.columns, "host", "path", "_j.rule", "_j.verdict")


def judge_urls_by_join(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """The same for any number of rules (verdict, key): candidate keys of each distinct host and path meet the rules in an equi-join."""
    pages = pages.drop(*RESULT)
    host, path = host_and_path(F.col("url"))
    pages = pages.withColumn("host", host).withColumn("path", path)
    rules = rules.groupBy("key").agg(F.max("verdict").alias("_v"))
    n = F.when(F.col("key").contains("/"), F.length("key") - F.locate("/", F.col("key")) + 1).otherwise(0)
    lengths = rules.select(n.alias("n")).distinct().agg(F.sort_array(F.collect_set("n")).alias("_lengths"))
    urls = pages.select("host", "path").where("host <> ''").distinct().join(F.broadcast(lengths))
    part = F.split("host", "\\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(part)), lambda k: F.array_join(F.slice(part, k, F.size(part)), "."))
    heads = F.transform(F.filter("_lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffix, lambda s: F.transform(heads, lambda h: F.concat(s, h))))
    found = urls.select("host", "path", F.explode(keys).alias("key")).join(rules, "key")
    best = found.groupBy(F.col("host").alias("_h"), F.col("path").alias("_p")).agg(F.max_by(F.struct("key", "_v"), F.struct(F.length("key"), F.locate("/", F.concat("key", F.lit("/"))))).alias("_b"))
    out = pages.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
    return out.select(*pages.columns, F.col("_b.key").alias("rule"), F.coalesce("_b._v", F.lit(default)).alias("verdict"))


def op8(pages: DataFrame) -> DataFrame:
    return judge_urls(pages.select("page_id", "url")).select("page_id", *RESULT)


OP8_SQL = """
WITH r(verdict, rule_host, rule_path) AS (VALUES """ + ", ".join(f"('{v}', '{k.split('/')[0]}', '/{k.split('/', 1)[1]}')" for v, k in RULES) + """),
u AS (SELECT row_number() OVER () AS i, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT i, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT i, arg_max(rule_host || rule_path, length(rule_host || rule_path) * 1000 + length(rule_host)) AS rule, arg_max(verdict, length(rule_host || rule_path) * 1000 + length(rule_host)) AS verdict
  FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY i)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (i)
"""
