"""Operator 7: language by compression with zstandard raw-content dictionaries, one a language.

Training is bounded: of each language at most `per_lang` rows (those whose id hashes lowest) meet in one task, and their
lower-cased text fills a dictionary of `dict_bytes`, which alone goes to the driver. Every text is then compressed whole with each dictionary; the
smallest result names the language.

Defined results. A null text, or one without a letter, is `und` with score 0. Repeated rows are judged each. An empty
table, or one without labelled rows, has no learned language: all rows are `und`. Extra columns stay; one named like a
result column is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .folds import bounded_sample, held_out

_LETTER = re.compile(r"[^\W\d_]")


def learn_dictionaries(docs: DataFrame, per_lang: int = 150, dict_bytes: int = 112_000) -> dict[str, bytes]:
    """A dictionary of at most dict_bytes for each language, from at most per_lang texts that meet in one task; texts do not reach the driver."""
    rows = docs.where(~held_out(F.col("doc_id"))).where("text is not null and lang is not null")
    rows = bounded_sample(rows.select("doc_id", "text", "lang"), "lang", per_lang)

    def one(own: pd.DataFrame) -> pd.DataFrame:
        texts = [t.lower().encode() for t in sorted(own["text"])]
        share = max(1, dict_bytes // len(texts))  # a fair part of each text, and more of it while there is room
        head = b"\n".join(x[:share] for x in texts)
        whole = (b"\n".join(x[share:] for x in texts) + b"\n" + head)[-dict_bytes:] or b" " * 8
        return pd.DataFrame({"lang": [own["lang"].iloc[0]], "dictionary": [whole]})

    found = rows.select("lang", "text").groupBy("lang").applyInPandas(one, "lang string, dictionary binary")
    return {r["lang"]: bytes(r["dictionary"]) for r in found.collect()}


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], level: int = 5):
        self.langs = sorted(dictionaries)
        params = zstandard.ZstdCompressionParameters.from_level(level, min_match=4, write_content_size=False, write_checksum=False)
        self.by = []
        for x in self.langs:
            d = zstandard.ZstdCompressionDict(dictionaries[x].ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            self.by.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language and the margin: by which share its size is below the second best."""
        if not text or not self.langs or not _LETTER.search(text):
            return "und", 0.0
        raw = text.lower().encode()
        sizes = sorted((len(c.compress(raw)), x) for c, x in zip(self.by, self.langs, strict=True))
        return sizes[0][1], 1.0 - sizes[0][0] / sizes[1][0] if len(sizes) > 1 else 1.0


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], min_margin: float = 0.01) -> DataFrame:
    """docs with lang_pred, score (the margin, 0 to 1) and rejected (margin below min_margin, or no letter)."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = Classifier(dictionaries)
        for texts in batches:
            yield pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score"])

    docs = docs.drop("lang_pred", "score", "rejected")
    out = docs.withColumn("_p", predicted("text"))
    return out.select(*docs.columns, "_p.lang_pred", "_p.score", (F.col("_p.score") < min_margin).alias("rejected"))


def op7(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text", "lang")
    out = identify_language(docs.select("doc_id", "text"), learn_dictionaries(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
