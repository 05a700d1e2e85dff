"""Stored tables in published versions: written beside the old ones, and valid from the moment a manifest names them.

A table is one or more Parquet folders. The manifest of a version lists the folders of every table; publishing writes the new
folders first and the manifest, a single small file, last. A run that dies before that leaves the version before as it is,
and what it wrote is named by nothing. Rows that are only added cost a folder of their own and no rewrite; a table of
many folders is rewritten into one when it is published next. There may be many readers, but one writer at a time.
"""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "version long, name string, path string, schema string"


class Versions:
    def __init__(self, spark: SparkSession, root: str, most_folders: int = 32):
        self.spark, self.root, self.most_folders = spark, root.rstrip("/"), most_folders

    def _manifest(self, version: int | None = None) -> tuple[int, dict[str, tuple[str, list[str]]]]:
        """(version, {table: (schema, folders)}) of one version, by default the newest; (0, {}) where there is none."""
        try:
            rows = self.spark.read.schema(MANIFEST).json(f"{self.root}/manifest/*")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0, {}
        newest = rows.agg(F.max("version")).first()[0] if version is None else version
        out: dict[str, tuple[str, list[str]]] = {}
        for r in rows.where(F.col("version") == newest).collect():  # a row a folder
            out.setdefault(r["name"], (r["schema"], []))[1].append(r["path"])
        return newest or 0, out

    def version(self) -> int:
        return self._manifest()[0]

    def folders(self, name: str) -> list[str]:
        """The folders of a table in the newest version."""
        return self._manifest()[1].get(name, ("", []))[1]

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version by name; none before the first."""
        read = lambda schema, paths: self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(*paths)
        return {name: read(*found) for name, found in self._manifest(version)[1].items()}

    def publish(self, whole: dict[str, DataFrame], added: dict[str, DataFrame] | None = None) -> int:
        """Write a new version: tables of `whole` in place of stored ones, rows of `added` behind them, all others as they are."""
        version, stored = self._manifest()
        known = self.tables(version) if stored else {}
        named = dict(stored)
        for name, rows in {**whole, **(added or {})}.items():
            path = f"{self.root}/tables/{name}/{uuid.uuid4().hex}"
            more = name not in whole and name in stored
            if more and len(stored[name][1]) >= self.most_folders:
                rows, more = known[name].unionByName(rows), False
            rows.write.parquet(path)
            named[name] = (rows.schema.json(), [*(stored[name][1] if more else []), path])
        rows = [(version + 1, name, path, schema) for name, (schema, paths) in named.items() for path in paths]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/{version + 1:08d}")
        return version + 1
