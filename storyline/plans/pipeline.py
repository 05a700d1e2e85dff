"""The whole run: articles to kept articles, clusters, nodes, timeline, expansion, impact, signals and checks, on stored tables.

run_pipeline() works on tables given by name and returns all of them whole; run_stored() keeps them in published versions, so
that a run that fails leaves the version before, with a journal of what each step did.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import keywords
from ..operators import headlines as H
from ..operators.articles import cleaned, cluster_articles, cluster_keys, keyed, main_topics, match_stored, new_articles, normalized_input, profiles, without_child
from ..operators.expand import contexts, expand, nodes_for, outlines
from ..operators.graph import settled
from ..operators.impact import analyze
from ..operators.quality import checks, health
from ..operators.signals import cluster_span, detect_signals, upsert_signals
from ..operators.store import upsert_impact, upsert_nodes, with_impact_type
from ..operators.timeline import build_nodes, build_timeline
from ..schemas import TABLES, conform, empty
from ..sources.versions import Versions

JOURNAL = "run string, place int, step string, status string, error string, counter string, n long"


@dataclass
class Run:
    """A run's view of the tables: those stored, the rows that it adds to some, and others that it replaces."""

    rows: DataFrame
    now: Column
    stored: dict[str, DataFrame]
    added: dict[str, DataFrame] = field(default_factory=dict)
    whole: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def before(self, name: str) -> DataFrame:
        return self.stored[name] if name in self.stored else empty(self.spark, name)

    def table(self, name: str) -> DataFrame:
        if name in self.whole:
            return self.whole[name]
        if name in self.added and name in self.stored:
            return self.stored[name].unionByName(self.added[name])
        return self.added[name] if name in self.added else self.before(name)

    def add(self, name: str, rows: DataFrame) -> int:
        """Rows behind those that this run has added before; counted while they are written."""
        rows, n = written(conform(rows, name) if name in TABLES else rows, name)
        self.added[name] = self.added[name].unionByName(rows) if name in self.added else rows
        return n

    def replace(self, name: str, rows: DataFrame) -> int:
        self.whole[name], n = written(conform(rows, name) if name in TABLES else rows, name)
        return n

    def articles(self) -> DataFrame:
        """cluster_id and the article's fields of every clustered article: map, cleaned and raw news joined."""
        text = self.table("cleaned_news").select(F.col("id").alias("cleaned_news_id"), F.col("raw_news_id").alias("id"), "cleaned_text", "normalized_text", "language")
        own = self.table("cluster_news_map").select("cluster_id", "cleaned_news_id").join(text, "cleaned_news_id")
        return own.join(self.table("raw_news"), "id")

    def index(self) -> H.HeadlineIndex | None:
        heads, dealt = H.HeadlineIndex.TABLES
        if heads not in self.stored:
            return None
        if "free" not in self.stored[heads].columns:  # stored before headlines met in blocks
            index = H.indexed(self.stored[heads])
            self.whole |= {heads: index.heads, dealt: index.dealt}
            return index
        return H.HeadlineIndex(self.stored[heads], self.stored[dealt])


def written(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """settled(), and the number of rows as observed while they were written."""
    seen = Observation()
    out = settled(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return out, seen.get["n"]


def ingestion(run: Run) -> dict[str, int]:
    """Articles whose key is not stored, the first of each."""
    fetched, valid = Observation(), Observation()
    count = F.count(F.lit(1)).alias("n")
    rows = normalized_input(run.rows.observe(fetched, count)).observe(valid, count)
    inserted = run.add("raw_news", new_articles(rows, run.before("raw_news")))
    return {"fetched_items": fetched.get["n"], "valid": valid.get["n"], "inserted": inserted, "skipped_duplicates": valid.get["n"] - inserted}


def preprocessing(run: Run) -> dict[str, int]:
    """Clean what has no cleaned row yet, but for near copies of a headline that is kept, in this run or before.

    A row that was left out has no cleaned row, so later runs meet it again and leave it out again.
    """
    done = run.before("cleaned_news")
    open_ = without_child(run.table("raw_news"), done, "raw_news_id")
    known = run.before("raw_news").join(done.select(F.col("raw_news_id").alias("id")), "id", "left_semi").select("unique_id")
    fresh, n = written(open_.join(known, "unique_id", "left_anti"), "unprocessed")
    gone, index = H.duplicates(fresh, index=run.index())
    kept = cleaned(fresh.join(gone, "id", "left_anti")).withColumn("raw_news_id", F.col("id")).withColumn("created_at", run.now)
    inserted = run.add("cleaned_news", kept)
    for name, rows in zip(H.HeadlineIndex.TABLES, (index.heads, index.dealt), strict=True):
        if name in run.whole:
            run.replace(name, run.whole[name].unionByName(rows))
        else:
            run.add(name, rows)
    return {"inserted": inserted, "skipped_exact": open_.count() - n, "skipped_fuzzy": n - inserted}


def clustering(run: Run) -> dict[str, int]:
    """Articles without cluster join the stored cluster that they match best, and the rest forms clusters; those keep their key and topic."""
    lone = without_child(run.table("cleaned_news"), run.before("cluster_news_map"), "cleaned_news_id").select("id", "raw_news_id", "normalized_text")
    lone = settled(lone.join(run.table("raw_news").select(F.col("id").alias("raw_news_id"), "title"), "raw_news_id"), "unclustered")
    items = lone.select("id", "normalized_text", keywords(F.concat_ws(" ", "title", "normalized_text")).alias("words"))
    matched, merged = lone.select("id", F.col("id").alias("cluster_id")).limit(0), 0
    if "cluster_news_map" in run.stored:
        matched, merged = written(match_stored(items, settled(profiles(run.articles()), "profiles")).select("id", "cluster_id"), "matched")
    rest = lone.join(matched, "id", "left_anti")
    members = settled(cluster_articles(rest), "members")
    own = rest.join(members, "id")
    created = run.add("event_clusters", main_topics(own).join(cluster_keys(own), "cluster_id").select(F.col("cluster_id").alias("id"), "cluster_key", "main_topic", run.now.alias("created_at")))
    mapped = run.add("cluster_news_map", members.unionByName(matched).select("id", "cluster_id", F.col("id").alias("cleaned_news_id")))
    return {"clusters_created": created, "mapped_news": mapped, "merged_to_existing": merged}


def timeline(run: Run) -> dict[str, int]:
    """Nodes of all clusters derived anew, the known ones under their ids; edges between neighbours; the anchor's group replaced."""
    articles = run.articles()
    topics = run.table("event_clusters").select(F.col("id").alias("cluster_id"), "main_topic", "cluster_key")
    known = run.before("nodes").groupBy("cluster_id").agg(F.min("id").alias("_id"))
    derived = build_nodes(articles, topics, run.now).join(known, "cluster_id", "left").withColumn("id", F.coalesce("_id", "id")).drop("_id")
    nodes, edges, places = build_timeline(derived, run.before("edges"))
    n_edges = run.add("edges", edges.withColumn("id", F.xxhash64("from_node_id", "to_node_id", "relation_type")).withColumn("created_at", run.now))
    n_nodes = nodes.count()
    run.replace("nodes", upsert_nodes(run.before("nodes"), nodes.withColumn("created_at", run.now)))
    places = settled(places.withColumn("id", F.xxhash64("timeline_group_id", "node_id")).withColumn("created_at", run.now), "places")
    others = run.before("timeline").join(places.select("timeline_group_id").distinct(), "timeline_group_id", "left_anti")
    run.replace("timeline", others.unionByName(conform(places, "timeline")))
    return {"nodes_created_or_updated": n_nodes, "edges_created": n_edges, "timeline_entries": places.count()}


def expansion(run: Run) -> dict[str, int]:
    """Edges to clusters near the timeline's nodes, with nodes for clusters that had none, which are made before the edges."""
    articles, nodes = run.articles(), run.table("nodes")
    about = settled(outlines(articles).join(run.table("event_clusters").select(F.col("id").alias("cluster_id"), "main_topic"), "cluster_id"), "outlines")
    seeds = run.table("timeline").select(F.col("node_id").alias("id"))
    grown = settled(expand(seeds, about, articles, nodes, run.table("edges")), "expansion")
    lone = grown.where("made").select(F.col("to_cluster").alias("cluster_id")).distinct()
    text = contexts(articles.join(lone, "cluster_id", "left_semi"))
    extra = nodes_for(text.join(about.select("cluster_id", "main_topic"), "cluster_id"), nodes, run.now).withColumn("created_at", run.now)
    extra, n = written(conform(extra, "nodes"), "made-nodes")
    run.whole["nodes"] = nodes.unionByName(extra)
    n_edges = run.add("edges", grown.withColumn("id", F.xxhash64("from_node_id", "to_node_id", "relation_type")).withColumn("created_at", run.now))
    return {"new_nodes": n, "new_edges": n_edges}


def impact(run: Run) -> dict[str, int]:
    """Impact rows of all nodes, as all were derived anew, under their stored ids; nodes get their type."""
    nodes = run.table("nodes")
    text = F.concat_ws(" ", "event_type", "entity", "description")
    found = settled(analyze(nodes.drop("confidence_score", "impact_type"), text).withColumn("node_id", F.col("id")).withColumn("created_at", run.now), "impact")
    run.replace("impact", upsert_impact(run.before("impact"), found))
    run.replace("nodes", with_impact_type(nodes, found.select("node_id", "impact_type")))
    return {"processed_nodes": (n := found.count()), "impact_rows_written": n}


def signals(run: Run) -> dict[str, int]:
    """Signals of all nodes; a stored one takes the newest text and keeps the larger confidence and source count."""
    found = settled(detect_signals(run.table("nodes"), cluster_span(run.articles()), run.now), "found-signals")
    key = F.xxhash64("node_id", "entity", "signal_type", F.regexp_replace("phrase", r"^\[[^\]]*\]\s*|\s*\(.*$", ""))
    stored = run.before("signals").withColumn("_key", key).groupBy(F.col("_key").alias("id")).agg(F.min("created_at").alias("created_at"))
    merged = upsert_signals(run.before("signals"), found).withColumn("id", key)
    n = run.replace("signals", merged.join(stored, "id", "left").withColumn("created_at", F.coalesce("created_at", run.now)))
    return {"signals_found": found.count(), "signals_stored": n}


STEPS: tuple[tuple[str, Callable[[Run], dict[str, int]]], ...] = (
    ("ingestion", ingestion), ("preprocessing", preprocessing), ("clustering", clustering), ("timeline", timeline), ("expansion", expansion), ("impact", impact), ("signals", signals),
)


def _attempt(run: Run, steps, name: str) -> tuple[list[tuple], Exception | None]:
    """Journal rows of the steps up to the first that fails, and its exception."""
    journal = []
    for place, (step, work) in enumerate(steps):
        try:
            for counter, n in work(run).items():
                journal.append((name, place, step, "ok", None, counter, n))
        except Exception as e:  # noqa: BLE001 - any failure ends the run and is reported
            return [*journal, (name, place, step, "error", str(e)[:1000], None, None)], e
    return journal, None


def run_pipeline(rows: DataFrame, as_of: str, stored: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """All nine tables whole, after a run over article rows (id, title, content, source, url, published_at, created_at).

    stored: what an earlier call returned. Beside the tables there are the index of kept headlines, `articles`, `steps` (a row
    a counter), `validation` and `health`. Ids of new articles must not be stored ones. A step that fails raises.
    """
    run = Run(rows, F.to_timestamp(F.lit(as_of)), dict(stored or {}))
    journal, failed = _attempt(run, STEPS, "run")
    if failed:
        raise failed
    out = {name: run.table(name) for name in (*TABLES, *H.HeadlineIndex.TABLES)}
    out["articles"] = run.articles()
    out["steps"] = rows.sparkSession.createDataFrame([r[1:3] + r[5:] for r in journal], "place int, step string, counter string, n long")
    out["validation"] = settled(checks(out), "validation")
    out["health"] = health(out["validation"])
    return out


def run_stored(rows: DataFrame, root: str, as_of: str, steps=STEPS) -> list:
    """A run over the tables that are published under root: the next version if every step succeeds, else nothing new.

    Returns the run's journal rows, which are also kept under root/journal: a row a counter of each step, or the error of the
    one that failed, and the checks, which run in either case, over the version that is valid then.
    """
    spark, store, name = rows.sparkSession, Versions(rows.sparkSession, root), uuid.uuid4().hex
    run = Run(rows, F.to_timestamp(F.lit(as_of)), store.tables())
    journal, failed = _attempt(run, steps, name)
    if not failed:
        replaced = {k: v for k, v in run.whole.items()}
        journal.append((name, len(steps), "publish", "ok", None, "version", store.publish(replaced, {k: v for k, v in run.added.items() if k not in replaced})))
    tables = store.tables()
    found = checks({k: tables.get(k, empty(spark, k)) for k in TABLES}).collect()  # a row a check
    journal += [(name, len(steps) + 1, "validation", r["severity"], None, r["check"], r["issues"]) for r in found if r["issues"]]
    rows = spark.createDataFrame(journal, JOURNAL)
    rows.coalesce(1).write.mode("append").parquet(f"{root.rstrip('/')}/journal")
    return rows.orderBy("place", "counter").collect()


__all__ = ["STEPS", "Run", "keyed", "run_pipeline", "run_stored"]
