from datetime import datetime

import pytest

from storyline.operators import store
from storyline.plans import pipeline
from storyline.plans.pipeline import run_pipeline
from storyline.schemas import TABLES
from storyline.sources.versions import Versions

AT = datetime(2024, 1, 1)
NEWS = "id long, title string, content string, source string, url string, published_at timestamp, created_at timestamp"


def test_replace_groups(spark, tmp_path):
    path, kind = str(tmp_path / "timeline"), "node_id long, position_index int, timeline_group_id string"
    store.replace_groups(spark.createDataFrame([(1, 0, "a"), (2, 1, "a"), (3, 0, "b")], kind), path)
    store.replace_groups(spark.createDataFrame([(9, 0, "a")], kind), path)
    assert sorted((r["node_id"], r["timeline_group_id"]) for r in spark.read.parquet(path).collect()) == [(3, "b"), (9, "a")]


def test_upsert_nodes(spark):
    stored = spark.createDataFrame([(1, 10, "Iran", None, "update", "old", AT, "supply", 0.5, False, AT), (2, 20, "Oil", None, "update", "stays", AT, None, 0.5, False, AT), (3, None, "x", None, "update", "no cluster", AT, None, 0.5, False, AT)], TABLES["nodes"])
    new = spark.createDataFrame([(7, 10, "Iran", "new", None, "extra"), (8, 30, "UN", "added", 0.7, "extra"), (9, 30, "UN", "repeated", 0.1, "extra"), (5, None, "y", "no key", 0.2, "extra")], "id long, cluster_id long, entity string, description string, confidence_score double, more string")
    rows = {r["id"]: r for r in store.upsert_nodes(stored, new).collect()}
    assert sorted(rows) == [1, 2, 3, 8]
    assert (rows[1]["description"], rows[1]["confidence_score"], rows[1]["impact_type"]) == ("new", None, "supply")
    assert (rows[2]["description"], rows[8]["description"], rows[3]["description"]) == ("stays", "added", "no cluster")
    assert {r["id"] for r in store.upsert_nodes(stored.limit(0), new).collect()} == {7, 8}
    assert {r["id"] for r in store.upsert_nodes(stored, new.limit(0)).collect()} == {1, 2, 3}


def test_upsert_impact_and_type(spark):
    stored = spark.createDataFrame([(1, 5, ["a"], [], [], [], 0.3, AT)], TABLES["impact"])
    new = spark.createDataFrame([(5, ["b"], 0.9), (6, ["c"], 0.4)], "node_id long, short_term_winners array<string>, confidence_score double")
    rows = {r["node_id"]: r for r in store.upsert_impact(stored, new).collect()}
    assert (rows[5]["id"], rows[5]["short_term_winners"], rows[6]["short_term_winners"]) == (1, ["b"], ["c"])
    nodes = spark.createDataFrame([(5, "old"), (6, None), (7, "kept")], "id long, impact_type string")
    types = spark.createDataFrame([(5, "supply"), (6, "policy")], "node_id long, impact_type string")
    assert {tuple(r) for r in store.with_impact_type(nodes, types).collect()} == {(5, "supply"), (6, "policy"), (7, "kept")}


TITLES = ["Oil prices surge due to supply crisis in Iran", "Oil prices surge due to supply crisis in Iraq", "Bank merger warns of default risk", "Bank merger warns of default risk", "", "Cup final drawn tonight in the capital"]
MORE = ["Oil prices surge due to supply crisis in Iran", "Cup final drawn tonight in the capitol", "Port strike halts grain exports from Odesa", "Bank merger warns of default risks"]


def batch(spark, first, titles, source="s"):
    rows = [(first + k, t, f"{t} and some content", source, None, AT, datetime(2024, 1, 2, 0, 0, first + k)) for k, t in enumerate(titles)]
    return spark.createDataFrame(rows, NEWS)


@pytest.fixture(scope="module")
def first(spark):
    return run_pipeline(batch(spark, 0, TITLES), "2024-02-01 00:00:00")


@pytest.fixture(scope="module")
def again(spark, first):
    return run_pipeline(batch(spark, 10, MORE, "another source"), "2024-02-02 00:00:00", first)


def test_whole_run(spark, first):
    t = first
    nodes = {r["id"]: r for r in t["nodes"].collect()}
    assert {*TABLES, "articles", "steps", "validation", "health"} <= set(t)
    assert all(t[k].schema.simpleString() == spark.createDataFrame([], TABLES[k]).schema.simpleString() for k in TABLES)
    assert sorted(r["position_index"] for r in t["timeline"].collect()) == list(range(len(nodes)))
    assert all(n["impact_type"] and n["created_at"] for n in nodes.values()) and {r["node_id"] for r in t["signals"].collect()} <= set(nodes)
    steps = {(r["step"], r["counter"]): r["n"] for r in t["steps"].collect()}
    assert [steps["ingestion", k] for k in ("fetched_items", "valid", "inserted", "skipped_duplicates")] == [6, 5, 4, 1]
    assert [steps["preprocessing", k] for k in ("inserted", "skipped_exact", "skipped_fuzzy")] == [3, 0, 1]  # Iraq is a near copy of Iran
    assert t["health"].first()["health"] == "healthy"


def test_second_run_keeps_and_compares_what_is_stored(spark, first, again):
    ids = lambda df, c="id": sorted(r[c] for r in df.select(c).collect())
    both = run_pipeline(batch(spark, 0, TITLES).unionByName(batch(spark, 10, MORE, "another source")), "2024-02-02 00:00:00")
    for name in ("raw_news", "cleaned_news"):  # a headline of the first run is compared with
        assert ids(again[name]) == ids(both[name])
    assert ids(again["raw_news"]) == [0, 1, 2, 5, 10, 11, 12, 13] and ids(again["cleaned_news"]) == [0, 2, 5, 12]
    steps = {(r["step"], r["counter"]): r["n"] for r in again["steps"].collect()}
    assert steps["preprocessing", "skipped_fuzzy"] == 4  # three new ones, and the one of the first run once more
    assert set(ids(first["nodes"])) < set(ids(again["nodes"])) and again["cluster_news_map"].count() == 4
    old = {r["id"]: r["created_at"] for r in first["nodes"].collect()}
    assert all(r["created_at"] == old[r["id"]] for r in again["nodes"].collect() if r["id"] in old)
    assert again["impact"].count() == again["nodes"].count() and again["health"].first()["health"] == "healthy"
    third = run_pipeline(batch(spark, 0, TITLES), "2024-02-03 00:00:00", again)
    assert {r["n"] for r in third["steps"].where("counter = 'inserted'").collect()} == {0}
    assert all(ids(third[k]) == ids(again[k]) for k in ("raw_news", "cleaned_news", "nodes", "edges", "timeline", "impact", "signals"))


def content(tables):
    """Rows of the nine tables, without the times at which they were made."""
    return {k: sorted(map(str, tables[k].drop("created_at").collect())) for k in TABLES}


def test_failed_run_leaves_the_version_before(spark, tmp_path, first, again):
    def fails(run):
        raise ValueError("lost its input")

    root = str(tmp_path / "a")
    broken = tuple((n, fails if n == "expansion" else f) for n, f in pipeline.STEPS)
    batches = batch(spark, 0, TITLES), batch(spark, 10, MORE, "another source")
    store = Versions(spark, root)
    assert store.tables() == {} and store.version() == 0
    pipeline.run_stored(batches[0], root, "2024-02-01 00:00:00")
    one = content(store.tables())
    assert one == content(first)
    journal = pipeline.run_stored(batches[1], root, "2024-02-02 00:00:00", broken)
    assert [(r["step"], r["error"]) for r in journal if r["status"] == "error"] == [("expansion", "lost its input")]
    assert {"ingestion", "timeline"} <= {r["step"] for r in journal} and not {"impact", "publish"} & {r["step"] for r in journal}
    assert store.version() == 1 and content(store.tables()) == one
    pipeline.run_stored(batches[1], root, "2024-02-02 00:00:00")
    assert store.version() == 2 and content(store.tables()) == content(again)
    assert content(store.tables(1)) == one  # readers of the version before still have it
    assert spark.read.parquet(f"{root}/journal").select("run").distinct().count() == 3


def test_versions_add_replace_and_gather(spark, tmp_path):
    store = Versions(spark, str(tmp_path / "v"), most_folders=2)
    df = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    assert store.publish({"a": df(1)}, {"b": df(1)}) == 1
    for k in (2, 3, 4):
        store.publish({}, {"b": df(k)})
    store.publish({"a": df(9)})
    got = {k: sorted(r["id"] for r in t.collect()) for k, t in store.tables().items()}
    assert got == {"a": [9], "b": [1, 2, 3, 4]} and store.version() == 5
    assert len(store._manifest()[1]["b"][1]) == 2  # the third addition was written with the rows before
    (tmp_path / "v" / "manifest" / "00000006").mkdir()  # a publisher that died before its manifest was there
    assert store.version() == 5 and store.publish({"a": df(7)}) == 6


def test_trigram_pairs_move_texts_not_trigrams(spark, tmp_path):
    from storyline import store_queries

    spark.createDataFrame([(i, f"word{i % 5} text", "en", "s") for i in range(30)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    out = store_queries.trigram_pairs(spark, str(tmp_path))
    above, below = out._jdf.queryExecution().optimizedPlan().toString().split("Join ", 1)
    assert "transform(" in above and "transform(" not in below
    assert out.count() == 18 and {r["similarity"] for r in out.where("other % 5 = id % 5").collect()} <= {1.0}
