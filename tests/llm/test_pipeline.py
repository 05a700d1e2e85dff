import corpus_pipeline
from pyspark.sql import functions as F
from storyline.llm import shingle_join

SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_decide(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.drop_toxic(spark, docs, SF).cache()
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    apart = corpus_pipeline.drop_near_copies(spark, kept, SF)
    assert apart.columns == docs.columns
    again = corpus_pipeline.drop_near_copies(spark, apart, SF)
    assert again.count() == apart.count() <= kept.count()
    lines = corpus_pipeline.drop_lines(spark, kept, SF)
    assert lines.count() == kept.count() and lines.where(F.length("text") > 0).count() > 0


def test_near_copies_keep_one_row_of_each_component(spark):
    def words(name, changed=()):
        return " ".join(f"{name}{i}x" if i in changed else f"{name}{i}" for i in range(100))

    rows = [
        (2, words("a"), "s"), (2, words("a"), "s"), (2, words("a"), "t"),  # an id and its text repeated
        (1, words("b"), "s"), (5, words("b"), "s"), (5, words("c"), "s"),  # id 5: a copy of 1, and a text of its own
        (None, words("d"), "s"), (None, words("d"), "t"), (None, words("d", [50]), "s"),  # copies without ids
        (7, words("e"), "s"), (None, words("e", [20, 40]), "s"), (6, words("e", [20, 40, 60, 80]), "s"),  # linked by the middle one
        (8, None, "s"), (9, "", "s"), (9, "", "s"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()]
    lone = [t for i, t in got if i is None]
    assert len(lone) == 1 and lone[0] in (words("d"), words("d", [50]))
    want = [(1, words("b")), (2, words("a")), (5, words("c")), (6, words("e", [20, 40, 60, 80])), (8, None), (9, ""), (9, "")]
    assert sorted((r for r in got if r[0] is not None), key=str) == sorted(want, key=str)
    ids = {r["doc_id"]: r["component_id"] for r in shingle_join.jaccard_components(docs).where("doc_id in (6, 7)").collect()}
    assert ids == {6: 6, 7: 6}


def test_run_packs_everything(spark):
    out = corpus_pipeline.run(spark, SF).cache()
    assert out.count() > 0 and out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").isEmpty()
