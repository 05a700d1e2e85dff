"""Early-warning signals: phrase detection, accumulation over nodes, and strength."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import signal_terms, time_span, words_array
from ..lexicons import SIGNAL_PHRASES

MIN_STRENGTH = 0.25


def detect(rows: DataFrame, text: Column, phrases=SIGNAL_PHRASES) -> DataFrame:
    """rows with phrase, signal_type, weight: one row for each phrase among a text's terms; the lexicon is broadcast."""
    lexicon = rows.sparkSession.createDataFrame([(p, t, w) for t, own in phrases.items() for p, w in own.items()], "phrase string, signal_type string, weight double")
    words = words_array(sorted({p for own in phrases.values() for p in own}))
    return rows.withColumn("phrase", F.explode(F.array_intersect(signal_terms(text), words))).join(F.broadcast(lexicon), "phrase")


def persistence(first: Column, last: Column, as_of: Column) -> Column:
    span = F.greatest((F.unix_micros(last) - F.unix_micros(first)) / 86400e6, F.lit(0.0))
    age = F.greatest((F.unix_micros(as_of) - F.unix_micros(last)) / 86400e6, F.lit(0.0))
    return F.coalesce(F.round(F.least(span / 7.0, F.lit(1.0)) * F.greatest(F.lit(0.0), 1.0 - age / 30.0), 3), F.lit(0.15))


def strength(frequency: Column, sources: Column, lasting: Column, weight: Column) -> Column:
    raw = 0.30 * F.least(frequency / 5.0, F.lit(1.0)) + 0.25 * F.least(sources / 4.0, F.lit(1.0)) + 0.25 * lasting + 0.20 * weight
    return F.round(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 3)


def label(score: Column) -> Column:
    return F.when(score >= 0.60, "STRONG").when(score >= 0.35, "MEDIUM").otherwise("WEAK")


def cluster_span(articles: DataFrame) -> DataFrame:
    """Per cluster_id: sources, first and last time; articles have cluster_id, source, published_at, created_at."""
    at = F.coalesce("published_at", "created_at")
    return articles.groupBy("cluster_id").agg(F.count_distinct("source").alias("source_count"), F.min(at).alias("first_ts"), F.max(at).alias("last_ts"))


def accumulate(found: DataFrame) -> DataFrame:
    """Detections (entity, signal_type, phrase, weight, source_count, first_ts, last_ts) by their key; partial sums come before the shuffle."""
    entity = F.coalesce(F.nullif(F.col("entity"), F.lit("")), F.lit("unknown"))
    return found.groupBy(entity.alias("entity"), "signal_type", "phrase").agg(
        F.count("*").alias("frequency"), F.max(F.coalesce("source_count", F.lit(0))).alias("source_count"), F.min("first_ts").alias("first_seen"), F.max("last_ts").alias("last_seen"), F.max("weight").alias("weight")
    )


def score(groups: DataFrame, as_of: Column, least: float = MIN_STRENGTH) -> DataFrame:
    lasting = persistence(F.col("first_seen"), F.col("last_seen"), as_of)
    out = groups.withColumn("confidence_score", strength(F.col("frequency"), F.col("source_count"), lasting, F.col("weight"))).where(F.col("confidence_score") >= least)
    text = F.format_string("[%s] %s (occurrences×%d, sources×%d)", label(F.col("confidence_score")), F.col("phrase"), F.col("frequency"), F.col("source_count"))
    return out.withColumn("text", text).withColumn("time_span", time_span(F.col("first_seen"), F.col("last_seen")))


def detect_signals(nodes: DataFrame, spans: DataFrame, as_of: Column) -> DataFrame:
    """A row for each contributing node: nodes (id, cluster_id, entity, event_type, description), spans of cluster_span().

    Groups are scored once and joined back to the detections, so no list of nodes is gathered for a frequent phrase.
    """
    text = F.concat_ws(" ", F.coalesce("entity", F.lit("")), F.coalesce("event_type", F.lit("")), F.coalesce("description", F.lit("")))
    found = detect(nodes.select("id", "cluster_id", "entity", text.alias("_text")), F.col("_text")).drop("_text").join(spans, "cluster_id", "left")
    found = found.withColumn("entity", F.coalesce(F.nullif(F.col("entity"), F.lit("")), F.lit("unknown")))
    scored = score(accumulate(found), as_of).select("entity", "signal_type", "phrase", "text", "time_span", "confidence_score", F.col("source_count").alias("_sources"))
    out = found.select(F.col("id").alias("node_id"), "entity", "signal_type", "phrase").join(scored, ["entity", "signal_type", "phrase"])
    return out.select("node_id", "signal_type", F.col("text").alias("phrase"), "entity", F.col("_sources").cast("int").alias("source_count"), "time_span", "confidence_score")


def upsert_signals(stored: DataFrame, new: DataFrame) -> DataFrame:
    """The newest phrase and span, and the larger source count and confidence, by (node_id, entity, signal_type, word of the phrase).

    A null in the key equals a null."""
    word = lambda c: F.regexp_extract(c, r"^\[[^\]]*\]\s*([^(]*?)\s*(?:\(|$)", 1)
    key = ["node_id", "entity", "signal_type", "_word"]
    a, b = stored.withColumn("_word", word("phrase")).alias("a"), new.withColumn("_word", word("phrase")).alias("b")
    cols = [F.coalesce("b.phrase", "a.phrase").alias("phrase"), F.coalesce("b.time_span", "a.time_span").alias("time_span"), F.greatest("a.source_count", "b.source_count").alias("source_count"), F.greatest("a.confidence_score", "b.confidence_score").alias("confidence_score")]
    same = F.lit(True)
    for k in key:
        same &= F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return a.join(b, same, "full").select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key[:-1]], *cols)
