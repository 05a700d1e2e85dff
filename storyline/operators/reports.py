"""Per-node reports: connections, impact and signal summaries, confidence, and the unified record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import iso_time, readable
from ..lexicons import EVENT_LABELS, IMPACT_LABELS, LISTS
from .impact import parse_entries


def label_of(code, labels: dict[str, str], default):
    return F.coalesce(F.try_element_at(F.create_map(*[x for k, v in labels.items() for x in (F.lit(k), F.lit(v))]), code), default)


def connections(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """node_id with arrays causes (outgoing) and caused_by (incoming) of (confidence, id, relation, entity, description)."""

    def side(near: str, far: str, name: str) -> DataFrame:
        other = nodes.select(F.col("id").alias(far), "entity", readable(F.col("description"), 100).alias("description"))
        e = edges.join(other, far)
        place = F.row_number().over(Window.partitionBy(near).orderBy(F.desc("confidence_score"), far))
        e = e.withColumn("_n", place) if most is None else e.withColumn("_n", place).where(F.col("_n") <= most)
        item = F.struct("_n", F.col("confidence_score").alias("confidence"), F.col(far).alias("id"), F.col("relation_type").alias("relation"), "entity", "description")
        return e.groupBy(F.col(near).alias("node_id")).agg(F.sort_array(F.collect_list(item)).alias(name))

    return side("from_node_id", "to_node_id", "causes").join(side("to_node_id", "from_node_id", "caused_by"), "node_id", "full")


def impact_report(nodes: DataFrame, impact: DataFrame) -> DataFrame:
    out = nodes.select(F.col("id").alias("node_id")).join(impact, "node_id", "left")
    parts = [parse_entries(F.col(k)).alias(k) for k in LISTS]
    return out.select("node_id", F.col("confidence_score").isNotNull().alias("available"), *parts)


def confidence_summary(nodes: DataFrame, impact: DataFrame, signals: DataFrame) -> DataFrame:
    rows = nodes.select(F.col("id").alias("node_id"), "confidence_score").unionByName(impact.select("node_id", "confidence_score")).unionByName(signals.select("node_id", "confidence_score"))
    c = F.col("confidence_score")
    return rows.where(c.isNotNull()).groupBy("node_id").agg(F.round(F.min(c), 3).alias("least"), F.round(F.max(c), 3).alias("most"), F.round(F.avg(c), 3).alias("mean"), F.count("*").alias("n"))


def signal_parts(phrase: Column) -> Column:
    """Struct (strength, keyword) of a signal text such as `[STRONG] crisis (sources 3)`; without a label the whole is the keyword."""
    rest = F.trim(F.regexp_replace(phrase, r"^\[[^\]]*\]", ""))
    labelled = F.rlike(phrase, F.lit(r"^\[[^\]]*\]"))
    strength = F.when(labelled, F.trim(F.regexp_extract(phrase, r"^\[([^\]]*)\]", 1))).otherwise("unknown")
    keyword = F.when(F.locate("(", rest) > 1, F.trim(F.substring_index(rest, "(", 1))).otherwise(rest)
    return F.struct(strength.alias("strength"), F.when(labelled, keyword).otherwise(phrase).alias("keyword"))


def signal_report(signals: DataFrame) -> DataFrame:
    """A row a signal with its strength and keyword read out of its text, and its place among its node's, the surest first."""
    place = F.row_number().over(Window.partitionBy("node_id").orderBy(F.desc("confidence_score"), "signal_type", "phrase"))
    part = signal_parts(F.coalesce("phrase", F.lit("")))
    return signals.select("node_id", place.alias("place"), "signal_type", part["strength"].alias("strength"), part["keyword"].alias("keyword"), F.coalesce("entity", F.lit("")).alias("entity"), "source_count", "time_span", "confidence_score")


def timeline_report(nodes: DataFrame, timeline: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """The entries of every timeline group by position, each with its `most` surest outgoing edges and the group's size."""
    place = F.row_number().over(Window.partitionBy("from_node_id").orderBy(F.desc("confidence_score"), "to_node_id"))
    best = edges.withColumn("_n", place).where(F.col("_n") <= most)
    item = F.struct("_n", F.col("to_node_id").alias("target_node_id"), F.col("relation_type").alias("relation"), F.col("confidence_score").alias("confidence"))
    best = best.groupBy(F.col("from_node_id").alias("node_id")).agg(F.sort_array(F.collect_list(item)).alias("causal_connections"))
    kind = F.coalesce("event_type", F.lit("update"))
    own = nodes.select(F.col("id").alias("node_id"), F.coalesce("entity", F.lit("")).alias("entity"), kind.alias("event_type"), label_of(F.col("event_type"), EVENT_LABELS, F.lit("Update")).alias("event_label"), readable(F.col("description")).alias("description"), iso_time(F.col("timestamp")).alias("timestamp"), "is_anchor")
    sizes = timeline.groupBy("timeline_group_id").agg(F.count("*").alias("total_events"))
    entries = timeline.select("timeline_group_id", "node_id", F.col("position_index").alias("position"))
    return entries.join(own, "node_id").join(best, "node_id", "left").join(sizes, "timeline_group_id")


def records(nodes: DataFrame, timeline: DataFrame, edges: DataFrame, impact: DataFrame, signals: DataFrame, articles: DataFrame, most: int = 5) -> DataFrame:
    """One nested record a node: event, timeline, impact, signals, metadata.

    All tables become rows of one node key that are dealt once; places of edges and signals are numbered in that order,
    and one grouping puts the record together, so of a hub's edges only the `most` surest are ever gathered. The entries
    of a whole timeline are those of timeline_report; a record holds its node's own place and connections.
    articles: cluster_id, source. Of several timeline or impact rows of a node the smallest id counts.
    """
    sizes = timeline.groupBy("timeline_group_id").agg(F.count("*").alias("total_events"))
    places = timeline.join(sizes, "timeline_group_id").select("node_id", F.struct("id", "timeline_group_id", F.col("position_index").alias("position"), "total_events").alias("timeline"))
    sources = articles.groupBy("cluster_id").agg(F.count_distinct("source").alias("data_sources"))
    event = F.struct(
        F.coalesce("entity", F.lit("")).alias("entity"), F.coalesce("event_type", F.lit("update")).alias("event_type"), label_of(F.col("event_type"), EVENT_LABELS, F.lit("Development / Update")).alias("event_type_label"),
        label_of(F.col("impact_type"), IMPACT_LABELS, F.coalesce("impact_type", F.lit(""))).alias("impact_classification"), readable(F.col("description")).alias("description"), iso_time(F.col("timestamp")).alias("timestamp"),
        "is_anchor", "confidence_score", F.coalesce("data_sources", F.lit(0)).alias("data_sources"), iso_time(F.col("created_at")).alias("last_updated"),
    )
    lists = {k: parse_entries(F.col(k)) for k in LISTS}
    term = lambda part, side: F.struct(*[lists[f"{part}_{who}"][kind].alias(f"{kind}_{who}") for who in ("winners", "losers") for kind in ("direct", "indirect")]).alias(side)
    sectors = F.array_sort(F.array_distinct(F.concat(*[lists[k]["sector"] for k in LISTS])))
    effects = F.struct("id", "confidence_score", term("short_term", "short_term"), term("long_term", "long_term"), sectors.alias("sector_impacts"))
    part = signal_parts(F.coalesce("phrase", F.lit("")))
    signal = F.struct("signal_type", part["strength"].alias("strength"), part["keyword"].alias("keyword"), F.coalesce("entity", F.lit("")).alias("entity"), "source_count", "time_span", "confidence_score")
    link = F.struct(F.col("to_node_id").alias("target_node_id"), F.col("relation_type").alias("relation"), F.col("confidence_score").alias("confidence"))
    tagged = [
        nodes.join(sources, "cluster_id", "left").select(F.col("id").alias("node_id"), F.lit("event").alias("kind"), F.col("confidence_score").alias("sure"), event.alias("event")),
        places.select("node_id", F.lit("timeline").alias("kind"), "timeline"),
        impact.select("node_id", F.lit("impact").alias("kind"), F.col("confidence_score").alias("sure"), effects.alias("impact")),
        signals.select("node_id", F.lit("signal").alias("kind"), F.col("confidence_score").alias("sure"), F.struct("signal_type", "phrase").alias("tie"), signal.alias("signal")),
        edges.select(F.col("from_node_id").alias("node_id"), F.lit("link").alias("kind"), F.col("confidence_score").alias("sure"), F.struct(F.col("to_node_id").cast("string").alias("signal_type"), F.lpad(F.col("to_node_id").cast("string"), 20, "0").alias("phrase")).alias("tie"), link.alias("link")),
    ]
    every = tagged[0]
    for t in tagged[1:]:
        every = every.unionByName(t, allowMissingColumns=True)
    order = Window.partitionBy("node_id", "kind").orderBy(F.desc_nulls_last("sure"), "tie.phrase", "tie.signal_type")
    every = every.repartition("node_id").withColumn("n", F.row_number().over(order)).where((F.col("kind") != "link") | (F.col("n") <= most))
    listed = lambda c: F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("n", c)))), lambda s: s[c])
    scored = F.when(F.col("kind") != "link", F.col("sure"))
    out = every.groupBy("node_id").agg(
        F.first("event", True).alias("event"), F.min("timeline").alias("t"), listed("link").alias("causal_connections"), F.min("impact").alias("impact"), listed("signal").alias("signals"),
        F.struct(F.round(F.min(scored), 3).alias("least"), F.round(F.max(scored), 3).alias("most"), F.round(F.avg(scored), 3).alias("mean"), F.count(scored).alias("n")).alias("confidence"),
    ).where("event is not null")
    timeline_part = F.struct("t.timeline_group_id", "t.position", F.coalesce("t.total_events", F.lit(0)).alias("total_events"), "causal_connections").alias("timeline")
    meta = F.struct("confidence", "event.data_sources", "event.last_updated").alias("metadata")
    return out.select("node_id", F.col("event").dropFields("data_sources", "last_updated").alias("event"), timeline_part, F.col("impact").dropFields("id").alias("impact"), "signals", meta)
