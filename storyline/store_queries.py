"""Queries over tables derived from the news view: stored rows, reports, checks and helpers, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import text as T
from .lexicons import CAUSAL_PATTERNS, ENTITIES, EVENT_KEYWORDS, EVENT_LABELS, GENERIC_WORDS, IMPACT_RULES, LISTS, SECTOR_ACTORS, SECTOR_KEYWORDS
from .news import AS_OF, NEWS_SQL, news
from .operators import articles as A
from .operators import expand as E
from .operators import impact as I
from .operators import quality as Q
from .operators import reports as R
from .operators import signals as S
from .operators import store as W
from .operators import timeline as L


def _words(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _q(body: str, more: str = "") -> str:
    return f"WITH {NEWS_SQL}{', ' + more if more else ''} {body}"


def preprocessed(s, d) -> DataFrame:
    return A.cleaned(news(s, d)).select("id", F.md5("cleaned_text").alias("cleaned"), F.md5("normalized_text").alias("normalized"), "language")


def unprocessed(s, d) -> DataFrame:
    n = news(s, d)
    return A.without_child(n, n.where("id % 3 = 0").select(F.col("id").alias("raw_news_id")), "raw_news_id").select("id")


def whole_impact_lists(s, d) -> DataFrame:
    out = I.analyze(news(s, d), F.concat_ws(" ", "title", "content"))
    return out.select("id", *[F.array_join(F.array_sort(k), "|").alias(k) for k in LISTS])


def text_parts(s, d) -> DataFrame:
    phrase = F.concat(F.lit("["), F.upper("source"), F.lit("] "), F.col("title"), F.when(F.col("id") % 2 == 0, " (sources 3)").otherwise(""))
    part = R.signal_parts(F.when(F.col("id") % 5 == 0, F.col("title")).otherwise(phrase))
    label = R.label_of(F.element_at(F.array(*map(F.lit, [*EVENT_LABELS, "none"])), (F.col("id") % 5 + 1).cast("int")), EVENT_LABELS, F.lit("Development / Update"))
    return news(s, d).select("id", part["strength"].alias("strength"), part["keyword"].alias("keyword"), label.alias("label"), T.contains_any(F.col("title"), ["bank", "oil", "Port"]).alias("named"), T.time_span(F.col("published_at"), F.col("created_at")).alias("span"))


def trigram_pairs(s, d) -> DataFrame:
    """Headlines meet as texts and are cut into trigrams after the join: the trigrams take twenty times their space."""
    n = news(s, d).select("id", T.normalize_text(T.clean_text(F.col("title"))).alias("g"))
    other = n.select((F.col("id") - 12).alias("id"), F.col("id").alias("other"), F.col("g").alias("h"))
    both = n.join(other, "id").select("id", "other", T.trigrams(F.col("g")).alias("g"), T.trigrams(F.col("h")).alias("h"))
    return both.select("id", "other", F.round(T.trigram_similarity(F.col("g"), F.col("h")), 6).alias("similarity"))


def _nodes(s, d) -> DataFrame:
    """A node an article: its source as entity."""
    n = news(s, d)
    return n.select("id", F.col("id").alias("cluster_id"), F.col("source").alias("entity"), F.lit("topic").alias("entity_type"), F.lit("update").alias("event_type"), F.col("title").alias("description"), F.col("published_at").alias("timestamp"), F.lit("neutral").alias("impact_type"), F.lit(0.7).alias("confidence_score"), (F.col("id") % 10 == 0).alias("is_anchor"), "created_at")


_ED = ("ed0 AS (SELECT id AS a, id + id % 4 * 5 AS b, (id % 12) / 10.0::DOUBLE AS c FROM news), ed AS (SELECT * FROM ed0 UNION ALL SELECT * FROM ed0 WHERE a % 9 = 0"
    + "".join(f" UNION ALL SELECT id, id + {k}, (id % {k}) / {k}.0::DOUBLE FROM news" for k in (7, 8, 9)) + ")")
_NODES = "nodes AS (SELECT id, id AS cluster_id, source AS entity, 'update' AS event_type, title AS description, published_at AS timestamp, 0.7::DOUBLE AS confidence_score, id % 10 = 0 AS is_anchor FROM news)"


def upserted_nodes(s, d) -> DataFrame:
    n = _nodes(s, d)
    new = n.where("id % 3 <> 1").select((F.col("id") + 1_000_000).alias("id"), "cluster_id", F.upper("entity").alias("entity"), "event_type")
    return W.upsert_nodes(n.where("id % 2 = 0").select("id", "cluster_id", "entity", "event_type", "confidence_score"), new)


def upserted_impact(s, d) -> DataFrame:
    n = news(s, d).select("id", F.col("id").alias("node_id"), (F.col("id") % 7 / 7).alias("confidence_score"))
    return W.upsert_impact(n.where("id % 2 = 0"), n.where("id % 5 < 3").select((F.col("id") + 1_000_000).alias("id"), "node_id", (F.col("confidence_score") + 1).alias("confidence_score")))


def upserted_signals(s, d) -> DataFrame:
    found = S.detect(news(s, d), F.col("title")).select(F.col("id").alias("node_id"), F.when(F.col("id") % 4 > 0, F.col("source")).alias("entity"), "signal_type", F.concat(F.lit("[WEAK] "), F.col("phrase"), F.lit(" (sources 1)")).alias("phrase"), F.lit("a").alias("time_span"), (F.col("id") % 3).cast("int").alias("source_count"), "weight")
    stored = found.where("node_id % 2 = 0").withColumnRenamed("weight", "confidence_score")
    new = found.where("node_id % 3 = 0").select("node_id", "entity", "signal_type", F.replace("phrase", F.lit("WEAK"), F.lit("STRONG")).alias("phrase"), F.lit("b").alias("time_span"), F.lit(1).alias("source_count"), (F.col("weight") / 2).alias("confidence_score"))
    return S.upsert_signals(stored, new)


def confidence_summary(s, d) -> DataFrame:
    n = _nodes(s, d)
    some = news(s, d).select(F.col("id").alias("node_id"), F.when(F.col("id") % 3 > 0, F.col("id") % 9 / 9).alias("confidence_score"))
    return R.confidence_summary(n, some, S.detect(news(s, d), F.col("title")).select(F.col("id").alias("node_id"), F.col("weight").alias("confidence_score")))


def _derived(s, d) -> dict[str, DataFrame]:
    """Nine tables with known faults, as functions of the article's id."""
    n, nodes = news(s, d), _nodes(s, d)
    nid = F.col("id").alias("node_id")
    edges = n.select("id", F.col("id").alias("from_node_id"), (F.col("id") + F.col("id") % 4 * 5).alias("to_node_id"), (F.col("id") % 12 / 10).alias("confidence_score"))
    more = [n.select("id", F.col("id").alias("from_node_id"), (F.col("id") + k).alias("to_node_id"), (F.col("id") % k / k).alias("confidence_score")) for k in (7, 8, 9)]
    edges = edges.unionByName(more[0]).unionByName(more[1]).unionByName(more[2]).unionByName(edges.where("id % 9 = 0"))
    nodes = nodes.withColumn("entity", F.when(F.col("id") % 11 > 0, F.col("entity")))
    again = nodes.where("id % 13 = 0").withColumn("id", F.col("id") + 1_000_000).withColumn("is_anchor", F.lit(False))
    impact = n.where("id % 3 = 0").select("id", nid, F.lit(0.5).alias("confidence_score"))
    return {
        "raw_news": n.where("id % 7 > 0"), "cleaned_news": n.where("id % 3 > 0").select("id", F.col("id").alias("raw_news_id")), "event_clusters": n.where("id % 5 > 0").select("id"),
        "cluster_news_map": n.where("id % 4 > 0").select("id", F.col("id").alias("cluster_id"), F.col("id").alias("cleaned_news_id")),
        "nodes": nodes.unionByName(again), "edges": edges,
        "timeline": n.where("id % 2 = 0").select("id", nid, (F.col("id") % 100).cast("int").alias("position_index"), F.col("source").alias("timeline_group_id")),
        "impact": impact.unionByName(impact.where("id % 12 = 0")), "signals": n.where("id % 6 = 1").select("id", (F.col("id") + 3).alias("node_id"), F.lit(1.5).alias("confidence_score")),
    }


def quality_checks(s, d) -> DataFrame:
    return Q.checks(_derived(s, d))


def table_rows(s, d) -> DataFrame:
    return Q.row_counts(_derived(s, d))


def quality_health(s, d) -> DataFrame:
    return Q.health(Q.checks(_derived(s, d))).select("errors", "warnings", "infos", "health")


def cluster_profiles(s, d) -> DataFrame:
    m = news(s, d).select("id", (F.col("id") % 40).alias("cluster_id"), "title", T.normalize_text(F.col("title")).alias("normalized_text"))
    return A.profiles(m).select("cluster_id", F.array_join(F.array_sort("words"), " ").alias("words"), F.array_join("texts", "|").alias("texts"))


def cluster_contexts(s, d) -> DataFrame:
    m = news(s, d).select("id", (F.col("id") % 40).alias("cluster_id"), "published_at", "created_at", T.normalize_text(F.col("title")).alias("normalized_text"))
    return E.contexts(m).select("cluster_id", "latest_ts", F.md5("context").alias("context"))


def cluster_spans(s, d) -> DataFrame:
    m = news(s, d).withColumn("cluster_id", F.col("id") % 40)
    return S.cluster_span(m).select("cluster_id", "first_ts", "last_ts", "source_count")


def missing_nodes(s, d) -> DataFrame:
    about = news(s, d).select(F.col("id").alias("cluster_id"), F.when(F.col("id") % 6 > 0, F.col("title")).alias("main_topic"), F.col("content").alias("context"), F.col("published_at").alias("latest_ts"))
    out = E.nodes_for(about, _nodes(s, d).where("id % 2 = 0"), F.to_timestamp(F.lit(AS_OF)))
    return out.select("id", "cluster_id", "entity", "event_type", F.md5("description").alias("description"), "timestamp", "confidence_score")


def near_positions(s, d) -> DataFrame:
    placed = L.ordered(_nodes(s, d).withColumn("score", F.lit(0.0)).withColumn("cluster_key", F.lit("k")).withColumn("frequency", F.lit(1)).withColumn("source_count", F.lit(1)).drop("is_anchor"))
    out = L.neighbours(placed).select("id", F.explode("to").alias("to"))
    return out.select("id", F.col("to.id").alias("other"), F.col("to.p").alias("place"))


def timeline_entries(s, d) -> DataFrame:
    t = _derived(s, d)
    out = R.timeline_report(_nodes(s, d), t["timeline"], t["edges"].withColumn("relation_type", F.lit("causes")), most=2)
    return out.select("timeline_group_id", "node_id", "position", "entity", "event_label", "total_events", F.array_join(F.transform("causal_connections", lambda x: x["target_node_id"].cast("string")), ",").alias("targets"))


def repeated_keys(s, d) -> DataFrame:
    return Q.repeated_keys(_derived(s, d))


def node_records(s, d) -> DataFrame:
    n, t = news(s, d), _derived(s, d)
    nodes = t["nodes"].where("id = cluster_id").withColumn("event_type", F.when(F.col("id") % 4 == 0, "trigger")).withColumn("created_at", F.col("timestamp"))
    lists = {k: F.array(F.concat(F.lit("DIRECT: "), "source", F.lit(" traders")), F.concat(F.lit("SECTOR [x]: "), "source")) for k in LISTS}
    effects = n.where("id % 3 = 0").select("id", F.col("id").alias("node_id"), F.lit(0.5).alias("confidence_score"), *[c.alias(k) for k, c in lists.items()])
    found = S.detect(n, F.col("title")).select(F.col("id").alias("node_id"), "signal_type", F.concat(F.lit("[WEAK] "), F.col("phrase"), F.lit(" (sources 1)")).alias("phrase"), F.col("source").alias("entity"), F.lit(1).alias("source_count"), F.lit("unknown").alias("time_span"), F.col("weight").alias("confidence_score"))
    out = R.records(nodes, t["timeline"], t["edges"].withColumn("relation_type", F.lit("causes")), effects, found, n.select(F.col("id").alias("cluster_id"), "source"), most=2)
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return out.select(
        "node_id", "event.entity", F.col("event.event_type_label").alias("event_label"), "timeline.timeline_group_id", "timeline.position", "timeline.total_events",
        joined("timeline.causal_connections", lambda x: x["target_node_id"].cast("string")).alias("targets"), joined("impact.short_term.direct_winners", lambda x: x).alias("direct_winners"), joined("impact.sector_impacts", lambda x: x).alias("sectors"),
        F.nullif(joined("signals", lambda x: F.concat_ws(":", x["keyword"], x["strength"])), F.lit("")).alias("signals"), "metadata.confidence.*", "metadata.data_sources",
    )


def expansion_candidates(s, d) -> DataFrame:
    n = news(s, d)
    bases = n.select(F.col("id").alias("node_id"), F.col("id").alias("cluster_id"), F.get(F.split("title", " "), 0).alias("entity"), F.col("published_at").alias("timestamp"))
    about = n.select(F.col("id").alias("cluster_id"), F.substring("title", 1, 40).alias("main_topic"), F.col("published_at").alias("latest_ts"))
    return E.candidates(bases, about, days=0.25).select("node_id", "to_cluster")


def signal_places(s, d) -> DataFrame:
    found = S.detect(news(s, d), F.col("title")).select(F.col("id").alias("node_id"), "signal_type", F.concat(F.lit("[WEAK] "), F.col("phrase"), F.lit(" (sources 1)")).alias("phrase"), F.col("source").alias("entity"), F.lit(1).alias("source_count"), F.lit("unknown").alias("time_span"), F.col("weight").alias("confidence_score"))
    return R.signal_report(found).select("node_id", "place", "signal_type", "strength", "keyword", "entity", "confidence_score")


def queries() -> dict:
    return {f.__name__: f for f in (
        preprocessed, unprocessed, whole_impact_lists, text_parts, trigram_pairs, upserted_nodes, upserted_impact, upserted_signals, confidence_summary, quality_checks, table_rows, quality_health,
        cluster_profiles, cluster_contexts, cluster_spans, missing_nodes, near_positions, timeline_entries, signal_places, repeated_keys, node_records, expansion_candidates,
    )}


def _rules(kind: str) -> str:
    """One SQL list of each of the four lists for an event type."""
    return "CASE t " + " ".join(f"WHEN '{k}' THEN {{" + ", ".join(f"'{x}': {_words(own[x])}" for x in LISTS) + "}" for k, own in IMPACT_RULES.items()) + " END"


def oracle_sql() -> dict[str, str]:
    from .queries import CLEAN, HEAD, KEYWORDS, NORM, TERMS, _hits, _PHRASES, _ranked

    keywords = KEYWORDS.format("title").replace("{{", "{").replace("}}", "}")
    hits = "[" + ", ".join(f"{{'k': '{k}', 'n': {_hits('terms', w.split())}, 'i': {i}}}" for i, (k, w) in enumerate(EVENT_KEYWORDS.items())) + "]"
    sectors = f"list_transform(list_filter({_ranked(SECTOR_KEYWORDS)}, lambda s: s.n < 0)[1:3], lambda s: s.k)"
    actor = lambda side: "flatten(list_transform(sec, lambda s: CASE s " + " ".join(f"WHEN '{k}' THEN {_words(f'SECTOR [{k}]: {a}' for a in both[side])}" for k, both in SECTOR_ACTORS.items()) + " END))"
    lists = []
    for i, k in enumerate(LISTS):
        own = f"r.{k}"
        second = f"CASE WHEN blend THEN list_transform(r2.{k}, lambda e: replace(replace(e, 'DIRECT:', 'INDIRECT (secondary):'), 'INDIRECT:', 'INDIRECT (secondary):')) ELSE [] END"
        lists.append(f"array_to_string(list_sort(list_distinct(list_concat({own}, {second}{', ' + actor(i) if i < 2 else ''}))), '|') AS {k}")
    rules = "rules(t, r) AS (SELECT t, " + _rules("t") + f" FROM unnest({_words(IMPACT_RULES)}) u(t))"
    first = "list_filter(ev, lambda e: e.n = list_max(list_transform(ev, lambda x: x.n)))[1]"
    detected = _PHRASES + ", t AS (SELECT *, unnest(list_distinct(regexp_extract_all(lower(title), '[a-z0-9'']+'))) AS phrase FROM news), f AS (SELECT * FROM t JOIN p USING (phrase))"
    faults = """raw_news AS (SELECT id FROM news WHERE id % 7 > 0), cleaned AS (SELECT id FROM news WHERE id % 3 > 0), ec AS (SELECT id FROM news WHERE id % 5 > 0), cm AS (SELECT id FROM news WHERE id % 4 > 0),
        tl AS (SELECT id, id % 100 AS p, source AS g FROM news WHERE id % 2 = 0), im AS (SELECT id FROM news WHERE id % 3 = 0 UNION ALL SELECT id FROM news WHERE id % 12 = 0), sg AS (SELECT id, id + 3 AS node_id FROM news WHERE id % 6 = 1),
        nd AS (SELECT id, id AS cluster_id, source FROM news UNION ALL SELECT id + 1000000, id, source FROM news WHERE id % 13 = 0), {ed}""".replace("{ed}", _ED)
    lost = lambda child, key, parent: f"SELECT count(*) FROM {child} WHERE {key} NOT IN (SELECT id FROM {parent})"
    every = [
        ("cleaned_news.raw_news_id without raw_news", "error", lost("cleaned", "id", "raw_news")), ("cluster_news_map.cleaned_news_id without cleaned_news", "error", lost("cm", "id", "cleaned")),
        ("cluster_news_map.cluster_id without event_clusters", "error", lost("cm", "id", "ec")), ("nodes.cluster_id without event_clusters", "error", lost("nd", "cluster_id", "ec")),
        ("timeline.node_id without nodes", "error", lost("tl", "id", "nd")), ("edges.from_node_id without nodes", "error", lost("ed", "a", "nd")), ("edges.to_node_id without nodes", "error", lost("ed", "b", "nd")),
        ("impact.node_id without nodes", "error", lost("im", "id", "nd")), ("signals.node_id without nodes", "error", lost("sg", "node_id", "nd")),
        ("nodes repeated cluster_id", "warning", "SELECT count(*) FROM (SELECT cluster_id FROM nd GROUP BY cluster_id HAVING count(*) > 1)"), ("edges repeated from_node_id,to_node_id", "warning", "SELECT count(*) FROM (SELECT a FROM ed GROUP BY a, b HAVING count(*) > 1)"),
        ("impact repeated node_id", "warning", "SELECT count(*) FROM (SELECT id FROM im GROUP BY id HAVING count(*) > 1)"), ("timeline repeated timeline_group_id,position_index", "warning", "SELECT count(*) FROM (SELECT g FROM tl GROUP BY g, p HAVING count(*) > 1)"),
        ("nodes.entity empty", "warning", "SELECT count(*) FROM nd WHERE cluster_id % 11 = 0 OR trim(coalesce(source, '')) = ''"), ("nodes.event_type empty", "warning", "SELECT 0"), ("nodes.confidence_score out of range", "error", "SELECT 0"),
        ("edges.confidence_score out of range", "error", "SELECT count(*) FROM ed WHERE c > 1"), ("impact.confidence_score out of range", "error", "SELECT 0"), ("signals.confidence_score out of range", "error", "SELECT count(*) FROM sg"),
        ("edges self-loop", "warning", "SELECT count(*) FROM ed WHERE a = b"), ("timeline position gap", "info", "SELECT count(*) FROM (SELECT g FROM tl GROUP BY g HAVING max(p) > count(*) - 1)"),
        ("nodes more than one anchor", "info", "SELECT count(*) FROM (SELECT count(*) AS n FROM news WHERE id % 10 = 0) WHERE n > 1"), ("event_clusters without news", "info", lost("ec", "id", "cm")),
        ("nodes without timeline, impact and signal", "info", "SELECT count(*) FROM nd WHERE id NOT IN (SELECT id FROM tl) AND id NOT IN (SELECT id FROM im) AND id NOT IN (SELECT node_id FROM sg)"),
    ]
    report = " UNION ALL ".join(f"SELECT '{c}' AS \"check\", '{v}' AS severity, ({n})::BIGINT AS issues" for c, v, n in every)
    total = lambda v: f"coalesce(sum(issues) FILTER (WHERE severity = '{v}'), 0)::BIGINT"
    upper = "CASE WHEN y.id IS NULL THEN x.entity ELSE upper(y.source) END"
    topic = "CASE WHEN id % 6 > 0 THEN title END"
    return {
        "preprocessed": _q(f"SELECT id, md5(c) AS cleaned, md5({NORM.format('c')}) AS normalized, CASE WHEN length(regexp_replace({NORM.format('c')}, '\\PL', '', 'g')) > 0 AND length(regexp_replace({NORM.format('c')}, '[^a-zA-Z]', '', 'g')) / length(regexp_replace({NORM.format('c')}, '\\PL', '', 'g')) >= 0.85 THEN 'en' ELSE 'unknown' END AS language FROM x", f"x AS (SELECT id, {CLEAN.format('content')} AS c FROM news)"),
        "unprocessed": _q("SELECT id FROM news WHERE id % 3 <> 0"),
        "whole_impact_lists": _q(f"SELECT id, {', '.join(lists)} FROM (SELECT z.id, z.sec, z.blend, ra.r AS r, rb.r AS r2 FROM z JOIN rules ra ON ra.t = z.kind JOIN rules rb ON rb.t = z.second.k)",
            f"{rules}, x AS (SELECT id, {TERMS.format('title || chr(32) || content')} AS terms FROM news), y AS (SELECT id, terms, {hits} AS ev, {sectors} AS sec FROM x), y2 AS (SELECT *, {first} AS top FROM y), y3 AS (SELECT *, CASE WHEN top.n > 0 THEN top.k ELSE 'policy' END AS kind FROM y2), y4 AS (SELECT *, list_filter(ev, lambda e: e.k <> kind) AS rest, list_filter(ev, lambda e: e.k = kind)[1].n AS n FROM y3), y5 AS (SELECT *, list_filter(rest, lambda e: e.n = list_max(list_transform(rest, lambda x: x.n)))[1] AS second FROM y4), z AS (SELECT *, n > 0 AND second.n >= n * 0.5 AS blend FROM y5)"),
        "text_parts": _q("SELECT id, CASE WHEN id % 5 = 0 THEN 'unknown' ELSE upper(source) END AS strength, CASE WHEN id % 5 = 0 THEN title WHEN strpos(title, '(') > 1 THEN trim(split_part(title, '(', 1)) ELSE trim(title) END AS keyword, "
            + f"({_words([*EVENT_LABELS.values(), 'Development / Update'])})[id % 5 + 1] AS label, regexp_matches(lower(title), 'bank|oil|port') AS named, coalesce(strftime(published_at, '%Y-%m-%d') || '->' || strftime(created_at, '%Y-%m-%d'), 'unknown') AS span FROM news"),
        "trigram_pairs": _q("SELECT a.id, b.id AS other, round(len(list_intersect(a.g, b.g)) / greatest(len(a.g), len(b.g))::DOUBLE, 6) AS similarity FROM v a JOIN v b ON b.id = a.id + 12", f"h AS (SELECT id, {HEAD} AS head FROM news), v AS (SELECT id, CASE WHEN length(head) < 3 THEN [head] ELSE list_distinct(list_transform(range(1, length(head) - 1), lambda i: substr(head, i, 3))) END AS g FROM h)"),
        "upserted_nodes": _q(f"SELECT coalesce(x.id, y.id + 1000000) AS id, coalesce(x.id, y.id) AS cluster_id, {upper} AS entity, 'update' AS event_type, x.confidence_score FROM (SELECT * FROM nodes WHERE id % 2 = 0) x FULL JOIN (SELECT * FROM news WHERE id % 3 <> 1) y ON x.id = y.id", _NODES),
        "upserted_impact": _q("SELECT coalesce(x.id, y.id + 1000000) AS id, coalesce(x.id, y.id) AS node_id, CASE WHEN y.id IS NULL THEN (x.id % 7) / 7.0::DOUBLE ELSE (y.id % 7) / 7.0::DOUBLE + 1 END AS confidence_score FROM (SELECT id FROM news WHERE id % 2 = 0) x FULL JOIN (SELECT id FROM news WHERE id % 5 < 3) y ON x.id = y.id"),
        "upserted_signals": _q("SELECT id AS node_id, CASE WHEN id % 4 > 0 THEN source END AS entity, signal_type, CASE WHEN id % 3 = 0 THEN '[STRONG] ' ELSE '[WEAK] ' END || phrase || ' (sources 1)' AS phrase, CASE WHEN id % 3 = 0 THEN 'b' ELSE 'a' END AS time_span, CASE WHEN id % 2 > 0 THEN 1 WHEN id % 3 = 0 THEN 1 ELSE id % 3 END::INTEGER AS source_count, CASE WHEN id % 2 = 0 THEN weight ELSE weight / 2 END AS confidence_score FROM f WHERE id % 2 = 0 OR id % 3 = 0", detected),
        "confidence_summary": _q("SELECT id AS node_id, round(min(c), 3) AS least, round(max(c), 3) AS most, round(avg(c), 3) AS mean, count(*) AS n FROM (SELECT id, 0.7::DOUBLE AS c FROM news UNION ALL SELECT id, (id % 9) / 9.0::DOUBLE FROM news WHERE id % 3 > 0 UNION ALL SELECT id, weight FROM f) GROUP BY id", detected),
        "quality_checks": _q(report, faults),
        "quality_health": _q(f"SELECT {total('error')} AS errors, {total('warning')} AS warnings, {total('info')} AS infos, CASE WHEN {total('error')} > 0 THEN 'errors' WHEN {total('warning')} > 0 THEN 'warnings' ELSE 'healthy' END AS health FROM ({report})", faults),
        "table_rows": _q(" UNION ALL ".join(f"SELECT '{n}' AS table_name, (SELECT count(*) FROM {t}) AS n" for n, t in (("raw_news", "raw_news"), ("cleaned_news", "cleaned"), ("event_clusters", "ec"), ("cluster_news_map", "cm"), ("nodes", "nd"), ("edges", "ed"), ("timeline", "tl"), ("impact", "im"), ("signals", "sg"))), faults),
        "cluster_profiles": _q("SELECT w.cluster_id, words, texts FROM (SELECT id % 40 AS cluster_id, array_to_string(list_sort(list_distinct(flatten(list(k)))), ' ') AS words FROM v GROUP BY 1) w JOIN (SELECT id % 40 AS cluster_id, string_agg(t, '|' ORDER BY id) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY id % 40 ORDER BY id) AS n FROM v) WHERE n <= 3 GROUP BY 1) x ON x.cluster_id = w.cluster_id", f"v AS (SELECT id, {keywords} AS k, {NORM.format('title')} AS t FROM news)"),
        "cluster_contexts": _q(f"SELECT id % 40 AS cluster_id, max(coalesce(published_at, created_at)) AS latest_ts, md5(string_agg({NORM.format('title')}, ' ' ORDER BY id)) AS context FROM news GROUP BY 1"),
        "cluster_spans": _q("SELECT id % 40 AS cluster_id, min(coalesce(published_at, created_at)) AS first_ts, max(coalesce(published_at, created_at)) AS last_ts, count(DISTINCT source) AS source_count FROM news GROUP BY 1"),
        "missing_nodes": _q(f"SELECT -id - 1 AS id, id AS cluster_id, CASE WHEN id % 6 > 0 THEN string_split(title, ' ')[1] ELSE 'event' END AS entity, 'expansion' AS event_type, md5(coalesce(nullif(substr(content, 1, 1000), ''), {topic})) AS description, coalesce(published_at, TIMESTAMP '{AS_OF}') AS timestamp, 0.6::DOUBLE AS confidence_score FROM news WHERE id % 2 <> 0"),
        "near_positions": _q("SELECT a.id, b.id AS other, b.p AS place FROM o a JOIN o b ON b.p BETWEEN a.p + 1 AND a.p + 5 AND coalesce(a.published_at >= b.published_at, true)", "o AS (SELECT id, published_at, CAST(row_number() OVER (ORDER BY id = (SELECT id FROM news ORDER BY published_at DESC NULLS LAST, id LIMIT 1) DESC, published_at DESC NULLS LAST, id) - 1 AS INTEGER) AS p FROM news)"),
        "timeline_entries": _q("SELECT source AS timeline_group_id, id AS node_id, CAST(id % 100 AS INTEGER) AS position, source AS entity, 'Development / Update' AS event_label, count(*) OVER (PARTITION BY source) AS total_events, targets FROM news JOIN (SELECT a, string_agg(CAST(b AS VARCHAR), ',' ORDER BY c DESC, b) AS targets FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM ed) WHERE k <= 2 GROUP BY a) ON a = id WHERE id % 2 = 0", _ED),
        "repeated_keys": _q(" UNION ALL ".join(f"SELECT '{name} repeated {label}' AS \"check\", CAST(row_number() OVER (ORDER BY {key}) AS INTEGER) AS place, {text} AS \"key\", count(*) AS n FROM {t} GROUP BY {key} HAVING count(*) > 1 QUALIFY row_number() OVER (ORDER BY {key}) <= 10"
            for name, label, t, key, text in (("nodes", "cluster_id", "nd", "cluster_id", "CAST(cluster_id AS VARCHAR)"), ("edges", "from_node_id,to_node_id", "ed", "a, b", "a || ',' || b"), ("impact", "node_id", "im", "id", "CAST(id AS VARCHAR)"), ("timeline", "timeline_group_id,position_index", "tl", "g, p", "g || ',' || p"))), faults),
        "node_records": _q(f"""SELECT n.id AS node_id, coalesce(CASE WHEN n.id % 11 > 0 THEN source END, '') AS entity, CASE WHEN n.id % 4 = 0 THEN '{EVENT_LABELS["trigger"]}' ELSE 'Development / Update' END AS event_label, CASE WHEN n.id % 2 = 0 THEN source END AS timeline_group_id, CASE WHEN n.id % 2 = 0 THEN CAST(n.id % 100 AS INTEGER) END AS position, coalesce(g.total, 0) AS total_events,
            targets, i.direct AS direct_winners, i.sector AS sectors, s.items AS signals, c.least, c.most, c.mean, c.n, 1::BIGINT AS data_sources FROM news n LEFT JOIN (SELECT source AS g, count(*) AS total FROM news WHERE id % 2 = 0 GROUP BY 1) g ON n.id % 2 = 0 AND g.g = n.source
            LEFT JOIN (SELECT a, string_agg(CAST(b AS VARCHAR), ',' ORDER BY c DESC, b) AS targets FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, lpad(CAST(b AS VARCHAR), 20, '0')) AS k FROM ed) WHERE k <= 2 GROUP BY a) e ON e.a = n.id
            LEFT JOIN (SELECT id, source || ' traders' AS direct, 'SECTOR [x]: ' || source AS sector FROM news WHERE id % 3 = 0) i ON i.id = n.id LEFT JOIN (SELECT id, string_agg(phrase || ':WEAK', ',' ORDER BY weight DESC, phrase) AS items FROM f GROUP BY id) s ON s.id = n.id
            JOIN (SELECT id, round(min(c), 3) AS least, round(max(c), 3) AS most, round(avg(c), 3) AS mean, count(*) AS n FROM (SELECT id, 0.7::DOUBLE AS c FROM news UNION ALL SELECT id, 0.5::DOUBLE FROM news WHERE id % 3 = 0 UNION ALL SELECT id, weight FROM f) GROUP BY id) c ON c.id = n.id""", _ED + ", " + detected),
        "expansion_candidates": _q("SELECT DISTINCT x.id AS node_id, y.id AS to_cluster FROM a x JOIN a y ON x.word = y.topic AND x.id <> y.id AND abs(epoch_us(x.published_at) - epoch_us(y.published_at)) <= 21600000000",
            f"e AS (SELECT id, published_at, unnest({TERMS.format("string_split(title, ' ')[1]")}) AS word FROM news WHERE published_at IS NOT NULL), t AS (SELECT id, published_at, unnest({TERMS.format('substr(title, 1, 40)')}) AS topic FROM news WHERE published_at IS NOT NULL), a AS (SELECT id, published_at, word, NULL AS topic FROM e UNION ALL SELECT id, published_at, NULL, topic FROM t)"),
        "signal_places": _q("SELECT id AS node_id, CAST(row_number() OVER (PARTITION BY id ORDER BY weight DESC, signal_type, '[WEAK] ' || phrase || ' (sources 1)') AS INTEGER) AS place, signal_type, 'WEAK' AS strength, phrase AS keyword, source AS entity, weight AS confidence_score FROM f", detected),
        "entities": _q("SELECT id, entity, n_entities FROM e3", entity_sql()),
        "stated_causes": _q("SELECT id, entity, -c.m AS confidence, c.event AS event, c.trigger AS trigger, c.predecessor AS predecessor, title AS evidence FROM s3", entity_sql() + ", " + cause_sql()),
        "keyword_overlaps": _q("SELECT a.id AS left_id, b.id AS right_id, round(count(*) / least(a.n, b.n)::DOUBLE, 6) AS score FROM w a JOIN w b ON a.word = b.word AND a.id < b.id GROUP BY a.id, b.id, a.n, b.n HAVING count(*) / least(a.n, b.n)::DOUBLE >= 0.65", f"v AS (SELECT id, {keywords} AS k FROM news), w AS (SELECT id, len(k) AS n, unnest(k) AS word FROM v)"),
    }


def entity_sql() -> str:
    """CTEs ending in e3 (id, title, entity, n_entities): names in the order found, then by priority."""
    item = lambda k: f"'{ENTITIES[k][1]}|{ENTITIES[k][0]}'"
    single = "CASE {} " + " ".join(f"WHEN '{k}' THEN {item(k)}" for k in ENTITIES if " " not in k) + " END"
    many = "[" + ", ".join(f"CASE WHEN contains(low, '{k}') THEN {item(k)} END" for k in ENTITIES if " " in k) + "]"
    # letters beyond ASCII count as letters at a word's border
    plain = r"regexp_replace(title, '[^\x00-\x7F\p{P}\p{S}\p{Z}\p{C}]', '_', 'g')"
    generic = _words(GENERIC_WORDS)
    return (
        f"e0 AS (SELECT id, title, lower(title) AS low, regexp_extract_all({plain}, '\\b[A-Z][a-z]{{2,}}\\b') AS proper FROM news), "
        f"e1 AS (SELECT id, title, list_filter(list_concat({many}, list_transform(regexp_extract_all(low, '[a-z0-9]+'), lambda w: {single.format('w')}), "
        f"list_transform(proper, lambda w: CASE WHEN NOT list_contains({generic}, lower(w)) AND {single.format('lower(w)')} IS NULL THEN '0|' || w END)), lambda x: x IS NOT NULL) AS f FROM e0), "
        "e2 AS (SELECT id, title, list_filter(f, lambda x, i: list_position(f, x) = i) AS f FROM e1), "
        "e2b AS (SELECT *, list_transform(list_sort(list_transform(f, lambda x, i: {'p': -CAST(x[1] AS INTEGER), 'i': i, 'n': x[3:]})), lambda s: s.n) AS names FROM e2), "
        f"e3 AS (SELECT id, title, len(f) AS n_entities, CASE WHEN len(f) > 0 THEN array_to_string(list_filter(names, lambda x, i: list_position(names, x) = i)[1:3], ', ') ELSE coalesce(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: w <> '' AND NOT list_contains({generic}, lower(w)))[1], 'event') END AS entity FROM e2b)"
    )


def cause_sql() -> str:
    """CTEs ending in s3 (id, title, entity, c): the best stated cause by confidence, then by order of patterns."""
    found = []
    for i, (phrase, _, effect) in enumerate(CAUSAL_PATTERNS):
        cut = rf"(?is)^(.*?)\b({phrase})\b(.*)$"
        left, right = (f"trim(regexp_extract(title, '{cut}', {g}))" for g in (1, 3))
        event, before = (left, right) if effect == "left" else (right, left)
        score = f"CASE WHEN entity <> '' AND contains(lower({event}), lower(entity)) THEN -0.95::DOUBLE ELSE -0.8::DOUBLE END"
        found.append(rf"CASE WHEN regexp_matches(title, '(?i)\b{phrase}\b') THEN {{'m': {score}, 'i': {i}, 'event': coalesce(nullif({event}, ''), title), 'trigger': '{phrase}', 'predecessor': {before}}} END")
    none = "{'m': -0.5::DOUBLE, 'i': 0, 'event': title, 'trigger': 'N/A', 'predecessor': 'N/A'}"
    return f"s3 AS (SELECT id, title, entity, coalesce(list_sort(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))[1], {none}) AS c FROM e3)"
