"""Queries over the news view by operator, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store_queries
from .functions import text as T
from .lexicons import CUES, EVENT_KEYWORDS, EVENT_TYPES, HEADLINE_STOPWORDS, KEYWORD_STOPWORDS, NEGATIVE, POSITIVE, SECTOR_KEYWORDS, SIGNAL_PHRASES
from .news import AS_OF, NEWS_SQL, news
from .operators import articles as A
from .operators import expand as E
from .operators import headlines as H
from .operators import impact as I
from .operators import search as R
from .operators import signals as S
from .operators import timeline as L

def _now():
    return F.to_timestamp(F.lit(AS_OF))


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _q(body: str, more: str = "") -> str:
    return f"WITH {NEWS_SQL}{', ' + more if more else ''} {body}"


CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '<[^>]+>', ' ', 'g'), '[^a-zA-Z0-9\s.,;:!?''\-]', ' ', 'g'), '\s+', ' ', 'g'))"
NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
HEAD = NORM.format(CLEAN.format("title"))
KEYWORDS = f"list_distinct(list_filter(list_transform(regexp_extract_all({{}}, '[a-zA-Z0-9]{{{{3,}}}}'), lambda w: lower(w)), lambda w: NOT list_contains({_list(KEYWORD_STOPWORDS)}, w))[1:20])"
TERMS = "list_distinct(list_transform(regexp_extract_all({}, '[a-zA-Z0-9]{{3,}}'), lambda w: lower(w)))"
STAMP = "coalesce(strftime(published_at, '%Y-%m-%dT%H:%M:%S+00:00'), '')"
JOINED = "array_to_string(list_sort({}), ' ')"


def _hits(lst: str, words) -> str:
    return f"len(list_intersect({lst}, {_list(words)}))"


def article_keys(s, d) -> DataFrame:
    return A.keyed(A.normalized_input(news(s, d))).select("id", "unique_id")


def clean_articles(s, d) -> DataFrame:
    t = T.clean_text(F.col("title"))
    return news(s, d).select("id", t.alias("cleaned"), T.normalize_text(t).alias("normalized"), T.infer_language(F.col("content")).alias("language"))


def page_sources(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/pages.parquet").select("page_id", T.source_of(F.col("url")).alias("source"), T.clean_text(F.col("html")).alias("body"))


def headline_tokens(s, d) -> DataFrame:
    head = T.normalize_text(T.clean_text(F.col("title")))
    tok = T.significant_tokens(head)
    return news(s, d).select("id", F.array_join(tok, " ").alias("tokens"), F.array_join(F.sort_array(T.trigrams(head)), "|").alias("trigrams"), F.array_join(F.sort_array(T.blocking_keys(head, tok)), "|").alias("keys"))


def article_keywords(s, d) -> DataFrame:
    k = T.keywords(F.col("title"))
    return news(s, d).select("id", F.array_join(F.sort_array(k), " ").alias("keywords"), T.cluster_key(k).alias("cluster_key"), T.timeline_group(T.cluster_key(k)).alias("timeline_group"))


def exact_headlines(s, d) -> DataFrame:
    w = Window.partitionBy("head").orderBy("id")
    n = news(s, d).select("id", T.normalize_text(T.clean_text(F.col("title"))).alias("head"))
    return n.withColumn("n", F.row_number().over(w)).where("n = 1").select("id", F.col("head").alias("headline"))


def new_rows(s, d) -> DataFrame:
    n = news(s, d)
    return A.new_articles(n, A.keyed(n.where("id % 3 = 0"))).select("id", "unique_id")


def similarity_pairs(s, d) -> DataFrame:
    n = news(s, d).select("id", "title", "published_at")
    after = n.select((F.col("id") - 12).alias("id"), F.col("id").alias("other"), F.col("title").alias("t2"), F.col("published_at").alias("p2"))
    a, b = T.terms(F.col("title")), T.terms(F.col("t2"))
    p = n.join(after, "id")
    return p.select("id", "other", F.round(T.overlap(T.keywords(F.col("title")), T.keywords(F.col("t2"))), 6).alias("overlap"), F.round(T.jaccard(a, b), 6).alias("jaccard"), F.round(T.temporal(F.col("published_at"), F.col("p2")), 6).alias("temporal"), T.within_days(F.col("published_at"), F.col("p2"), 7).alias("near"))


def signal_phrases(s, d) -> DataFrame:
    return S.detect(news(s, d), F.concat_ws(" ", "title", "content")).select("id", "phrase", "signal_type", "weight")


def _groups(s, d) -> DataFrame:
    f = S.detect(news(s, d), F.concat_ws(" ", "title", "content")).withColumn("at", F.coalesce("published_at", "created_at"))
    f = f.withColumn("entity", F.col("source")).withColumn("source_count", F.lit(1)).withColumn("first_ts", F.col("at")).withColumn("last_ts", F.col("at"))
    return S.accumulate(f)


def signal_strength(s, d) -> DataFrame:
    out = S.score(_groups(s, d), _now())
    return out.select("entity", "signal_type", "phrase", "frequency", "confidence_score", S.label(F.col("confidence_score")).alias("strength"), "time_span", "text")


def impact_types(s, d) -> DataFrame:
    out = I.analyze(news(s, d), F.concat_ws(" ", "title", "content"))
    return out.select("id", "impact_type", F.array_join("sectors", ",").alias("sectors"), "direction", "confidence_score")


def impact_lists(s, d) -> DataFrame:
    out = I.analyze(news(s, d), F.col("title"))
    return out.select("id", *[F.array_join(k, "|").alias(k) for k in I.LISTS])


def event_types(s, d) -> DataFrame:
    own = T.terms(F.concat_ws(" ", "title", "content"))
    return news(s, d).select("id", L.event_type(own).alias("event_type"), F.coalesce(L.strongest_cue(own)["weight"], F.lit(0.0)).alias("weight"))


def entities(s, d) -> DataFrame:
    found = L.entities(F.col("title"))
    return news(s, d).select("id", L.entity_string(found, F.col("title")).alias("entity"), F.size(found).alias("n_entities"))


def stated_causes(s, d) -> DataFrame:
    n = news(s, d).withColumn("entity", L.entity_string(L.entities(F.col("title")), F.col("title")))
    return n.select("id", "entity", L.primitives(F.array("title"), F.col("entity")).alias("p")).select("id", "entity", (-F.col("p.minus_confidence")).alias("confidence"), "p.event", "p.trigger", "p.predecessor", "p.evidence")


def _members(s, d) -> DataFrame:
    return news(s, d).withColumn("cluster_id", F.col("id") % 12)


def cluster_stats(s, d) -> DataFrame:
    return L.cluster_stats(_members(s, d)).select("cluster_id", "frequency", "source_count", "latest_ts")


def cluster_topics(s, d) -> DataFrame:
    return A.main_topics(_members(s, d))


def cluster_titles(s, d) -> DataFrame:
    return L.newest_titles(_members(s, d)).select("cluster_id", F.array_join("titles", "|").alias("titles"))


def keyword_overlaps(s, d) -> DataFrame:
    own = news(s, d).select("id", T.keywords(F.col("title")).alias("words"))
    out = A.keyword_pairs(own, 0.65)
    return out.select(F.col("a").alias("left_id"), F.col("b").alias("right_id"), F.round("score", 6).alias("score"))


def kept_articles(s, d) -> DataFrame:
    n = news(s, d)
    return n.select("id").join(H.duplicates(n)[0], "id", "left_anti")


def second_run(s, d) -> DataFrame:
    """Articles that two runs keep: a third of them first, the others against the index of the kept headlines."""
    n = news(s, d)
    one, two = n.where("id % 3 = 0"), n.where("id % 3 <> 0")
    gone, index = H.duplicates(one)
    more, _ = H.duplicates(two, index=index)
    return n.select("id").join(gone.unionByName(more), "id", "left_anti")


def headline_clusters(s, d) -> DataFrame:
    """Clusters of all articles by their whole headlines: as keywords and as the text that is compared."""
    return A.cluster_articles(news(s, d).withColumn("normalized_text", T.normalize_text(T.clean_text(F.col("title")))))


def expansion_edges(s, d) -> DataFrame:
    """Edges from the nodes of the articles with even ids; every article is a cluster, its headline the topic and the text."""
    n = news(s, d).withColumn("cluster_id", F.col("id")).withColumn("normalized_text", T.normalize_text(T.clean_text(F.col("title"))))
    about = E.outlines(n).join(n.select("cluster_id", F.col("title").alias("main_topic")), "cluster_id")
    nodes = n.where("id % 2 = 0").select("id", "cluster_id", F.get(F.split("title", " "), 0).alias("entity"), F.col("published_at").alias("timestamp"))
    known = nodes.select(F.col("id").alias("from_node_id"), (F.col("id") + 10).alias("to_node_id"), F.lit("causes").alias("relation_type"))
    return E.expand(nodes, about, n, nodes, known, days=1).select("from_node_id", "to_node_id", "made")


def _nodes(s, d) -> DataFrame:
    m = news(s, d).withColumn("cluster_id", F.col("id"))
    topics = m.select("cluster_id", T.keywords(F.col("title")).alias("words")).select("cluster_id", F.array_join(F.slice("words", 1, 3), " ").alias("main_topic"), T.cluster_key(F.col("words")).alias("cluster_key"))
    return L.build_nodes(m, topics, _now())


def timeline_order(s, d) -> DataFrame:
    n = news(s, d).select("id", F.lit("k").alias("cluster_key"), F.col("published_at").alias("timestamp"), (F.col("id") % 7).cast("double").alias("score"), F.lit(1).alias("frequency"), F.lit(1).alias("source_count"))
    return L.ordered(n).select("id", "position_index", "is_anchor")


def causal_edges(s, d) -> DataFrame:
    return L.build_timeline(_nodes(s, d))[1]


def event_search(s, d) -> DataFrame:
    n = _nodes(s, d).withColumn("is_anchor", F.lit(False))
    asked = s.createDataFrame([("oil prices in Hormuz",), ("bank merger",), ("UAE wants to help US force Hormuz open",)], "query string")
    return R.search(n, asked, _now(), 25)


def node_signals(s, d) -> DataFrame:
    n = _nodes(s, d)
    m = news(s, d).withColumn("cluster_id", F.col("id"))
    return S.detect_signals(n, S.cluster_span(m), _now())


def queries() -> dict:
    return store_queries.queries() | {k: globals()[k] for k in (
        "signal_strength", "article_keys", "clean_articles", "page_sources", "headline_tokens", "article_keywords", "exact_headlines", "new_rows", "similarity_pairs", "signal_phrases",
        "impact_types", "impact_lists", "event_types", "entities", "stated_causes", "cluster_stats", "cluster_topics", "cluster_titles", "keyword_overlaps", "kept_articles", "timeline_order",
        "causal_edges", "event_search", "node_signals", "second_run", "headline_clusters", "expansion_edges",
    )}


_PHRASES = "p(phrase, signal_type, weight) AS (VALUES " + ", ".join(f"('{p}', '{t}', {w}::DOUBLE)" for t, own in SIGNAL_PHRASES.items() for p, w in own.items()) + ")"
_FOUND = "t AS (SELECT *, unnest(list_distinct(regexp_extract_all(lower(title || ' ' || content), '[a-z0-9'']+'))) AS phrase FROM news), f AS (SELECT * FROM t JOIN p USING (phrase))"
_CUES = "c(term, relation, weight, place) AS (VALUES " + ", ".join(f"('{w}', '{r}', {x}::DOUBLE, {i})" for i, (w, (r, x)) in enumerate(CUES.items())) + ")"


def _ranked(lexicon) -> str:
    return "list_sort([" + ", ".join(f"{{'n': -{_hits('terms', w.split())}, 'i': {i}, 'k': '{k}'}}" for i, (k, w) in enumerate(lexicon.items())) + "])"


def oracle_sql() -> dict[str, str]:
    return store_queries.oracle_sql() | _news_sql()


def _news_sql() -> dict[str, str]:
    kind_hits = "CASE impact_type " + " ".join(f"WHEN '{k}' THEN {_hits('terms', w.split())}" for k, w in EVENT_KEYWORDS.items()) + " END"
    return {
        "signal_strength": _q("""SELECT entity, signal_type, phrase, frequency, s AS confidence_score, CASE WHEN s >= 0.6 THEN 'STRONG' WHEN s >= 0.35 THEN 'MEDIUM' ELSE 'WEAK' END AS strength, strftime(a, '%Y-%m-%d') || '->' || strftime(b, '%Y-%m-%d') AS time_span,
            format('[{}] {} (occurrences×{}, sources×1)', CASE WHEN s >= 0.6 THEN 'STRONG' WHEN s >= 0.35 THEN 'MEDIUM' ELSE 'WEAK' END, phrase, frequency) AS text
            FROM (SELECT *, round(least(greatest(0.3::DOUBLE * least(frequency / 5.0::DOUBLE, 1.0) + 0.25::DOUBLE * 0.25::DOUBLE + 0.25::DOUBLE * last + 0.2::DOUBLE * weight, 0.0), 1.0), 3) AS s FROM (SELECT *, round(least(greatest((epoch_us(b) - epoch_us(a)) / 86400e6, 0.0) / 7.0::DOUBLE, 1.0) * greatest(0.0, 1.0 - greatest((epoch_us(TIMESTAMP '2024-02-01') - epoch_us(b)) / 86400e6, 0.0) / 30.0::DOUBLE), 3) AS last FROM g)) WHERE s >= 0.25""",
            _PHRASES + ", " + _FOUND + ", g AS (SELECT source AS entity, signal_type, phrase, count(*) AS frequency, min(coalesce(published_at, created_at)) AS a, max(coalesce(published_at, created_at)) AS b, max(weight) AS weight FROM f GROUP BY 1, 2, 3)"),
        "article_keys": _q(f"SELECT id, sha256(trim(title) || '|' || trim(source) || '|' || {STAMP}) AS unique_id FROM news WHERE trim(title) <> '' AND trim(content) <> '' AND trim(coalesce(source, '')) <> ''"),
        "clean_articles": _q(f"SELECT id, {CLEAN.format('title')} AS cleaned, {NORM.format(CLEAN.format('title'))} AS normalized, CASE WHEN length(regexp_replace(content, '\\PL', '', 'g')) > 0 AND length(regexp_replace(content, '[^a-zA-Z]', '', 'g')) / length(regexp_replace(content, '\\PL', '', 'g')) >= 0.85 THEN 'en' ELSE 'unknown' END AS language FROM news"),
        "page_sources": f"SELECT page_id, coalesce(nullif(regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), '^www\\.', ''), ''), 'unknown-source') AS source, {CLEAN.format('html')} AS body FROM pages",
        "headline_tokens": _q("SELECT id, array_to_string(tok, ' ') AS tokens, array_to_string(CASE WHEN length(head) < 3 THEN [head] ELSE list_sort(list_distinct(list_transform(range(1, length(head) - 1), lambda i: substr(head, i, 3)))) END, '|') AS trigrams, array_to_string(list_sort(list_distinct(list_concat(['p:' || substr(head, 1, 16)], list_filter(flatten(list_transform(range(1, 5), lambda i: list_transform(range(i + 1, 5), lambda j: 't:' || tok[i] || '_' || tok[j]))), lambda x: x IS NOT NULL), CASE WHEN len(tok) > 0 THEN ['s:' || tok[1]] ELSE [] END))), '|') AS keys FROM h",
            f"h0 AS (SELECT id, {HEAD} AS head FROM news), h AS (SELECT id, head, list_sort(list_filter(string_split(head, ' '), lambda w: length(w) >= 3 AND NOT list_contains({_list(HEADLINE_STOPWORDS)}, w))) AS tok FROM h0)"),
        "article_keywords": _q("SELECT id, array_to_string(list_sort(k), ' ') AS keywords, key AS cluster_key, 'timeline-' || substr(sha256(key), 1, 12) AS timeline_group FROM (SELECT id, k, substr(sha256(array_to_string(list_sort(k)[1:5], '|')), 1, 24) AS key FROM (SELECT id, " + KEYWORDS.format("title").replace("{{", "{").replace("}}", "}") + " AS k FROM news))"),
        "exact_headlines": _q(f"SELECT min(id) AS id, head AS headline FROM (SELECT id, {HEAD} AS head FROM news) GROUP BY head"),
        "new_rows": _q("SELECT min(id) AS id, unique_id FROM k WHERE unique_id NOT IN (SELECT unique_id FROM k WHERE id % 3 = 0) GROUP BY unique_id", f"k AS (SELECT id, sha256(trim(title) || '|' || trim(source) || '|' || {STAMP}) AS unique_id FROM news WHERE trim(title) <> '' AND trim(content) <> '')"),
        "signal_phrases": _q("SELECT id, phrase, signal_type, weight FROM f", _PHRASES + ", " + _FOUND),
        "impact_types": _q(f"""SELECT id, impact_type, array_to_string(sec, ',') AS sectors, CASE WHEN up > down THEN 'positive' WHEN down > up THEN 'negative' ELSE 'neutral' END AS direction,
            round(least(greatest(0.5::DOUBLE * least({kind_hits} / 5.0::DOUBLE, 1.0) + 0.3::DOUBLE * least(abs(up - down) / 3.0::DOUBLE, 1.0) + 0.2::DOUBLE * least(len(sec) / 2.0::DOUBLE, 1.0), 0.25), 0.95), 3) AS confidence_score FROM y""",
            f"x AS (SELECT id, {TERMS.format("title || ' ' || content")} AS terms FROM news), y0 AS (SELECT id, terms, {_ranked(EVENT_KEYWORDS)}[1] AS e, list_transform(list_filter({_ranked(SECTOR_KEYWORDS)}, lambda s: s.n < 0)[1:3], lambda s: s.k) AS sec, {_hits('terms', POSITIVE)} AS up, {_hits('terms', NEGATIVE)} AS down FROM x), y AS (SELECT *, CASE WHEN e.n < 0 THEN e.k ELSE 'policy' END AS impact_type FROM y0)"),
        "event_types": _q("SELECT n.id, coalesce(arg_min(CASE relation " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_TYPES.items()) + " END, -weight * 1000 + place / 1000.0), 'update') AS event_type, coalesce(max(weight), 0.0::DOUBLE) AS weight FROM news n LEFT JOIN m ON m.id = n.id GROUP BY n.id",
            _CUES + f", t AS (SELECT id, unnest({TERMS.format("title || ' ' || content")}) AS term FROM news), m AS (SELECT * FROM t JOIN c USING (term))"),
        "cluster_stats": _q("SELECT id % 12 AS cluster_id, count(*) AS frequency, count(DISTINCT source) AS source_count, max(coalesce(published_at, created_at)) AS latest_ts FROM news GROUP BY 1"),
        "cluster_topics": _q("SELECT cluster_id, string_agg(word, ' ' ORDER BY place) AS main_topic FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, a, p) AS place FROM g) WHERE place <= 3 GROUP BY cluster_id",
            f"w AS (SELECT id, generate_subscripts(l, 1) AS pos, lower(unnest(l)) AS word FROM (SELECT id, regexp_extract_all(title, '[a-zA-Z0-9]{{3,}}') AS l FROM news)), g AS (SELECT id % 12 AS cluster_id, word, count(*) AS n, min(id * 100000 + pos) // 100000 AS a, min(id * 100000 + pos) % 100000 AS p FROM w WHERE NOT list_contains({_list(KEYWORD_STOPWORDS)}, word) GROUP BY 1, 2)"),
        "cluster_titles": _q("SELECT cluster_id, string_agg(title, '|' ORDER BY n) AS titles FROM (SELECT id % 12 AS cluster_id, title, row_number() OVER (PARTITION BY id % 12 ORDER BY created_at DESC, id) AS n FROM news) WHERE n <= 3 GROUP BY cluster_id"),
        "similarity_pairs": _q("""SELECT a.id, b.id AS other, round(len(list_intersect(a.k, b.k)) / least(len(a.k), len(b.k))::DOUBLE, 6) AS overlap, round(len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t)))::DOUBLE, 6) AS jaccard,
            coalesce(round(greatest(0.0, 1.0 - abs(epoch_us(a.published_at) - epoch_us(b.published_at)) / 86400e6 / 30.0::DOUBLE), 6), 0.15) AS temporal, coalesce(abs(epoch_us(a.published_at) - epoch_us(b.published_at)) <= 604800000000, false) AS near FROM v a JOIN v b ON b.id = a.id + 12""",
            "v AS (SELECT id, published_at, " + KEYWORDS.format("title").replace("{{", "{").replace("}}", "}") + f" AS k, {TERMS.format('title')} AS t FROM news)"),
        "timeline_order": _q("SELECT id, CAST(row_number() OVER (ORDER BY is_anchor DESC, published_at DESC NULLS LAST, s DESC, id) - 1 AS INTEGER) AS position_index, is_anchor FROM (SELECT *, id = (SELECT id FROM (SELECT id, id % 7 AS s, published_at FROM news) ORDER BY s DESC, published_at DESC NULLS LAST, id LIMIT 1) AS is_anchor, id % 7 AS s FROM news)"),
    }
