"""Ranked event search for a table of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words_array
from ..lexicons import LOW_WEIGHT, SEARCH_STOPWORDS, SYNONYMS
from .graph import settled


def tokenize(query: Column) -> Column:
    """Struct (base, synonyms, core) of a query text."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(query), r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")), " ")
    base = F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(words_array(SEARCH_STOPWORDS), w)))
    table = F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), words_array(v))])
    none = F.array().cast("array<string>")
    more = F.array_distinct(F.flatten(F.transform(base, lambda w: F.coalesce(F.try_element_at(table, w), none))))
    base = F.when(F.size(base) > 0, base).otherwise(F.array(F.lower(F.trim(query))))
    heavy = F.filter(base, lambda w: ~F.array_contains(words_array(LOW_WEIGHT), w))
    core = F.filter(heavy, lambda w: F.length(w) >= 3)
    return F.struct(base.alias("base"), more.alias("synonyms"), F.when(F.size(core) > 0, core).when(F.size(heavy) > 0, heavy).otherwise(base).alias("core"))


def _total(words: Column, value) -> Column:
    return F.aggregate(words, F.lit(0.0), lambda a, w: a + value(w))


def relevance(q: Column, term: Column, entity: Column, topic: Column, text: Column) -> Column:
    """The score of one node for one query without recency and anchor; null where no core word occurs."""
    low = words_array(LOW_WEIGHT)
    one = lambda c: F.when(c, 1.0).otherwise(0.0)
    weigh = lambda w, hit, full, small: F.when(hit, F.when(F.array_contains(low, w), small).otherwise(full)).otherwise(0.0)
    in_e, in_t, in_d = (lambda w: F.contains(entity, w)), (lambda w: F.contains(topic, w)), (lambda w: F.contains(text, w))
    strong = lambda w: one(~F.array_contains(low, w))
    whole = F.when(entity == term, 30.0).when(F.contains(entity, term), 15.0).otherwise(0.0) + 5.0 * one(F.contains(text, term)) + 5.0 * one(F.contains(topic, term))
    score = whole + _total(q["base"], lambda w: weigh(w, in_e(w), 10.0, 0.5) + weigh(w, in_t(w), 5.0, 0.5) + weigh(w, in_d(w), 2.0, 0.2)) + _total(q["synonyms"], lambda w: weigh(w, in_e(w), 10.0, 0.5))
    matched = _total(q["base"], lambda w: one(in_e(w) | in_t(w) | in_d(w))) + _total(q["synonyms"], lambda w: one(in_e(w)))
    firm = _total(q["base"], lambda w: strong(w) * (one(in_e(w)) + one(in_t(w)))) + _total(q["synonyms"], lambda w: strong(w) * one(in_e(w)))
    is_core = lambda w: F.array_contains(q["core"], w)
    core_e = _total(q["base"], lambda w: one(is_core(w) & in_e(w))) + _total(q["synonyms"], lambda w: one(is_core(w) & in_e(w)))
    core_t = _total(q["base"], lambda w: one(is_core(w) & in_t(w)))
    core_d = _total(q["base"], lambda w: one(is_core(w) & in_d(w) & ~in_e(w) & ~in_t(w)))
    score = score + F.when(matched > 1, matched * 2.0).otherwise(0.0)
    score = score * F.when(firm == 0, 0.1).otherwise(1.0)
    score = score * F.when((core_e == 0) & (core_t == 0) & (core_d > 0), 0.15).otherwise(1.0)
    score = score + F.when(F.size(q["core"]) > 1, (core_e + core_t + core_d) / F.size(q["core"]) * 10.0).otherwise(0.0) + core_e * 8.0
    return F.when(core_e + core_t + core_d > 0, score)


def grams(text: Column) -> Column:
    """The distinct pieces of a text of one to three characters, and the empty one: every text of up to three characters that it contains."""
    n = F.length(text)
    of = lambda k: F.when(n >= k, F.transform(F.sequence(F.lit(1), F.greatest(n - k + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), of(1), of(2), of(3)))


def candidates(asked: DataFrame, texts: DataFrame, few: int = 256) -> DataFrame:
    """(query, id): nodes whose text contains a core word of a query. asked: query, core; texts: id, text.

    Up to `few` different words are sent to all tasks, and each text is looked through once for each of them. More are
    looked up by that of their pieces of three characters (or by themselves, if they are shorter) which fewest nodes hold; the
    postings of pieces that no query asks for are left out first. So the work grows with the nodes that a word may be in.
    """
    word = settled(asked.select("query", F.explode("core").alias("word")).distinct(), "words")
    each = word.select("word").distinct()
    if each.limit(few + 1).count() <= few:
        found = texts.join(F.broadcast(each), F.contains("text", F.col("word"))).select("word", "id")
        return found.join(F.broadcast(word), "word").select("query", "id").distinct()
    piece = F.when(F.length("word") <= 3, F.array("word")).otherwise(F.filter(grams(F.col("word")), lambda g: F.length(g) == 3))
    pieces = settled(each.select("word", F.explode(piece).alias("gram")), "word-pieces")
    postings = texts.select("id", F.explode(grams(F.col("text"))).alias("gram")).join(pieces.select("gram").distinct(), "gram", "left_semi")
    postings = settled(postings, "postings")
    held = pieces.join(postings.groupBy("gram").agg(F.count("*").alias("n")), "gram", "left")
    best = held.groupBy("word").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")).select("word", "best.gram")
    found = best.join(postings, "gram").join(texts, "id").where(F.contains("text", F.col("word"))).select("word", "id")
    return word.join(found, "word").select("query", "id").distinct()


def search(nodes: DataFrame, queries: DataFrame, as_of: Column, limit: int = 10) -> DataFrame:
    """(query, rank, id, score): nodes: id, entity, main_topic, description, timestamp, is_anchor; queries: query.

    Only nodes that contain a core word of the query have a score, and only those are scored. Repeated queries count once.
    """
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    asked = settled(queries.select("query").where("query is not null").distinct().select("query", F.lower(F.trim("query")).alias("_term"), tokenize(F.col("query")).alias("_q")), "queries")
    text = nodes.select("id", F.concat_ws("\n", low("entity"), low("main_topic"), low("description")).alias("text"))
    every = candidates(asked.select("query", "_q.core"), text).join(asked, "query").join(nodes, "id")
    age = (F.unix_micros(as_of) - F.unix_micros("timestamp")) / 86400e6
    score = relevance(F.col("_q"), F.col("_term"), low("entity"), low("main_topic"), low("description"))
    score = score + F.coalesce(F.greatest(F.lit(0.0), 3.0 - age / 10.0), F.lit(0.0)) + F.when(F.coalesce("is_anchor", F.lit(False)), 1.0).otherwise(0.0)
    scored = every.select("query", "id", F.round(score, 6).alias("score")).where("score is not null")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= limit).select("query", "rank", "id", "score")
