"""Impact classification of event texts: type, sectors, direction, confidence, winners and losers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import hits, terms, words_array
from ..lexicons import EVENT_KEYWORDS, IMPACT_RULES, LISTS, NEGATIVE, POSITIVE, SECTOR_ACTORS, SECTOR_KEYWORDS


def _ranked(own: Column, lexicon: dict[str, str]) -> Column:
    """Structs (minus hits, place, name), most hits first, ties in order of declaration."""
    return F.array_sort(F.array(*[F.struct((-hits(own, w.split())).alias("n"), F.lit(i).alias("i"), F.lit(k).alias("k")) for i, (k, w) in enumerate(lexicon.items())]))


def event_type(own: Column) -> Column:
    first = F.get(_ranked(own, EVENT_KEYWORDS), 0)
    return F.when(first["n"] < 0, first["k"]).otherwise("policy")


def sectors(own: Column, most: int = 3) -> Column:
    return F.transform(F.slice(F.filter(_ranked(own, SECTOR_KEYWORDS), lambda s: s["n"] < 0), 1, most), lambda s: s["k"])


def direction(own: Column) -> Column:
    up, down = hits(own, POSITIVE), hits(own, NEGATIVE)
    return F.when(up > down, "positive").when(down > up, "negative").otherwise("neutral")


def _hits_of(own: Column, kind: Column) -> Column:
    out = F.lit(0)
    for k, w in EVENT_KEYWORDS.items():
        out = F.when(kind == k, hits(own, w.split())).otherwise(out)
    return out


def confidence(own: Column, kind: Column, found: Column) -> Column:
    clear = F.abs(hits(own, POSITIVE) - hits(own, NEGATIVE))
    raw = 0.50 * F.least(_hits_of(own, kind) / 5.0, F.lit(1.0)) + 0.30 * F.least(clear / 3.0, F.lit(1.0)) + 0.20 * F.least(F.size(found) / 2.0, F.lit(1.0))
    return F.round(F.least(F.greatest(raw, F.lit(0.25)), F.lit(0.95)), 3)


def _rules(fix_prefix: bool) -> tuple[Column, Column]:
    def strings(x):
        return F.array(*map(F.lit, x))

    def blended(entry: str) -> str:
        if fix_prefix:
            return "INDIRECT (secondary):" + entry.split(":", 1)[1]
        # both prefixes hold the same word, so an indirect entry gets the new text inside its old one
        return entry.replace("DIRECT:", "INDIRECT (secondary):").replace("INDIRECT:", "INDIRECT (secondary):")

    def rules(change):
        pairs = []
        for t, lists in IMPACT_RULES.items():
            pairs += [F.lit(t), F.struct(*[strings(map(change, lists[k])).alias(k) for k in LISTS])]
        return F.create_map(*pairs)

    return rules(str), rules(blended)


def _lookup(table: Column, keys: Column) -> Column:
    return F.flatten(F.transform(keys, lambda k: F.try_element_at(table, k)))


def impact_lists(own: Column, kind: Column, found: Column, fix_prefix: bool = False) -> Column:
    """Struct of the four lists: the type's rules, those of a second type with at least half its hits, and sector actors."""
    plain, second_rules = _rules(fix_prefix)
    first_hits = _hits_of(own, kind)
    second = F.get(F.filter(_ranked(own, EVENT_KEYWORDS), lambda s: s["k"] != kind), 0)
    blend = (first_hits > 0) & (-second["n"] >= first_hits * 0.5)
    none = F.array().cast("array<string>")
    actors = []
    for side in (0, 1):
        pairs = [x for s, both in SECTOR_ACTORS.items() for x in (F.lit(s), F.array(*[F.lit(f"SECTOR [{s}]: {a}") for a in both[side]]))]
        actors.append(_lookup(F.create_map(*pairs), found))
    out = []
    for i, k in enumerate(LISTS):
        more = F.when(blend, F.try_element_at(second_rules, second["k"])[k]).otherwise(none)
        out.append(F.array_distinct(F.concat(F.try_element_at(plain, kind)[k], more, actors[i] if i < 2 else none)).alias(k))
    return F.struct(*out)


def analyze(nodes: DataFrame, text: Column) -> DataFrame:
    """nodes with impact_type, sectors, direction, confidence_score and the four lists; a narrow map, no shuffle.

    A text's terms are cut down to those of any list once; what is counted after that are the few that are left."""
    listed = list(dict.fromkeys(w for words in (*EVENT_KEYWORDS.values(), *SECTOR_KEYWORDS.values()) for w in words.split()) | dict.fromkeys([*POSITIVE, *NEGATIVE]))
    out = nodes.withColumn("_terms", F.array_intersect(terms(text), words_array(listed))).withColumn("impact_type", event_type(F.col("_terms"))).withColumn("sectors", sectors(F.col("_terms")))
    out = out.withColumn("direction", direction(F.col("_terms"))).withColumn("confidence_score", confidence(F.col("_terms"), F.col("impact_type"), F.col("sectors")))
    out = out.withColumn("_lists", impact_lists(F.col("_terms"), F.col("impact_type"), F.col("sectors")))
    return out.select("*", "_lists.*").drop("_terms", "_lists")


def parse_entries(entries: Column) -> Column:
    """Struct (direct, indirect, sector) of a list by prefix."""
    entries = F.coalesce(entries, F.array().cast("array<string>"))
    second = lambda e: F.startswith(e, F.lit("INDIRECT (secondary):"))
    indirect = lambda e: second(e) | F.startswith(e, F.lit("INDIRECT:"))
    bare = lambda e: F.trim(F.regexp_replace(e, r"^(INDIRECT \(secondary\)|INDIRECT|DIRECT):", ""))
    sector = lambda e: F.startswith(e, F.lit("SECTOR"))
    return F.struct(
        F.transform(F.filter(entries, lambda e: ~indirect(e) & ~sector(e)), bare).alias("direct"),
        F.transform(F.filter(entries, indirect), bare).alias("indirect"), F.transform(F.filter(entries, sector), lambda e: F.trim(e)).alias("sector"),
    )
