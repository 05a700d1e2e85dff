"""Column functions over text: cleaning, keys, terms, and similarities of term sets."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..lexicons import HEADLINE_STOPWORDS, KEYWORD_STOPWORDS


def words_array(words) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def clean_text(text: Column) -> Column:
    """Tags and characters outside the plain set become spaces; spaces are collapsed."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"[^a-zA-Z0-9\s.,;:!?'\-]", " "), r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def infer_language(text: Column) -> Column:
    letters = F.length(F.regexp_replace(text, r"\P{L}", ""))
    latin = F.length(F.regexp_replace(text, "[^a-zA-Z]", ""))
    return F.when((letters > 0) & (latin / letters >= 0.85), "en").otherwise("unknown")


def iso_time(ts: Column) -> Column:
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def article_key(title: Column, source: Column, published_at: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.trim(title), F.trim(source), F.coalesce(iso_time(published_at), F.lit(""))), 256)


def source_of(url: Column) -> Column:
    netloc = F.regexp_replace(F.lower(F.try_parse_url(url, F.lit("AUTHORITY"))), r"^www\.", "")
    return F.coalesce(F.nullif(netloc, F.lit("")), F.lit("unknown-source"))


def once(value: Column, body) -> Column:
    """body(value), with value worked out once: what a lambda reads from outside it is else worked out for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def significant_tokens(text: Column) -> Column:
    stop = words_array(HEADLINE_STOPWORDS)
    return F.sort_array(F.filter(F.split(text, " "), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w)))


def trigrams(text: Column) -> Column:
    def of(own: Column) -> Column:
        n = F.length(own)
        every = F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(own, i, F.lit(3)))
        return F.when(n < 3, F.array(own)).otherwise(F.array_distinct(every))

    return once(text, of)


def blocking_keys(text: Column, tokens: Column) -> Column:
    """The first 16 characters, every pair of the first four sorted tokens, and the first token."""

    def of(own: Column) -> Column:
        pairs = F.array_compact(F.array(*[F.when(F.size(own) > j, F.concat(F.lit("t:"), F.get(own, i), F.lit("_"), F.get(own, j))) for i, j in ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))]))
        first = F.when(F.size(own) > 0, F.array(F.concat(F.lit("s:"), F.get(own, 0)))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(F.array(F.concat(F.lit("p:"), F.substring(text, 1, 16))), pairs, first))

    return once(tokens, of)


def terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z0-9]{3,}"), 0), F.lower))


def keywords(text: Column, most: int = 20) -> Column:
    stop = words_array(KEYWORD_STOPWORDS)
    every = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[a-zA-Z0-9]{3,}"), 0), F.lower)
    return F.array_distinct(F.slice(F.filter(every, lambda w: ~F.array_contains(stop, w)), 1, most))


def signal_terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9']+"), 0))


def contains_any(text: Column, words) -> Column:
    return F.exists(words_array(words), lambda w: F.contains(F.lower(text), F.lower(w)))


def readable(text: Column, most: int = 200) -> Column:
    joined = F.array_join(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\|"), lambda p: F.trim(p)), lambda p: p != ""), "; ")
    return F.when(F.length(joined) > most, F.concat(F.regexp_replace(F.substring(joined, 1, most), " [^ ]*$", ""), F.lit("…"))).otherwise(joined)


def time_span(first: Column, last: Column) -> Column:
    return F.coalesce(F.concat(F.date_format(first, "yyyy-MM-dd"), F.lit("->"), F.date_format(last, "yyyy-MM-dd")), F.lit("unknown"))


def cluster_key(words: Column) -> Column:
    return F.substring(F.sha2(F.array_join(F.slice(F.sort_array(words), 1, 5), "|"), 256), 1, 24)


def timeline_group(key: Column) -> Column:
    return F.concat(F.lit("timeline-"), F.substring(F.sha2(key, 256), 1, 12))


def hits(own: Column, words) -> Column:
    return F.size(F.array_intersect(own, words_array(words)))


def overlap(a: Column, b: Column) -> Column:
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def trigram_similarity(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def temporal(a: Column, b: Column) -> Column:
    days = F.abs(F.unix_micros(a) - F.unix_micros(b)) / 86400e6
    return F.coalesce(F.greatest(F.lit(0.0), 1.0 - days / 30.0), F.lit(0.15))


def within_days(a: Column, b: Column, days: int) -> Column:
    return F.coalesce(F.abs(F.unix_micros(a) - F.unix_micros(b)) <= days * 86_400_000_000, F.lit(False))


#: The characters that char_counts() counts each by itself; all others are one class.
COUNTED = "abcdefghijklmnopqrstuvwxyz0123456789 "


def char_counts(text: Column) -> Column:
    """Array of how often each character of COUNTED is in a text, then how many others there are."""
    each = [(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit("")))).cast("long") for c in COUNTED]
    counts = F.array(*each)
    return F.concat(counts, F.array(F.length(text) - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)))


def ratio_bound(a: Column, b: Column) -> Column:
    """No less than the sequence ratio of two texts, from their char_counts(): what both hold of each character, at most."""
    total = lambda x: F.aggregate(x, F.lit(0).cast("long"), lambda s, n: s + n)
    size = total(a) + total(b)
    return F.when(size > 0, 2 * total(F.zip_with(a, b, lambda x, y: F.least(x, y))) / size).otherwise(1.0)


def same_start(a: Column, b: Column, threshold: float) -> Column:
    """True only where the sequence ratio of texts a and b is at least the threshold because they start alike.

    The longest common block is no shorter than the common start. If it is the start, then a space in both texts behind it
    is one more match; if not, it is longer than the start. From 200 characters on, b's frequent ones are left out: not told here.
    """
    size = F.length(a) + F.length(b)
    k = F.ceil(F.lit(threshold) * size / 2).cast("int")
    same = lambda n: (F.length(a) >= n) & (F.length(b) >= n) & (F.substr(a, F.lit(1), n) == F.substr(b, F.lit(1), n))
    spaced = lambda t: F.contains(F.substr(t, k), F.lit(" "))
    return (size > 0) & (k > 0) & (F.length(b) < 200) & (2.0 * k / size >= threshold) & same(k - 1) & (same(k) | (spaced(a) & spaced(b)))


def ratio_at_least(threshold: float, autojunk: bool = True):
    """pandas_udf (a, b) -> the sequence ratio, or 0 where its upper bounds are already below the threshold.

    Arguments keep their order: the ratio isn't symmetric.
    """

    @F.pandas_udf("double")
    def ratio(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            out = pd.Series(0.0, index=a.index)
            for text, rows in b.groupby(b, sort=False):
                m = SequenceMatcher(None, "", text, autojunk)  # keeps what it knows of its second text
                for i in rows.index:
                    m.set_seq1(a[i])
                    if m.real_quick_ratio() >= threshold and m.quick_ratio() >= threshold:
                        out[i] = m.ratio()
            yield out

    return ratio


def ratio_above():
    """pandas_udf (a, b, bound) -> the sequence ratio, or 0 where an upper bound of it is below the row's bound or a text is null."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series, bound: pd.Series) -> pd.Series:
        out = pd.Series(0.0, index=a.index)
        for text, rows in b.dropna().groupby(b, sort=False):
            m = SequenceMatcher(None, "", text)
            for i in rows.index:
                if a[i] is not None:
                    m.set_seq1(a[i])
                    if m.real_quick_ratio() >= bound[i] and m.quick_ratio() >= bound[i]:
                        out[i] = m.ratio()
        return out

    return ratio


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence of two texts, a character of b at a time: the bits of a number stand for those of a."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def near_copy(gate: float, threshold: float):
    """pandas_udf (a, b, apart) -> whether the trigrams of two texts overlap by the gate, as in trigram_similarity, their sequence ratio
    reaches the threshold, and their first `apart` characters, if any, are not the same.

    Its matching blocks are a common subsequence, and the first of them is no shorter than a common start or end; from 200 characters on,
    b's frequent ones are left out, so there ends do not tell."""

    def ends(a: str, b: str) -> tuple[int, int]:
        most = min(len(a), len(b))
        start = next((i for i in range(most) if a[i] != b[i]), most)
        return start, next((i for i in range(most - start) if a[-1 - i] != b[-1 - i]), most - start)

    def grams(text: str) -> set[str]:
        return {text[i : i + 3] for i in range(max(len(text) - 2, 1))}

    @F.pandas_udf("boolean")
    def near(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b, apart in batches:
            of = {text: grams(text) for text in {*a, *b}}
            matchers: dict[str, SequenceMatcher] = {}  # one keeps what it knows of its second text

            def alike(x: str, y: str, n: int) -> bool:
                own, other = of[x], of[y]
                if len(own & other) / max(len(own), len(other)) < gate or (n and x[:n] == y[:n]):
                    return False
                size, (start, end) = len(x) + len(y), ends(x, y)
                if len(y) < 200 and 2.0 * max(start, end) / size >= threshold:
                    return True
                if 2.0 * (start + end + common_length(x[start : len(x) - end], y[start : len(y) - end])) / size < threshold:
                    return False
                if y not in matchers:
                    matchers[y] = SequenceMatcher(None, "", y)
                matchers[y].set_seq1(x)
                return matchers[y].ratio() >= threshold

            yield pd.Series(list(map(alike, a.tolist(), b.tolist(), apart.tolist())), dtype=bool)

    return near
