"""Operators 1 to 10 on small tables: nulls, empty texts, repeated rows, ties, clashing columns and empty tables."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyline.llm import hamming_search, langid, line_dedup, mixing, packing, repeat_dedup, shingle_join, toxicity, url_filter, vector_dedup
from storyline.llm.common import components
from storyline.llm.folds import bounded_sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = [f"w{i}" for i in range(400)]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORD) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 120)
    part = base.split()
    near = " ".join([*part[:60], "CHANGED", *part[61:]])
    far = " ".join([*part[:30], *prose(2, 90).split()])
    long = "\n".join(prose(i % 7 + 50, 30) for i in range(300))
    texts = [base, near, base.upper(), far, None, "", "a b c", "A  b\tc", prose(3, 80) + " é€ " + prose(9, 60), base, long, "the same line of more than twenty\nx", "The same line of more than twenty \ny", "the same line of more than twenty"]
    out = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", 1) for i, t in enumerate(texts)]
    return [*out, out[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def closure(ids, links):
    top = {i: i for i in ids}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        top[b] = a
    return {i: root(i) for i in ids}


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (8, 9), (9, 8), (5, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8}


def test_jaccard_join_is_exact(spark, docs, rows):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in shingle_join.op2(docs).collect()]
    sets = {i: shingles(t) for i, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = closure(sets, links)
    assert sorted(got) == sorted((i, len(sets[i]), want[i]) for i, *_ in rows)
    assert shingle_join.op2(spark.createDataFrame([], DOCS)).count() == 0


def test_jaccard_blocks_find_the_same(spark):
    base = prose(5, 100).split()
    texts = []
    for i in range(150):
        own = list(base)
        own[i % 100 : i % 100 + (i % 9)] = ["z%d" % i] * (i % 9)
        texts.append((i, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    whole = {r["doc_id"]: r["component_id"] for r in shingle_join.jaccard_components(df).collect()}
    cut = {r["doc_id"]: r["component_id"] for r in shingle_join.jaccard_components(df, block=16).collect()}
    sets = {i: shingles(t) for i, t in texts}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert whole == cut == closure(sets, links)


def test_signature_bound_is_safe():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 1 << 62, 500, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 200))) for _ in range(120)]
    label = np.arange(120)
    got = closure(range(120), shingle_join.link_sets(sets, label, np.arange(120), None))
    links = [(a, b) for a in range(120) for b in range(a) if 7 * len(np.intersect1d(sets[a], sets[b])) >= 3 * (len(sets[a]) + len(sets[b]))]
    assert got == closure(range(120), links)


def test_repeats_match_brute_force(spark, docs, rows):
    got = sorted(tuple(r) for r in repeat_dedup.op4(docs).collect())
    want = repeat_dedup.brute_force([t for _, t, *_ in rows])
    assert got == sorted((r[0], *w) for r, w in zip(rows, want))
    periodic = spark.createDataFrame([(1, "ab" * 300), (2, "x" + "ab" * 150 + "y"), (3, "q" * 199), (4, "q" * 199), (5, "q" * 200)], "doc_id long, text string")
    want = repeat_dedup.brute_force([r["text"] for r in periodic.collect()])
    assert sorted(tuple(r)[1:] for r in repeat_dedup.op4(periodic).collect()) == sorted(want)
    clash = docs.withColumn("kept", F.lit(1)).withColumn("n_bytes", F.lit(1))
    assert repeat_dedup.remove_repeats(clash).count() == len(rows)


def test_repeats_at_text_ends_match_brute_force(spark):
    rng = np.random.default_rng(11)

    def letters(n):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))

    texts = []
    for i in range(180):  # a passage in two texts: at the start, in the middle, at the end or just before it
        passage = letters(200 + i % 12)
        for place in (i % 4, i // 4 % 4):
            front, back = ((0, 300), (300, 300), (300, 0), (300, 1 + i % 10))[place]
            texts.append(letters(front) + passage + letters(back))
    got = sorted(tuple(r)[1:] for r in repeat_dedup.op4(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert got == sorted(repeat_dedup.brute_force(texts))


def test_lines(spark, docs, rows):
    got = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.op9(docs).collect()}
    held = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    want = set()
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(held.get(key(x), ())) >= 3 and max(held[key(x)]) != i)]
        want.add((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    # the repeated row of document 3 counts as a document of its own; no line of it is near the limit
    assert got == want
    assert line_dedup.dedup_lines(docs.withColumn("n_lines", F.lit("x"))).count() == len(rows)
    assert line_dedup.op9(spark.createDataFrame([], DOCS)).count() == 0


def test_lines_of_long_texts_and_repeats(spark):
    line = [f"a common line number {k % 700} of this text" for k in range(5000)]
    own = [*line, "short", "a line that only this text holds", "a line that only this text holds"]
    df = spark.createDataFrame([(1, "\n".join(line)), (2, "\n".join(own)), (3, "\n".join(line[:700]).upper()), (4, "short\nshort")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    assert [(got[i]["n_lines"], got[i]["n_dropped"]) for i in (1, 2, 3, 4)] == [(5000, 5000), (5003, 5000), (700, 0), (2, 0)]
    assert got[2]["text"] == "short\n" + "\n".join(own[-2:]) and got[1]["text"] == "" and got[4]["text"] == "short\nshort"


def test_line_runs_merge_levels(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for b in range(5):  # ids fall from batch to batch
        df = spark.createDataFrame([(9 - b, f"line {i} of more than twenty") for i in range(b, b + 3)], "doc_id long, text string")
        assert runs.add(line_dedup.line_hashes(df, 20)).count() == (3 if b == 0 else 1)
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    totals = runs.totals().collect()
    assert sum(r["n_docs"] for r in totals) == 15 and sorted(r["keeper"] for r in totals) == [5, 6, 7, 8, 9, 9, 9]


def test_mixing(spark, docs, rows):
    out = mixing.op10(docs).collect()
    assert len(out) == len(rows) and sorted(map(tuple, out)) == sorted(map(tuple, mixing.op10(docs).collect()))
    size = {i: len((t or "").split()) for i, t, *_ in rows}
    assert all(r["size"] == size[r["doc_id"]] and r["taken"] <= 2 * r["size"] for r in out)
    targets = {(r["source_size"], r["target"]) for r in out}
    total = sum(r["size"] for r in out)
    assert abs(sum(t for _, t in targets) - 1.5 * total) < 1e-6 and all(t <= 2 * s for s, t in targets)
    many = spark.createDataFrame([(i, prose(i, 20 + i % 30), f"s{i % 4}") for i in range(2000)], "doc_id long, text string, source string")
    per = mixing.mix_plan(many.withColumn("size", F.lit("clash"))).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect()
    assert all(abs(r["t"] - r["target"]) <= 50 for r in per)
    drawn = mixing.mix(many)
    assert drawn.columns == many.columns and drawn.groupBy("doc_id").count().where("count > 2").isEmpty()
    assert mixing.op10(spark.createDataFrame([], DOCS)).count() == 0


def test_packing_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        n = len(ids)
        cuts = [0, *range(n % 1024 or min(n, 1024), n + 1, 1024)]
        want[i] = [(p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    out = packing.op6(docs).collect()
    got = defaultdict(list)
    bins = defaultdict(list)
    for r in out:
        got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert {i: sorted(set(v)) for i, v in got.items()} == want and len(got[3]) == 2 * len(want[3])
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    assert packing.op6(spark.createDataFrame([], DOCS)).count() == 0


def test_bin_completion_finds_optimum():
    rng = random.Random(2)
    for _ in range(30):
        pieces = []
        for _ in range(8):  # bins that can be filled to the brim
            cuts = sorted(rng.sample(range(50, 1000), rng.randint(1, 3)))
            pieces += [b - a for a, b in zip([0, *cuts], [*cuts, 1024])]
        counts = defaultdict(int)
        for p in pieces:
            counts[p] += 1
        got = packing.bin_completion(dict(counts), 1024)
        assert sum(n for _, n in got) <= sum(n for _, n in packing.best_fit(dict(counts), 1024))
        back = defaultdict(int)
        for f, n in got:
            assert sum(s * k for s, k in f) <= 1024
            for s, k in f:
                back[s] += k * n
        assert back == counts


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(7)
    docs, labels = [], []
    for i in range(500):
        w = prose(i, 60).split()
        if i % 5 == 0:
            w[rng.randrange(60)] = rng.choice(["grobble", "snarfing", "plonkery"])
        docs.append((i, " ".join(w)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(1000, None), (1001, ""), (1002, prose(1, 50) + " gr0bble grobbles")]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame([*labels, (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in toxicity.op3(d, lab).collect()}
    held = [i for i in range(500) if out[i]["held_out"]]
    assert held and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in held)
    assert np.mean([out[i]["predicted"] == (i % 5 == 0) for i in held]) > 0.95
    assert out[1002]["predicted"] == 1 and out[1000]["score"] == out[1001]["score"] and out[1000]["predicted"] == 0
    assert toxicity.op3(d.limit(0), lab.limit(0)).count() == 0


def test_toxicity_scores_texts_alone():
    texts = [f"plain words {i} about grain" + " and more" * (i * 7 % 50) for i in range(60)] + [None, "", "vile scum"] + [f"vile scum {i}" for i in range(60)]
    model = toxicity.Toxicity().fit(texts, [int(bool(t) and "vile" in t) for t in texts], rounds=20)
    together = model.scorer().scores(texts).tolist()
    assert together == [model.scorer().scores([t])[0] for t in texts] == model.scorer().scores(texts[::-1]).tolist()[::-1]


def test_dictionaries_do_not_depend_on_partitions(spark):
    rows = [(i, f"{lang} sentence {i} " * (i % 5 + 1), lang) for i, lang in enumerate(["en", "de", "fr"] * 40)] + [(999, None, "en"), (1000, "", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many = (langid.learn_dictionaries(df.repartition(n), per_lang=10, dict_bytes=300) for n in (1, 7))
    assert one == many and set(one) == {"de", "en", "fr"} and all(8 <= len(x) <= 300 for x in one.values())


def test_language(spark):
    syllables = {"aa": ["ka", "mo", "ti"], "bb": ["schr", "elf", "ung"], "cc": ["eau", "oix", "ille"]}
    rng = random.Random(1)
    rows = [(i, " ".join("".join(rng.choice(syllables[x]) for _ in range(3)) for _ in range(40)), x) for i, x in enumerate(list(syllables) * 60)]
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "kamoti kamoka", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in langid.op7(df).collect()}
    assert np.mean([out[i]["lang_pred"] == x for i, _, x in rows[:180] if out[i]["held_out"]]) > 0.97
    assert out[900]["lang_pred"] == out[901]["lang_pred"] == "und" and out[902]["lang_pred"] == "aa"
    assert {r["lang_pred"] for r in langid.op7(df.where("lang is null")).collect()} == {"und"}


def test_urls(spark):
    urls = ["http://a.EXAMPLE.com/en/742?x=1", "https://example.com/en/8", "http://notexample.com/en/7", "ftp://x.net/de/8#f", "http://m.example.net/de/81", "no scheme", None, "http://org/es/", "http://a.org?/es/", "http://com/en/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df).collect()}
    assert got[0] == ("a.example.com", "/en/742", "example.com/en/7", "allow") and got[1][2:] == ("com/en/", "block") and got[2][2:] == ("com/en/", "block")
    assert got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("example.net/de/8", "block") and got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2:] == ("org/es/", "block") and got[8] == ("a.org", "", None, "allow") and got[9][3] == "block"
    rules = spark.createDataFrame([(v, k) for v, k in url_filter.RULES], "verdict string, key string")
    by_join = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls_by_join(df, rules).collect()}
    assert by_join == got
    index = url_filter.DigestIndex([("block", f"h{i}.com/") for i in range(50)], digest=lambda k: 7)
    assert [index.key(j) for j in index.find(["h3.com/", "h49.com/"])] == ["h3.com/", "h49.com/"] and index.find(["zz/"])[0] == -1


def test_hamming_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    vec = rng.normal(size=(300, 64))
    vec[100:140] = vec[100]
    rows = [(i, v.tolist()) for i, v in enumerate(vec)] + [(400, None), (401, [1.0]), (402, [float("nan")] * 64), (None, vec[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["distance"]) for r in hamming_search.op1(df).collect())
    bits = vec.astype(np.float32) > 0
    want = []
    for q in range(0, 300, 20):
        near = sorted((int((bits[q] != bits[i]).sum()), i) for i in range(300) if i != q)[:10]
        want += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    assert got == want
    few = spark.createDataFrame(rows[:3], df.schema)
    assert hamming_search.op1(few).count() == 2


def test_vectors_recall(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 32))
    vec = np.concatenate([base, base + rng.normal(scale=0.12, size=base.shape), base[:5], base[:1] * 3])
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vec)] + [(900, None, 0), (901, [0.0] * 32, 0), (902, [float("inf")] * 32, 0), (903, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for block in (4096, 8):
        out = {r["vec_id"]: r for r in vector_dedup.near_vectors(df, block=block).collect()}
        unit = vec / np.linalg.norm(vec, axis=1, keepdims=True)
        true = (unit @ unit.T >= 0.95).sum(axis=1) - 1
        found = np.array([out[i]["n_links"] for i in range(len(vec))])
        assert (found <= true).all() and found.sum() >= 0.9 * true.sum()
        assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in (900, 901, 902, 903))
        assert out[120]["component_id"] == 0 and not out[120]["kept"] and len(out) == len(rows)


def test_training_rows_are_those_whose_ids_hash_lowest(spark):
    rows = [(i, f"t{i}", None if i % 50 == 0 else ("hot" if i % 10 else "rare")) for i in range(1, 6000)]
    rows += [(7, "t7", "hot")] * 30 + [(None, "no id", "rare")]
    got = bounded_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(7), "lang", 40)
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("h", F.xxhash64("doc_id")).toPandas()
    want = []
    for lang in ("hot", "rare"):
        own = frame[frame.lang == lang].sort_values(["h", "doc_id", "text"]).head(40)
        want += own[["lang", "text"]].values.tolist()
    assert sorted([r["lang"], r["text"]] for r in got.collect()) == sorted(want)
    assert bounded_sample(spark.createDataFrame([], "doc_id long, text string, lang string"), "lang", 40).count() == 0
