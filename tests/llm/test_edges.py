"""Edges of the ten operators: few or unlike rows, very long texts, null ids, repeated rows, clashing names, empty tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from storyline.llm import hamming_search, langid, line_dedup, mixing, packing, repeat_dedup, shingle_join, toxicity, url_filter, vector_dedup

DOCS = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"
VECTORS = "vec_id long, embedding array<double>"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(n))


@pytest.mark.parametrize("texts, want", [
    (["one document alone in its table here"], [0]),
    (["one two three four five six", "seven eight nine ten eleven twelve"], [0, 1]),
    (["one two three four five six"] * 2, [0, 0]),
    ([None, None], [0, 1]),
    ([prose(1, 40), prose(2, 40), prose(1, 40) + " more"], [0, 1, 0]),
])
def test_jaccard_join_of_few_rows(spark, texts, want):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = shingle_join.jaccard_components(df, bucket_tokens=5).collect()  # most buckets hold no shared shingle
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == list(enumerate(want))


def test_jaccard_join_links_rows_without_id(spark):
    a, b = prose(3, 60), prose(4, 60)
    df = spark.createDataFrame([(None, a), (5, a + " x"), (7, b), (None, prose(5, 30)), (7, a + " y")], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["component_id"])) for r in shingle_join.op2(df).collect())
    assert got == [("5", "5"), ("7", "5"), ("7", "7"), ("None", "5"), ("None", "None")]


def test_shingles_of_long_texts_are_those_of_short_ones():
    text = prose(6, 150_000).encode() + b" " + b"z" * 1_000_000 + b"\t" + prose(7, 50).encode()
    words = text.split()
    (got,) = shingle_join.shingle_sets([text])
    parts = [shingle_join.shingle_sets([b" ".join(words[i : i + 5])])[0] for i in (0, 70_000, 149_998, len(words) - 5)]
    assert len(got) == len({tuple(words[i : i + 5]) for i in range(len(words) - 4)}) and np.isin(np.concatenate(parts), got).all()


def test_links_survive_short_hashes():
    """With so few bits that shingles of one set fall together, no prefix loses a pair that links."""
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 1 << 62, 60, dtype=np.uint64))]
    sets += [np.r_[sets[0][: len(sets[0]) - k], rng.integers(0, 1 << 62, k, dtype=np.uint64)] for k in range(1, 20)]
    bits = 8
    held, own = {}, []
    for s in sets:
        s = np.unique(s)
        short = np.unique(s & np.uint64((1 << bits) - 1))
        own.append((short, -(-3 * len(s) // 4) - (len(s) - len(short))))
        for x in short.tolist():
            held[x] = held.get(x, 0) + 1
    prefix = []
    for short, need in own:
        shared = sorted((held[x], x) for x in short.tolist() if held[x] > 1)
        prefix.append(set(shared[: max(0, len(shared) - max(need, 1) + 1)]))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 7 * len(np.intersect1d(a, b)) >= 3 * (len(np.unique(a)) + len(np.unique(b))):
                assert prefix[i] & prefix[j]


def test_very_long_texts(spark):
    long = "\n".join(prose(i, 400) for i in range(600)) + "\n" + "a" * 30_000
    rows = [(1, long, "en", "a"), (2, long[:-5] + "end", "en", "a"), (3, prose(1, 50), "en", "b")]
    df = spark.createDataFrame(rows, DOCS)
    two = {r["doc_id"]: r["component_id"] for r in shingle_join.op2(df).collect()}
    assert two == {1: 1, 2: 1, 3: 3}
    four = {r["doc_id"]: r for r in repeat_dedup.op4(df).collect()}
    assert four[1]["n_bytes"] == len(long) and four[1]["n_removed"] == len(long) and four[3]["n_removed"] in (0, len(rows[2][1]))
    six = packing.op6(df).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("length").alias("m")).collect()
    assert max(r["m"] for r in six) == 1024 and max(r["n"] for r in six) > 200_000
    nine = {r["doc_id"]: r for r in line_dedup.op9(df).collect()}
    assert nine[1]["n_lines"] == 601 and nine[1]["n_dropped"] == 0
    ten = {r["doc_id"]: r for r in mixing.op10(df).collect()}
    assert ten[1]["size"] == len(long.split())
    assert {r["lang_pred"] for r in langid.op7(df).collect()} <= {"en", "und"}
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 1)], LABELS)
    assert toxicity.op3(df, labels).count() == 3


def test_added_token_and_odd_texts_have_the_ids_of_the_json_form(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    odd = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n<|endoftext", "     á \U0001f600‍\U0001f468 א١Ⅻ", "it's I'LL\n\n \t x", "q" * 3000, prose(1, 2000)]
    odd += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xA0, 0xD000), rng.randrange(0x1F300, 0x1F700), 10, 32])) for _ in range(60)) for _ in range(300)]
    got = {(r["doc_id"], r["piece"]): (r["length"], r["ids_crc32"]) for r in packing.op6(spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")).collect()}
    want = {}
    for i, t in enumerate(odd):
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want |= {(i, p): (b - a, zlib.crc32(ids[a:b].tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert got == want


def test_bins_reach_the_known_optimum():
    rng = random.Random(2)
    for _ in range(30):
        counts = {}
        for _ in range(8):  # bins that can be filled to the brim
            cuts = sorted(rng.sample(range(50, 1000), rng.randint(1, 3)))
            for a, b in zip([0, *cuts], [*cuts, 1024]):
                counts[b - a] = counts.get(b - a, 0) + 1
        assert sum(n for _, n in packing.bin_completion(counts, 1024)) == 8


def test_targets_are_those_of_water_filling(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["a", "a", "a", "B", "c", "é", "z", None])) for i in range(400)] + [(900, None, "empty")]
    got = {r["source"]: (r["source_size"], r["target"]) for r in mixing.op10(spark.createDataFrame(rows, "doc_id long, text string, source string")).join(spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, source string"), "doc_id").collect()}
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, free, target = 1.5 * sum(size.values()), set(size), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * size[s]}
        for s in over or free:
            target[s] = 2.0 * size[s] if over else weight[s] * level
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    assert {s: n for s, (n, _) in got.items()} == size and all(abs(got[s][1] - target[s]) < 1e-6 for s in size)


def test_the_tree_deals_all_copies_in_even_shards(spark):
    docs = spark.createDataFrame([(i, prose(i, 30), f"s{i % 3}") for i in range(1500)], "doc_id long, text string, source string")
    out = mixing.op10(docs).where("taken > 0").toPandas()
    assert out["shard_1"].between(0, 7).all() and (out["shard_2"].notna() == (out["taken"] > out["size"])).all()
    assert out["shard_1"].value_counts().min() > 0.4 * len(out) / 8 and out["shuffle_key"].nunique() == len(out)


def test_recall_at_the_threshold_and_any_magnitude(spark):
    rng = np.random.default_rng(7)
    a = rng.normal(size=(1500, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.normal(size=a.shape)
    b -= (b * a).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    near = 0.9501 * a + np.sqrt(1 - 0.9501**2) * b
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, near]))]
    big = [1e200, 1.0e200] + [0.0] * 3
    rows += [(9000, big), (9001, [1.0001e200, 1e200, 0.0, 0.0, 0.0]), (9002, [1e-200, 1e-200, 0.0, 0.0, 0.0]), (9003, [0.0] * 5), (9004, [float("nan")] * 5), (None, big), (9000, [0.0, 0.0, 1.0, 0.0, 0.0])]
    out = vector_dedup.op5(spark.createDataFrame(rows, VECTORS)).collect()
    links = {}
    for r in out:
        links.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"]))
    assert sum(links[i][0][0] for i in range(3000)) / 3000 >= 0.9
    assert all(links[i + 1500][0][1] in (i, i + 1500) for i in range(1500))
    assert links[None] == [(3, 9000)] and links[9001] == links[9002] == [(3, 9000)] and sorted(links[9000]) == [(0, 9000), (3, 9000)]
    assert links[9003] == [(0, 9003)] and links[9004] == [(0, 9004)] and len(out) == len(rows)


def test_hamming_parts_hot_codes_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    vec = rng.normal(size=(400, 64))
    vec[100:260] = vec[100]
    rows = [(i, v.tolist(), 1) for i, v in enumerate(vec)] + [(40, vec[41].tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code int")
    codes = df.select("vec_id", hamming_search.sign_code(F.col("embedding")).alias("code"))
    whole = sorted(map(tuple, hamming_search.op1(df).collect()))
    parts = sorted(map(tuple, hamming_search.top_k(codes, codes.where("vec_id % 20 = 0"), part_codes=20).collect()))
    assert whole == parts
    bits = vec > 0
    want = sorted((int((bits[120] != bits[i]).sum()), i) for i in range(400) if i not in (120, 40))[:10]
    assert [(r[3], r[2]) for r in whole if r[0] == 120] == want


def test_rows_without_id_and_repeated_rows(spark):
    text = "\n".join(["a line that all of these documents hold", "another line of more than twenty"])
    rows = [(None, text), (None, text), (4, text), (4, text), (9, text + "\nend")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    nine = sorted((str(r["doc_id"]), r["n_dropped"]) for r in line_dedup.op9(df).collect())
    assert nine == [("4", 2), ("4", 2), ("9", 0), ("None", 2), ("None", 2)]
    ten = mixing.op10(df.withColumn("source", F.lit(None).cast("string"))).collect()
    assert len(ten) == 5 and all(r["taken"] <= 2 * r["size"] for r in ten)
    labels = spark.createDataFrame([(4, 1, 1), (9, 1, 0), (None, 1, 1)], LABELS)
    assert toxicity.op3(df, labels).count() == 5
    lang = df.withColumn("lang", F.lit("en")).withColumn("lang_pred", F.lit(7)).withColumn("score", F.lit("x"))
    assert [r["lang_pred"] for r in langid.op7(lang).collect()] == ["en"] * 5
    pages = spark.createDataFrame([(None, "http://a.com/en/1"), (None, "http://a.com/en/1"), (2, None)], "page_id long, url string")
    assert sorted(str(r["rule"]) for r in url_filter.op8(pages).collect()) == ["None", "com/en/", "com/en/"]


def test_languages_tie_on_equal_training_text(spark):
    rows = [(i, "the same words for both of them", "xx" if i % 2 else "yy") for i in range(60)]
    first, again = ({(r["doc_id"], r["lang_pred"]) for r in langid.op7(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(n)).collect()} for n in (1, 3))
    assert first == again and len({x for _, x in first}) == 1


def test_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    vectors, pages = spark.createDataFrame([], VECTORS), spark.createDataFrame([], "page_id long, url string")
    results = [hamming_search.op1(vectors), repeat_dedup.op4(docs), vector_dedup.op5(vectors), langid.op7(docs), url_filter.op8(pages), mixing.op10(docs), toxicity.op3(docs, labels)]
    assert [r.count() for r in results] == [0] * len(results)
