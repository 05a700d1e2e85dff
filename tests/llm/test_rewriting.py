"""Operators 11 to 13 against brute force: exact copies, aligned tokens, fill-in-the-middle."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from storyline.llm import exact_dedup, fill_middle, token_alignment

DOCS = "doc_id long, text string, bytes long, word string, row string, kept boolean, output string, part int"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def prose(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice(["word", "Straße", "été", "naïve", "x", "日本", "1234", "the", "tion"]) + rng.choice([" ", "  ", "\n", "\t", ", "]) for _ in range(n))


TEXTS = [
    None, "", "a", "A", " ", "\n\t ", "hello world", "Hello World", "hello  world", "Ägypten", "ägypten", "ÄGYPTEN", "trailing white \x0b\x0c\r", "  leading", "no<P>marker", "<S>", "<M>", "<p> <X>",
    "a b c", "▁piece", "zero\x00byte", "<|endoftext|> and </s> <s> <unk>", "😀😀 emoji 👩‍👩‍👧", "x" * 3000, prose(1, 60), prose(1, 60).upper(), prose(2, 4000), "don't we'll I'M", "ﬁ ligature ½",
]


@pytest.fixture(scope="module")
def rows():
    own = [(i, t) for i, t in enumerate(TEXTS)] + [(40 + i, t) for i, t in enumerate(TEXTS[5:12])]
    return own + [(None, "hello world"), (None, "lone"), (None, "lone"), (46, TEXTS[11]), (7, "same id, other text"), *[(100 + i, prose(i, 12)) for i in range(40)]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, i, "w", "r", True, t, 1) for i, t in rows], DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


# 11


def test_exact_groups_equal_brute_force(docs, rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    got = exact_dedup.op11(docs).collect()
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        text = next(t for i, t in rows if i == r["doc_id"] and sha(lower(t)) == r["text_sha256"])
        own = groups[lower(text)]
        assert r["group_size"] == len(own) and r["keep_id"] == max((i for i in own if i is not None), default=None)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
        kept[lower(text)] += r["kept"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)


def test_exact_groups_hash_only_what_survives(docs, rows):
    sizes = Counter(lower(t) for _, t in rows)
    got = exact_dedup.exact_groups(docs).collect()
    hashed = {r["text_sha256"] for r in got} - {None}
    assert {sha(t) for t, n in sizes.items() if n > 1} <= hashed and sum(r["text_sha256"] is None for r in got) > 30


@pytest.mark.parametrize("head, bits", [(1, 64), (3, 1 << 24)])
def test_exact_groups_do_not_depend_on_head_or_bits(docs, head, bits):
    pick = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = [sorted(map(str, exact_dedup.exact_groups(docs, *p, all_digests=True).select(pick).collect())) for p in ((head, bits), (256, 1 << 24))]
    assert got[0] == got[1]


def test_drop_copies_keeps_whole_rows(docs, rows):
    got = exact_dedup.drop_copies(docs)
    assert got.columns == docs.columns
    got = got.collect()
    assert Counter(lower(r["text"]) for r in got) == {lower(t): 1 for _, t in rows}
    assert all(r["bytes"] == r["doc_id"] and r["output"] == r["text"] for r in got)


def test_exact_groups_of_one_hot_text(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "Same").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    got = exact_dedup.op11(df).where("group_size > 1").collect()
    assert len(got) == 1000 and {(r["keep_id"], r["group_size"]) for r in got} == {(2997, 1000)} and sum(r["kept"] for r in got) == 1


def test_exact_dedup_is_native(docs):
    plan = exact_dedup.op11(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_case_is_changed_as_stated_for_every_character(spark):
    every = spark.range(1, 0x110000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    both = F.concat(F.lit("Aa"), "c")
    assert every.where(exact_dedup.same_case(both) != exact_dedup.ascii_lower(both)).isEmpty()


# 13


def cut_by_rule(doc_id, text):
    text = text or ""
    unit = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = [int(sha(f"42:{'' if doc_id is None else doc_id}")[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(unit) + 1) for x in h[:2])
    p, m, s = "".join(unit[:a]), "".join(unit[a:b]), "".join(unit[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return len(unit), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(unit), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(unit), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("window, part", [(1 << 20, 4 << 20), (7, 50)])
def test_fill_middle_equals_rule(docs, rows, monkeypatch, window, part):
    monkeypatch.setattr(fill_middle, "_WINDOW", window)
    data = [(t or "").encode() for _, t in rows]
    ends = np.cumsum([0, *map(len, data)])
    want = [cut_by_rule(*r) for r in rows]
    form = np.array([("plain", "psm", "spm").index(w[1]) for w in want])
    first, second = (np.array([e + len((t or "")[:k].encode()) for (_, t), e, k in zip(rows, ends, chars, strict=False)]) for chars in ([w[2] or 0 for w in want], [(w[2] or 0) + (w[3] or 0) for w in want]))
    first[form == 0] = second[form == 0] = ends[1:][form == 0]
    whole = np.frombuffer(b"".join(data), np.uint8)
    out, out_ends = fill_middle.scatter(whole, ends, first, second, form)
    assert [out[a:b].tobytes().decode() for a, b in zip(out_ends[:-1], out_ends[1:], strict=True)] == [w[4] for w in want]
    back, back_ends = fill_middle.gather(out, out_ends, form)
    assert back.tobytes() == whole.tobytes() and (back_ends == ends).all()
    assert [x for a, b in fill_middle._slices(ends, part) for x in range(a, b)] == list(range(len(rows)))


def test_fill_middle_query_equals_rule(docs, rows):
    got = sorted(map(str, (tuple(r) for r in fill_middle.op13(docs).collect())))
    want = sorted(str((i, *cut_by_rule(i, t)[:4], sha(cut_by_rule(i, t)[4]), sha(t or ""))) for i, t in rows)
    assert got == want
    assert {cut_by_rule(*r)[1] for r in rows} == {"plain", "psm", "spm"}


def test_restored_text_comes_from_output_and_form(docs):
    out = fill_middle.fill_middle(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    broken = out.withColumn("output", F.when(F.col("form") == "psm", F.replace("output", F.lit("<S>"), F.lit(""))).otherwise(F.col("output")))
    with pytest.raises(Exception, match="marker"):
        fill_middle.restore(broken).collect()


# 12


def pieces_by_libraries(text):
    """Token bytes and ids by both libraries, the byte-level one in its JSON form."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer

    if "kit" not in pieces_by_libraries.__dict__:
        t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        t.encode_special_tokens = True
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(c): c for c in kept} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in kept)}
        pieces_by_libraries.kit = t, sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model")), byte
    t, sp, byte = pieces_by_libraries.kit
    a = t.encode(" " + text, add_special_tokens=False).ids
    b = sp.encode(text)
    names = [sp.id_to_piece(x) for x in b]
    return [(x, bytes(byte[c] for c in t.id_to_token(x))) for x in a], [(x, bytes([int(n[3:5], 16)]) if sp.is_byte(x) else n.replace("▁", " ").encode()) for x, n in zip(b, names, strict=True)]


def aligned_by_rule(rows):
    per = []
    for _, text in rows:
        a, b = pieces_by_libraries(text) if text else ([], [])
        raw = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            per.append(([], [], []))
            continue
        at = lambda side: [(x, s, s + len(y)) for (x, y), s in zip(side, np.cumsum([0, *(len(y) for _, y in side)]).tolist(), strict=False)]
        a, b = at(a), at(b)
        links, j = [], 0
        for x, s, e in a:
            while b[j][2] <= s:
                j += 1
            k = j
            while k < len(b) and b[k][1] < e:
                links.append((x, b[k][0]))
                k += 1
        both = sorted({e for *_, e in a} & {e for *_, e in b})
        groups, start = [], 0
        for end in both:
            groups.append("|".join(",".join(str(x) for x, s, e in side if start <= s and e <= end) for side in (a, b)))
            start = end
        per.append(([x for x, *_ in a], [x for x, *_ in b], links, groups))
    count = Counter(p for x in per for p in set(x[2]))
    most = defaultdict(int)
    for (x, _), n in count.items():
        most[x] = max(most[x], n)
    for (i, _), x in zip(rows, per, strict=True):
        groups = x[3] if x[0] else []
        yield i, len(x[0]), len(x[1]), len(groups), len(x[2]), sum(count[p] == most[p[0]] for p in x[2]), sum(count[p] for p in x[2]), sha(";".join(groups)) if groups else ""


@pytest.fixture(scope="module")
def aligned(rows):
    short = [r for r in rows if len(r[1] or "") < 5000]
    return sorted(map(str, aligned_by_rule(short))), [r for r in rows if len(r[1] or "") >= 5000]


def test_alignment_equals_rule(docs, aligned):
    got = token_alignment.op12(docs.where("coalesce(length(text), 0) < 5000")).collect()
    assert sorted(str(tuple(r)) for r in got) == aligned[0]
    assert any(r["n_a"] == 0 and r["doc_id"] == TEXTS.index("▁piece") for r in got)


def test_words_are_cut_where_both_tokenizers_cut():
    rng, kit = random.Random(4), token_alignment.tokenizers(token_alignment.public_tokenizers_paths())
    assert not [p for p in map(kit.b.id_to_piece, range(kit.size_b)) if re.search("[^▁]▁", p)]
    for _ in range(400):
        text = "".join(rng.choice([" ", " ", "  ", "a", "The", "'s", "!", "?!", "\n", "\t", "\xa0", "\u2003", "\x1c", "▁", "é", "日", "12", "<s>", "\x85"]) for _ in range(rng.randint(1, 25)))
        words, none = token_alignment.Words(kit), token_alignment.Alignment(kit, [text])
        docs = token_alignment.Documents(words, [text])
        n_groups, groups = none.groups()
        assert ";".join(words.text[i] for i in docs.found[0]) == groups[0] and docs.per_row(words.sizes[3])[0] == n_groups[0]


def test_words_may_be_forgotten(rows, monkeypatch):
    kit, batch = token_alignment.tokenizers(token_alignment.public_tokenizers_paths()), pa.record_batch({"text": [t for _, t in rows]})

    def found():
        words = token_alignment.Words(kit)
        return [(";".join(words.text[i] for i in f), *map(sorted, zip(*(x.tolist() for x in d.pairs(words)), strict=True)), words.cleared) for _, d in token_alignment._aligned(iter([batch]), words) for f in d.found]

    whole = found()
    monkeypatch.setattr(token_alignment, "_SLICE", 200)
    monkeypatch.setattr(token_alignment, "_KEPT", 1)
    parts = found()
    assert [p[0] for p in parts] == [w[0] for w in whole] and parts[-1][-1] > 3
    monkeypatch.setattr(token_alignment, "_KEPT", 4000)  # some words stay
    assert [p[0] for p in found()] == [w[0] for w in whole]


def test_alignment_in_small_shards_and_turns(docs, aligned):
    got = token_alignment.align_tokens(docs.where("coalesce(length(text), 0) < 5000").repartition(40), shard=30, most_shards=5)
    got = got.withColumn("groups", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise(""))
    assert sorted(str(tuple(r)) for r in got.collect()) == aligned[0]


def test_long_text_aligns_whole(docs):
    r = token_alignment.align_tokens(docs.where("length(text) >= 5000")).collect()
    assert len(r) == 1 and r[0]["n_links"] == r[0]["n_a"] + r[0]["n_b"] - r[0]["n_groups"] and r[0]["groups"].count(";") + 1 == r[0]["n_groups"]


def test_perfect_hash_is_minimal_and_rejects_others():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 50_000))
    h = token_alignment.PerfectHash.of(keys)
    at = h.find(keys)
    assert h.n == len(keys) and sorted(at) == list(range(len(keys)))
    again = token_alignment.PerfectHash.load(h.blobs())
    assert (again.find(keys) == at).all()
    table = token_alignment.CountTable(1, [{"shard": 0, "levels": h.blobs(), "keys": keys[np.argsort(at)].tobytes(), "counts": np.arange(len(keys)).tobytes()}])
    assert (table.counts_of(keys) == at).all()
    with pytest.raises(ValueError, match="not counted"):
        table.counts_of(keys + 1)


@pytest.mark.parametrize("op", [exact_dedup.op11, fill_middle.op13, token_alignment.op12])
def test_empty_table_gives_empty_result(empty, op):
    assert op(empty).collect() == []
