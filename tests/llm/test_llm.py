"""The operators against brute-force versions, on fixtures with nulls, ties, repeats, long and empty texts,
empty tables and extra columns with clashing names."""

import collections
import hashlib
import math
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from oracle import rows_of_query, rows_of_sql
from pyspark.sql import functions as F

from loglens.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10
from loglens.llm.registry import ORACLES, QUERIES
from loglens.llm.scratch import components
from loglens.llm.words import ngrams, words

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def made(n=60, seed=0):
    """Documents with copies, near copies, shared passages, nulls, blanks, one very long text and odd characters."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(1, 7))) for _ in range(400)]
    sentence = lambda k: [r.choice(vocabulary) for _ in range(k)]
    passage, base = sentence(60), sentence(120)
    texts = [None, "", " \t\n", "one", "one", "two words", "A b\tc\nd\x0be\x0cf é\xa0ü \x1c!", "x " * 40]
    texts += [" ".join(base), " ".join(base).upper(), " ".join(base[:110] + sentence(4)), " ".join(base[5:])]
    texts.append(" ".join(sentence(30_000) + passage))
    while len(texts) < n:
        own = sentence(r.randint(5, 150))
        if r.random() < 0.3:
            at = r.randint(0, len(own))
            own[at:at] = passage[r.randint(0, 20) : r.randint(30, 60)]
        texts.append(" ".join(own))
    return [(i * 3 % (3 * n), t, r.choice(["en", "fr", None]), r.choice(["a", "b", None]), None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = made()
    return spark.createDataFrame(rows, DOCS).repartition(3), {r[0]: r[1] for r in rows}


@pytest.fixture(scope="module")
def clashing(docs):
    """Extra columns under names that the operators use."""
    names = ("id", "n", "h1", "z", "part", "size", "target", "copies", "kept", "c0", "_t", "_s", "score", "n_words", "bucket", "piece", "length")
    return docs[0].withColumns({c: F.lit("x") for c in names})


def none(spark):
    return spark.createDataFrame([], DOCS)


def test_words_and_ngrams():
    import pyarrow as pa

    texts = ["a b  a", None, "", "\tab a\x0b", "a b a"]
    first, h = words(pa.array(texts))
    assert np.diff(first).tolist() == [3, 0, 0, 2, 3]
    assert h[0] == h[2] == h[4] == h[5] and h[1] != h[0] and len(set(h.tolist())) == 3
    start, g = ngrams(first, h, 3)
    assert start.tolist() == [0, 5] and g[0] == g[1]
    assert (words(pa.array(["Ab É"]), lower=True)[1] == words(pa.array(["aB É"]), lower=True)[1]).all()


def test_components(spark):
    edges = spark.createDataFrame([(5, 4), (4, 3), (3, 9), (9, 1), (20, 21), (21, 22), (7, 7)], "a long, b long")
    assert {tuple(r) for r in components(edges).collect()} == {(5, 1), (4, 1), (3, 1), (9, 1), (1, 1), (20, 20), (21, 20), (22, 20)}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert rows_of_query(QUERIES[name](spark, SMALL)) == rows_of_sql(SMALL, ORACLES[name])


# 1. chat snapshots


def test_snapshots(spark):
    rows = [(1, 0, "user", "hi"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (3, 0, "user", "hi"), (3, 1, "assistant", "yes"), (4, 0, "user", "ho"), (5, 0, "user", None), (6, 0, "user", ""), (None, 0, "user", "z"), (7, None, None, "q"), (7, None, None, "q")]
    out = {r["conv_id"]: (r["n_turns"], r["rendered"]) for r in op1.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1))).collect()}
    assert set(out) == {2, 4, 5, 6, None, 7}
    assert out[2] == (2, "<|user|>\nhi\n<|assistant|>\nyes\n") and out[7][0] == 2
    assert op1.collapse(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_long_conversation_is_a_prefix(spark):
    turns = [(c, t, "u", f"t{t}") for c, n in ((1, 600), (2, 599), (3, 600)) for t in range(n)]
    out = op1.collapse(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()
    assert [(r["conv_id"], r["n_turns"]) for r in out] == [(1, 600)]


# 2. mixing


def targets_by_hand(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in rest) for s in rest}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: float(most * sizes[s]) for s in over}


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {s: r.choice([0, 1, 10, 100, 1000]) for s in ["a", "b", "B", "é", None, "z"]}
    got = {x["source"]: x["target"] for x in op2.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
    want = targets_by_hand(sizes)
    assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def test_mix(spark, docs, clashing):
    df, texts = docs
    size = {i: len(WORD.findall(t or "")) for i, t in texts.items()}
    sized = df.withColumn("size", op2.n_words(F.col("text")))
    one = [tuple(r) for r in op2.sample(sized, "size", "source", "doc_id").select("doc_id", "size", "source", "source_size", "target", "copies").collect()]
    again = [tuple(r) for r in op2.sample(sized.repartition(7), "size", "source", "doc_id").select("doc_id", "size", "source", "source_size", "target", "copies").collect()]
    assert sorted(one, key=str) == sorted(again, key=str) and len(one) == len(texts)
    by = collections.defaultdict(lambda: [0, 0, 0.0, 0])
    for i, n, s, whole, target, copies in one:
        assert n == size[i] and 0 <= copies <= 3
        x = by[s]
        x[0], x[1], x[2], x[3] = x[0] + n, x[1] + copies * n, target, max(x[3], n)
        assert whole == sum(size[k] for k, v in ((r[0], r[2]) for r in one) if v == s)
    for _, taken, target, largest in by.values():
        assert abs(taken - target) <= 1.3 * largest + 1
    want = targets_by_hand({s: x[0] for s, x in by.items()})
    assert all(abs(x[2] - want[s]) < 1e-6 * want[s] + 1e-9 for s, x in by.items())
    assert op2.mixed(clashing).columns == clashing.columns
    assert op2.mixed(none(spark)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_copies_are_a_systematic_sample(spark, seed):
    """The sample in the stated order, by hand: rising size class, salt, size and key; one offset; exact fractions."""
    r = random.Random(seed)
    rows = [(r.choice([None, i, 7]), r.choice(["a", "a", "a", "b", "c", None]), r.choice([0, 1, 3, 10, r.randint(1, 5000)])) for i in range(500)]
    rows += [(i, "rare", 1_000_000) for i in range(40)] + [(1, "empty", 0)]
    df = spark.createDataFrame(rows, "k long, s string, n long").withColumn("tag", F.monotonically_increasing_id()).repartition(3)
    got = [(x["tag"], x["copies"], x["target"], x["source_size"]) for x in op2.sample(df, "n", "s", "k", seed=seed).collect()]
    salt = {x["tag"]: (x["salt"], x["h"]) for x in df.select("tag", F.pmod(F.xxhash64(F.lit(seed), "k", "s", "n", "tag"), F.lit(16)).alias("salt"), F.xxhash64(F.lit(seed)).alias("h")).collect()}
    own = {x["tag"]: x for x in df.collect()}
    by = collections.defaultdict(list)
    for t, copies, target, size in got:
        x = own[t]
        by[x["s"]].append(((math.floor(math.log(x["n"] + 1.0) * 32), salt[t][0], x["n"], (x["k"] is not None, x["k"] or 0)), copies, target, size, salt[t][1]))
    for s, every in by.items():
        every.sort(key=lambda x: x[0])
        size = sum(own[t]["n"] for t in own if own[t]["s"] == s)
        assert {x[3] for x in every} == {size}
        if not size:
            assert {x[1] for x in every} == {0}
            continue
        words = min(math.floor(every[0][2] + 0.5), 3 * size)
        passed = lambda i: (i * words + every[0][4] % size) // size
        want = collections.Counter((x[0], passed(i + 1) - passed(i)) for i, x in enumerate(every))
        mine = collections.Counter((x[0], x[1]) for x in every)
        # rows that are equal in all of the order may change places
        assert {k: sum(c * n for (a, c), n in want.items() if a == k) for k, _ in want} == {k: sum(c * n for (a, c), n in mine.items() if a == k) for k, _ in mine}
        if s is not None and s != "rare":
            assert abs(sum(x[1] * x[0][2] for x in every) - words) <= 2 * max(x[0][2] for x in every)


def test_tiny_rates_are_exact(spark):
    """One of very many documents is taken, although its share is far below a millionth."""
    df = spark.range(3_000_000).select(F.col("id").alias("k"), F.lit("big").alias("s"), F.lit(1000).alias("n")).unionByName(spark.createDataFrame([(-1, "a", 5), (-2, "c", 1)], "k long, s string, n int"))
    taken = {x["s"]: (x["t"], x["target"]) for x in op2.sample(df, "n", "s", "k").groupBy("s").agg(F.sum(F.col("copies") * F.col("n")).alias("t"), F.max("target").alias("target")).collect()}
    assert abs(taken["big"][0] - taken["big"][1]) <= 1000 and taken["a"][0] == 15


def test_mix_of_many_equal_documents(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("w w w w").alias("text"), F.when(F.col("id") < 2000, "a").otherwise("b").alias("source"))
    out = op2.mixed(df).groupBy("source").count().collect()
    want = targets_by_hand({"a": 8000, "b": 4000})
    assert all(abs(r["count"] * 4 - want[r["source"]]) <= 4 for r in out)


# 3. language


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = op3.identify(docs, op3.learn(docs.where(~op3.held_out()))).where(op3.held_out())
    right = out.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    assert out.where("rejected").count() < 0.02 * out.count()


def test_choice_by_hand(spark, docs):
    """Sizes of whole texts, block by block, with each dictionary; the smallest sum, the margin and the score."""
    import zstandard

    r = random.Random(9)
    words = {k: ["".join(r.choice(a) for _ in range(r.randint(2, 9))) for _ in range(150)] for k, a in {"p": "abcde", "q": "cdefg", "r": "vwxyz"}.items()}
    own = {k: " ".join(r.choice(w) for _ in range(2000)).encode() for k, w in words.items()}
    own["s"] = own["p"]  # a tie: the first one wins and is rejected
    texts = {**docs[1], 900: " ".join(r.choice(words["q"]) for _ in range(9000)), 901: "12 34 !", 902: "Ab1cD", 903: " ".join(r.choice(words["p"] + words["q"]) for _ in range(300)), 904: "é" * 5000}
    got = {x["doc_id"]: x for x in op3.identify(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), own).collect()}
    for i, t in texts.items():
        if not t or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"], got[i]["rejected"]) == ("und", 0.0, True)
            continue
        data = re.sub(r"[^a-zà-öø-ÿ]+", " ", t.lower()).encode()
        sizes = {}
        for k, d in own.items():
            made = zstandard.ZstdCompressionParameters.from_level(3, source_size=2048, dict_size=len(d), min_match=3, write_content_size=0, write_dict_id=0)
            sizes[k] = sum(len(zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=made).compress(data[a : a + 2048])) for a in range(0, len(data), 2048))
        first, second = sorted(sizes.values())[:2]
        best = next(k for k in own if sizes[k] == first)
        apart = 1 - first / second
        assert got[i]["lang_pred"] == best and got[i]["rejected"] == (apart < op3.MARGIN) and got[i]["score"] == pytest.approx(1 - 0.5 * math.exp(-apart / 0.05))
    assert got[900]["lang_pred"] == "q" and not got[900]["rejected"]


def test_language_edges(spark, docs, clashing):
    model = op3.learn(spark.createDataFrame([(1, "the cat and the dog sat on the mat", "en"), (2, "le chat et le chien dans la rue", "fr"), (3, None, "de"), (4, "x", None)], "doc_id long, text string, lang string"))
    assert set(model) == {"en", "fr"}
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "the dog and the cat and the mat"), (5, "le chien et le chat dans la rue " * 5000)]
    out = {r["doc_id"]: (r["lang_pred"], r["rejected"], r["score"]) for r in op3.identify(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert [out[i][0] for i in range(1, 6)] == ["und", "und", "und", "en", "fr"]
    assert [out[i][1] for i in range(1, 6)] == [True, True, True, False, False] and all(0 <= x[2] <= 1 for x in out.values())
    got = op3.identify(clashing, model)
    assert set(got.columns) == set(clashing.columns) | {"lang_pred", "score", "rejected"} and got.count() == len(docs[1])
    assert op3.identify(none(spark), op3.learn(none(spark))).count() == 0


# 4. near duplicates


def sets_of(texts):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(fold))
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def near_by_hand(texts):
    sets, root = sets_of(texts), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_near_duplicates(spark, docs, clashing):
    want = near_by_hand(docs[1])
    assert sum(not k for _, _, k in want.values()) >= 3
    for df in (docs[0], clashing):
        assert {r[0]: tuple(r)[1:] for r in op4.near_duplicates(df).collect()} == want
    assert op4.near_duplicates(none(spark)).count() == 0


def test_a_large_group_of_near_copies(spark):
    r = random.Random(5)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(120)]
    texts = {}
    for i in range(160):
        own = list(base)
        for _ in range(r.randint(0, 6)):
            own[r.randrange(len(own))] = f"n{r.randint(0, 10**6)}"
        texts[i] = " ".join(own)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x[0]: tuple(x)[1:] for x in op4.near_duplicates(df).collect()} == near_by_hand(texts)


def test_exact_copies_only(spark):
    """No two different texts share a shingle here, so there is nothing to search but copies to link."""
    base = [" ".join(f"w{k}x{i}" for i in range(20)) for k in range(3)]
    texts = {i: t for i, t in enumerate(["", base[0], base[1], "Short text", base[0].upper(), None, base[0].replace(" ", "  \t"), "short TEXT", base[2], base[0]])}
    want = near_by_hand(texts)
    assert {i for i, x in want.items() if not x[2]} == {4, 6, 7, 9}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x[0]: tuple(x)[1:] for x in op4.near_duplicates(df).collect()} == want


def test_a_notice_in_very_many_documents(spark):
    """20,000 short documents that share all words but one: long lists of values without a single link."""
    rows = [(i, f"all rights reserved by owner x{i // 2}") for i in range(20_000)] + [(20_000, "ALL rights reserved by owner x0"), (20_001, "rights reserved by owner x0")]
    began = time.time()
    found = {x[0]: tuple(x)[1:] for x in op4.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert found == {i: (2, i - i % 2, i % 2 == 0) for i in range(20_000)} | {20_000: (2, 0, False), 20_001: (1, 20_001, True)}
    assert time.time() - began < 120


@pytest.mark.parametrize("outside", [0, 5])
def test_lists_joined_under_real_shingles(spark, monkeypatch, outside):
    """Chains, groups and a common notice, with all or some lists taken for large ones."""
    monkeypatch.setattr(op4, "OUTSIDE", outside)
    monkeypatch.setattr(op4, "MORE_STARS", 1 + outside)
    r = random.Random(outside)
    notice = [f"n{i}" for i in range(30)]
    texts, word = {}, lambda: f"w{r.randint(0, 10**6)}"
    for k in range(6):
        own = [word() for _ in range(80)]
        for _ in range(25):
            own = list(own)
            for _ in range(r.randint(1, 3)):
                own[r.randrange(len(own))] = word()
            texts[len(texts)] = " ".join(own + notice)
    for _ in range(60):
        texts[len(texts)] = " ".join(notice + [word() for _ in range(r.randint(5, 30))])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {x[0]: tuple(x)[1:] for x in op4.near_duplicates(df).collect()} == near_by_hand(texts)


def test_near_duplicates_with_null_and_repeated_ids(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(None, base), (None, base + " x"), (7, base), (7, base), (9, base + " y"), (None, None)]
    found = sorted(map(tuple, op4.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert found == sorted([(None, 36, None, True), (None, 37, None, True), (7, 36, 7, True), (7, 36, 7, True), (9, 37, 7, False), (None, 0, None, True)], key=repr)


# 5. repeats


def repeats_by_hand(texts, w=13):
    own = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(own):
        for j in range(len(own[i]) - w + 1):
            first.setdefault(tuple(own[i][j : j + w]), i)
    out = {}
    for i, x in own.items():
        gone = set()
        for j in range(len(x) - w + 1):
            if first[tuple(x[j : j + w])] < i:
                gone |= set(range(j, j + w))
        out[i] = (len(x), len(gone), b" ".join(y for k, y in enumerate(x) if k not in gone).decode())
    return out


def test_repeats(spark, docs, clashing):
    want = repeats_by_hand(docs[1])
    assert sum(n > 0 for _, n, _ in want.values()) > 5
    for df in (docs[0], clashing):
        assert {r[0]: tuple(r)[1:] for r in op5.remove_repeats(df).collect()} == want
    assert op5.remove_repeats(none(spark)).count() == 0


def test_repeats_with_rows_of_one_id_and_without(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "p"), (1, text, "q"), (None, text, "r"), (2, text, "s")], "doc_id long, text string, tag string")
    got = {r["tag"]: (r["doc_id"], r["n_removed"]) for r in op5.remove_repeats(df, carry=("tag",)).collect()}
    assert got == {"p": (1, 0), "q": (1, 0), "r": (None, 0), "s": (2, 30)}


# 6. packing


def test_packing(spark, docs, clashing):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(op6.vocabulary())
    for df in (docs[0], clashing):
        rows = op6.packed_documents(df).collect()
        by = collections.defaultdict(list)
        for r in rows:
            by[r["doc_id"]].append(r)
        assert set(by) == set(docs[1])
        for i, own in by.items():
            ids = np.array([*model.encode(docs[1][i] or "", add_special_tokens=False).ids, 0], "<u4")
            cut = [ids[s : s + 2048] for s in range(0, len(ids), 2048)]
            own.sort(key=lambda r: r["piece"])
            assert [(r["start"], r["length"], r["ids_crc32"]) for r in own] == [(2048 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(cut)]
        check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in rows])
        assert len({r["sequence_id"] for r in rows}) <= -(-sum(r["length"] for r in rows) // 2048) + 1
    assert op6.packed_documents(none(spark)).count() == 0


ODD = [
    "don't I'LL we've 's 't a's'b it's'", "<|endoftext|> a<|startoftext|>b <|endoftext|>. <|endof", "a\xa0b\u3000c\u2028d\x85e", "a\x1cb \x1d c\x1e\x1f", "e\u0301 é E\u0301A \u0301x a\u0301\u0302", "STRASSE Straße ſ K Å İstanbul ıI ﬁn",
    "12 3.14 a1b2 x² ½ ٣", "漢字かな交じり文 한국어 العربية हिन्दी", "🙂 👩‍👩‍👧‍👦🇩🇪", "... !!! a.b.c. -- ,;: $%&* #a", "\t\n\x0b\x0c\r", "", None, "x" * 5000, "ab" * 3000 + ".", "\u200b \ufeff a\u200db", "\ud7ff\ue000\U0010ffff", "ÀÖØöøÿ×÷ ÇA.",
    "ａｂｃ ＡＢ", "a,b c, d;", "* & %", "<|ENDOFTEXT|> <|EndOfText|>. <|endoftext|>! <|endoftext|>,x a<b. A<B.", "a). 'S. x'. it'S! 1. ½. é. É! a.\u0301 -. _.", "Ω Ω Å", "don’t ‘s", "\0 a\0b \x7f",
]


@pytest.mark.parametrize("remembered", [200_000, 30])
def test_encoder_equals_tokenizer(spark, monkeypatch, remembered):
    """Odd texts one by one and together, then real ones; with a memory that is too small, too."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(op6, "REMEMBERED", remembered)
    model, own = Tokenizer.from_file(op6.vocabulary()), op6.Encoder(op6.vocabulary())
    real = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(300).collect()]
    for texts in [*([t] for t in ODD), ODD, [" ".join(t or "" for t in ODD)], real, ODD[::-1], []]:
        cut, ids = own(pa.array(texts, pa.string()))
        assert len(cut) == len(texts) + 1
        for i, t in enumerate(texts):
            assert ids[cut[i] : cut[i + 1]].tolist() == [*model.encode(t or "", add_special_tokens=False).ids, 0], t


def test_copies_of_one_row_are_dealt_over_shards(spark, monkeypatch):
    rows = [(None, "a b c")] * 400 + [(1, "d e")] * 400
    cut = op6.table(op6.pieces(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), op6.vocabulary()), "pieces")
    out = op6.pack(cut, shard=100).collect()
    assert len(out) == 800 and len({r["sequence_id"] >> 32 for r in out}) == 8
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in out])


def check_sequences(places):
    by = collections.defaultdict(list)
    for s, o, n in places:
        by[s].append((o, n))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 2048


def test_two_fit_beats_one():
    bins, _ = op6.fill(np.array([6, 3, 3, 4, 4]), 10)
    assert bins.max() == 1
    r = np.random.default_rng(1)
    for _ in range(20):
        sizes = r.integers(1, 2049, 300)
        bins, offsets = op6.fill(sizes)
        check_sequences(zip(bins.tolist(), offsets.tolist(), sizes.tolist(), strict=True))


# 7. URLs


def test_redirects(spark):
    link = '<link href="{}" rel="canonical">'
    rows = [
        (1, "http://a.net/fr/1", ""), (2, "http://b.org/x", link.format("http://a.net/fr/1")), (3, "http://c.org/y", '<meta http-equiv="refresh" content="0; url=http://b.org/x">'),
        (4, "http://d.org/z", link.format("http://c.org/y")), (5, "http://WWW.Example.com/en/q", link.format("http://a.net/fr/1")), (6, None, "x"), (7, "nothing", None), (8, "http://e.org", ""), (9, "http://www.example.com/en/k?u#f", ""),
        (10, "http://x.net/es/", link.format("http://y.org/")), (11, "http://y.org/", ""), (11, "http://y.org/", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(1), "v": F.lit(2), "host": F.lit(3)})
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in op7.filter_pages(df).collect())
    assert [(x[0], x[3], x[4]) for x in got] == [(1, "net/fr/", "block"), (2, None, "allow"), (3, None, "allow"), (4, None, "allow"), (5, "www.example.com/en/", "allow"), (6, None, "allow"), (7, None, "allow"), (8, None, "allow"), (9, "www.example.com/en/", "allow"), (10, "net/es/", "block"), (11, None, "block"), (11, None, "block")]
    assert got[4][1:3] == ("www.example.com", "/en/q") and got[5][1:3] == ("", "") and got[7][1:3] == ("e.org", "")
    assert op7.filter_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_relative_targets(spark):
    from urllib.parse import urljoin

    bases = ["http://a.net/fr/x/y?q=1#f", "https://b.org", "http://c.org/", "http://d.org/k?u=http://e.org/z"]
    targets = ["/en/x", "//host.org/p", "//host.org", "next.html", "./n", "../n", "../../../n/", "a/./b/../c", "..", ".", "x/..", "?p=2", "next?u=http://h/p", "http://h.org/a/../b", "/p#f"]
    df = spark.createDataFrame([(b, t) for b in bases for t in targets], "b string, t string")
    # urljoin() takes dots out of absolute targets, too
    for r in df.withColumn("got", op7.resolved(F.col("b"), F.col("t"))).collect():
        assert r["got"] == (r["t"] if r["t"].startswith("http:") else urljoin(r["b"], r["t"])), r
    none_ = spark.createDataFrame([("http://a.b/c", t) for t in ("", "mailto:x@y", "javascript:void(0)", None)], "b string, t string")
    assert [r["g"] for r in none_.select(op7.resolved(F.col("b"), F.col("t")).alias("g")).collect()] == [None] * 4


def test_relative_redirects(spark):
    link, fresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="{}">'
    rows = [
        (1, "http://a.net/fr/1", ""), (2, "http://a.net/x/2", link.format("/fr/1")), (3, "http://b.org/x", link.format("//a.net/fr/1")), (4, "http://b.org/k/4", fresh.format("0; url=../x")),
        (5, "http://c.org/p?a=1&b=2", link.format("http://a.net/fr/1")), (6, "http://c.org/q/6", fresh.format("0;URL=/p?a=1&amp;b=2")), (7, "http://d.org/7", link.format("mailto:a@a.net")), (8, "http://d.org/fr/8", link.format("fr/1")), (9, None, link.format("/fr/1")), (10, "nothing", link.format("/fr/1")),
    ]
    got = {r["page_id"]: r["verdict"] for r in op7.filter_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "block" if i <= 6 else "allow" for i in range(1, 11)}


def test_links_meet_whatever_their_case(spark):
    link = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.net/fr/x", ""), (2, "http://b.org/", link.format("HTTP://A.Net/fr/x#top")), (3, "HTTPS://C.org/p#y", link.format("http://B.ORG/")), (4, "http://d.org/", link.format("https://c.org/p")),
        (5, "http://e.org/", "<!-- " + link.format("http://a.net/fr/x") + " --><script>'" + link.format("http://a.net/fr/x") + "'</script>"), (6, "http://f.org/", link.format("http://a.net/FR/x")), (7, "http://a.net/FR/x", ""),
    ]
    got = {r["page_id"]: r["verdict"] for r in op7.filter_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow"}


def test_pages_equal_sql_with_links(spark, tmp_path):
    r = random.Random(3)
    urls = [f"http://{h}/{p}/{i}" for i in range(40) for h, p in [(r.choice(["a.com", "b.net", "c.org", "m.example.com"]), r.choice(["en", "es", "fr"]))]]
    rows = [(i, u, f'<LINK rel=canonical href="{r.choice(urls).replace("http:", r.choice(["http:", "HTTP:"]))}{r.choice(["", "#f"])}">{r.choice(["", "<!-- x -->"])}' if r.random() < 0.5 else r.choice([None, f"<!--<link rel=canonical href={urls[0]}>-->"])) for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    df.toPandas().to_parquet(tmp_path / "pages.parquet")
    assert rows_of_query(op7.filter_pages(df)) == rows_of_sql(str(tmp_path), op7.ORACLE)


# 8. transport streams


@pytest.mark.parametrize("n", [1, 64, 156, 157, 158, 159, 165, 166, 167, 168, 169, 170, 184, 352, 353, 354, 16_383, 16_384, 16_385, 16_384 * 17 + 3])
def test_stream_round_trip(n):
    data = random.Random(n).randbytes(n)
    media = op8.mux(data)
    back = op8.demux(media)
    units = -(-n // op8.UNIT)
    assert back.payload == data and back.breaks == 0 and len(media) == 188 * back.packets and back.damage == {}
    assert back.pts == [k * 3600 for k in range(units)] and back.random_access == list(range(0, units, op8.GROUP)) and back.clocks == len(back.random_access)


def packet(pid, content=b"", counter=0, start=False, adaptation=None, payload=True, error=False):
    """A packet by hand; adaptation holds the field's bytes after its length; what is left free is stuffed there."""
    room = 184 - len(content)
    if adaptation is not None or room:
        body = (adaptation or b"\0")[: max(room - 1, 0)].ljust(room - 1, b"\xff") if room > 1 else b""
        field = bytes([room - 1]) + body
    else:
        field = b""
    control = (0x20 if field else 0) | (0x10 if payload else 0)
    out = bytes([0x47, (0x80 if error else 0) | (0x40 if start else 0) | pid >> 8, pid & 0xFF, control | counter % 16]) + field + content
    assert len(out) == 188
    return out


def pes(data, pts=None, stream=0xE0, size=None):
    head = b"\x80\x80\x05" + op8.stamp(pts) if pts is not None else b"\x80\0\0"
    return b"\0\0\1" + bytes([stream]) + (len(head) + len(data) if size is None else size).to_bytes(2, "big") + head + data


def spread(data, pid, counter=0):
    return [packet(pid, data[i : i + 184], counter + k, start=not i) for k, i in enumerate(range(0, len(data), 184))]


def foreign():
    """(packets, units): a stream of another multiplexer. Its tables have descriptors and span packets, a network
    and two programs; packets of other ids, null packets and empty ones lie between."""
    r = random.Random(3)
    pat = op8.section(0, 7, b"\0\0" + (0xE010).to_bytes(2, "big") + b"\0\x05" + (0xE200).to_bytes(2, "big") + b"\0\x02" + (0xE100).to_bytes(2, "big"))
    descriptor = b"\x05\x04HDMV"
    es = lambda kind, pid, info=b"": bytes([kind]) + (0xE000 | pid).to_bytes(2, "big") + (0xF000 | len(info)).to_bytes(2, "big") + info
    long_info = b"\x83\xc8" + bytes(200)
    pmt = op8.section(2, 2, (0xE301).to_bytes(2, "big") + (0xF000 | len(descriptor)).to_bytes(2, "big") + descriptor + es(0x1B, 0x300, long_info) + es(0x0F, 0x301, b"\x0a\x04eng\0"))
    other = op8.section(2, 5, (0xE400).to_bytes(2, "big") + b"\xf0\0" + es(0x1B, 0x400))
    table = lambda pid, s, c=0: [packet(pid, (b"\0" + s)[i : i + 184].ljust(184, b"\xff"), c + k, start=not i) for k, i in enumerate(range(0, len(s) + 1, 184))]
    units = [r.randbytes(n) for n in (1000, 50, 700, 184 * 4)]
    out = [*table(0, pat), *table(0x200, other), *table(0x100, pmt), packet(0x1FFF, bytes(184)), packet(0x301, b"", adaptation=b"\x10" + op8.clock_field(9), payload=False)]
    counter = 14
    for k, u in enumerate(units):
        for p in spread(pes(u, 90_000 * k, size=0 if k == 2 else None), 0x300, counter):
            out += [p, packet(0x400, r.randbytes(184), counter)]
            counter += 1
        out.append(packet(0x300, b"", counter - 1, payload=False))  # adaptation only: the counter stays
    return out, units


def test_foreign_streams():
    packets, units = foreign()
    back = op8.demux(b"".join(packets))
    assert back.payload == b"".join(units) and back.pts == [90_000 * k for k in range(4)] and back.breaks == 0 and back.damage == {} and back.clocks == 1
    assert op8.demux(b"".join(packets), program=5).damage == {"header": 1}  # packets without a beginning
    assert op8.demux(b"".join(packets), program=9).damage == {"program": 1}
    own = [i for i, p in enumerate(packets) if p[1:3] == b"\x03\0" or p[1:3] == b"\x43\0"]
    twice = packets[: own[2] + 1] + [packets[own[2]]] + packets[own[2] + 1 :]
    assert (x := op8.demux(b"".join(twice))).payload == back.payload and x.breaks == 0 and x.damage == {"repeated": 1}
    gap = packets[: own[2]] + packets[own[2] + 1 :]
    x = op8.demux(b"".join(gap))
    assert x.breaks == 1 and x.damage == {"lost": 1, "size": 1} and len(x.payload) == len(back.payload) - 184 and x.pts == back.pts
    bad = list(packets)
    bad[own[2]] = packets[own[2]][:1] + bytes([packets[own[2]][1] | 0x80]) + packets[own[2]][2:]
    assert op8.demux(b"".join(bad)).damage == {"error": 1, "lost": 1, "size": 1}
    first = packets[: own[0]] + packets[own[0] + 1 :]
    assert (x := op8.demux(b"".join(first))).damage == {"header": 1} and x.payload == b"".join(units[1:])
    jump = [p if i < own[-3] else p[:3] + bytes([p[3] & 0xF0 | (p[3] + 5) % 16]) + p[4:] if i in own else p for i, p in enumerate(packets)]
    assert op8.demux(b"".join(jump)).breaks == 1


def test_damaged_streams():
    packets, units = foreign()
    whole = b"".join(packets)
    for noise in (b"\x47junk", b"x" * 400, b"\x47" * 3):
        x = op8.demux(noise + whole)
        assert x.payload == b"".join(units) and x.damage["sync"] >= 1, noise
    middle = 188 * 12
    x = op8.demux(whole[:middle] + b"noise" + whole[middle:])
    assert x.payload == b"".join(units) and x.damage == {"sync": 1}
    assert op8.demux(whole + b"\x47abc").damage == {"tail": 1, "sync": 1} or op8.demux(whole + b"\x47abc").damage == {"tail": 1}
    table = bytearray(whole)
    table[20] ^= 1
    assert op8.demux(bytes(table)).damage == {"table": 1, "program": 1}
    for junk in (b"", b"x", bytes(188), b"\x47" * 188, b"\x47" * 1000, random.Random(1).randbytes(5000)):
        assert op8.demux(junk).payload == b""
    r = random.Random(8)
    own = op8.mux(r.randbytes(60_000))
    for _ in range(60):  # nothing raises, whatever is damaged
        hurt = bytearray(own)
        for _ in range(r.randint(1, 30)):
            hurt[r.randrange(len(hurt))] = r.randrange(256)
        for _ in range(r.randint(0, 3)):
            del hurt[(at := r.randrange(len(hurt))) : at + r.randint(1, 400)]
        op8.demux(bytes(hurt))


def test_streams_of_documents(spark, docs, clashing):
    for df in (docs[0], clashing):
        media = op8.table(op8.as_streams(df), "media")
        whole, got = ({r["doc_id"]: r for r in f(media).collect()} for f in (op8.parsed, op8.digests))
        stored = {r["doc_id"]: r["media"] for r in media.collect()}
        for i, t in docs[1].items():
            data = (t or "").encode()
            padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
            r = got[i]
            assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
            assert whole[i]["payload"] == padded and whole[i]["damage"] == {} and r["media_sha256"] == hashlib.sha256(stored[i]).hexdigest()
    odd = spark.createDataFrame([(None, None), (1, b""), (1, b"xyz"), (2, b"".join(foreign()[0]))], "doc_id long, media binary")
    found = sorted(op8.parsed(odd).collect(), key=repr)
    assert [len(r["payload"]) for r in found if r["payload"] is not None] == [0, 0, sum(map(len, foreign()[1]))] and len(found) == 4
    assert op8.digests(odd.withColumn("n_bytes", F.lit(1))).count() == 4
    assert op8.digests(op8.as_streams(none(spark))).count() == 0


# 9. licenses


def test_licenses(spark, docs, clashing):
    rows = [
        (1, "Released under the MIT License."), (2, "x\nLicensed under CC BY-NC 4.0.\ny"), (3, None), (4, ""), (5, "mit  license MIT-License mit licenses"), (6, "General public\nlicense; apache license"),
        (7, "word " * 50_000 + "this work is licensed under the gnu general public license version 3"), (8, "a license"), (9, "permission is hereby granted free of charge to any person obtaining a copy of the software and documentation files associated"),
    ]
    got = {r["doc_id"]: r for r in op9.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    view = {i: (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for i, r in got.items()}
    assert view[1] == (5, 1, 3, 3, "mit", "mit") and view[2] == (9, 0, None, None, "", "cc-by-nc") and view[3] == view[4] == (0, 0, None, None, "", "")
    assert view[5] == (6, 2, 0, 2, "mit", "mit") and view[6] == (5, 2, 0, 3, "apache,gpl", "apache,gpl")
    assert view[7][:5] == (50_012, 1, 50_007, 50_007, "gpl") and view[8][5] == "" and view[9][5] == "mit"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert op9.scan(clashing).count() == len(docs[1]) and op9.scan(none(spark)).count() == 0


def test_license_join_is_exact(spark):
    r = random.Random(2)
    templates = [(label, set(op9.folded(t).split())) for label, t in op9.TEMPLATES]
    rows = []
    for i in range(300):
        _, t = r.choice(templates)
        own = [w.decode() for w in sorted(t) if r.random() < 0.93] + ["extra"] * r.randint(0, 3)
        r.shuffle(own)
        rows.append((i, " ".join(own)))
    got = {x["doc_id"]: set(filter(None, x["labels"].split(","))) - set(filter(None, x["base_labels"].split(","))) for x in op9.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    base = {b: p for p, b in op9.PHRASES.items()}
    for i, text in rows:
        own = set(text.encode().split())
        want = {label for label, t in templates if len(own & t) >= op9.CONTAINMENT * len(t) - 1e-9}
        found_base = {label for label, phrase in base.items() if re.search(rb"(^|\s)" + phrase + rb"(\s|$)", text.encode())}
        assert got[i] == want - found_base


WRAPPED = {
    "bsd": "/*\n * Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions are met:\n */",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
    "gpl": "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public\n# License as published by",
    "mpl": "// This Source Code Form is subject to the terms of the Mozilla Public\r\n// License, v. 2.0. If a copy",
    "apache": "you may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses",
}


def test_wrapped_licenses(spark):
    near = [f"int x;\n{t}\nint y;" for t in WRAPPED.values()]
    far = [t.replace("\n", "\n" + "other " * 40 + "\n") for t in WRAPPED.values()]
    got = {r["doc_id"]: r for r in op9.scan(spark.createDataFrame(list(enumerate(near + far)), "doc_id long, text string")).collect()}
    for i, label in enumerate(WRAPPED):
        assert label in got[i]["labels"].split(",") and got[i]["score"] >= op9.CONTAINMENT
        assert got[i + len(near)]["labels"] == ""


def test_templates_of_a_table(spark):
    """Random templates and texts: labels are those of all windows and lines, whatever the words' frequencies."""
    r = random.Random(11)
    word = lambda: f"w{min(r.randint(0, 60), r.randint(0, 60))}"
    made = [(f"t{k}", " ".join(word() for _ in range(r.randint(1, 12)))) for k in range(25)] + [("t0", "!!"), (None, "w1"), ("x", None), ("t1", "zzz zzy")]
    texts = {i: "\n".join(" ".join(word() for _ in range(r.randint(0, 14))) for _ in range(r.randint(0, 8))) for i in range(120)}
    texts[7] += "\nzzz\n zzy"
    table = spark.createDataFrame(made, "label string, text string")
    got = {x["doc_id"]: x for x in op9.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), templates=table).collect()}
    for i, text in texts.items():
        words, lines = text.split(), [x.split() for x in text.split("\n")]
        want = {}
        for label, t in made:
            own = (t or "").replace("!", "").split()
            if label and own:
                size = -(-5 * len(own) // 4)
                blocks = [*lines, *(words[k : k + size] for k in range(len(words)))]
                share = max((len(set(own) & set(b)) for b in blocks), default=0) / len(set(own))
                if share >= 0.9 - 1e-9:
                    want[label] = max(want.get(label, 0), share)
        assert set(filter(None, got[i]["labels"].split(","))) == set(want) and got[i]["score"] == max(want.values(), default=0.0)
    assert "t1" in got[7]["labels"]
    assert op9.scan(none(spark), templates=table.limit(0)).count() == 0


def test_many_phrases_in_one_text(spark):
    """Places are found in time that grows with the text."""
    began = time.time()
    text = "mit license apache license general public license license " * 60_000
    r = op9.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_base"], r["first_word"], r["last_word"]) == (180_000, 0, 8 * 60_000 - 4) and time.time() - began < 30


def test_runs_of_words():
    r = random.Random(4)
    for _ in range(200):
        words = [r.choice([b"a", b"b", b"c", b"d", b"-", b"-"]) for _ in range(r.randint(0, 30))]
        at = [i for i, w in enumerate(words) if w != b"-"]
        size = r.randint(1, 9)
        want = max((len(set(words[i : i + size]) - {b"-"}) for i in range(len(words))), default=0)
        assert op9.span_share(at, [words[i] for i in at], size) == want


# 10. vectors


def links_by_hand(rows):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(np.array(v))]
    ids = [i for i, _ in good]
    n, root = collections.Counter(), {i: i for i, _ in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            x, y = good[a][1], good[b][1]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                n[ids[a]] += 1
                n[ids[b]] += 1
                p, q = find(ids[a]), find(ids[b])
                root[max(p, q)] = min(p, q)
    return {i: (n[i], find(i), find(i) == i) for i, _ in rows}


def vectors(n=150, dim=64, seed=4):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((12, dim))
    rows = []
    for i in range(n):
        v = centres[i % 12] + r.standard_normal(dim) * r.choice([0.05, 0.25, 0.33, 0.4, 2.0])
        rows.append((i, v.astype(np.float32).tolist()))
    same = rows[0][1]
    rows += [(n + k, same) for k in range(6)] + [(n + 6, [2 * x for x in same])]
    return rows + [(n + 7, None), (n + 8, [0.0] * dim), (n + 9, [None] * dim), (n + 10, [float("nan")] * dim), (n + 11, []), (n + 12, [1.0, 2.0]), (n + 13, [1.0, 2.0])]


@pytest.mark.parametrize("dim", [64, 20, 3])
def test_vectors(spark, dim):
    rows = vectors(dim=dim)
    want = links_by_hand(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for own in (df, df.withColumns({c: F.lit(1) for c in ("id", "v", "n", "w", "block", "chunk", "links", "root", "label")})):
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op10.near_duplicates(own).collect()}
        assert got == want
    assert sum(n for n, _, _ in want.values()) > 100


def test_vectors_in_chunks(spark, monkeypatch):
    rows = vectors()
    monkeypatch.setattr(op10, "CHUNK", 16)
    monkeypatch.setattr(op10, "SAMPLE", 128)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op10.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == links_by_hand(rows)
    assert op10.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_cells():
    """Each point has one cell, and every partner's cell above its own is among those that its ball reaches."""
    r = np.random.default_rng(6)
    x = np.concatenate([r.standard_normal((300, 5)), np.zeros((50, 5)), r.standard_normal((1, 5)) + r.standard_normal((200, 5)) * 0.1])
    cells = op10.Cells(x[::4], 4)
    home = cells.home(x)
    assert home.min() >= 0 and home.max() < 16 and len(set(home)) > 8
    row, cell = cells.near(x, 0.25)
    reach = set(zip(row.tolist(), cell.tolist(), strict=True))
    for a in range(len(x)):
        for b in np.flatnonzero(((x - x[a]) ** 2).sum(axis=1) <= 0.25):
            assert home[b] <= home[a] or (a, home[b]) in reach
    assert len(reach) < 16 * len(x)


def test_vectors_of_doubles(spark, monkeypatch):
    monkeypatch.setattr(op10, "CHUNK", 32)
    rows = [(i, v if v is None else [None if x is None else float(x) * 1e-200 for x in v]) for i, v in vectors(seed=7)]
    rows.append((None, rows[0][1]))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op10.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = links_by_hand([(i, v if v is None else [None if x is None else x * 1e200 for x in v]) for i, v in rows[:-1]])
    assert got == {**want, None: (0, None, True)}


# null and repeated ids, nulls in any column, clashing names, empty tables

AWKWARD = [(None, None, None, None, None), (None, "a b c", "en", "s", 5), (None, "a b c", "en", "s", 5), (1, "x " * 40, "fr", None, None), (1, "x " * 40, "fr", None, None), (1, "y " * 40, "fr", "s", 80), (2, "", "de", "s", 0), (3, " \n", None, None, 2)]
EACH = {
    "op2": lambda df: op2.sample(df, op2.n_words(F.col("text")), "source", "doc_id"),
    "op3": lambda df: op3.identify(df, {"en": b"a b c the of", "fr": b"x y le la"}),
    "op4": op4.near_duplicates,
    "op5": op5.remove_repeats,
    "op6": op6.packed_documents,
    "op8": lambda df: op8.digests(op8.as_streams(df)),
    "op9": op9.scan,
}


@pytest.fixture(scope="module")
def awkward(spark):
    plain = spark.createDataFrame(AWKWARD, DOCS).repartition(3)
    names = ("id", "n", "rep", "sig", "tok", "part", "z", "_salt", "_s", "_row", "size", "copies", "target", "media", "words", "labels", "rejected", "lang_pred", "kept", "component_id", "shard", "sequence_id", "offset", "ids_crc32")
    return {"plain": plain, "clashing": plain.withColumns({c: F.lit(None).cast("string") if k % 2 else F.map_from_arrays(F.array(F.lit("k")), F.array(F.lit(k))) for k, c in enumerate(names)}), "empty": none(spark)}


@pytest.mark.parametrize("name", sorted(EACH))
def test_awkward_rows(awkward, name):
    """One row for each row, null ids as null ids; the texts here are one piece each."""
    for kind, df in awkward.items():
        got = collections.Counter(r["doc_id"] for r in EACH[name](df).collect())
        assert got == ({} if kind == "empty" else {None: 3, 1: 3, 2: 1, 3: 1}), kind


def test_awkward_rows_in_stages(spark, awkward):
    """Each stage gives the columns of documents and keeps what its docstring says."""
    import corpus_pipeline as cp

    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    want = {
        "language ID": None, "MinHash near-dedup": {None: 3, 1: 3, 2: 1, 3: 1}, "substring dedup": {None: 3, 1: 3, 2: 1, 3: 1}, "mixing sources": None, "best-fit packing": {None: 3, 1: 3, 2: 1, 3: 1},
    }
    for kind, df in awkward.items():
        for name, stage in cp.STAGES:
            out = stage(spark, df, SMALL)
            got = collections.Counter(r["doc_id"] for r in out.collect())
            if name != "best-fit packing":
                assert out.columns == columns, name
            if kind == "empty":
                assert not got, name
            elif want[name]:
                assert got == want[name], (kind, name)
            elif name == "language ID":
                assert set(got) <= {None, 1}, kind  # null and blank texts go
            else:
                assert got and set(got) <= {None, 1, 2, 3}, kind


def test_session_is_left_as_it_was(spark):
    from loglens.llm import scratch

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    scratch.table(spark.range(3), "x")
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "77" and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


# pipeline


def test_pipeline(spark):
    import corpus_pipeline as pipe

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = [r["doc_id"] for r in pipe.language(spark, docs, SMALL).collect()]
    assert len(kept) > 0.95 * len(texts)
    near = pipe.near_duplicates(spark, docs, SMALL)
    hand = near_by_hand(texts)
    assert {r["doc_id"] for r in near.collect()} == {i for i, x in hand.items() if x[2]}
    hand = repeats_by_hand(texts)
    cut = {r["doc_id"]: r for r in pipe.repeats(spark, docs, SMALL).collect()}
    for i, (_, gone, left) in hand.items():
        if gone and not left:
            assert i not in cut
        else:
            assert cut[i]["text"] == (left if gone else texts[i]) and cut[i]["n_chars"] == len(cut[i]["text"])
    out = pipe.run(spark, SMALL)
    rows = out.collect()
    check_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in rows])
    assert len(rows) > 50
