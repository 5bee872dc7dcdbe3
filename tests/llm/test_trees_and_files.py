"""Merkle manifests, files of token ids and prefix tries against plain versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loglens.llm import op11, op12, op13
from loglens.llm.scratch import numbered

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("parts", [1, 7])
def test_numbered(spark, parts):
    r = random.Random(parts)
    rows = [(r.choice("aaaab"), r.choice([None, 1, 2, 3]), i) for i in range(300)] + [("c", 0, 1000)]
    df = spark.createDataFrame(rows, "g string, v long, i long").repartition(parts)
    got = [tuple(x) for x in numbered(df, "g", [F.col("v").asc_nulls_first(), F.col("i")], "at").collect()]
    want, seen = [], collections.Counter()
    for g, v, i in sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0, x[2])):
        want.append((g, v, i, seen[g]))
        seen[g] += 1
    assert [x[3] for x in sorted(got, key=lambda x: x[2])] == [x[3] for x in sorted(want, key=lambda x: x[2])]
    assert numbered(df.limit(0), "g", [F.col("v")], "at").count() == 0


# 11. Merkle manifests


def tree(leaves, fanout):
    """(root, [siblings of each leaf, level by level])"""
    levels = [leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([sha("".join(now[i : i + fanout])) for i in range(0, len(now), fanout)])
    beside = []
    for at in range(len(leaves)):
        own = []
        for nodes in levels[:-1]:
            run = range(at - at % fanout, min(at - at % fanout + fanout, len(nodes)))
            own += [nodes[i] for i in run if i != at]
            at //= fanout
        beside.append(own)
    return levels[-1][0], beside


@pytest.mark.parametrize(("levels", "fanout", "n"), [(1, 2, 45), (2, 3, 150), (12, 2, 30)])
def test_manifest_by_hand(spark, levels, fanout, n):
    r = random.Random(n)
    rows = [(r.choice([None, *range(n)]), r.choice([None, "", "é a", "x" * 50]), r.choice(["en", "en", "en", "é", "z", "", None]), "s", r.choice([None, 3])) for _ in range(n)] * (2 if n == 45 else 1)
    df = spark.createDataFrame(rows, DOCS).repartition(3).withColumns({c: F.lit("x") for c in ("tree", "key", "leaf", "row", "root")})
    bad = F.when(F.col("n_chars") == 3, F.lit("0" * 64))
    got = collections.Counter(tuple(x) for x in op11.manifest(df, levels=levels, fanout=fanout, tampered=bad).collect())
    one = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    by = collections.defaultdict(list)
    for i, text, lang, source, chars in rows:
        by[lang].append((i, sha("".join(map(one, (i, source, lang, chars, text)))), chars == 3))
    order = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        # of equal leaves the changed one may stand anywhere, but they have one n_chars, so both are changed
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = tree([x[1] for x in by[lang]], fanout)
    root, above = tree([trees[x][0] for x in order], fanout)
    want = collections.Counter()
    for lang, rest in zip(order, above, strict=True):
        for (i, leaf, changed), beside in zip(by[lang], trees[lang][1], strict=True):
            want[(i, leaf, trees[lang][0], root, sha("".join(beside + rest)), not changed)] += 1
    assert collections.Counter((*k[:5], k[6]) for k in got.elements()) == want
    assert all((k[5] == k[3]) == k[6] for k in got)


def test_manifest_of_nothing(spark):
    assert op11.manifest(spark.createDataFrame([], DOCS)).count() == 0


# 12. files of token ids


@pytest.fixture(scope="module")
def encoder():
    return op12.Encoder(op12.vocabulary())


def test_pieces_have_the_ids_of_whole_texts(encoder):
    r = random.Random(3)
    some = ["a", "B", " ", "  ", "\n", "\n\n", "\t", ".", ",", "'s", "'ll", "<|endoftext|>", "<", "é", "×", "\xa0", " ", "1", "23", "日", "-", "?!", "\x85", "\x1c", "😀", "_", " word", "."]
    texts = [None, "", *("".join(r.choice(some) for _ in range(r.randint(0, 14))) for _ in range(5000)), "x" * 100_000]
    cut, ids = encoder(pa.array(texts))
    for i, found in enumerate(encoder.model.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)):
        assert ids[cut[i] : cut[i + 1]].tolist() == [*found.ids, op12.END], texts[i]


def test_remembered_pieces_may_go(encoder, monkeypatch):
    monkeypatch.setattr(op12, "REMEMBERED", 50)
    own, r = op12.Encoder(op12.vocabulary()), random.Random(1)
    for _ in range(20):
        texts = [" ".join(f"w{r.randint(0, 200)}" for _ in range(30)) for _ in range(3)]
        assert own(pa.array(texts))[1].tolist() == [i for e in own.model.encode_batch_fast(texts, add_special_tokens=False) for i in [*e.ids, op12.END]]
    assert len(own.keys) <= 150


R = np.random.default_rng(5)
CASES = {
    "none": [],
    "one": [7],
    "equal": [9] * 10_000,
    "all different": range(4096),
    "more than a block": range(5000),
    "evenly": R.integers(0, 65_536, 9000),
    "skewed": R.zipf(1.3, 20_000) % 50_000,
    "phrases": np.tile(R.integers(0, 50_000, 37), 500),
    "a block and one": R.integers(0, 3, 4097),
    "whole blocks": R.integers(0, 300, 8192),
}


@pytest.mark.parametrize("case", CASES)
def test_blocks_round_trip(case):
    ids = np.array(CASES[case], np.uint16)
    directory, alphabets, words = op12.squeeze(ids)
    body = b"".join(x for p in zip(alphabets, words, strict=True) for x in p)
    assert (op12.expand(directory, memoryview(body)) == ids).all()
    if case in ("equal", "phrases", "skewed", "whole blocks"):
        assert len(body) < 2 * len(ids) * 0.85
    # each block alone
    at = 0
    for i, (a, w) in enumerate(zip(alphabets, words, strict=True)):
        own = memoryview(body)[at : at + len(a) + len(w)]
        at += len(own)
        assert (op12.expand(directory[i : i + 1], own) == ids[i * op12.BLOCK : (i + 1) * op12.BLOCK]).all()


def test_carries_ripple():
    # long runs of sure predictions drive the coder's low end up to its limit now and then
    r = np.random.default_rng(0)
    for _ in range(20):
        ids = np.repeat(r.integers(0, 4, 3000), r.integers(1, 30, 3000))[:30_000].astype(np.uint16)
        directory, alphabets, words = op12.squeeze(ids)
        assert (op12.expand(directory, memoryview(b"".join(x for p in zip(alphabets, words, strict=True) for x in p))) == ids).all()


def test_blocks_are_coded_in_spells(monkeypatch):
    # what is known beforehand is not looked up id by id
    calls, real = [], op12.Lanes.interval
    monkeypatch.setattr(op12.Lanes, "interval", lambda self, *a: calls.append(1) or real(self, *a))
    ids = np.concatenate([np.tile(R.integers(0, 900, 50), 200), R.integers(0, 900, 2 * op12.BLOCK + 1000)]).astype(np.uint16)
    directory, alphabets, words = op12.squeeze(ids)
    assert 0 < len(calls) < op12.BLOCK // 8
    assert (op12.expand(directory, memoryview(b"".join(x for p in zip(alphabets, words, strict=True) for x in p))) == ids).all()


def test_predictions_found_beforehand():
    r = random.Random(2)
    blocks = [[r.choice([0, 1, 2, r.randrange(900)]) for _ in range(500)] for _ in range(3)]
    for own, told in zip(blocks, op12._told(np.array(blocks, np.int16)).tolist(), strict=True):
        tables, a, b = ({}, {}), 0, 0
        for x, t in zip(own, told, strict=True):
            want = 0
            for place, (table, key) in enumerate(zip(tables, (a, a * 0x9E3B + b * 0x6A09 & (1 << op12.BITS2) - 1), strict=True)):
                guess, trust = table.get(key, (0, 0))
                want |= trust << 3 * place | (guess == x) << 6 + place
                table[key] = (x, min(trust + 1, op12.LEVEL)) if guess == x else (x, 0)
            assert t == want
            a, b = x, a


def test_a_part_of_some_million_ids_is_one_file(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        df = spark.range(5).select(F.col("id").alias("doc_id"), F.expr("repeat('a ', 900000 + int(id))").alias("text"))
        files = op12.write_ids(df, op12.vocabulary()).collect()
        assert [(f["first"], f["n_ids"]) for f in files] == [(0, sum(op12.read_file(bytes(files[0]["bytes"]))[1].tolist()))]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_file_and_its_damage():
    ids = np.array(CASES["skewed"], np.uint16)
    names, counts = [5, None, -3, 2**60], np.array([1, 0, 15_000, 4999])
    data = op12.pack_file(names, counts, ids)
    back = op12.read_file(data)
    assert back[0] == names and (back[1] == counts).all() and (back[2] == ids).all()
    r = random.Random(0)
    for at in [*range(40), *(r.randrange(len(data) - 8) for _ in range(60))]:
        worse = bytearray(data)
        worse[at] ^= 1 << r.randrange(8)
        with pytest.raises(ValueError):
            op12.read_file(bytes(worse))
    for size in (0, 10, 30, 200, len(data) // 2):
        with pytest.raises(ValueError):
            op12.read_file(data[:size])


def expected_ids(encoder, rows):
    """(doc_id, n_tokens, ids_crc32) of rows, any order."""
    out = collections.Counter()
    for i, text in rows:
        ids = [*encoder.model.encode(text or "", add_special_tokens=False).ids, op12.END]
        out[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    return out


@pytest.mark.parametrize("size", [1, 40])
def test_token_files(spark, encoder, size):
    r = random.Random(size)
    rows = [(r.choice([None, None, *range(-5, 60)]), r.choice([None, "", "a b", " ".join(f"w{r.randint(0, 50)}" for _ in range(r.randint(1, 60)))])) for _ in range(120)]
    rows += rows[:30] + [(1000, "long " * 9000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumns({c: F.lit("x") for c in ("id", "tie", "row", "part", "bytes", "n")})
    files = op12.write_ids(df, op12.vocabulary(), size=size)
    got = [tuple(x) for x in op12.read_ids(files).collect()]
    assert collections.Counter((a, c, d) for a, _, c, d in got) == expected_ids(encoder, rows)
    at = 0
    for i, start, n, _ in sorted(got, key=lambda x: x[1]):
        assert start == at
        at += n
    order = [x[0] for x in sorted(got, key=lambda x: x[1])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))


def test_token_files_of_nothing(spark):
    assert op12.token_files(spark.createDataFrame([], DOCS)).count() == 0


# 13. prefix tries


def trie(rows, family=20, heads=4):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    full = {}
    for c in own:
        base = c - (abs(c) % family) * (1 if c >= 0 else -1)
        h = zlib.crc32(str(c).encode()) % heads
        full[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = collections.defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes[turns[:d]].append(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    out = []
    for p, members in nodes.items():
        under = [q for q in nodes if q[: len(p)] == p]
        ends = ",".join(str(c) for c in sorted(c for c in members if full[c] == p))
        saved = sum((len(nodes[q]) - 1) * (len(WORD.findall(q[-1][1])) if q else 0) for q in under)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], sum(not children[q] for q in under), saved, sha(ends)))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed", range(2))
def test_trie_by_hand(spark, seed):
    r = random.Random(seed)
    rows = []
    for c in [*range(0, 70), -3, -20, -41, 205, 1000]:
        for t in range(r.choice([1, 1, 2, 3, 5])):
            rows.append((c, r.choice([t, t, t, None]), r.choice(["user", "user", None, ""]), r.choice(["hi", "yes  no", "", None, "a b c"])))
    rows += [(None, 0, "user", "lost")] * 3 + [rows[0]] * 2
    if seed == 1:  # long ones of several spans, with a shared beginning
        rows += [(c, t, "u", f"t{t}" if t < n - 2 else f"c{c}") for c, n in ((300, 600), (301, 600), (302, 520)) for t in range(n)]
    df = spark.createDataFrame(rows, TURNS).repartition(3).withColumns({x: F.lit("x") for x in ("c", "k", "d", "f0", "words", "h")})
    got = sorted((tuple(x) for x in op13.prefix_trie(df).collect()), key=str)
    want = trie(rows)
    assert got == want


def test_trie_with_other_bases(spark, monkeypatch):
    """With primes so small that fingerprints of different texts meet, groups are found unequal and done again."""
    rows = [(c, t, "u", f"{r}") for c in range(8) for t, r in enumerate(random.Random(c).sample(range(4), 2))]
    monkeypatch.setattr(op13, "PRIMES", (37, 41, 43))
    tried, plain = [], op13.rebuilt
    monkeypatch.setattr(op13, "rebuilt", lambda turns, attempt, *a: tried.append(attempt) or plain(turns, 0 if attempt > 5 else attempt, *a))
    monkeypatch.setattr(op13, "_bases", lambda attempt: [1, 1, 1] if attempt == 0 else [5 + attempt, 7 + attempt, 11 + attempt])
    got = sorted((tuple(x) for x in op13.prefix_trie(spark.createDataFrame(rows, TURNS)).collect()), key=str)
    assert got == trie(rows) and tried[0] == 0


def test_trie_of_nothing(spark):
    assert op13.prefix_trie(spark.createDataFrame([], TURNS)).count() == 0


def test_ids_of_a_large_node_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(op13, "PIECE", 50)
    ids = [*range(-30, 400), 10**12]
    df = spark.createDataFrame([(1, 2, i) for i in reversed(ids)] + [(1, 3, 5), (4, 2, 6)], "c long, d long, id long").repartition(5)
    got = {(r["c"], r["d"]): r["sha"] for r in op13._digests(df).collect()}
    assert got == {(1, 2): sha(",".join(map(str, sorted(ids)))), (1, 3): sha("5"), (4, 2): sha("6")}


def test_new_pieces_are_encoded_together():
    encode, texts = op12.Encoder(op12.vocabulary()), []
    real = encode.model

    class Counted:
        def encode_batch_fast(self, some, **more):
            texts.extend(some)
            return real.encode_batch_fast(some, **more)

    encode.model = Counted()
    rng = random.Random(5)
    bits = [" ", "  ", "\n", "\t", "é", " É", "<|endoftext|>", " <", ".", "'s", " 's", "́", " ́", "日本", " 日", "$$$", "Ġ", " Ġa", "\r\n"]
    plain = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(2000))]
    odd = ["".join(rng.choice([*bits, f" x{rng.randrange(99)}"]) for _ in range(rng.randrange(30))) for _ in range(500)]
    for rows in (plain, odd, plain):
        cut, ids = encode(pa.array(rows))
        assert [ids[s:e].tolist() for s, e in zip(cut, cut[1:])] == [[*real.encode(r, add_special_tokens=False).ids, op12.END] for r in rows]
        if rows is plain:
            assert len(texts) < 100
        texts.clear()
