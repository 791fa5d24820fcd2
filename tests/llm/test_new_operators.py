"""Hard negatives, token counts and periodic runs against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodegrid.llm import negatives, periodic, tokencount
from lodegrid.llm.queries import QUERIES, SQL, with_tail
from tests.llm.test_operators import LONG, TEXTS, none, odd, table, texts_of  # noqa: F401
from tests.oracle_check import check, connect

SF = "/root/testdata/sf0.001"


# 11 -----------------------------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize(("dim", "top"), [(1, 5), (64, 147), (65, 2**20), (700, 2**24), (3, 2**30)])
def test_residue_product_is_exact(dim, top):
    rng = np.random.default_rng(dim)
    a, b = rng.integers(-top, top + 1, (7, dim)), rng.integers(-top, top + 1, (9, dim))
    b[0], a[0] = top, -top
    want = np.array([[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a], dtype=object)
    got = negatives.Product(a.astype(float), b.astype(float)).scores(slice(None))
    assert (got.astype(object) == want).all()


def test_primes_and_bounds():
    assert all(negatives.BLOCK * ((p - 1) // 2) ** 2 < 2**24 for p in negatives.PRIMES) and len(set(negatives.PRIMES)) == len(negatives.PRIMES)
    for bound in (0, 1, 500_000, 2**40, 2**61):
        assert math.prod(negatives.moduli(bound)) > 2 * bound + 1
    with pytest.raises(OverflowError):
        negatives.moduli(2.0**62)


def test_order_of_scores_alike_on_both_ways():
    rng = np.random.default_rng(3)
    s, good = rng.integers(-4, 5, (20, 33)), rng.random((20, 33)) < 0.6
    for most in (None, 5, 40):
        fast, slow = negatives.ordered(s, good, 4.0, most), negatives.ordered(s, good, 2.0**60, most)
        for i in range(20):
            n = fast[2][i]
            assert n == slow[2][i] == min(good[i].sum(), most or 99)
            want = sorted(np.flatnonzero(good[i]), key=lambda j: (-s[i, j], j))[:n]
            assert fast[1][i, :n].tolist() == slow[1][i, :n].tolist() == want
            assert fast[0][i, :n].tolist() == slow[0][i, :n].tolist() == s[i, want].tolist()


def plain_negatives(rows, every=50, low=50, high=95):
    ok = {}
    for i, label, v in rows:
        if i is None or label is None or not v or any(x is None or not math.isfinite(x) for x in v):
            continue
        ok[i] = min(ok.get(i, (label, v)), (label, v))
    ints = {i: (label, [math.floor(256 * x) for x in v]) for i, (label, v) in ok.items()}
    out = []
    for a, (la, va) in ints.items():
        if a % every:
            continue
        s = [(-sum(x * y for x, y in zip(va, v)), i, label) for i, (label, v) in ints.items() if i != a and len(v) == len(va)]
        for ps, p, _ in sorted(x for x in s if x[2] == la)[:5]:
            fit = sorted((ns, i) for ns, i, label in s if label != la and 50 * -ps <= 100 * -ns <= 95 * -ps)
            out += [(a, p, k + 1, i, -ps, -ns) for k, (ns, i) in enumerate(fit[:3])]
    return sorted(out)


def test_negatives(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 4)), np.float32(rng.normal(size=6) + (i % 3)).tolist()) for i in range(-100, 400)]
    rows += [(i, 1, rows[0][2]) for i in range(500, 620)]  # copies: ties by key
    rows += [(None, 1, [1.0] * 6), (650, None, [1.0] * 6), (651, 2, None), (652, 2, []), (653, 2, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (654, 2, [float("nan")] * 6), (655, 2, [float("inf")] * 6)]
    rows += [(700, 2, [0.0] * 6), (701, 2, [0.0] * 6), (702, 3, [0.0] * 6), (750, 1, [2.0, 3.0]), (751, 1, [2.0, 3.0]), (752, 0, [1.0, 2.0]), (800, 3, [-1.0] * 6), (50, 9, [9.0] * 6)] + rows[:60]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<float>, cell string, id int").repartition(4)
    want = plain_negatives(rows)
    assert len(want) > 50 and sorted(map(tuple, negatives.mine(df).collect())) == want
    monkeypatch.setattr(negatives, "ROWS", 90)
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "HELD", 100)
    assert sorted(map(tuple, negatives.mine(df).collect())) == want
    empty = negatives.mine(df.limit(0))
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_op11_statement(spark):
    ok, said = check(spark, connect("/root/testdata/sf0.01"), "/root/testdata/sf0.01", "op11", QUERIES["op11_residue_negatives"], SQL["op11_residue_negatives"])
    assert ok, said


# 12 -----------------------------------------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def counter():
    import public_tokenizers

    return tokencount.counter(public_tokenizers.path("byte_bpe_50k.json"))


def test_whole_tokens_are_proven(counter):
    whole = counter.lengths.whole
    assert len(whole) > 40_000 and " the" in whole and "the" in whole
    some = random.Random(0).sample(sorted(whole), 5000)
    assert all(len(x.ids) == 1 for x in counter.t.encode_batch(some, add_special_tokens=False))
    assert "\n\n\n" not in whole or len(counter.t.encode("\n\n\n").ids) == 1


def test_pattern_and_library_agree_where_claimed(counter):
    for a, b in tokencount.PROVEN:
        for c in range(a, b + 1, 1 if b - a < 3000 else 7):
            ch = chr(c)
            s = f"a{ch}a {ch} 1{ch}1 .{ch}. {ch}{ch}a  "
            assert [s[x:y] for _, (x, y) in counter.t.pre_tokenizer.pre_tokenize_str(s)] == counter.pattern.findall(s), hex(c)


def test_token_counts(odd, none, counter, monkeypatch):  # noqa: F811
    t = counter.t
    size = lambda x: len(t.encode(x, add_special_tokens=False).ids)
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = sorted(((d, len((x or "").encode()), size(x or ""), size(x or "") > 512) for d, x in texts_of(odd)), key=key)
    got = tokencount.counts(odd)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and sorted(map(tuple, got.collect()), key=key) == want
    assert tokencount.counts(none).count() == 0
    rng = random.Random(5)
    pool = [" ", "  ", "\n", "\t", "\x1c", "\x85", " ", "　", "a", "The", "'ll", "'", "9", "²", ".", "..", "é", "日本", "\U0001f600", "<|endoftext|>", "<|endof", "՘", "꟎", "zzqx", "antidisestablishment", "\x00"]
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(40))) for _ in range(1500)] + ["x" * 5000, " " * 5000, "a1" * 4000, "<|endoftext|>" * 9]
    for section in (1 << 18, 16):
        monkeypatch.setattr(tokencount, "SECTION", section)
        assert [counter.count(x) for x in texts] == [size(x) for x in texts]


def test_merged_only_where_not_whole(counter):
    before = counter.lengths.merged
    counter.count("the house of the rising sun is a house of the sun")
    assert counter.lengths.merged == before
    counter.lengths.most, most = 50, counter.lengths.most
    assert counter.count(LONG[:50_000]) == len(counter.t.encode(LONG[:50_000], add_special_tokens=False).ids)
    counter.lengths.most = most


# 13 -----------------------------------------------------------------------------------------------------------------------------------

def plain_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q) and (i, j + q) not in out:
                out[i, j + q] = q
            i = j + 1 if j == i else j
    return sorted((s, e - s, q) for (s, e), q in out.items())


def plain_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [x for i, x in enumerate(w) if i not in gone]


def test_runs_against_all_lags(monkeypatch):
    rng = random.Random(11)
    texts = [[rng.choice("ab") for _ in range(rng.randrange(60))] for _ in range(300)]
    for _ in range(200):
        w = []
        for _ in range(rng.randrange(1, 5)):
            unit = [rng.choice("abcdefghij") for _ in range(rng.randrange(1, 25))]
            w += (unit * rng.randrange(1, 9))[: rng.randrange(1, 150)] + [str(rng.random())] * rng.randrange(2)
        texts.append(w)
    a, b = ["x"], ["x", "y"]
    for _ in range(9):
        a, b = b, b + a
    texts += [b, ["z"] * 3000, (["p", "q"] * 400 + ["r"]) * 5]
    assert sum(map(len, map(plain_runs, texts))) > 300
    for dense in (8, 1, 0):
        monkeypatch.setattr(periodic, "DENSE", dense)
        for w in texts:
            runs = periodic.runs_of(w)
            assert runs == plain_runs(w), w
            assert periodic.collapse(w, runs) == plain_collapse(w, runs)


def test_segments_are_stable_and_lose_no_run():
    rng = np.random.default_rng(2)
    for _ in range(200):
        w = rng.zipf(1.3, rng.integers(1, 400)) % 50
        ids = np.unique(w, return_inverse=True)[1]
        found = periodic.segments(ids, 4, 6)
        for lo, hi in found:
            assert hi - lo >= 6 and np.unique(ids[lo:hi], return_counts=True)[1].min() >= 4
        for s, n, _ in plain_runs(w.tolist()):
            assert any(lo <= s and s + n <= hi for lo, hi in found)


def test_long_texts_take_n_log_n():
    import time

    chain = [f"c{i // 4}" for i in range(400_000)]  # every split frees the next one
    for w in (["a"] * 1_000_000, [f"w{i % 5000}" for i in range(1_000_000)], chain, [f"b{i // 7}" for i in range(350_000)]):
        began = time.time()
        periodic.runs_of(w)
        assert time.time() - began < 30


def test_detect(odd, none):  # noqa: F811
    rows = periodic.detect(odd).collect()
    want = []
    for d, x in texts_of(odd):
        w = re.findall("[^ \t-\r]+", x or "")
        runs = [] if len(w) > 10_000 else plain_runs(w)
        if len(w) > 10_000:
            runs = periodic.runs_of(w)
            assert runs == [(0, len(w), 997 * 13)]
        want.append((d, len(w), runs, " ".join(plain_collapse(w, runs))))
    key = lambda r: str(r)
    assert sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["kept"]) for r in rows), key=key) == sorted(want, key=key)
    assert periodic.detect(none).count() == 0 and periodic.detect(none).columns == ["doc_id", "n_words", "runs", "kept"]
    with pytest.raises(ValueError):
        periodic.detect(odd, times=3)


def test_op13_by_its_contract(spark):
    got = {r["doc_id"]: r for r in QUERIES["op13_frequency_split_runs"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    edited = {r["doc_id"]: r["text"] for r in with_tail(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    assert len(got) == len(docs)
    seen = 0
    for d, text in docs:
        w = re.findall("[^ \t-\r]+", text or "")
        n, h = len(w), zlib.crc32(str(d).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            assert edited[d].split(" ") == w
        if n > 3000:
            continue
        runs = plain_runs(w)
        seen += len(runs)
        r = got[d]
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert r["n_runs"] == len(runs)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(plain_collapse(w, runs)).encode()).hexdigest()
    assert seen > 10


def test_tail_of_odd_rows(odd):  # noqa: F811
    rows = with_tail(odd).collect()
    assert len(rows) == odd.count() and sum(r["text"] is None for r in rows) == odd.where(F.col("text").isNull()).count()
