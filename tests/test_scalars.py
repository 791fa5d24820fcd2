import weakref

from pyspark.sql import functions as F

import pandas as pd
import pyarrow as pa

from lodegrid.functions import evm, scalars as sc
from lodegrid.functions import text
from lodegrid.functions.text import contract_level, parse_source, snippet, split_top_level, strip_comments


def one(spark, col, **vals):
    df = spark.createDataFrame([tuple(vals.values())], list(vals)) if vals else spark.range(1)
    return df.select(col.alias("v")).first().v


def test_strip_comments_keeps_length_and_lines():
    src = "a // x\n/* b\n c */ d"
    out = strip_comments(src)
    assert len(out) == len(src) and out.count("\n") == src.count("\n")
    assert out.replace(" ", "").replace("\n", "") == "ad"


def test_parse_source_nested_and_unterminated():
    r = parse_source("function a(uint x) public { if (x > 1) { y(); } }\nfunction b() external { z {")
    assert [f[2] for f in r["fns"]] == ["a", "b"]
    assert r["fns"][0][5] == "{ if (x > 1) { y(); } }" and r["fns"][1][1] == 2
    assert r["fns"][1][5] == "{ z {"


def test_contract_level_and_split(spark):
    d = spark.createDataFrame([("contract A { uint x; function f() { uint y; } uint z; }", "a, f(b, c), d[1,2]")], "s string, p string")
    r = d.select(contract_level("s").alias("s"), split_top_level("p").alias("p")).first()
    assert "uint x;" in r.s and "uint z;" in r.s and "uint y;" not in r.s
    assert r.p == ["a", "f(b, c)", "d[1,2]"]


def test_snippet_window(spark):
    text = "\n".join(f"l{i}" for i in range(20))
    assert one(spark, snippet(F.col("t"), F.lit(text.index("l5"))), t=text) == "\n".join(f"l{i}" for i in range(4, 13))


def test_fingerprint_ignores_cosmetics(spark):
    fp = lambda t, f, fn="go": one(spark, sc.fingerprint(F.lit("d"), F.array(F.lit(fn)), F.lit(t), F.lit(f)))
    assert fp("Hit 0xAbCd12 at 42", "a/b/C.sol") == fp("hit  0x9999aa at 7", "x\\C.sol")
    assert fp("Hit", "C.sol") != fp("Hit", "C.sol", "stop")


def test_classify_ladder(spark):
    rows = [(9.0, 8.0), (10.0, 9.0), (9.0, 6.0), (9.0, 5.0), (8.0, 4.0), (7.0, 3.0), (5.0, 9.0), (2.0, 1.0)]
    got = [r.k for r in spark.createDataFrame(rows, "i double, c double").select(sc.classify(F.col("i"), F.col("c")).alias("k")).collect()]
    assert got == [sc.CONFIRMED] * 2 + [sc.LIKELY] * 2 + [sc.NEEDS] * 2 + [sc.LOW] * 2


def test_keccak_of_many_messages_at_once():
    known = {b"": "c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470", b"abc": "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"}
    mixed = [*known, *[bytes([k % 251]) * k for k in (135, 136, 137, 271, 272, 273)], b"abc"]
    got = evm.keccak256_all(mixed)
    assert got[:2] == list(known.values()) and got[-1] == got[1]
    assert got == [evm.keccak256(m) for m in mixed] and len(set(got)) == len(mixed) - 1
    assert evm.keccak256_all([]) == []
    assert len(set(evm.keccak256_all([b"%d" % i for i in range(evm.LANES + 10)]))) == evm.LANES + 10
    assert evm.keccak_text.func(pd.Series(["abc", None, ""], index=[5, 6, 9])).tolist() == [got[1], None, got[0]]
    assert evm.keccak_hex.func(pd.Series(["616263", "", None])).tolist() == ["0x" + got[1], "", ""]


def test_parsed_texts_leave_a_batch_in_slices():
    raw = pd.Series([f"/* c\n{i} */ function f{i}() public {{ x = {i}; }}" for i in range(2 * text.SLICE_ROWS + 3)])
    parts = list(text.parsed_slices(iter([raw, raw[:1], raw[:0]])))
    assert [len(p) for p in parts] == [text.SLICE_ROWS, text.SLICE_ROWS, 3, 1]
    assert [r[0]["name"] for p in parts[:3] for r in p["fns"]] == [f"f{i}" for i in range(len(raw))]
    assert text.blanked("a\r b\n\nc\u2028") == "    \n\n  "


def test_keccak_and_slots():
    assert evm.keccak256(b"transfer(address,uint256)")[:8] == "a9059cbb"
    assert evm.keccak256(b"x" * 300) != evm.keccak256(b"x" * 301)
    impl = int(evm.keccak256(b"eip1967.proxy.implementation"), 16) - 1
    assert f"{impl:064x}" == evm.PROXY_SLOTS["eip1967_implementation_slot"]


def test_bytecode_utils(spark):
    addr = "ab" * 20
    code = "0x" + evm.MINIMAL_PROXY + addr + "5af4a264697066735822ffzz"
    d = spark.createDataFrame([(code,)], "c string").select(evm.normalize_bytecode(F.col("c")).alias("n")).select("n", evm.strip_metadata(F.col("n")).alias("s"))
    r = d.select("n", "s", evm.minimal_proxy_target(F.col("s")).alias("t")).first()
    assert r.t == "0x" + addr and r.s.endswith("5af4") and len(r.n) % 2 == 0
    ops = spark.createDataFrame([("6001600262aabb",)], "c string").select(F.explode(evm.decode_opcodes("c")).alias("o")).select("o.*").collect()
    assert [(o.pc, o.name, o.push_data) for o in ops] == [(0, "PUSH1", "01"), (2, "PUSH1", "02"), (4, "PUSH3", "aabb")]


def test_json_from_chat(spark):
    f = lambda t: one(spark, sc.json_from_text(F.col("t")), t=t)
    assert f("x ```json\n{\"a\": 1}\n``` y") == '{"a": 1}'
    assert f("say {\"a\": 2} done") == '{"a": 2}'
    assert f("no { json") is None


def test_slices_are_bounded_by_rows_and_characters():
    long = "x" * (text.SLICE_CHARS // 2)
    values = ["a", None, long, long, long, "b", long * 3, "c"]
    for batch in (pa.array(values), pd.Series(values)):
        assert list(text.slices(iter([batch, batch[:0], batch[:1]]))) == [["a", None, long], [long, long], ["b"], [long * 3], ["c"], ["a"]]
    assert [len(x) for x in text.slices(iter([pa.array(["a"] * 5)]), 2)] == [2, 2, 1]


def test_a_batch_is_let_go_before_the_next_is_asked_for():
    seen = []

    def batches():
        for _ in range(3):
            b = pd.Series(["function f() public {}"] * 3)
            seen.append(weakref.ref(b))
            yield b
            del b
            assert seen[-1]() is None

    assert sum(map(len, text.parsed_slices(batches()))) == 9


def test_arrow_batches_are_parsed_as_one(spark):
    src = [None, "", "modifier only() { _; } function f(uint a) public only { x = \"é\U0001f600\"; }", "contract C { function g() external { if (a) { b(); } }"]
    d = spark.createDataFrame([(i, src[i % 4]) for i in range(300)], "id long, raw string").coalesce(1)
    got = d.select("id", "raw", text.parse_sources("raw").alias("p")).select("*", text.contract_level("p.clean").alias("level")).collect()
    assert len(got) == 300
    for r in got:
        want = text.parse_source(r.raw)
        assert r.p.clean == want["clean"] and [tuple(f) for f in r.p.fns] == want["fns"] and [tuple(m) for m in r.p.mods] == want["mods"]
        assert len(r.level) == len(r.raw or "") and "b();" not in r.level
