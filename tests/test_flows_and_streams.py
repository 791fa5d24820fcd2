"""Graph walks, flows by postings, the prefix-filtered set join, and streams with late rows, windows and upserts."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from lodegrid.functions.text import calls_in
from lodegrid.operators import aggregates, graph, sinks, taint
from lodegrid.operators.facts import enrich, state_vars
from lodegrid.rules.engine import functions, parse
from lodegrid.streaming import watch, windows


def edges_of(spark, pairs, t=1):
    return spark.createDataFrame([(t, *p) for p in pairs], "target_id long, src string, dst string")


def starts_of(spark, names, t=1):
    return spark.createDataFrame([(t, n) for n in names], "target_id long, node string")


CHAIN = [(f"n{i}", f"n{i + 1}") for i in range(12)]


def test_depth_first_misses_what_breadth_first_reaches(spark):
    # the long way, walked first, meets x at depth 8 and does not go on from there; the short way meets it at depth 1
    pairs = [("s", "x"), ("x", "y"), ("s", "z1")] + [(f"z{i}", f"z{i + 1}") for i in range(1, 7)] + [("z7", "x")]
    e, s = edges_of(spark, pairs), starts_of(spark, ["s"])
    broad = {r["node"] for r in graph.walks(s, e, 8).collect()}
    deep = {r["node"]: r["visit_no"] for r in graph.walks(s, e, 8, graph.walk_depth).collect()}
    assert broad == {"s", "x", "y"} | {f"z{i}" for i in range(1, 8)}
    assert set(deep) == broad - {"y"} and deep["s"] == 0 and deep["z1"] == 1 and deep["x"] == 8


def test_walks_equal_the_rounds(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(t, f"f{rng.randrange(12)}", f"f{rng.randrange(12)}") for t in range(6) for _ in range(25)]
    e = spark.createDataFrame([r for r in set(rows) if r[1] != r[2]], "target_id long, src string, dst string")
    s = spark.createDataFrame([(t, f"f{i}") for t in range(7) for i in range(0, 12, 3)], "target_id long, node string")
    run = lambda: ({tuple(r) for r in graph.reach(s, e, 3).collect()}, {(r[0], r[1], r[2], tuple(r[3])) for r in graph.shortest_paths(s, e, 3).collect()})
    packed = run()
    monkeypatch.setattr(graph, "SMALL_GRAPH", 20)
    assert run() == packed and len(packed[0]) > 50
    assert graph.reach(s, e.limit(0)).count() == s.count()


def test_walks_take_one_exchange(spark):
    plan = graph.walks(starts_of(spark, ["n0"]), edges_of(spark, CHAIN))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_calls_in():
    assert calls_in("{ a(b(x, y), z[i, j], (p, q)); c(); d(1; }") == [("b", ["x", "y"]), ("a", ["b(x, y)", "z[i, j]", "(p, q)"]), ("c", [])]
    assert calls_in(None) == [] and calls_in("f(" * 50 + "x" + ")" * 50)[0] == ("f", ["x"])


SOURCE = """
contract V {
  mapping(address => uint256) balances;
  mapping(bytes32 => bool) spent;
  function enter(address who, uint256 lot, bytes32 tag) external { step(tag, lot, who); }
  function step(bytes32 mark, uint256 sum, address dest) internal { spent[mark] = true; dest.call{value: sum}(""); }
  function swap(address other, uint256 n) external { step(n, other, n); }
  function look(uint256 n) external view returns (uint256) { return n; }
}
"""


def test_flows_of_a_contract(spark):
    p = parse(spark.createDataFrame([(1, "ethereum", "a.sol", 0, SOURCE)], "target_id long, chain string, path string, pos int, raw string"))
    fl = taint.flows(enrich(functions(p)), state_vars(p))
    got = {(r["entrypoint"], r["function"], r["source"], r["sink_kind"]): r["confidence"] for r in fl.collect() if r["entrypoint"] == "enter"}
    # an argument counts by its place: who is handed over as dest, lot as sum, tag as mark, which only the marker's statement holds
    assert got[("enter", "step", "who", "value_transfer")] == 0.75 and got[("enter", "step", "tag", "replay_marker")] == 0.75
    assert got[("enter", "step", "lot", "value_transfer")] == 0.75 and ("enter", "step", "tag", "value_transfer") not in got
    assert ("enter", "enter", "who", "value_transfer") not in got and {r["path"][0] for r in fl.collect()} == {"enter", "swap"}
    assert fl.where("entrypoint = 'look'").count() == 0


def test_written_statement_is_the_first_with_an_assignment_after_the_name(spark):
    fns = spark.createDataFrame([(1, "f", "{ read(total); uint256 total = 1; total += 2; other = total; x[i]++; }")], "target_id long, name string, body string")
    got = {r["var"]: r["text"] for r in taint.written(fns).collect()}
    assert got["total"] == "uint256 total = 1" and got["other"] == "other = total" and got["x"] == "x[i]++" and "read" not in got


def plain_overlaps(a, b, least):
    return {(i, j, len(set(x) & set(y))) for (i, x), (j, y) in itertools.product(a, b) if len(set(x) & set(y)) >= least}


@pytest.mark.parametrize("least", [1, 2, 3])
def test_overlaps_are_exact(spark, least):
    rng = random.Random(least)
    some = lambda n: [(i, rng.sample([f"w{k}" for k in range(30)], rng.randrange(0, 7)) + ["common", "usual"][: rng.randrange(3)]) for i in range(n)]
    a, b = some(80), some(40)
    df = lambda rows, k: spark.createDataFrame(rows, f"{k} long, tokens array<string>")
    got = {tuple(r) for r in aggregates.overlaps(df(a, "x"), df(b, "y"), "x", "y", least).collect()}
    assert got == plain_overlaps(a, b, least)


@pytest.mark.parametrize("most", [1000, 3])
def test_overlaps_of_common_tokens_and_repeated_keys(spark, monkeypatch, most):
    monkeypatch.setattr(aggregates, "COMMON_SETS", most)
    df = lambda rows, k: spark.createDataFrame(rows, f"{k} long, tokens array<string>")
    a = [(1, ["u", "v", "w"]), (1, ["u", "x", "y"]), (2, ["u", "v"]), (3, []), (4, None), (None, ["u", "v"]), *((10 + i, ["u", f"o{i}"]) for i in range(5))]
    b = [(7, ["u", "v", "x"]), (7, ["u", "y", "x"]), (8, ["v"]), (None, ["u", "v"]), *((20 + i, ["u", f"o{i}"]) for i in range(5))]
    got = sorted(tuple(r) for r in aggregates.overlaps(df(a, "x"), df(b, "y"), "x", "y").collect())
    assert got == sorted([(1, 7, 2), (1, 7, 2), (1, 7, 3), (2, 7, 2), *((10 + i, 20 + i, 2) for i in range(5))])


def test_overlaps_read_the_larger_side_once(spark):
    d = spark.range(50).selectExpr("id AS x", "split(concat('aa bb t', id), ' ') AS tokens")
    plan = aggregates.overlaps(d, d.withColumnRenamed("x", "y"), "x", "y")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_a_token_of_every_set_is_no_join_key(spark):
    rows = [(i, ["common", f"own{i}"]) for i in range(400)]
    df = spark.createDataFrame(rows, "x long, tokens array<string>")
    found = aggregates.overlaps(df, df.withColumnRenamed("x", "y"), "x", "y")
    assert {(r["x"], r["y"]) for r in found.collect()} == {(i, i) for i in range(400)}


T0 = dt.datetime(2024, 1, 1)
HEAD = "address string, ts timestamp, implementation string, codehash string, admin string, owner string"


def readings(n=60, seed=1):
    rng = random.Random(seed)
    val = lambda p: rng.choice([None, "", f"{p}1", f"{p}2", f"{p}1".upper()])
    return [(f"a{i % 3}", T0 + dt.timedelta(minutes=i), val("i"), val("c"), val("d"), val("o")) for i in range(n)]


def replay(spark, tmp_path, parts, delay=None):
    """The readings stored file by file, read one file a trigger, in two runs of one query."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, HEAD).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if k in (0, len(parts) - 1):  # the first run ends after one file; the second takes up its state
            src = spark.readStream.schema(HEAD).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
            q = watch.watch_stream(src, delay).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
            q.awaitTermination()
    return sorted(map(tuple, spark.read.schema(watch.EVENT).parquet(f"{tmp_path}/out").collect()), key=str)


def test_watch_takes_triggers_in_order_and_reports_late_readings(spark, tmp_path):
    rows = readings()
    first, second = rows[:30], rows[30:]
    random.Random(2).shuffle(first)
    random.Random(3).shuffle(second)
    late = ("a0", T0 + dt.timedelta(minutes=1), "i9", "c9", "d9", "o9")
    got = replay(spark, tmp_path, [first, second + [late]])
    want = sorted(map(tuple, watch.watch_batch(spark.createDataFrame(rows, HEAD)).select("address", "ts", "kind", "old", "new", "severity", "rescan").collect()), key=str)
    assert [e for e in got if e[2] != "late_reading"] == want and len(want) > 20
    assert [e for e in got if e[2] == "late_reading"] == [("a0", late[1], "late_reading", None, None, "info", False)]


def test_watch_puts_readings_in_order_across_triggers_behind_the_watermark(spark, tmp_path):
    rows = readings(48, 5)
    mixed = [rows[k] for b in range(0, 48, 16) for k in random.Random(b).sample(range(b, b + 16), 16)]
    parts = [mixed[:10], mixed[10:30], mixed[30:], [("z", T0 + dt.timedelta(days=1), "i", "c", "d", "o")]]
    got = replay(spark, tmp_path, parts, "2 hours")
    want = sorted(map(tuple, watch.watch_batch(spark.createDataFrame(rows, HEAD)).select("address", "ts", "kind", "old", "new", "severity", "rescan").collect()), key=str)
    assert got == want and len(want) > 10


def test_windows_close_with_the_watermark_and_take_late_rows(spark, tmp_path):
    rows = [("k", T0 + dt.timedelta(minutes=m), m) for m in (0, 5, 12, 3, 25, 8, 90)]  # 3 and 8 are late, within the delay
    for k in (rows[:3], rows[3:6], rows[6:]):
        spark.createDataFrame(k, "key string, ts timestamp, v int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("key string, ts timestamp, v int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    n = [F.count(F.lit(1)).alias("n")]
    tumbling = {(r["window_start"].minute, r["n"]) for r in windows.drained(windows.windowed(src, ["key"], n, "30 minutes", "10 minutes")).collect()}
    assert tumbling == {(0, 4), (10, 1), (20, 1)}
    got = [(r["session_start"].minute, r["session_end"].minute, r["n"]) for r in windows.drained(windows.sessions(src, ["key"], n, "30 minutes", "10 minutes")).collect()]
    assert sorted(got) == [(0, 22, 5), (25, 35, 1)]
    assert windows.drained(windows.first_seen(src, ["key"], "1 day")).count() == 1


def test_upserts_are_idempotent_and_leave_other_partitions(spark, tmp_path):
    merge = sinks.Upserts(f"{tmp_path}/t", ["k"], ["v"], "part")
    df = lambda rows: spark.createDataFrame(rows, "k long, v long, part int")
    merge(df([(1, 1, 0), (2, 1, 1), (2, 3, 1), (2, 2, 1)]), 0)
    files = lambda p: sorted(str(x) for x in (tmp_path / "t" / "rows" / f"part={p}").glob("*.parquet"))
    before = files(0), files(1)
    merge(df([(2, 9, 1), (3, 1, 1)]), 1)
    table = {(1, 1), (2, 9), (3, 1)}
    assert {(r["k"], r["v"]) for r in merge.read(spark).collect()} == table and files(0) == before[0] and files(1) != before[1]
    after = files(1)
    merge(df([(2, 9, 1), (3, 1, 1)]), 1)  # the same trigger once more
    assert files(1) == after
    merge(df([(2, 5, 1), (1, 0, 0)]), 2)  # older rows
    assert {(r["k"], r["v"]) for r in merge.read(spark).collect()} == table


def test_state_variables_read_a_file_once(spark):
    src = "/* " + "a comment\n" * 200 + "*/\ncontract C {\n  mapping(address =>  uint) public bal;\n\n\t uint256   public\n constant  cap = 1;\n  address payable owner;\r\n  event E(uint a);\n  string internal s;\n function f() public { uint y = 1; { uint z = 2; } }\n}"
    files = spark.createDataFrame([(1, "c", "a.sol", 0, src), (1, "c", "b.sol", 1, "bool s;\nbool t;"), (2, "c", "e.sol", 0, ""), (3, "c", "n.sol", 0, None)], "target_id long, chain string, path string, pos int, raw string")
    d = state_vars(parse(files))
    got = {(r["target_id"], r["name"]): (r["path"], r["type"], r["attrs"], r["key_type"], r["grp"], r["decl_pos"]) for r in d.collect()}
    assert got[1, "bal"] == ("a.sol", "mapping", ["public"], "address", 0, 0)
    assert got[1, "cap"] == ("a.sol", "uint256", ["public", "constant"], None, 1, 0)
    assert got[1, "owner"] == ("a.sol", "address payable", [], None, 1, 1)
    assert got[1, "s"][:3] == ("a.sol", "string", ["internal"]) and got[1, "t"][:2] == ("b.sol", "bool")
    assert {k for k, _ in got} == {1}
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("contract_level(") == 1 and plan.count("regexp_extract_all(") == 2


def test_texts_are_dealt_to_as_many_tasks_as_a_shuffle_has(spark, tmp_path):
    from lodegrid.plans.corpus import contract_files

    spark.createDataFrame([(i, "t") for i in range(40)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.lodegrid.spread.tasks", None)
    spark.conf.unset("spark.lodegrid.spread.tasks")
    try:
        files = contract_files(spark, str(tmp_path))
        assert files.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions")) and files.count() == 40
    finally:
        if before is not None:
            spark.conf.set("spark.lodegrid.spread.tasks", before)


def test_a_body_is_searched_once_for_its_calls(spark):
    from lodegrid.operators.facts import CALL_TARGET

    body = "{ a.b(c)[1].call{value: msg.value, gas: 2}(x, y); t . transfer ( to,  1 ); _mint(u, 1); q.safeTransferFrom(p, r, n); z.call{gas: 1}(); }"
    f = spark.createDataFrame([(1, "e", "p", 0, 0, 1, "f", "uint x", "public", body), (1, "e", "p", 0, 0, 1, "g", "", "", None)],
                              "target_id long, chain string, path string, pos int, start int, line int, name string, params string, tail string, body string")
    d = enrich(f)
    searches = d._jdf.queryExecution().analyzed().toString().split("regexp_extract_all(body#")[1:]
    assert sum(f", (?s)({CALL_TARGET})" in x[:40 + len(CALL_TARGET)] for x in searches) == 1
    got = {r["name"]: r for r in d.select("name", "external_calls", "mints").collect()}
    assert [tuple(c) for c in got["f"]["external_calls"]] == [
        ("a.b(c)[1]", "call", "x, y", "msg.value"), ("t", "transfer", "to, 1", ""), ("q", "safeTransferFrom", "p, r, n", ""), ("z", "call", "", "")]
    assert [tuple(c) for c in got["f"]["mints"]] == [("self", "_mint", "u, 1", "")]
    assert got["g"]["external_calls"] is None and got["g"]["mints"] is None
