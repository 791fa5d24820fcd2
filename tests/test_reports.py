"""Ranks, lines of hits, bundles, archives, artefact rows and merged graphs on small fixtures."""

import os
import random
import zipfile
from io import BytesIO

import pytest
from pyspark.sql import functions as F

from lodegrid.operators import bundle, places, protocol, sinks
from lodegrid.operators.ordering import ranked
from lodegrid.sources import layouts


def test_ranks_equal_a_sort(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([None, 1, 2, 3]), rnd.choice("ab")) for i in range(3000)]
    d = spark.createDataFrame(rows, "id long, score int, kind string").repartition(7)
    got = [r["id"] for r in ranked(d, F.desc("score"), "kind", "id").orderBy("rank_no").collect()]
    assert got == [r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))]
    assert [r["rank_no"] for r in ranked(d, "id").orderBy("id").select("rank_no").collect()] == list(range(1, 3001))


def test_ranks_of_ties_and_of_nothing(spark):
    d = spark.range(500).select(F.lit(1).alias("k"))
    assert sorted(r["rank_no"] for r in ranked(d, "k").collect()) == list(range(1, 501))
    e = ranked(d.where("k > 1"), "k")
    assert e.columns == ["k", "rank_no"] and e.count() == 0


def test_ranks_need_no_task_with_all_rows(spark):
    plan = ranked(spark.range(1000), F.desc("id"))._jdf.queryExecution().executedPlan().toString()
    # the one window without a partition counts tasks, after the aggregate by task
    assert plan.count("Window") <= 2 and "__task" in plan


@pytest.mark.parametrize("seed", range(30))
def test_places_equal_counting(seed):
    rnd = random.Random(seed)
    text = "".join(rnd.choice("ab\n") for _ in range(rnd.randint(0, 60)))
    offsets = [rnd.randint(0, len(text)) for _ in range(9)]
    lines = text.split("\n")
    lines = lines[:-1] if lines[-1] == "" else lines
    for p in places.places_in(text, offsets):
        ln = text.count("\n", 0, p["start"])
        assert p["line"] == ln + 1
        assert p["window"] == "\n".join(lines[max(0, ln - 1) : ln + 8])


def test_lines_of_hits(spark):
    files = spark.createDataFrame([(1, "a.sol", "one\ntwo\nthree\n"), (1, "b.sol", ""), (2, "a.sol", None)], "target_id long, path string, raw string")
    hits = spark.createDataFrame([(1, "a.sol", 4, "x"), (1, "a.sol", 4, "y"), (1, "a.sol", None, "n"), (1, "a.sol", 99, "far"), (1, "b.sol", 0, "e"), (2, "a.sol", 3, "z"), (3, "a.sol", 0, "w")],
                                 "target_id long, path string, start long, tag string")
    got = {r["tag"]: (r["line"], r["window"]) for r in places.with_lines(hits, files).collect()}
    assert got == {"x": (2, "one\ntwo\nthree"), "y": (2, "one\ntwo\nthree"), "n": (None, None), "far": (4, "three"), "e": (1, ""), "z": (1, ""), "w": (None, None)}


def test_bundle_reads_back_and_the_last_one_counts(spark, tmp_path):
    path = str(tmp_path / "b")
    first = bundle.write_bundle({"nodes": spark.range(10), "edges": spark.range(3).selectExpr("id AS src", "id + 1 AS dst")}, path)
    assert {n: d.count() for n, d in bundle.read_bundle(spark, path).items()} == {"nodes": 10, "edges": 3}
    bundle.write_bundle({"nodes": spark.range(4)}, path)
    assert {n: d.count() for n, d in bundle.read_bundle(spark, path).items()} == {"nodes": 4}
    assert {n: d.count() for n, d in bundle.read_bundle(spark, path, first).items()} == {"nodes": 10, "edges": 3}
    assert sorted((r["part"], r["n_rows"]) for r in bundle.manifest(spark, path).collect()) == [("edges", 3), ("nodes", 4), ("nodes", 10)]


def test_failed_bundle_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "b")
    kept = bundle.write_bundle({"nodes": spark.range(10)}, path)
    with pytest.raises(Exception):  # noqa: B017 - whatever the failed task raises
        bundle.write_bundle({"nodes": spark.range(5), "edges": spark.range(3).selectExpr("raise_error('lost') AS x")}, path)
    assert os.listdir(tmp_path / "b" / "parts") == [kept]
    assert bundle.read_bundle(spark, path)["nodes"].count() == 10
    with pytest.raises(ValueError):
        bundle.read_bundle(spark, path, "unknown")
    with pytest.raises(ValueError):
        bundle.write_bundle({}, path)


def test_archives_hold_every_line_in_order(spark):
    rows = [(1, "a.txt", None, i, f"line {i}") for i in range(25)] + [(1, "b.txt", None, 0, None), (2, "a.txt", 5, 1, "later"), (2, "a.txt", 4, 9, "ü first")]
    d = spark.createDataFrame(rows, "scan_id long, entry string, section long, line_no long, line string").repartition(5)
    got = sorted(bundle.archives(d, 10).collect(), key=lambda r: (r["scan_id"], r["volume"]))
    assert [(r["scan_id"], r["volume"], r["n_entries"], r["n_rows"]) for r in got] == [(1, 0, 1, 10), (1, 1, 1, 10), (1, 2, 2, 6), (2, 0, 1, 2)]
    names, texts = [], {}
    for r in got:
        z = zipfile.ZipFile(BytesIO(r["archive"]))
        assert z.testzip() is None
        for n in z.namelist():
            names.append((r["scan_id"], n))
            texts[r["scan_id"], n.split(".txt")[0]] = texts.get((r["scan_id"], n.split(".txt")[0]), "") + z.read(n).decode()
    assert names == [(1, "a.txt"), (1, "a.txt.1"), (1, "a.txt.2"), (1, "b.txt"), (2, "a.txt")]
    assert texts == {(1, "a"): "".join(f"line {i}\n" for i in range(25)), (1, "b"): "\n", (2, "a"): "ü first\nlater\n"}
    assert bundle.archives(d.where("scan_id = 9"), 10).count() == 0


def test_archives_pass_lines_on_without_a_frame_a_volume(spark):
    rows = [(1, "big", None, i, "x" * 150) for i in range(7)] + [(1, f"e{i}", None, 0, "short") for i in range(5)] + [(1, None, None, 0, "lost"), (None, "e", None, 0, "lost")]
    d = spark.createDataFrame(rows, "scan_id long, entry string, section long, line_no long, line string").repartition(3)
    a = bundle.archives(d, 3)
    plan = a._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "MapInArrow" in plan
    got = {r["volume"]: r for r in a.collect()}
    zips = {v: zipfile.ZipFile(BytesIO(r["archive"])) for v, r in got.items()}
    assert {v: z.namelist() for v, z in zips.items()} == {0: ["big"], 1: ["big.1"], 2: ["big.2", "e0"], 3: ["e1", "e2", "e3"], 4: ["e4"]}
    assert [got[v]["n_rows"] for v in range(5)] == [2, 3, 3, 3, 1] and [got[v]["n_entries"] for v in range(5)] == [1, 1, 2, 3, 1]
    assert zips[1].infolist()[0].compress_type == zipfile.ZIP_DEFLATED and zips[4].read("e4") == b"short\n"


def test_archives_send_a_line_once(spark):
    rows = [(i % 4, f"e{i % 7}", None, i, f"line {i}") for i in range(300)] + [(1, None, None, 0, "lost"), (1, None, None, 1, "lost"), (None, "e", None, 0, "lost")]
    d = spark.createDataFrame(rows, "scan_id long, entry string, section long, line_no long, line string").repartition(3)
    plan = bundle.archives(d, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and sum("Repartition" in x and "[scan_id" in x for x in plan.split("\n")) == 1


def test_archives_of_large_scans_are_the_same(spark, monkeypatch):
    rows = [(i % 4 % 3, f"e{i % 7}", i % 2, i, None if i % 50 == 0 else f"line {i}") for i in range(300)] + [(1, None, None, 0, "lost"), (1, None, None, 1, "lost"), (None, "e", None, 0, "lost")]
    d = spark.createDataFrame(rows, "scan_id long, entry string, section long, line_no long, line string").repartition(3)
    want = sorted(map(tuple, bundle._archives_by_rank(d, 10).collect()))
    assert sorted(map(tuple, bundle.archives(d, 10).collect())) == want and len(want) == 31
    monkeypatch.setattr(bundle, "LARGE_SCAN", 100)  # scan 0 is larger
    assert sorted(map(tuple, bundle.archives(d, 10).collect())) == want


def test_export_entries(spark):
    d = spark.createDataFrame(
        [(7, 1, 70, "0xA", "Vault", "reentrancy", 'a "b", c', "high", "CONFIRMED_CRITICAL", 8.5, 7.5, "open", ["t1"], "why", "text"),
         (7, 2, 71, "0xB", None, "token_logic", "plain", "low", "LOW_OR_INFO", 2.0, 1.0, "open", None, None, "")],
        "scan_id long, id long, target_id long, address string, contract_name string, detector string, title string, severity_candidate string, classification string, "
        "impact_score double, confidence_score double, status string, next_tests array<string>, ai_rationale string, description string")
    ev = spark.createDataFrame([(7, 70, "n.json", "{}")], "scan_id long, target_id long, name string, body string")
    scans = spark.createDataFrame([(7,), (8,)], "id long")
    got = bundle.export_entries(d, ev, scans).orderBy("scan_id", "entry", "section", "line_no").collect()
    by = {}
    for r in got:
        by.setdefault((r["scan_id"], r["entry"]), []).append(r["line"])
    assert by[7, "findings.csv"] == ["address,detector,title,impact,confidence,classification,status,next_test", '0xA,reentrancy,"a ""b"", c",8,8,CONFIRMED_CRITICAL,open,t1', "0xB,token_logic,plain,2,1,LOW_OR_INFO,open,"]
    assert len(by[7, "summary.json"]) == 2 and by[7, "evidence/70/n.json"] == ["{}"]
    assert by[7, "report.md"][0] == "## Target `0xA` (Vault)" and len(by[7, "report.md"]) == 2
    assert by[8, "report.md"] == [sinks.NOTHING]


def test_large_artefacts_are_listed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(layouts, "MAX_BYTES", 40)
    out = tmp_path / "out"
    out.mkdir()
    (out / "A.json").write_text('{"contractName": "A"}')
    (out / "B.json").write_text('{"contractName": "' + "B" * 60 + '"}')
    (tmp_path / "other.json").write_text("{}")
    got = {os.path.basename(r["artifact"]): (r["body"], r["skipped"]) for r in layouts.read_artifacts(spark, f"file://{tmp_path}").collect()}
    assert got == {"A.json": ('{"contractName": "A"}', None), "B.json": (None, "over 40 bytes")}


def test_merged_graph(spark):
    t = spark.createDataFrame([(1, 9, "0xAA"), (2, 9, "0xbb"), (3, 8, "0xcc")], "target_id long, scan_id long, address string")
    n = spark.createDataFrame(
        [(1, "target", "A", "target", "0xAA", "scan_target", 1.0), (1, "state:o", "o", "oracle", "0xFE", "state_var", 0.5), (1, "state:u", "u", "asset", None, "state_var", 0.5),
         (2, "target", "B", "target", "0xbb", "scan_target", 1.0), (2, "abi:o", "feed", "oracle", "0xfe", "abi_getter", 0.9), (2, "state:u", "u", "asset", None, "state_var", 0.5),
         (2, "state:a", "peer", "router", "0xaa", "state_var", 0.4), (3, "target", "C", "target", "0xcc", "scan_target", 1.0), (3, "state:o", "o3", "oracle", "0xfe", "state_var", 0.1)],
        "target_id long, id string, label string, role string, address string, source string, confidence double")
    e = spark.createDataFrame([(1, "target", "state:o", "uses", None, None), (2, "target", "abi:o", "uses", None, None), (2, "target", "state:a", "calls", "f", "m"), (2, "target", "gone", "x", None, None)],
                              "target_id long, src string, dst string, kind string, function string, method string")
    nodes, edges, seen = protocol.merge_graphs(n, e, t)
    got = {(r["scan_id"], r["node"]): (r["label"], r["role"], r["targets"], r["in_scan"]) for r in nodes.collect()}
    assert got == {(9, "0xaa"): ("A", "target", 2, True), (9, "0xbb"): ("B", "target", 1, True), (9, "0xfe"): ("o", "oracle", 2, False), (9, "0xaa:asset:u"): ("u", "asset", 1, False),
                   (9, "0xbb:asset:u"): ("u", "asset", 1, False), (8, "0xcc"): ("C", "target", 1, True), (8, "0xfe"): ("o3", "oracle", 1, False)}
    assert {(r["scan_id"], r["src_node"], r["dst_node"], r["kind"], r["targets"]) for r in edges.collect()} == {(9, "0xaa", "0xfe", "uses", 1), (9, "0xbb", "0xfe", "uses", 1), (9, "0xbb", "0xaa", "calls", 1)}
    assert seen.count() == 9
