"""The literal gate loses no hit, and says no to most rules on most functions."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodegrid.plans.corpus import contract_files
from lodegrid.plans.snippets import TWINS
from lodegrid.rules.catalog import rules_for
from lodegrid.rules.dsl import body, count_true, in_file, name, tail
from lodegrid.rules.engine import evaluate, parse, target_flags
from lodegrid.rules.prefilter import Gate, automaton, either, literals, pack, with_matches

SF = "/root/testdata/sf0.001"
COLS = ["target_id", "file", "start", "detector", "variant", "function", "impact", "conf", "variable"]


def clauses(*groups):
    return tuple(frozenset(g) for g in groups)


@pytest.mark.parametrize("pattern, want", [
    ("transfer", clauses(["transfer"])),
    (r"Deposit\s*\(\s*Amount", clauses(["deposit"], ["amount"])),
    (r"(?:mint|burn)From", clauses(["mint", "burn"], ["from"])),
    (r"(?:lock)?Owner(?:able)*", clauses(["owner"])),
    (r"swap|\w+", ()),
    (r"swap|id", ()),
    (r"(?!never)call", clauses(["call"])),
    (r"(?<=pre)call", clauses(["pre"], ["call"])),
    (r"two words", clauses(["two"], ["words"])),
    (r"a|b", ()),
    ("", ()),
    (r"\p{Lu}ong", ()),
    (r"(?:abc){0,2}", ()),
    (r"(?:abc){2}", clauses(["abc"])),
])
def test_literals_of_patterns(pattern, want):
    assert set(literals(pattern)) == set(want)


def test_needs_follow_the_logic():
    a, b = body.has("alpha"), tail.has("beta")
    assert (a & b).needs == clauses(["alpha"], ["beta"])
    assert (a | b).needs == clauses(["alpha", "beta"])
    assert (~a).needs == () and (a | ~b).needs == ()
    assert (a & in_file("gamma")).needs == clauses(["alpha"])
    assert (count_true(a, b) >= 1).needs == clauses(["alpha", "beta"])
    assert (count_true(a, b) < 1).needs == () and (count_true(a, ~b) >= 1).needs == ()
    assert (name + " " + body).has("gamma").needs == clauses(["gamma"])
    assert (name + body).has("gamma").needs == () and (name + "x" + body).has("gamma").needs == ()
    assert body.all(r"key\[(\w+)\]").any(lambda x: x.has("user")).needs == clauses(["key["], ["user"])
    assert body.all(r"key\[(\w+)\]").every(lambda x: x.has("user")).needs == ()
    assert body.extract(r"leaf\((.*)\)").has("^$").needs == ()
    assert either() == () and either(clauses(["ab", "abcd"], ["xyz"]), clauses(["q" * 9])) == clauses(["xyz", "q" * 9])


PATTERNS = sorted({p for p in (r"mint|burn(?:From)?", r"(?:safe)?Transfer(?:From|To)", r"require\s*\([^;]*owner", r"\b(public|external)\b", r"x\s*=\s*(abc|abd|xyz)+;")})
WORDS = st.lists(st.sampled_from(["mint", "burnFrom", "safe", "Transfer", "From", "To", "require", "(", " ", "owner", "PUBLIC", "external", "x", "=", "abc", "abd", ";", "K", "İ", "m", "int"]), max_size=12)


@settings(max_examples=300, deadline=None)
@given(WORDS, st.sampled_from(PATTERNS))
def test_a_match_has_its_literals(words, pattern):
    text = "".join(words)
    if re.search("(?i)" + pattern, text, re.A):
        assert all(any(w in text.lower() for w in c) for c in literals(pattern))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sets(st.sampled_from(["abc", "bcd", "cde", "abcde", "xyz"]), min_size=1).map(frozenset), max_size=3).map(tuple), min_size=1, max_size=130),
       st.text("abcdexyz", max_size=20))
def test_bits_by_brute_force(needs, text):
    gate = Gate(dict(enumerate(needs)))
    met = 0
    if gate.words:
        for _, m in automaton(gate.words)(text):
            met |= m
    bits = pack(met, gate.masks)
    for r, n in enumerate(needs):
        if n:
            word, bit = gate.place[r]
            assert bool(bits[word] >> bit & 1) == all(any(w in text for w in c) for c in n)
        else:
            assert gate.test(r) == ""


def rows(d):
    return sorted(map(str, d.select(*COLS).collect()))


def test_gate_loses_no_hit(spark):
    rules = rules_for("ultra-deep-v2")
    texts = [t for pair in TWINS.values() for t in pair] + ["", "function f( {", "function G(address K) external { K.call(\"\"); }"]
    upper = [re.sub(r"\b(mint|burn|owner|transfer|deposit|withdraw|claim|nonce)\b", lambda m: m.group().upper(), t) for t in texts]
    files = spark.createDataFrame([(i, "ethereum", "a.sol", 0, t) for i, t in enumerate([*texts, *upper])] + [(9999, None, None, 0, None)],
                                  "target_id long, chain string, path string, pos int, raw string").repartition(16)
    parsed = parse(files).cache()
    got, want = rows(evaluate(files, rules, parsed)), rows(evaluate(files, rules, parsed, gated=False))
    assert got == want and len(got) > 200
    assert evaluate(files.limit(0), rules).isEmpty()


def test_gates_are_one_python_step_each_and_tell_most(spark):
    rules = rules_for("ultra-deep-v2")
    files = contract_files(spark, SF)
    plan = evaluate(files, [r for r in rules if r.grain == "fn" and r.target is None and not r.custom_guard])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("+- ArrowEvalPython") + plan.count("+- BatchEvalPython") == 3
    few = evaluate(files, rules_for("deep", only="access_control"))._jdf.queryExecution().optimizedPlan().toString()
    assert "fn_can" not in few and "file_can" not in few
    needs = {i: r.when.needs for i, r in enumerate(rules) if r.grain == "fn"}
    gate = Gate(needs)
    fns = parse(files).select(F.explode("fns").alias("f")).select(F.concat_ws("\n", "f.name", "f.params", "f.tail", "f.body").alias("t"))
    bits = fns.select(gate.column(F.col("t")).alias("b")).select(F.expr("aggregate(b, 0, (s, x) -> s + bit_count(x))").alias("n"))
    assert bits.agg(F.avg("n")).first()[0] < len(needs) / 4
    assert sum(not n for n in needs.values()) <= 5


def test_a_branch_needs_all_its_words():
    assert set(literals(r"knownRoot|require\s*\([^;]*root")) == {frozenset(["knownroot", "require"]), frozenset(["knownroot", "root"])}


def test_target_flags_are_gated_and_the_same(spark):
    rules = [r for r in rules_for("ultra-deep-v2") if r.target is not None or r.grain == "target"]
    nodes = [n for r in rules for n in (r.target, r.when if r.grain == "target" else None) if n is not None]
    texts = [t for pair in TWINS.values() for t in pair] + ["", None, "/* bridge */ contract A { // groth16 verifyProof(\n }", "VERIFY/**/PROOF multiCall", "block.chainId == 1"]
    files = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "target_id long, raw string")
    d = target_flags(files, nodes)
    assert "target_can" in d._jdf.queryExecution().analyzed().toString()
    rows_of = lambda x: sorted(map(str, x.collect()))
    assert rows_of(d) == rows_of(target_flags(files, nodes, gated=False))


def test_matches_are_those_of_the_patterns(spark):
    patterns = {"a": r"(?i)\b(quorum|ballot)\b", "b": r"mint\s*\(|burn\s*\(", "c": r"x|yz"}
    texts = ["Quorum mint (", "burnt", "xburn(", "", None, "ballots", "yz BALLOT"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, raw string")
    want = d.select("*", *[F.col("raw").rlike(p).alias(k) for k, p in patterns.items()])
    assert sorted(map(str, with_matches(d, "raw", **patterns).collect())) == sorted(map(str, want.collect()))
