"""Source-to-sink flows over the call graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .facts import accesses, call_edges, last_definitions
from ..session import cut
from .graph import shortest_paths

# ---- Fixed values: name classes ---------------------------------------------------------
VALUE_NAME = (r"(?i)recipient|receiver|to|dst|amount|value|token|asset|share|shares|root|proof|proofData|payload|message|nonce|index|fee|relayer")
REPLAY_VAR = r"(?i)processed|consumed|spent|nullifier|claimed|used"
ACCOUNT_VAR = r"(?i)debt|collateral|reward|share|shares|balance|balances|supply|reserve|checkpoint|index|acc"
UPGRADE_CALL = r"(?i)upgradeTo|upgradeToAndCall|setImplementation|setBeacon|diamondCut|setFacet|implementation"
ORACLE_READ = r"(?i)latestRoundData\s*\(|getReserves\s*\(|slot0\s*\(|balanceOf\s*\(\s*address\s*\(\s*this\s*\)"
PROOF_NAME = r"(?i)proof|payload|message|data|pubdata|root|nonce|signature|sig"
# -----------------------------------------------------------------------------------------


def sources(fns: DataFrame) -> DataFrame:
    """(target_id, entry, kind, name) of every entrypoint."""
    lit = lambda k, n, c: F.when(c, F.array(F.struct(F.lit(k).alias("kind"), F.lit(n).alias("name")))).otherwise(
        F.array().cast("array<struct<kind:string,name:string>>"))
    names = F.array_distinct(F.concat("param_names", "decoded"))
    call = F.transform(names, lambda n: F.struct(F.lit("calldata").alias("kind"), n.alias("name")))
    proof = F.transform(F.filter(names, lambda n: n.rlike(PROOF_NAME)), lambda n: F.struct(F.lit("proof_data").alias("kind"), n.alias("name")))
    b = F.col("body")
    extra = [lit("msg_sender", "msg.sender", b.contains("msg.sender")), lit("msg_sender", "_msgSender()", b.contains("_msgSender")),
             lit("msg_value", "msg.value", b.contains("msg.value")), lit("msg_sender", "tx.origin", b.contains("tx.origin")),
             lit("calldata", "abi.decode", b.contains("abi.decode")), lit("oracle", "oracle_read", b.rlike(ORACLE_READ))]
    return fns.where("entrypoint").select("target_id", F.col("name").alias("entry"), F.explode(F.concat(call, proof, *extra)).alias("s")).select(
        "target_id", "entry", "s.kind", "s.name")


#: Sources that are no identifiers; they match as parts of a text.
PLACES = ("msg.sender", "_msgSender()", "msg.value", "tx.origin")
IDENT = r"\b([A-Za-z_]\w*)\b"


def words(text: Column) -> Column:
    """What a source's name can match in a text: its identifiers, and the places it names."""
    ids = F.regexp_extract_all(text, F.lit(IDENT), F.lit(1))
    return F.array_distinct(F.concat(ids, F.array_compact(F.array(*[F.when(F.contains(text, F.lit(p)), p) for p in PLACES]))))


def written(fns: DataFrame) -> DataFrame:
    """(target_id, fn, var, text): the first statement of a body in which a name stands before an assignment, by name.

    The names before a statement's last operator are extracted once, so a written variable finds its statement by equality.
    """
    stmts = F.regexp_extract_all("body", F.lit(r"([^;{}]+)"), F.lit(1))
    d = fns.select("target_id", F.col("name").alias("fn"), F.posexplode(stmts).alias("no", "stmt"))
    before = F.regexp_extract("stmt", r"(?s)^(.*)(?:=|\+\+|--)", 1)
    d = d.select("target_id", "fn", "no", "stmt", F.explode(F.array_distinct(F.regexp_extract_all(before, F.lit(IDENT), F.lit(1)))).alias("var"))
    first = d.groupBy("target_id", "fn", "var").agg(F.min_by("stmt", "no").alias("stmt"))
    return first.select("target_id", "fn", "var", F.left(F.trim(F.regexp_replace("stmt", r"\s+", " ")), F.lit(500)).alias("text"))


def sinks(fns: DataFrame, edges: DataFrame, acc: DataFrame) -> DataFrame:
    """(target_id, fn, sink_kind, label, text) of value sinks, low-level calls, upgrades and marked writes."""
    text = lambda x: F.concat_ws(" ", x["target"], x["kind"], x["args"], x["value"], x["args"])
    st = lambda k, lab, t: F.struct(k.alias("sink_kind"), lab.alias("label"), t.alias("text"))
    vs = F.transform("value_sinks", lambda x: st(F.lit("value_transfer"), x["kind"], text(x)))
    ll = F.transform(F.filter("external_calls", lambda x: x["kind"].isin("delegatecall", "call")),
                     lambda x: st(F.when(x["kind"] == "call", "low_level_call").otherwise("delegatecall"), x["kind"], text(x)))
    direct = fns.select("target_id", F.col("name").alias("fn"), F.explode(F.concat(vs, ll)).alias("k")).select("target_id", "fn", "k.*")
    up = edges.where(F.col("dst").rlike(UPGRADE_CALL)).select("target_id", F.col("src").alias("fn"), F.lit("upgrade").alias("sink_kind"),
                                                               F.col("dst").alias("label"), F.col("dst").alias("text"))
    kinds = F.array_compact(F.array(F.when(F.col("var").rlike(REPLAY_VAR), "replay_marker"), F.when(F.col("var").rlike(ACCOUNT_VAR), "accounting_write")))
    w = acc.where("writes").select("target_id", F.col("name").alias("fn"), "var").distinct().join(written(fns), ["target_id", "fn", "var"], "left")
    marked = w.select("target_id", "fn", F.explode(kinds).alias("sink_kind"), F.concat(F.lit("write:"), "var").alias("label"), F.coalesce("text", "var").alias("text"))
    return direct.unionByName(up).unionByName(marked)


def flows(fns: DataFrame, svars: DataFrame, max_depth: int = 8) -> DataFrame:
    """Flows (entry, fn, source kind/name, sink, confidence, path), best confidence per source and sink.

    Names meet texts by equality: identifiers of sink texts and of call arguments are extracted once as postings (target, function,
    word), and sources join them on the word. No pattern is built from a name.
    """
    fns = cut(last_definitions(fns))  # the function table is read by seven branches below: parse once
    edges = cut(call_edges(fns))
    acc = accesses(fns, svars)
    starts = fns.where("entrypoint").select("target_id", F.col("name").alias("node"))
    paths = cut(shortest_paths(starts, edges, max_depth).select("target_id", F.col("start").alias("entry"), F.col("node").alias("fn"), "path"))
    pairs = paths.select("target_id", "entry", "fn")
    sk = sinks(fns, edges, acc).distinct().withColumns({"words": words(F.col("text")), "valuey": F.col("text").rlike(VALUE_NAME)})
    sk = cut(sk.withColumn("sink_no", F.xxhash64("sink_kind", "label", "text")))
    src = sources(fns).where(F.col("name") != "")
    cols = ["target_id", "entry", "fn", "sink_no", "kind", "name"]
    found = lambda df, conf: df.select(*cols, F.lit(conf).alias("confidence"))

    reaching = src.join(pairs, ["target_id", "entry"])  # (target_id, entry, kind, name, fn)
    postings = sk.select("target_id", "fn", "sink_no", F.explode("words").alias("name"))
    direct = found(reaching.join(postings, ["target_id", "fn", "name"]), 0.9)

    # what the entry hands to the sink function: the words of each argument and its place
    calls = fns.select("target_id", F.col("name").alias("entry"), F.explode("calls").alias("c")).select("target_id", "entry", F.col("c.callee").alias("fn"), F.posexplode("c.args").alias("place", "arg"))
    given = calls.where("entry != fn").select("target_id", "entry", "fn", "place", F.explode(words(F.col("arg"))).alias("name")).distinct()
    passed = src.join(given, ["target_id", "entry", "name"]).join(pairs, ["target_id", "entry", "fn"], "left_semi")
    helper_params = fns.select("target_id", F.col("name").alias("fn"), "param_names")
    passed = passed.join(helper_params, ["target_id", "fn"]).join(sk.select("target_id", "fn", "sink_no", "words", "valuey"), ["target_id", "fn"])
    passed = passed.where(F.col("valuey") | F.coalesce(F.array_contains("words", F.get("param_names", F.col("place"))), F.lit(False)))

    called = sk.where(F.col("sink_kind").isin("delegatecall", "low_level_call", "upgrade") & F.col("valuey")).select("target_id", "fn", "sink_no")
    control = reaching.where("kind = 'calldata'").join(called, ["target_id", "fn"])
    priced = sk.where(F.col("sink_kind").isin("value_transfer", "accounting_write")).select("target_id", "fn", "sink_no")
    oracle = reaching.where("kind = 'oracle'").join(priced, ["target_id", "fn"])

    moved = sk.where(F.col("sink_kind").isin("value_transfer", "accounting_write", "replay_marker"))
    dec = fns.select("target_id", F.col("name").alias("fn"), F.explode("decoded").alias("name")).join(moved, ["target_id", "fn"])
    dec = dec.where(F.array_contains("words", F.col("name")) | F.col("name").rlike(VALUE_NAME)).join(pairs, ["target_id", "fn"]).withColumn("kind", F.lit("calldata"))
    helper = moved.where("valuey").join(pairs.where("entry != fn"), ["target_id", "fn"]).withColumns({"kind": F.lit("calldata"), "name": F.lit("cross_function_args")})

    every = direct
    for one in (found(control, 0.8), found(dec, 0.8), found(passed, 0.75), found(oracle, 0.55), found(helper, 0.45)):
        every = every.unionByName(one)
    best = every.groupBy(*cols).agg(F.max("confidence").alias("confidence"))
    best = best.join(sk.select("target_id", "fn", "sink_no", "sink_kind", "label", "text"), ["target_id", "fn", "sink_no"])
    return best.join(paths, ["target_id", "entry", "fn"]).select(
        "target_id", F.col("entry").alias("entrypoint"), F.col("fn").alias("function"), F.col("kind").alias("source_kind"), F.col("name").alias("source"),
        "sink_kind", F.col("label").alias("sink"), F.col("text").alias("sink_text"), "confidence", "path",
        (F.col("entry") != F.col("fn")).alias("cross_function"))


def summary(fl: DataFrame) -> DataFrame:
    """Counts by sink kind, by source kind and overall, in one pass (grouping sets)."""
    g = fl.groupingSets([["target_id", "sink_kind"], ["target_id", "source_kind"], ["target_id"]], "target_id", "sink_kind", "source_kind")
    return g.agg(F.count(F.lit(1)).alias("flows"), F.count_if(F.col("confidence") >= 0.75).alias("high_confidence"),
                 F.count_if("cross_function").alias("cross_function"))
