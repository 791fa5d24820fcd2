"""The offline scan: sources -> rules -> passes -> report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import body_key
from ..operators import bytecode, dedup, gates, protocol, scoring
from ..operators.facts import accesses, call_edges, enrich, state_vars
from ..operators.taint import flows as taint_flows
from ..rules import graph_rules as gr
from ..rules.catalog import detectors, rules_for
from ..rules.engine import evaluate, functions, parse
from ..session import cut
from ..sources import chain as chain_reads

NONE = {"pattern_class": "string", "value_state": "string", "value_signal": "string", "reference_state": "string", "destination_control": "string",
        "suppressed_reason": "string", "corroborated_by": "array<string>"}


def to_candidates(hits: DataFrame) -> DataFrame:
    """Catalog hits in the candidate layout; the position sorts by file, offset and rule."""
    return hits.select(
        "target_id", F.struct("pos", "start", "rule_no", "variable").alias("pos"), "detector", "title",
        F.lit("").alias("description"), "impact", "conf", "rule_id", "bug_class", "file", "line", "snippet", "body_key", "tier", "lead_only", "ev_flags",
        F.when(F.col("function").isNotNull(), F.array("function")).otherwise(F.array().cast("array<string>")).alias("functions"),
        F.lit(None).cast("string").alias("function"), F.lit(False).alias("suppressed"), F.lit(False).alias("tool_agree"),
        *[F.lit(None).cast(t).alias(c) for c, t in NONE.items()])


LEADS = ("pausability_bypass", "weird_hunt_taint_value_flow", "zk_verifier")
#: Characters at the head of a target's first file in which words of a dependent contract are looked for.
DEPENDENT_HEAD = 8000
#: Rules outside the catalog in the order of their hits; a hit's rule number is its place here.
SPECIAL = ("reentrancy", "solvency_check", "flashloan_governance", "delegatecall", "zk_verifier", "pausability_bypass", "weird_hunt_taint_value_flow",
           "economic_oracle_lending", "governance_blast_radius", "timelock_roles", "bytecode_periphery")


def special_hits(files: DataFrame, parsed: DataFrame, profile: str, flagged: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """Hits of the rules over call edges, flows, chain reads and bytecode for the profile's detectors, in the layout of catalog hits.

    ``known`` holds stored reads by name (see ``triage``); rules over a missing table have no hits.
    """
    fns = cut(enrich(functions(parsed)))
    sv = cut(state_vars(parsed))
    want = set(detectors(profile))
    flows = cut(taint_flows(fns, sv))
    acc = accesses(fns, sv)
    parts = [gr.reentrancy_interprocedural(fns, flagged), gr.solvency_check(fns), gr.flashloan_governance(files, fns), gr.delegatecall(fns, flows, acc), gr.proof_value_flow(flows, fns)]
    if "pausability_bypass" in want:
        parts += [gr.pausability_bypass(fns, call_edges(fns)), gr.taint_value_flow(flows)]
    if "economic_oracle_lending" in want and {"targets", "getters"} <= set(known):
        nodes, _ = protocol.nodes_and_edges(known["targets"], sv, fns, acc, known["getters"])
        nodes = cut(nodes)
        parts.append(gr.economic_oracle_lending(files, fns, protocol.surfaces(nodes, files), nodes))
    if {"abi", "roles"} <= set(known):
        parts.append(_as_hits(gr.governance_blast_radius(fns, known["abi"], known["roles"]).withColumnRenamed("variant", "rule_id"), "governance"))
    if {"delays", "roles"} <= set(known):
        parts.append(_as_hits(gr.timelock_roles(known["roles"], known["delays"]), "governance"))
    if "bytecode_periphery" in want and {"contracts", "resolved"} <= set(known):
        ops = cut(bytecode.opcodes(known["contracts"]).where(bytecode.NEEDED))
        parts.append(_as_hits(bytecode.periphery(bytecode.risk_signals(known["contracts"], ops), known["resolved"]), "bytecode"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    none = F.lit(None).cast("string")
    lead = F.col("detector").isin(*LEADS)
    number = F.create_map(*[x for i, n in enumerate(SPECIAL) for x in (F.lit(n), F.lit(100_000 + i))])
    # same file of a function name: the last definition, as the name-keyed facts have it
    where = fns.groupBy("target_id", F.col("name").alias("function")).agg(F.max_by(F.struct("path", "start", "line", F.substring("body", 1, 1500).alias("snippet"), body_key("body").alias("body_key")), F.struct("pos", "start")).alias("at"))
    return out.join(where, ["target_id", "function"], "left").select(
        "target_id", none.alias("chain"), F.col("at.path").alias("file"), F.lit(1 << 29).alias("pos"), F.coalesce("at.start", F.lit(0)).alias("start"), F.coalesce("at.line", F.lit(1)).alias("line"),
        F.try_element_at(number, "detector").alias("rule_no"), "detector", "rule_id", F.coalesce("rule_id", "detector").alias("variant"), "bug_class",
        F.concat_ws(": ", F.regexp_replace(F.coalesce("rule_id", "detector"), "_", " "), "function").alias("title"), "function", "impact", "conf",
        F.when(lead, "lead_only").when(F.col("detector") == "delegatecall", "confirmable").alias("tier"), lead.alias("lead_only"),
        F.array().cast("array<string>").alias("ev_flags"), F.coalesce("at.snippet", F.lit("")).alias("snippet"), F.coalesce("at.body_key", F.lit("")).alias("body_key"),
        F.coalesce("rule_id", F.lit("")).alias("variable"))


def _as_hits(rows: DataFrame, bug: str) -> DataFrame:
    """Rows of a rule over stored reads in the layout of the graph rules."""
    have = {c: F.col(c) for c in rows.columns}
    none = F.lit(None).cast("string")
    return rows.select("target_id", have.get("function", none).alias("function"), "detector", have.get("rule_id", none).alias("rule_id"), F.lit(bug).alias("bug_class"),
                       F.col("impact").cast("double").alias("impact"), F.col("conf").cast("double").alias("conf"))


def tool_candidates(tool: DataFrame) -> DataFrame:
    """Rows of external analysers in the layout of catalog hits; they come after all of our own."""
    none = F.lit(None).cast("string")
    return gr.analyzer_findings(tool).select(
        "target_id", none.alias("chain"), none.alias("file"), F.lit(1 << 30).alias("pos"), F.lit(0).alias("start"), F.lit(1).alias("line"), F.lit(200_000).alias("rule_no"), "detector",
        none.alias("rule_id"), "detector", "bug_class", "title", "function", "impact", "conf", none.alias("tier"), F.lit(False).alias("lead_only"), F.array().cast("array<string>").alias("ev_flags"),
        F.lit("").alias("snippet"), F.lit("").alias("body_key"), F.col("title").alias("variable")).toDF(
        "target_id", "chain", "file", "pos", "start", "line", "rule_no", "detector", "rule_id", "variant", "bug_class", "title", "function", "impact", "conf", "tier", "lead_only", "ev_flags", "snippet", "body_key", "variable")


def single_key_admin(hits: DataFrame, chain: DataFrame) -> DataFrame:
    """A guarded upgrade of code under an admin that is a plain account is one key away from any code: confidence 6, no mark of governance."""
    kinds = chain.select("target_id", "admin_kind")
    risk = (F.col("detector") == "proxy_upgrade") & (F.col("variant") == "guarded_upgrade") & (F.col("impact") >= 8) & (F.col("admin_kind") == "eoa")
    new = {"conf": F.lit(6.0), "title": F.concat(F.lit("Upgrade function controlled by a single EOA admin: "), F.col("function")),
           "ev_flags": F.array_except("ev_flags", F.array(F.lit("governance_controlled"), F.lit("documented_centralization")))}
    return hits.join(kinds, "target_id", "left").select(*[F.when(risk, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in hits.columns])


def value_context(files: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """(target_id, value_state, value_signal, reference_state) of every target from its stored reads, its sources and who refers to it.

    A target without reads is unknown; without the table ``references`` it is unknown whether anyone refers to a target.
    """
    hints = files.groupBy("target_id").agg(
        F.bool_or(F.coalesce(F.col("raw").rlike(chain_reads.FLOW_SOURCE), F.lit(False))).alias("flow_hint"),
        F.min_by(F.substring(F.coalesce("raw", F.lit("")), 1, DEPENDENT_HEAD).rlike(chain_reads.DEPENDENT), "pos").alias("in_source"))
    d = hints.join(chain_reads.wide(known["reads"]), "target_id", "left").join(known["chain"].select("target_id", "rpc_ok"), "target_id", "left")
    d = d.withColumn("rpc_ok", F.coalesce("rpc_ok", F.lit(False)))
    if "targets" in known:
        named = F.coalesce(F.col("contract_name").rlike(chain_reads.DEPENDENT), F.lit(False))
        d = d.join(known["targets"].select("target_id", "contract_name"), "target_id", "left").withColumn("in_source", F.col("in_source") | named)
    if "references" in known:
        n = known["references"].groupBy("target_id").agg(F.count_distinct("by").alias("n"))
        d = d.join(n, "target_id", "left").withColumn("referenced_by_count", F.coalesce("n", F.lit(0)))
    else:
        d = d.withColumn("referenced_by_count", F.lit(None).cast("long"))
    return chain_reads.value_context(d.withColumnRenamed("in_source", "dependent_hint"))


def live_evidence(cand: DataFrame, known: dict[str, DataFrame]) -> DataFrame:
    """Mark open candidates about initialisers, proxies and vaults whose getters read zero, where the target's chain could be read."""
    up = known["chain"].where("rpc_ok").select("target_id")
    d = gates.liveness(cand, known["reads"].join(up, "target_id", "left_semi"), known["targets"].select("target_id", "contract_name"))
    never = F.col("never_initialized") & ~F.coalesce("suppressed", F.lit(False))
    return d.withColumn("ev_flags", F.when(never, F.array_union("ev_flags", F.array(F.lit("never_initialized")))).otherwise(F.col("ev_flags"))).select(*cand.columns)


def in_turn(cand: DataFrame, *passes: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The passes one after the other; what one gives is kept for the next, since corroboration reads its candidates three times."""
    for k, one in enumerate(passes):
        cand = one(cand if k == 0 else cut(cand))
    return cand


def triage(files: DataFrame, profile: str = "ultra-deep-v2", order: str = "production", known: dict[str, DataFrame] | None = None) -> DataFrame:
    """Scored candidates of the source files: every detector of the profile, then all passes.

    order='production' runs sanity, corroboration, collapse; 'offline' runs corroboration, collapse, sanity
    (corroboration skips suppressed rows, so the results can differ).

    known: stored reads by name - abi(target_id, name), roles(target_id, role, zero_has, dead_has), delays(target_id, min_delay),
    contracts(target_id, code, source_verified), resolved(target_id), targets and getters (see ``protocol.nodes_and_edges``),
    tool (see ``analyzer_findings``), suppressions(fingerprint, address, reason), chain(target_id, rpc_ok, chain_mismatch, code,
    live_initialized, admin_kind - see ``chain.classify_admin``): one row for each target, NULL = unknown,
    reads(target_id, method, value) - stored getter values, with chain: value context, and with targets: liveness evidence,
    references(target_id, by).
    """
    known = known or {}
    parsed = cut(parse(files))  # four consumers below: parse once, keep the table in the shared folder
    hits = cut(evaluate(files, rules_for(profile), parsed))
    flagged = hits.where("detector = 'reentrancy'").select("target_id", "function")
    hits = hits.unionByName(special_hits(files, parsed, profile, flagged, known))
    if "chain" in known:
        hits = single_key_admin(hits, known["chain"])
    if "tool" in known:
        hits = hits.unionByName(tool_candidates(known["tool"]))
    cand = cut(to_candidates(hits))
    if "tool" in known:
        cand = scoring.tool_agreement(cand.drop("tool_agree"), known["tool"], ["target_id"])
    if {"chain", "reads"} <= set(known):
        cand = cand.drop("value_state", "value_signal", "reference_state").join(value_context(files, known), "target_id", "left")
    fns = functions(parsed)
    reads = {"rpc_ok": "boolean", "chain_mismatch": "boolean", "code": "string", "live_initialized": "boolean"}
    targets = files.select("target_id").distinct().withColumn("has_source", F.lit(True))
    if "chain" in known:
        targets = targets.join(known["chain"].select("target_id", *reads), "target_id", "left")
    else:
        targets = targets.withColumns({c: F.lit(None).cast(t) for c, t in reads.items()})
    targets = targets.withColumn("rpc_ok", F.coalesce("rpc_ok", F.lit(False)))
    live = (lambda d: live_evidence(d, known)) if {"chain", "reads", "targets"} <= set(known) else (lambda d: d)
    sane = lambda d: gates.sanity(live(d), fns, targets, known.get("abi"))
    cor = lambda d: scoring.corroborate(d.drop("corroborated", "corroborated_by"), ["target_id"])
    col = lambda d: dedup.collapse_duplicates(dedup.with_keys(d), ["target_id"])
    steps = (sane, cor, col) if order == "production" else (cor, col, sane)
    cand = in_turn(cand, *steps)
    if {"suppressions", "targets"} <= set(known):
        cand = dedup.suppress(cand.join(known["targets"].select("target_id", "address"), "target_id", "left"), known["suppressions"]).drop("address")
    return scoring.score(cand, profile)


def triage_report(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: the whole scan of a folder; findings by detector and class with the best priority, most urgent first."""
    from .corpus import contract_files, stored_reads

    d = triage(contract_files(spark, sf), known=stored_reads(spark, sf))
    d = d.withColumns({"next_tests": F.array().cast("array<string>")}).withColumn("priority", scoring.priority())
    return (d.groupBy("detector", "classification").agg(F.count(F.lit(1)).alias("findings"), F.max("impact_score").alias("max_impact"),
                                                       F.max("priority").alias("top_priority"), F.sum("dup_count").alias("copies"))
            .orderBy(F.desc("top_priority"), "detector", "classification"))
