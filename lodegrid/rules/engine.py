"""Catalog evaluation: one lazy plan from source files to candidate rows.

files(target_id, chain, path, pos, raw)
  -> parse (one Arrow pass: comment blanking, function and modifier arrays)
  -> per-file flags, then explode to functions (no file text is carried)
  -> every rule as a Column predicate in one projection -> explode hits
  -> target-grain conditions joined to the (small) hits, never to the functions.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import body_key
from ..functions.text import parse_sources
from ..session import cut
from .dsl import Many, Node, lowered
from .model import GUARD_BODY, Rule
from .prefilter import Gate, both, gate_of

PACK = 20
# Comment removal for yes/no target flags; offsets do not matter there, so it stays JVM-side.
CLEAN_SQL = r"regexp_replace(regexp_replace(raw, r'(?s)/\*.*?\*/', ' '), r'//[^\n]*', ' ')"


def parse(files: DataFrame) -> DataFrame:
    """Add clean text, function array and modifier array."""
    return files.withColumn("p", parse_sources("raw")).select(*files.columns, "p.clean", "p.fns", "p.mods")


def functions(parsed: DataFrame, *extra: str) -> DataFrame:
    """One row per function."""
    return parsed.select("target_id", "chain", "path", "pos", *extra, F.explode("fns").alias("f")).select(
        "target_id", "chain", "path", "pos", *extra, "f.*")


def _flags(nodes: list[Node], grain: str) -> dict:
    out = {}
    for n in nodes:
        for k, (g, p) in (n.flags if n is not None else {}).items():
            if g == grain:
                out[k] = p
    return out


_NO_HIT = "cast(array() AS array<struct<r:int,v:string>>)"


def _packs(rules: list[tuple[int, Rule]], each: dict[int, str] | None = None, gate: Gate | None = None) -> str:
    """SQL of the array of {r, v} for the rules that hold on the current row, in packs; a gate is asked first."""
    packs, first = [_NO_HIT], gate.test if gate else lambda i: ""
    for at in range(0, len(rules), PACK):
        one = [f"CASE WHEN {first(i)}{r.when.s} THEN named_struct('r', {i}, 'v', '') END"
               for i, r in rules[at:at + PACK] if r.each is None]
        if one:
            packs.append(f"filter(array({', '.join(one)}), h -> h IS NOT NULL)")
        packs += [f"CASE WHEN {first(i)}{r.when.s} THEN transform({(each or {}).get(i, r.each.s)}, v -> named_struct('r', {i}, 'v', v)) "
                  f"ELSE {_NO_HIT} END" for i, r in rules[at:at + PACK] if r.each is not None]
    return f"concat({', '.join(packs)})"


def target_flags(files: DataFrame, nodes: list[Node], gated: bool = True) -> DataFrame | None:
    """Boolean facts of every target: partial aggregation, one short row per target."""
    flags = _flags(nodes, "t")
    if not flags:
        return None
    src = files.select("target_id", "raw", F.expr(CLEAN_SQL).alias("clean"))
    # clean is raw with a blank for each comment, so what a pattern needs in either text stands in raw
    gate = gate_of({k: p.needs for k, p in flags.items()}, "target_can") if gated else None
    if gate:
        src = src.withColumn(gate.bits, gate.column(F.col("raw")))
    src = src.select("*", *[F.expr(e) for e in lowered("raw", "clean")])
    src = src.select("target_id", *[F.expr(f"({gate.test(k) if gate else ''}{p.s})").alias(k) for k, p in flags.items()])
    return src.groupBy("target_id").agg(*[F.bool_or(k).alias(k) for k in flags])


def guard_modifiers(parsed: DataFrame) -> DataFrame:
    """Names of modifiers whose body checks authority, per target."""
    m = parsed.select("target_id", F.explode("mods").alias("m"))
    return m.where(F.col("m.body").rlike("(?i)" + GUARD_BODY)).select("target_id", F.col("m.name").alias("modifier")).distinct()


_RULE_ARROW = pa.schema([
    ("r", pa.int32()), ("detector", pa.string()), ("rule_id", pa.string()), ("variant", pa.string()), ("bug_class", pa.string()), ("tier", pa.string()),
    ("lead_only", pa.bool_()), ("ev_flags", pa.list_(pa.string())), ("impact", pa.float64()), ("conf", pa.float64()), ("fixed_fn", pa.string()),
    ("once", pa.bool_()), ("once_fn", pa.bool_()), ("custom_guard", pa.bool_()), ("tcond", pa.int32())])


def _rule_rows(spark, rules: list[Rule], conds: list[str]) -> DataFrame:
    rows = []
    for i, r in enumerate(rules):
        rows.append((i, r.detector, r.rule_id, r.key.lstrip("~"), r.bug or None, r.tier or None, r.is_lead, list(r.flags), r.impact,
                     r.conf, r.fn, r.once, r.once_fn, r.custom_guard, conds.index(r.target.s) if r.target is not None else None))
    # an Arrow table reaches the JVM as it is; a list of tuples would start Python workers on the executors to read it
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _RULE_ARROW.types)], schema=_RULE_ARROW))


def _file_fact(key: str, node: Node, gate: Gate | None) -> str:
    """SQL of a file-grain flag or list under its name; a gate is asked first."""
    can = gate.test(key) if gate else ""
    if not isinstance(node, Many):
        return f"({can}{node.s}) AS {key}"
    return f"CASE WHEN {can}true THEN {node.s} ELSE cast(array() AS array<string>) END AS {key}" if can else f"{node.s} AS {key}"


def evaluate(files: DataFrame, rules: list[Rule], parsed: DataFrame | None = None, gated: bool = True) -> DataFrame:
    """Candidate rows of every catalog rule over the source files; without the literal gate (``gated``) the rows are the same."""
    spark = files.sparkSession
    parsed = parse(files) if parsed is None else parsed
    numbered = list(enumerate(rules))
    fn_rules = [(i, r) for i, r in numbered if r.grain == "fn"]
    file_rules = [(i, r) for i, r in numbered if r.grain == "file"]
    hits = None
    if fn_rules or file_rules:
        # One pass over the parsed files: file facts become columns, then the functions are exploded together
        # with one pseudo row per file that carries the file-grain rules. No file text reaches those rows.
        fl = _flags([n for _, r in fn_rules + file_rules for n in (r.when, r.each)], "f")
        lists = {i: f"each_{i}" for i, r in file_rules if r.each is not None}
        facts = {**fl, **{lists[i]: r.each for i, r in file_rules if i in lists}}
        texts = parsed.select("target_id", "chain", "path", "pos", "raw", "clean", "fns")
        file_gate = gate_of({k: p.needs for k, p in facts.items()}, "file_can") if gated else None
        if file_gate:
            texts = texts.withColumn(file_gate.bits, file_gate.column(F.col("raw")))
        texts = texts.select("*", *[F.expr(e) for e in lowered("raw", "clean")])
        flagged = texts.select("target_id", "chain", "path", "pos", "fns", *[F.expr(_file_fact(k, p, file_gate)) for k, p in facts.items()])
        fields = "'start', {0}, 'line', {1}, 'name', {2}, 'params', {3}, 'tail', {4}, 'body', {5}"
        rows = "transform(fns, f -> named_struct('is_file', false, " + fields.format(*[f"f.{c}" for c in ("start", "line", "name", "params", "tail", "body")]) + "))"
        if file_rules:
            rows = f"concat({rows}, array(named_struct('is_file', true, {fields.format('0', '1', repr(''), repr(''), repr(''), repr(''))})))"
        keep = [*fl, *lists.values()]
        rel = flagged.select("target_id", "chain", "path", "pos", *keep, F.explode(F.expr(rows)).alias("f")).select("target_id", "chain", "path", "pos", *keep, "f.*")
        gate = gate_of({i: both(r.when.needs, r.each.needs if r.each is not None else ()) for i, r in fn_rules}, "fn_can") if gated else None
        if gate:
            rel = rel.withColumn(gate.bits, gate.column(F.concat_ws("\n", "name", "params", "tail", "body")))
        rel = rel.select("*", *[F.expr(e) for e in lowered("name", "params", "tail", "body")])
        by_fn = _packs(fn_rules, gate=gate)
        emit = by_fn if not file_rules else f"CASE WHEN is_file THEN {_packs(file_rules, lists)} ELSE {by_fn} END"
        hits = rel.select("target_id", "chain", "path", "pos", "start", "line", F.col("name").alias("function"), "tail",
                          F.substring("body", 1, 1500).alias("snippet"), body_key("body").alias("body_key"), F.explode(F.expr(emit)).alias("h"))
    tnodes = [r.target for _, r in numbered if r.target is not None] + [r.when for _, r in numbered if r.grain == "target"]
    conds = list(dict.fromkeys(r.target.s for _, r in numbered if r.target is not None))
    tgt = [(i, r) for i, r in numbered if r.grain == "target"]
    tf = target_flags(files, tnodes, gated)
    if conds and tgt:
        tf = cut(tf)  # read for the conditions and for the rules: one short row per target, one pass over the texts
    out = None
    if hits is not None:
        # the catalog is a fixed list of rules, so its broadcast never grows with the data
        dim = F.broadcast(_rule_rows(spark, rules, conds))
        out = hits.select(*[c for c in hits.columns if c != "h"], "h.r", "h.v").join(dim, "r")
        if conds:
            ok = tf.select("target_id", F.array(*[F.expr(c) for c in conds]).alias("ok"))
            out = out.join(ok, "target_id").where("tcond IS NULL OR get(ok, tcond)").drop("ok")
        if any(r.once or r.once_fn for _, r in numbered):
            key = F.when(F.col("once"), F.concat_ws("|", "path", "r")).when(F.col("once_fn"), F.concat_ws("|", "function", "r")).otherwise(
                F.concat_ws("|", "path", "r", "start", "v"))
            w = Window.partitionBy("target_id", "first_key").orderBy("pos", "start")
            # every other hit has a key of its own, so rank 1 keeps it and Spark can prune ranks map-side
            out = out.withColumn("first_key", key).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "first_key")
        if any(r.custom_guard for _, r in numbered):
            out = _drop_custom_guarded(out, guard_modifiers(parsed))
    if tgt:
        rows = tf.select("target_id", F.explode(F.expr(_packs(tgt))).alias("h")).select("target_id", "h.r", "h.v").join(F.broadcast(_rule_rows(spark, rules, conds)), "r")
        first = files.groupBy("target_id").agg(F.min("chain").alias("chain"))
        rows = rows.join(first, "target_id").select(
            "*", F.lit(None).cast("string").alias("path"), F.lit(1 << 30).alias("pos"), F.lit(0).alias("start"), F.lit(1).alias("line"),
            F.lit("").alias("function"), F.lit("").alias("tail"), F.lit("").alias("snippet"), F.lit("").alias("body_key"))
        out = rows if out is None else out.unionByName(rows)
    return _shape(out)


def _drop_custom_guarded(hits: DataFrame, guards: DataFrame) -> DataFrame:
    """Anti-join on (target, header identifier): an equi-join, not a scan of all guards."""
    hits = cut(hits)
    key = ["target_id", "path", "pos", "start", "r"]
    ids = hits.where("custom_guard").select(*key, F.explode(F.array_distinct(F.regexp_extract_all("tail", F.lit(r"([A-Za-z_]\w*)"), F.lit(1)))).alias("modifier"))
    bad = ids.join(guards, ["target_id", "modifier"]).select(*key).distinct()
    return hits.join(bad, key, "left_anti")


def _shape(hits: DataFrame) -> DataFrame:
    fn = F.when(F.col("fixed_fn") != "", F.col("fixed_fn")).when(F.col("function") != "", F.col("function"))
    words = F.regexp_replace("variant", "_", " ")
    return hits.select(
        "target_id", "chain", F.col("path").alias("file"), "pos", "start", "line", F.col("r").alias("rule_no"), "detector", "rule_id", "variant",
        "bug_class", F.concat_ws(": ", F.concat(F.upper(F.substring(words, 1, 1)), F.expr("substring(regexp_replace(variant, '_', ' '), 2)")), fn).alias("title"),
        fn.alias("function"), "impact", "conf", "tier", "lead_only", "ev_flags", "snippet", "body_key", F.col("v").alias("variable"))


# ------------------------------------------------------------------ DuckDB twin (tests, oracle)
def oracle_sql(files_sql: str, rules: list[Rule]) -> str | None:
    """The same catalog over a DuckDB relation files(target_id, chain, path, pos, raw, clean, fns, mods)."""
    if any(n is not None and n.d is None for r in rules for n in (r.when, r.each, r.target)):
        return None
    flags = {}
    for r in rules:
        for n in (r.when, r.each, r.target):
            flags.update(n.flags if n is not None else {})
    if any(p.d is None for _, p in flags.values()):
        return None
    ff = {k: p for k, (g, p) in flags.items() if g == "f"}
    tf = {k: p for k, (g, p) in flags.items() if g == "t"}
    sel = "".join(f", {p.d} AS {k}" for k, p in ff.items())
    ctes = [f"files AS ({files_sql})", f"flagged AS (SELECT *{sel} FROM files)"]
    agg = "".join(f", bool_or({p.d}) AS {k}" for k, p in tf.items())
    ctes.append(f"tf AS (SELECT target_id{agg} FROM files GROUP BY target_id)")
    fcols = "".join(f", {k}" for k in ff)
    ctes.append("fn AS (SELECT target_id, chain, path, pos, ord, f.name AS name, f.params AS params, f.tail AS tail, f.body AS body"
                f"{fcols} FROM (SELECT target_id, chain, path, pos{fcols}, unnest(fns) AS f, generate_subscripts(fns, 1) AS ord FROM flagged))")
    guard = GUARD_BODY.replace("'", "''")
    ctes.append("guards AS (SELECT DISTINCT target_id, m.name AS modifier FROM (SELECT target_id, unnest(mods) AS m FROM files) "
                f"WHERE regexp_matches(m.body, '(?i){guard}'))")
    parts = []
    for r in rules:
        lab = f"'{r.detector}' AS detector, '{r.key.lstrip('~')}' AS variant, {r.impact}::DOUBLE AS impact, {r.conf}::DOUBLE AS conf"
        tcond = f" AND {r.target.d}" if r.target is not None else ""
        if r.grain == "target":
            parts.append(f"SELECT tf.target_id, NULL::VARCHAR AS file, {lab}, {_q(r.fn)} AS function FROM tf WHERE {r.when.d}")
            continue
        src = "fn" if r.grain == "fn" else "flagged"
        frm = f"(SELECT *, unnest({r.each.d}) AS v FROM {src} WHERE {r.when.d})" if r.each is not None else src
        fn = "s.name" if r.grain == "fn" else _q(r.fn)
        cond = "true" if r.each is not None else r.when.d
        q = f"SELECT s.target_id, s.path AS file, {lab}, {fn} AS function FROM {frm} s JOIN tf USING (target_id) WHERE {cond}{tcond}"
        if r.custom_guard:
            q += " AND NOT EXISTS (SELECT 1 FROM guards g WHERE g.target_id = s.target_id AND list_contains(regexp_extract_all(s.tail, '([A-Za-z_]\\w*)', 1), g.modifier))"
        if r.once:
            q += " QUALIFY row_number() OVER (PARTITION BY s.target_id, s.path ORDER BY s.ord) = 1"
        if r.once_fn:
            q += " QUALIFY row_number() OVER (PARTITION BY s.target_id, s.name ORDER BY s.pos, s.ord) = 1"
        parts.append(q)
    body = " UNION ALL ".join(f"SELECT * FROM ({p})" for p in parts)
    return f"WITH {', '.join(ctes)} SELECT target_id, file, detector, variant, function, impact, conf FROM ({body})"


def _q(s: str) -> str:
    return "NULL::VARCHAR" if not s else "'" + s + "'"

