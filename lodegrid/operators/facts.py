"""Function facts as relations: parameters, guards, calls, sinks, reads/writes and both call-edge tables.

All facts are extracted by JVM regex arrays and resolved by equi-joins on
(target, identifier) - never by testing every known name against every body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import call_arguments, contract_level, split_top_level
from .dedup import keep_first, keep_last

# ---- Fixed values: extraction patterns --------------------------------------------------
CALL_TARGET = r"[A-Za-z_]\w*(?:\s*\[[^\]]+\]|(?:\.[A-Za-z_]\w*)|(?:\([^;{}]*\)))*"
CALL_KIND = r"call|delegatecall|staticcall|transfer|send|safeTransfer|safeTransferFrom|transferFrom"
EXTERNAL_CALL = rf"(?s)({CALL_TARGET})\s*\.\s*({CALL_KIND})\s*(?:\{{([^}}]*)\}})?\s*\(([^;{{}}]*)\)"
MINT_BURN = r"(?s)\b(_?mint|_?burn)\s*\(([^;{}]*)\)"
VALUE_METHODS = ("transfer", "send", "safeTransfer", "safeTransferFrom", "transferFrom", "call", "_mint", "mint", "_burn", "burn")
MAPPING = (r"mapping\s*\(([^=;{}]+)=>\s*([^)]+)\)\s*((?:public|private|internal|constant|immutable|override|\s)*)([A-Za-z_]\w*)\s*[;=]")
STATE_VAR = (r"(?m)^\s*([A-Za-z_]\w*(?:\s+payable)?(?:\[\])?|address\s+payable|uint\d*|int\d*|bytes\d*|bytes|string|bool)\s+"
             r"((?:(?:public|private|internal|constant|immutable|override)\s+)*)([A-Za-z_]\w*)\s*(?:=|;)")
NOT_STATE = r"\b(function|modifier|event|error|struct|enum|contract|interface|library|return|emit|delete|using|import|pragma)\b"
PARAM_NOISE = ("memory", "storage", "calldata", "payable", "uint", "int", "address", "bool", "string", "bytes")
ACCESS_HINT = r"(?i)^(only[A-Z_]|.*Only$|.*Guard$|restricted$|requiresAuth$|auth$|isAuthorized$)"
TAIL_WORDS = ("public", "external", "internal", "private", "view", "pure", "payable", "virtual", "override", "returns", "memory",
              "storage", "calldata")
DECODE = r"(?s)(\([^)]*\)|[A-Za-z_]\w*)\s*=\s*abi\.decode\s*\("
WRITE = r"\b([A-Za-z_]\w*)\s*(?:\[[^\]]+\])?\s*(?:=|\+=|-=|\*=|/=|%=|\+\+|--)"
# -----------------------------------------------------------------------------------------

IDENT = r"([A-Za-z_]\w*)"


def _all(c: str | Column, p: str, g: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(p), F.lit(g))


def _ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def visibility() -> Column:
    v = F.regexp_extract("tail", r"\b(public|external|internal|private)\b", 1)
    return F.when(v == "", "unknown").otherwise(v)


def mutability() -> Column:
    v = F.regexp_extract("tail", r"\b(view|pure|payable)\b", 1)
    return F.when(v == "", "nonpayable").otherwise(v)


def modifiers() -> Column:
    words = _all(F.regexp_replace("tail", r"returns\s*\([^)]*\)", " "), IDENT)
    return F.filter(words, lambda w: ~w.isin(*TAIL_WORDS))


def guards() -> Column:
    req = F.transform(_all("body", r"(?s)(\b(?:require|assert)\s*\(.*?\))\s*;"), _ws)
    rev = F.transform(_all("body", r"(?s)\brevert\s+([^;]+);"), lambda g: F.concat(F.lit("revert "), _ws(g)))
    inline = F.when(F.col("body").rlike(r"hasRole\s*\(|msg\.sender\s*==|_msgSender\s*\(\s*\)\s*=="),
                    F.array(F.lit("inline_sender_or_role_check"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.filter("modifiers", lambda m: m.rlike(ACCESS_HINT)), req, rev, inline)


def decoded_fields() -> Column:
    slots = F.flatten(F.transform(_all("body", DECODE), lambda s: F.split(F.regexp_replace(s, r"[()]", ""), ",")))
    return F.array_distinct(F.filter(F.transform(slots, lambda p: F.regexp_extract(p, r"([A-Za-z_]\w*)[^\w]*$", 1)), lambda x: x != ""))


def enrich(fns: DataFrame) -> DataFrame:
    """Add visibility, mutability, modifiers, guards, params, decoded fields, events and both call shapes."""
    d = fns.withColumns({"param_parts": split_top_level("params"), "calls": call_arguments("body")})  # one Python step
    last = lambda p: F.regexp_extract(p, r"([A-Za-z_]\w*)[^\w]*$", 1)
    pname = lambda p, i: F.when(last(p).isin("", *PARAM_NOISE), F.concat(F.lit("arg"), i.cast("string"))).otherwise(last(p))
    d = d.withColumns({"visibility": visibility(), "mutability": mutability(), "modifiers": modifiers(),
                       "param_names": F.transform("param_parts", pname), "decoded": decoded_fields(),
                       "events": F.array_distinct(_all("body", r"\bemit\s+([A-Za-z_]\w*)\s*\("))})
    d = d.withColumn("param_types", F.transform("param_parts", lambda p, i: _ws(F.regexp_replace(p, r"\b[A-Za-z_]\w*[^\w]*$", ""))))
    # a body is searched once by each pattern; the parts of a call are taken from the call
    part = lambda x, p, g: F.regexp_extract(x, p, g)
    ext = F.transform(_all("body", EXTERNAL_CALL, 0),
                      lambda x: F.struct(_ws(part(x, EXTERNAL_CALL, 1)).alias("target"), part(x, EXTERNAL_CALL, 2).alias("kind"), _ws(part(x, EXTERNAL_CALL, 4)).alias("args"),
                                         _ws(part(part(x, EXTERNAL_CALL, 3), r"\bvalue\s*:\s*([^,}]+)", 1)).alias("value")))
    mint = F.transform(_all("body", MINT_BURN, 0),
                       lambda x: F.struct(F.lit("self").alias("target"), part(x, MINT_BURN, 1).alias("kind"), _ws(part(x, MINT_BURN, 2)).alias("args"), F.lit("").alias("value")))
    d = d.withColumns({"guards": guards(), "external_calls": ext, "mints": mint,
                       "entrypoint": F.col("visibility").isin("public", "external", "unknown")})
    return d.withColumn("value_sinks", F.concat(F.filter("external_calls", lambda x: x["kind"].isin(*VALUE_METHODS)), "mints"))


def state_vars(parsed: DataFrame) -> DataFrame:
    """Declared state variables; the first declaration of a name in a target wins, mappings before the rest of a file.

    A file's text is read by each pattern once, and the parts of a declaration are taken from the declaration. The plain ones are looked
    for where runs of white space are one character: a blanked comment has as many line starts as the comment has lines.
    """
    src = parsed.select("target_id", "path", F.col("pos").alias("file_pos"), contract_level("clean").alias("src"))
    found = lambda grp, text, p: F.transform(_all(text, p, 0), lambda x, i: F.struct(F.lit(grp).alias("grp"), i.alias("decl_pos"), x.alias("decl")))
    every = F.concat(found(0, F.col("src"), MAPPING), found(1, _narrow(F.col("src")), STATE_VAR))
    # outer: for an inner one the optimizer would run all patterns a second time, to filter
    e = src.select("target_id", "path", "file_pos", F.explode_outer(every).alias("z")).select("target_id", "path", "file_pos", "z.*").where("decl IS NOT NULL")
    m, part = F.col("grp") == 0, lambda p, g: F.regexp_extract("decl", p, g)
    d = e.where(m | ~F.col("decl").rlike(NOT_STATE)).select(
        "target_id", "path", "file_pos", "grp", "decl_pos", F.when(m, part(MAPPING, 4)).otherwise(part(STATE_VAR, 3)).alias("name"),
        F.when(m, "mapping").otherwise(_ws(part(STATE_VAR, 1))).alias("type"),
        F.filter(F.split(F.trim(F.when(m, part(MAPPING, 3)).otherwise(part(STATE_VAR, 2))), r"\s+"), lambda x: x != "").alias("attrs"),
        F.when(m, F.trim(part(MAPPING, 1))).alias("key_type"))
    return keep_first(d, ["target_id", "name"], F.col("file_pos"), F.col("grp"), F.col("decl_pos"))


def _narrow(text: Column) -> Column:
    """Runs of white space as one line feed where they hold a line's end, as one blank elsewhere."""
    return F.regexp_replace(F.regexp_replace(text, r"[ \t\x0B\f]+", " "), r" ?[\n\r]\s*", "\n")


def last_definitions(fns: DataFrame) -> DataFrame:
    """Name-keyed functions: a later definition of a name replaces an earlier one."""
    return keep_last(fns, ["target_id", "name"], F.col("pos"), F.col("start"))


def _edges(fns: DataFrame, pattern: str) -> DataFrame:
    """Identifiers of every body resolved to functions of the same target; distinct caller -> callee."""
    used = fns.select("target_id", F.col("name").alias("src"), F.explode(F.array_distinct(_all("body", pattern))).alias("dst")).where("src <> dst").distinct()
    known = fns.select("target_id", F.col("name").alias("dst")).distinct()
    return used.join(known, ["target_id", "dst"], "left_semi").select("target_id", "src", "dst")


def call_edges(fns: DataFrame) -> DataFrame:
    """Edges by call syntax: the callee's name followed by '('."""
    return _edges(fns, r"\b([A-Za-z_]\w*)\s*\(")


def loose_edges(fns: DataFrame) -> DataFrame:
    """Edges by mention: the callee's name anywhere in the body."""
    return _edges(fns, r"\b([A-Za-z_]\w*)\b")


def accesses(fns: DataFrame, svars: DataFrame) -> DataFrame:
    """Distinct (function, state variable) with read and write marks, by equi-join on the identifier."""
    ids = F.transform(F.array_distinct(_all("body", r"\b([A-Za-z_]\w*)\b")), lambda x: F.struct(x.alias("var"), F.lit(0).alias("w")))
    wr = F.array_distinct(F.concat(_all("body", WRITE), _all("body", r"\bdelete\s+([A-Za-z_]\w*)\b"), _all("body", r"\b([A-Za-z_]\w*)\s*\.\s*(?:push|pop)\s*\(")))
    ws = F.transform(wr, lambda x: F.struct(x.alias("var"), F.lit(1).alias("w")))
    e = fns.select("target_id", "path", "name", visibility().alias("visibility"), F.explode(F.concat(ids, ws)).alias("u")).select("target_id", "path", "name", "visibility", "u.*")
    e = e.groupBy("target_id", "path", "name", "visibility", "var").agg(F.max("w").alias("writes"))
    return e.join(svars.select("target_id", F.col("name").alias("var")).distinct(), ["target_id", "var"], "left_semi").withColumn("writes", F.col("writes") == 1)


def read_write_matrix(acc: DataFrame) -> DataFrame:
    """Per state variable: sorted readers, writers and externally reachable writers."""
    d = acc.select("target_id", "var", "name", "writes", F.col("visibility").isin("public", "external", "unknown").alias("ext")).distinct()
    return d.groupBy("target_id", "var").agg(
        F.array_sort(F.collect_set("name")).alias("read_by"), F.array_sort(F.collect_set(F.when(F.col("writes"), F.col("name")))).alias("written_by"),
        F.array_sort(F.collect_set(F.when(F.col("writes") & F.col("ext"), F.col("name")))).alias("entrypoint_writers"))
