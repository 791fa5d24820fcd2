"""Contract files derived from the ``documents`` table.

Every document becomes one source file: its whole text as a leading block
comment, then a contract whose functions are picked from the snippet pool by the
document id. Two documents share a target, so contract-grain rules see more than
one file. The work grows with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.chain import classify_admin
from .registry import spread
from .snippets import SPECIAL_TWINS, TWINS

PICKS = 5
POOL = [t for pair in (*TWINS.values(), *SPECIAL_TWINS.values()) for t in pair]


def documents(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/documents.parquet")
    return df.select(*cols) if cols else df


def contract_files(spark: SparkSession, sf: str) -> DataFrame:
    """files(target_id, chain, path, pos, raw) from documents; no shuffle."""
    pool = F.array(*[F.lit(t) for t in POOL])
    n = len(POOL)
    picks = F.transform(F.sequence(F.lit(0), F.lit(PICKS - 1)),
                        lambda j: F.element_at(pool, F.pmod(F.col("doc_id") * 7 + j * 53, F.lit(n)).cast("int") + 1))
    raw = F.concat(F.lit("/* "), F.replace(F.col("text"), F.lit("*/"), F.lit("")), F.lit(" */\n"), F.array_join(picks, "\n"), F.lit("\n}\n"))
    return spread(documents(spark, sf, "doc_id", "text"), always=True).select(
        F.floor(F.col("doc_id") / 2).cast("long").alias("target_id"),
        F.element_at(F.array(F.lit("ethereum"), F.lit("base")), F.pmod(F.col("doc_id"), F.lit(2)).cast("int") + 1).alias("chain"),
        F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".sol")).alias("path"),
        F.pmod(F.col("doc_id"), F.lit(2)).cast("int").alias("pos"), raw.alias("raw"))


def stored_reads(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Chain reads, ABI names, bytecode and tool rows of the targets of ``contract_files``, derived from their numbers."""
    t = documents(spark, sf, "doc_id").select(F.floor(F.col("doc_id") / 2).cast("long").alias("target_id")).distinct()
    k = F.col("target_id")
    addr = lambda c: F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(c)), 40, "0"))
    pick = lambda m, a, b: F.when(k % m == 0, F.lit(a)).otherwise(F.lit(b))
    none = F.lit(None).cast("string")
    code = F.concat(F.lit("0x6080604052"), F.when(k % 4 == 0, "f4").when(k % 4 == 1, "3255").otherwise("f1"), F.lit("63"), pick(3, "3659cfe6", "23b872dd"), F.lit("14"), F.when(k % 9 == 0, "ff").otherwise("00"))
    admins = t.select("target_id", F.when(k % 3 == 0, "0x").when(k % 3 == 1, "0x6080").alias("code"), F.when(k % 2 == 0, "2").alias("getThreshold()"), F.when(k % 4 == 1, "3600").alias("getMinDelay()"))
    kinds = classify_admin(admins).select("target_id", F.col("kind").alias("admin_kind"))
    read = lambda method, v: F.struct(F.lit(method).alias("method"), v.alias("value"))
    zero = F.lit("0x" + "0" * 40)
    values = F.array(read("balance", F.when(k % 3 != 2, (k % 3).cast("string"))), read("totalAssets()", F.when(k % 8 == 0, "0")), read("totalSupply()", F.when(k % 9 == 0, "7")),
                     read("owner()", F.when(k % 4 == 0, zero).when(k % 4 == 1, addr(k))), read("factory()", F.when(k % 6 == 1, zero)))
    return {
        "reads": t.select("target_id", F.explode(values).alias("r")).select("target_id", "r.*"),
        "references": t.where("target_id % 3 = 1").select("target_id", (k + 1).alias("by")),
        "chain": t.select("target_id", (k % 6 != 0).alias("rpc_ok"), F.when(k % 5 != 1, k % 11 == 3).alias("chain_mismatch"), F.when(k % 13 == 5, "0x").when(k % 13 != 6, code).alias("code"),
                          F.when(k % 4 == 1, True).when(k % 4 == 2, False).alias("live_initialized")).join(kinds, "target_id"),
        "abi": t.select("target_id", F.explode(F.array_compact(F.array(F.lit("execute"), F.lit("upgradeTo"), pick(2, "withdraw", "deposit"), F.when(k % 4 == 1, "initialize")))).alias("name")),
        "roles": t.where("target_id % 7 < 2").select("target_id", pick(2, "EXECUTOR_ROLE", "PROPOSER_ROLE").alias("role"), (k % 7 == 0).alias("zero_has"), F.lit(None).cast("boolean").alias("dead_has")),
        "delays": t.where("target_id % 5 = 0").select("target_id", F.lit(3600).cast("long").alias("min_delay")),
        "contracts": t.select("target_id", code.alias("code"), (k % 6 == 0).alias("source_verified")),
        "resolved": t.where("target_id % 22 = 0"),
        "targets": t.select("target_id", addr(k + 1).alias("address"), F.lit("C").alias("contract_name"), F.when(k % 2 == 0, addr(k + 7)).alias("implementation"), *[none.alias(c) for c in ("admin", "admin_owner", "owner", "beacon")]),
        "getters": t.select("target_id", F.lit("oracle").alias("name"), addr(k + 9).alias("address"), F.lit(True).alias("from_abi")),
        "tool": t.where("target_id % 4 = 0").select("target_id", F.lit("slither").alias("tool"), pick(8, "reentrancy-eth", "unchecked-transfer").alias("check"), F.lit("High").alias("impact"), F.lit("Medium").alias("confidence"),
                                                    F.lit("reentrancy before the state change").alias("description"), none.alias("location"), F.lit("withdraw").alias("function"), (k % 3 == 0).alias("high_value")),
    }


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def contract_files_sql() -> str:
    """DuckDB twin: function and modifier arrays by line, since every snippet function is one line."""
    pool = "[" + ", ".join(_sql(t) for t in POOL) + "]"
    n = len(POOL)
    lines = f"array_to_string(list_transform(range(0, {PICKS}), lambda j: ({pool})[((doc_id * 7 + j * 53) % {n}) + 1]), chr(10)) || chr(10) || '}}' || chr(10)"
    head = r"function\s+[A-Za-z_]\w*\s*\("
    fn = (r"{'name': regexp_extract(l, 'function\s+([A-Za-z_]\w*)', 1), "
          rf"'params': trim(regexp_extract(l, '{head}([^)]*)\)', 1)), "
          rf"'tail': trim(regexp_extract(l, '{head}[^)]*\)([^{{;]*)\{{', 1)), "
          rf"'body': regexp_extract(l, '{head}[^)]*\)[^{{;]*(\{{.*\}})', 1)}}")
    return (
        "SELECT target_id, chain, path, pos, raw, clean, "
        f"list_transform(list_filter(string_split(clean, chr(10)), lambda l: regexp_matches(l, '{head}')), lambda l: {fn}) AS fns, "
        r"list_transform(list_filter(string_split(clean, chr(10)), lambda l: regexp_matches(l, 'modifier\s+\w+')), "
        r"lambda l: {'name': regexp_extract(l, 'modifier\s+(\w+)', 1), 'body': l}) AS mods "
        "FROM (SELECT doc_id // 2 AS target_id, CASE doc_id % 2 WHEN 0 THEN 'ethereum' ELSE 'base' END AS chain, "
        "'src/f' || doc_id || '.sol' AS path, doc_id % 2 AS pos, '/* ' || replace(text, '*/', '') || ' */' || chr(10) || src AS raw, "
        f"regexp_replace(src, '//[^\\n]*', '', 'g') AS clean FROM (SELECT doc_id, text, {lines} AS src FROM documents))")
