"""Explorer snapshots: source decoding, ABI projections, fallbacks, modules and creations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.evm import address_array, address_word
from ..functions.scalars import safe_relpath
from ..operators.dedup import keep_first, keep_last, top_per_key

# Paths of audited third-party code, and the module ids probed on module-style contracts.
LIBRARY_MARKERS = ("@openzeppelin/", "openzeppelin/contracts", "solmate/", "solady/", "@uniswap/", "@chainlink/", "forge-std/", "ds-test/",
                   "@layerzerolabs/", "lib/openzeppelin", "lib/solmate", "lib/solady", "lib/forge-std")
MODULE_IDS = (1, 2, 3, 4, 5, 6, 7, 8, 500000, 500001)
ABI = ("array<struct<type:string,name:string,inputs:array<struct<name:string,type:string>>,outputs:array<struct<name:string,type:string>>,"
       "stateMutability:string>>")
_MULTI = "map<string,struct<content:string>>"


def decode_sources(rows: DataFrame) -> DataFrame:
    """(address, source_code, contract_name) -> one row per source file.

    Standard JSON (also in an extra brace pair), a file map of objects, a file map of strings, or one plain file.
    """
    t = F.trim("source_code")
    t = F.when(F.startswith(t, F.lit("{{")) & F.endswith(t, F.lit("}}")), F.expr("substring(trim(source_code), 2, length(trim(source_code)) - 2)")).otherwise(t)
    d = rows.where("length(trim(source_code)) > 0").withColumn("t", t)
    std = F.from_json("t", f"struct<sources:{_MULTI}>")["sources"]
    maps = F.from_json("t", _MULTI)
    flat = F.from_json("t", "map<string,string>")
    obj = lambda m: F.map_filter(m, lambda k, v: v["content"].isNotNull())
    entries = lambda m: F.transform(F.map_entries(m), lambda e: F.struct(e["key"].alias("path"), e["value"]["content"].alias("text")))
    strs = F.transform(F.map_entries(F.map_filter(flat, lambda k, v: ~F.startswith(v, F.lit("{")))), lambda e: F.struct(e["key"].alias("path"), e["value"].alias("text")))
    one = F.array(F.struct(F.coalesce(F.nullif("contract_name", F.lit("")), F.lit("Contract")).alias("path"), F.col("source_code").alias("text")))
    js = F.startswith("t", F.lit("{")) & F.try_parse_json("t").isNotNull()
    n = lambda m: F.coalesce(F.size(obj(m)), F.lit(0))
    files = (F.when(js & (n(std) > 0), entries(obj(std)))
             .when(js & (n(maps) + F.coalesce(F.size(strs), F.lit(0)) > 0), F.concat(F.coalesce(entries(obj(maps)), F.array().cast("array<struct<path:string,text:string>>")), strs))
             .otherwise(one))
    e = d.select("address", F.posexplode(files).alias("pos", "f"))
    return e.select("address", "pos", safe_relpath(F.col("f.path")).alias("path"), F.col("f.text").alias("text"))


def parse_abi(rows: DataFrame) -> DataFrame:
    """abi JSON text -> exploded ABI items."""
    items = F.from_json(F.coalesce(F.get_json_object("abi", "$.abi"), F.col("abi")), ABI)
    return rows.select("target_id", F.posexplode(items).alias("pos", "i")).select("target_id", "pos", "i.*")


def abi_functions(items: DataFrame) -> DataFrame:
    return items.where("type = 'function' AND name IS NOT NULL AND name <> ''").select("target_id", "name").distinct()


def abi_address_getters(items: DataFrame) -> DataFrame:
    """Zero-input functions returning exactly one address."""
    no_in = F.coalesce(F.size("inputs"), F.lit(0)) <= 0
    return items.where((F.col("type") == "function") & no_in & (F.size("outputs") == 1) & (F.get("outputs", F.lit(0))["type"] == "address")).select(
        "target_id", "name").distinct()


def combine_abis(*items: DataFrame) -> DataFrame:
    """Union of ABIs, first item per (type, name, input types)."""
    u = None
    for k, i in enumerate(items):
        i = i.withColumn("src", F.lit(k))
        u = i if u is None else u.unionByName(i)
    u = u.withColumn("sig", F.array_join(F.transform("inputs", lambda x: x["type"]), ","))
    return keep_first(u, ["target_id", "type", "name", "sig"], F.col("src"), F.col("pos"))


def with_fallback(primary: DataFrame, mirror: DataFrame) -> DataFrame:
    """Primary source where verified and non-empty, else the mirror; proxy hints of the primary are kept.

    Both carry (address, verified, files array, is_proxy, implementation).
    """
    m = mirror.select("address", *[F.col(c).alias(f"m_{c}") for c in ("verified", "files", "is_proxy", "implementation")])
    d = primary.join(m, "address", "left")
    own = F.coalesce(F.col("verified") & (F.size("files") > 0), F.lit(False))
    use_m = ~own & F.coalesce(F.col("m_verified"), F.lit(False))
    return d.select("address", F.when(use_m, F.col("m_verified")).otherwise(F.col("verified")).alias("verified"),
                    F.when(use_m, F.col("m_files")).otherwise(F.col("files")).alias("files"),
                    (F.coalesce("is_proxy", F.lit(False)) | (use_m & F.coalesce("m_is_proxy", F.lit(False)))).alias("is_proxy"),
                    F.coalesce("implementation", F.when(use_m, F.col("m_implementation"))).alias("implementation"))


def is_library(path: Column) -> Column:
    p = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    out = F.lit(False)
    for m in LIBRARY_MARKERS:
        out = out | F.contains(p, F.lit(m))
    return out


def drop_libraries(files: DataFrame, key: str = "target_id") -> DataFrame:
    """Drop library paths; a target consisting only of libraries keeps everything.

    Project files pass straight through; only library files are anti-joined against the targets that have some.
    """
    lib = is_library(F.col("path"))
    own = files.where(~lib)
    return own.unionByName(files.where(lib).join(own.select(key).distinct(), key, "left_anti"))


def creations(direct: DataFrame, internal: DataFrame) -> DataFrame:
    """Contracts created by a deployer: direct transactions win over internal ones, by block.

    direct(deployer, to, contract_address, block), internal(deployer, type, contract_address, block).
    """
    real = F.col("contract_address").rlike("(?i)^0x[0-9a-f]*[1-9a-f][0-9a-f]*$")
    a = direct.where((F.coalesce("to", F.lit("")) == "") & real).select("deployer", F.lower("contract_address").alias("address"), "block", F.lit(0).alias("src"))
    b = internal.where(F.startswith("type", F.lit("create")) & real).select("deployer", F.lower("contract_address").alias("address"), "block", F.lit(1).alias("src"))
    return keep_first(a.unionByName(b), ["deployer", "address"], F.col("src"), -F.col("block")).drop("src")


def module_addresses(facts: DataFrame, targets: DataFrame) -> DataFrame:
    """Facet and module implementations out of stored call results, first-seen order, without the target itself.

    facts(target_id, method, arg, value); methods facetAddresses(), moduleIdToImplementation(uint256), moduleIdToProxy(uint256).
    """
    facets = facts.where("method = 'facetAddresses()'").select("target_id", F.lit(0).alias("g"), F.posexplode(address_array(F.col("value"))).alias("k", "module"))
    ids = F.col("arg").cast("int")
    mods = facts.where(F.col("method").isin("moduleIdToImplementation(uint256)", "moduleIdToProxy(uint256)") & ids.isin(*MODULE_IDS)).select(
        "target_id", F.when(F.col("method") == "moduleIdToImplementation(uint256)", 1).otherwise(2).alias("g"), ids.alias("k"), address_word(F.col("value")).alias("module"))
    d = facets.unionByName(mods).where("module IS NOT NULL").join(targets.select("target_id", F.lower("address").alias("own")), "target_id").where("module <> own").drop("own")
    return keep_first(d, ["target_id", "module"], F.col("g"), F.col("k"))


def expand_modules(modules: DataFrame, sources: DataFrame, max_modules: int = 16) -> DataFrame:
    """Files of verified modules under a module path; the cap counts modules that have source.

    sources(address, path, text) holds verified files only.
    """
    have = sources.select(F.lower("address").alias("module")).distinct()
    m = top_per_key(modules.join(have, "module", "left_semi"), ["target_id"], max_modules, F.col("g"), F.col("k"))
    return m.join(sources.select(F.lower("address").alias("module"), "path", "text"), "module").select(
        "target_id", F.concat_ws("/", F.lit("_modules"), "module", "path").alias("path"), "text")


def merge_sources(proxy: DataFrame, implementation: DataFrame, modules: DataFrame) -> DataFrame:
    """Union with path prefixes; a later set replaces an equal path."""
    a = proxy.select("target_id", "path", "text", F.lit(0).alias("src"))
    b = implementation.select("target_id", F.concat(F.lit("_implementation/"), "path").alias("path"), "text", F.lit(1).alias("src"))
    c = modules.select("target_id", "path", "text", F.lit(2).alias("src"))
    return keep_last(a.unionByName(b).unionByName(c), ["target_id", "path"], F.col("src"))


def main_source(files: DataFrame, names: DataFrame, prefer_implementation: bool = False) -> DataFrame:
    """The main file per target: preferred side, then the file named like the contract, else the largest."""
    impl = F.col("path").contains("_implementation/")
    side = impl if prefer_implementation else ~impl
    stem = F.regexp_extract("path", r"([^/]+)\.sol$", 1)
    d = files.join(names.select("target_id", "contract_name"), "target_id", "left")
    return keep_first(d, ["target_id"], F.when(side, 0).otherwise(1), F.when(stem == F.coalesce("contract_name", F.lit("")), 0).otherwise(1),
                      -F.length("text"), F.col("path")).select("target_id", "path")


def repository_context(files: DataFrame, max_files: int = 40, max_chars: int = 60000) -> DataFrame:
    """First files of a repository within a file and character budget (a bounded review context)."""
    from pyspark.sql import Window

    w = Window.partitionBy("target_id").orderBy("path")
    d = files.withColumns({"k": F.row_number().over(w)}).where(F.col("k") <= max_files)
    run = Window.partitionBy("target_id").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("used", F.coalesce(F.sum(F.length("text")).over(run), F.lit(0))).where(F.col("used") < max_chars)
    return d.withColumn("text", F.left("text", (F.lit(max_chars) - F.col("used")).cast("int"))).drop("k", "used")
