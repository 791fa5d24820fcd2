"""URL filter: a blocked Bloom filter in front of an exact hash join.

Listed keys set eight bits in one 256-bit block each. The filter is a small table (block, four words) that is sent to every task; its
size has a fixed bound, so a very long list makes it let more pass, never lose one. Keys that pass meet the list in an exact equality
join, which removes the false positives.

Two lists go through it: host/path rules (allow and block; all host suffixes and the listed path lengths of a URL are looked up; the
longest rule wins) and listed canonical URLs (block). A rule's verdict goes before the list's.

Defined results: a null URL or one without "://" has an empty host and path, no rule, and verdict allow; repeated rows are kept; an
empty table gives an empty table; further columns are not read. Every different URL is judged once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower

#: Query parameters that name a campaign, not a page.
TRACKING = "utm_[a-z]+|ref|fbclid|gclid"


def host_path(url: Column) -> tuple[Column, Column]:
    start = F.instr(url, "://")
    rest = F.when(start > 0, F.substring(url, start + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return ascii_lower(host), path


def canonical(url: Column) -> Column:
    """Host without www., path without a closing slash, query without campaign parameters; no scheme, no fragment. Empty if there is no host."""
    host, path = host_path(url)
    asked = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(asked, "&"), lambda p: (p != "") & ~p.rlike(f"^({TRACKING})="))
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit(""))
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, "/+$", ""), tail)).otherwise(F.lit(""))


def _shift(c: Column, by: Column) -> Column:
    return F.call_function("shiftleft", c, by)


def _bits(key: Column, blocks: int) -> list[Column]:
    """The key's block and its four 64-bit masks, two bits in each."""
    a, b = F.xxhash64(key), F.xxhash64(key, F.lit(1))
    bit = lambda at: _shift(F.lit(1).cast("long"), F.shiftrightunsigned(b, at).bitwiseAND(63).cast("int"))
    two = [bit(12 * i).bitwiseOR(bit(12 * i + 6)) for i in range(4)]
    return [F.pmod(a, F.lit(blocks)).alias("block")] + [m.alias(f"w{i}") for i, m in enumerate(two)]


def _shift(c: Column, by: Column) -> Column:
    return F.call_function("shiftleft", c, by)


def bloom(keys: DataFrame, blocks: int = 8192) -> DataFrame:
    """Filter of the column `key`: at most `blocks` rows of 40 bytes (8192: 320 KB), whatever the list's length."""
    marked = keys.select(*_bits(F.col("key"), blocks))
    return marked.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"f{i}") for i in range(4)])


def passing(keys: DataFrame, filt: DataFrame, blocks: int = 8192) -> DataFrame:
    """Rows of `keys` whose `key` may be listed. The filter is broadcast; its size is bounded by `blocks`."""
    probe = keys.select("*", *_bits(F.col("key"), blocks)).join(F.broadcast(filt), "block")
    hit = F.lit(True)
    for i in range(4):
        hit = hit & (F.col(f"f{i}").bitwiseAND(F.col(f"w{i}")) == F.col(f"w{i}"))
    return probe.where(hit).select(*keys.columns)


def rule_keys(url_parts: DataFrame, lengths: list[int]) -> DataFrame:
    """(url, key) with every host suffix and every listed path length of a URL; `lengths` are those that occur in the rules."""
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tails = F.filter(F.array(*[F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths]), lambda p: p.isNotNull())
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(tails, lambda p: F.concat(h, F.lit("\n"), p))))
    return url_parts.where("host != ''").select("url", F.explode(F.array_distinct(pairs)).alias("key"))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame, lengths: list[int], url: str = "url", blocks: int = 8192) -> DataFrame:
    """All columns `url` of `pages`, each different one once, with host, path, rule and verdict.

    rules: (host, path, verdict); lengths: the different lengths of the rules' paths. listed: (canonical), any number of rows.
    """
    host, path = host_path(F.col("url"))
    urls = pages.select(F.col(url).alias("url")).where("url IS NOT NULL").distinct()
    urls = urls.select("url", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canonical"))

    table = rules.select(F.concat("host", F.lit("\n"), "path").alias("key"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("decided"))
    found = passing(rule_keys(urls, lengths), bloom(table, blocks), blocks).join(table, "key")
    best = found.groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("decided"), F.col("rule"))).alias("best"))

    names = listed.where("canonical != ''").select(F.col("canonical").alias("key")).distinct()
    maybe = passing(urls.where("canonical != ''").select("url", F.col("canonical").alias("key")), bloom(names, blocks), blocks)
    hits = maybe.join(names, "key", "left_semi").select("url", F.lit(True).alias("in_list"))

    return urls.join(best, "url", "left").join(hits, "url", "left").select(
        "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.decided", F.when(F.col("in_list"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), F.coalesce("in_list", F.lit(False)).alias("listed")
    )


def filter_pages(pages: DataFrame, rules: DataFrame, listed: DataFrame, lengths: list[int], key: str = "page_id", url: str = "url") -> DataFrame:
    """Every page with host, path, rule, verdict and whether its canonical URL is listed."""
    verdicts = judge(pages, rules, listed, lengths, url).withColumnRenamed("url", "judged")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("url"))
    return rows.join(verdicts, rows["url"] == verdicts["judged"], "left").select(
        F.col("key").alias(key), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed")
    )
