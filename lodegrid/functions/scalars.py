"""Scalar building blocks as JVM-side Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code markers that enter a pattern signature (lower-cased, spaces removed).
PATTERN_MARKERS = (
    "transferfrom(msg.sender", "safetransferfrom(msg.sender", "require(msg.sender==address(this))", "factory==address(0)",
    "slot0.sqrtpricex96==0", "onlyowner", "onlyrole", "nonreentrant", "initializer", "reinitializer",
)
# Corpus stop words.
STOP_WORDS = tuple((
    "the and for with that this from into can not are was were will would should could because contract function external "
    "public issue vulnerability finding user users owner admin when where there have has had using use used same some only "
    "also lack missing incorrect wrong high medium low critical severity protocol impact attack vector code line file data "
    "value amount token tokens").split())
# Chain name -> chain id.
CHAIN_IDS = {
    "ethereum": 1, "mainnet": 1, "sepolia": 11155111, "arbitrum": 42161, "optimism": 10, "base": 8453, "polygon": 137, "bsc": 56,
    "avalanche": 43114, "avax": 43114, "scroll": 534352, "linea": 59144, "zksync": 324, "zksync-era": 324, "blast": 81457,
    "gnosis": 100, "fantom": 250, "celo": 42220, "mantle": 5000, "mode": 34443, "polygonzkevm": 1101, "arbitrum-nova": 42170,
}
CONFIRMED, LIKELY = "CONFIRMED_CRITICAL", "LIKELY_CRITICAL_NEEDS_POC"
NEEDS, LOW, FALSE_POSITIVE = "NEEDS_MORE_INVESTIGATION", "LOW_OR_INFO", "FALSE_POSITIVE"
REPORTABLE = (CONFIRMED, LIKELY)

def _s(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def norm_title(title: Column) -> Column:
    """Lower-case, hex runs to 0x, digit words to n, whitespace collapsed."""
    t = F.regexp_replace(F.lower(_s(title)), r"0x[0-9a-fA-F]{4,}", "0x")
    t = F.regexp_replace(t, r"\b\d+\b", "n")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def basename(path: Column) -> Column:
    return F.substring_index(F.replace(_s(path), F.lit("\\"), F.lit("/")), "/", -1)


def first_function(functions: Column) -> Column:
    return _s(F.get(functions, F.lit(0)))


def fingerprint(detector: Column, functions: Column, title: Column, file: Column) -> Column:
    return F.sha1(F.concat_ws("|", detector, first_function(functions), norm_title(title), basename(file)))


def squeeze(snippet: Column) -> Column:
    return F.regexp_replace(_s(snippet), r"\s+", "")


def bare_function(functions: Column) -> Column:
    return F.lower(F.regexp_replace(first_function(functions), r"^_+", ""))


def pattern_signature(detector, functions, title, rule_id, bug_class, pattern_class, snippet) -> Column:
    """Address-free pattern key: context for later reviews, never a suppression by itself."""
    low = F.lower(squeeze(snippet))
    marks = F.array_sort(F.filter(F.array(*[F.lit(m) for m in PATTERN_MARKERS]), lambda m: F.contains(low, m)))
    rule = F.coalesce(F.nullif(rule_id, F.lit("")), F.nullif(bug_class, F.lit("")), norm_title(title))
    cls = F.coalesce(F.nullif(pattern_class, F.lit("")), F.nullif(bug_class, F.lit("")), F.lit(""))
    base = F.concat_ws("|", detector, bare_function(functions), rule, cls, F.array_join(marks, ","))
    return F.concat(F.lit("pat:"), F.substring(F.sha1(base), 1, 40))


def body_key(body) -> Column:
    """Hash of a body without white space, whole; empty for an empty one."""
    s = squeeze(F.col(body) if isinstance(body, str) else body)
    return F.when(s != "", F.substring(F.sha1(s), 1, 12)).otherwise(F.lit(""))


def content_key(detector, functions, title, rule_id, snippet, whole=None) -> Column:
    """Path-free key: same detector, function, rule and body. Rows without a snippet share the empty hash.

    ``whole`` is the hash of the whole body where the snippet is only its head.
    """
    h = body_key(snippet) if whole is None else F.coalesce(whole, body_key(snippet))
    return F.concat_ws("|", detector, bare_function(functions), F.coalesce(F.nullif(rule_id, F.lit("")), norm_title(title)), h)


def tokens(text: Column) -> Column:
    """Distinct corpus tokens of a text."""
    words = F.regexp_extract_all(F.lower(_s(text)), F.lit(r"([a-z][a-z0-9_]{3,})"), F.lit(1))
    return F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), x))


def severity(impact: Column) -> Column:
    return (F.when(impact >= 9, "critical").when(impact >= 7, "high").when(impact >= 4, "medium").when(impact >= 2, "low").otherwise("info"))


def confidence_label(conf: Column) -> Column:
    return F.when(conf >= 8, "high").when(conf >= 4, "medium").otherwise("low")


def classify(impact: Column, conf: Column) -> Column:
    return (F.when((impact >= 9) & (conf >= 8), CONFIRMED).when((impact >= 9) & (conf >= 5), LIKELY)
            .when((impact >= 7) & (conf >= 3), NEEDS).otherwise(LOW))


def chain_id(chain: Column) -> Column:
    m = F.create_map(*[x for k, v in CHAIN_IDS.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, F.lower(chain)), F.lit(1))


def toggle(toggles: Column, key: str, default: bool) -> Column:
    """A per-scan toggle, or the default where it is unset."""
    return F.coalesce(F.try_element_at(toggles, F.lit(key)).cast("boolean"), F.lit(default))


def mask(value: Column, head: int = 12, tail: int = 4) -> Column:
    return (F.when(_s(value) == "", "").when(F.length(value) <= head + tail, "***")
            .otherwise(F.concat(F.left(value, F.lit(head)), F.lit("..."), F.right(value, F.lit(tail)))))


def file_slug(text: Column, limit: int = 80) -> Column:
    return F.left(F.regexp_replace(text, r"[^A-Za-z0-9_.-]", "_"), F.lit(limit))


def check_slug(text: Column) -> Column:
    """Tool-check slug: lower-case words joined by dashes, at most 48 characters."""
    s = F.left(F.regexp_replace(F.regexp_replace(F.lower(_s(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", ""), F.lit(48))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("issue"))


def safe_relpath(name: Column) -> Column:
    parts = F.filter(F.split(F.replace(_s(name), F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", ".", ".."))
    path = F.coalesce(F.nullif(F.array_join(parts, "/"), F.lit("")), F.lit("Contract.sol"))
    return F.when(F.endswith(path, F.lit(".sol")), path).otherwise(F.concat(path, F.lit(".sol")))


def json_from_text(content: Column) -> Column:
    """The JSON object inside a chat answer: fenced block, else the outermost braces, else null."""
    fenced = F.regexp_extract(content, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    inner = F.when(fenced != "", fenced).otherwise(content)
    braced = F.regexp_extract(inner, r"(?s)(\{.*\})", 1)
    text = F.when(F.startswith(F.trim(inner), F.lit("{")), inner).when(braced != "", braced).otherwise(inner)
    return F.when(F.try_parse_json(text).isNotNull(), text)


# Fixed value: the tool's summary line.
SUMMARY_LINE = (r"(\d+)\s+probe\(s\)\s+\+\s+(\d+)\s+stateful scenario\(s\)"
                r"(?:\s+\+\s+(\d+)\s+asset probe\(s\)\s+\+\s+(\d+)\s+accounting probe\(s\))?")


def invariant_summary(summary: Column) -> Column:
    """Four counters out of a tool summary line; absent counters are 0."""
    n = lambda g: F.coalesce(F.regexp_extract(_s(summary), SUMMARY_LINE, g).try_cast("int"), F.lit(0))
    return F.struct(n(1).alias("probes"), n(2).alias("stateful"), n(3).alias("assets"), n(4).alias("accounting"))


def due(last: Column, interval: Column, now: Column) -> Column:
    """Never checked, or at least ``interval`` seconds ago."""
    return last.isNull() | (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(last.cast("timestamp")) >= interval)


def trim_text(value: Column, limit: int = 1500) -> Column:
    return F.when(F.length(value) <= limit, value).otherwise(F.concat(F.left(value, F.lit(limit)), F.lit(" …[truncated]")))


def trim_list(value: Column, limit: int = 12, text: int = 1500) -> Column:
    return F.transform(F.slice(value, 1, limit), lambda v: trim_text(v, text))
