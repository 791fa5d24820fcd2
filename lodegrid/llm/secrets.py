"""Secret scan: fixed patterns, and novelty against a dictionary-primed compressor.

Base patterns (assign, access, hex) are matched over the whole text. The method then looks at every string of twelve characters or more
with a sensitive word shortly before it, at the strings that follow a reported one after white space, and at the lines of private keys: how many bytes does a zstandard frame grow when the string is appended to its surroundings, given a dictionary of
identifiers? Other copies of the string itself are left out of its surroundings, so a key that stands twice is no known word. Words and
identifiers in the dictionary, or made of what occurs nearby, cost little; keys cost about a byte for each character and
are reported as `novel`.

The identifier dictionary is counted over all documents: the most frequent names in front of `=`, `:` or `(`, at most `names` of them
(its size bound, a parameter); it is the only thing sent to the tasks.

Defined results: null text is the empty text and has no spans; a long text is scanned whole, in time that goes with its length and spans; repeated rows are scanned each by itself; an empty table gives an empty
table; further columns are kept by `redact` and not read by `scan`. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|key|credential|bearer|auth|private", re.I | re.A)
#: What may stand between the lines of one key, escaped line ends included; and the blocks of private keys with their header lines.
BETWEEN = re.compile(r"[\s\\]+")
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY[A-Z ]*-----.*?(?:-----END|\Z)", re.S)
#: Cheap tests: a text with none of these words (lower-cased) has no match of ASSIGN.
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
NAME = r"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]{2,31}+)[\"']?\x20*[:=(]"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns; matches of a kind don't overlap, short ones are dropped."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


class Novelty:
    """Marginal compressed bytes of a string after its surroundings, per character."""

    def __init__(self, names: list[str], level: int = 3):
        import zstandard

        words = "\n".join(reversed(names)).encode() or b"password = token = secret = api_key"  # frequent ones last: nearest to the data
        self.c = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)

    def of(self, around: str, found: str) -> float:
        a = around.encode()
        return (len(self.c.compress(a + found.encode())) - len(self.c.compress(a))) / len(found)


def surroundings(text: str, s: int, e: int, around: int) -> str:
    """`around` characters before s and after e, without other copies of text[s:e] or of its parts between `=` (of 12 characters or more)."""
    more = around + e - s  # a copy that the window would cut is seen whole
    before, after = text[max(0, s - more) : s], text[e : e + more]
    found = text[s:e]
    for part in [found, *(x for x in found.split("=") if len(x) >= 12)]:
        before, after = before.replace(part, " "), after.replace(part, " ")
    return before[-around:] + after[:around]


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty, least: float, near: int, around: int) -> list[tuple[int, int, int]]:
    """Candidates not inside a base span that cost `least` bytes a character and have a sensitive word at most `near` characters before
    them, or only white space between them and a reported span, or stand in the block of a private key."""
    out, done = [], -1
    base = sorted(base)
    starts, reach = [b for b, _, _ in base], list(accumulate((e for _, _, e in base), max))  # how far the spans so far reach
    blocks = [m.span() for m in KEY_BLOCK.finditer(text)] if "PRIVATE KEY" in text else []
    block_starts = [b for b, _ in blocks]  # blocks don't overlap
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        at = bisect_right(starts, s)
        block = bisect_left(block_starts, s) - 1
        if at and reach[at - 1] >= e:
            done = reach[at - 1]
        elif SENSITIVE.search(text, max(0, s - near), s) or (done >= 0 and BETWEEN.fullmatch(text, done, s)) or (block >= 0 and s < blocks[block][1]):
            if novelty.of(surroundings(text, s, e, around), m[0]) >= least:
                out.append((s, 3, e))
                done = e
    return out


def identifiers(docs: DataFrame, text: str = "text", names: int = 2000) -> list[str]:
    """The most frequent names in front of an assignment or a call, over all documents; ties by name. At most `names` short strings."""
    found = docs.select(F.explode(F.regexp_extract_all(text_of(docs, text), F.lit(NAME), 1)).alias("name"))
    top = found.groupBy("name").count().orderBy(F.desc("count"), "name").limit(names)
    return [r["name"] for r in top.collect()]


def _scan(docs: DataFrame, keep: list[str], text: str, names: list[str], least: float, near: int, around: int, replace: str | None) -> DataFrame:
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    fields = [T.StructField(f"__{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*fields, T.StructField("__spans", T.ArrayType(span)), T.StructField("__text", T.StringType())])
    arrow_span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(names)
        for batch in batches:
            spans, texts = [], []
            for body in batch.column(len(keep)).to_pylist():
                base = base_spans(body)
                every = sorted(base + novel_spans(body, base, novelty, least, near, around))
                spans.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in every])
                texts.append(masked(body, every, replace) if replace is not None and every else None)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(spans, arrow_span), pa.array(texts, pa.string())], schema.names)

    rows = docs.select(*[docs[c].alias(f"__{i}") for i, c in enumerate(keep)], text_of(docs, text).alias("__body"))
    return rows.mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """The text with each union of overlapping spans replaced by `mark`."""
    out, done, end = [], 0, -1
    for s, _, e in spans:
        if s >= end:
            out += [text[done:s], mark]
            done = end = e
        elif e > end:
            done = end = e
    return "".join(out) + text[done:]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", names: int = 2000, least: float = 0.6, near: int = 48, around: int = 256) -> DataFrame:
    """One row per document: key and `spans`, an array of (kind, start, end) by start, then kind."""
    found = _scan(docs, [key], text, identifiers(docs, text, names), least, near, around, None)
    return found.select(F.col("__0").alias(key), F.col("__spans").alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[secret]", names: int = 2000, least: float = 0.6, near: int = 48, around: int = 256) -> DataFrame:
    """All columns of the documents; spans in the text are replaced by `mark`, texts without any stay as they are (null stays null)."""
    found = _scan(docs, docs.columns, text, identifiers(docs, text, names), least, near, around, mark)
    cols = {c: F.col(f"__{i}") for i, c in enumerate(docs.columns)}
    cols[text] = F.coalesce("__text", cols[text])
    return found.select(*[v.alias(c) for c, v in cols.items()])
