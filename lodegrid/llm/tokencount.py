"""Token counts by the whole-token shortcut.

Before a text is read, every string of the vocabulary is encoded by itself: it is *whole* if the pre-tokenizer leaves it in one part and
the merges turn that part into one token. A text is cut into pre-tokens; those that are whole count one without any merge, only the rest
go through the merges, once for each different pre-token a task has lately met.

Pre-tokens are cut by this vocabulary's public pattern. The library's own tables know fewer letters of newer scripts than the pattern's
engine, so a text with a character outside `PROVEN` is cut by the library's pre-tokenizer; the tests hold both against each other over
these ranges. Special strings in a text are one token each and part what stands beside them, as the library does by default.

Defined results: a null text is empty; an empty text has no bytes and no tokens; a null key stays null; repeated rows are counted each by
itself; an empty table gives an empty table; further columns are not read. Memory: one text, its pre-tokens in sections of about
`SECTION` characters, and the tables of lengths; a section ends only where a pre-token ends, and one without such a place is read on
lazily. A pre-token of any length is merged whole, since merges may join any two neighbours in it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

#: Ranges of characters in which pattern and library agree on letters, numbers and white space.
PROVEN = ((0x0, 0x52F), (0x5D0, 0x5EA), (0x600, 0x6FF), (0x900, 0x97F), (0xE00, 0xE7F), (0x1E00, 0x1FFF), (0x2000, 0x206F), (0x20A0, 0x20BF), (0x2100, 0x2BFF), (0x3000, 0x9FFF), (0xAC00, 0xD7A3), (0xFF00, 0xFFEF), (0x1F300, 0x1FAFF))
#: The pattern that comes with the vocabulary (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SECTION = 1 << 18
#: Lengths of pre-tokens of at most so many characters are kept.
KEPT_CHARS = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable ones for themselves, the others from code point 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(other)) for b in range(256)]


class Lengths(dict):
    """Tokens of a pre-token; what is missing is merged. Whole tokens stay; the others are kept in two generations of `most`."""

    def __init__(self, model, whole: set[str], letters: list[str], most: int = 200_000):
        super().__init__()
        self.model, self.letters, self.most, self.whole, self.old, self.merged = model, letters, most, whole, {}, 0

    def __missing__(self, part: str) -> int:
        if part in self.whole:
            n = 1
        elif (n := self.old.get(part)) is None:
            n = len(self.model.tokenize("".join(map(self.letters.__getitem__, part.encode()))))
            self.merged += 1
        if len(part) <= KEPT_CHARS:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[part] = n
        return n


class Counter:
    """Counts tokens as the library's `encode` gives them without added tokens."""

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        cutter = said["pre_tokenizer"] or {}
        if said["model"]["type"] != "BPE" or said["normalizer"] or cutter.get("type") != "ByteLevel" or cutter.get("add_prefix_space") or not cutter.get("use_regex", True):
            raise ValueError("the shortcut is for byte-level BPE vocabularies that are cut by the public pattern")
        special = said["added_tokens"]
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in special):
            raise ValueError("special strings that reach beyond themselves are not supported")
        self.special = re.compile("|".join(re.escape(x["content"]) for x in sorted(special, key=lambda x: -len(x["content"])))) if special else None
        self.pattern = regex.compile(PATTERN)
        self.odd = re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in PROVEN) + "]")
        self.letters = byte_letters()
        self.back = {c: bytes([b]) for b, c in enumerate(self.letters)}
        self.lengths = Lengths(self.t.model, self.proven_whole(said["model"]["vocab"]), self.letters)

    def proven_whole(self, vocabulary: dict[str, int]) -> set[str]:
        """Strings of the vocabulary that stand alone as one pre-token and as one token."""
        out = set()
        for token in vocabulary:
            try:
                plain = b"".join(map(self.back.__getitem__, token)).decode()
            except (KeyError, UnicodeDecodeError):
                continue  # part of a character: never a pre-token
            if len(self.t.pre_tokenizer.pre_tokenize_str(plain)) == 1 and len(self.t.model.tokenize(token)) == 1:
                out.add(plain)
        return out

    def parts(self, text: str) -> Iterator[Iterator[str] | list[str]]:
        """Pre-tokens, a section at a time. White space after another character always begins a pre-token, so sections end there."""
        if not text.isascii() and self.odd.search(text):
            yield (text[a:b] for _, (a, b) in self.t.pre_tokenizer.pre_tokenize_str(text))
            return
        at, end = 0, len(text)
        while at < end:
            to = min(at + SECTION, end)
            if to < end:
                while to > at and not (text[to] in " \n" and text[to - 1] > " " and not text[to - 1].isspace()):
                    to -= 1
                if to == at:
                    yield (m.group() for m in self.pattern.finditer(text, at))
                    return
            yield self.pattern.findall(text[at:to])
            at = to

    def count(self, text: str) -> int:
        sections = [text]
        n = 0
        if self.special is not None and self.special.search(text):
            sections = self.special.split(text)
            n = len(sections) - 1
        of = self.lengths.__getitem__
        return n + sum(sum(map(of, found)) for s in sections if s for found in self.parts(s))


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each Python worker and vocabulary."""
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def counts(docs: DataFrame, vocabulary: str | None = None, limit: int = 512, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key, n_bytes, n_tokens, over_limit (more than `limit` tokens). A map over the input: nothing is shuffled.

    `vocabulary` is the path of a tokenizer file on every executor; None takes the public byte-level one.
    """
    named = vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = named
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        of = counter(path).count
        for b in batches:
            found = [of(x.as_py()) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.int64())], ["key", "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    body = text_of(docs, text)
    rows = docs.select(docs[key].alias("key"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    return rows.mapInArrow(run, schema).select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
