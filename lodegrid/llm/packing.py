"""Packing by power-of-two decomposition (dataset decomposition).

A document of n tokens is cut into pieces whose lengths are the binary digits of n: whole sequences of the largest length first, then
one piece for each set bit. Every piece is a sequence of its own, so no sequence crosses documents and none needs padding; pieces of
equal length share a bucket, from which a trainer draws batches of one shape.

Tokens come from a public vocabulary file whose path is a parameter; nothing is trained. White space never reaches a token of this
vocabulary, so a text is encoded word by word and each task keeps the ids of words it has met (bounded, then emptied).

Defined results: a null or empty text is the end token alone; repeated rows are packed each by itself; an empty table gives no pieces;
further columns are not read. Memory holds one batch of documents and the word tables; a long document is cut like any other.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Characters that only one of str.split and the tokenizer's own white-space class takes as white space.
ODD_SPACES = "\x1c\x1d\x1e\x1f"
SPECIAL = "<|"


#: Words of these characters (printable ASCII but the apostrophe, and Latin-1 letters) are normalised and split without the library.
PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]+")
UNITS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_letters() -> dict[int, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others take the code points from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(other)}


class WordEncoder:
    """Ids of a text, as the tokenizer gives them for the whole text; words and their parts are looked up before they are encoded.

    Each table has two generations: when the new one is full it becomes the old one, from which words in use are taken over.
    """

    def __init__(self, path: str, words: int = 200_000, units: int = 200_000):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.words, self.old_words, self.max_words = {}, {}, words
        self.units, self.old_units, self.max_units = {}, {}, units
        self.letters = byte_letters()

    def whole(self, text: str) -> bytes:
        return array("I", self.t.encode(text, add_special_tokens=False).ids).tobytes()

    def split(self, word: str) -> list[str]:
        """The parts of a word that are encoded by themselves, in the byte-level alphabet."""
        if PLAIN.fullmatch(word):
            found = UNITS.findall(word.lower())
            return found if word.isascii() else [u.encode().decode("latin-1").translate(self.letters) for u in found]
        return [u for u, _ in self.t.pre_tokenizer.pre_tokenize_str(self.t.normalizer.normalize_str(word))]

    def unit(self, unit: str) -> bytes:
        ids = self.units.get(unit)
        if ids is None:
            ids = self.old_units.get(unit)
            if ids is None:
                ids = array("I", [x.id for x in self.t.model.tokenize(unit)]).tobytes()
            if len(self.units) >= self.max_units:
                self.old_units, self.units = self.units, {}
            self.units[unit] = ids
        return ids

    def word(self, word: str) -> bytes:
        ids = self.old_words.get(word)
        if ids is None:
            ids = self.whole(word) if SPECIAL in word else b"".join(map(self.unit, self.split(word)))
        return ids

    def ids(self, text: str) -> bytes:
        """Unsigned 32-bit ids in the machine's byte order (little-endian on the machines Spark runs on; checked below)."""
        if any(c in text for c in ODD_SPACES):
            return self.whole(text)
        words = text.split()
        known = self.words
        if new := set(words).difference(known):
            if len(known) + len(new) > self.max_words:
                self.old_words, self.words = known, {}
                known, new = self.words, set(words)
            for w in new:
                known[w] = self.word(w)
        return b"".join(map(known.__getitem__, words))


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker and vocabulary."""
    if sys.byteorder != "little" or array("I").itemsize != 4:
        raise RuntimeError("ids are written as little-endian 32-bit numbers")
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cuts(n: int, most: int) -> list[int]:
    """Lengths of the pieces of n tokens: `most` as often as it goes in, then the binary digits of the rest, large ones first."""
    rest = n % most
    return [most] * (n // most) + [1 << b for b in range(most.bit_length() - 2, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, vocabulary: str | None = None, most: int = 4096, end: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket (log2 of length), sequence_id, offset.

    `most` is a power of two. A piece fills its sequence, so offset is 0 throughout. sequence_id is unique: the number of the input
    partition and the place there; the only step is a map over the input, and a lost task makes the same pieces again.
    """
    if most & (most - 1):
        raise ValueError("the sequence length has to be a power of two")
    kind = docs.schema[key].dataType
    named = vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = named
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        enc, tail = encoder(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows: list[tuple] = []
                part = batch.slice(lo, 256)
                for i, body in enumerate(part.column(1).to_pylist()):
                    ids = enc.ids(body) + tail
                    n, start = len(ids) // 4, 0
                    for size in cuts(n, most):
                        rows.append((i, start, size, ids[4 * start : 4 * (start + size)], n, size.bit_length() - 1))
                        start += size
                at, start, size, ids, n, bucket = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(bucket, pa.int32())],
                    ["key", "start", "length", "ids", "doc_tokens", "bucket"],
                )

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("key", kind)] + [T.StructField(n, t) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("bucket", T.IntegerType()))])
    pieces = docs.select(docs[key].alias("key"), text_of(docs, text).alias("text")).mapInArrow(run, schema)
    return pieces.select(F.col("key").alias(key), "start", "length", "ids", "doc_tokens", "bucket", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Pieces as Parquet, one folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)
