"""Benchmark decontamination: rare gapped seeds join texts to items, then Smith-Waterman alignment.

Texts are lower-cased and freed of ASCII punctuation. A seed is two neighbouring words of an item that stand in the text next to each
other or with one word between them. How many of its seeds an item needs follows from the least score (`least_pairs`): say `need` of
them. An item's seeds are ranked by the number of different texts that hold them, over the whole table, and its most common ones are left out
of the join: so many that a text which holds `need` seeds still holds half of `need` among the rest. So no alignment of enough score is
lost, however common a phrase is, and common phrases bring no pairs together.

1. One pass over the texts writes the places of all pairs that a bit map of the items' seeds lets through (fixed size, built by Spark).
2. Their texts are counted by seed; the rare seeds of the items join the places on equality; pairs of document and item with enough
   different seeds are candidates.
3. Candidates are aligned: matching words score 2, others and gaps -1; the score is divided by that of the whole item. Paraphrased and
   edited copies keep much of it.

Defined results: null texts have no words and hold nothing; an item of fewer than n words is found in documents that have exactly its
words and no others; an item without words is never found; null ids are kept as they are; repeated rows are reported each by itself;
items that repeat both id and text count once; empty tables give an empty table; further columns are not read. Memory: the pairs of one
text, the bit map, and 256 items of a text at a time.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .common import free_name, text_of

PUNCTUATION = bytes.maketrans(string.punctuation.encode(), b" " * len(string.punctuation))
MATCH, OTHER, GAP = 2, -1, -1
#: Rows of a batch of places, and items that are aligned with a text at a time.
ROWS, ITEMS = 65_536, 256


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(PUNCTUATION).split()


def hashes(words: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def pairs(h: np.ndarray, apart: int) -> np.ndarray:
    """64-bit hash of each word and the word `apart` places after it, whatever stands between."""
    out = h[:-apart] * np.uint64(0x9E3779B97F4A7C15) + h[apart:]
    out ^= out >> np.uint64(32)
    return out * np.uint64(0xD6E8FEB86659FD93)


def whole(h: np.ndarray) -> np.ndarray:
    """64-bit hash of all words of a short text."""
    return np.frombuffer(xxhash.xxh3_64_digest(h.tobytes(), 7), ">u8").astype(np.uint64)


def align(item: np.ndarray, words: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of the item in the words: score over the item's full score, first and last word (exclusive)."""
    m, n = len(item), len(words)
    above, begins = np.zeros(n + 1), np.arange(n + 1)
    best, span = 0.0, (0, 0)
    ramp = np.arange(n + 1) * -GAP
    for w in item:
        diagonal = above[:-1] + np.where(words == w, MATCH, OTHER)
        up = above[1:] + GAP
        row = np.concatenate([[0.0], np.maximum(np.maximum(diagonal, up), 0)])
        start = np.concatenate([[0], np.where(diagonal >= up, begins[:-1], begins[1:])])
        fresh = np.flatnonzero(row == 0)
        start[fresh] = fresh
        lifted = row + ramp
        top = np.maximum.accumulate(lifted)
        source = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row, begins = top - ramp, start[source]
        above = row
        at = int(row.argmax())
        if row[at] > best:
            best, span = float(row[at]), (int(begins[at]), at)
    return best / (MATCH * m), *span


def least_pairs(words: int, least: float) -> int:
    """Neighbours among an item's words that any alignment with this share of its score finds with at most one word between them.

    Of two words matched one after the other, with a words of the item and b of the text left out between them, the alignment loses
    max(a, b). With M matches, 2M less all of these is 2 * words * least at least, and M plus all a is `words` at most: so the sum of
    max(a, b) + a is at most M + words * (1 - 2 * least). Pairs other than a = 0, b <= 1 have two or more of it, and M is words * least
    at least.
    """
    return max(1, math.ceil(words * (1.5 * least - 0.5) - 1 - 1e-9))


def seeds_of(h: np.ndarray, n: int, least: float) -> tuple[np.ndarray, int]:
    """An item's seeds, and how many of them a text that holds it has. Short items have one, of all their words."""
    if len(h) < n:
        return (whole(h), 1) if len(h) else (np.zeros(0, np.uint64), 1)
    return pairs(h, 1), least_pairs(len(h), least)


def seeds_in(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed, place) of all pairs of a text, and of the whole text where it is short."""
    found = [(k, np.arange(len(k))) for k in ((pairs(h, 1), pairs(h, 2)) if len(h) > 1 else ())]
    if 0 < len(h) < n:
        found.append((whole(h), np.zeros(1, np.int64)))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


class Text:
    """A text's words and pairs, against which items are aligned one by one."""

    def __init__(self, body: str, n: int, least: float):
        self.h, self.n, self.least = hashes(words_of(body)), n, least
        seed, place = seeds_in(self.h, n)
        order = np.lexsort((place, seed))
        self.seed, self.place = seed[order], place[order]

    def best(self, item: np.ndarray) -> tuple[float, int, int] | None:
        """(score, first word, last word exclusive) if the text holds the item.

        An alignment that scores enough takes no more words of the text than two times the item's, so its seeds stand that close.
        """
        size = len(item)
        if size < self.n:
            return (1.0, 0, size) if np.array_equal(item, self.h) else None
        seeds, need = seeds_of(item, self.n, self.least)
        lo, hi = np.searchsorted(self.seed, seeds), np.searchsorted(self.seed, seeds, "right")
        many = hi - lo
        at = np.repeat(np.arange(len(seeds)), many)
        place = self.place[np.arange(many.sum()) + np.repeat(lo - np.cumsum(many) + many, many)]
        order = np.argsort(place, kind="stable")
        at, place = at[order], place[order]
        first = np.arange(max(0, len(place) - need + 1))
        begins = place[first[place[first + need - 1] - place[first] <= 2 * size]]
        best = (0.0, 0, 0)
        for part in np.split(begins, np.flatnonzero(np.diff(begins) > 4 * size) + 1) if len(begins) else ():
            a, e = max(0, int(part[0]) - 2 * size), int(part[-1]) + 2 * size + 2
            if len(np.unique(at[np.searchsorted(place, a) : np.searchsorted(place, e)])) >= need:
                score, x, y = align(item, self.h[a:e])
                best = max(best, (score, a + x, a + y))
        return best if best[0] >= self.least else None


def item_table(items: DataFrame, item: str, text: str, n: int, least: float) -> DataFrame:
    """One row per different item with words: no, item, words and seeds (64-bit hashes, signed), need."""
    shape = T.StructType([T.StructField("item", items.schema[item].dataType), T.StructField("words", T.ArrayType(T.LongType())), T.StructField("seeds", T.ArrayType(T.LongType())), T.StructField("need", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = [hashes(words_of(x.as_py())) for x in b.column(1)]
            seeds = [seeds_of(h, n, least) for h in words]
            lists = lambda hs: pa.array([h.view(np.int64) for h in hs], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists(words), lists([s for s, _ in seeds]), pa.array([k for _, k in seeds], pa.int32())], shape.names)

    table = items.select(items[item].alias("item"), text_of(items, text).alias("body")).distinct().mapInArrow(run, shape)
    return stored(table.where(F.size("words") > 0).withColumn("no", F.monotonically_increasing_id()))[0]


def bit_map(seeds: DataFrame, bits: int) -> bytes:
    """2^bits bits, set where the first bits of a seed say: 2 MB for 24 bits, however many seeds there are."""
    at = F.shiftrightunsigned("seed", 64 - bits) + 1
    rows = seeds.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bitmap")).collect()
    out = bytearray(1 << bits - 3)
    for r in rows:
        out[(r["bucket"] - 1) * 4096 : (r["bucket"] - 1) * 4096 + len(r["bitmap"])] = r["bitmap"]
    return bytes(out)


def places(texts: DataFrame, flags: bytes, bits: int, n: int) -> DataFrame:
    """(row, seed) of the pairs of each text (row, text) whose bit is set, repeats of a text left out."""
    spark: SparkSession = texts.sparkSession
    held = spark.sparkContext.broadcast(flags)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flag, shift = np.unpackbits(np.frombuffer(held.value, np.uint8), bitorder="little").view(bool), np.uint64(64 - bits)
        rows, seeds, many = [], [], 0

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(rows)), pa.array(np.concatenate(seeds).view(np.int64))], ["row", "seed"])
            rows.clear()
            seeds.clear()
            return out

        for b in batches:
            for row, x in zip(b.column(0).to_numpy(), b.column(1)):
                seed, _ = seeds_in(hashes(words_of(x.as_py())), n)
                seed = np.unique(seed[flag[seed >> shift]])
                if len(seed):
                    rows.append(np.full(len(seed), row, np.int64))
                    seeds.append(seed)
                    many += len(seed)
                    if many >= ROWS:
                        many = 0
                        yield batch()
        if rows:
            yield batch()

    return texts.mapInArrow(run, "row long, seed long")


def candidates(items: DataFrame, found: DataFrame) -> DataFrame:
    """(row, no): pairs that can reach the least score, by the rare seeds of the items."""
    often = found.groupBy("seed").agg(F.count(F.lit(1)).alias("often"))
    seeds = items.select("no", "need", F.size("seeds").alias("n"), F.posexplode("seeds").alias("at", "seed"))
    order = Window.partitionBy("no").orderBy(F.coalesce("often", F.lit(0)), "seed", "at")
    half = F.greatest(F.lit(1), F.floor(F.col("need") / 2)).cast("int")
    rare = seeds.join(often, "seed", "left").withColumn("rank", F.row_number().over(order)).withColumn("half", half)
    rare = rare.where(F.col("rank") <= F.col("n") - F.col("need") + F.col("half"))
    # a seed that an item has several times counts as often
    rare = rare.groupBy("seed", "no", "half").agg(F.count(F.lit(1)).alias("times"))
    met = found.join(rare, "seed").groupBy("row", "no", "half").agg(F.sum("times").alias("times"))
    return met.where(F.col("times") >= F.col("half")).select("row", "no")


def matches(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = 4, least: float = 0.5, bits: int = 24) -> DataFrame:
    """(key, item, score, start, end): documents that hold an item, whole or edited, with the share of its score and the words it
    takes. `least` is 0.5 or more: below, an alignment may do without any two neighbours. Texts are known by a hash between the steps, so
    copies are joined once; texts that share one are only aligned with each other's items, too."""
    if least < 0.5 or n < 4:
        raise ValueError("least has to be 0.5 or more, n 4 or more")
    table = item_table(items, item, item_text, n, least)
    body = text_of(docs, text)
    source = docs.select(docs[key].alias("key"), F.xxhash64(body).alias("row"), body.alias("text"))
    flags = bit_map(table.select(F.explode("seeds").alias("seed")), bits)
    found, _ = stored(places(source.select("row", "text"), flags, bits, n).distinct())
    met = candidates(table, found).join(table.select("no", "item", "words"), "no")
    piece = F.floor((F.row_number().over(Window.partitionBy("row").orderBy("no")) - 1) / ITEMS)
    lists = met.withColumn("piece", piece).groupBy("row", "piece").agg(F.collect_list(F.struct("item", "words")).alias("items"))
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("item", items.schema[item].dataType), T.StructField("score", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, words = b.column(3).values.field(0), b.column(3).values.field(1)
            offsets = b.column(3).offsets.to_pylist()
            which, held, found = [], [], []
            for i in range(b.num_rows):
                body = Text(b.column(2)[i].as_py(), n, least)
                for k in range(offsets[i], offsets[i + 1]):
                    best = body.best(np.array(words[k].as_py(), np.int64).view(np.uint64))
                    if best is not None:
                        which.append(i)
                        held.append(k)
                        found.append(best)
            if found:
                rows = pa.array(which, pa.int64())
                scores, starts, ends = zip(*found)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), ids.take(pa.array(held, pa.int64())), pa.array(scores, pa.float64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], schema.names)

    found = source.join(lists, "row").select("key", "row", "text", "items").mapInArrow(run, schema)
    return found.select(F.col("key").alias(key), F.col("item").alias(item), "score", "start", "end")


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item: all columns. `docs` is a stored table: rows are numbered in the order of its files."""
    row = free_name(docs, "row_number")
    numbered = docs.withColumn(row, F.monotonically_increasing_id())
    found = matches(numbered, items, row, text, item, item_text).select(row).distinct()
    return numbered.join(found, row, "left_anti").drop(row)
