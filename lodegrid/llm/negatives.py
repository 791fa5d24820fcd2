"""Hard-negative mining with exact integer scores from a residue number system.

A component x is the integer floor(scale * x); the score of two vectors is their integer inner product. Component matrices are reduced
modulo several small primes and multiplied in float32: a block of `BLOCK` products of two centred residues stays below 2^24, so each
block is exact. Garner's form of the Chinese remainder theorem turns the residues of a score into its centred mixed-radix digits, which
give the signed score. As many primes are taken as the norms at hand ask for (Cauchy and Schwarz bound every score).

Anchors (rows whose key is divisible by `every`) meet all rows in a grid of blocks: a cell is one block of anchors and one of rows, each
of bounded size, dealt by a hash of the key, so a common label or a crowd of copies is spread over all cells. A cell returns the best few
of each anchor. First the positives of an anchor (its best rows of the same label), then, for each positive, the best rows of other
labels whose score lies in the window that the positive's score sets; both are cut to their ranks by a window over the cells' rows.

Defined results: rows with a null key, label or vector, an empty vector, or a null or non-finite component (before or after scaling)
take no part; rows that repeat a key count as one, the one with the smallest label, then vector; a vector meets only those of its own
length; equal scores go to the smaller key; an anchor without positives and a positive without negatives give no rows; zero vectors
score 0; scores beyond 62 bits raise; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Products that are added in float32 before they are reduced.
BLOCK = 64
#: Rows and anchors of one cell, about; scores that a task holds at once.
ROWS, ANCHORS, HELD = 32_768, 4_096, 1 << 22
#: Scores and the places behind them have to fit here.
MOST = 1 << 62


def primes(block: int = BLOCK) -> list[int]:
    """Odd primes, large ones first, for which `block` products of centred residues stay below 2^24."""
    top = 2 * int(((1 << 24) / block) ** 0.5) + 1
    while block * ((top - 1) // 2) ** 2 >= 1 << 24:
        top -= 1
    sieve = np.ones(top + 1, bool)
    sieve[:2] = False
    for i in range(2, int(top**0.5) + 1):
        if sieve[i]:
            sieve[i * i :: i] = False
    return [int(p) for p in np.flatnonzero(sieve)[::-1] if p > 2]


PRIMES = primes()


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """x modulo p between -(p-1)/2 and (p-1)/2; whole numbers below 2^24 in float32, any in float64."""
    x = x - np.float32(p) * np.rint(x / np.float32(p))
    return x - np.float32(p) * np.rint(x / np.float32(p))  # a quotient near a half may have been rounded to the wrong side


def residues(c: np.ndarray, p: int) -> np.ndarray:
    return centred(np.fmod(c, p), p).astype(np.float32)


def moduli(bound: float) -> list[int]:
    """The first primes whose product exceeds all differences of scores up to `bound`."""
    if not bound < MOST:
        raise OverflowError("scores need more than 62 bits")
    out, product = [], 1
    for p in PRIMES:
        out.append(p)
        product *= p
        if product > 2 * int(bound * (1 + 1e-9)) + 2:
            return out
    raise OverflowError("scores need more primes than there are")


class Product:
    """Exact scores of anchors (rows of `a`) and rows of `b`, whole numbers in float64, a slice of anchors at a time."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        self.bound = float(np.sqrt((a * a).sum(1).max() * (b * b).sum(1).max()))
        self.p = moduli(self.bound)
        self.a = [residues(a, p) for p in self.p]
        self.b = [np.ascontiguousarray(residues(b, p).T) for p in self.p]

    def scores(self, some: slice | np.ndarray, columns: slice | np.ndarray = slice(None)) -> np.ndarray:
        digits: list[np.ndarray] = []
        for k, p in enumerate(self.p):
            a, b = self.a[k][some], self.b[k][:, columns]
            e = np.float32(0)
            for lo in range(0, a.shape[1], BLOCK):
                e = centred(e + centred(a[:, lo : lo + BLOCK] @ b[lo : lo + BLOCK], p), p)
            for q, d in zip(self.p, digits):  # what the digits so far leave, divided by their primes
                inverse = np.float32(pow(q, -1, p))
                e = centred((e - d) * centred(inverse, p), p)
            digits.append(e)
        out = digits[-1].astype(np.int64)
        for q, d in zip(self.p[-2::-1], digits[-2::-1]):
            out *= q
            out += d.astype(np.int64)
        return out


def ordered(score: np.ndarray, good: np.ndarray, bound: float, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, column, how many) of the good entries of each line, best first, ties by column; `most` of them where given."""
    n = score.shape[1]
    if (bound + 1) * n < MOST:
        key = np.where(good, score * n + np.arange(n - 1, -1, -1), np.iinfo(np.int64).min)
        if most is not None and most < n:
            key = np.partition(key, n - most, axis=1)[:, n - most :]
        key = np.sort(key, axis=1)[:, ::-1]
        return key // n, n - 1 - key % n, np.minimum(good.sum(1), key.shape[1])
    at = np.argsort(np.where(good, -score, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :most]
    return np.take_along_axis(score, at, 1), at, np.minimum(good.sum(1), at.shape[1])


def components(column: pa.ChunkedArray, scale: float) -> np.ndarray:
    """Lists of one length as whole numbers in float64."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return np.floor(scale * flat).reshape(len(column), -1)


def by_length(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple[pa.Table, pa.Table, np.ndarray, np.ndarray]]:
    """Anchors and rows of each length (rows by key), with numbers that stand for their labels."""
    a_len, r_len = pc.list_value_length(anchors["v"]), pc.list_value_length(rows["v"])
    for size in pc.unique(a_len).to_pylist():
        a, r = anchors.filter(pc.equal(a_len, size)), rows.filter(pc.equal(r_len, size))
        if a.num_rows and r.num_rows:
            r = r.take(pc.sort_indices(r["id"]))
            names = pa.concat_arrays([a["label"].combine_chunks(), r["label"].combine_chunks()])
            code = names.dictionary_encode().indices.to_numpy()
            yield a, r, code[: a.num_rows], code[a.num_rows :]


def positives_of(anchors: pa.Table, rows: pa.Table, scale: float, k: int) -> Iterator[tuple]:
    """(anchor, row, score) arrays: the k best rows of an anchor's own label in this cell, the anchor itself left out."""
    for a, r, a_label, r_label in by_length(anchors, rows):
        a_id, r_id = a["id"].to_numpy(), r["id"].to_numpy()
        product = Product(components(a["v"], scale), components(r["v"], scale))
        for label in np.unique(a_label):
            mine, theirs = np.flatnonzero(a_label == label), np.flatnonzero(r_label == label)
            for lo in range(0, len(mine) if len(theirs) else 0, step := max(1, HELD // max(1, len(theirs)))):
                some = mine[lo : lo + step]
                s, at, n = ordered(product.scores(some, theirs), a_id[some][:, None] != r_id[theirs][None, :], product.bound, k)
                line, place = np.nonzero(np.arange(s.shape[1])[None, :] < n[:, None])
                yield a_id[some][line], r_id[theirs][at[line, place]], s[line, place]


def negatives_of(anchors: pa.Table, rows: pa.Table, scale: float, k: int, low: int, high: int) -> Iterator[tuple]:
    """(anchor, positive, its score, row, score) arrays: for each positive the k best rows of other labels in this cell with
    low % of its score <= score <= high % of it."""
    for a, r, a_label, r_label in by_length(anchors, rows):
        a_id, r_id, positives = a["id"].to_numpy(), r["id"].to_numpy(), a["positives"].to_pylist()
        product = Product(components(a["v"], scale), components(r["v"], scale))
        for lo in range(0, len(a_id), step := max(1, HELD // len(r_id))):
            some = slice(lo, lo + step)
            good = (a_label[some][:, None] != r_label[None, :]) & (a_id[some][:, None] != r_id[None, :])
            s, at, n = ordered(product.scores(some), good, product.bound)
            out: list[tuple] = []
            for i, found in enumerate(positives[some]):
                down = -s[i, : n[i]]
                for p in found:
                    least, top = -(-low * p["score"] // 100), high * p["score"] // 100
                    first = int(np.searchsorted(down, -top))
                    last = min(first + k, int(np.searchsorted(down, -least, "right")))
                    out += [(a_id[lo + i], p["id"], p["score"], r_id[at[i, j]], s[i, j]) for j in range(first, last)]
            if out:
                yield tuple(np.array(c, np.int64) for c in zip(*out))


def mine(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", every: int = 50, scale: float = 256.0,
         positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor against all rows."""
    spark = vectors.sparkSession
    n, a = vectors.agg(F.count(F.lit(1)), F.count_if(F.col(key) % every == 0)).first()
    wide = spark.sparkContext.defaultParallelism
    r_blocks, a_blocks = max(1, -(-n // ROWS), min(2 * wide, -(-n // 1024))), max(1, -(-a // ANCHORS))
    tasks = min(r_blocks * a_blocks, 20_000)

    finite = lambda x: F.abs(x.cast("double") * scale) < float("inf")  # noqa: E731  NaN is larger
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[label].alias("label"), vectors[vector].alias("v"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(finite(x), F.lit(False))))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row")).select("id", "row.label", "row.v")

    block = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    row_cell = F.explode(F.transform(F.sequence(F.lit(0), F.lit(a_blocks - 1)), lambda i: block(r_blocks) * a_blocks + i)).alias("cell")
    anchor_cell = F.explode(F.transform(F.sequence(F.lit(0), F.lit(r_blocks - 1)), lambda i: i * a_blocks + block(a_blocks))).alias("cell")
    celled = rows.select(row_cell, "id", "label", "v").repartition(tasks, "cell")

    def grid(anchors: DataFrame, kernel, schema: str) -> DataFrame:
        names = [f.split()[0] for f in schema.split(", ")]

        def cell(few: pa.Table, all_: pa.Table) -> pa.Table:
            found = list(kernel(few, all_)) if few.num_rows and all_.num_rows else []
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(names)
            return pa.table([pa.array(c, pa.int64()) for c in columns], names)

        few = anchors.select(anchor_cell, "*").repartition(tasks, "cell")
        few = few.toDF(*few.columns)  # columns of its own: rows and anchors are one table
        return few.groupBy("cell").cogroup(celled.groupBy("cell")).applyInArrow(cell, schema)

    def best(df: DataFrame, by: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    anchors = rows.where(F.col("id") % every == 0)
    near = grid(anchors, lambda f, r: positives_of(f, r, scale, positives), "anchor long, id long, score long")
    lists = best(near, ["anchor"], positives).groupBy("anchor").agg(F.collect_list(F.struct("id", "score")).alias("positives"))
    anchors = anchors.join(lists, F.col("id") == F.col("anchor")).select("id", "label", "v", "positives")
    far = grid(anchors, lambda f, r: negatives_of(f, r, scale, negatives, low, high), "anchor_id long, positive_id long, positive_score long, id long, score long")
    return best(far, ["anchor_id", "positive_id"], negatives).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
