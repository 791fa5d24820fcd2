"""Substring deduplication: a count-min prefilter, then exact grouping of the windows estimated repeated.

A window is `size` consecutive words of one document. Documents are dealt to chunks by a hash of id and text. Each chunk's sketch has
`depth` rows; as most cells are empty it is kept as sorted cells, cut into shards of the rows, and merged shard by shard. The number of
shards follows the corpus, so the sketch grows with it and is never held whole anywhere. A shard answers each chunk with those of its
cells whose merged count is two or more. Counts are only overestimated: a repeated window always passes. Windows that pass are grouped
exactly by a 128-bit hash of their words, and each chunk learns which of its windows also start in a document with a smaller id.

Texts are shuffled once, into chunks, and read from that exchange by the three passes.

Defined results: null text has no words; a null id counts as larger than any other; rows with one id never take words from each other;
texts shorter than a window stay whole; an empty table gives an empty table; further columns are not read. A chunk or a shard is held
by one task: some MB, or one document if it is longer. Chunks send each shard one block, so chunks get larger with the square root of the
corpus, from 8 MB (17 GB) up to 32 MB (275 GB; about half a GB in a task), and a shard stands for two chunks: between these blocks grow with
the corpus alone, beyond them with its square - at 1 TB a block is some 300 windows. Results don't depend on `chunk_bytes`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

LAST = np.iinfo(np.int64).max
#: Multipliers of the two window hashes (odd, otherwise free).
POWERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
CELL_BITS = 25
#: Least and largest size of a chunk where the caller names none.
CHUNK_BYTES = (8 << 20, 32 << 20)
#: Chunks whose cells a shard of the sketch has room for.
SHARD_CHUNKS = 2


def chunk_size(total: int) -> int:
    """Bytes of a chunk for a corpus of so many bytes; by the square root, so chunks and the blocks between them grow in step."""
    return int(min(max(CHUNK_BYTES[0], 64 * total**0.5), CHUNK_BYTES[1]))


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space (space and \\t to \\r), as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def mix(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ np.uint64(salt * 0x51ED270B)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(29))


def windows(texts: list[str], ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows of the texts: 128-bit hash as (n, 2), first word's place in the run of all words, document id; words per text."""
    digest, runs, counts = xxhash.xxh3_128_digest, [], []
    for t in texts:
        w = words_of(t)
        counts.append(len(w))
        runs.append(b"".join(map(digest, w)))
    h = np.frombuffer(b"".join(runs), "<u8").reshape(-1, 2)
    n = np.array(counts, np.int64)
    many = len(h) - size + 1
    if many < 1:
        return np.zeros((0, 2), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), n
    out = np.zeros((many, 2), np.uint64)
    for k in range(size):
        out *= np.array(POWERS)
        out += h[k : k + many]
    doc = np.repeat(np.arange(len(n)), n)
    start = np.flatnonzero(doc[:many] == doc[size - 1 :])
    out = out[start]
    return np.stack([mix(out[:, 0], 1), mix(out[:, 1], 2)], 1), start, ids[doc[start]], n


def cells(h: np.ndarray, row: int, shards: int) -> np.ndarray:
    """Cell of each window in a row of the sketch, with the row's and the shard's number above it."""
    x = mix(h[:, 0], 10 + row)
    s = np.uint64(shards)
    return ((np.uint64(row) * s + x % s) << np.uint64(CELL_BITS)) | ((x // s) & np.uint64((1 << CELL_BITS) - 1))


def put(values: np.ndarray) -> bytes:
    """Sorted numbers below 2**32 as compressed differences."""
    d = np.diff(values.astype(np.uint32), prepend=np.uint32(0))
    kind = np.uint16 if not len(d) or d.max() < 65536 else np.uint32
    planes = d.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T.tobytes()
    return bytes([np.dtype(kind).itemsize]) + zstandard.ZstdCompressor(level=1).compress(planes)


def got(block: bytes) -> np.ndarray:
    width = block[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block[1:]), np.uint8).reshape(width, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(f"<u{width}")[:, 0], dtype=np.uint64)


def squeeze(ids: np.ndarray) -> bytes:
    """64-bit numbers, bytes of one weight together, compressed: ids of one chunk share their high bytes."""
    return zstandard.ZstdCompressor(level=1).compress(ids.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unsqueeze(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(block), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8")[:, 0]


def within(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which 128-bit hashes are in `known`."""
    if not len(known) or not len(h):
        return np.zeros(len(h), bool)
    known = known[np.lexsort((known[:, 1], known[:, 0]))]
    at, hit = np.searchsorted(known[:, 0], h[:, 0]), np.zeros(len(h), bool)
    live = np.arange(len(h))
    while len(live):  # once, but for equal first halves
        ok = at[live] < len(known)
        live = live[ok]
        live = live[known[at[live], 0] == h[live, 0]]
        hit[live] |= known[at[live], 1] == h[live, 1]
        live = live[~hit[live]]
        at[live] += 1
    return hit


def smallest(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order that puts equal hashes together, starts of the groups in it, and each group's smallest id."""
    order = np.lexsort((h[:, 1], h[:, 0]))
    s = h[order]
    first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]).any(1)))) if len(s) else np.zeros(0, np.int64)
    low = np.minimum.reduceat(ids[order], first) if len(s) else np.zeros(0, np.int64)
    return order, first, low


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("id").fill_null(LAST).to_numpy()


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 13, depth: int = 2, chunk_bytes: int | None = None) -> DataFrame:
    """One row per document: key, n_words, n_removed and kept, the words that stay, joined by one space. The id is an integer column."""
    body = docs.select(docs[key].cast("long").alias("id"), text_of(docs, text).alias("text"))
    total = body.agg(F.sum(F.octet_length("text") + F.lit(16))).first()[0] or 0
    n = max(1, -(-total // (chunk_bytes or chunk_size(total))))
    shards = max(1, n // SHARD_CHUNKS)  # of a sketch row, and of the exact groups
    dealt = body.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))
    block = "shard int, chunk int, cells binary"

    def sketch(table: pa.Table) -> pa.Table:
        h, _, _, _ = windows(table.column("text").to_pylist(), _ids(table), size)
        chunk, out = table.column("chunk")[0].as_py(), []
        for row in range(depth):
            c = np.sort(cells(h, row, shards))
            if len(c) > 2:
                c = c[np.concatenate(([True, True], c[2:] != c[:-2]))]  # a count of two is enough
            shard = (c >> np.uint64(CELL_BITS)).astype(np.int64)
            cut = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if len(c) else []
            for lo, hi in zip(cut, [*cut[1:], len(c)]):
                out.append((int(shard[lo]), chunk, put(c[lo:hi] & np.uint64((1 << CELL_BITS) - 1))))
        return pa.table({"shard": pa.array([x[0] for x in out], pa.int32()), "chunk": pa.array([x[1] for x in out], pa.int32()), "cells": pa.array([x[2] for x in out], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        own = [got(x).astype(np.uint32) for x in table.column("cells").to_pylist()]
        value, count = np.unique(np.concatenate(own), return_counts=True)
        value, rows = value[count > 1], []
        for c in own:
            at = np.searchsorted(value, c)
            at[at == len(value)] = 0
            rows.append(put(np.unique(c[value[at] == c])) if len(value) else put(c[:0]))
        return pa.table({"shard": table.column("shard"), "chunk": table.column("chunk"), "cells": pa.array(rows, pa.binary())})

    def candidates(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if table.num_rows and answers.num_rows:
            h, _, ids, _ = windows(table.column("text").to_pylist(), _ids(table), size)
            known = np.sort(np.concatenate([got(c) | np.uint64(s << CELL_BITS) for s, c in zip(answers.column("shard").to_pylist(), answers.column("cells").to_pylist())]))
            for row in range(depth):
                c = cells(h, row, shards)
                at = np.searchsorted(known, c)
                at[at == len(known)] = 0
                hit = known[at] == c if len(known) else np.zeros(len(c), bool)
                h, ids = h[hit], ids[hit]
            order, first, low = smallest(h, ids)
            h = h[order][first]
            shard = (mix(h[:, 1], 20) % np.uint64(shards)).astype(np.int64)
            for s in np.unique(shard):
                m = shard == s
                out.append((int(s), table.column("chunk")[0].as_py(), h[m].tobytes(), squeeze(low[m])))
        return pa.table({"shard": pa.array([x[0] for x in out], pa.int32()), "chunk": pa.array([x[1] for x in out], pa.int32()), "hashes": pa.array([x[2] for x in out], pa.binary()), "ids": pa.array([x[3] for x in out], pa.binary())})

    def exact(table: pa.Table) -> pa.Table:
        hs = [np.frombuffer(x, "<u8").reshape(-1, 2) for x in table.column("hashes").to_pylist()]
        ids = np.concatenate([unsqueeze(x) for x in table.column("ids").to_pylist()])
        h = np.concatenate(hs)
        order, first, low = smallest(h, ids)
        least = np.empty(len(h), np.int64)
        least[order] = np.repeat(low, np.diff(np.append(first, len(h))))
        later, ends = least < ids, np.cumsum([len(x) for x in hs])
        return pa.table({"chunk": table.column("chunk"), "hashes": pa.array([x[m].tobytes() for x, m in zip(hs, np.split(later, ends[:-1]))], pa.binary())})

    def cover(table: pa.Table, answers: pa.Table) -> pa.Table:
        texts, ids = table.column("text").to_pylist(), _ids(table)
        h, start, owner, counts = windows(texts, ids, size)
        known = np.concatenate([np.frombuffer(x, "<u8").reshape(-1, 2) for x in answers.column("hashes").to_pylist()] or [np.zeros((0, 2), np.uint64)])
        gone = within(h, known)
        order, first, low = smallest(h, owner)
        gone[order] |= np.repeat(low, np.diff(np.append(first, len(h)))) < owner[order]
        marks = np.zeros(counts.sum() + size + 1, np.int32)
        np.add.at(marks, start[gone], 1)
        np.add.at(marks, start[gone] + size, -1)
        stays, kept, removed, at = np.cumsum(marks) == 0, [], [], 0
        for t, k in zip(texts, counts.tolist()):
            keep = stays[at : at + k]
            at += k
            removed.append(k - int(keep.sum()))
            w = words_of(t)
            kept.append(b" ".join(w if not removed[-1] else [x for x, y in zip(w, keep.tolist()) if y]).decode("utf-8", "surrogatepass"))
        return pa.table({"id": table.column("id"), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string())})

    chunks = dealt.groupBy("chunk")
    merged = chunks.applyInArrow(sketch, block).groupBy("shard").applyInArrow(merge, block)
    passed = chunks.cogroup(merged.groupBy("chunk")).applyInArrow(candidates, "shard int, chunk int, hashes binary, ids binary")
    found = passed.groupBy("shard").applyInArrow(exact, "chunk int, hashes binary")
    done = chunks.cogroup(found.groupBy("chunk")).applyInArrow(cover, "id long, n_words long, n_removed long, kept string")
    return done.select(F.col("id").cast(docs.schema[key].dataType if isinstance(docs.schema[key].dataType, T.IntegralType) else T.LongType()).alias(key), "n_words", "n_removed", "kept")
