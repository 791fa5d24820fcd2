"""Near duplicates: SimHash fingerprints, deletion-variant signatures, connected components.

A fingerprint of `64 * words` bits is cut into segments. Cut into s segments, two fingerprints that differ in at most 2s - 1 bits have a
segment that differs in at most one, so each segment is indexed under its variants with one bit left out (and no more): fingerprints
that share a variant meet in an equality grouping and are verified by their Hamming distance. Equal fingerprints are one node
beforehand, so groups of copies never meet here.

Inside a bucket of variants only links are kept that connect it, never all pairs, and a task gives one link for each node. Components are
found by rounds of large-star and small-star steps, each a table in the shared folder.

Where a Jaccard similarity is asked for, the components of these links are only what is compared: inside each, every pair of texts that
is not yet connected is held against the exact similarity of its shingles, and the components of the pairs that pass are the result.

Defined results: null, empty or white-space text has fingerprint zero and links like any other; a null id never becomes a group's
smallest id while another is there; repeated rows are in one group; an empty table gives an empty table; further columns are not read.
A bucket costs its task the fingerprints of its members; equal fingerprints count once, and close ones are left out as soon as they are
linked, so time goes with the square only of members that are in no link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..session import discard, stored
from .common import free_name, parts, text_of

ROWS = 200_000
#: Rows of a bucket that are compared in step, and of one that is cut again where that loses nothing.
SMALL, CROWDED = 64, 8192
#: Most texts and shingles of a block that is compared at once.
BLOCK, BLOCK_SHINGLES = 2048, 1_000_000


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space (space and \\t to \\r), A-Z in lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(text: str, size: int, seed: int) -> np.ndarray:
    """XXH64 of each run of `size` words joined by one space, with repeats; fewer words: of them all; none: an empty array."""
    w = words_of(text)
    if not w:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(w), max(1, len(w) - size + 1)
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    h = xxhash.xxh64_intdigest
    last = ends[min(size, len(w)) - 1 :]
    return np.fromiter((h(line[s:e], seed) for s, e in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)


def fingerprint(text: str, size: int, words: int, seed: int = 42, distinct: bool = False) -> tuple[list[int], bytes, int]:
    """`words` 64-bit words, signed: a bit is set if it is in over half of the hashes; words after the first use the hashes mixed
    anew. And, if each different shingle is taken once, a digest of the set of shingles and its size (else empty and 0)."""
    first = shingle_hashes(text, size, seed)
    first = np.unique(first) if distinct else first
    out, digest = [], xxhash.xxh3_128_digest(first.tobytes()) if distinct else b""
    for k in range(words):
        h = first
        if k:
            h = (first ^ np.uint64(k)) * np.uint64(0xFF51AFD7ED558CCD)
            h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
            h ^= h >> np.uint64(33)
        ones = np.zeros(64, np.int64)
        for lo in range(0, len(h), 65536):  # bounds the unpacked bits
            ones += np.unpackbits(h[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0]))
    return out, digest, len(first) if distinct else 0


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, words: int = 1, distinct: bool = False) -> DataFrame:
    """One row per document: key, f0.. (64-bit words) and, if each different shingle counts once, digest and size of the set of shingles."""
    from pyspark.sql import types as T

    names = [f"f{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [fingerprint(x, size, words, distinct=distinct) for x in b.column(1).to_pylist()]
            fps = np.array([f for f, _, _ in found], np.int64).reshape(-1, words)
            rest = [pa.array([d for _, d, _ in found], pa.binary()), pa.array([n for _, _, n in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(fps[:, k].copy()) for k in range(words)], *rest], ["key", *names, "digest", "many"])

    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), *[T.StructField(n, T.LongType()) for n in names], T.StructField("digest", T.BinaryType()), T.StructField("many", T.LongType())])
    return docs.select(docs[key].alias("key"), text_of(docs, text).alias("text")).mapInArrow(run, schema)


def variants(fps: DataFrame, words: int, segment: int, carried: int) -> DataFrame:
    """(sig, f0.. of the first `carried` words): each segment with each one of its bits left out; the segment's and the bit's number are part of the signature.

    Equal segments share all of these, so no entry without a wildcard is needed.
    """
    per, names = 64 // segment, [f"f{k}" for k in range(carried)]

    def of(s: int) -> Column:
        value = F.shiftrightunsigned(f"f{s // per}", segment * (s % per)).bitwiseAND(F.lit((1 << segment) - 1))
        bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)
        number = lambda i: F.call_function("shiftleft", F.lit(s * segment).cast("long") + i, F.lit(segment))
        return F.transform(F.sequence(F.lit(0), F.lit(segment - 1)), lambda i: number(i).bitwiseOR(value.bitwiseAND(F.bitwise_not(bit(i)))))

    rows = [of(s) for s in range(words * per)]
    return fps.select(F.explode(F.flatten(F.array(*rows))).alias("sig"), *names)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the edges a-b connect it with."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def reached(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect whatever chains of at most `distance` bits connect: each row found looks only at rows not yet found, so a
    group whose members are close costs about its size."""
    left, out = np.arange(len(fps)), []
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[at]).sum(1, dtype=np.int64) <= distance
            if near.any():
                found = left[near]
                out.append(np.stack([np.full(len(found), at), found]))
                front += found.tolist()
                left = left[~near]
    return tuple(np.concatenate(out, 1)) if out else (np.zeros(0, np.int64),) * 2


def halved(fps: np.ndarray, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row): the two 16-bit quarters of half `part` of 64-bit fingerprints, each with one bit left out."""
    rows, sigs = [], []
    for k in (2 * part, 2 * part + 1):
        value = (fps[:, 0] >> np.uint64(16 * k)) & np.uint64(0xFFFF)
        for bit in range(16):
            sigs.append((np.uint64(16 * k + bit) << np.uint64(16)) | (value & ~np.uint64(1 << bit)))
            rows.append(np.arange(len(fps)))
    return np.concatenate(sigs), np.concatenate(rows)


def bucket_links(sig: np.ndarray, fps: np.ndarray, distance: int, half: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows within `distance` bits inside buckets of equal `sig` (sorted) that connect whatever such pairs connect.

    Small buckets are compared in step, large ones row by row. half: the signatures are halves of one 64-bit word of that many bits; then
    a crowded bucket is cut again by the quarters of the other half, one of which differs in at most one bit where both differ in two.
    """
    edge = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True])))
    sizes = np.diff(edge)
    out = [np.zeros((2, 0), np.int64)]
    for i in np.flatnonzero(sizes > SMALL).tolist():
        rows = np.arange(edge[i], edge[i + 1])
        if half and distance <= 2 and len(rows) > CROWDED:
            of = int(sig[rows[0]]) >> half >= half  # signatures are numbered by bit: the upper half's come after the lower half's
            sub, at = halved(fps[rows], 0 if of else 1)
            order = np.argsort(sub, kind="stable")
            a, b = bucket_links(sub[order], fps[rows][at[order]], distance)
            a, b = at[order][a], at[order][b]
        else:
            a, b = reached(fps[rows], distance)
        out.append(np.stack([rows[a], rows[b]]))
    small = np.repeat(sizes <= SMALL, sizes)
    at, k = np.flatnonzero(small), 1
    while True:
        at = at[at + k < len(sig)]
        at = at[sig[at] == sig[at + k]]
        if not len(at):
            both = np.concatenate(out, 1)
            return both[0], both[1]
        near = np.bitwise_count(fps[at] ^ fps[at + k]).sum(1, dtype=np.int64) <= distance
        out.append(np.stack([at[near], at[near] + k]))
        k += 1


def starred(ends: np.ndarray, words: int) -> np.ndarray:
    """Edges (rows of 2 * words numbers) as one edge from each node to the smallest node of its component."""
    void = np.ascontiguousarray(ends.reshape(-1, words)).view(np.dtype((np.void, 8 * words))).ravel()
    nodes, flat = np.unique(void, return_inverse=True)
    root = roots(len(nodes), flat[::2], flat[1::2])
    own = np.flatnonzero(root != np.arange(len(nodes)))
    plain = nodes.view(np.int64).reshape(-1, words)
    return np.concatenate([plain[own], plain[root[own]]], 1)


def links(fps: DataFrame, words: int, segment: int, distance: int, extra: int = 0) -> DataFrame:
    """(a, b): numbers (see `node_of`) of different fingerprints of `words` words, connected wherever a chain of links of at most
    `distance` bits connects them; `extra` words after these are only cut into segments. A task gives one link for each node it has
    linked, to the smallest one of the component it knows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        ends = [np.zeros((0, 2 * words), np.int64)]

        def flush(last: bool) -> None:
            sig, f = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            end = len(sig) if last else int(np.searchsorted(sig, sig[-1]))
            held.clear()
            if end < len(sig):
                held.append((sig[end:], f[end:]))
            a, b = bucket_links(sig[:end], f[:end].view(np.uint64), distance, segment if words == 1 and segment == 32 else None)
            if len(a):
                ends.append(np.concatenate([f[a], f[b]], 1))
                if sum(map(len, ends)) > ROWS:
                    ends[:] = [starred(np.concatenate(ends), words)]

        for batch in batches:
            if batch.num_rows:
                held.append((batch.column(0).to_numpy(), np.stack([c.to_numpy() for c in batch.columns[1:]], 1)))
            if sum(len(h[0]) for h in held) > ROWS and held[0][0][0] != held[-1][0][-1]:
                flush(False)
        if held:
            flush(True)
        out = starred(np.concatenate(ends), words)
        for lo in range(0, len(out), ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(out[lo : lo + ROWS, k].copy()) for k in range(2 * words)], [f"{s}{k}" for s in "ab" for k in range(words)])

    rows = variants(fps, words + extra, segment, words).repartition(parts(fps.sparkSession), "sig").sortWithinPartitions("sig")
    found = rows.mapInArrow(run, ", ".join(f"{s}{k} long" for s in "ab" for k in range(words)))
    return found.select(node_of("a", words).alias("a"), node_of("b", words).alias("b")).where("a != b").distinct()


def node_of(prefix: str, words: int) -> Column:
    """The number of a fingerprint: the word itself, or a hash of several words. Two fingerprints of one number only make a component that
    is compared larger."""
    return F.col(f"{prefix}0") if words == 1 else F.xxhash64(*[f"{prefix}{k}" for k in range(words)])


def similar_pairs(texts: list[str], sides: list[int], size: int, similarity: float, known: list[int] | None = None) -> list[tuple[int, int]]:
    """Numbers (i, j) of texts whose sets of shingles have this Jaccard similarity: pairs that connect whatever such pairs connect.

    Sides are 0 (first) or 1; if both are there, only pairs of one from each are looked at. Texts of equal numbers in `known` are
    connected already. Every text has a shingle.
    """
    sets = [np.unique(shingle_hashes(t, size, 42)) for t in texts]
    many = np.array([len(x) for x in sets])
    at = np.concatenate(([0], np.cumsum(many)))
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marked, out = np.zeros(at[-1], bool), []
    root = np.arange(len(sets)) if known is None else np.unique(known, return_inverse=True)[1]
    left = sides.index(1) if sides[0] != sides[-1] else 0
    for i in range(left or len(sets) - 1):
        lo = left or i + 1
        js = lo + np.flatnonzero((root[lo:] != root[i]) & (np.minimum(many[lo:], many[i]) / np.maximum(many[lo:], many[i]) >= similarity))
        if not len(js):
            continue
        mine = flat[at[i] : at[i + 1]]
        marked[mine] = True
        if 4 * len(js) > len(sets) - lo:
            shared = np.add.reduceat(marked[flat[at[lo] :]], at[lo:-1] - at[lo], dtype=np.int64)[js - lo]
        else:
            shared = np.array([np.count_nonzero(marked[flat[at[j] : at[j + 1]]]) for j in js])
        marked[mine] = False
        for j in js[shared / (many[i] + many[js] - shared) >= similarity].tolist():
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def compared(rows: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (a, b) inside each group (root, i, j) of rows with node, side, known and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if len(group) > 1:
                found = similar_pairs([g[6] for g in group], [g[3] for g in group], size, similarity, [g[5] for g in group])
                yield pa.RecordBatch.from_arrays([pa.array([group[p[k]][4] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])
            group.clear()

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for row in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                    if group and group[0][:3] != row[:3]:
                        yield from flush()
                    group.append(row)
        yield from flush()

    rows = rows.select("root", "i", "j", "side", "node", "known", "text")
    return rows.repartition(parts(rows.sparkSession), "root", "i", "j").sortWithinPartitions("root", "i", "j", "side").mapInArrow(run, "a long, b long")


def verified(members: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """Links (a, b) between members of a root whose exact Jaccard similarity is high enough; they connect whatever such pairs of one root's
    members connect. members: (node, root, many); docs: (node, text).

    A root with many members is cut into blocks by a hash, and compared inside them; then, what is not yet connected, inside blocks cut
    by another hash. A text is sent once for each, and a group of near copies is one component by then. Only what is still apart in a
    root of several blocks is held against all other blocks, each pair of blocks by itself.
    """
    spark = members.sparkSession
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("many") / BLOCK_SHINGLES)).cast("int")
    crowds = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), blocks.alias("blocks")).where("n > 1").drop("n")
    texts, _ = stored(members.join(crowds, "root").join(docs, "node").select("node", "root", "blocks", "text"))

    def dealt(rows: DataFrame, salt: int) -> DataFrame:
        return rows.withColumn("i", F.pmod(F.xxhash64("node", F.lit(salt)), "blocks").cast("int")).withColumn("j", F.col("i")).withColumn("side", F.lit(0))

    def apart(found: DataFrame) -> DataFrame:
        """Texts of roots of several blocks that are not yet one component."""
        large = texts.where("blocks > 1").join(components(found).withColumnRenamed("root", "known"), "node", "left").withColumn("known", F.coalesce("known", "node"))
        still = large.groupBy("root").agg(F.min("known").alias("lo"), F.max("known").alias("hi")).where("lo != hi").select("root")
        return large.join(still, "root")

    found, _ = stored(compared(dealt(texts.withColumn("known", F.col("node")), 1), size, similarity))
    if texts.where("blocks > 1").isEmpty():
        return found
    again, _ = stored(compared(dealt(apart(found), 2), size, similarity))
    found = found.unionByName(again)
    mine = dealt(apart(found), 1).select("root", "node", "known", "text", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("i != other")
    rows = mine.select("root", "node", "known", "text", F.least("i", "other").alias("i"), F.greatest("i", "other").alias("j"), (F.col("i") > F.col("other")).cast("int").alias("side"))
    return found.unionByName(compared(rows, size, similarity))


def hex_of(prefix: str, words: int):
    """16 lower-case hexadecimal digits for each 64-bit word."""
    return F.concat(*[F.lower(F.lpad(F.hex(f"{prefix}{k}"), 16, "0")) for k in range(words)])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root): nodes of the edges (a, b) with the smallest node of their component. Raises if `rounds` don't do.

    Each round is a table in the shared folder; the one before is deleted.
    """
    spark = edges.sparkSession
    now, path = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    seen = None
    for k in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # the way to the smallest neighbour, once for each node, and what leads from the other neighbours there
        small = low.select("u", F.col("m").alias("v")).unionByName(large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        state = Observation(f"round{k}")
        after, fresh = stored(small.observe(state, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")))
        discard(spark, path)
        now, path = after, fresh
        if state.get == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state.get
    raise RuntimeError("the components did not settle; raise `rounds`")


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 3, segment: int = 32, distance: int = 2) -> DataFrame:
    """One row per document: key, fingerprint of 64 bits (hexadecimal) and component_id, the smallest key that chains of links reach."""
    base, _ = stored(fingerprints(docs, key, text, size))
    nodes = base.groupBy("f0").agg(F.min("key").alias("first"))
    joined = nodes.join(components(links(nodes, 1, segment, distance)), F.col("f0") == F.col("node"), "left").select("f0", "first", F.coalesce("root", "f0").alias("root"))
    lowest = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    named = joined.join(lowest, "root").select("f0", "component_id")
    return base.join(named, "f0", "left").select(F.col("key").alias(key), hex_of("f", 1).alias("fingerprint"), "component_id")


def cutting(n: int, similarity: float, missed: float = 0.0004, load: int = 32) -> tuple[int, int]:
    """(bits of a segment, words to be cut): the shortest segments whose buckets hold about `load` of n different texts, and as many of
    them as leave no one-bit match for a share `missed` of pairs of this similarity."""
    turned = math.acos(2 * similarity / (1 + similarity)) / math.pi  # of the bits, for two sets of one size
    segment = next((b for b in (16, 21) if n <= load << b - 1), 32)
    hit = (1 - turned) ** segment + segment * turned * (1 - turned) ** (segment - 1)
    return segment, max(3, math.ceil(math.log(missed) / math.log(1 - hit) / (64 // segment)))


def similar_groups(docs: DataFrame, key: str, text: str, size: int, words: int, extra: int, segment: int, distance: int, similarity: float) -> DataFrame:
    """One row per document: key (of type long, unique, not null) and component_id, the smallest key that chains of pairs of at least this
    Jaccard similarity reach; each different shingle counts once.

    Fingerprints only bring together what is compared: components of their links are taken apart again by exact similarity.
    """
    names = [f"f{k}" for k in range(words)]
    base, _ = stored(fingerprints(docs, key, text, size, words + extra, True))
    sets = base.groupBy("digest").agg(F.min("key").alias("node"), F.min("many").alias("many"), *[F.min(f"f{k}").alias(f"f{k}") for k in range(words + extra)])
    able = sets.where(F.col("many") / (F.col("many") + 1.0) >= similarity)  # smaller sets are similar to their equals only
    fps = able.groupBy(*names).agg(*[F.min(f"f{k}").alias(f"f{k}") for k in range(words, words + extra)])
    loose = components(links(fps, words, segment, distance, extra)).withColumnRenamed("node", "number")
    members = able.select("node", "many", node_of("f", words).alias("number")).join(loose, "number", "left").select("node", "many", F.coalesce("root", "number").alias("root"))
    members, _ = stored(members)
    found = components(verified(members, docs.select(docs[key].alias("node"), text_of(docs, text).alias("text")), size, similarity))
    named = sets.select("digest", "node").join(found, "node", "left").select("digest", F.coalesce("root", "node").alias("component_id"))
    return base.select(F.col("key").alias(key), "digest").join(named, "digest").select(key, "component_id")


def first_of_group(docs: DataFrame, text: str = "text", size: int = 5, words: int = 3, distance: int = 47, similarity: float = 0.8) -> DataFrame:
    """The documents with one of each group of near copies: all columns, the row read first stays. `docs` is a stored table: rows are
    numbered in the order of its files.

    Five-word shingles. Of 192 bits, a Jaccard similarity of 0.8 turns over 29.1 on average, over 47 less than once in a thousand times,
    while two texts without a common shingle come so close once in 10^12 times. How many bits a segment has follows from the number of
    documents, so that buckets stay small as the corpus grows; further words are cut into segments until one of them differs in at most
    one bit for 99.96 % of such pairs. What is found in this way is held against the exact similarity.
    """
    row = free_name(docs, "row_number")
    at = docs.withColumn(row, F.monotonically_increasing_id())
    segment, cut_words = cutting(docs.count(), similarity)
    gone = similar_groups(at, row, text, size, words, cut_words - words, segment, distance, similarity).where(F.col(row) != F.col("component_id")).select(row)
    return at.join(gone, row, "left_anti").drop(row)
