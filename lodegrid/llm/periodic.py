"""Periodic run detection: recursive frequency splitting, then a scan of the surviving segments by lag.

A run is a longest stretch of words with smallest period q and at least max(`least`, `times` * q) words, so each of its words stands in
it at least `times` times. A word that occurs less often than that in the segment at hand can be in no run of it: such words split the
segment, the parts are counted anew, and so on until none splits any more. Every run lies inside one surviving segment.

Splitting goes on in the largest part with the counts it has, less those of the other parts, and counts only the smaller parts anew, so
the work is n log n however deep it goes. In a surviving segment, small lags are compared word by word. For a larger lag q only every
q-th word is compared: a run of four periods holds four neighbouring multiples of q with equal words; from there it is followed to both
ends. That is n log n comparisons over all lags, and stretches that an earlier run of a shorter period explains are not followed again.

Defined results: a null text has no words; white space is the space and \\t to \\r; a text without a run has an empty list and is kept;
runs may overlap and all are listed; a null key stays null; repeated rows are handled each by itself; an empty table gives an empty
table; further columns are not read. Memory: the words of one text. Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import text_of

WORD = re.compile("[^ \t-\r]+")
#: Lags up to this one are compared word by word.
DENSE = 8


def segments(ids: np.ndarray, times: int, least: int) -> list[tuple[int, int]]:
    """Stretches (start, end) of at least `least` words in which every word occurs at least `times` times, after splitting to stability."""
    n = len(ids)
    if n < least:
        return []
    order = np.argsort(ids, kind="stable")  # places of each word, in order
    first = np.concatenate(([0], np.cumsum(np.bincount(ids))))
    count = np.zeros(len(first) - 1, np.int64)
    out, todo = [], [(0, n)]
    while todo:
        lo, hi = todo.pop()
        words, k = np.unique(ids[lo:hi], return_counts=True)
        count[words] = k
        cuts = lo + np.flatnonzero(count[ids[lo:hi]] < times)
        while len(cuts):
            starts, ends = np.concatenate(([lo], cuts + 1)), np.concatenate((cuts, [hi]))
            big = int(np.argmax(ends - starts))
            for i in np.flatnonzero(ends - starts >= least):
                if i != big:
                    todo.append((int(starts[i]), int(ends[i])))
            left, right = int(starts[big]), int(ends[big])
            gone, k = np.unique(np.concatenate((ids[lo:left], ids[right:hi])), return_counts=True)
            count[gone] -= k
            lo, hi = left, right
            if hi - lo < least:
                break
            rare = gone[(count[gone] < times) & (count[gone] > 0)]
            where = [order[first[w] : first[w + 1]] for w in rare]
            where = [p[np.searchsorted(p, lo) : np.searchsorted(p, hi)] for p in where]
            cuts = np.sort(np.concatenate(where)) if where else np.zeros(0, np.int64)
        count[words] = 0
        if hi - lo >= least:
            out.append((lo, hi))
    return sorted(out)


def follow(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading words of a and b (of one length) are equal, looked at in growing steps."""
    at, step = 0, 64
    while at < len(a):
        differ = a[at : at + step] != b[at : at + step]
        if differ.any():
            return at + int(np.argmax(differ))
        at, step = at + step, step * 2
    return len(a)


def sampled(w: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, place): places j, multiples of a lag in low..high, whose words at j, j+q, j+2q and j+3q are equal; by lag, then place."""
    n, lags, places = len(w), [], []
    root = min(high, max(low - 1, int(n**0.5)))
    for q in range(low, root + 1):
        s = w[::q]
        same = s[1:] == s[:-1]
        at = np.flatnonzero(same[:-2] & same[1:-1] & same[2:])
        if len(at):
            lags.append(np.full(len(at), q))
            places.append(at * q)
    qs, k = np.arange(root + 1, high + 1), 0
    while len(qs := qs[(k + 3) * qs < n]):
        at = k * qs
        hit = (w[at] == w[at + qs]) & (w[at + qs] == w[at + 2 * qs]) & (w[at + 2 * qs] == w[at + 3 * qs])
        if hit.any():
            lags.append(qs[hit])
            places.append(at[hit])
        k += 1
    if not lags:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, j = np.concatenate(lags), np.concatenate(places)
    order = np.lexsort((j, q))
    return q[order], j[order]


class Covered:
    """Runs so far; says which stretches lie inside one of them."""

    def __init__(self):
        self.runs, self.seen = [], 0
        self.starts, self.reach = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def inside(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if self.seen < len(self.runs):
            r = np.array([(s, s + size) for s, size, _ in self.runs], np.int64)
            r = r[np.lexsort((r[:, 1], r[:, 0]))]
            self.starts, self.reach, self.seen = r[:, 0], np.maximum.accumulate(r[:, 1]), len(r)
        at = np.searchsorted(self.starts, start, "right")
        return (at > 0) & (np.concatenate(([0], self.reach))[at] >= end)


def lag_scan(w: np.ndarray, times: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of one segment."""
    n, found = len(w), Covered()
    for q in range(1, min(DENSE, n // times) + 1):
        same = np.concatenate(([False], w[q:] == w[:-q], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        start, end = edge[::2], edge[1::2] + q
        good = end - start >= max(least, times * q)
        start, end = start[good], end[good]
        new = ~found.inside(start, end)  # equal to a run of a shorter period
        found.runs += [(int(s), int(e - s), q) for s, e in zip(start[new], end[new])]
    if n // times > DENSE:
        lags, places = sampled(w, DENSE + 1, n // times)
        bounds = np.flatnonzero(np.concatenate(([True], lags[1:] != lags[:-1]))) if len(lags) else []
        for lo, hi in zip(bounds, [*bounds[1:], len(lags)]):
            q, j = int(lags[lo]), places[lo:hi]
            done, new = 0, []
            for at in j[~found.inside(j, j + 3 * q + 1)].tolist():
                if at < done:
                    continue
                ahead = follow(w[at : n - q], w[at + q :])
                back = follow(w[:at][::-1], w[q : at + q][::-1])
                s, e = at - back, at + ahead + q
                done = e - q
                if e - s >= max(least, times * q):
                    new.append((s, e - s, q))
            at = np.array(new, np.int64).reshape(-1, 3)
            explained = found.inside(at[:, 0], at[:, 0] + at[:, 1])  # the words between the compared ones have a shorter period
            found.runs += [r for r, x in zip(new, explained) if not x]
    return found.runs


def runs_of(words: list[str], times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    if len(words) < least:
        return []
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    return sorted((((lo + s, size, q) for lo, hi in segments(ids, times, least) for s, size, q in lag_scan(ids[lo:hi], times, least))), key=lambda r: (r[0], r[2]))


def collapse(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    step = np.zeros(len(words) + 1, np.int64)
    at = np.array(runs, np.int64)
    np.add.at(step, at[:, 0] + at[:, 2], 1)
    np.add.at(step, at[:, 0] + at[:, 1], -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", times: int = 4, least: int = 6) -> DataFrame:
    """One row per document: key, n_words, runs (array of start, length, period) and kept (text with each run cut down to one period,
    words joined by one space)."""
    if times < 4 or least < 2:
        raise ValueError("a run has at least four periods and two words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
        for b in batches:
            for lo in range(0, b.num_rows, 256):
                part = b.slice(lo, 256)
                sizes, offsets, flat, kept = [], [0], [], []
                for x in part.column(1):
                    words = WORD.findall(x.as_py())
                    runs = runs_of(words, times, least)
                    sizes.append(len(words))
                    flat += runs
                    offsets.append(len(flat))
                    kept.append(" ".join(collapse(words, runs)))
                at = np.array(flat, np.int64).reshape(-1, 3)
                items = pa.StructArray.from_arrays([pa.array(at[:, k].copy()) for k in range(3)], fields=list(kind.value_type))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items), pa.array(kept, pa.string())], ["key", "n_words", "runs", "kept"]
                )

    item = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(item)), T.StructField("kept", T.StringType())])
    return docs.select(docs[key].alias("key"), text_of(docs, text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
