"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Words (runs of letters, of digits and of other signs, in lower case, and marks for capitals and for repetition) are hashed into a fixed
number of rows. Each has a sparse random index vector; its context vector is the sum of the index vectors of its neighbours over all
documents. A document is the mean of its words' vectors (index and normalised context). A small network learns the label from a bounded
sample of labelled documents; its temperature is fitted on labelled documents it has not seen.

Bounds: the word table has `rows` x `dim` numbers whatever the corpus; at most `sample` labelled documents are used to fit.

Defined results: null and empty texts are the zero vector and get the network's score for it; with labels of one class or none every
score is the smoothed share of label 1; several labels of one document are averaged, null labels left out; repeated rows are scored each
by itself; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fold, text_of

PARTS = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")
STEP = 20_000


class Words:
    """Row numbers (unsigned 16-bit) of a text's words. White-space-separated strings are looked up; the table has two generations, and
    when the new one is full it becomes the old one."""

    def __init__(self, rows: int, most: int = 200_000):
        self.rows, self.most, self.table, self.old = rows, most, {}, {}
        self.up, self.again = self.row("<capitals>"), self.row("<again>")

    def row(self, word: str) -> int:
        return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")) % self.rows

    def string(self, s: str) -> bytes:
        found = self.old.get(s)
        if found is None:
            rows = [self.row(w) for w in PARTS.findall(s.lower())]
            if len(s) > 1 and s.isupper():
                rows.append(self.up)
            found = array("H", rows).tobytes()
        return found

    def of(self, text: str) -> np.ndarray:
        strings, known = text.split(), self.table
        if new := set(strings).difference(known):
            if len(known) + len(new) > self.most:
                self.old, self.table = known, {}
                known, new = self.table, set(strings)
            for s in new:
                known[s] = self.string(s)
        ids = np.frombuffer(b"".join(map(known.__getitem__, strings)), np.uint16)
        same = int((ids[1:] == ids[:-1]).sum()) if len(ids) else 0
        return np.concatenate([ids, np.full(same, self.again, np.uint16)]) if same else ids


_WORDS: dict[int, Words] = {}


def words_for(rows: int) -> Words:
    """One table for each Python worker and number of rows."""
    if rows not in _WORDS:
        _WORDS[rows] = Words(rows)
    return _WORDS[rows]


def index_vectors(rows: int, dim: int, ones: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the non-zero components of each row's index vector."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, dim, (rows, ones)), rng.choice([-1, 1], (rows, ones))


def batches_of(texts: list[str], words: Words, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of the words, number of words of each text) for runs of texts of about `step` words."""
    ids, n = [], 0
    for t in texts:
        ids.append(words.of(t))
        n += len(ids[-1])
        if n > step:
            yield np.concatenate(ids).astype(np.int64), np.array([len(x) for x in ids])
            ids, n = [], 0
    if ids:
        yield np.concatenate(ids).astype(np.int64), np.array([len(x) for x in ids])


def contexts(docs: DataFrame, text: str, rows: int, dim: int, ones: int, reach: int) -> np.ndarray:
    """Context vectors of all rows: neighbours up to `reach` words away, counted over all documents. Each task sends one row per word row."""
    names = [f"c{k}" for k in range(dim)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (place, sign) = words_for(rows), index_vectors(rows, dim, ones)
        parts = [(place[:, k].copy(), sign[:, k].astype(np.float64)) for k in range(ones)]
        sums = np.zeros(rows * dim)
        for b in batches:
            for ids, counts in batches_of(b.column(0).to_pylist(), words, 600_000):
                doc = np.repeat(np.arange(len(counts)), counts)
                for o in range(1, reach + 1):
                    near = doc[o:] == doc[:-o]
                    x, y = ids[:-o][near], ids[o:][near]
                    at, other = np.concatenate([x, y]) * dim, np.concatenate([y, x])  # both directions in one count
                    for places, signs in parts:
                        sums += np.bincount(at + places[other], signs[other], rows * dim)
        table = np.rint(sums).astype(np.int64).reshape(rows, dim)
        used = np.flatnonzero(table.any(1))
        for lo in range(0, len(used), 4096):
            at = used[lo : lo + 4096]
            yield pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(table[at, k].copy()) for k in range(dim)]], ["row", *names])

    sent = docs.select(text_of(docs, text).alias("text")).mapInArrow(run, "row long, " + ", ".join(f"{n} long" for n in names))
    summed = sent.groupBy("row").agg(*[F.sum(n).alias(n) for n in names]).toPandas()  # `rows` x `dim` numbers
    out = np.zeros((rows, dim))
    out[summed["row"].to_numpy(np.int64)] = summed[names].to_numpy(np.float64)
    return out


def word_vectors(context: np.ndarray, ones: int) -> np.ndarray:
    """Index vector and context vector side by side, each of length one."""
    rows, dim = context.shape
    place, sign = index_vectors(rows, dim, ones)
    own = np.zeros((rows, dim))
    for k in range(ones):
        np.add.at(own, (np.arange(rows), place[:, k]), sign[:, k])
    tidy = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    return np.concatenate([tidy(own), tidy(context)], 1).astype(np.float32)


def pool(texts: list[str], words: Words, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of each text's words; zero for none."""
    out = np.zeros((len(texts), vectors.shape[1]))
    for i, t in enumerate(texts):
        ids = words.of(t)
        for lo in range(0, len(ids), STEP):  # a long text in several steps
            out[i] += vectors[ids[lo : lo + STEP]].sum(0)
        out[i] /= max(len(ids), 1)
    return out


class Network:
    """Two layers, the hidden one with tanh; trained with Adam on the logistic loss."""

    def __init__(self, x: np.ndarray, y: np.ndarray, calib_x: np.ndarray, calib_y: np.ndarray, hidden: int = 32, epochs: int = 60, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.prior = (y.sum() + calib_y.sum() + 1) / (len(y) + len(calib_y) + 2)
        self.fit = len(np.unique(y)) == 2
        if not self.fit:
            return
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-4)
        z = (x - self.mean) / self.scale
        p = [rng.standard_normal((z.shape[1], hidden)) / np.sqrt(z.shape[1]), np.zeros(hidden), rng.standard_normal(hidden) / np.sqrt(hidden), np.zeros(1)]
        m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(len(z)), max(1, len(z) // 128)):
                h = np.tanh(z[at] @ p[0] + p[1])
                d = (1 / (1 + np.exp(-(h @ p[2] + p[3]))) - y[at]) / len(at)
                back = np.outer(d, p[2]) * (1 - h * h)
                step += 1
                for i, g in enumerate((z[at].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()]))):
                    m[i] = 0.9 * m[i] + 0.1 * g
                    v[i] = 0.999 * v[i] + 0.001 * g * g
                    p[i] -= 0.003 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        if len(calib_y):
            logit, tries = self.logits(calib_x), np.exp(np.linspace(-1.5, 2.5, 161))
            loss = [np.logaddexp(0, -np.where(calib_y == 1, logit, -logit) / t).mean() for t in tries]
            self.temperature = float(tries[int(np.argmin(loss))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        if not self.fit:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def _pooled(docs: DataFrame, keep: list[str], text: str, vectors: np.ndarray, finish, kind: T.DataType) -> DataFrame:
    """Columns `keep` as __0.. and `out`, what `finish` makes of the pooled vectors."""
    schema = T.StructType([*[T.StructField(f"__{i}", docs.schema[c].dataType) for i, c in enumerate(keep)], T.StructField("out", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_for(len(vectors))
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], finish(pool(b.column(len(keep)).to_pylist(), words, vectors))], schema.names)

    return docs.select(*[docs[c].alias(f"__{i}") for i, c in enumerate(keep)], text_of(docs, text).alias("__text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, held: int = 0, rows: int = 32768, dim: int = 64, ones: int = 4, reach: int = 2, sample: int = 20_000) -> tuple[np.ndarray, Network]:
    """Word vectors (from all documents) and the network (from labelled documents outside the held-out fold; the next fold calibrates)."""
    vectors = word_vectors(contexts(docs, text, rows, dim, ones, reach), ones)
    known = labels.select(labels[key].alias("k"), labels[label].alias("y")).where("k IS NOT NULL AND y IS NOT NULL").where(fold("k", folds) != held)
    known = known.groupBy("k").agg((F.avg("y") >= 0.5).cast("double").alias("y")).orderBy(F.xxhash64("k"), "k").limit(sample)
    named = docs.select(docs[key].alias("k"), text_of(docs, text).alias("text")).join(F.broadcast(known), "k")  # `sample` rows at most
    got = _pooled(named, ["k", "y"], "text", vectors, lambda x: pa.array([v.tobytes() for v in x.astype("<f4")], pa.binary()), T.BinaryType())
    got = got.select(F.col("__1").alias("y"), "out", (fold("__0", folds) == (held + 1) % folds).alias("calibrates"), F.xxhash64("__0", "out").alias("h")).orderBy("h").limit(sample).toPandas()
    if got.empty:
        return vectors, Network(np.zeros((0, vectors.shape[1])), np.zeros(0), np.zeros((0, vectors.shape[1])), np.zeros(0))
    x, y, c = np.stack([np.frombuffer(v, "<f4") for v in got["out"]]).astype(np.float64), got["y"].to_numpy(np.float64), got["calibrates"].to_numpy(bool)
    if len(np.unique(y[~c])) < 2:
        c[:] = False
    return vectors, Network(x[~c], y[~c], x[c], y[c])


def score(docs: DataFrame, model: tuple[np.ndarray, Network], keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """The columns `keep` (all, if not named) and `__score`, between 0 and 1."""
    vectors, network = model
    keep = docs.columns if keep is None else keep
    out = _pooled(docs, keep, text, vectors, lambda x: pa.array(network.probability(x), pa.float64()), T.DoubleType())
    return out.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(keep)], F.col("out").alias("__score"))
