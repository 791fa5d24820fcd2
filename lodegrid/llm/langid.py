"""Language identification in two steps: the family first, then one-versus-one linear support vector machines inside it.

A text is the square roots of its relative counts of hashed two- and three-letter strings (anything but a letter counts as a space). The
families come from a fixed table of well-known languages; a language that is not in it is a family of its own. All machines are fitted
on a bounded sample: `sample` documents of each language at most, by a hash of id and text.

Defined results: null texts and texts without a letter are `und` with score 0, as is everything if there is nothing to learn from; null
languages are never learned; repeated rows are predicted each by itself; an empty table gives an empty table; further columns are not
read. Long texts are counted in steps, whole.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_of

#: Families of common languages by ISO 639-1 code (well-known facts, not data of ours).
FAMILIES = {
    "germanic": "af da de en fy is lb nl no sv",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "semitic": "am ar he mt",
    "indic": "bn gu hi mr ne pa ur",
    "baltic": "lt lv",
    "celtic": "br cy ga",
}
STEP = 1 << 20


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs.split()), f"={lang}")


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point: is it a letter (category L)?"""
    if not _LETTERS:
        _LETTERS.append(np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)]))
    return _LETTERS[0]


def features(text: str, dim: int) -> np.ndarray | None:
    """Unit vector of the text's letter strings; None without a letter."""
    known, counts, seen = letters(), np.zeros(dim), False
    for lo in range(0, max(len(text), 1), STEP):
        c = np.frombuffer(text[lo : lo + STEP + 2].lower().encode("utf-32-le", "surrogatepass"), "<u4")
        c = np.concatenate([[32], c, [32]]).astype(np.uint32) if lo == 0 else c
        is_letter = known[np.minimum(c, 0x10FFFF)]
        seen = seen or bool(is_letter.any())
        c = np.where(is_letter, c, np.uint32(32)).astype(np.uint32)
        two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
        three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
        blank = c == 32
        for h, empty in ((two, blank[:-1] & blank[1:]), (three, blank[:-2] & blank[1:-1])):
            h = h[~empty]
            counts += np.bincount(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - int(dim).bit_length() + 1), minlength=dim)
    if not seen:
        return None
    return np.sqrt(counts / counts.sum())


class Machine:
    """Linear support vector machine (hinge loss, Pegasos steps, averaged)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, penalty: float = 1e-4, epochs: int = 12, seed: int = 11):
        rng, n = np.random.default_rng(seed), len(x)
        w, b, mean_w, mean_b, t = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0, 0
        weight = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
        for _ in range(epochs):
            for at in np.array_split(rng.permutation(n), max(1, n // 32)):
                t += 1
                rate = 1 / (penalty * (t + 1000))
                bad = at[y[at] * (x[at] @ w + b) < 1]
                w *= 1 - rate * penalty
                if len(bad):
                    push = rate * weight[bad] * y[bad] / len(at)
                    w += push @ x[bad]
                    b += 0.01 * push.sum()
                mean_w += (w - mean_w) / t
                mean_b += (b - mean_b) / t
        self.w, self.b = mean_w, mean_b
        self.scale = max(float(np.std(x @ self.w + self.b)), 1e-9)

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Distance to the border, in standard deviations of the training texts."""
        return (x @ self.w + self.b) / self.scale


class Model:
    """Families against each other (one against the rest), languages of a family pairwise."""

    def __init__(self, x: np.ndarray, langs: np.ndarray):
        self.langs = sorted(set(langs))
        family = np.array([family_of(v) for v in langs])
        self.families = sorted(set(family))
        self.members = {f: [v for v in self.langs if family_of(v) == f] for f in self.families}
        self.of = {f: Machine(x, np.where(family == f, 1.0, -1.0)) for f in self.families} if len(self.families) > 1 else {}
        self.pairs = {}
        for f in self.families:
            for a, b in combinations(self.members[f], 2):
                m = (langs == a) | (langs == b)
                self.pairs[a, b] = Machine(x[m], np.where(langs[m] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        sure = 1.0
        best = self.families[0]
        if self.of:
            m = np.array([self.of[f].margin(x) for f in self.families])
            p = np.exp(2 * (m - m.max()))
            best, sure = self.families[int(m.argmax())], float((p / p.sum()).max())
        members = self.members[best]
        if len(members) == 1:
            return members[0], sure
        votes, part = dict.fromkeys(members, 0.0), dict.fromkeys(members, 0.0)
        for a, b in combinations(members, 2):
            p = float(1 / (1 + np.exp(-2 * np.clip(self.pairs[a, b].margin(x), -30, 30))))
            votes[a if p >= 0.5 else b] += 1
            part[a] += p
            part[b] += 1 - p
        lang = max(members, key=lambda v: (votes[v], part[v]))
        return lang, sure * part[lang] / (len(members) - 1)


def train(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", dim: int = 4096, sample: int = 600) -> Model | None:
    """Fit on documents where `learn` holds and a language is given; `sample` of each language at most."""
    rows = docs.where(learn & F.col(lang).isNotNull()).select(docs[lang].cast("string").alias("lang"), text_of(docs, text).alias("text"), docs[key].cast("string").alias("k"))
    ranked = rows.select("lang", "k", F.xxhash64("k", "text").alias("h")).withColumn("salt", F.pmod(F.col("h"), F.lit(64)))
    picked = ranked
    for by in (["lang", "salt"], ["lang"]):  # a frequent language is cut down in 64 parts first
        order = Window.partitionBy(*by).orderBy("h", "k")
        picked = picked.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample).drop("n")
    chosen = picked.select("lang", "h").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(v, h, f) for v, h, t in zip(*(c.to_pylist() for c in b.columns)) if (f := features(t, dim)) is not None]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2].astype("<f4").tobytes() for g in got], pa.binary())], ["lang", "h", "x"])

    full = rows.select("lang", "text", F.xxhash64("k", "text").alias("h")).join(F.broadcast(chosen), ["lang", "h"])  # `sample` short rows for each language
    found = full.select("lang", "h", "text").mapInArrow(run, "lang string, h long, x binary").dropDuplicates(["lang", "h"]).orderBy("h", "lang").toPandas()
    if found.empty:
        return None
    return Model(np.stack([np.frombuffer(v, "<f4") for v in found["x"]]).astype(np.float64), found["lang"].to_numpy(str))


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text", dim: int = 4096) -> DataFrame:
    """One row per document: key, lang_pred, score."""
    schema = T.StructType([T.StructField("key", docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [("und", 0.0) if model is None or (f := features(t, dim)) is None else model.predict(f) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64())], ["key", "lang_pred", "score"])

    return docs.select(docs[key].alias("key"), text_of(docs, text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)
