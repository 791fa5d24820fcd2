"""Every pipeline stage on its own input, against brute force; all stages over the given tables and over odd rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodegrid.llm import decontam, packing, quality, secrets, simhash

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    folder, docs, out = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        done = spark.read.parquet(f"{folder}/{k}")
        out.append((docs, done))
        docs = done
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def shingles(text):
    w = text.encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_columns(spark, steps):
    cols = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(done.columns == cols for _, done in steps[:4]) and len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


def test_quality_stage(spark, steps):
    docs, done = steps[0]
    vectors, network = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    w = quality.Words(len(vectors))
    want = set()
    for d, r in rows(docs).items():
        ids = w.of(r["text"] or "").astype(np.int64)
        x = vectors[ids].astype(np.float64).mean(0) if len(ids) else np.zeros(vectors.shape[1])
        if network.probability(x[None, :])[0] >= 0.3:
            want.add(d)
    assert set(rows(done)) == want
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [d for d in rows(docs) if labels.get(d) == 1]
    assert len(want & set(good)) >= 0.97 * len(good)


def test_near_duplicate_stage(steps):
    docs, done = (rows(d) for d in steps[1])
    s = {d: shingles(r["text"] or "") for d, r in docs.items()}
    like = {(a, b): len(s[a] & s[b]) / max(1, len(s[a] | s[b])) for a, b in itertools.combinations(sorted(docs), 2)}
    assert all(max((j for p, j in like.items() if d in p), default=0) >= 0.8 for d in set(docs) - set(done))  # nothing without a near copy goes
    assert not [p for p, j in like.items() if j >= 0.8 and p[0] in done and p[1] in done]
    assert all(done[d] == docs[d] for d in done)


def test_decontamination_stage(spark, steps):
    docs, done = (rows(d) for d in steps[2])
    items = [decontam.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    hold = {d for d, r in docs.items() for w in [b" " + b" ".join(decontam.words_of(r["text"])) + b" "] if any(b" " + b" ".join(i) + b" " in w for i in items)}
    assert hold and not hold & set(done) and len(done) >= len(docs) - len(hold) - 2


def test_secret_stage(steps):
    docs, done = (rows(d) for d in steps[3])
    assert set(docs) == set(done)
    for d, r in docs.items():
        spans = secrets.base_spans(r["text"])
        assert not secrets.base_spans(done[d]["text"]) and done[d]["n_chars"] == len(done[d]["text"])
        assert spans or done[d]["text"] == r["text"] or "[secret]" in done[d]["text"]


def test_packing_stage(steps):
    import public_tokenizers

    e = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    docs, pieces = rows(steps[4][0]), steps[4][1].orderBy("doc_id", "start").collect()
    for d, group in itertools.groupby(pieces, key=lambda r: r["doc_id"]):
        assert b"".join(bytes(r["ids"]) for r in group) == e.ids(docs[d]["text"]) + np.array([2], "<u4").tobytes()
    assert {r["doc_id"] for r in pieces} == set(docs)


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    cols = "doc_id long, text string, lang string, source string, n_chars long, __x string, spans string, score double, `row` long"
    odd = [(None, None, None, None, None, None, None, None, None), (1, "", "en", "s", 0, "x", "y", 0.0, 1), (1, "", "en", "s", 0, "x", "y", 0.0, 1), (2, "secret = abcdefghijklmnop", "en", "s", 25, "x", "y", 0.0, 1), (3, "word " * 30_000, "en", "s", 150_000, "x", "y", 0.0, 1)]
    spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (2, "a few words of a test item that nobody copied so far")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, data in (("odd", odd), ("none", [])):
        spark.createDataFrame(data, cols).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}{k}")
            docs = spark.read.parquet(f"{tmp_path}/{name}{k}")
            assert k == 4 or docs.columns == [c.split()[0].strip("`") for c in cols.split(", ")]
        assert docs.select("doc_id").distinct().count() == (3 if data else 0)
    kept = spark.read.parquet(f"{tmp_path}/odd3").collect()
    assert sorted(str(r["text"])[:12] for r in kept) in (["None", "[secret]", "word word wo"], ["", "[secret]", "word word wo"])


def test_run_gives_the_last_stage(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    same = lambda df: sorted(map(tuple, df.select("doc_id", "start", "length", F.crc32("ids"), "doc_tokens").collect()))
    assert same(got) == same(steps[4][1])


def test_shingle_fingerprint_of_copies_is_equal():
    assert simhash.fingerprint("A b  c\nd e f", 5, 3, distinct=True) == simhash.fingerprint("a b c d e f", 5, 3, distinct=True)
