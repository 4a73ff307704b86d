"""Quality classifier against plain counts, a plain decomposition, plain votes, and on held-out documents."""

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortmart.llm import quality

GOOD = "the quick brown fox jumps over the lazy dog while rain falls on old stone roofs and nobody in town seems to mind".split()


def good(k):
    rnd = random.Random(k)
    return " ".join(rnd.choice(GOOD) for _ in range(60)).capitalize() + "."


def bad(k):
    rnd = random.Random(k)
    if k % 2:
        return " ".join(w for _ in range(10) for w in [rnd.choice(GOOD)] * 6)
    return " ".join(f"{rnd.choice(GOOD).upper()}!!" for _ in range(60))


def table_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def model(spark):
    texts = [good(k) if k % 3 else bad(k) for k in range(90)]
    docs = table_of(spark, texts)
    return quality.train(docs, docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("quality")))


def test_counts_of_terms():
    """N-grams one by one; words of equal form and place count for equal terms; parts of long texts add up."""
    text = "Ab ab, ab"
    row = quality.term_counts([text])[0]
    plain = np.zeros(quality.BUCKETS, np.int64)
    for n in quality.ORDERS:
        for k in range(len(text) - n + 1):
            h = np.uint64(0)
            for c in text[k : k + n]:
                h = np.array([h]) * np.uint64(0x100000001B3) + np.array([ord(c)], np.uint64)
                h = h[0]
            plain[int(quality.mix(np.array([h]) + np.uint64(n))[0]) % quality.BUCKETS] += 1
    rest = row - plain
    assert rest.min() >= 0 and rest.sum() == 3 + 2  # three words and two pairs of neighbours
    same = quality.term_counts(["xx yy yy zz", "xx yy ya zz"])
    assert not np.array_equal(same[0], same[1])
    forms = [set(np.flatnonzero(quality.term_counts([t])[0])) for t in ("ab ab", "ab ba")]
    assert forms[0] != forms[1]


def test_long_texts_count_whole(monkeypatch):
    text = " ".join(good(k) for k in range(40))
    whole = quality.term_counts([text, "", "a"])
    real = quality.pieces
    monkeypatch.setattr(quality, "pieces", lambda texts, overlap: real(texts, overlap, 1000))
    assert np.array_equal(quality.term_counts([text, "", "a"]), whole)


def test_space_is_the_leading_singular_vectors():
    rows = np.random.default_rng(3).standard_normal((40, 12)) * np.arange(12, 0, -1) ** 2
    got, want = quality.latent_space(rows, 4), np.linalg.svd(rows, full_matrices=False)[2][:4].T
    assert np.allclose(got @ got.T, want @ want.T, atol=1e-4)


def test_scores_are_the_votes_of_the_nearest(model):
    texts = [good(1000), bad(1001), bad(1002), good(1003) + " " + bad(1003), "x", "", None]
    got = quality.score_texts(model, texts)
    for text, score in zip(texts[:5], got, strict=False):
        counts = quality.term_counts([text])[0]
        row = [math.log1p(c) * i for c, i in zip(counts, model.idf, strict=True)]
        low = np.array(row) @ model.space.astype(np.float64)
        cosine = [float(np.dot(low, v) / np.linalg.norm(low) / np.linalg.norm(v)) for v in model.vectors.astype(np.float64)]
        nearest = sorted(range(len(cosine)), key=lambda k: -cosine[k])[: quality.NEIGHBOURS]
        votes = [max(cosine[k], 1e-6) ** quality.POWER * model.weights[k] for k in nearest]
        assert abs(score - sum(v for v, k in zip(votes, nearest, strict=True) if model.labels[k] == 1) / sum(votes)) < 1e-3
    assert got[0] > 0.9 and got[1] < 0.1 and got[2] < 0.1 and got[5] == got[6] == model.empty_score
    assert np.array_equal(quality.score_texts(model, [good(k) for k in range(300)])[-3:], quality.score_texts(model, [good(k) for k in range(300)][-3:])) or np.allclose(
        quality.score_texts(model, [good(k) for k in range(300)])[-3:], quality.score_texts(model, [good(k) for k in range(300)][-3:]), atol=1e-5
    )


def test_weights_of_terms_come_from_all_texts(spark):
    docs = table_of(spark, ["aa bb", "aa", None, ""])
    idf = quality.inverse_frequencies(docs)
    seen = (quality.term_counts(["aa bb", "aa", "", ""]) > 0).sum(axis=0)
    assert np.allclose(idf, np.log(5 / (1 + seen)), atol=1e-6)


def test_edge_cases(spark, model):
    texts = [None, "", " \n", "word", "日本語 テキスト", "x" * 5000, good(7) * 300, good(7), good(7), "\x00 \x7f"]
    docs = table_of(spark, texts).selectExpr("doc_id", "text", "'a' AS Score", "1.5 AS given_text", "text AS other")
    got = {r["doc_id"]: r for r in quality.score_quality(docs, model).collect()}
    assert len(got) == len(texts) and set(got[0].asDict()) == {"doc_id", "given_text", "other", "score", "predicted"}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    assert got[0]["score"] == got[1]["score"] == model.empty_score and got[7]["score"] == got[8]["score"]
    assert quality.score_quality(docs.limit(0), model).count() == 0
    nothing = docs.limit(0)
    unlearned = quality.train(nothing, nothing.selectExpr("doc_id", "CAST(NULL AS INT) AS quality"))
    assert {r["score"] for r in quality.score_quality(docs, unlearned).collect()} == {0.5}
    one_class = quality.train(docs, docs.selectExpr("doc_id", "CAST(1 AS INT) AS quality"))
    assert min(r["score"] for r in quality.score_quality(docs, one_class).collect()) > 0.5


def test_held_out_documents(spark):
    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("test tables are not there")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "quality")
    rows = quality.query(spark, "/root/testdata/sf0.1").where("held_out").join(labels, "doc_id").collect()
    wrong = {y: sum(r["predicted"] != y for r in rows if r["quality"] == y) for y in (0, 1)}
    assert wrong[0] <= 0.05 * sum(r["quality"] == 0 for r in rows) and wrong[1] <= 0.01 * len(rows)
