"""The pipeline's stages against plain versions, on the smallest test tables."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from cohortmart.llm import mixing, token_orc, toxicity
from cohortmart.llm.common import share
from cohortmart.llm.components import connected_components
from tests.conftest import rows
from tests.llm.test_edge_cases import contained_truth, jaccard_truth

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "mixing", "tokens"]
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns and 150 < clean.count() <= 200
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    truth = jaccard_truth([texts[i] for i in ids])
    alone = stages["near_duplicates"](spark, docs, SF)
    assert sorted(r["doc_id"] for r in alone.collect()) == [ids[k] for k, *_, kept in truth if kept]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    leaks = {ids[d] for d, *_ in contained_truth([texts[i] for i in ids], items)}
    rest = stages["decontamination"](spark, docs, SF)
    assert {r["doc_id"] for r in rest.collect()} == set(ids) - leaks
    mixed = stages["mixing"](spark, docs, SF)
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == docs.columns and max(counts.values()) <= 2
    assert stages["tokens"](spark, mixed.limit(20), SF).count() == 20


def test_components(spark):
    chain = [(k, k + 1) for k in range(1, 60)] + [(100, k) for k in range(101, 140)] + [(5, 5), (200, 201), (201, 200)]
    got = dict(rows(connected_components(spark.createDataFrame(chain, "a long, b long"), "a", "b")))
    assert {got[k] for k in range(1, 61)} == {1} and {got[k] for k in range(100, 140)} == {100} and got[201] == 200 and len(got) == 102
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")
def test_run_is_the_stages_one_after_the_other(spark):
    """run() against plain versions of the stages, each on what the one before kept; the toxic ones by the operator's own scores."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet").where(share(F.col("doc_id"), 5) != 0))
    toxic = {r["doc_id"] for r in toxicity.score_docs(docs, model).where("predicted = 1").collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in toxic}
    ids = sorted(texts)
    ids = [ids[k] for k, *_, kept in jaccard_truth([texts[i] for i in ids]) if kept]
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {ids[d] for d, *_ in contained_truth([texts[i] for i in ids], items)}
    rest = docs.where(F.col("doc_id").isin([i for i in ids if i not in leaks]))
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_copies(rest).collect()}
    tokenizer, want, start = Tokenizer.from_file(token_orc.tokenizer_path()), [], 0
    for i in sorted(copies):
        for _ in range(copies[i]):
            own = [*tokenizer.encode(texts[i] or "", add_special_tokens=False).ids, 1]
            want.append((i, start, len(own), zlib.crc32(np.asarray(own, "<u4").tobytes())))
            start += len(own)
    got = corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32")
    assert sorted(tuple(r) for r in got.collect()) == want
