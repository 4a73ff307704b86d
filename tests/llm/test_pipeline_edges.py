"""The whole pipeline on empty tables, null and blank texts, repeated rows and columns with clashing names; tables left behind."""

import os

import corpus_pipeline
from cohortmart.llm import common
from cohortmart.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, key_a string, copies int, component string, predicted int, node string"


def tables(spark, path, docs, labels):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, "some words of a benchmark that nobody has seen"), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_odd_rows(spark, tmp_path):
    texts = [None, "", " \n", "one", "a b c d e f g h", "a b c d e f g h", "we read some words of a benchmark that nobody has seen today", "x" * 3000]
    docs = [(k, t, None, None if k % 2 else "s", None, 0.1, "k", 3, "c", 1, "n") for k, t in enumerate(texts)]
    docs += [docs[3], docs[4], (None, "no id at all", "en", "s", 1, None, None, None, None, None, None)]
    sf = tables(spark, tmp_path, docs, [(k, 1, k % 2) for k in range(8)] + [(3, None, None), (None, 0, 1)])
    got = [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()]
    kept = {r["doc_id"] for r in got}
    assert {0, 1, 2} <= kept and 6 not in kept and len({4, 5} & kept) <= 1 and all(r["n_tokens"] >= 1 for r in got)


def test_no_documents(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, [], [(1, 1, 0)])).count() == 0


def test_tables_between_steps_are_removed(spark, tmp_path):
    folder = common.shared_folder(spark).removeprefix("file://")
    there = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    docs = [(k, f"word{k} and other words {k % 3}", "en", "s", 1, None, None, None, None, None, None) for k in range(20)]
    corpus_pipeline.run(spark, tables(spark, tmp_path, docs, [(k, 1, k % 2) for k in range(20)])).count()
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - there}
    assert left == {f"pipeline-{name}" for name, _ in corpus_pipeline.STAGES} | {"pipeline-orc"}
    there = set(os.listdir(folder))
    chain = spark.createDataFrame([(k, k + 1) for k in range(100)], "a long, b long")
    assert connected_components(chain, "a", "b").count() == 101
    assert len(set(os.listdir(folder)) - there) == 1
