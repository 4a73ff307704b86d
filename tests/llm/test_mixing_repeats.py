"""Rows that are equal in all columns: their words come near the target like those of different rows."""

from collections import Counter

from pyspark.sql import functions as F

from cohortmart.llm import mixing


def test_one_row_many_times_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES", 100)
    data = [(1, "a b c d e f g", "a", 5)] * 3000 + [(k, "w " * (k % 40), "a" if k % 3 else "b", k) for k in range(2, 500)] + [(1, "a b c d e f g", "a", 6)] * 2
    docs = spark.createDataFrame(data, "doc_id long, text string, source string, n_chars long")
    copies = mixing.mix_copies(docs).toPandas()
    for source, own in copies.groupby("source"):
        taken, target = (own["copies"] * own["size"]).sum(), own["target"].iloc[0]
        assert abs(taken - target) <= 0.02 * target, source
    assert (copies["copies"] <= 2 * copies["n_rows"]).all()
    got = Counter((r["doc_id"], r["source"], r["n_chars"]) for r in mixing.mix_documents(docs).collect())
    want = Counter()
    for r in docs.withColumn("doc_key", mixing.row_key(docs)).dropDuplicates(["doc_key"]).join(spark.createDataFrame(copies[["doc_key", "copies"]]), "doc_key").collect():
        if r["copies"]:
            want[r["doc_id"], r["source"], r["n_chars"]] = r["copies"]
    assert got == want
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = mixing.query(spark, str(tmp_path))
    assert rows.count() == len(data) and rows.where("taken > 2 * size").count() == 0
    sums = rows.groupBy("source_size").agg(F.sum("taken").alias("t"), F.max("target").alias("x")).collect()
    assert all(abs(r["t"] - r["x"]) <= 0.02 * r["x"] for r in sums)
