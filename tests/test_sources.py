import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cohortmart.functions.literals import infer_types, literal_text, without_comments
from cohortmart.operators.marts import STAGED
from cohortmart.plans.pipeline import Job, run_pipeline
from cohortmart.sources import dump, files
from cohortmart.streaming.scores import best_stream, staged_stream
from tests.conftest import rows

DUMP = """-- dump of INSERT INTO `nothing` VALUES (1);
CREATE TABLE `scores` (
  `id` bigint(20) NOT NULL,
  `user_id` int(10) unsigned,
  `data` text,
  PRIMARY KEY (`id`),
  KEY `user` (`user_id`)
) ENGINE=InnoDB;
INSERT INTO `scores` (`id`, `user_id`, `data`) VALUES
(1,101,'{"mods":[{"acronym":"DT"}], "a": "x;y) -- z"}'),
(2, -102, 'it''s'),
(3,NULL,'say \\'hi\\' \\\\ there');
INSERT INTO osu_scores_high (id) VALUES (7);
INSERT INTO `scores` VALUES (4,104);
INSERT INTO scores (id, user_id, data) VALUES (5,105,'cut off
"""


@pytest.fixture
def dump_file(tmp_path):
    p = tmp_path / "d.sql"
    p.write_text(DUMP)
    return str(p)


def test_dump_rows(spark, dump_file):
    got = rows(dump.read_insert_dump(spark, dump_file, "scores"))
    assert got == [(1, 101, '{"mods":[{"acronym":"DT"}], "a": "x;y) -- z"}'), (2, -102, "it's"), (3, None, "say 'hi' \\ there"), (4, 104, None)]
    assert rows(dump.read_insert_dump(spark, dump_file, "osu_scores_high")) == [("7",)]
    assert dump.read_insert_dump(spark, dump_file, "absent").count() == 0


def test_dump_without_names_or_types_and_empty_files(spark, tmp_path):
    (tmp_path / "a.sql").write_text("INSERT INTO t VALUES (1,,'x'),( 2 , null,'');\n")
    (tmp_path / "b.sql").write_text("no sql at all\n")
    (tmp_path / "c.sql").write_text("")
    df = dump.read_insert_dump(spark, f"{tmp_path}/a.sql", "t")
    assert df.columns == ["col_0", "col_1", "col_2"] and rows(df) == [("1", None, "x"), ("2", None, "")]
    assert dump.read_insert_dump(spark, f"{tmp_path}/b.sql", "t").count() == 0
    assert dump.dump_tables(spark, f"{tmp_path}/c.sql").count() == 0


def test_dump_tables_schema_and_counts(spark, dump_file):
    assert [r[0] for r in dump.dump_tables(spark, dump_file).collect()] == ["osu_scores_high", "scores"]
    assert rows(dump.dump_schema(spark, dump_file, "scores")) == [(0, "id", "bigint"), (1, "user_id", "int"), (2, "data", "text")]
    assert rows(dump.dump_row_counts(spark, dump_file)) == [("osu_scores_high", 1), ("scores", 4)]


def test_literals(spark):
    raw = ["NULL", "null", "", " 'a' ", "''", "'it''s'", "12", "-1.5", "'NULL'", r"'a\'b\"c\\'"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", literal_text(F.col("r")).alias("v"))
    assert [r["v"] for r in df.orderBy("i").collect()] == [None, None, None, "a", "", "it's", "12", "-1.5", "NULL", "a'b\"c\\"]
    one = spark.createDataFrame([("/* a\nb */ INSERT -- c\nINTO t VALUES",)], "h string").select(without_comments(F.col("h"))).first()[0]
    assert " ".join(one.split()) == "INSERT INTO t VALUES"


def test_types_are_inferred_from_all_rows(spark):
    df = spark.createDataFrame([("1", "1", "x", None), ("2", "2.5", "1", None), (None, None, None, None)], "a string, b string, c string, d string")
    assert rows(infer_types(df)) == [("a", "bigint"), ("b", "double"), ("c", "string"), ("d", "string")]


def test_sharded_parquet_and_manifest(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.write_sharded(spark.range(50_000).coalesce(1), path, 20_000, 5_000)
    m = files.parquet_manifest(spark, path, "t").collect()
    assert sorted(r["rows"] for r in m) == [10_000, 20_000, 20_000]
    import pyarrow.parquet as pq

    assert max(pq.ParquetFile(f"{path}/{r['file']}").metadata.num_row_groups for r in m) == 4
    assert all(os.path.getsize(f"{path}/{r['file']}") == r["size_bytes"] and r["hash"].startswith("sha256:") for r in m)
    s = files.manifest_summary(spark, path, "t").first()
    assert s["total_rows"] == 50_000 and s["schema"][0]["type"] == "bigint" and json.loads(files.manifest_summary(spark, path, "t").toJSON().first())["version"] == "1.0"
    files.write_sharded(spark.range(3), path, mode="ignore")
    assert spark.read.parquet(path).count() == 50_000


def test_untyped_and_empty_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, 1.5, "a", True)], "i long, d double, s string, b boolean").withColumn("n", F.lit(None))
    files.write_sharded(df, f"{tmp_path}/a")
    assert dict(spark.read.parquet(f"{tmp_path}/a").dtypes)["n"] == "string"
    files.write_sharded(df.limit(0), f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 0
    with pytest.raises(AnalysisException):
        files.load_raw(spark, f"{tmp_path}/none/*.parquet")


def test_table_path_and_counts(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/x/t")
    assert files.table_path(spark, f"{tmp_path}/x", "t") == f"{tmp_path}/x/t/*.parquet"
    assert files.table_path(spark, f"{tmp_path}/x", "u") == f"{tmp_path}/x/*.parquet"
    assert rows(files.table_counts({"t": spark.range(2), "gone": None}, spark)) == [("gone", 0), ("t", 2)]


def test_csv_and_tsv_keep_odd_values(spark, tmp_path):
    schema = "i int, s string"
    data = [(1, 'a "q" b'), (2, "c,d"), (3, None), (4, "x\\y"), (5, "two\nlines"), (6, ""), (7, "tab\there")]
    df = spark.createDataFrame(data, schema)
    files.write_csv_chunks(df.coalesce(1), f"{tmp_path}/c", 3)
    files.write_tsv(df, f"{tmp_path}/t")
    assert rows(files.read_csv_chunks(spark, f"{tmp_path}/c", schema)) == data
    assert rows(files.read_tsv(spark, f"{tmp_path}/t", schema)) == data
    assert len([f for f in os.listdir(f"{tmp_path}/c") if f.endswith(".csv")]) == 3


def test_jdbc_round_trip(spark):
    url, driver = "jdbc:derby:memory:plays;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    try:
        spark.range(100).select(F.col("id").alias("ID")).write.jdbc(url, "T", properties={"driver": driver})
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no embedded database here: {str(e)[:80]}")
    df = files.read_jdbc_table(spark, url, "T", "ID", 0, 100, 4, driver=driver)
    assert df.rdd.getNumPartitions() == 4 and df.count() == 100
    assert files.read_jdbc_table(spark, url, "T", driver=driver).count() == 100


def test_pipeline_phases_and_rerun(spark, tmp_path):
    os.makedirs(f"{tmp_path}/dumps")
    cols = "`id`, `user_id`, `beatmap_id`, `score`, `pp`, `playmode`, `data`"
    create = "CREATE TABLE `scores` (`id` bigint, `user_id` bigint, `beatmap_id` bigint, `score` bigint, `pp` double, `playmode` int, `data` text);\n"
    mods = '{"mods":[{"acronym":"DT"}]}'
    (tmp_path / "dumps/scores.sql").write_text(f"{create}INSERT INTO `scores` ({cols}) VALUES\n(1,1,1,9,5.5,0,'{mods}'),(2,1,1,9,6.5,0,'{mods}'),(3,1,1,9,7,1,NULL);\n")
    job = Job(f"{tmp_path}/dumps", f"{tmp_path}/parquet", f"{tmp_path}/warehouse")
    assert all(n == 0 for _, n in rows(run_pipeline(spark, job, dry_run=True)))
    want = {"raw_scores": 3, "raw_items": 0, "raw_item_sets": 0, "best_plays": 1, "user_topk": 1, "item_user_sets": 1}
    for _ in range(2):
        assert dict(rows(run_pipeline(spark, job))) == want
    best = spark.read.parquet(job.at("best_plays")).first()
    assert (best["id"], best["variant_key"], best["speed_mod"]) == (2, "DT", "DT")
    with pytest.raises(ValueError):
        run_pipeline(spark, job, ("lead",))


def test_stream_of_score_files(spark, tmp_path):
    schema = StructType.fromDDL("id long, user_id long, item_id long, score long, pp double, playmode int, data string, variant_key string, speed_mod string")
    for k, pp in enumerate((5.0, 7.0, None, 6.0)):
        spark.createDataFrame([(k, 1, 1, 0, pp, 0, None, "", None), (k, 1, 1, 0, 99.0, 1, None, "", None)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    staged = staged_stream(spark, f"{tmp_path}/in", schema, files_at_once=1)
    assert tuple(staged.columns) == STAGED
    q = best_stream(staged).writeStream.outputMode("complete").format("memory").queryName("best_now").option("checkpointLocation", f"{tmp_path}/cp").start()
    try:
        q.processAllAvailable()
        assert [(r["id"], r["pp"]) for r in spark.table("best_now").collect()] == [(1, 7.0)]
    finally:
        q.stop()
