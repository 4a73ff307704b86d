"""Steps that have to grow no faster than their input."""

import gzip
import time

from pyspark.sql import functions as F

from cohortmart.functions.literals import NUMBER, WHOLE, infer_types
from cohortmart.operators import bitmaps, cooccurrence, recommend
from cohortmart.sources import dump, files, statements
from tests.conftest import rows


def test_plays_and_not_bitmaps_are_shuffled(spark):
    """Items of few users in every task: a bitmap has 4 KB wherever it is made, so none is made before the shuffle."""
    plays = spark.range(0, 4000, 1, 8).selectExpr("id % 500 AS item_id", "id % 2 AS variant_key", "id * 100 AS user_no")
    made = bitmaps.item_bitmaps(plays)
    below = made._jdf.queryExecution().executedPlan().toString().split("Exchange", 1)
    assert "bitmap_construct_agg" in below[0] and "bitmap_construct_agg" not in below[1]
    assert rows(bitmaps.bitmap_sizes(made, "item_id")) == sorted([(k, 8) for k in range(500)], key=repr)


def test_text_that_is_no_number_is_not_tried(spark):
    """The guard admits all that a cast to double takes; columns of words and of fractions take about as long as one of whole numbers."""
    odd = ["1", " 1 ", "1.5", "1e5", ".5", "5.", "1d", "1F", "0x1p3", "0x1.8P-1d", "inf", "-inf", "+Infinity", "NaN", "+NaN", "nan ", "\t1.5\n", "\x001", "1e400", "-.5e-3f"]
    odd += ["abc", "1998-09-02", "", "+", "-", "1e", "1 2", "１", "1L", "infinityx", "0x10", "1_0", "1,5", "N", ".", "+3", "-4 ", "\x7f5", "\x856\x1f", "9" * 19, "1.0", "\t\n7\r"]
    df = spark.createDataFrame([(v,) for v in odd], "v string")
    assert df.where(F.col("v").try_cast("bigint").isNotNull() & ~F.col("v").rlike(WHOLE)).count() == 0
    assert df.where(F.col("v").try_cast("double").isNotNull() & ~F.col("v").rlike(NUMBER)).count() == 0
    for v, kind in (("1.5", "double"), ("N", "string"), ("1e5 ", "double"), (" 7", "bigint"), ("1998-09-02", "string"), (None, "string")):
        assert rows(infer_types(spark.createDataFrame([(v,), ("1",)] if v else [(None,)], "v string"))) == [("v", kind)]

    def seconds(value):
        df = spark.range(0, 300_000, 1, 1).select(F.concat(F.lit(value), F.col("id") % 10).alias("v"))
        infer_types(df).collect()
        start = time.perf_counter()
        infer_types(df).collect()
        return time.perf_counter() - start

    whole = seconds("12")
    assert seconds("N of no number ") < 4 * whole + 0.5 and seconds("12.5") < 4 * whole + 0.5


def test_a_row_of_the_reader_is_no_longer_than_a_statement(spark, tmp_path):
    """A dump without line breaks; an empty line in a value; a packed dump; a last semicolon that is or isn't there."""
    text = "".join(f"INSERT INTO t (k, v) VALUES ({k},'a\n\nb');" for k in range(50))
    (tmp_path / "a.sql").write_text(text.replace("\n", " "))
    assert statements._lines(spark, f"{tmp_path}/a.sql").count() == 50
    (tmp_path / "b.sql").write_text(text)
    (tmp_path / "c.sql").write_text(text[:-1] + " -- no; end")
    (tmp_path / "d.sql.gz").write_bytes(gzip.compress(text.encode()))
    for name in ("b.sql", "c.sql", "d.sql.gz"):
        assert rows(dump.read_insert_dump(spark, f"{tmp_path}/{name}", "t")) == sorted([(str(k), "a\n\nb") for k in range(50)], key=repr)
    found = statements.statements(spark, f"{tmp_path}/*").where("NOT ended").collect()
    assert [r["file"].rsplit("/", 1)[1] for r in found] == ["c.sql"]


def test_pairs_of_seeds_and_items_are_counted_behind_the_shuffle(spark):
    """Arrays are shuffled by seed, to tasks of a bounded number of pairs; seeds of more pairs are counted before."""
    plays = spark.range(0, 6000, 1, 4).selectExpr("id % 300 AS user_id", "id % 700 AS item_no").distinct().cache()
    members = spark.range(0, 900, 1, 4).selectExpr("id % 300 AS user_id", "CASE WHEN id < 300 THEN -1 ELSE id % 50 END AS seed_no").distinct().cache()
    want = rows(members.join(plays, "user_id").groupBy("seed_no", "item_no").count())
    total = members.join(plays, "user_id").count()
    for pairs, heavy in ((total, False), (total // 40, True), (0, True)):
        got = cooccurrence.co_occurrence(members, plays, 4, max(pairs, 1))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("Union" in plan) == heavy and rows(got) == want
    plan = cooccurrence.co_occurrence(members, plays, 4, total // 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.split("Generate explode(items")[0].split("Union")[-1]
    parts = cooccurrence.co_occurrence(members.where("seed_no >= 0"), plays, 4, total // 30).rdd.getNumPartitions()
    assert parts >= 15


def test_counts_of_all_seeds_meet_their_description_in_one_join(spark):
    """One join gives the counts their items, one all that is told of these; statistics and dimensions meet before."""
    best = spark.range(4000).selectExpr("id % 200 AS user_id", "id % 40 AS item_id", "'DT' AS variant_key", "CAST(id AS DOUBLE) AS pp").dropDuplicates(["user_id", "item_id"])
    seeds = spark.range(40).selectExpr("id AS seed_id", "id AS item_id", "CAST(NULL AS DOUBLE) AS pp_low", "CAST(NULL AS DOUBLE) AS pp_high", "CAST(NULL AS STRING) AS variant")
    items = spark.range(30).selectExpr("id AS item_id", "id % 4 AS set_id", "'v' AS version", "1.0 AS difficultyrating")
    sets = spark.range(3).selectExpr("id AS set_id", "'a' AS artist", "'t' AS title")
    found = recommend.recommend_for_seeds(best, seeds, items, sets)
    above = found._jdf.queryExecution().executedPlan().toString().split("Generate explode(items")[0]
    assert above.count("Join") == 2
    assert {r["item_id"] for r in found.collect()} == {k for k in range(30) if k % 4 < 3}


def test_small_files_are_read_once_whole_by_few_tasks(spark, tmp_path):
    """A file of one statement that it cuts off: no shuffle, one look at it, and not a task for every 32 of them."""
    (tmp_path / "many").mkdir()
    for k in range(400):
        (tmp_path / f"many/{k}.sql").write_text(f"INSERT INTO t (a) VALUES ({k}),('{k}")
    (tmp_path / "marked.sql").write_bytes("\ufeffINSERT INTO t (a) VALUES (1);\nINSERT INTO t (a) VALUES (2".encode())
    found = statements.statements(spark, f"{tmp_path}/many")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1 and found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert sorted((r["offset"], r["ended"], r["text"]) for r in found.collect()) == sorted((0, False, f"INSERT INTO t (a) VALUES ({k}),('{k}") for k in range(400))
    marked = statements.statements(spark, f"{tmp_path}/marked.sql").orderBy("offset").collect()
    assert [(r["offset"], r["ended"], r["text"].strip()) for r in marked] == [(3, True, "INSERT INTO t (a) VALUES (1)"), (33, False, "INSERT INTO t (a) VALUES (2")]
    # Beside a file that Spark splits, and packed ones.
    long = "INSERT INTO t (a) VALUES " + ",".join(f"({k})" for k in range(1_000_000)) + ";\n"
    (tmp_path / "many/long.sql").write_text(long + "INSERT INTO t (a) VALUES (-1), ('cut")
    (tmp_path / "many/packed.sql.gz").write_bytes(gzip.compress(b"INSERT INTO t (a) VALUES (-2)"))
    assert len(long) > statements._least(spark)
    assert rows(dump.dump_row_counts(spark, f"{tmp_path}/many")) == [("t", 400 + 1_000_000 + 1 + 1)]
    left = dump.dump_rejects(spark, f"{tmp_path}/many").select("reason", "n_rows_kept", "text")
    assert rows(left) == sorted([("incomplete list", 1, f"('{k}") for k in [*range(400), "cut"]], key=repr)


def test_a_file_for_each_row_starts_no_process(spark, tmp_path):
    """Before, Spark's writer took about 15 ms of a task for each file."""
    texts = [f"({k}, 'ä;\n" for k in range(3000)] + ["", None, "same", "same"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(3).cache()
    df.count()
    start = time.perf_counter()
    files.write_each(df, f"{tmp_path}/each")
    assert time.perf_counter() - start < 10
    files.write_each(df.limit(0), f"{tmp_path}/none")
    found = [p for p in (tmp_path / "each").rglob("*") if p.is_file()]
    assert sorted(p.read_bytes().decode() for p in found) == sorted(t or "" for t in texts)
    assert max(len(list(d.iterdir())) for d in (tmp_path / "each").iterdir()) <= files.FOLDER
    assert spark.read.option("wholetext", True).text(f"{tmp_path}/each/*/*").count() == len(texts) - 2  # Spark passes over empty files


def test_a_file_for_each_row_on_a_file_system_that_is_not_mounted(spark, tmp_path):
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.each.link./data", f"file://{tmp_path}")
    files.write_each(spark.createDataFrame([("(1,'a",), ("b",)], "t string"), "viewfs://each/data/x")
    assert sorted(r[0] for r in spark.read.text("viewfs://each/data/x/*/*").collect()) == ["(1,'a", "b"]
