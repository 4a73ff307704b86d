"""Bitmaps, co-occurrence, sketches, best plays without a window, and layouts, against plain computations."""

import random
import uuid
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortmart.operators import bitmaps, cohort, cooccurrence, quality, recommend, sketches
from cohortmart.operators.marts import PLAY, best_plays, item_statistics
from cohortmart.sources import files
from tests.conftest import rows

FULL = "id long, user_id long, item_id long, score long, pp double, playmode int, data string, variant_key string, speed_mod string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plays_of(spark, seed=0, users=300, items=40, n=4000):
    rnd = random.Random(seed)
    made = {(rnd.randrange(users) * 977 - 5000, rnd.randrange(items), rnd.choice(["", "DT"])): round(rnd.uniform(0, 500), 2) for _ in range(n)}
    return spark.createDataFrame([(u, i, v, p) for (u, i, v), p in made.items()], "user_id long, item_id long, variant_key string, pp double").cache()


def test_bitmaps_equal_joins(spark):
    best = plays_of(spark)
    numbers = bitmaps.dense_numbers(best, "user_id")
    ordered = sorted({r["user_id"] for r in best.collect()})
    assert rows(numbers) == sorted(((u, k) for k, u in enumerate(ordered)), key=repr)
    # Numbers that fill several buckets, with the ends of a bucket.
    far = numbers.withColumn("user_no", F.col("user_no") * 1013 + F.when(F.col("user_no") % 2 == 0, 0).otherwise(32768))
    for given in (numbers, far):
        plays = bitmaps.numbered_plays(best, given)
        items = bitmaps.item_bitmaps(plays)
        for item, low in ((3, None), (7, 400.0), (7, 9999.0)):
            asked = cohort.cohort_filter(item, low)
            got = bitmaps.bitmap_overlap(items, bitmaps.cohort_bitmap(plays, asked))
            assert rows(got) == rows(cohort.cohort_overlap(best, cohort.cohort_users(best, item, low)))
        assert rows(bitmaps.bitmap_sizes(items, "item_id", "variant_key")) == rows(best.groupBy("item_id", "variant_key").agg(F.count("*")))
    assert bitmaps.dense_numbers(best.limit(0), "user_id").count() == 0


@pytest.mark.parametrize("block", [1, 3, 256])
def test_co_occurrence_with_a_very_active_user(spark, block):
    """One user has a third of all rows; every pair of its blocks has a key of its own."""
    members = [(1, s) for s in range(60)] + [(u, u % 7) for u in range(2, 120)]
    plays = [(1, 100 + i) for i in range(90)] + [(u, 100 + (u * k) % 50) for u in range(2, 120) for k in (1, 2)] + [(999, 5)]
    plays = sorted(set(plays))
    want = Counter((s, i) for u, s in members for v, i in plays if u == v)
    m = spark.createDataFrame(members, "user_id long, seed_no long")
    p = spark.createDataFrame(plays, "user_id long, item_no long")
    got = cooccurrence.co_occurrence(m, p, block)
    assert rows(got) == sorted(((s, i, n) for (s, i), n in want.items()), key=repr)


def test_overlaps_of_all_seeds_equal_single_cohorts(spark):
    best = plays_of(spark, 2)
    seeds = spark.createDataFrame([(k, k, 300.0 if k % 2 else None, None, "DT" if k % 3 == 0 else None) for k in range(40)], "seed_id long, item_id long, pp_low double, pp_high double, variant string")
    members = cohort.seed_cohorts(best, seeds).select("seed_id", "user_id")
    popular = item_statistics(best).where("user_count >= 45").select("item_id", "variant_key", "user_count")
    got = rows(cooccurrence.seed_overlaps(members, best, popular, 4, block=5))
    want = []
    for r in seeds.collect():
        users = cohort.cohort_users(best, r["item_id"], r["pp_low"], None, r["variant"])
        counted = cohort.cohort_overlap(best, users).join(popular, ["item_id", "variant_key"]).where("cohort_overlap >= 4")
        want += [(r["seed_id"], x["item_id"], x["variant_key"], x["cohort_overlap"]) for x in counted.collect()] if r["seed_id"] < 6 else []
    assert [g for g in got if g[0] < 6] == sorted(want, key=repr) and len(want) > 10
    dims = best.select("item_id").distinct().selectExpr("item_id", "item_id % 3 AS set_id", "'v' AS version", "1.0 AS difficultyrating")
    sets = spark.createDataFrame([(k, "a", "t") for k in range(3)], "set_id long, artist string, title string")
    assert recommend.recommend_for_seeds(best, seeds, dims, sets, 4, 45, 10).groupBy("seed_id").count().agg(F.max("count")).first()[0] == 10


def test_quantile_sketches_merge_within_their_error(spark):
    best = spark.range(200_000).selectExpr("id % 3 AS item_id", "CAST(id % 5 AS STRING) AS variant_key", "pow(rand(7) * 100, 2) AS pp").cache()
    merged = sketches.with_quantiles(sketches.merged_scores(sketches.score_sketches(best, "item_id", "variant_key"), "item_id"), a=0.5, b=0.9, c=0.99)
    for r in merged.collect():
        own = best.where(F.col("item_id") == r["item_id"])
        for name, q in (("a", 0.5), ("b", 0.9), ("c", 0.99)):
            assert abs(own.where(F.col("pp") <= r[name]).count() / r["n_rows"] - q) < 0.02
    few = spark.createDataFrame([(1, "", None), (1, "", None), (2, "", 3.0)], "item_id long, variant_key string, pp double")
    got = sketches.with_quantiles(sketches.score_sketches(few, "item_id"), m=0.5).select("item_id", "n_rows", "m")
    assert rows(got) == [(1, 0, None), (2, 1, 3.0)]


def test_user_sketches_merge_and_intersect_within_their_error(spark):
    best = spark.range(300_000).selectExpr("id % 60000 AS user_id", "id % 2 AS item_id", "CAST(id % 3 AS STRING) AS variant_key").union(spark.range(90_000).selectExpr("id + 30000", "9L", "''"))
    parts = sketches.user_sketches(best, "item_id", "variant_key")
    n = {r["item_id"]: r["n_users"] for r in sketches.distinct_users(sketches.merged_users(parts, "item_id")).collect()}
    exact = {r["item_id"]: r["n"] for r in best.groupBy("item_id").agg(F.count_distinct("user_id").alias("n")).collect()}
    assert all(abs(n[k] - exact[k]) <= 0.06 * exact[k] for k in exact)
    users = best.where("item_id = 9").select("user_id").distinct()
    got = {r["item_id"]: r["cohort_overlap"] for r in sketches.sketched_overlap(sketches.merged_users(parts, "item_id"), sketches.user_sketches(users)).collect()}
    true = {r["item_id"]: r["n"] for r in best.join(users, "user_id", "left_semi").groupBy("item_id").agg(F.count_distinct("user_id").alias("n")).collect()}
    assert all(abs(got[k] - true[k]) <= 0.06 * 90_000 for k in true)
    assert {r["cohort_overlap"] for r in sketches.sketched_overlap(parts, sketches.user_sketches(users.limit(0))).collect()} == {0}


def test_best_plays_are_a_maximum_not_a_window(spark):
    rnd = random.Random(4)
    nan = float("nan")
    data = [(rnd.choice([None, 1, 2, 3, k]), rnd.choice([1, 2, None]), rnd.choice([1, None]), rnd.choice([None, 5, 6]), rnd.choice([None, nan, 1.5, 2.5, -0.5]), 0, None, rnd.choice(["", "DT", None]), None) for k in range(400)]
    staged = spark.createDataFrame([(*r[:6], f"d{r[0]}{r[3]}", *r[7:]) for r in data], FULL)
    w = Window.partitionBy("user_id", "item_id", "variant_key").orderBy(F.col("pp").desc_nulls_last(), F.col("score").desc_nulls_last(), F.col("id").asc_nulls_last())
    want = staged.withColumn("n", F.row_number().over(w)).where("n = 1").select(*PLAY)
    got = best_plays(staged)
    assert list(map(str, rows(got))) == list(map(str, rows(want))) and "Window" not in plan(got) and tuple(got.columns) == PLAY
    # Beaten plays are left behind before the shuffle: it has as many rows as tasks have keys at most.
    assert "partial_max" in plan(got)


def read_of_scan(df):
    """Rows that the scans of a query have given on."""
    df.collect()

    def walk(node):
        own = [node.metrics().get("numOutputRows").get().value()] if "FileSourceScan" in node.getClass().getSimpleName() else []
        kids = node.children()
        return own + [x for k in range(kids.size()) for x in walk(kids.apply(k))]

    top = df._jdf.queryExecution().executedPlan()
    if "AdaptiveSparkPlan" in top.getClass().getSimpleName():
        top = top.executedPlan()
    return sum(walk(top))


def test_clustered_files_skip_row_groups(spark, tmp_path):
    best = spark.range(60_000).selectExpr("id", "pmod(xxhash64(id), 100000000000L) AS user_id", "pmod(id * 7919, 50) AS item_id", "1L AS score", "pmod(xxhash64(id, 3), 50000) / 100.0 AS pp", "'' AS variant_key").cache()
    table = files.save_clustered(best, f"{tmp_path}/c", 1_000)
    by_item = table.where("item_id = 7 AND pp >= 400")
    assert by_item.count() == best.where("item_id = 7 AND pp >= 400").count() > 100
    assert read_of_scan(by_item) <= 4_000
    one = best.first()["user_id"]
    assert table.where(F.col("user_id") == one).count() == 1 and read_of_scan(table.where(F.col("user_id") == one)) <= 6_000
    assert read_of_scan(table.where("score = 1")) == 60_000


def test_layouts_join_where_they_lie(spark):
    name = f"j_{uuid.uuid4().hex[:8]}"
    best = plays_of(spark, 5).selectExpr("1L AS id", "*")
    by_item, by_user = files.save_layouts(best, name, 4)
    stats = files.save_by_item(item_statistics(best), f"{name}_stats", 4)
    users = files.save_by_user(cohort.cohort_users(best, 3), f"{name}_cohort", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    try:
        described = by_item.join(stats, ["item_id", "variant_key"])
        shared = by_user.join(users, "user_id", "left_semi")
        assert "Exchange" not in plan(described) and "Exchange" not in plan(shared)
        assert described.count() == best.count() and shared.count() == best.join(cohort.cohort_users(best, 3), "user_id").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")
        for t in (f"{name}_by_item_id", f"{name}_by_user_id", f"{name}_stats", f"{name}_cohort"):
            spark.sql(f"DROP TABLE {t}")


def test_checks_are_counted_while_writing(spark, tmp_path):
    best = spark.createDataFrame([(1, 1, "DT,HR", "DT"), (2, 1, "HR,DT", "DT"), (3, 1, "HT", None), (4, 1, None, None)], "user_id long, item_id long, variant_key string, speed_mod string")
    table, seen = files.save_observed(best, f"{tmp_path}/b", **quality.WHILE_WRITING["best"]())
    assert seen == {"n_rows": 4, "variant_order": quality.unsorted_variants(best).count(), "speed_class": quality.wrong_speed(best).count()} and table.count() == 4
    assert seen["variant_order"] == 2 and seen["speed_class"] == 1
    assert rows(quality.observed_report(spark, {"best": seen})) == [("speed_class", "best", 1), ("variant_order", "best", 2)]
    _, none = files.save_observed(best.limit(0), f"{tmp_path}/n", **quality.WHILE_WRITING["best"]())
    assert none == {"n_rows": 0, "variant_order": 0, "speed_class": 0}


def test_csv_rows_and_rejects_add_up(spark, tmp_path):
    (tmp_path / "a.csv").write_text('i,s\n1,a\nx,b\n3,"c,d"\n4\n5,e,f\n\\N,g\n')
    good, bad = files.csv_rows_and_rejects(spark, f"{tmp_path}/a.csv", "i int, s string")
    assert rows(good) == [(1, "a"), (3, "c,d"), (None, "g")]
    assert sorted(r["text"] for r in bad.collect()) == ["4", "5,e,f", "x,b"] and {r["file"].rsplit("/", 1)[1] for r in bad.collect()} == {"a.csv"}


def test_jdbc_ranges_of_equal_size(spark):
    url, driver = "jdbc:derby:memory:skewed;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    table = spark.range(1000).selectExpr("IF(id < 900, id, id * 1000000) AS ID", "IF(id % 100 = 0, NULL, id) AS V")
    try:
        table.write.jdbc(url, "S", properties={"driver": driver})
    except Exception as e:  # noqa: BLE001
        pytest.skip(f"no embedded database here: {str(e)[:80]}")
    read = files.read_jdbc_balanced(spark, url, "S", "ID", 5, driver=driver)
    sizes = [r["n"] for r in read.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert rows(read) == rows(table) and len(sizes) == 5 and max(sizes) <= 260
    assert files.read_jdbc_balanced(spark, url, "S", "V", 4, driver=driver).count() == 1000


def test_large_files_are_hashed_by_their_rows(spark, tmp_path):
    rows_ = spark.range(3_000).selectExpr("id", "CAST(id % 7 AS STRING) AS s", "IF(id % 5 = 0, NULL, id / 3) AS d")
    rows_.coalesce(1).write.parquet(f"{tmp_path}/a")
    rows_.orderBy(F.desc("id")).coalesce(1).write.parquet(f"{tmp_path}/b")
    rows_.withColumn("s", F.when(F.col("id") == 77, "x").otherwise(F.col("s"))).coalesce(1).write.parquet(f"{tmp_path}/c")
    by_rows = [files.parquet_manifest(spark, f"{tmp_path}/{t}", "t", whole=1).first() for t in "abc"]
    assert by_rows[0]["hash"] == by_rows[1]["hash"] != by_rows[2]["hash"] and all(r["hash"].startswith("rows:") and r["rows"] == 3_000 for r in by_rows)
    assert files.parquet_manifest(spark, f"{tmp_path}/a", "t").first()["hash"].startswith("sha256:")


def test_scratch_tables_are_removed(spark, tmp_path):
    import os

    best = plays_of(spark, 6, 20, 5, 60)
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    there = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with files.scratch_removed(spark):
        files.write_sharded(bitmaps.numbered_plays(best, bitmaps.dense_numbers(best, "user_id")), f"{tmp_path}/out")
        assert set(os.listdir(folder)) - there
    assert not set(os.listdir(folder)) - there and spark.read.parquet(f"{tmp_path}/out").count() == best.count()
