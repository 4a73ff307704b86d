from pyspark.sql import functions as F

from cohortmart.functions.numbers import deviation, half_up, mean
from cohortmart.functions.variants import modifiers, requested_variant, speed_class, variant_key
from cohortmart.operators import cohort, quality, recommend
from cohortmart.operators.marts import Names, best_plays, canonical, item_statistics, item_user_sets, stage_scores, user_topk
from tests.conftest import rows

SCHEMA = "id long, user_id long, item_id long, score long, pp double, playmode int, data string, variant_key string, speed_mod string"


def play(id, user, item, pp, variant="", speed=None, mode=0, score=0):
    return (id, user, item, score, pp, mode, None, variant, speed)


def test_staging_drops_other_and_null_modes(spark):
    raw = spark.createDataFrame([play(1, 1, 1, 1.0), play(2, 1, 1, 1.0, mode=1), play(3, 1, 1, 1.0, mode=None), play(4, 1, 1, 1.0, mode=2), play(5, 2, 1, 1.0)], SCHEMA)
    assert [r["id"] for r in stage_scores(raw).orderBy("id").collect()] == [1, 5]


def test_best_play_of_each_user_item_and_variant(spark):
    raw = spark.createDataFrame([play(1, 7, 31, 61.5, "DT"), play(2, 7, 31, 12.0, "DT"), play(3, 7, 31, 88.25, "DT"), play(4, 8, 32, 71.0, "HR"), play(5, 8, 32, 70.5, "HR"), play(6, 9, 33, None), play(7, 10, 34, 5.0, score=1), play(8, 10, 34, 5.0, score=2)], SCHEMA)
    best = best_plays(raw)
    assert sorted(r["id"] for r in best.collect()) == [3, 4, 6, 8]
    assert quality.duplicate_keys(best, ["user_id", "item_id", "variant_key"]).count() == 0
    assert quality.not_best(best, raw).count() == 0


def test_top_k_by_user_and_speed_class_with_null_as_a_class(spark):
    raw = spark.createDataFrame([play(i, 1, 4000 + i, 90 - 0.25 * i, "DT", "DT") for i in range(180)] + [play(1000 + i, 1, i, float(i)) for i in range(120)], SCHEMA)
    top = user_topk(best_plays(raw), 100)
    assert {r["speed_mod"]: r["count"] for r in top.groupBy("speed_mod").count().collect()} == {"DT": 100, None: 100}
    assert top.where("speed_mod IS NULL").agg(F.min("pp")).first()[0] == 20.0
    assert quality.too_many(top, 100).count() == 0 and quality.too_many(top, 99).count() == 2


def test_item_statistics(spark):
    raw = spark.createDataFrame([play(i, i, 1, float(i)) for i in range(1, 5)] + [play(9, 9, 2, 7.0)], SCHEMA)
    sets = {r["item_id"]: r for r in item_user_sets(raw).collect()}
    assert sets[1]["user_ids"] == [1, 2, 3, 4] and sets[1]["user_count"] == 4
    assert (sets[1]["avg_pp"], sets[1]["min_pp"], sets[1]["median_pp"], sets[1]["p75_pp"]) == (2.5, 1.0, 2.5, 3.25)
    assert sets[2]["std_pp"] is None and abs(sets[1]["std_pp"] - 1.2909944487) < 1e-9
    exact = item_statistics(raw, 2).where("item_id = 1").first()
    assert abs(exact["std_pp"] - sets[1]["std_pp"]) < 1e-12
    assert quality.miscounted_sets(item_user_sets(raw)).count() == 0 and quality.disordered_percentiles(item_user_sets(raw)).count() == 0


def test_modifiers_variants_and_speed(spark):
    data = ['{"mods":[{"acronym":"HR"},{"acronym":"DT"}]}', '{"mods":[{"acronym":"HT"}]}', '{"mods":[{"acronym":"NC"}]}', '{"mods": []}', None, "not json", '{"mods":[{"acronym":', '{"mods":null}', "{}", '{"mods":[{"acronym":"HD"},{"x":1},{"acronym":"HD"}]}', "NULL"]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, data string").select("i", modifiers(F.col("data")).alias("m"))
    got = [(r["k"], r["s"]) for r in df.select("i", variant_key(F.col("m")).alias("k"), speed_class(F.col("m")).alias("s")).orderBy("i").collect()]
    assert got == [("DT,HR", "DT"), ("HT", "HT"), ("NC", "DT"), ("", None), ("", None), ("", None), ("", None), ("", None), ("", None), ("HD,HD", None), ("", None)]
    assert requested_variant(["HR", "DT"]) == "DT,HR" and requested_variant([]) is None


def test_canonical_names_and_derived_columns(spark):
    raw = spark.createDataFrame([(1, 2, 3, 4, 5.0, 0, '{"mods":[{"acronym":"NC"}]}')], "id long, user_id long, beatmap_id long, score long, pp double, playmode int, data string")
    row = canonical(raw, Names()).first()
    assert (row["item_id"], row["variant_key"], row["speed_mod"]) == (3, "NC", "DT")


def test_rounding_is_half_up_on_doubles(spark):
    assert rows(spark.createDataFrame([(0.285,), (1.005,), (2.5,)], "x double").select(half_up(F.col("x")))) == [(0.28,), (1.0,), (2.5,)]
    x = spark.createDataFrame([(0.1,), (0.2,), (0.3,)], "x double").agg(mean(F.col("x"), 1), deviation(F.col("x"), 1)).first()
    assert abs(x[0] - 0.2) < 1e-12 and abs(x[1] - 0.1) < 1e-9


def test_cohort_and_recommendations(spark):
    plays = [play(u * 10 + i, 100 + u, 200 + i, 400.0 + u * 10 + i, "DT") for u in range(6) for i in range(3)] + [play(900, 999, 200, 350.0, "")]
    best = best_plays(spark.createDataFrame(plays, SCHEMA))
    assert cohort.cohort_users(best, 200).count() == 7
    assert rows(cohort.cohort_users(best, 200, 440.0, 500.0, "DT")) == [(104,), (105,)]
    items = spark.createDataFrame([(200, 1, "a", 1.0), (201, 1, "b", 2.0)], "item_id long, set_id long, version string, difficultyrating double")
    sets = spark.createDataFrame([(1, "x", "y")], "set_id long, artist string, title string")
    users = cohort.cohort_users(best, 200, 410.0)
    out = recommend.recommend_from_cohort(best, users, items, sets)
    assert [(r["item_id"], r["cohort_overlap"], r["total_players"]) for r in out.collect()] == [(201, 5, 6), (200, 5, 6)]
    assert quality.wrong_novelty(out).count() == 0
    assert recommend.recommend_from_cohort(best, users.limit(0), items, sets).count() == 0
    seeds = spark.createDataFrame([(1, 200, 410.0, None, None), (2, 777, None, None, None)], "seed_id long, item_id long, pp_low double, pp_high double, variant string")
    many = recommend.recommend_for_seeds(best, seeds, items, sets)
    assert [tuple(r)[2:] for r in many.orderBy("place").collect()] == [tuple(r) for r in out.collect()]


def test_quality_checks_find_violations(spark):
    bad = spark.createDataFrame([play(1, 1, 1, 1.0, "HR,DT", "HT"), play(2, 1, 5, 1.0, "XDT", "DT")], SCHEMA)
    assert quality.unsorted_variants(bad).count() == 1 and quality.wrong_speed(bad).count() == 2
    assert quality.orphans(bad, spark.createDataFrame([(1,)], "item_id long"), "item_id").count() == 1
    assert quality.wrong_mode(spark.createDataFrame([play(1, 1, 1, 1.0, mode=None)], SCHEMA)).count() == 1
    assert quality.missing_columns(bad.drop("pp"), ("id", "pp")) == ["pp"]


def test_histogram_of_one_value_and_of_nulls(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (2, 0.0), (2, 10.0), (2, None)], "item_id long, pp double")
    assert rows(cohort.histogram(df)) == [(1, 1, 2), (2, 1, 1), (2, 10, 1)]


def test_bounds_are_asked_only_within_the_scale():
    from cohortmart.operators.serving import asked_range

    assert asked_range(0.0, 1000.0) == {} and asked_range(5.0, 900.0) == {"pp_low": 5.0, "pp_high": 900.0} and asked_range(0.0, 10.0) == {"pp_high": 10.0}
