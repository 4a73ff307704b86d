"""Dumps whose values hold statement ends, and dumps with Windows line ends."""

import pytest
from pyspark.sql import functions as F

from cohortmart.functions.literals import literal_text
from cohortmart.operators import quality
from cohortmart.sources import dump
from tests.conftest import rows

VALUES = [(1, "one;\ntwo"), (2, "ok"), (3, ";\n;\n"), (4, "a\r\nb;\r\nc"), (5, "it's \\n;\nINSERT INTO t VALUES (9,'x')"), (6, None), (7, "")]


@pytest.mark.parametrize("raw_breaks", [False, True])
def test_round_trip_of_statement_ends_in_values(spark, tmp_path, raw_breaks):
    path = f"{tmp_path}/d"
    dump.write_insert_dump(spark.createDataFrame(VALUES, "id long, note string").coalesce(1), path, "t", 2, raw_breaks)
    assert rows(dump.read_insert_dump(spark, path, "t").select(F.col("id").cast("long"), "note")) == sorted(VALUES, key=repr)
    assert rows(dump.dump_row_counts(spark, path)) == [("t", len(VALUES))] and dump.unclosed_files(spark, path).count() == 0


def test_windows_line_ends_and_cut_off_files(spark, tmp_path):
    (tmp_path / "w.sql").write_bytes(b"-- it's a note\r\nINSERT INTO t (a, b) VALUES\r\n(1,'x'),\r\n(2,'y');\r\nINSERT INTO t (a, b) VALUES (3,'z;\r\n');\r\n")
    assert rows(dump.read_insert_dump(spark, f"{tmp_path}/w.sql", "t")) == [("1", "x"), ("2", "y"), ("3", "z;\r\n")]
    (tmp_path / "c.sql").write_text("INSERT INTO t (a, b) VALUES (1,'x'), (2,'cut")
    assert rows(dump.read_insert_dump(spark, f"{tmp_path}/c.sql", "t")) == [("1", "x")]
    assert [r["file"].rsplit("/", 1)[1] for r in dump.unclosed_files(spark, f"{tmp_path}/*.sql").collect()] == ["c.sql"]


def test_escapes_of_literals(spark):
    raw = [(r"'a\nb'", "a\nb"), (r"'a\\nb'", r"a\nb"), (r"'\'\"'", "'\""), ("'it''s'", "it's"), (r"'\\''x'", r"\'x"), (r"'\r\t'", "\r\t"), (r"'\d'", r"\d")]
    df = spark.createDataFrame([(x,) for x, _ in raw], "x string").select(literal_text(F.col("x")).alias("x"))
    assert [r["x"] for r in df.collect()] == [y for _, y in raw]


def test_quality_checks_see_nulls_and_missing_columns(spark):
    play = "user_id long, item_id long, variant_key string, pp double"
    best = spark.createDataFrame([(1, 1, "", None), (2, 1, None, 1.0), (3, 1, "", 5.0)], play)
    staged = spark.createDataFrame([(1, 1, "", 9.0), (2, 1, None, 4.0), (3, 1, "", 5.0)], play)
    assert sorted(r["user_id"] for r in quality.not_best(best, staged).collect()) == [1, 2]
    stats = spark.createDataFrame([(1.0, 2.0, None, 4.0), (None, None, None, None), (1.0, 1.0, 1.0, 1.0), (2.0, 1.0, 3.0, 4.0)], "min_pp double, median_pp double, p75_pp double, p90_pp double")
    assert quality.disordered_percentiles(stats).count() == 2
    novelty = spark.createDataFrame([(None, 1, 2), (0.5, 1, 2), (0.5, 1, 4)], "novelty_score double, cohort_overlap long, total_players long")
    assert quality.wrong_novelty(novelty).count() == 2
    manifest = spark.createDataFrame([("a", 2), ("a", 3), ("b", 1), ("d", 1)], "table_name string, rows long")
    counts = spark.createDataFrame([("a", 5), ("b", 2), ("c", 0)], "table string, n_rows long")
    assert sorted(r["table"] for r in quality.manifest_mismatches(manifest, counts).collect()) == ["b", "c", "d"]
    full = "id long, user_id long, item_id long, score long, pp double, data string, variant_key string, speed_mod string"
    plays = spark.createDataFrame([(1, 1, 1, 1, 1.0, None, "DT", None)], full)
    sets = spark.createDataFrame([(1, "DT", [1], 1, 1.0, 1.0, 1.0, 1.0)], "item_id long, variant_key string, user_ids array<long>, user_count long, min_pp double, median_pp double, p75_pp double, p90_pp double")
    report = {(r["check"], r["table"]): r["violations"] for r in quality.quality_report(plays, plays, plays, sets, plays, plays).collect()}
    assert report["playmode", "staged"] is None and report["columns", "staged"] == 1 and report["speed_class", "best"] == 1 and report["unique_play", "best"] == 0
