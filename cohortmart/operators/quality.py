"""Data quality: every check gives its violations, the report counts them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmart.operators.marts import PLAY, STAGED


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(df: DataFrame, parent: DataFrame, column: str) -> DataFrame:
    """Rows whose key has no row in the parent; a null key has none."""
    return df.join(parent.select(column), column, "left_anti")


def _other_mode(playmode: int = 0) -> Column:
    return ~F.col("playmode").eqNullSafe(F.lit(playmode))


def wrong_mode(staged: DataFrame, playmode: int = 0) -> DataFrame:
    return staged.where(_other_mode(playmode))


def too_many(top: DataFrame, k: int) -> DataFrame:
    return top.groupBy("user_id", "speed_mod").agg(F.count("*").alias("n")).where(F.col("n") > k)


def not_best(best: DataFrame, staged: DataFrame) -> DataFrame:
    """Best plays below the highest pp of their user, item and variant; null is below any pp, and null keys are keys too."""
    keys = ["user_id", "item_id", "variant_key"]
    highest = staged.groupBy(*keys).agg(F.max("pp").alias("highest")).withColumnsRenamed({k: f"of_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [best[k].eqNullSafe(highest[f"of_{k}"]) for k in keys])
    joined = best.join(highest, same).where(F.col("highest").isNotNull() & (F.col("pp").isNull() | (F.col("pp") < F.col("highest"))))
    return joined.drop(*[f"of_{k}" for k in keys])


def _miscounted() -> Column:
    return F.size("user_ids") != F.col("user_count")


def miscounted_sets(sets: DataFrame) -> DataFrame:
    return sets.where(_miscounted())


def _disordered() -> Column:
    names = ["min_pp", "median_pp", "p75_pp", "p90_pp"]
    ordered = reduce(lambda a, b: a & b, [F.col(a) <= F.col(b) for a, b in zip(names, names[1:], strict=False)])
    none = reduce(lambda a, b: a & b, [F.col(c).isNull() for c in names])
    return ~F.coalesce(ordered, none)


def disordered_percentiles(sets: DataFrame) -> DataFrame:
    """Sets whose percentiles don't ascend; all of them may be null (no pp at all), but not some."""
    return sets.where(_disordered())


def _unsorted_variant() -> Column:
    parts = F.split("variant_key", ",")
    return ~(F.array_sort(parts) == parts).eqNullSafe(F.lit(True))


def unsorted_variants(df: DataFrame) -> DataFrame:
    return df.where(_unsorted_variant())


def _other_speed() -> Column:
    parts = F.split("variant_key", ",")
    said = F.when(F.arrays_overlap(parts, F.array(F.lit("DT"), F.lit("NC"))), "DT").when(F.array_contains(parts, "HT"), "HT")
    return ~said.eqNullSafe(F.col("speed_mod"))


def wrong_speed(df: DataFrame) -> DataFrame:
    """Rows whose speed class is not what the whole tokens of the variant key say."""
    return df.where(_other_speed())


def _other_novelty(eps: float = 1e-9) -> Column:
    x = F.col("novelty_score")
    right = x.between(0, 1) & (F.abs(x - (1 - F.col("cohort_overlap") / F.col("total_players"))) <= eps)
    return ~F.coalesce(right, F.lit(False))


def wrong_novelty(recommended: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Rows whose novelty is null, outside of 0 to 1 or not 1 less the overlap's share."""
    return recommended.where(_other_novelty(eps))


def manifest_mismatches(manifest: DataFrame, counts: DataFrame) -> DataFrame:
    """Tables whose files' rows don't add up to the table's count, on either side."""
    listed = manifest.groupBy(F.col("table_name").alias("table")).agg(F.sum("rows").alias("listed"))
    return counts.join(listed, "table", "full").where(~F.coalesce(F.col("listed") == F.col("n_rows"), F.lit(False)))


def missing_columns(df: DataFrame, expected: tuple[str, ...]) -> list[str]:
    return [c for c in expected if c not in df.columns]


#: Checks of single rows by table, which can be counted while the table is written.
WHILE_WRITING = {
    "staged": lambda: {"playmode": _other_mode()},
    "best": lambda: {"variant_order": _unsorted_variant(), "speed_class": _other_speed()},
    "sets": lambda: {"user_count": _miscounted(), "percentile_order": _disordered()},
    "recommended": lambda: {"novelty": _other_novelty()},
}


def observed_report(spark: SparkSession, counted: dict[str, dict[str, int]]) -> DataFrame:
    """check, table, violations as quality_report() has them, from what save_observed() has counted for each table."""
    found = [(check, table, n) for table, seen in counted.items() for check, n in seen.items() if check != "n_rows"]
    return spark.createDataFrame(found, "check string, table string, violations long")


def quality_report(
    staged: DataFrame, best: DataFrame, top: DataFrame, sets: DataFrame, items: DataFrame, raw: DataFrame, k: int = 100,
    recommended: DataFrame | None = None, manifest: DataFrame | None = None, counts: DataFrame | None = None,
) -> DataFrame:
    """check, table, violations: one row for each check.

    A check that needs a column which its table lacks gives null; the missing columns themselves are counted by the check
    "columns". Checks of tables that aren't given are left out.
    """
    spark = staged.sparkSession
    absent = {"staged": missing_columns(staged, STAGED), "best": missing_columns(best, PLAY), "top": missing_columns(top, PLAY)}
    play_key, set_key = ["user_id", "item_id", "variant_key"], ["item_id", "variant_key"]
    #: Checks of single rows: those of a table are counted in one scan.
    of_rows = [
        ("staged", staged, [("playmode", _other_mode, ["playmode"])]),
        ("sets", sets, [("user_count", _miscounted, ["user_ids", "user_count"]), ("percentile_order", _disordered, ["min_pp", "median_pp", "p75_pp", "p90_pp"])]),
        ("best", best, [("variant_order", _unsorted_variant, ["variant_key"]), ("speed_class", _other_speed, ["variant_key", "speed_mod"])]),
    ]
    if recommended is not None:
        of_rows.append(("recommended", recommended, [("novelty", _other_novelty, ["novelty_score", "cohort_overlap", "total_players"])]))
    of_tables = [
        ("unique_play", "best", lambda: duplicate_keys(best, play_key), [(best, play_key)]),
        ("unique_set", "sets", lambda: duplicate_keys(sets, set_key), [(sets, set_key)]),
        ("top_k", "top", lambda: too_many(top, k), [(top, ["user_id", "speed_mod"])]),
        ("best_is_highest", "best", lambda: not_best(best, staged), [(best, [*play_key, "pp"]), (staged, [*play_key, "pp"])]),
        ("orphan_item", "best", lambda: orphans(best, items, "item_id"), [(best, ["item_id"]), (items, ["item_id"])]),
        ("orphan_user", "best", lambda: orphans(best, raw, "user_id"), [(best, ["user_id"]), (raw, ["user_id"])]),
        *[("columns", name, lambda gone=gone: spark.range(len(gone)), []) for name, gone in absent.items()],
    ]
    if manifest is not None and counts is not None:
        of_tables.append(("manifest", "counts", lambda: manifest_mismatches(manifest, counts), [(manifest, ["table_name", "rows"]), (counts, ["table", "n_rows"])]))
    possible = lambda needs: not any(missing_columns(df, tuple(names)) for df, names in needs)
    unknown = F.lit(None).cast("long")
    reports = []
    for table, df, checks in of_rows:
        counted = df.agg(F.lit(0), *[(F.count_if(wrong()) if possible([(df, needs)]) else unknown).alias(check) for check, wrong, needs in checks])
        listed = F.array(*[F.struct(F.lit(check).alias("check"), F.lit(table).alias("table"), F.col(check).alias("violations")) for check, *_ in checks])
        reports.append(counted.select(F.explode(listed).alias("r")).select("r.*"))
    for check, table, found, needs in of_tables:
        counted = found().agg(F.count("*").alias("violations")) if possible(needs) else spark.range(1).select(unknown.alias("violations"))
        reports.append(counted.select(F.lit(check).alias("check"), F.lit(table).alias("table"), "violations"))
    return reduce(DataFrame.unionByName, reports)
