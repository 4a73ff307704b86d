"""Cohorts: the users behind a seed item, and what their plays look like."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmart.functions.numbers import half_up, mean
from cohortmart.functions.variants import requested_variant


def cohort_filter(item_id: int, pp_low: float | None = None, pp_high: float | None = None, variant: str | None = None) -> Column:
    """The item and, where given, a range of pp (ends included) and a variant."""
    asked = [F.col("item_id") == item_id]
    if pp_low is not None:
        asked.append(F.col("pp") >= pp_low)
    if pp_high is not None:
        asked.append(F.col("pp") <= pp_high)
    if variant is not None:
        asked.append(F.col("variant_key") == variant)
    return reduce(lambda a, b: a & b, asked)


def cohort_users(best: DataFrame, item_id: int, pp_low: float | None = None, pp_high: float | None = None, variant: str | None = None) -> DataFrame:
    """Distinct user_id. The cohort stays a DataFrame: joins take it as it is."""
    return best.where(cohort_filter(item_id, pp_low, pp_high, variant)).select("user_id").distinct()


def seed_cohorts(best: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed_id, item_id, user_id of all seeds (seed_id, item_id, pp_low, pp_high, variant); a null condition holds."""
    s = seeds.select("seed_id", F.col("item_id").alias("seed_item"), "pp_low", "pp_high", "variant")
    fits = (
        (F.col("item_id") == F.col("seed_item"))
        & (F.col("pp_low").isNull() | (F.col("pp") >= F.col("pp_low")))
        & (F.col("pp_high").isNull() | (F.col("pp") <= F.col("pp_high")))
        & (F.col("variant").isNull() | (F.col("variant_key") == F.col("variant")))
    )
    return best.join(s, fits).select("seed_id", F.col("seed_item").alias("item_id"), "user_id").distinct()


def cohort_overlap(best: DataFrame, cohort: DataFrame) -> DataFrame:
    """item_id, variant_key, cohort_overlap: users of the cohort among those of each item and variant.

    Plays are unique by user, item and variant, so a semi join and a count are the size of the intersection.
    """
    return best.join(cohort.select("user_id").distinct(), "user_id", "left_semi").groupBy("item_id", "variant_key").agg(F.count("*").alias("cohort_overlap"))


def asked_plays(plays: DataFrame, pp_low: float = 0.0, pp_high: float = 10_000.0, mods: list[str] | None = None) -> DataFrame:
    """Plays in a range of pp (null pp is out) and, where asked, of a variant in any order of its modifiers."""
    within = F.col("pp").between(pp_low, pp_high)
    key = requested_variant(mods)
    return plays.where(within if key is None else within & (F.col("variant_key") == key))


def cohort_profile(plays: DataFrame, seeds: DataFrame, measure: str = "pp", digits: int | None = None, **asked: object) -> DataFrame:
    """item_id, cohort_size (rows) and min, max, mean and median of a measure, rounded half up; items without rows are absent."""
    chosen = asked_plays(plays, **asked).join(seeds.select("item_id").distinct(), "item_id", "left_semi")
    x = F.col(measure)
    out = chosen.groupBy("item_id").agg(F.count("*").alias("cohort_size"), F.min(x).alias("a"), F.max(x).alias("b"), mean(x, digits).alias("c"), F.percentile(x, F.lit(0.5)).alias("d"))
    return out.select("item_id", "cohort_size", *[half_up(F.col(c)).alias(f"{n}_{measure}") for c, n in zip("abcd", ("min", "max", "mean", "median"), strict=True)])


def cohort_top_players(plays: DataFrame, users: DataFrame, k: int = 10) -> DataFrame:
    """item_id, place, user_id, username, pp, accuracy: the k users of highest pp of each item, each by the best play."""
    order = [F.col("pp").desc_nulls_last(), F.col("accuracy").desc_nulls_last(), F.col("user_id")]
    first = plays.withColumn("n", F.row_number().over(Window.partitionBy("item_id", "user_id").orderBy(F.col("pp").desc_nulls_last(), F.col("accuracy").desc_nulls_last()))).where("n = 1")
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)).cast("long")).where(F.col("place") <= k)
    return ranked.join(users.select("user_id", "username"), "user_id").select("item_id", "place", "user_id", "username", "pp", "accuracy")


def histogram(plays: DataFrame, measure: str = "pp", bins: int = 10) -> DataFrame:
    """item_id, bin (1 to bins), n: counts over equal parts of the range of each item; the highest value is in the last bin,
    an item of one value has all in the first. Nulls are left out. Counting needs no row of an item beside another."""
    ranges = plays.groupBy("item_id").agg(F.min(measure).alias("lo"), F.max(measure).alias("hi"))
    at = F.floor((F.col(measure) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1
    place = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.lit(bins), at)).cast("long")
    return plays.where(F.col(measure).isNotNull()).join(ranges, "item_id").groupBy("item_id", place.alias("bin")).agg(F.count("*").alias("n"))
