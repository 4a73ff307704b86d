"""Sketches kept in marts: quantiles and distinct users that merge over variants, items and days without going back to plays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy: a quantile sketch of this k has a rank error of about 0.7 %, a user sketch of 2 ** lg_k entries a relative
#: standard error of 1.6 %. Up to so many values both are exact.
K, LG_K = 400, 12


def score_sketches(best: DataFrame, *by: str, measure: str = "pp", k: int = K) -> DataFrame:
    """by, n_rows, quantiles: a KLL sketch of the measure for each group; null values are not in it. Groups combine before the
    shuffle, and a group of any size is one row of some KB."""
    return best.groupBy(*by).agg(F.count(measure).alias("n_rows"), F.kll_sketch_agg_double(measure, F.lit(k)).alias("quantiles"))


def merged_scores(sketches: DataFrame, *by: str, k: int = K) -> DataFrame:
    """The sketches of larger groups from those of smaller ones, for instance of items from those of items and variants."""
    return sketches.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.kll_merge_agg_double("quantiles", F.lit(k)).alias("quantiles"))


def quantile(sketch: Column | str, q: float) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.lit(q))


def with_quantiles(sketches: DataFrame, **wanted: float) -> DataFrame:
    """Adds a column for each wanted quantile; null for groups without values."""
    some = F.col("n_rows") > 0
    return sketches.withColumns({name: F.when(some, quantile("quantiles", q)) for name, q in wanted.items()})


def user_sketches(best: DataFrame, *by: str, lg_k: int = LG_K) -> DataFrame:
    """by, users: a theta sketch of the distinct users of each group."""
    return best.groupBy(*by).agg(F.theta_sketch_agg("user_id", lg_k).alias("users"))


def merged_users(sketches: DataFrame, *by: str, lg_k: int = LG_K) -> DataFrame:
    return sketches.groupBy(*by).agg(F.theta_union_agg("users", lg_k).alias("users"))


def distinct_users(sketches: DataFrame) -> DataFrame:
    """Adds n_users, the estimated number."""
    return sketches.withColumn("n_users", F.theta_sketch_estimate("users"))


def sketched_overlap(items: DataFrame, cohort: DataFrame) -> DataFrame:
    """The sketches of items with cohort_overlap, the estimated number of users in common with the cohort: its one row of
    user_sketches(), 2 ** lg_k numbers at most, goes to the items through the driver. The error is relative to the larger of both sets, so small overlaps of large
    sets are uncertain."""
    sketch = cohort.select("users").first()
    asked = F.lit(bytearray(sketch["users"]) if sketch else None).cast("binary")
    common = F.theta_sketch_estimate(F.theta_intersection("users", asked))
    return items.withColumn("cohort_overlap", F.coalesce(common, F.lit(0).cast("long")))
