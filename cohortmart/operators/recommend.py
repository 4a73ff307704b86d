"""Recommendations: items that a cohort shares, ranked by overlap, with novelty or similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortmart.functions.numbers import half_up, mean_of, novelty, similarity, total
from cohortmart.operators.cooccurrence import seed_overlaps
from cohortmart.operators.cohort import asked_plays, cohort_overlap, seed_cohorts
from cohortmart.operators.marts import item_statistics
from cohortmart.sources.files import save_table, scratch_path

MIN_OVERLAP, MIN_PLAYERS, LIMIT = 3, 5, 100
MEASURES = ("avg_pp", "std_pp", "min_pp", "median_pp", "p75_pp", "p90_pp")
OUTPUT = ("item_id", "variant_key", "version", "artist", "title", "difficultyrating", "total_players", "cohort_overlap", *MEASURES, "novelty_score")


def _about(stats: DataFrame, items: DataFrame, sets: DataFrame, min_players: int) -> DataFrame:
    """What is told of each item and variant of enough players; items without dimensions drop."""
    popular = stats.where(F.col("user_count") >= min_players).select("item_id", "variant_key", "user_count", *MEASURES)
    return popular.join(items.select("item_id", "set_id", "version", "difficultyrating"), "item_id").join(sets.select("set_id", "artist", "title"), "set_id")


def _described(counted: DataFrame, about: DataFrame, min_overlap: int) -> DataFrame:
    full = counted.where(F.col("cohort_overlap") >= min_overlap).join(about, ["item_id", "variant_key"])
    return full.withColumn("total_players", F.col("user_count")).withColumn("novelty_score", novelty(F.col("cohort_overlap"), F.col("user_count")))


def recommend_from_cohort(best: DataFrame, cohort: DataFrame, items: DataFrame, sets: DataFrame, min_overlap: int = MIN_OVERLAP, min_players: int = MIN_PLAYERS, limit: int = LIMIT, stats: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """The `limit` items and variants of largest overlap; ties by avg_pp, then item and variant. No row for an empty cohort."""
    stats = item_statistics(best, digits) if stats is None else stats
    rows = _described(cohort_overlap(best, cohort), _about(stats, items, sets, min_players), min_overlap)
    order = [F.col("cohort_overlap").desc(), F.col("avg_pp").desc_nulls_last(), F.col("item_id"), F.col("variant_key")]
    return rows.select(*OUTPUT).orderBy(*order).limit(limit)


def recommend_for_seeds(best: DataFrame, seeds: DataFrame, items: DataFrame, sets: DataFrame, min_overlap: int = MIN_OVERLAP, min_players: int = MIN_PLAYERS, limit: int = LIMIT, stats: DataFrame | None = None, digits: int | None = None) -> DataFrame:
    """recommend_from_cohort() for every row of seeds (seed_id, item_id, pp_low, pp_high, variant) at once, with its place.

    Cost: the plays of each seed's cohort, counted by seed_overlaps(): cohorts and items below the thresholds are left out
    before, and a very active user is spread over tasks. What is told of the items is written once and meets the counts in
    one join. Give top plays (user_topk) as `best` to bound them.
    """
    stats = item_statistics(best, digits) if stats is None else stats
    members = seed_cohorts(best, seeds).select("seed_id", "user_id")
    about = save_table(_about(stats, items, sets, min_players), scratch_path(best.sparkSession, "about"))
    popular = about.select("item_id", "variant_key", "user_count").distinct()
    counted = seed_overlaps(members, best.select("user_id", "item_id", "variant_key"), popular, min_overlap)
    rows = _described(counted, about, min_overlap)
    order = Window.partitionBy("seed_id").orderBy(F.col("cohort_overlap").desc(), F.col("avg_pp").desc_nulls_last(), F.col("item_id"), F.col("variant_key"))
    ranked = rows.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit)
    return ranked.select("seed_id", "place", *OUTPUT)


def recommend_similar(plays: DataFrame, seeds: DataFrame, items: DataFrame, pp_low: float = 0.0, pp_high: float = 10_000.0, mods: list[str] | None = None, limit: int = 10, digits: int | None = None) -> DataFrame:
    """For every seed item that is known: the other items of its cohort by number of players, with similarity (their share
    of the cohort) and rounded averages. Candidates have the seed's range of pp but any variant."""
    known = seeds.select("item_id").distinct().join(items.select("item_id"), "item_id", "left_semi").select(F.col("item_id").alias("seed_id"))
    asked = asked_plays(plays, pp_low, pp_high, mods)
    cohort = asked.join(known, asked["item_id"] == known["seed_id"]).select("seed_id", "user_id").distinct()
    size = cohort.groupBy("seed_id").agg(F.count("*").alias("cohort_size"))
    # One row for each user and item meets the cohorts, so players are counted as rows and means come from sums.
    own = asked_plays(plays, pp_low, pp_high).join(items.select("item_id"), "item_id", "left_semi")
    own = own.groupBy("user_id", "item_id").agg(*[x for c, n in (("pp", "a"), ("accuracy", "b")) for x in (total(F.col(c), digits).alias(f"{n}_sum"), F.count(c).alias(f"{n}_n"))])
    near = own.join(cohort, "user_id").where(F.col("item_id") != F.col("seed_id"))
    sums = [F.sum(c).alias(c) for c in ("a_sum", "a_n", "b_sum", "b_n")]
    counted = near.groupBy("seed_id", "item_id").agg(F.count("*").alias("play_count"), *sums)
    full = counted.select("seed_id", "item_id", "play_count", *[mean_of(F.col(f"{n}_sum"), F.col(f"{n}_n"), digits).alias(n) for n in "ab"])
    order = Window.partitionBy("seed_id").orderBy(F.col("play_count").desc(), F.col("a").desc_nulls_last(), F.col("item_id"))
    ranked = full.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit).join(items, "item_id").join(size, "seed_id")
    details = [c for c in items.columns if c not in ("item_id", "set_id")]
    return ranked.select("seed_id", "place", "item_id", *details, "play_count", half_up(F.col("a")).alias("avg_pp"), half_up(F.col("b")).alias("avg_accuracy"), similarity(F.col("play_count"), F.col("cohort_size")).alias("similarity_score"))
