"""Score marts: staged scores, best plays, top plays of a user, statistics of an item and variant.

Canonical columns: id, user_id, item_id, score, pp, playmode, data, variant_key, speed_mod.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmart.functions.numbers import deviation, mean
from cohortmart.functions.variants import modifiers, speed_class, variant_key

STAGED = ("id", "user_id", "item_id", "score", "pp", "playmode", "data", "variant_key", "speed_mod")
PLAY = ("id", "user_id", "item_id", "score", "pp", "data", "variant_key", "speed_mod")


@dataclass(frozen=True)
class Names:
    """Names of a source's columns by canonical name."""

    id: str = "id"
    user_id: str = "user_id"
    item_id: str = "beatmap_id"
    score: str = "score"
    pp: str = "pp"
    playmode: str = "playmode"
    data: str = "data"
    variant_key: str = "mods_key"
    speed_mod: str = "speed_mod"


def canonical(df: DataFrame, names: Names | None = None) -> DataFrame:
    """Columns under their canonical names; variant key and speed class are taken from `data` where the source lacks them."""
    names = names or Names()
    mods = modifiers(F.col(names.data)) if names.data in df.columns else F.array().cast("array<string>")
    made = {"variant_key": variant_key(mods), "speed_mod": speed_class(mods), "data": F.lit(None).cast("string")}
    cols = []
    for f in fields(Names):
        source = getattr(names, f.name)
        if source not in df.columns and f.name not in made:
            raise ValueError(f"column {source} is missing")
        cols.append((F.col(f"`{source}`") if source in df.columns else made[f.name]).alias(f.name))
    return df.select(*cols)


def stage_scores(raw: DataFrame, playmode: int = 0) -> DataFrame:
    """Plays of one mode, nine columns; a null mode is dropped. Works on streams too."""
    return raw.where(F.col("playmode") == playmode).select(*STAGED)


def _best_first() -> list[Column]:
    return [F.col("pp").desc_nulls_last(), F.col("score").desc_nulls_last(), F.col("id").asc_nulls_last()]


def best_plays(staged: DataFrame) -> DataFrame:
    """One play for each user, item and variant: the one of highest pp, then score, then lowest id; null pp is last.

    The best row is a maximum, which combines before the shuffle: plays that are beaten within their task go no further.
    """
    keys = ["user_id", "item_id", "variant_key"]
    # Nulls are the smallest values of a row's parts, and ~id turns the order of ids around. What follows settles full ties.
    rank = F.struct("pp", "score", F.bitwise_not(F.col("id").cast("long")).alias("__id"), "id", *[c for c in PLAY if c not in (*keys, "pp", "score", "id")])
    first = staged.groupBy(*keys).agg(F.max(rank).alias("__best"))
    return first.select(*[F.col(c) if c in keys else F.col("__best")[c].alias(c) for c in PLAY])


def user_topk(best: DataFrame, k: int = 100) -> DataFrame:
    """The k best plays of each user and speed class; a null class is one of its own."""
    w = Window.partitionBy("user_id", "speed_mod").orderBy(*_best_first(), F.col("item_id"), F.col("variant_key"))
    return best.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).select(*PLAY)


def _statistics(best: DataFrame, digits: int | None, *more: Column) -> DataFrame:
    q = F.percentile("pp", F.array(F.lit(0.5), F.lit(0.75), F.lit(0.9)))
    stats = best.groupBy("item_id", "variant_key").agg(
        *more, F.count("*").alias("user_count"), mean(F.col("pp"), digits).alias("avg_pp"), deviation(F.col("pp"), digits).alias("std_pp"), F.min("pp").alias("min_pp"), q.alias("__q")
    )
    return stats.withColumns({n: F.col("__q")[k] for k, n in enumerate(("median_pp", "p75_pp", "p90_pp"))}).drop("__q")


def item_statistics(best: DataFrame, digits: int | None = None) -> DataFrame:
    """user_count, avg, std, min, median, p75 and p90 of pp for each item and variant. All but the percentiles combine
    before the shuffle; the exact percentiles are counts of distinct values."""
    return _statistics(best, digits)


def item_user_sets(best: DataFrame, digits: int | None = None) -> DataFrame:
    """item_statistics() with the sorted list of users, in one aggregation. The list of an item is one row; joins never use it."""
    return _statistics(best, digits, F.sort_array(F.collect_list("user_id")).alias("user_ids"))
