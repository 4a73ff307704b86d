"""Look-ups: metadata, ordered batches, profiles, and plays of an item or a user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmart.functions.numbers import half_up, mean


def item_metadata(ids: DataFrame, items: DataFrame, sets: DataFrame) -> DataFrame:
    """Metadata of the distinct ids that are known; no order."""
    return ids.select("item_id").distinct().join(items, "item_id").join(sets, "set_id").select("item_id", "set_id", "version", "difficultyrating", "artist", "title")


def lookup_items(requests: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each requested id (request_id, item_ids) with its place: order and repeats stay, unknown ids have nulls."""
    asked = requests.select("request_id", F.posexplode("item_ids").alias("place", "item_id"))
    return asked.withColumn("place", F.col("place").cast("long")).join(items, "item_id", "left")


def known_ids(ids: DataFrame, table: DataFrame, column: str) -> DataFrame:
    return ids.select(column).distinct().join(table.select(column), column, "left_semi")


def missing_ids(ids: DataFrame, table: DataFrame, column: str) -> DataFrame:
    return ids.select(column).distinct().join(table.select(column), column, "left_anti")


def item_scores(best: DataFrame, item_id: int, pp_low: float | None = None) -> DataFrame:
    """Best plays of an item, highest pp first, with their place. Reads few row groups of the layout by item."""
    return _placed(best.where((F.col("item_id") == item_id) & (F.lit(True) if pp_low is None else F.col("pp") >= pp_low)), "item_id")


def user_scores(best: DataFrame, user_id: int) -> DataFrame:
    return _placed(best.where(F.col("user_id") == user_id), "user_id")


def _placed(rows: DataFrame, of: str) -> DataFrame:
    order = Window.partitionBy(of).orderBy(F.col("pp").desc_nulls_last(), F.col("score").desc_nulls_last(), "id", "user_id", "item_id", "variant_key")
    return rows.withColumn("place", F.row_number().over(order).cast("long"))


def user_top_plays(plays: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """The k plays of highest pp of every user among known items, with the item's columns and the place."""
    order = Window.partitionBy("user_id").orderBy(F.col("pp").desc_nulls_last(), F.col("score").desc_nulls_last(), "id", "item_id", "variant_key", "accuracy")
    known = plays.join(items.select("item_id", "version", "difficultyrating"), "item_id")
    return known.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= k).select(
        "user_id", "place", "item_id", "version", "difficultyrating", "pp", "variant_key", "accuracy", "score"
    )


def user_profile(users: DataFrame, top: DataFrame, digits: int | None = None) -> DataFrame:
    """Each user with total_plays and average_pp of the top plays given (rounded half up; 0 plays: null) and a null peak_rank."""
    counted = top.groupBy("user_id").agg(F.count("*").alias("n"), mean(F.col("pp"), digits).alias("m"))
    return users.join(counted, "user_id", "left").select(*users.columns, F.coalesce("n", F.lit(0)).alias("total_plays"), half_up(F.col("m")).alias("average_pp"), F.lit(None).cast("long").alias("peak_rank"))


def asked_range(low: float, high: float, lowest: float = 0.0, highest: float = 1000.0) -> dict[str, float]:
    """pp_low and pp_high of a request, each only where it is within the ends of the scale: at the ends nothing is asked."""
    return ({"pp_low": low} if low > lowest else {}) | ({"pp_high": high} if high < highest else {})


def card_view(rows: DataFrame, cover: str = "https://covers.example.org/{}.jpg") -> DataFrame:
    """Rows for display: a cover address by item, 95 for a missing or zero accuracy, an empty list of modifiers."""
    left, _, right = cover.partition("{}")
    accuracy: Column = F.col("avg_accuracy")
    return rows.withColumns(
        {
            "cover_url": F.concat(F.lit(left), F.col("item_id").cast("string"), F.lit(right)),
            "avg_accuracy": F.when(accuracy.isNull() | (accuracy == 0), F.lit(95.0)).otherwise(accuracy),
            "mods": F.lit(""),
        }
    )
