"""Score files as a stream: staged as they arrive, best plays kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortmart.operators.marts import PLAY, stage_scores


def staged_stream(spark: SparkSession, path: str, schema: T.StructType, playmode: int = 0, files_at_once: int = 100) -> DataFrame:
    """Plays of one mode from Parquet files that are added to a folder."""
    return stage_scores(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path), playmode)


def best_stream(staged: DataFrame) -> DataFrame:
    """The best play of each user, item and variant so far, by the order of the batch mart. State: one row for each key."""
    rank = F.struct(F.col("pp").isNotNull().alias("a"), F.col("pp").alias("b"), F.col("score").isNotNull().alias("c"), F.col("score").alias("d"), (-F.col("id")).alias("e"))
    keys = ["user_id", "item_id", "variant_key"]
    best = staged.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in PLAY if c not in keys]), rank).alias("p"))
    return best.select(*[F.col(c) if c in keys else F.col(f"p.{c}") for c in PLAY])
