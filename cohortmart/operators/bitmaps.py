"""Sets of users as bitmaps: users are numbered densely once, an item's users are bits in buckets of 32,768 numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortmart.sources.files import save_table, scratch_path


def dense_numbers(ids: DataFrame, column: str, name: str = "user_no") -> DataFrame:
    """column, name: the distinct ids in ascending order, numbered from 0 without gaps; null ids are left out.

    Ranges of ids are sorted each for itself. Only the number of ids of each range is put in order as a whole, one row for each
    partition.
    """
    spark = ids.sparkSession
    ranged = ids.where(F.col(column).isNotNull()).select(column).distinct().repartitionByRange(column).sortWithinPartitions(column)
    placed = save_table(ranged.withColumn("at", F.monotonically_increasing_id()), scratch_path(spark, "numbers"))
    part, place = F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return placed.withColumn("part", F.shiftright("at", 33)).join(before, "part").select(column, (F.col("before") + place).alias(name))


def numbered_plays(best: DataFrame, numbers: DataFrame) -> DataFrame:
    """The best plays with user_no, for cohorts as bitmaps. This is the only join by user; it is made once, with the marts."""
    return best.join(numbers, "user_id")


def _bits(number: str = "user_no") -> tuple[Column, Column]:
    return F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")


def item_bitmaps(plays: DataFrame) -> DataFrame:
    """item_id, variant_key, bucket, bits: the users of each item and variant, from numbered plays. A row has 4 KB, and an item
    of any size is spread over its buckets.

    Plays are dealt as numbers and bits are set behind the shuffle: most items have few users in a task, whose bitmaps would be
    far larger than they are. A bucket has 32,768 users at most, so no item or bucket is too much for a task.
    """
    keys = ["item_id", "variant_key", "bucket"]
    placed = plays.select("item_id", "variant_key", F.bitmap_bucket_number("user_no").alias("bucket"), "user_no")
    return placed.repartition(*keys).groupBy(*keys).agg(_bits()[1])


def cohort_bitmap(plays: DataFrame, condition: Column) -> DataFrame:
    """bucket, bits: the users with a play that meets the condition, for instance cohort_filter()."""
    bucket, bits = _bits()
    return plays.where(condition).groupBy(bucket).agg(bits)


def bitmap_sizes(bitmaps: DataFrame, *by: str) -> DataFrame:
    """by, n_users: the number of bits in all buckets."""
    return bitmaps.groupBy(*by).agg(F.sum(F.bitmap_count("bits")).alias("n_users"))


def bitmap_overlap(items: DataFrame, cohort: DataFrame) -> DataFrame:
    """item_id, variant_key, cohort_overlap, as cohort_overlap() gives it: the bits that an item's bitmap and the cohort's have
    in common, bucket by bucket. No user is joined or counted by itself, and items without a common user have no row.

    Both bitmaps of a bucket are two rows of one group, which are combined before the shuffle.
    """
    met = items.join(cohort.select("bucket", F.col("bits").alias("asked")), "bucket")
    both = met.select("item_id", "variant_key", "bucket", F.explode(F.array("bits", "asked")).alias("bits"))
    common = both.groupBy("item_id", "variant_key", "bucket").agg(F.bitmap_and_agg("bits").alias("bits"))
    return bitmap_sizes(common, "item_id", "variant_key").where("n_users > 0").withColumnRenamed("n_users", "cohort_overlap")
