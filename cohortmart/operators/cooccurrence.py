"""How often seeds and items have users in common, for all seeds at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortmart.sources.files import save_table, scratch_path

#: Entries of a block of one user, about: pairs of blocks are what tasks share.
BLOCK = 256
#: Pairs of a seed and an item that one task counts, about.
PAIRS = 2_000_000


def _blocks(rows: DataFrame, value: Column, sizes: DataFrame, own: str, other: str, own_at: str, other_at: str) -> DataFrame:
    """user_id, own_at, other_at, entries: the rows of each user in blocks of about BLOCK, once for each block of the other side.

    Blocks are dealt by a hash of the value, so no rows of a user have to be put in order.
    """
    counted = rows.join(sizes, "user_id")
    dealt = counted.select("user_id", F.pmod(F.xxhash64(value), F.col(own)).cast("int").alias(own_at), F.col(other).alias("others"), value.alias("value"))
    blocks = dealt.groupBy("user_id", own_at, "others").agg(F.collect_list("value").alias("entries"))
    return blocks.select("user_id", own_at, F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias(other_at), "entries")


def _met(members: DataFrame, plays: DataFrame, sizes: DataFrame, block: int, parts: int | None = None) -> DataFrame:
    """seeds, items: a row for each pair of blocks of a user, in `parts` partitions if given."""
    number = lambda c: F.ceil(F.col(c) / block).cast("int")
    sizes = sizes.select("user_id", number("m").alias("m_blocks"), number("p").alias("p_blocks"))
    keys = ["user_id", "m_at", "p_at"]
    left = _blocks(members, F.col("seed_no"), sizes, "m_blocks", "p_blocks", "m_at", "p_at").withColumnRenamed("entries", "seeds")
    right = _blocks(plays, F.col("item_no"), sizes, "p_blocks", "m_blocks", "p_at", "m_at").withColumnRenamed("entries", "items")
    if parts is not None:
        left, right = left.repartition(parts, *keys), right.repartition(parts, *keys)
    return left.join(right, keys).select("seeds", "items")


def co_occurrence(members: DataFrame, plays: DataFrame, block: int = BLOCK, pairs: int = PAIRS) -> DataFrame:
    """seed_no, item_no, n_users from members (user_id, seed_no) and plays (user_id, item_no), each without repeated rows.

    The rows of a user are arrays, and a pair of blocks is one row of the join. Users with more rows than a block have several
    on either side, and every pair of blocks has a key of its own, so one user with a large part of all plays is spread over
    all tasks. What is shuffled for a seed are the blocks of items and not the pairs: all of a seed meet in one task, and tasks
    have about `pairs` pairs, which are counted there once. Seeds of more pairs than that are counted in the tasks of the join
    first, where their pairs repeat, and then added up. The pairs themselves are what a user's seeds times items are; give top
    plays to bound them.
    """
    spark, n = plays.sparkSession, F.count("*")
    sizes = members.groupBy("user_id").agg(n.alias("m")).join(plays.groupBy("user_id").agg(n.alias("p")), "user_id")
    sizes = save_table(sizes, scratch_path(spark, "sizes"))
    weights = members.join(sizes, "user_id").groupBy("seed_no").agg(F.sum("p").alias("pairs"))
    weights = save_table(weights, scratch_path(spark, "weights"))
    few = F.col("pairs") <= pairs
    light, heavy = weights.agg(F.sum(F.when(few, F.col("pairs"))), F.sum(F.when(~few, F.col("pairs")))).first()
    tasks = lambda total: max(-(-(total or 0) // pairs), spark.sparkContext.defaultParallelism)

    chosen = members.join(weights.where(few), "seed_no", "left_semi") if heavy else members
    dealt = _met(chosen, plays, sizes, block).select(F.explode("seeds").alias("seed_no"), "items").repartition(tasks(light), "seed_no")
    counted = dealt.select("seed_no", F.explode("items").alias("item_no")).groupBy("seed_no", "item_no").agg(n.alias("n_users"))
    if not heavy:
        return counted
    met = _met(members.join(weights.where(~few), "seed_no", "left_semi"), plays, sizes, block, tasks(heavy))
    often = met.select(F.explode("seeds").alias("seed_no"), "items").select("seed_no", F.explode("items").alias("item_no"))
    return counted.unionByName(often.groupBy("seed_no", "item_no").agg(n.alias("n_users")))


def seed_overlaps(members: DataFrame, best: DataFrame, popular: DataFrame, min_overlap: int, block: int = BLOCK) -> DataFrame:
    """seed_id, item_id, variant_key, cohort_overlap of at least min_overlap, from members (seed_id, user_id) and the best plays.

    popular (item_id, variant_key, user_count) are the items that count. No overlap is larger than its cohort or than its
    item's users, so cohorts and items below min_overlap go before any pair is made. Items are pairs of id and key, which are
    counted by one number, from a written table; members and plays are written too, as they are read several times.
    """
    spark = best.sparkSession
    wanted = popular.where(F.col("user_count") >= min_overlap).select("item_id", "variant_key")
    usable = save_table(wanted.withColumn("item_no", F.monotonically_increasing_id()), scratch_path(spark, "items"))
    plays = save_table(best.join(usable, ["item_id", "variant_key"]).select("user_id", "item_no"), scratch_path(spark, "plays"))
    members = save_table(members.select("seed_id", "user_id"), scratch_path(spark, "members"))
    large = members.groupBy("seed_id").agg(F.count("*").alias("n")).where(F.col("n") >= min_overlap)
    asked = members.join(large, "seed_id", "left_semi").select("user_id", F.col("seed_id").alias("seed_no"))
    counted = co_occurrence(asked, plays, block).where(F.col("n_users") >= min_overlap)
    return counted.join(usable, "item_no").select(F.col("seed_no").alias("seed_id"), "item_id", "variant_key", F.col("n_users").alias("cohort_overlap"))
