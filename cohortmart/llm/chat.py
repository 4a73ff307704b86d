"""Chat formatting: logged conversations that are a prefix of a longer one are dropped, the others are rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortmart.llm.common import stored, table

ROLE_OPEN, ROLE_CLOSE, TURN_END = "<|", "|>\n", "<|end|>\n"


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> the same with place (1, 2, ...), n_turns, h1 and h2: rolling hashes of the turns so far.

    The hashes combine by xor those of (place, role, text) of each turn, two independent ones of 64 bits. Repeated rows
    of a conversation count once; turns of the same number are ordered by role and text; null turns come first. Rows
    without a conv_id are conversations of one turn each. Other columns are ignored.
    """
    clean = turns.select("conv_id", "turn", "role", "text").distinct()
    # A conversation of its own for each row without an id: the row's hash stands for the missing id.
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    keyed = clean.withColumn("alone", alone)
    order = Window.partitionBy("conv_id", "alone").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def one(seed: str) -> Column:
        return F.xxhash64(F.lit(seed), "place", "role", F.col("text").isNull(), "text")

    placed = keyed.withColumn("place", F.row_number().over(order))
    whole = Window.partitionBy("conv_id", "alone")
    return placed.withColumns(
        {"h1": F.bit_xor(one("a")).over(so_far), "h2": F.bit_xor(one("b")).over(so_far), "n_turns": F.count("*").over(whole)}
    )


def render_turn(role: Column, text: Column) -> Column:
    """A null role renders as an empty one, a null text as an empty one."""
    return F.concat(F.lit(ROLE_OPEN), F.coalesce(role, F.lit("")), F.lit(ROLE_CLOSE), F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(TURN_END))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, chat: each maximal conversation once, rendered turn by turn.

    One output row holds one conversation; nothing larger than a conversation is gathered in a task.
    """
    prefixes = stored(turn_prefixes(turns), "chat-prefixes")
    whole = prefixes.where("place = n_turns").groupBy("n_turns", "h1", "h2").agg(
        F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id", "alone")).alias("first"), F.count("*").alias("n_copies")
    )
    proper = prefixes.where("place < n_turns").select(F.col("place").cast("long").alias("n_turns"), "h1", "h2").distinct()
    maximal = whole.join(proper, ["n_turns", "h1", "h2"], "left_anti").select(
        F.col("first.conv_id").alias("id"), F.col("first.alone").alias("one"), "n_turns", "n_copies"
    )
    same = F.col("conv_id").eqNullSafe(F.col("id")) & F.col("alone").eqNullSafe(F.col("one"))
    kept = prefixes.drop("n_turns").join(maximal, same).select("conv_id", "alone", "n_turns", "n_copies", "place", render_turn(F.col("role"), F.col("text")).alias("piece"))
    gathered = kept.groupBy("conv_id", "alone", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(F.struct("place", "piece"))).alias("all"))
    return gathered.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("all", lambda x: x["piece"]), "").alias("chat"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS place,
        count(*) OVER (PARTITION BY conv_id) AS n_turns,
        string_agg('<|' || role || '|>' || chr(10) || text || chr(10) || '<|end|>' || chr(10), '')
          OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS chat
      FROM t),
whole AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, chat FROM p WHERE place = n_turns GROUP BY n_turns, chat)
SELECT w.conv_id, CAST(w.n_turns AS BIGINT) AS n_turns, w.n_copies, w.chat FROM whole w
WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.place < p.n_turns AND p.place = w.n_turns AND p.chat = w.chat)
"""
