"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies. Within chunks the largest document with a fractional
probability is paired with the smaller ones together, or where those are too few with the next smaller one: mass,
weighted by size, moves between the two at random until one of them is integral. Expectations are kept, and so is the expected
number of words of a source. Large documents are settled first, so what is left of a chunk is one small document, which goes up
a reduction tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortmart.llm.common import WORD, fresh, stored, table

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST = 2.0
CHUNK = 2_000
FAN_IN = 500

#: Copies of one of many equal rows that a task makes.
COPIES = 1_000

ROW = "source string, doc_id long, doc_key long, size long, n_rows long, copies long, p double, level long, chunk long"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def row_key(docs: DataFrame) -> Column:
    """A hash of all columns but maps, which have none."""
    return F.xxhash64(*[F.col(f"`{name}`") for name, kind in docs.dtypes if "map<" not in kind])


def _numbered(sources: DataFrame) -> DataFrame:
    """Adds place (0, 1, ...): sources by code point, null last. Only the rows of each partition are counted together."""
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    ranged = sources.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("id", F.monotonically_increasing_id())
    ranged = stored(ranged.withColumn("part", F.shiftright("id", 33)), "mix-sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy("part").agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.col("base") + F.col("id") - F.shiftleft(F.col("part"), 33)
    return ranged.join(parts, "part").withColumn("place", place).drop("id", "part", "base")


def target_sizes(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """source, source_size, ... -> the same with target. Sources by code point, null last, take the weights in turn; none gets
    more than `most` times its size, and what it can't take is shared by weight among the others.

    Each round gives the full sources their most; the driver sees sums only. There are few rounds: one more than those in which
    a source becomes full.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights)).cast("int"))
    rows = stored(_numbered(sources).withColumns({"weight": weight, "cap": most * F.col("source_size").cast("double")}), "mix-weights")
    total = budget * float(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    rate = 0.0  # words for each weight; never falls, so a full source stays full
    full = F.col("cap") <= F.col("weight") * F.lit(rate)
    before = None
    while True:
        s = rows.agg(F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0.0)).alias("given"), F.sum(F.when(~full, F.col("weight"))).alias("open"), F.count_if(full).alias("n")).first()
        if not s["open"] or s["n"] == before:
            break
        rate, before = max(0.0, total - s["given"]) / s["open"], s["n"]
        full = F.col("cap") <= F.col("weight") * F.lit(rate)
    return rows.withColumn("target", F.when(full, F.col("cap")).otherwise(F.col("weight") * F.lit(rate))).drop("weight", "cap", "place")


def _mix(x: int) -> float:
    """A number in [0, 1) from 64 bits, the same at every run."""
    x = (x ^ (x >> 33)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
    x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 33)) >> 11) / 9007199254740992.0


def round_chunk(weight: list[float], p: list[float], keys: list[int], seed: int) -> tuple[np.ndarray, int]:
    """Rounds the probabilities of documents in descending weight, keeping sum(weight * p); the index of the one left, or -1.

    Document i with probability q against all smaller open ones, if they can take its mass: with chance q it becomes 1 and j
    gives c_j * (1 - q), else it becomes 0 and j gains c_j * q, where sum(w_j * c_j) = w_i. Otherwise it is paired with the next
    open one: with chance b/(a+b) i gains a and j gives a*w_i/w_j, else i gives b and j gains b*w_i/w_j, where a and b are the
    largest that keep both in [0, 1]. Expectations stay, and one of the two becomes 0 or 1.
    """
    w, out, tiny = np.asarray(weight, float), np.array(p, float), 1e-12

    def settle(k: object) -> None:
        x = out[k]
        out[k] = np.where(x <= tiny, 0.0, np.where(x >= 1 - tiny, 1.0, x))

    def coin(a: int, b: int) -> float:
        return _mix((keys[a] * 0x9E3779B97F4A7C15 ^ keys[b] ^ seed * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)

    settle(slice(None))
    is_open = (out > 0) & (out < 1)
    left = -1
    for i in range(len(out)):
        if not is_open[i]:
            continue
        rest = i + 1 + np.flatnonzero(is_open[i + 1 :])
        if not len(rest):
            left = i
            break
        q = out[i]
        room = np.minimum(out[rest] / (1 - q), (1 - out[rest]) / q)
        all_room = float(w[rest] @ room)
        if all_room >= w[i]:
            moved = room * (w[i] / all_room)
            if coin(i, i) < q:
                out[i], out[rest] = 1.0, out[rest] - moved * (1 - q)
            else:
                out[i], out[rest] = 0.0, out[rest] + moved * q
        else:
            for j in rest:
                ratio = w[i] / w[j]
                a, b = min(1 - out[i], out[j] / ratio), min(out[i], (1 - out[j]) / ratio)
                if coin(i, j) * (a + b) < b:
                    out[i], out[j] = out[i] + a, out[j] - a * ratio
                else:
                    out[i], out[j] = out[i] - b, out[j] + b * ratio
                settle([i, j])
                if out[i] in (0.0, 1.0):
                    break
            else:  # all smaller ones are settled
                left = i
                break
        settle(rest)
        is_open[rest] = (out[rest] > 0) & (out[rest] < 1)
    return out, left


def _round_groups(last: bool, seed: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(__w=pdf["size"].clip(lower=1)).sort_values(["__w", "doc_id", "doc_key"], ascending=False, kind="stable").reset_index(drop=True)
        weight = pdf.pop("__w").astype(float).tolist()
        keys = [k & 0xFFFFFFFFFFFFFFFF for k in pdf["doc_key"].tolist()]
        p, left = round_chunk(weight, pdf["p"].tolist(), keys, seed)
        if left >= 0 and last:
            p[left] = float(_mix(keys[left] ^ seed) < p[left])
            left = -1
        done = np.arange(len(pdf)) != left
        pdf["p"] = p
        pdf["copies"] = pdf["copies"] + np.where(done, np.round(pdf["p"]), 0).astype("int64")
        pdf.loc[done, "p"] = -1.0
        return pdf

    return fn


def mix_copies(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST, chunk: int = CHUNK, fan_in: int = FAN_IN, seed: int = 7) -> DataFrame:
    """Copies of each document: doc_id, doc_key, source, size, n_rows, source_size, target, copies.

    Null texts have size 0. Documents of size 0 take no words and are kept once. Rows that are equal in all columns are one unit
    of `n_rows` rows; its copies are those of all of them, and only the last one is left to chance, so a source of one row many
    times over comes as near to its target as any other.
    """
    units = stored(
        docs.groupBy("source", "doc_id", row_key(docs).alias("doc_key"))
        .agg(F.max(word_count(F.col("text"))).alias("size"), F.count("*").alias("n_rows")),
        "mix-units",
    )
    totals = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n_rows")).alias("source_size"), F.count("*").alias("n"))
    facts = stored(target_sizes(totals, weights, budget, most).withColumn("n_chunks", F.ceil(F.col("n") / chunk)).drop("n"), "mix-targets")
    known = facts.select(F.col("source").alias("at"), "source_size", "target", "n_chunks")
    joined = units.join(known, F.col("source").eqNullSafe(F.col("at")), "left").drop("at")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    expected = F.when(F.col("size") == 0, F.lit(1.0)).otherwise(expected)
    start = joined.select(
        "source", "doc_id", "doc_key", "size", "n_rows",
        F.floor(expected * F.col("n_rows")).cast("long").alias("copies"), (expected * F.col("n_rows") - F.floor(expected * F.col("n_rows"))).alias("p"),
        F.lit(0).cast("long").alias("level"), F.pmod(F.xxhash64("doc_key", F.lit(seed)), F.col("n_chunks")).alias("chunk"),
    )
    whole = start.where(F.col("p") <= 0)
    rest, parts, n = start.where(F.col("p") > 0), [whole], facts.agg(F.coalesce(F.max("n_chunks"), F.lit(1))).first()[0]
    level = 0
    while True:
        last = n <= 1
        out = stored(rest.groupBy("source", "chunk").applyInPandas(_round_groups(last, seed + level), ROW), f"mix-level{level}")
        parts.append(out.where(F.col("p") < 0))
        if last:
            break
        level, n = level + 1, -(-n // fan_in)
        rest = out.where(F.col("p") >= 0).withColumn("chunk", F.floor(F.col("chunk") / fan_in)).withColumn("level", F.lit(level).cast("long"))
    done = parts[0]
    for x in parts[1:]:
        done = done.unionByName(x)
    return done.join(known, F.col("source").eqNullSafe(F.col("at")), "left").select(
        "doc_id", "doc_key", "source", "size", "n_rows", "source_size", "target", "copies"
    )


def mix_documents(docs: DataFrame, **options: object) -> DataFrame:
    """The mix itself: each document as many times as it was given copies, all columns kept.

    Of equal rows one is taken for all; its copies are made by as many tasks as they need.
    """
    key, times, rows, k, part = fresh(docs, "key", "copies", "rows", "k", "part")
    copies = mix_copies(docs, **options).where("copies > 0").select(F.col("doc_key").alias(key), F.col("copies").alias(times), F.col("n_rows").alias(rows))
    keyed = docs.withColumn(key, row_key(docs)).join(copies, key)
    once = keyed.where(F.col(rows) == 1).withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times))))
    one = keyed.where(F.col(rows) > 1).dropDuplicates([key])
    parts = one.withColumn(part, F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(times) - 1) / COPIES)))).repartition(key, part)
    again = parts.withColumn(k, F.explode(F.sequence(F.col(part) * COPIES + 1, F.least(F.col(times), (F.col(part) + 1) * COPIES)))).drop(part)
    return once.unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mixed = mix_copies(docs)
    per_row = mixed.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
    # The copies of equal rows are shared out evenly.
    own = F.floor(F.col("copies") / F.col("n_rows")) + F.when(F.col("row") <= F.col("copies") % F.col("n_rows"), 1).otherwise(0)
    return per_row.select("doc_id", "size", "source_size", "target", (own * F.col("size")).alias("taken"))
