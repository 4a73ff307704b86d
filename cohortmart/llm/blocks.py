"""Pairs within groups without emitting them: groups are cut into blocks, pairs of blocks are dealt to tasks.

A task sees at most two blocks of one group. It compares their pairs in numpy and returns something for each member, so rows
grow with the members and not with the pairs; a group of any size spreads over as many tasks as it has pairs of blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 512
PAIRS = 1 << 20


def block_pairs(members: DataFrame, key: str, member: str, block: int = BLOCK, weight: str | None = None, most: int = 1 << 20) -> DataFrame:
    """Members of groups of two and more, each once for every pair of blocks that its block takes part in.

    Adds first, second (the pair of blocks) and mine (the member's own). Rows with the same key, first and second belong
    together. A group of up to `block` members is one block, paired with itself; with `weight`, a column, blocks also hold
    about `most` of it together at most, so that long members make smaller blocks.
    """
    load = F.sum(F.col(weight).cast("long")) if weight else F.lit(0).cast("long")
    sizes = members.groupBy(key).agg(F.count("*").alias("__n"), load.alias("__load")).where("__n > 1")
    joined = members.join(sizes, key)
    wanted = F.greatest(F.ceil(F.col("__n") / block), F.ceil(F.col("__load") / most))
    n_blocks = F.least(F.col("__n"), wanted).cast("int")
    dealt = joined.withColumn("mine", F.pmod(F.xxhash64(member, F.lit("block")), n_blocks).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
    return dealt.withColumns({"first": F.least("mine", "__other"), "second": F.greatest("mine", "__other")}).drop("__n", "__load", "__other")


def sorted_groups(dealt: DataFrame, key: str, member: str) -> DataFrame:
    return dealt.repartition(key, "first", "second").sortWithinPartitions(key, "first", "second", "mine", member)


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole groups from sorted batches, with the start of each group (and the end). Memory is bounded by a batch and
    a group, which holds two blocks at most."""
    rest: pa.Table | None = None

    def starts(t: pa.Table) -> np.ndarray:
        cols = [t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in (key, "first", "second")]
        change = np.zeros(len(t), bool)
        change[:1] = True
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(change)

    for batch in batches:
        t = pa.Table.from_batches([batch])
        if rest is not None:
            t = pa.concat_tables([rest, t])
        if not len(t):
            continue
        s = starts(t)
        if len(s) > 1:
            yield t.slice(0, s[-1]).combine_chunks(), s
        rest = t.slice(s[-1])
    if rest is not None and len(rest):
        yield rest.combine_chunks(), np.array([0, len(rest)])


def pair_ranges(starts: np.ndarray, first: np.ndarray, second: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the range of later rows that it is to be compared with: all later ones of its group, or for a
    pair of different blocks, the rows of the second block if it is of the first."""
    n = len(mine)
    size = np.diff(starts)
    end = np.repeat(starts[1:], size)
    of_first = mine == first
    in_first = np.add.reduceat(of_first.astype(np.int64), starts[:-1]) if n else np.zeros(0, np.int64)
    begin_second = np.repeat(starts[:-1] + in_first, size)
    low = np.where(first == second, np.arange(n) + 1, np.where(of_first, begin_second, end))
    return low, end


def expand(low: np.ndarray, end: np.ndarray, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of rows of those ranges, about `most` at a time."""
    count = np.maximum(end - low, 0)
    total = np.cumsum(count)
    at, n = 0, len(low)
    while at < n:
        before = total[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(total, before + most, "right")))
        c = count[at:stop]
        if c.sum():
            a = np.repeat(np.arange(at, stop), c)
            offset = np.arange(len(a)) - np.repeat(np.cumsum(c) - c, c)
            yield a, low[a] + offset
        at = stop


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each row is joined to by the pairs (a, b), directly or through others."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        new = new[label]
        if (new == label).all():
            break
        label = new
    return label


def map_groups(dealt: DataFrame, key: str, member: str, fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Applies fn to tables of whole groups of block_pairs()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, key):
            yield from fn(t, starts if starts[-1] == len(t) else np.append(starts, len(t)))

    return sorted_groups(dealt, key, member).mapInArrow(run, schema)
