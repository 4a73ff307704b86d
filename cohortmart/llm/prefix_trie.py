"""Prefix trie of conversations from vertical bitmaps: bitsets of conversations for each (position, turn), shard by shard."""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortmart.llm.common import crc_sql, row_keys, stored, table

#: Conversations of a shard, neighbours by id: the bits of one bitset.
SHARD = 1_024
#: Turns that a rebuilt conversation may take over are fewer than this; groups of so many ids share them.
BORROWED, GROUP = 6, 100

TURN = "conv_id long, place long, k1 long, k2 long, n_chars long"
NODE = "node binary, up_node binary, shard long, number long, up long, size long, depth long, n_convs long, first_conv long, n_chars long, inner boolean, ends array<long>"
PART = "node binary, saved_tokens long, n_leaves long, n_children long, up_conv long"


def placed_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text -> conv_id, place (1, 2, ...), k1, k2 (hashes of role and text), n_chars (code points).

    Null turns come first, turns of the same number in the order of role and text; null roles and texts are empty ones;
    repeated rows are turns of their own; rows without a conv_id are left out, other columns ignored. Texts move once, to be
    put in order, and go no further.
    """
    clean = turns.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    k1, k2 = row_keys("role", "text")
    return clean.select("conv_id", F.row_number().over(order).cast("long").alias("place"), k1.alias("k1"), k2.alias("k2"), F.char_length("text").cast("long").alias("n_chars"))


def _roots(conversations: DataFrame) -> DataFrame:
    """The row of place 0 of every conversation: it is a member of the root, whether it has turns or not."""
    none = F.lit(0).cast("long")
    return conversations.select("conv_id", *[none.alias(c) for c in ("place", "k1", "k2", "n_chars")])


def sequences(turns: DataFrame) -> DataFrame:
    """Conversations as they are, for prefix_trie()."""
    placed = stored(placed_turns(turns), "trie-turns")
    return placed.unionByName(_roots(placed.select("conv_id").distinct()))


def rebuilt_sequences(turns: DataFrame) -> DataFrame:
    """Conversations that begin with the first h turns of the first one of their hundred, and go on with their own turns after
    the first h; h is crc32 of the id modulo 6. One without turns is left as a root."""
    placed = stored(placed_turns(turns), "trie-turns")
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    leads = sizes.select(F.col("conv_id").alias("lead"), F.col("n").alias("lead_n"))
    h, lead = F.crc32(F.col("conv_id").cast("string")) % BORROWED, F.col("conv_id") - F.col("conv_id") % GROUP
    # At most a hundred conversations share a lead, and a lead lends five turns at most.
    plan = sizes.select("conv_id", h.alias("h"), lead.alias("lead")).join(leads, "lead", "left").select("conv_id", "h", "lead", F.least("h", F.coalesce("lead_n", F.lit(0))).alias("taken"))
    lent = placed.where((F.col("place") < BORROWED) & (F.col("conv_id") % GROUP == 0)).withColumnRenamed("conv_id", "lead")
    first = plan.join(lent, "lead").where("place <= taken").select("conv_id", "place", "k1", "k2", "n_chars")
    own = placed.join(plan, "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "k1", "k2", "n_chars")
    return first.unionByName(own).unionByName(_roots(sizes))


def _bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def shard_trie(keys: list[list[bytes]], chars: list[list[int]]) -> Iterator[tuple[bytes, bytes | None, int, int, int, int, int]]:
    """Nodes of the trie of a few conversations, depth first: path, path above, number of the node above, depth, bitset of
    members, bitset of those that end here, code points of the last turn. A path is a hash of all turns from the root on."""
    postings: defaultdict[tuple[int, bytes], int] = defaultdict(int)
    longer: defaultdict[int, int] = defaultdict(int)
    for c, turns in enumerate(keys):
        for d, key in enumerate(turns):
            postings[d, key] |= 1 << c
            longer[d] |= 1 << c
    stack: list[tuple[bytes, bytes | None, int, int, int, int]] = [(b"", None, -1, 0, (1 << len(keys)) - 1, 0)]
    number = 0
    while stack:
        path, above, up, depth, members, size = stack.pop()
        rest = members & longer[depth]
        yield path, above, up, depth, members, members ^ rest, size
        children = []
        while rest:
            # The turn of the first conversation left: its posting within the node is a child.
            one = (rest & -rest).bit_length() - 1
            key = keys[one][depth]
            child = rest & postings[depth, key]
            rest ^= child
            children.append((hashlib.blake2b(path + key, digest_size=16).digest(), path, number, depth + 1, child, chars[one][depth]))
        stack.extend(reversed(children))
        number += 1


def _shard_nodes(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["conv_id", "place"])
    conv, place = pdf["conv_id"].to_numpy(), pdf["place"].to_numpy()
    packed = pdf[["k1", "k2"]].to_numpy("<i8").tobytes()
    root = np.flatnonzero(place == 0)
    cut, ids, size = np.append(root, len(conv)), conv[root], pdf["n_chars"].tolist()
    keys = [[packed[16 * i : 16 * i + 16] for i in range(a + 1, b)] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    chars = [size[a + 1 : b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
    found = list(shard_trie(keys, chars))
    below = np.ones(len(found), np.int64)
    for k in range(len(found) - 1, 0, -1):
        below[found[k][2]] += below[k]
    shard = int(pdf["shard"].iloc[0])
    rows = [
        (path, above, shard, k, up, int(below[k]), depth, members.bit_count(), int(ids[(members & -members).bit_length() - 1]), n_chars, members != ends, [int(ids[b]) for b in _bits(ends)])
        for k, (path, above, up, depth, members, ends, n_chars) in enumerate(found)
    ]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in NODE.split(", ")])


def _shard_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """What a shard adds to its nodes' subtrees. A node that several shards have counts in the first of them, its owner, which
    has all nodes above it too."""
    pdf = pdf.sort_values("number")
    owned = (pdf["owner"] == pdf["shard"]).to_numpy()
    chars, n, up = pdf["n_chars"].to_numpy(np.int64), pdf["n_convs"].to_numpy(np.int64), pdf["up"].to_numpy(np.int64)

    def subtree(x: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(x))
        at = np.arange(len(x))
        return sums[at + pdf["size"].to_numpy()] - sums[at]

    children = np.zeros(len(pdf), np.int64)
    np.add.at(children, up[1:], owned[1:].astype(np.int64))
    first = pdf["all_first"].to_numpy(np.int64)
    up_conv = pd.array(first[np.maximum(up, 0)], dtype="Int64")
    up_conv[up < 0] = pd.NA
    return pd.DataFrame(
        {"node": pdf["node"], "saved_tokens": subtree((n - owned) * chars), "n_leaves": subtree((owned & ~pdf["all_inner"].to_numpy(bool)).astype(np.int64)), "n_children": children, "up_conv": up_conv}
    )


def shard_nodes(turns: DataFrame) -> DataFrame:
    """The nodes of each shard, with the ids of the conversations that end there, ascending, in a written table.

    A shard is up to SHARD conversations that are neighbours by id, and shards are in the order of ids. One conversation's
    turns are in one task, as hashes; no node's members are.
    """
    ids = turns.where("place = 0").select("conv_id").repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    shards = stored(ids.withColumn("shard", F.shiftright(F.monotonically_increasing_id(), SHARD.bit_length() - 1)), "trie-shards")
    return stored(turns.join(shards, "conv_id").groupBy("shard").applyInPandas(_shard_nodes, NODE), "trie-nodes")


def prefix_trie(nodes: DataFrame) -> DataFrame:
    """node, up_node, conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens of the
    whole trie, from shard_nodes(). No rows without conversations."""
    whole = nodes.groupBy("node").agg(
        F.min("shard").alias("owner"), F.min("first_conv").alias("all_first"), F.max("inner").alias("all_inner"), F.first("up_node").alias("up_node"), F.first("depth").alias("depth"), F.sum("n_convs").alias("all_convs")
    )
    whole = stored(whole, "trie-whole")
    wanted = nodes.select("node", "shard", "number", "up", "size", "n_convs", "n_chars").join(whole.select("node", "owner", "all_first", "all_inner"), "node")
    parts = wanted.groupBy("shard").applyInPandas(_shard_sums, PART)
    sums = parts.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved_tokens")], F.min("up_conv").alias("parent_conv_id"))
    return whole.join(sums, "node").select("node", "up_node", F.col("all_first").alias("conv_id"), "depth", "parent_conv_id", F.col("all_convs").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")


def end_digests(nodes: DataFrame) -> DataFrame:
    """node, ends_sha256: hash of the decimal ids of the conversations that end at the node, ascending, joined by commas.

    The lists of a node come in the order of shards, one row each, and run through the hash one after the other: a list of any
    length is never in memory as a whole.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for own, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own != node:
                    if running is not None:
                        done.append((node, running.hexdigest()))
                    node, running = own, hashlib.sha256()
                    running.update(",".join(map(str, ends)).encode())
                else:
                    running.update(("," + ",".join(map(str, ends))).encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends_sha256"])
        if running is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([running.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    listed = nodes.where(F.size("ends") > 0).select("node", "ends", "shard")
    return listed.repartition("node").sortWithinPartitions("node", "shard").select("node", "ends").mapInArrow(digest, "node binary, ends_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = shard_nodes(rebuilt_sequences(table(spark, sf_dir, "conversations")))
    trie = prefix_trie(nodes).join(end_digests(nodes), "node", "left")
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


_SQL = """
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
h AS (SELECT conv_id, n, {crc} % 6 AS h, conv_id - conv_id % 100 AS lead FROM c),
k AS (SELECT h.*, least(h.h, coalesce(l.n, 0)) AS k FROM h LEFT JOIN c l ON l.conv_id = h.lead),
s AS (SELECT k.conv_id, t.place, role, text FROM k JOIN t ON t.conv_id = k.lead AND t.place <= k.k
      UNION ALL SELECT k.conv_id, t.place - k.h + k.k, role, text FROM k JOIN t ON t.conv_id = k.conv_id AND t.place > k.h),
p AS (SELECT conv_id, place AS depth, length(text) AS chars,
        string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY place) AS path FROM s
      UNION ALL SELECT conv_id, 0, 0, '' FROM k),
e AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS last FROM p),
n AS (SELECT path, min(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
        sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = last), '')) AS ends_sha256 FROM e GROUP BY path),
u AS (SELECT *, CASE WHEN depth > 0 THEN substr(path, 1, 64 * (depth - 1)) END AS up FROM n),
ch AS (SELECT up AS path, count(*) AS n_children FROM u WHERE up IS NOT NULL GROUP BY up),
x AS (SELECT u.*, coalesce(n_children, 0) AS n_children FROM u LEFT JOIN ch USING (path)),
anc AS (SELECT substr(path, 1, 64 * i) AS path, sum((n_convs - 1) * chars) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
        FROM (SELECT *, unnest(range(depth + 1)) AS i FROM x) GROUP BY 1)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, above.conv_id AS parent_conv_id, x.n_convs, CAST(x.n_children AS BIGINT) AS n_children,
  anc.n_leaves, CAST(anc.saved_tokens AS BIGINT) AS saved_tokens, x.ends_sha256
FROM x JOIN anc USING (path) LEFT JOIN n above ON above.path = x.up
"""

ORACLE = _SQL.replace("{crc}", crc_sql("conv_id"))
