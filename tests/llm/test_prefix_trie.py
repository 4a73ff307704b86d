"""Prefix trie against a plain one of dictionaries, whole and in small shards, and its edge cases."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from cohortmart.llm import prefix_trie
from tests.conftest import rows

TURNS = "conv_id long, turn long, role string, text string"


def order(turn):
    return (turn[0] is not None, turn[0] or 0, turn[1] or "", turn[2] or "")


def plain_conversations(data):
    own = {}
    for c, turn, role, text in data:
        if c is not None:
            own.setdefault(c, []).append((turn, role, text))
    return {c: [(r or "", t or "") for _, r, t in sorted(turns, key=order)] for c, turns in own.items()}


def plain_rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    return out


def plain_trie(conversations):
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, ids in members.items():
        subtree = [p for p in members if p[: len(path)] == path]
        children = [p for p in subtree if len(p) == len(path) + 1]
        leaves = [p for p in subtree if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in subtree)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in subtree if p)
        ends = ",".join(map(str, sorted(c for c in ids if len(conversations[c]) == len(path))))
        up = min(members[path[:-1]]) if path else None
        out.append((min(ids), len(path), up, len(ids), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def made(seed, n, spread):
    rnd = random.Random(seed)
    data = []
    for c in range(n):
        for turn in range(rnd.choice([1, 2, 3, 6, 9])):
            say = rnd.choice(["hi", "yes", "ñandú", ""]) if rnd.random() < 0.8 else f"own {c} {turn}"
            data.append((c * spread, turn, rnd.choice(["user", "user", None]), None if rnd.random() < 0.1 else say))
    return data


@pytest.mark.parametrize("spread,shard", [(1, 1024), (1, 16), (7, 4), (100, 16)])
def test_query_equals_plain_trie(spark, tmp_path, monkeypatch, spread, shard):
    monkeypatch.setattr(prefix_trie, "SHARD", shard)
    data = made(spread, 130, spread)
    spark.createDataFrame(data, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows(prefix_trie.query(spark, str(tmp_path))) == plain_trie(plain_rebuilt(plain_conversations(data)))


def trie(spark, data):
    nodes = prefix_trie.shard_nodes(prefix_trie.sequences(spark.createDataFrame(data, TURNS)))
    whole = prefix_trie.prefix_trie(nodes).join(prefix_trie.end_digests(nodes), "node", "left")
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    return whole.select(*columns, F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def test_conversations_as_they_are(spark, monkeypatch):
    """Nulls anywhere, ties, repeated rows, rows without an id, one long conversation and one that all have."""
    monkeypatch.setattr(prefix_trie, "SHARD", 8)
    data = made(3, 30, 1) + [(None, 1, "user", "hi"), (50, None, None, None), (50, None, "user", "x"), (50, 1, "a", "b"), (50, 1, "a", "b"), (50, 1, "a", "a")]
    data += [(60, k, "user", f"{k % 3}") for k in range(300)] + [(100 + c, k, "user", "same " * 50) for c in range(40) for k in range(3)]
    assert rows(trie(spark, data)) == plain_trie(plain_conversations(data))


def test_empty_table_and_other_columns(spark):
    none = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(prefix_trie.shard_nodes(prefix_trie.rebuilt_sequences(none))).count() == 0
    extra = spark.createDataFrame([(1, 0, "user", "hi", 5, b"x")], f"{TURNS}, place int, node binary")
    got = prefix_trie.prefix_trie(prefix_trie.shard_nodes(prefix_trie.sequences(extra)))
    assert sorted((r["depth"], r["n_convs"], r["n_leaves"]) for r in got.collect()) == [(0, 1, 1), (1, 1, 1)]


def test_bitsets_of_a_shard():
    a, b, c = (bytes([k]) * 16 for k in range(3))
    found = list(prefix_trie.shard_trie([[a, b], [a], [a, b], [c], []], [[1, 2], [1], [1, 2], [3], []]))
    assert [(depth, members, ends, size) for _, _, _, depth, members, ends, size in found] == [(0, 0b11111, 0b10000, 0), (1, 0b00111, 0b00010, 1), (2, 0b00101, 0b00101, 2), (1, 0b01000, 0b01000, 3)]
    assert [up for _, _, up, *_ in found] == [-1, 0, 1, 0]
