"""N-gram Jaccard join: a MinHash LSH forest finds candidates, exact shingle sets verify them.

Each text has TREES labels of DEPTH minima; a label is the path of the text in one trie of the forest. Texts are matched on
whole labels first. Then the matched prefixes are shortened until texts at the threshold meet in one of the tries with
the target recall; a trie node whose texts have all met already is not looked at again, and branches that hold one text
even at the shortest prefix are cut off before. Texts that meet and look alike make families, and within a family every
pair is verified with whole shingle sets, so a link is exact and pairs of large families are never rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmart.llm.blocks import BLOCK, block_pairs, expand, forest, map_groups, pair_ranges
from cohortmart.llm.common import fresh, row_keys, stored, table
from cohortmart.llm.components import connected_components, fewer_edges

SHINGLE = 5
SIMILARITY = 0.8
TREES, DEPTH = 20, 6
MINIMA = TREES * DEPTH
#: Bytes of a minimum in a label.
WIDTH = 2
RECALL = 0.9999
#: Texts of a crowded trie node whose signatures differ from its leader's in such a share at most are represented by it.
INSIDE = 0.2
LEADER_ROUNDS = 2
#: Texts, and words, of a block of a family that is verified.
FAMILY_BLOCK, FAMILY_WORDS = 1024, 1 << 20
#: Minima, a byte of each, that the texts of families of more than a block are told apart by before any text is dealt.
WIDE = 512

_rng = np.random.default_rng(20)
_FACTORS = _rng.integers(1, 1 << 32, MINIMA, np.uint64) | np.uint64(1)
_ADDENDS = _rng.integers(0, 1 << 32, MINIMA, np.uint64)


_WIDE_FACTORS = _rng.integers(1, 1 << 32, WIDE, np.uint64) | np.uint64(1)
_WIDE_ADDENDS = _rng.integers(0, 1 << 32, WIDE, np.uint64)


def recall_at(depth: int, similarity: float = SIMILARITY) -> float:
    """The chance that texts of that similarity share a prefix of that length in one of the tries."""
    return 1 - (1 - similarity**depth) ** TREES


def prefix_lengths(similarity: float = SIMILARITY, recall: float = RECALL) -> list[int]:
    """Lengths at which the tries are matched: whole labels, then the longest prefix that reaches the recall (or 1)."""
    last = next((d for d in range(DEPTH, 0, -1) if recall_at(d, similarity) >= recall), 1)
    return sorted({DEPTH, last}, reverse=True)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word 5-grams; texts of one to four words have one shingle, of all of them."""
    words = (text or "").encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(h))
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + (h[k : len(h) - n + 1 + k] ^ (out >> np.uint64(29)))
    out ^= out >> np.uint64(32)
    return np.unique(out)


def signature(shingles: np.ndarray, piece: int = 4096, factors: np.ndarray = _FACTORS, addends: np.ndarray = _ADDENDS) -> np.ndarray:
    """The minima of hashed shingles."""
    low = np.full(len(factors), np.iinfo(np.uint64).max, np.uint64)
    x = (shingles ^ (shingles >> np.uint64(31))) & np.uint64(0xFFFFFFFF)
    for at in range(0, len(x), piece):
        part = x[at : at + piece]
        low = np.minimum(low, ((part[None, :] * factors[:, None] + addends[:, None]) & np.uint64(0xFFFFFFFFFFFF)).min(axis=1))
    return low


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def signatures(rows: DataFrame) -> DataFrame:
    """doc_id, k1, k2, h1, h2 (hash of the words), n_words, labels (of all tries, one after the other), low (a byte of each
    minimum) of the rows (doc_id, k1, k2, text) that hold a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                h1, h2, words, labels, low, keep = [], [], [], [], [], []
                for k, text in enumerate(part.column(3).to_pylist()):
                    raw = (text or "").encode("utf-8", "surrogatepass").split()
                    if not raw:
                        continue
                    s = signature(shingle_set(text))
                    s ^= s >> np.uint64(13)
                    digest = xxhash.xxh3_128_intdigest(b" ".join(raw))
                    keep.append(k)
                    h1.append(digest >> 64)
                    h2.append(digest & 0xFFFFFFFFFFFFFFFF)
                    words.append(len(raw))
                    labels.append((s & np.uint64(0xFFFF)).astype(">u2").tobytes())
                    low.append((s & np.uint64(0xFF)).astype(np.uint8).tobytes())
                own = part.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [*[own.column(k) for k in range(3)], _longs(h1), _longs(h2), pa.array(words, pa.int64()), pa.array(labels, pa.binary()), pa.array(low, pa.binary())],
                    names=["doc_id", "k1", "k2", "h1", "h2", "n_words", "labels", "low"],
                )

    return rows.select("doc_id", "k1", "k2", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, h1 long, h2 long, n_words long, labels binary, low binary")


def _trie_node(depth: int) -> Column:
    """A hash of the trie and the prefix of that length."""
    return F.xxhash64("tree", F.substring("label", 1, depth * WIDTH))


def shared_branches(texts: DataFrame, depth: int) -> DataFrame:
    """node, tree, label: of the tries of texts (node, labels), the branches where texts share a prefix of that length."""
    size = DEPTH * WIDTH
    branches = F.array(*[F.struct(F.lit(t).cast("short").alias("tree"), F.substring("labels", t * size + 1, size).alias("label")) for t in range(TREES)])
    leaves = texts.select("node", F.explode(branches).alias("x")).select("node", "x.tree", "x.label").withColumn("prefix", _trie_node(depth))
    shared = leaves.groupBy("prefix").agg(F.count("*").alias("n")).where("n > 1").select("prefix")
    return leaves.join(shared, "prefix").select("node", "tree", "label")


def _agreement(similarity: float, minima: int = MINIMA) -> float:
    """How many minima of texts at the threshold agree at least: the expected number less five standard deviations."""
    return minima * max(0.0, similarity - 5 * np.sqrt(similarity * (1 - similarity) / minima))


def _lows(column: pa.ChunkedArray | pa.Array, minima: int = MINIMA) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, minima)


def _looks_alike(similarity: float, minima: int = MINIMA):
    """Edges of a spanning forest of the pairs of a table's groups whose signatures agree nearly as often as at the threshold."""
    least = _agreement(similarity, minima)

    def fn(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, low = t.column("node").to_numpy(), _lows(t.column("low"), minima)
        first, second, mine = (t.column(c).to_numpy() for c in ("first", "second", "mine"))
        label = np.arange(len(ids))
        for a, b in expand(*pair_ranges(starts, first, second, mine), 1 << 16):
            apart = label[a] != label[b]
            a, b = a[apart], b[apart]
            same = (low[a] == low[b]).sum(axis=1) >= least
            if same.any():
                joined = np.flatnonzero(label != np.arange(len(ids)))
                label = forest(len(ids), np.concatenate([joined, a[same]]), np.concatenate([label[joined], b[same]]))
        moved = np.flatnonzero(label != np.arange(len(ids)))
        yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[label[moved]])], names=["a", "b"])

    return fn


def _near_leaders(rest: DataFrame, similarity: float) -> DataFrame:
    """rest (prefix, node, low) with leader, near and inside: each text of a trie node against one text of it.

    Differences of signatures are a metric. So where a text differs from the leader by INSIDE at most, whatever it may link
    to differs from the leader by no more than that and what links may differ: near.
    """
    least = _agreement(similarity)
    leaders = rest.groupBy("prefix").agg(F.min_by(F.struct("node", "low"), F.xxhash64("node", F.lit("leader"))).alias("l"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = (_lows(batch.column(2)) == _lows(batch.column(4))).sum(axis=1) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(same >= least - INSIDE * MINIMA), pa.array(same >= (1 - INSIDE) * MINIMA)], names=["prefix", "node", "low", "leader", "near", "inside"])

    both = rest.join(leaders, "prefix").select("prefix", "node", "low", F.col("l.node").alias("leader"), F.col("l.low").alias("other"))
    return both.mapInArrow(run, "prefix long, node long, low binary, leader long, near boolean, inside boolean")


def _meetings(met: DataFrame, similarity: float) -> DataFrame:
    """a, b: edges between texts (prefix, n, node, low) that meet in a trie node and look alike, directly or through others.

    In nodes of more than one block, texts are held against a leader; only those it doesn't represent go on, so a large
    group of near copies costs a row for each. The others are compared in pairs of blocks.
    """
    edges = []
    crowded = met.where(F.col("n") > BLOCK).select("prefix", "node", "low")
    rest = met.where(F.col("n") <= BLOCK).select("prefix", "node", "low")
    if not crowded.isEmpty():
        for _ in range(LEADER_ROUNDS):
            seen = stored(_near_leaders(crowded, similarity), "jaccard-leaders")
            edges.append(seen.where("near AND node <> leader").select(F.col("node").alias("a"), F.col("leader").alias("b")))
            crowded = seen.where("NOT inside").select("prefix", "node", "low")
        rest = rest.unionByName(crowded)
    found = map_groups(block_pairs(rest, "prefix", "node"), "prefix", "node", _looks_alike(similarity), "a long, b long")
    for other in edges:
        found = found.unionByName(other)
    return found


def families(texts: DataFrame, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """node, component: texts (node, labels, low) that may link with others, directly or through others."""
    depths = prefix_lengths(similarity, recall)
    branches = stored(shared_branches(texts, depths[-1]), "jaccard-branches")
    known = None
    for depth in depths:
        here = branches.select("node", _trie_node(depth).alias("prefix"))
        here = here.withColumn("family", F.col("node")) if known is None else here.join(known, "node", "left").withColumn("family", F.coalesce("component", "node"))
        unsettled = here.groupBy("prefix").agg(F.count("*").alias("n"), F.min("family").alias("low"), F.max("family").alias("high")).where("low < high").select("prefix", "n")
        met = stored(here.select("node", "prefix").join(unsettled, "prefix").join(texts.select("node", "low"), "node").select("prefix", "n", "node", "low"), "jaccard-met")
        edges = fewer_edges(_meetings(met, similarity), "a", "b")
        if known is not None:
            edges = edges.unionByName(known.select(F.col("node").alias("a"), F.col("component").alias("b")))
        known = connected_components(edges, "a", "b")
    return known


def _wide(rows: DataFrame) -> DataFrame:
    """component, node, low: a byte of each of WIDE minima of the rows (component, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = []
            for text in batch.column(2).to_pylist():
                x = signature(shingle_set(text), 4096, _WIDE_FACTORS, _WIDE_ADDENDS)
                low.append((x ^ (x >> np.uint64(13))).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(low, pa.binary())], names=["component", "node", "low"])

    return rows.select("component", "node", "text").mapInArrow(run, "component long, node long, low binary")


def told_apart(members: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """members (component, node, text, ...) with the families of more than a block cut into those of texts that look alike by
    WIDE minima, too. Texts of one template, say of similarity 0.5, make a family by the few minima of the forest, but none by
    these, and no text is dealt for them. Texts that look like no other are left out: they link with nothing.

    Short signatures are dealt here instead of texts: WIDE bytes of a text for each block of its family.
    """
    large = members.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > FAMILY_BLOCK).select("component")
    if large.isEmpty():
        return members
    wide = stored(_wide(members.join(large, "component", "left_semi")), "jaccard-wide")
    edges = map_groups(block_pairs(wide, "component", "node", FAMILY_BLOCK), "component", "node", _looks_alike(similarity, WIDE), "a long, b long")
    parts = connected_components(fewer_edges(stored(edges, "jaccard-alike"), "a", "b"), "a", "b")
    cut = members.drop("component").join(parts, "node").select(*members.columns)
    return members.join(large, "component", "left_anti").unionByName(cut)


def _overlaps(sets: list[np.ndarray], others: list[np.ndarray] | None, columns: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets with all others (or each other), by products of 0/1 matrices."""
    rows = sets if others is None else [*sets, *others]
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(s) for s in rows])
    _, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[place] > 1
    owner, place = owner[shared], np.unique(place[shared], return_inverse=True)[1]
    n = len(sets)
    out = np.zeros((n, len(rows) if others is None else len(others)), np.float32)
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for at in range(0, int(place[-1]) + 1 if len(place) else 0, columns):
        lo, hi = np.searchsorted(place, [at, at + columns])
        m = np.zeros((len(rows), columns), np.float32)
        m[owner[lo:hi], place[lo:hi] - at] = 1
        out += m[:n] @ (m if others is None else m[n:]).T
    return out


def _verify(similarity: float):
    """For each member, the weight of its links (links: documents linked to it) and an edge of a spanning forest."""

    def fn(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, weight = t.column("node").to_numpy(), t.column("copies").to_numpy()
        mine, first = t.column("mine").to_numpy(), t.column("first").to_numpy()
        second = t.column("second").to_numpy()
        texts = t.column("text")
        out_id, out_links, out_to = [], [], []
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            sets = [shingle_set(texts[k].as_py()) for k in range(s, e)]
            size = np.array([len(x) for x in sets], float)
            n = e - s
            if first[s] == second[s]:
                both = _overlaps(sets, None)
                a, b = np.triu_indices(n, 1)
                inter = both[a, b]
            else:
                cut = int((mine[s:e] == first[s]).sum())
                if cut in (0, n):
                    continue
                both = _overlaps(sets[:cut], sets[cut:])
                a, b = np.divmod(np.arange(cut * (n - cut)), n - cut)
                inter, b = both[a, b], b + cut
            linked = inter >= similarity * (size[a] + size[b] - inter) - 1e-9
            a, b = a[linked], b[linked]
            links = np.bincount(a, weight[s + b], n) + np.bincount(b, weight[s + a], n)
            label = forest(n, a, b)
            has = np.flatnonzero(links > 0)
            out_id.append(ids[s + has])
            out_links.append(links[has].astype(np.int64))
            out_to.append(ids[s + label[has]])
        if out_id:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_id, out_links, out_to)], names=["node", "links", "to"])

    return fn


def _decide(docs: DataFrame, similarity: float) -> DataFrame:
    """doc_id, k1, k2, n, class_id, n_links, kept for each different row (id and text) of docs that holds a word; n counts it."""
    k1, k2 = row_keys("doc_id", "text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select("doc_id", "text", k1.alias("k1"), k2.alias("k2"))
    sig = stored(signatures(rows), "jaccard-signatures")
    one = sig.groupBy("h1", "h2").agg(
        F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.min_by(F.struct("k1", "k2", "n_words", "labels", "low"), F.struct("k1", "k2")).alias("s")
    )
    texts = stored(one.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "least", "copies", "s.*"), "jaccard-texts")
    family = families(texts, similarity)
    wanted = texts.join(family, "node").select("k1", "k2", "node", "component", "copies", "n_words")
    members = stored(rows.select("k1", "k2", "text").join(wanted, ["k1", "k2"]).drop("k1", "k2").dropDuplicates(["node"]), "jaccard-members")
    dealt = block_pairs(told_apart(members, similarity), "component", "node", FAMILY_BLOCK, "n_words", FAMILY_WORDS)
    checked = stored(map_groups(dealt, "component", "node", _verify(similarity), "node long, links long, to long"), "jaccard-links")
    parts = connected_components(fewer_edges(checked, "node", "to"), "a", "b").select("node", F.col("component").alias("part"))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    known = texts.select("node", "h1", "h2", "least", "copies").join(links, "node", "left").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    known = stored(known.select("h1", "h2", "least", "part", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "jaccard-known")
    classes = known.groupBy("part").agg(F.min("least").alias("class_id"))
    different = sig.groupBy("doc_id", "k1", "k2", "h1", "h2").agg(F.count("*").alias("n"))
    judged = different.join(known.join(classes, "part").drop("least"), ["h1", "h2"]).select("doc_id", "k1", "k2", "n", "part", "class_id", "n_links")
    judged = stored(judged, "jaccard-judged")
    first = judged.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("part").agg(F.min(F.struct("k1", "k2")).alias("first"))
    kept = F.struct("k1", "k2") == F.col("first")
    return judged.join(first, "part", "left").select("doc_id", "k1", "k2", "n", "class_id", "n_links", F.coalesce(kept, F.lit(False)).alias("kept"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, class_id, n_links, kept: one row for each row of docs.

    class_id is the smallest doc_id of the texts joined by links of Jaccard similarity >= `similarity`, directly or through
    others; n_links counts the other rows linked directly, copies included; kept is true for one row of each class, also
    where rows share an id or are equal. Texts of the same words are one text with copies. Null texts and texts without a
    word link with nothing and are kept. Ids need not be distinct; a null id counts as the largest.
    """
    decided = _decide(docs, similarity).withColumn("k", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    found = decided.select("doc_id", "class_id", "n_links", (F.col("kept") & (F.col("k") == 1)).alias("kept"))
    blank = docs.where(F.col("text").isNull() | ~F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(F.col("doc_id").cast("long").alias("doc_id"))
    return found.unionByName(blank.select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("kept")))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each class of near duplicates, that of the smallest id; all columns kept.

    Of rows that share id and text one stays, whichever; rows without a word all stay.
    """
    decided = stored(_decide(docs, similarity).select("k1", "k2", "n", "kept"), "jaccard-decided")
    a, b = fresh(docs, "key_a", "key_b")
    k1, k2 = row_keys(F.col("doc_id").cast("long"), "text")
    keyed = docs.withColumns({a: k1, b: k2})
    columns = [F.col(f"`{c}`") for c in docs.columns]
    named = lambda df: df.select(F.col("k1").alias(a), F.col("k2").alias(b))
    single = keyed.join(named(decided.where("NOT kept OR n > 1")), [a, b], "left_anti")
    again = keyed.join(named(decided.where("kept AND n > 1")), [a, b], "left_semi").dropDuplicates([a, b])
    return single.select(*columns).unionByName(again.select(*columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: All pairs of texts that share a shingle, their Jaccard similarity, and the closure of the links. Ids are distinct there.
ORACLE = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, w, least(5, len(w)) AS k FROM w WHERE len(w) > 0),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM k),
x AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-9),
l AS (SELECT a AS doc_id, b AS other FROM p UNION ALL SELECT b, a FROM p),
r AS (SELECT doc_id, other FROM l UNION SELECT r.doc_id, l.other FROM r JOIN l ON r.other = l.doc_id),
c AS (SELECT doc_id, min(other) AS least FROM r GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id)
SELECT d.doc_id, least(d.doc_id, coalesce(c.least, d.doc_id)) AS class_id, coalesce(n.n, 0) AS n_links, d.doc_id <= coalesce(c.least, d.doc_id) AS kept
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
"""
