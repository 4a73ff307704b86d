"""Embedding near-duplicates by a pivot-permutation index.

Every vector is described by its nearest reference points in order. Each of the first few of them has an inverted list that
the vector is entered in. Two vectors of a list are candidates if their permutations share some pivots at least, and
candidates are verified by their cosine in double precision. Reference points are kept apart from each other, so that a
crowd of like vectors has few of them and like vectors share the same ones. Pivots become denser as vectors become more, so how
many are looked at follows from the recall of pairs that are planted just at the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmart.llm.blocks import block_pairs, expand, forest, map_groups, pair_ranges
from cohortmart.llm.common import below, row_keys, stored, table
from cohortmart.llm.components import connected_components, fewer_edges

COSINE = 0.9
#: Pivots of a permutation, those whose lists a vector is entered in, and those that candidates share: the first of these that
#: finds TARGET of PLANTED pairs, each of a vector of a sample and a partner at the threshold.
SHAPES = ((8, 4, 3), (8, 4, 2), (8, 6, 2), (8, 8, 2), (12, 8, 2), (16, 12, 2), (24, 16, 3), (48, 32, 3))
TARGET, PLANTED = 0.96, 2_000
#: Reference points for each vector length: so many times the root of the number of vectors, within bounds, picked from a hash
#: sample of CHOICE times as many; none is closer to another than SPREAD.
PIVOT_FACTOR, PIVOTS_LEAST, PIVOTS_MOST, CHOICE, SPREAD = 4.0, 32, 16_384, 2, 0.6
#: Numbers of all reference points together, at most: 32 MB that are broadcast.
PIVOT_NUMBERS = 1 << 22
#: Vector lengths that have pivots, the most frequent ones; vectors of another length share one list.
LENGTHS = 4_096
BLOCK = 1024


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. Scaled by their largest component first, so that no square is lost or too large."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def pick_pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Unit rows for each length of vectors (vec, k1). The driver gets a count for each length and the bounded samples.

    A length too rare for a reference point of its own within the bounds has none: its vectors share one list.
    """
    sizes = {r["length"]: r["n"] for r in vectors.groupBy(F.size("vec").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").limit(LENGTHS).collect()}
    wanted = {k: int(min(n, PIVOTS_MOST, max(PIVOTS_LEAST, PIVOT_FACTOR * n**0.5))) for k, n in sizes.items()}
    shrink = min(1.0, PIVOT_NUMBERS / max(1, sum(CHOICE * k * n for k, n in wanted.items())))
    wanted = {k: int(n * shrink) for k, n in wanted.items() if int(n * shrink)}
    if not wanted:
        return {}
    part = F.create_map(*[F.lit(x) for k, n in wanted.items() for x in (k, min(1.0, CHOICE * n / sizes[k]))])
    rows = vectors.where(below(F.col("k1"), F.coalesce(part[F.size("vec")], F.lit(0.0)))).select("k1", "vec").collect()
    found: dict[int, np.ndarray] = {}
    kept = dict.fromkeys(wanted, 0)
    for r in sorted(rows, key=lambda r: r["k1"]):
        unit = _units(np.array([r["vec"]], float))[0]
        n = len(unit)
        own = found.setdefault(n, np.empty((wanted[n], n)))
        if kept[n] < wanted[n] and (not kept[n] or (own[: kept[n]] @ unit).max() < SPREAD):
            own[kept[n]] = unit
            kept[n] += 1
    return {k: v[: kept[k]] for k, v in found.items()}


def _nearest(units: np.ndarray, pivots: np.ndarray, most: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first; pivots as near are in the order of their numbers."""
    like = units @ pivots.T
    most = min(most, like.shape[1])
    near = np.sort(np.argpartition(-like, most - 1, axis=1)[:, :most], axis=1)
    return np.take_along_axis(near, np.argsort(-np.take_along_axis(like, near, 1), axis=1, kind="stable"), 1)


def planted_recall(pivots: np.ndarray, vectors: np.ndarray, shape: tuple[int, int, int], cosine: float, pairs: int = PLANTED) -> float:
    """The share of pairs at the threshold that the shape makes candidates: vectors, and partners of them in random directions."""
    rng = np.random.default_rng(11)
    nearest, listed, shared = shape
    if vectors.shape[1] < 2 or not len(vectors):
        return 1.0
    met = []
    for at in range(0, pairs, 500):
        x = vectors[(at + np.arange(min(500, pairs - at))) % len(vectors)]
        side = rng.standard_normal(x.shape)
        side -= (side * x).sum(axis=1, keepdims=True) * x
        a, b = _nearest(x, pivots, nearest), _nearest(cosine * x + (1 - cosine**2) ** 0.5 * _units(side), pivots, nearest)
        common = (a[:, :, None] == b[:, None, :]).sum(axis=(1, 2)) >= min(shared, a.shape[1])
        met.append(common & (a[:, :listed, None] == b[:, None, :listed]).any(axis=(1, 2)))
    return float(np.concatenate(met).mean())


def pick_shape(vectors: DataFrame, pivots: dict[int, np.ndarray], cosine: float = COSINE) -> tuple[int, int, int]:
    """The first of SHAPES that reaches TARGET; the last where none does. The pairs are planted at about PLANTED / 4 vectors of
    a hash sample of its own, of lengths that have pivots."""
    large = [n for n, p in pivots.items() if len(p) > 1]
    if not large:
        return SHAPES[0]
    own = vectors.where(F.size("vec").isin(large))
    part = min(1.0, PLANTED / 4 / max(1, own.count()))
    rows = [r["vec"] for r in own.where(below(F.col("k2"), part)).select("vec").collect()]
    some = {n: _units(np.array([v for v in rows if len(v) == n], float)) for n in {len(v) for v in rows}}
    return next((s for s in SHAPES if all(planted_recall(pivots[n], x, s, cosine) >= TARGET for n, x in some.items())), SHAPES[-1])


def _vectors(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All components of all rows, and where each row starts (with the end)."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(flat.offsets.to_numpy())
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def describe(vectors: DataFrame, pivots: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """node, permutation: the numbers of the nearest pivots, nearest first. Pivots of all lengths are numbered together; a
    vector whose length has none has a permutation of one number of its own, below 0."""
    first, number = {}, 0
    for length in sorted(pivots):
        first[length], number = number, number + len(pivots[length])
    shared = vectors.sparkSession.sparkContext.broadcast((pivots, first))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, begin = shared.value
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                flat, cuts = _vectors(part.column(1))
                lengths = np.diff(cuts)
                out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(part)
                for n in np.unique(lengths):
                    mine = np.flatnonzero(lengths == n)
                    if n not in points:
                        for k in mine:
                            out[k] = np.array([-1 - n], np.int32)
                        continue
                    units = _units(np.stack([flat[cuts[k] : cuts[k + 1]] for k in mine]))
                    for k, row in zip(mine, _nearest(units, points[n], nearest) + begin[n], strict=True):
                        out[k] = row.astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.list_(pa.int32()))], names=["node", "permutation"])

    return vectors.select("node", "vec").mapInArrow(run, "node long, permutation array<int>")


def _verify(cosine: float, n_listed: int, n_shared: int):
    """For each member of a list, the weight of its links and an edge of a spanning forest. A pair is taken in one list only:
    that of the first pivot, by number, in whose lists both are."""

    def fn(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, weight, key = (t.column(c).to_numpy() for c in ("node", "copies", "list"))
        blocks = [t.column(c).to_numpy() for c in ("first", "second", "mine")]
        ranks, cuts = _vectors(t.column("permutation"))
        # All vectors of a list have one length and so permutations of one size.
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            near = ranks[cuts[s] : cuts[e]].astype(np.int64).reshape(e - s, -1)
            x = _units(np.stack(t.column("vec").slice(s, e - s).to_pylist()).astype(float))
            listed, least = near[:, :n_listed], min(n_shared, near.shape[1])
            links, label = np.zeros(e - s, np.int64), np.arange(e - s)
            for a, b in expand(*pair_ranges(np.array([0, e - s]), *(c[s:e] for c in blocks)), 1 << 16):
                both = np.where((listed[a][:, :, None] == listed[b][:, None, :]).any(axis=2), listed[a], np.iinfo(np.int64).max)
                own = both.min(axis=1) == key[s]
                a, b = a[own], b[own]
                candidates = (near[a][:, :, None] == near[b][:, None, :]).sum(axis=(1, 2)) >= least
                a, b = a[candidates], b[candidates]
                alike = np.einsum("ij,ij->i", x[a], x[b]) >= cosine
                a, b = a[alike], b[alike]
                if len(a):
                    links += np.bincount(a, weight[s + b], e - s).astype(np.int64) + np.bincount(b, weight[s + a], e - s).astype(np.int64)
                    joined = np.flatnonzero(label != np.arange(e - s))
                    label = forest(e - s, np.concatenate([joined, a]), np.concatenate([label[joined], b]))
            has = np.flatnonzero(links)
            if len(has):
                yield pa.RecordBatch.from_arrays([pa.array(ids[s + has]), pa.array(links[has]), pa.array(ids[s + label[has]])], names=["node", "links", "to"])

    return fn


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of vectors.

    Vectors that are null, empty or zero, or hold null or non-finite numbers, link with nothing, and so do vectors of different
    lengths. Equal vectors are one vector with copies. Ids are taken as distinct; rows that repeat an id count as copies or
    vectors like any other. Other columns are ignored. A list of any length is compared whole, in pairs of blocks; beyond
    PIVOTS_MOST reference points that work grows with the square of a list.
    """
    k1, k2 = row_keys("vec")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vec"))
    rows = rows.select("vec_id", "vec", k1.alias("k1"), k2.alias("k2"), usable(F.col("vec")).alias("good"))
    one = rows.where("good").groupBy("k1", "k2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.min("vec").alias("vec"))
    different = stored(one.select(F.monotonically_increasing_id().alias("node"), "*"), "pivot-vectors")
    pivots = pick_pivots(different)
    nearest, listed, shared = pick_shape(different, pivots, cosine)
    described = describe(different, pivots, nearest)
    entered = stored(different.select("node", "copies", "vec").join(described, "node"), "pivot-index")
    entries = entered.select("node", "copies", "vec", "permutation", F.explode(F.slice("permutation", 1, listed)).alias("list"))
    checked = stored(map_groups(block_pairs(entries, "list", "node", BLOCK), "list", "node", _verify(cosine, listed, shared), "node long, links long, to long"), "pivot-links")
    parts = connected_components(fewer_edges(checked, "node", "to"), "a", "b").select("node", F.col("component").alias("part"))
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    known = different.select("node", "k1", "k2", "least", "copies").join(links, "node", "left").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    known = stored(known.select("k1", "k2", "least", "part", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "pivot-known")
    components = known.groupBy("part").agg(F.min("least").alias("component_id"))
    linked = rows.where("good").select("vec_id", "k1", "k2").join(known.join(components, "part").select("k1", "k2", "n_links", "component_id"), ["k1", "k2"])
    others = rows.where("NOT good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = stored(linked.select("vec_id", "n_links", "component_id").unionByName(others), "pivot-found")
    return found.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: All pairs of usable vectors of one length, and the closure of the links.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
  AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
l AS (SELECT a.vec_id, b.vec_id AS other FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
r AS (SELECT vec_id, other FROM l UNION SELECT r.vec_id, l.other FROM r JOIN l ON r.other = l.vec_id),
c AS (SELECT vec_id, min(other) AS least FROM r GROUP BY vec_id),
n AS (SELECT vec_id, count(*) AS n FROM l GROUP BY vec_id)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, least(e.vec_id, coalesce(c.least, e.vec_id)) AS component_id, e.vec_id <= coalesce(c.least, e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON e.vec_id = c.vec_id LEFT JOIN n ON e.vec_id = n.vec_id
"""
