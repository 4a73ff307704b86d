"""Toxicity: two Kneser-Ney models of characters, one for each class, with shared backoff counts.

A text is read as a run of lower-case words, each with its characters from a start mark to an end mark. Most words of a toxic
text are ordinary ones: its model takes each word from the ordinary model, and now and then, with chance RATE, from the
toxic one. What decides is the difference of that model's log-likelihood and the ordinary one's for each word. Only the counts
of the longest n-grams belong to a class. Both classes back off to one model of the counts of both together, interpolated
with its continuation counts, so a rare expression that neither class knows is judged alike by both. A word that a text has had
before says less: its r-th occurrence counts 1/r. A logistic curve, fitted on other labelled rows than those counted,
turns the difference into a probability.

Counts are of all training rows. They, the gains and the backoffs are tables. Tables of a checked size are broadcast for
scoring, larger ones are joined to the different n-grams of chunks of texts. Only the curve is fitted on a bounded sample.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortmart.llm.common import below, fresh, share, stored, table
from cohortmart.llm.ngrams import HashTable, code_points, mix, pieces

ORDER = 5
DISCOUNT = 0.75
#: Of the counts of a class: what it has seen once is as good as unseen.
CLASS_DISCOUNT = 1.0
#: The share of a toxic text's words that the toxic model stands for.
RATE = 0.01
#: Differences are taken on a logarithmic scale from the least one possible on, which this stands for.
LEAST = 1e-3
LOWEST = float(np.log(LEAST))
#: Labelled rows of each class that the logistic curve is fitted on: about so many at most, of one of the folds.
LEARN_ROWS = 2_000
FOLDS = 4
#: Model tables of so many rows together at most are broadcast (12 bytes each), larger ones are joined.
MODEL_ROWS = 4_000_000
#: Texts, and their characters, that are scored together where the model is joined, about.
CHUNK_ROWS, CHUNK_CHARS = 1_000, 1 << 22
#: N-grams that a counting task keeps before it gives them on.
TASK_GRAMS = 3_000_000
WORD = re.compile(r"[^\W_]+")
START, END = "\x02", "\x03"
#: Counts of n-grams: of ordinary and toxic rows, each of the first fold and of the others.
COUNTS = ("n0_first", "n0_rest", "n1_first", "n1_rest")
#: The models: without the rows of the first fold, and of all rows.
HELD, WHOLE = 0, 1


def running(text: str | None) -> str:
    """The text as it is modelled: lower-case words of letters and digits, an end mark after each."""
    return "".join([w + END for w in WORD.findall((text or "").lower())]) or END


def places(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The place of each character in its word; the end mark is the last one of a word. A part of a text begins a word."""
    begins = np.zeros(len(points), bool)
    begins[cuts[:-1]] = True
    begins[1:] |= points[:-1] == ord(END)
    at = np.arange(len(points))
    return at - np.maximum.accumulate(np.where(begins, at, 0))


def _seen(points: np.ndarray, place: np.ndarray, back: int) -> np.ndarray:
    """The character `back` before each one, the start mark beyond the word's beginning."""
    moved = np.concatenate([np.full(back, ord(START), points.dtype), points])[: len(points)]
    return np.where(place >= back, moved, ord(START))


def _hashes(points: np.ndarray, place: np.ndarray, skip: int = 0) -> np.ndarray:
    """64-bit hashes of the n-grams of ORDER that end at each character; with skip = 1, of their contexts."""
    h = np.zeros(len(points), np.uint64)
    for back in range(ORDER - 1, skip - 1, -1):
        h = h * np.uint64(0x100000001B3) + _seen(points, place, back).astype(np.uint64)
    return mix(h)


@dataclass
class ToxicityModel:
    """Tables of the n-grams known to either class; column k is of the model HELD or WHOLE."""

    gains: DataFrame  # key, g0, g1: log P(toxic) - log P(ordinary) of the longest n-grams, by hash
    backoffs: DataFrame  # key, g0, g1: log backoff weight of the longest contexts, toxic less ordinary
    rows: int
    slope: float = 0.0
    shift: float = 0.0


def features(texts: list[str | None], gains: HashTable, backoffs: HashTable) -> np.ndarray:
    """For each text, the difference of its log-likelihoods for each word, on a logarithmic scale.

    An n-gram unknown to both classes backs off to the same distribution in both, so only the weights of its context differ.
    A text is looked at whole, however long it is: its characters take some 60 bytes each meanwhile.
    """
    total, size = np.zeros(len(texts)), np.zeros(len(texts))
    for index, parts, _ in pieces([running(t) for t in texts], 0, whole=True):
        points, cuts = code_points(parts)
        place = places(points, cuts)
        gain, found = gains.get(_hashes(points, place))
        gain[~found] = backoffs.get(_hashes(points, place, 1)[~found])[0]
        begin = np.flatnonzero(place == 0)
        owner = np.searchsorted(cuts, begin, "right") - 1
        toxic_over_ordinary = np.exp(np.minimum(np.add.reduceat(gain.astype(float), begin), 50))
        name = np.add.reduceat(mix((points.astype(np.uint64) + np.uint64(1)) * (place.astype(np.uint64) + np.uint64(7))), begin)
        order = np.lexsort((name, owner))
        new = np.ones(len(begin), bool)
        new[1:] = (owner[order][1:] != owner[order][:-1]) | (name[order][1:] != name[order][:-1])
        at = np.arange(len(begin))
        counts = np.empty(len(begin))
        counts[order] = 1 / (1 + at - np.maximum.accumulate(np.where(new, at, 0)))
        first = np.searchsorted(owner, np.arange(len(parts)))
        np.add.at(total, index, np.add.reduceat(np.log(1 - RATE + RATE * toxic_over_ordinary) * counts, first))
        np.add.at(size, index, np.add.reduceat(counts, first))
    return np.log(LEAST + np.maximum(total / np.maximum(size, 1e-9) - np.log(1 - RATE), 0.0))


def _looked_up(model: ToxicityModel, k: int) -> list[HashTable]:
    out = []
    for rows in (model.gains, model.backoffs):
        found = rows.select("key", F.col(f"g{k}").cast("float").alias("g")).toArrow()
        out.append(HashTable(found.column("key").to_numpy().view(np.uint64), found.column("g").to_numpy()))
        del found
    pa.default_memory_pool().release_unused()
    return out


def _with_features(rows: DataFrame, text_col: str, model: ToxicityModel, k: int, fn: Callable[[pa.Table, np.ndarray], pa.Table], schema: object) -> DataFrame:
    """fn(some rows, their features) for all rows, by model k."""
    if model.rows <= MODEL_ROWS:
        shared = rows.sparkSession.sparkContext.broadcast(_looked_up(model, k))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, len(batch), 256):
                    t = pa.Table.from_batches([batch.slice(at, 256)])
                    yield from fn(t, features(t.column(text_col).to_pylist(), *shared.value)).to_batches()

        return rows.mapInArrow(run, schema)
    (chunk,) = fresh(rows, "chunk")
    schema_in = T.StructType([*rows.schema.fields, T.StructField(chunk, T.LongType())])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, n, size = TaskContext.get().partitionId() << 33, 0, 0
        for batch in batches:
            out = np.empty(len(batch), np.int64)
            for k, length in enumerate(pc.fill_null(pc.utf8_length(batch.column(text_col)), 0).to_pylist()):
                if n and (n >= CHUNK_ROWS or size + length > CHUNK_CHARS):
                    number, n, size = number + 1, 0, 0
                out[k], n, size = number, n + 1, size + length
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, chunk])

    chunked = stored(rows.mapInArrow(numbered, schema_in), "toxicity-texts")

    def different(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            texts = batch.column(1).to_pylist()
            for number in np.unique(numbers):
                for _, parts, _ in pieces([running(texts[j]) for j in np.flatnonzero(numbers == number)], 0, whole=True):
                    points, cuts = code_points(parts)
                    place = places(points, cuts)
                    for kind in (0, 1):
                        keys = np.unique(_hashes(points, place, kind)).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), number)), pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys)], names=["part", "kind", "key"])

    asked = stored(chunked.select(chunk, text_col).mapInArrow(different, "part long, kind int, key long").distinct(), "toxicity-asked")
    both = [asked.where(F.col("kind") == kind).join(of.select("key", F.col(f"g{k}").alias("g")), "key") for kind, of in enumerate((model.gains, model.backoffs))]

    def scored(t: pa.Table, known: pa.Table) -> pa.Table:
        tables = []
        for kind in (0, 1):
            mine = known.filter(pa.array(known.column("kind").to_numpy() == kind))
            tables.append(HashTable(mine.column("key").to_numpy().view(np.uint64), mine.column("g").to_numpy().astype(np.float32)))
        return fn(t, features(t.column(text_col).to_pylist(), *tables))

    return chunked.groupBy(chunk).cogroup(both[0].unionByName(both[1]).groupBy("part")).applyInArrow(scored, schema)


class _Counter:
    """Counts of n-grams by hash in COUNTS columns."""

    def __init__(self) -> None:
        self.keys, self.grams, self.counts = np.zeros(0, np.uint64), np.zeros(0, f"<U{ORDER}"), np.zeros((0, len(COUNTS)), np.int64)
        self.parts: list[tuple[np.ndarray, np.ndarray, int, np.ndarray]] = []
        self.waiting = 0

    def add(self, texts: list[str], column: int) -> None:
        for _, parts, _ in pieces([running(t) for t in texts], 0, whole=True):
            points, cuts = code_points(parts)
            place = places(points, cuts)
            keys, first, n = np.unique(_hashes(points, place), return_index=True, return_counts=True)
            shown = [_seen(points, place, back)[first] for back in range(ORDER - 1, -1, -1)]
            grams = np.stack(shown, axis=1).astype("<u4").view(f"<U{ORDER}")[:, 0]
            self.parts.append((keys, grams, column, n))
            self.waiting += len(keys)
            if self.waiting > TASK_GRAMS:
                self.merge()

    def merge(self) -> None:
        keys = np.concatenate([self.keys, *[p[0] for p in self.parts]])
        grams = np.concatenate([self.grams, *[p[1] for p in self.parts]])
        unique, first, place = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.zeros((len(unique), len(COUNTS)), np.int64)
        counts[place[: len(self.keys)]] = self.counts
        at = len(self.keys)
        for own, _, column, n in self.parts:
            counts[place[at : at + len(own)], column] += n
            at += len(own)
        self.keys, self.grams, self.counts, self.parts, self.waiting = unique, grams[first], counts, [], 0

    def taken(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for at in range(0, len(self.keys), 100_000):
            c = self.counts[at : at + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(self.grams[at : at + 100_000].tolist()), *[pa.array(c[:, j]) for j in range(len(COUNTS))]], names=["gram", *COUNTS])
        self.__init__()


def _gather(rows: DataFrame) -> DataFrame:
    """gram and COUNTS: how often each longest n-gram occurs in the rows (toxic, fold, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter()
        for batch in batches:
            column = batch.column(0).to_numpy() * 2 + (batch.column(1).to_numpy() != 0)
            texts = batch.column(2).to_pylist()
            for c in np.unique(column):
                counter.add([texts[j] for j in np.flatnonzero(column == c)], int(c))
            if len(counter.keys) > TASK_GRAMS:
                yield from counter.taken()
        yield from counter.taken()

    found = rows.select("toxic", "fold", "text").mapInArrow(count, "gram string, " + ", ".join(f"{c} long" for c in COUNTS))
    return found.groupBy("gram").agg(*[F.sum(c).alias(c) for c in COUNTS])


def _shared(grams: DataFrame) -> DataFrame:
    """gram, p of order ORDER - 1: interpolated continuation probabilities, both classes together.

    grams: the distinct longest n-grams. Each order is made from the distinct n-grams that are one longer, which stand for the
    different left extensions of their endings, and interpolated with the order below.
    """
    kinds: dict[int, DataFrame] = {}
    longer = grams.select("gram")
    for n in range(ORDER - 1, 0, -1):
        longer = kinds[n] = stored(longer.groupBy(F.right("gram", F.lit(n)).alias("gram")).agg(F.count("*").alias("n")), f"toxicity-kinds-{n}")
    found = None
    for n in range(1, ORDER):
        here = kinds[n].select("gram", "n", F.left("gram", F.lit(n - 1)).alias("context"), F.right("gram", F.lit(n - 1)).alias("ending"))
        totals = here.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        below_it = here.join(totals, "context")
        if found is None:
            below_it = below_it.withColumn("base", F.lit(1.0 / (kinds[1].count() + 1)))
        else:
            below_it = below_it.join(found.select(F.col("gram").alias("ending"), F.col("p").alias("base")), "ending")
        p = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total") + DISCOUNT * F.col("kinds") / F.col("total") * F.col("base")
        found = stored(below_it.select("gram", p.alias("p")), f"toxicity-shared-{n}")
    return found


def _by_hash(rows: DataFrame, n: int) -> DataFrame:
    """key instead of gram: the hash of its n characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = code_points(batch.column(0).to_pylist())[0].reshape(-1, n).astype(np.uint64)
            keys = np.zeros(len(points), np.uint64)
            for k in range(n):
                keys = keys * np.uint64(0x100000001B3) + points[:, k]
            keys = mix(keys)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), batch.column(1), batch.column(2)], names=["key", "g0", "g1"])

    return rows.select("gram", "g0", "g1").mapInArrow(run, "key long, g0 double, g1 double")


def fit_models(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The gains and backoffs of a ToxicityModel from the counts of all training rows: gram, COUNTS."""
    base = _shared(grams)
    models, each = (HELD, WHOLE), [(y, k) for y in (0, 1) for k in (HELD, WHOLE)]
    counts = [(F.col(f"n{y}_rest") + (F.col(f"n{y}_first") if k == WHOLE else 0)).alias(f"c{y}_{k}") for y, k in each]
    counted = grams.select("gram", F.left("gram", F.lit(ORDER - 1)).alias("context"), F.right("gram", F.lit(ORDER - 1)).alias("ending"), *counts)
    both = lambda k: F.col(f"c0_{k}") + F.col(f"c1_{k}")
    sums = [x for y, k in each for x in (F.sum(f"c{y}_{k}").alias(f"t{y}_{k}"), F.count_if(F.col(f"c{y}_{k}") > 0).alias(f"k{y}_{k}"))]
    sums += [F.count_if(both(k) > 0).alias(f"k_{k}") for k in models]
    weight = [F.when(F.col(f"t{y}_{k}") > 0, CLASS_DISCOUNT * F.col(f"k{y}_{k}") / F.col(f"t{y}_{k}")).otherwise(1.0).alias(f"w{y}_{k}") for y, k in each]
    contexts = stored(counted.groupBy("context").agg(*sums).select("context", *[f"t{y}_{k}" for y, k in each], *[f"k_{k}" for k in models], *weight), "toxicity-contexts")
    known = counted.join(contexts, "context").join(base.select(F.col("gram").alias("ending"), "p"), "ending")

    def shared_p(k: int) -> Column:
        seen = F.col(f"t0_{k}") + F.col(f"t1_{k}")
        p = (F.greatest(both(k) - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col(f"k_{k}") * F.col("p")) / seen
        return F.when(seen > 0, p).otherwise(F.col("p"))

    def log_p(y: int, k: int) -> Column:
        own = F.greatest(F.col(f"c{y}_{k}") - CLASS_DISCOUNT, F.lit(0.0)) / F.greatest(F.col(f"t{y}_{k}"), F.lit(1))
        return F.log(own + F.col(f"w{y}_{k}") * shared_p(k) + 1e-12)

    gains = known.select("gram", *[(log_p(1, k) - log_p(0, k)).alias(f"g{k}") for k in (HELD, WHOLE)])
    backoffs = contexts.select(F.col("context").alias("gram"), *[(F.log(f"w1_{k}") - F.log(f"w0_{k}")).alias(f"g{k}") for k in (HELD, WHOLE)])
    return stored(_by_hash(gains, ORDER), "toxicity-gains"), stored(_by_hash(backoffs, ORDER - 1), "toxicity-backoffs")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * weight.sum() / len(weight) * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty
        step = np.linalg.solve(hessian, x.T @ (weight * (y - p)) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, learn_rows: int = LEARN_ROWS) -> ToxicityModel | None:
    """Counts all labelled rows (doc_id, text; doc_id, toxic) and fits the curve on a bounded sample of them.

    The sample is of the first fold, and is described by the model of the other folds, so that the curve sees texts as unknown
    ones look. An id with labels of both kinds is toxic. Labels other than 0 and 1 and rows without a text are left out.
    None where a class has no row in the first fold or none in the others.
    """
    marked = labels.where(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")
    ids = stored(marked.withColumn("fold", fold), "toxicity-ids")
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(ids, "doc_id")
    grams = stored(_gather(rows), "toxicity-grams")
    sums = grams.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS]).first()
    if not all(sums):
        return None
    gains, backoffs = fit_models(grams)
    model = ToxicityModel(gains, backoffs, gains.count() + backoffs.count())
    sizes = {r["toxic"]: r["n"] for r in ids.where("fold = 0").groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    part = F.when(F.col("toxic") == 1, min(1.0, learn_rows / sizes[1])).otherwise(min(1.0, learn_rows / sizes[0]))
    sample = rows.where("fold = 0").withColumn("part", part).where(below(F.col("doc_id"), F.col("part"))).select("text", "toxic", "part")

    def described(t: pa.Table, x: np.ndarray) -> pa.Table:
        return pa.table({"x": x, "toxic": t.column("toxic"), "part": t.column("part")})

    seen = _with_features(sample, "text", model, HELD, described, "x double, toxic int, part double").toArrow()
    x, y, taken = (seen.column(c).to_numpy().astype(float) for c in ("x", "toxic", "part"))
    order = np.lexsort((y, x))
    model.slope, model.shift = _logistic(x[order, None] - LOWEST, y[order], 1 / taken[order])
    return model


def score_docs(docs: DataFrame, model: ToxicityModel | None, text_col: str = "text", keep_text: bool = False, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """Adds the score and the prediction under `names`, from the text alone; without a model both are 0.

    Null and empty texts are scored too. Columns that have these names already are replaced.
    """
    kept = [c for c in docs.columns if (keep_text or c != text_col) and c not in names]
    cols = [F.col(f"`{c}`") for c in kept]
    if model is None:
        return docs.select(*cols, F.lit(0.0).alias(names[0]), F.lit(0).alias(names[1]))
    schema = docs.select(*cols).schema.add(names[0], "double").add(names[1], "integer")
    slope, shift = float(model.slope), float(model.shift)
    (own,) = fresh(docs, "scored")

    def score(t: pa.Table, x: np.ndarray) -> pa.Table:
        value = 1 / (1 + np.exp(-np.clip((x - LOWEST) * slope + shift, -30, 30)))
        return t.select(kept).append_column(names[0], pa.array(value)).append_column(names[1], pa.array((value >= 0.5).astype(np.int32)))

    return _with_features(docs.select(*cols, F.col(f"`{text_col}`").alias(own)), own, model, WHOLE, score, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are not predicted toxic, with their columns. Learns from the same rows as the query."""
    model = train(docs, labels.where(share(F.col("doc_id"), 5) != 0))
    names = fresh(docs, "toxicity_score", "toxicity_predicted")
    return score_docs(docs, model, keep_text=True, names=tuple(names)).where(F.col(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels").where(share(F.col("doc_id"), 5) != 0))
    held_out = share(F.col("doc_id"), 5) == 0
    return score_docs(docs.withColumn("held_out", held_out), model)
