"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmart.llm.common import below, fresh, share, stored, table
from cohortmart.llm.ngrams import code_points, mix, pieces

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
#: Labelled rows that are learned for each language: about so many at most, picked by a hash of the id.
LEARN_ROWS = 2_000
#: Languages of a matrix: it is broadcast, and has BUCKETS numbers of four bytes for each. More of them are scored one matrix
#: after the other.
LANGUAGES = 256
#: Labels whose numbers are broadcast to the rows that are counted, at most.
LABELS = 100_000
UNKNOWN = "und"


@dataclass
class LanguageModel:
    languages: list[str]
    log_prob: np.ndarray  # one row of BUCKETS log probabilities for each language
    log_prior: np.ndarray


def hashed_ngrams(points: np.ndarray) -> list[np.ndarray]:
    """For each order n, the buckets of the n-grams that end at position n - 1 and later."""
    x = points.astype(np.uint64)
    out, h = [], x
    for n in ORDERS:
        if n > 1:
            h = h[:-1] * np.uint64(0x100000001B3) + x[n - 1 :]
        out.append((mix(h + np.uint64(n)) & np.uint64(BUCKETS - 1)).astype(np.int32))
    return out


def ngrams_of(parts: list[str], known: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the index of the part and the bucket of each of its n-grams."""
    points, cuts = code_points(parts)
    owner = np.repeat(np.arange(len(parts), dtype=np.int32), np.diff(cuts))
    place = np.arange(len(points)) - cuts[:-1][owner]
    skip = np.asarray(known, np.int32)[owner]
    for n, h in zip(ORDERS, hashed_ngrams(points), strict=True):
        use = place[n - 1 :] >= np.maximum(n - 1, skip[n - 1 :])
        yield owner[n - 1 :][use], h[use]


@dataclass
class LanguageCounts:
    """The counts of more languages than a matrix has: a table of label (its number), bucket and n, and the labels in order."""

    languages: list[str]
    sizes: list[int]
    counted: DataFrame
    smooth: float

    def models(self) -> Iterator[LanguageModel]:
        """The models of LANGUAGES languages each, one after the other."""
        for at in range(0, len(self.languages), LANGUAGES):
            part = self.counted.where(F.col("label").between(at, at + LANGUAGES - 1)).select((F.col("label") - at).alias("label"), "bucket", "n").toArrow()
            yield _model(self.languages[at : at + LANGUAGES], self.sizes[at : at + LANGUAGES], sum(self.sizes), part, self.smooth)


def _model(languages: list[str], sizes: list[int], total: int, counted: pa.Table, smooth: float) -> LanguageModel:
    matrix = np.full((len(languages), BUCKETS), smooth, np.float32)
    matrix[counted["label"].to_numpy(), counted["bucket"].to_numpy()] += counted["n"].to_numpy()
    for row in matrix:  # in place: the matrix is the largest thing here
        np.log(row / row.sum(dtype=float), out=row)
    return LanguageModel(languages, matrix, np.log(np.array(sizes, float) / total))


def train(rows: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", learn_rows: int = LEARN_ROWS, smooth: float = 0.5) -> LanguageModel | LanguageCounts:
    """Counts n-grams of a bounded sample of the labelled rows, about `learn_rows` of each language.

    Rows with a null text or label are not learned. The driver gets a number for each label, and one count for each language and
    bucket of one matrix at a time; any number of labels is learned.
    """
    usable = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label"))
    usable = usable.where(F.col("text").isNotNull() & F.col("label").isNotNull())
    found = usable.groupBy("label").agg(F.count("*").alias("n"))
    sizes = {r["label"]: r["n"] for r in found.collect()}
    languages = sorted(sizes)
    if not sizes:
        return LanguageModel([], np.zeros((0, BUCKETS), np.float32), np.zeros(0))
    spark = rows.sparkSession
    number = spark.createDataFrame([(k, i, min(1.0, learn_rows / sizes[k])) for i, k in enumerate(languages)], "label string, number int, part double")
    sample = usable.join(F.broadcast(number) if len(languages) <= LABELS else number, "label").where(below(F.col("id"), F.col("part"))).select(F.col("number").alias("label"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}

        def given() -> Iterator[pa.RecordBatch]:
            for label, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), label, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["label", "bucket", "n"])
            sums.clear()

        for batch in batches:
            labels, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for label in np.unique(labels):
                total = sums.setdefault(int(label), np.zeros(BUCKETS, np.int64))
                for _, parts, known in pieces([texts[k].lower() for k in np.flatnonzero(labels == label)], max(ORDERS) - 1):
                    for _, h in ngrams_of(parts, known):
                        total += np.bincount(h, minlength=BUCKETS)
                if len(sums) > LANGUAGES:
                    yield from given()
        yield from given()

    counted = sample.mapInArrow(count, "label int, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    if len(languages) > LANGUAGES:
        return LanguageCounts(languages, [sizes[k] for k in languages], stored(counted, "language-counts"), smooth)
    return _model(languages, [sizes[k] for k in languages], sum(sizes.values()), counted.toArrow(), smooth)


def log_odds(model: LanguageModel, texts: list[str]) -> np.ndarray:
    """Log prior and likelihood of each language for each text."""
    total = np.tile(model.log_prior, (len(texts), 1))
    for index, parts, known in pieces([t.lower() for t in texts], max(ORDERS) - 1):
        at = np.asarray(index)
        for owner, h in ngrams_of(parts, known):
            # Sparse rows times matrix: every n-gram is one entry of its text's row, the products are summed by text.
            for k in range(len(model.languages)):
                np.add.at(total[:, k], at, np.bincount(owner, model.log_prob[k][h], minlength=len(parts)))
    return total


def score_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and its posterior probability for each text; UNKNOWN and 0 for null texts and texts without a letter."""
    given = [t or "" for t in texts]
    total = log_odds(model, given)
    if not model.languages:
        return [UNKNOWN] * len(given), np.zeros(len(given))
    odds = np.exp(total - total.max(axis=1, keepdims=True))
    best = total.argmax(axis=1)
    score = odds[np.arange(len(given)), best] / odds.sum(axis=1)
    known_text = np.array([any(map(str.isalpha, t)) for t in given], bool)
    return [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, known_text, strict=True)], np.where(known_text, score, 0.0)


def _identify_by_parts(docs: DataFrame, counts: LanguageCounts, text_col: str) -> DataFrame:
    """identify() with one matrix after the other: the best language so far, its log odds and the sum of all odds relative to
    them go along with each text."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c != text_col and c not in ("lang_pred", "score")]
    given, best, top, mass = fresh(docs, "given_text", "best_lang", "top_odds", "mass")
    now = docs.select(*kept, F.col(f"`{text_col}`").alias(given), F.lit(UNKNOWN).alias(best), F.lit(float("-inf")).alias(top), F.lit(0.0).alias(mass))
    spark = docs.sparkSession
    for model in counts.models():
        shared = spark.sparkContext.broadcast(model)

        def score(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                old = batch.column(top).to_numpy()
                total = log_odds(shared.value, [t or "" for t in batch.column(given).to_pylist()])
                high = np.maximum(old, total.max(axis=1))
                sums = batch.column(mass).to_numpy() * np.exp(old - high) + np.exp(total - high[:, None]).sum(axis=1)
                names = [shared.value.languages[k] if new > was else name for k, new, was, name in zip(total.argmax(axis=1), total.max(axis=1), old, batch.column(best).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(names, pa.string()), pa.array(high), pa.array(sums)], names=batch.schema.names)

        now = stored(now.mapInArrow(score, now.schema), "language-best")
        shared.unpersist()
    letters = F.coalesce(F.col(given), F.lit("")).rlike(r"\p{L}")
    return now.select(*kept, F.when(letters, F.col(best)).otherwise(UNKNOWN).alias("lang_pred"), F.when(letters, 1 / F.col(mass)).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, model: LanguageModel | LanguageCounts, text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score, from the text alone. Texts of any length; the text column itself is dropped. With more languages
    than a matrix has, the texts are scored and written once for each matrix."""
    if isinstance(model, LanguageCounts):
        return _identify_by_parts(docs, model, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != text_col and c not in ("lang_pred", "score")]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("lang_pred", "string").add("score", "double")

    (given,) = fresh(docs, "given_text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, value = score_texts(shared.value, batch.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(lang, pa.string()), pa.array(value)], names=[*kept, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(given)).mapInArrow(score, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = share(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out).select("doc_id", "text", "lang"))
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), model)
