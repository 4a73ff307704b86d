"""Quality classifier: nearest labelled texts in a latent semantic space vote, weighted by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortmart.llm.common import below, fresh, share, table
from cohortmart.llm.ngrams import code_points, mix, pieces

ORDERS = (1, 2, 3)
#: Terms are hashed: a text is a row of so many counts, the latent space is broadcast as a matrix of that height.
BUCKETS = 1 << 14
#: Dimensions of the latent space.
DIMENSIONS = 64
#: Labelled texts of each class that are learned, about, picked by a hash of the id; they are broadcast as vectors.
LEARN_ROWS = 1_000
#: Nearest labelled texts that vote, and the power of their cosine that weighs them.
NEIGHBOURS, POWER = 15, 4
#: Texts whose counts and products are in memory at once.
BLOCK = 256
#: A part of a long text begins so many characters early, so that words and n-grams across the cut are seen whole.
OVERLAP = 256


def _kinds() -> np.ndarray:
    """Kind of each character below 256: 1 for small letters, 2 for large ones, 3 for digits, else the character itself and 8."""
    at = np.arange(256)
    lower = (at >= 97) & (at <= 122) | (at >= 0xDF)
    upper = (at >= 65) & (at <= 90) | (at >= 0xC0) & (at <= 0xDE)
    return np.where(lower, 1, np.where(upper, 2, np.where((at >= 48) & (at <= 57), 3, at + 8))).astype(np.int64)


KINDS, OTHER = _kinds(), 4


def _word_terms(points: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """End place and hash of the terms that tell a word's form, and of those of two neighbouring forms.

    The form is the kind of its first and last character, whether its letters are all large, and whether it repeats the word
    before it.
    """
    inside = (points > 32) | (points < 9) | ((points > 13) & (points < 32))
    edge = np.diff(owner, prepend=-1) != 0
    starts = inside.copy()
    starts[1:] &= edge[1:] | ~inside[:-1]
    first = np.flatnonzero(starts)
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    ends = inside.copy()
    ends[:-1] &= edge[1:] | ~inside[1:]
    last = np.flatnonzero(ends)
    # Words are the same if a hash of their characters and of their order is.
    sums = np.cumsum(mix(points.astype(np.uint64)))
    ordered = np.cumsum(mix(points.astype(np.uint64) + np.uint64(1 << 40)) * np.arange(1, len(points) + 1, dtype=np.uint64))
    one = mix(points.astype(np.uint64) + np.uint64(1 << 40))
    total = np.cumsum(one)
    before = first - 1
    zero = np.uint64(0)
    plain = sums[last] - np.where(before >= 0, sums[before], zero)
    moved = ordered[last] - np.where(before >= 0, ordered[before], zero) - (total[last] - np.where(before >= 0, total[before], zero)) * first.astype(np.uint64)
    of = owner[first]
    same = np.append(False, (plain[1:] == plain[:-1]) & (moved[1:] == moved[:-1]) & (of[1:] == of[:-1]))
    kind = np.where(points < 256, KINDS[np.minimum(points, 255)], OTHER)
    lower, upper = np.cumsum(kind == 1), np.cumsum(kind == 2)

    def count(sums: np.ndarray) -> np.ndarray:
        return sums[last] - np.where(before >= 0, sums[before], 0)

    form = ((kind[first] * 512 + kind[last]) * 2 + ((count(lower) == 0) & (count(upper) > 0))) * 2 + same
    pair = np.flatnonzero(of[1:] == of[:-1]) + 1
    one = mix(form.astype(np.uint64) + np.uint64(7 << 40))
    two = mix(form[pair].astype(np.uint64) * np.uint64(1 << 22) + form[pair - 1].astype(np.uint64) + np.uint64(9 << 50))
    return np.append(last, last[pair]), np.append(one, two)


def term_counts(texts: list[str]) -> np.ndarray:
    """One row of BUCKETS counts for each text: character n-grams, forms of words, and pairs of forms."""
    out = np.zeros((len(texts), BUCKETS), np.int32)
    mask = np.uint64(BUCKETS - 1)
    left = [len(t) for t in texts]
    for index, parts, known in pieces(texts, OVERLAP):
        for k, part, skip in zip(index, parts, known, strict=True):
            left[k] -= len(part) - skip
        points, cuts = code_points(parts)
        owner = np.repeat(np.arange(len(parts), dtype=np.int64), np.diff(cuts))
        start = np.asarray(known, np.int64) + cuts[:-1]
        cell = owner * BUCKETS
        x = points.astype(np.uint64)
        found, h = [], x
        for n in ORDERS:
            if n > 1:
                h = h[:-1] * np.uint64(0x100000001B3) + x[n - 1 :]
            end = np.arange(n - 1, len(x))
            use = end >= np.maximum(cuts[:-1] + n - 1, start)[owner[n - 1 :]]
            found.append((cell[n - 1 :] + (mix(h + np.uint64(n)) & mask).astype(np.int64))[use])
        end, term = _word_terms(points, owner)
        # A word counts in the part that has the place behind it; the text's end is one.
        behind = cuts[1:] + np.array([left[k] == 0 for k in index], np.int64)
        use = (end + 1 >= start[owner[end]] + (start == cuts[:-1])[owner[end]]) & (end + 1 < behind[owner[end]])
        found.append((cell[end] + (term & mask).astype(np.int64))[use])
        out[index] += np.bincount(np.concatenate(found), minlength=len(parts) * BUCKETS).astype(np.int32).reshape(len(parts), BUCKETS)
    return out


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1 (0 for empty texts): logarithms of the counts times the terms' weights."""
    out = LOGS[np.minimum(counts, len(LOGS) - 1)] * idf
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


LOGS = np.log1p(np.arange(1 << 16)).astype(np.float32)


@dataclass
class QualityModel:
    idf: np.ndarray
    space: np.ndarray  # BUCKETS x DIMENSIONS
    vectors: np.ndarray  # a row of length 1 for each learned text that has terms
    labels: np.ndarray
    weights: np.ndarray  # of a text's vote: all texts of a class together weigh 1
    empty_score: float


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """log((1 + texts) / (1 + texts with the term)) for each bucket, over all texts; tasks send one number for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen = 0, np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                texts = [t or "" for t in batch.column(0).slice(at, BLOCK).to_pylist()]
                n += len(texts)
                seen += (term_counts(texts) > 0).sum(axis=0)
        at = np.append(-1, np.flatnonzero(seen))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(n, seen[at[1:]]))], names=["bucket", "n"])

    counted = docs.select(text_col).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(BUCKETS + 1, np.int64)
    sums[counted["bucket"].to_numpy()] = counted["n"].to_numpy()  # the last entry, -1, is the number of texts
    return np.log((1.0 + sums[-1]) / (1.0 + sums[:-1])).astype(np.float32)


def learned_counts(docs: DataFrame, labels: DataFrame, text_col: str, id_col: str, label_col: str, learn_rows: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Labels, and buckets and counts of the terms, of about `learn_rows` labelled texts of each class, in the order of their ids."""
    usable = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    sizes = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).collect()}
    wanted = F.when(F.col("label") == 1, min(1.0, learn_rows / max(1, sizes.get(1, 0)))).otherwise(min(1.0, learn_rows / max(1, sizes.get(0, 0))))
    chosen = usable.where(below(F.col("id"), wanted))
    # A few thousand ids and labels go to the texts; only if ids repeat so often that it isn't so, the texts are shuffled.
    few = chosen.count() <= 8 * learn_rows
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen) if few else chosen, "id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), BLOCK):
                part = batch.slice(at, BLOCK)
                rows = term_counts([t or "" for t in part.column(2).to_pylist()])
                used = [np.flatnonzero(r) for r in rows]
                packed = [[u.astype("<u2").tobytes() for u in used], [r[u].astype("<i4").tobytes() for r, u in zip(rows, used, strict=True)]]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(x, pa.binary()) for x in packed]], names=["id", "label", "buckets", "n"])

    kind = sample.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("label", T.IntegerType()), T.StructField("buckets", T.BinaryType()), T.StructField("n", T.BinaryType())])
    got = sample.select("id", "label", "text").mapInArrow(count, schema).toArrow().sort_by([("id", "ascending"), ("label", "ascending"), ("n", "ascending")])
    counts = [(np.frombuffer(b.as_py(), "<u2"), np.frombuffer(n.as_py(), "<i4")) for b, n in zip(got["buckets"], got["n"], strict=True)]
    return got["label"].to_numpy().astype(np.int64), counts


def latent_space(rows: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The leading right singular vectors of the rows, by subspace iteration from a fixed start."""
    width = min(dimensions + 16, *rows.shape)
    found = rows @ np.random.default_rng(0).standard_normal((rows.shape[1], width)).astype(np.float32)
    for _ in range(4):
        base, _ = np.linalg.qr(found)
        found = rows @ (rows.T @ base)
    base, _ = np.linalg.qr(found)
    return np.linalg.svd(base.T @ rows, full_matrices=False)[2][:dimensions].T


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality", learn_rows: int = LEARN_ROWS) -> QualityModel:
    """Term weights from all of `docs`, the latent space and its labelled vectors from a bounded sample of the labelled ones.

    Labels other than 0 and 1 are not learned. The driver holds some 2 * learn_rows rows of BUCKETS numbers of four bytes.
    """
    idf = inverse_frequencies(docs, text_col)
    label, counts = learned_counts(docs, labels, text_col, id_col, label_col, learn_rows)
    filled = np.array([len(b) > 0 for b, _ in counts], bool)
    prior = (label.sum() + 0.5) / (len(label) + 1)
    empty_score = float((label[~filled].sum() + prior) / ((~filled).sum() + 1))
    label, rows = label[filled], np.zeros((int(filled.sum()), BUCKETS), np.float32)
    for row, (buckets, n) in zip(rows, (c for c in counts if len(c[0])), strict=True):
        row[buckets] = LOGS[np.minimum(n, len(LOGS) - 1)] * idf[buckets]
        row /= max(np.linalg.norm(row), 1e-12)
    space = latent_space(rows) if len(rows) else np.zeros((BUCKETS, 1), np.float32)
    sizes = np.bincount(label, minlength=2)
    return QualityModel(idf, space, _unit(rows @ space), label, 1.0 / np.maximum(1, sizes)[label], empty_score)


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def score_texts(model: QualityModel, texts: list[str | None], neighbours: int = NEIGHBOURS, power: float = POWER) -> np.ndarray:
    """For each text, the share of label 1 in the votes of its nearest labelled texts; what is as near as the last one votes
    too. Texts without terms get the share of such texts learned."""
    given = [t or "" for t in texts]
    out = np.full(len(given), model.empty_score)
    if not len(model.labels):
        return out
    for at in range(0, len(given), BLOCK):
        counts = term_counts(given[at : at + BLOCK])
        cosine = _unit(weighted(counts, model.idf) @ model.space) @ model.vectors.T
        k = min(neighbours, cosine.shape[1])
        last = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, cosine.shape[1] - k, None]
        vote = np.where(cosine >= last, np.maximum(cosine, 1e-6).astype(np.float64) ** power, 0.0) * model.weights
        share_of_1 = (vote * model.labels).sum(axis=1) / vote.sum(axis=1)
        filled = counts.any(axis=1)
        out[at : at + BLOCK][filled] = share_of_1[filled]
    return out


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from a score of 0.5 on), from the text alone.

    Null texts are empty ones; repeated rows each get their score; columns of these names that are there already are replaced,
    the text column is dropped. Texts of any length count whole, a million characters at a time; only a word of more than 256
    characters that lies across such a cut counts from the cut's overlap on. Nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != text_col and c.lower() not in ("score", "predicted")]
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("score", "double").add("predicted", "integer")
    (given,) = fresh(docs, "given_text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = score_texts(shared.value, batch.column(len(kept)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(value), pa.array((value >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").alias(given)).mapInArrow(score, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = share(F.col("doc_id"), 3) == 1
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "quality")
    return score_quality(docs.select("doc_id", held_out.alias("held_out"), "text"), train(docs.select("doc_id", "text"), labels))
