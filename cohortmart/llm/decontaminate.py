"""Benchmark decontamination: short test items are found inside long documents by MinHash containment search.

Items are parted by size. Each has a MinHash sketch, the smallest hashed shingles, whose length depends on its part. A
document holds an item at the threshold only if enough of the sketch occurs among the document's shingles; such pairs
are verified by the exact containment of the item's shingles. An item of one to four words is one shingle of all of them.
All of it are DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmart.llm.common import SPACE, fresh, stored, table

SHINGLE = 5
CONTAINMENT = 0.8
#: Sketch length of items of up to so many shingles; longer items take the last one.
SKETCHES = ((16, 8), (64, 16), (None, 24))
#: Candidate documents up to so many are broadcast, and only their shingles are verified; beyond, those of all documents are.
CANDIDATES = 1_000_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), lambda w: w != "")


def _shingles(words: Column, made: Callable[[list[Column]], Column], kind: str, n: int) -> Column:
    """One value for each word n-gram in order; empty for fewer words."""
    places = F.sequence(F.lit(1), F.size(words) - (n - 1))
    each = F.transform(places, lambda i: made([F.get(words, i + (k - 1)) for k in range(n)]))
    return F.when(F.size(words) >= n, each).otherwise(F.array().cast(f"array<{kind}>"))


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    """64-bit hashes of the word n-grams, for the search."""
    return _shingles(words, lambda w: F.xxhash64(*w), "bigint", n)


def shingle_ids(words: Column, n: int = SHINGLE) -> Column:
    """Two independent hashes of each word n-gram, 128 bits together: its identity when items are verified."""
    return _shingles(words, lambda w: F.struct(F.xxhash64(*w).alias("a"), F.xxhash64(F.lit("id"), *w).alias("b")), "struct<a:bigint,b:bigint>", n)


def _of_item(made: Callable[[Column, int], Column], words: Column) -> Column:
    """The shingles of an item, or its only one if it has fewer words than a shingle."""
    out = made(words, SHINGLE)
    for n in range(1, SHINGLE):
        out = F.when(F.size(words) == n, made(words, n)).otherwise(out)
    return out


def _sketch_length(n: Column) -> Column:
    out = F.lit(SKETCHES[-1][1])
    for most, k in reversed(SKETCHES[:-1]):
        out = F.when(n <= most, k).otherwise(out)
    return out


def item_sketches(items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """item_id, text -> item, item_id, words, length (words of a shingle), n (distinct shingles), need, sketch.

    At most n - ceil(containment * n) shingles of a held item are missing, so as many of the sketch at most; `need` is
    what must then be there, or for large items a quarter of the sketch, which a held item has but for a chance of about 1e-6.
    Items without a word are never found. Repeated items count once; item is a hash of both columns.
    """
    split = items.select("item_id", "text").distinct().withColumn("words", _words(F.col("text")))
    hashed = split.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "words", F.array_sort(F.array_distinct(_of_item(shingle_hashes, F.col("words")))).alias("all"))
    n = F.size("all")
    k = F.least(n, _sketch_length(n))
    spare = n - F.ceil(n * F.lit(containment) - F.lit(1e-9))
    return hashed.where(n > 0).select(
        "item", "item_id", "words", F.least(F.size("words"), F.lit(SHINGLE)).alias("length"), n.alias("n"), F.greatest(k - spare, F.ceil(k / 4), F.lit(1)).cast("int").alias("need"), F.slice("all", F.lit(1), k).alias("sketch")
    )


def contained_items(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, doc_key, item_id, containment: each document with each item of which it holds that share of shingles.

    Words are lower-case and parted by white space. Null texts hold nothing. Repeated rows of a document count once;
    doc_key is a hash of id and text that tells documents apart that share an id.
    """
    sketches = stored(item_sketches(items, containment), "bench-sketches")
    lengths = sorted(r["length"] for r in sketches.select("length").distinct().collect()) or [SHINGLE]  # five at most
    wanted = sketches.select("item", "need", F.explode("sketch").alias("shingle"))
    # The words are a column of their own first: the shingles look at them again and again.
    texts = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), _words(F.col("text")).alias("words"))
    each = texts.select("doc_key", F.explode(F.concat(*[shingle_hashes(F.col("words"), n) for n in lengths])).alias("shingle"))
    hits = each.join(wanted, "shingle").groupBy("doc_key", "item", "need").agg(F.count_distinct("shingle").alias("hits"))
    found = stored(hits.where("hits >= need").select("doc_key", "item"), "bench-candidates")
    # Only items that were found anywhere are verified, and texts never leave their tasks.
    asked = sketches.join(found.select("item").distinct(), "item", "left_semi").select("item", "item_id", F.explode(F.array_distinct(_of_item(shingle_ids, F.col("words")))).alias("id"), "n")
    keys = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("doc_key"), "text")
    if found.count() <= CANDIDATES:
        keys = keys.join(F.broadcast(found.select("doc_key").distinct()), "doc_key", "left_semi")
    candidates = keys.select("doc_id", "doc_key", _words(F.col("text")).alias("words"))
    exact = candidates.select("doc_id", "doc_key", F.explode(F.concat(*[shingle_ids(F.col("words"), n) for n in lengths])).alias("id")).join(asked, "id")
    held = exact.groupBy("doc_id", "doc_key", "item", "item_id", "n").agg(F.count_distinct("id").alias("k")).where(F.col("k") / F.col("n") >= containment)
    return held.join(found, ["doc_key", "item"], "left_semi").select("doc_id", "doc_key", "item_id", (F.col("k") / F.col("n")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Documents that hold no item, with their columns."""
    (key,) = fresh(docs, "doc_key")
    held = contained_items(docs, items, containment).select(F.col("doc_key").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    return keyed.join(held, key, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contained_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "containment")


ORACLE = """
WITH b AS (SELECT DISTINCT item_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM benchmark),
bk AS (SELECT *, least(5, len(w)) AS k FROM b WHERE len(w) > 0),
bs AS (SELECT item_id, text, k, list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM bk),
d AS (SELECT DISTINCT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
dk AS (SELECT d.*, k FROM d, (SELECT DISTINCT k FROM bs) WHERE len(w) >= k),
ds AS (SELECT doc_id, text, unnest(list_distinct(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))) AS s FROM dk),
bx AS (SELECT item_id, text AS item_text, len(s) AS n, unnest(s) AS s FROM bs),
hits AS (SELECT ds.doc_id, ds.text, bx.item_id, bx.item_text, bx.n, count(*) AS k FROM bx JOIN ds ON bx.s = ds.s GROUP BY ALL)
SELECT doc_id, item_id, CAST(k AS DOUBLE) / n AS containment FROM hits WHERE CAST(k AS DOUBLE) / n >= 0.8
"""
