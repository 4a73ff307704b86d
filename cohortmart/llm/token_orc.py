"""Token ids in ORC: stripes with run-length encoded integers, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortmart.llm.common import scratch_path, table

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
PUNCTUATION = b".,;:!?\"()[]{}|*#%$&-_=+/<>~^@"
#: Texts that hold these go to the tokenizer as a whole: the start of a special token's string, combining marks.
WHOLE = (b"<|", b"\xcc", b"\xcd")

TOKEN_SCHEMA = "doc_id long, part int, local_start long, ids array<int>"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Words of these letters, once in lower case, need no normalization: those of ASCII and the Latin ones up to U+00FF.
PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes are themselves, the others
    follow from U+0100 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Encodes texts with a tokenizer of the tokenizers library, each distinct word once.

    Fits byte-level tokenizers that drop white space and letter case: ids of a text are those of its words one after the
    other. Words of plain letters go to the tokenizer's model at once, all others through the whole tokenizer. When more than
    `limit` words are known, all but those of the last texts are forgotten, so memory is bounded.
    """

    def __init__(self, path: str, limit: int = 500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit = Tokenizer.from_file(path), limit
        self.model = self.tokenizer.model
        self.pieces = Tokenizer(self.model)
        self.pieces.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = np.arange(256, dtype="<u4")
        for byte, letter in byte_letters().items():
            self.letters[byte] = ord(letter) if byte >= 128 else byte
        suffix, tokens = getattr(self.model, "end_of_word_suffix", None), range(self.tokenizer.get_vocab_size())
        self.last = np.array([bool(suffix) and (self.tokenizer.id_to_token(k) or "").endswith(suffix) for k in tokens], bool)
        self.known, self.known_ids = pa.array([], pa.string()), pa.array([], pa.large_binary())

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words of plain letters, as one text of the model; where a word ends is told by its last token."""
        shown = self.letters[np.frombuffer(" ".join(words).encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.asarray(self.pieces.encode_batch_fast([shown], add_special_tokens=False)[0].ids, "<u4")
        ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
        if len(ends) != len(words):
            return [array("I", [t.id for t in self.model.tokenize(x)]).tobytes() for x in shown.split(" ")]
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def learn(self, missing: list[bytes]) -> list[bytes]:
        """Ids of each of those words."""
        cores = [word.rstrip(PUNCTUATION) for word in missing]
        low = b"\n".join(cores).decode().lower().split("\n")
        plain = list(dict.fromkeys(filter(PLAIN.fullmatch, low)))
        ids = dict(zip(plain, self._plain_ids(plain), strict=True)) if plain else {}
        signs: dict[bytes, bytes] = {}
        out = []
        for word, core, shown in zip(missing, cores, low, strict=True):
            own = ids.get(shown)
            # Only plain letters are sure to end where the punctuation begins: others may become a letter and a mark.
            if own is None:
                own = self._ids(word.decode())
            elif len(core) < len(word):
                after = word[len(core) :]
                if after not in signs:
                    signs[after] = self._ids(after.decode())
                own += signs[after]
            out.append(own)
        return out

    def _looked_up(self, words: pa.Array) -> pa.Array:
        """Ids of different words. Known ones are Arrow arrays, which take a fifth of a dictionary's memory."""
        at = pc.index_in(words, value_set=self.known)
        gaps = at.is_null()
        missing = words.filter(gaps)
        if len(missing):
            made = self.learn(missing.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist())
            places = at.fill_null(0).to_numpy().copy()
            places[gaps.to_numpy(zero_copy_only=False)] = np.arange(len(self.known), len(self.known) + len(missing))
            at = pa.array(places)
            self.known = pa.concat_arrays([self.known, missing])
            self.known_ids = pa.concat_arrays([self.known_ids, pa.array(made, pa.large_binary())])
        ids = self.known_ids.take(at)
        if len(self.known) > self.limit:
            self.known, self.known_ids = words, ids
        return ids

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (strings without nulls) one after the other and the number of each text's.

        Words are told apart by Arrow, so only different ones of these texts are looked up.
        """
        lo, hi = np.frombuffer(texts.buffers()[1], np.int32)[[texts.offset, texts.offset + len(texts)]]
        blob = b"" if texts.buffers()[2] is None else memoryview(texts.buffers()[2])[lo:hi].tobytes()
        whole = np.zeros(len(texts), bool)
        for sign in WHOLE:
            if sign in blob:
                whole |= pc.match_substring(texts.cast(pa.binary()), sign).to_numpy(zero_copy_only=False)
        split = pc.ascii_split_whitespace(pc.ascii_lower(pc.if_else(pa.array(whole), "", texts) if whole.any() else texts))
        words = split.flatten().dictionary_encode()
        ids = self._looked_up(words.dictionary).take(words.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1] // 4
        starts = split.offsets.to_numpy().astype(np.int64)
        cuts = ends[starts - starts[0]]
        values = np.frombuffer(ids.buffers()[2] or b"", "<u4")[: cuts[-1]]
        sizes = np.diff(cuts)
        if whole.any():
            own = {k: np.frombuffer(self._ids(texts[k].as_py()), "<u4") for k in np.flatnonzero(whole).tolist()}
            values = np.insert(values, np.repeat(cuts[list(own)], [len(x) for x in own.values()]), np.concatenate(list(own.values())))
            sizes[list(own)] = [len(x) for x in own.values()]
        return values, sizes

    def encode(self, raw: list[bytes]) -> list[bytes]:
        """Ids of each UTF-8 text as little-endian unsigned 32-bit integers."""
        values, sizes = self.encode_array(pa.array(raw, pa.binary()).cast(pa.string()))
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        return [values[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker and path."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def _runs(sizes: np.ndarray, most: int = 2_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` bytes together."""
    start, total = 0, 0
    for k, size in enumerate(sizes.tolist()):
        total += size
        if total >= most:
            yield start, k + 1
            start, total = k + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def token_rows(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """Token ids of each text with the end id appended, in ascending order of ids over the partitions.

    Null texts count as empty and have the end id only; rows without an id come first; rows of the same id are
    ordered by a hash of their text and then by the text. Other columns are ignored.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = pa.default_memory_pool()
        pool.release_unused()  # what earlier steps left in a worker that is used again
        part, before, enc = TaskContext.get().partitionId(), 0, encoder(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.string())
            for lo, hi in _runs(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)):
                values, sizes = enc.encode_array(pc.fill_null(texts.slice(lo, hi - lo), ""))
                values = np.insert(values, np.cumsum(sizes), end_id)
                cuts = np.concatenate([[0], np.cumsum(sizes + 1)])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(np.full(hi - lo, part, np.int32)),
                        pa.array(before + cuts[:-1]),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values.view("<i4"))),
                    ],
                    names=["doc_id", "part", "local_start", "ids"],
                )
                before += int(cuts[-1])
                pool.release_unused()

    tie = F.xxhash64("text")
    ordered = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), tie)
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), tie, "text")
    )
    return ordered.mapInArrow(encode, TOKEN_SCHEMA)


def write_token_orc(rows: DataFrame, path: str) -> None:
    """One ORC file for each partition, in document order: integers are run-length encoded, row groups indexed."""
    (
        rows.write.option("compression", "zstd")
        .option("orc.stripe.size", str(64 << 20))
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", "1000")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """Rows of the files; with `doc_ids`, statistics and Bloom filters rule out most stripes and row groups."""
    df = spark.read.schema(TOKEN_SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def token_starts(stored: DataFrame) -> DataFrame:
    """Columns part and base: ids in all parts before. One row for each file."""
    totals = stored.groupBy("part").agg(F.max(F.col("local_start") + F.size("ids")).alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def token_digest(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each stored document."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            cuts = lists.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crcs = [zlib.crc32(raw[a * 4 : b * 4]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(cuts)), pa.array(crcs, pa.int64())],
                names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"],
            )

    each = stored.mapInArrow(sums, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    start: Column = F.col("base") + F.col("local_start")
    return each.join(token_starts(stored), "part").select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")


def token_orc(docs: DataFrame, path: str, tokenizer: str | None = None, **columns: str) -> DataFrame:
    """Encodes, writes to `path` as ORC and returns the digest of what the files hold."""
    write_token_orc(token_rows(docs, tokenizer or tokenizer_path(), **columns), path)
    return token_digest(read_token_orc(docs.sparkSession, path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_orc(table(spark, sf_dir, "documents"), scratch_path(spark, "token-orc"))
