"""Statements of SQL dumps, in all byte ranges of a file at once.

A range of a file (a split, as Spark reads it) may begin within a statement, a quote or a comment. What a range does to the
state at its start is a small table: for each possible state, the one at its end and whether a statement ends in it. These
tables are composed file by file, which tells every range its true state, and the ranges are then cut into statements where
they are. Only statements that cross ranges are put together by a shuffle. Files that Spark never splits are read once, whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortmart.sources.files import save_table, scratch_path

#: States between two stretches of a dump: outside of everything, in the three kinds of quotes, in a comment of several lines, in one
#: that ends with its line.
NORMAL, SINGLE, DOUBLE, BACK, COMMENT, LINE = STATES = range(6)
#: What needs no care from a state NORMAL on: text without signs of meaning, whole quotes, single dashes and slashes.
PLAIN = re.compile(rb"""(?s)(?:[^'"`;/#\-]++|'(?:[^'\\]++|\\.|'')*+'|"(?:[^"\\]++|\\.|"")*+"|`[^`]*+`|-(?!-)|/(?!\*))*+""")
CLOSE = {
    SINGLE: re.compile(rb"(?s)(?:[^'\\]++|\\.|'')*+'"),
    DOUBLE: re.compile(rb'(?s)(?:[^"\\]++|\\.|"")*+"'),
    BACK: re.compile(rb"[^`]*+`"),
    COMMENT: re.compile(rb"(?s)(?:[^*]++|\*(?!/))*+\*/"),
    LINE: re.compile(rb"[^\n]*+(?=\n)"),
}
OPEN = {ord("'"): SINGLE, ord('"'): DOUBLE, ord("`"): BACK}
#: Ranges that are told their state by a broadcast table, at most: about 100 bytes for each range of a file (128 MB as Spark is
#: set by default). Beyond that the lines are joined to the table by a shuffle.
RANGES = 1_000_000

Part = tuple[int, int, bool]


def parts_of_text(text: bytes, state: int) -> tuple[list[Part], int]:
    """Start and end of the parts of a text outside of comments, each with whether a statement ends behind it; and the state
    at the text's end."""
    at, parts = 0, []
    begin = -1 if state in (COMMENT, LINE) else 0
    while True:
        if state != NORMAL:
            m = CLOSE[state].match(text, at)
            if not m:
                if state not in (COMMENT, LINE):
                    parts.append((begin, len(text), False))
                return parts, state
            at = m.end()
            if state in (COMMENT, LINE):
                begin = at
            state = NORMAL
        at = PLAIN.match(text, at).end()
        if at == len(text):
            parts.append((begin, at, False))
            return parts, NORMAL
        sign = text[at]
        if sign == 59:  # a semicolon
            parts.append((begin, at, True))
            at = begin = at + 1
        elif sign in OPEN:
            state, at = OPEN[sign], at + 1
        else:
            parts.append((begin, at, False))
            state, at = (COMMENT, at + 2) if sign == 47 else (LINE, at)  # with no slash, the rest of the line is a comment


def parts_of_line(line: bytes, state: int) -> tuple[list[Part], int]:
    """parts_of_text() of a line without its end, which a comment from -- or # ends with."""
    parts, state = parts_of_text(line, state)
    return parts, NORMAL if state == LINE else state


#: Files that Spark reads through a codec.
PACKED = r"\.(?:gz|bz2|deflate|snappy|lz4|zst|zstd)$"


def _read(spark: SparkSession, path: str, sep: str) -> DataFrame:
    m = F.col("_metadata")
    size = m["file_size"] if sep == ";" else F.lit(None).cast("long")
    read = spark.read.option("lineSep", sep).text(path)
    split = (m["file_block_length"] < m["file_size"]).alias("split")
    return read.select(m["file_path"].alias("file"), m["file_block_start"].alias("start"), split, m["file_size"].alias("bytes"), size.alias("size"), F.col("value").cast("binary").alias("line"))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The files, which are listed once. Conditions on their names and sizes (_metadata) pick them from the list and read no file."""
    return spark.read.format("binaryFile").load(path)


def _any(listed: DataFrame, condition: Column) -> bool:
    return not listed.where(condition).select("path").isEmpty()


def _lines(spark: SparkSession, path: str, listed: DataFrame | None = None) -> DataFrame:
    """file, start, split, bytes (of the file), size, line: what is between two semicolons, so a row is no longer than a statement even
    where a dump has no line breaks. Packed files are read by lines, with size null: their size does not tell if the last semicolon
    is there."""
    if not _any(_listed(spark, path) if listed is None else listed, F.col("_metadata.file_path").rlike(PACKED)):
        return _read(spark, path, ";")
    packed = F.col("file").rlike(PACKED)
    return _read(spark, path, ";").where(~packed).unionByName(_read(spark, path, "\n").where(packed))


#: Files of so many bytes at most are opened by tasks of about so many of Spark's partitions of files (of 32, as Spark is set by default).
TINY, TOGETHER = 64 << 10, 32


def _whole_files(listed: DataFrame, least: int) -> DataFrame:
    """What _pieces() reads of the files that Spark never splits, each as one row of `least` bytes at most: to open a file as lines takes
    Spark several times as long. A byte order mark goes, as it does from lines."""
    m = F.col("_metadata")
    plain = listed.where((m["file_size"] <= least) & ~m["file_path"].rlike(PACKED))
    mark = F.substring("content", 1, 3) == F.lit(b"\xef\xbb\xbf")
    zero = F.lit(0).cast("long")
    line = F.when(mark, F.substring("content", F.lit(4), F.length("content"))).otherwise(F.col("content"))
    base = F.when(mark, F.lit(3).cast("long")).otherwise(zero)
    read = lambda df: df.select(m["file_path"].alias("file"), zero.alias("start"), F.lit(NORMAL).alias("state"), base.alias("base"), zero.alias("began"), m["file_size"].alias("size"), line.alias("line"))
    tiny = read(plain.where(m["file_size"] <= TINY))
    tasks = max(tiny.rdd.getNumPartitions() // TOGETHER, listed.sparkSession.sparkContext.defaultParallelism)
    return tiny.coalesce(tasks).unionByName(read(plain.where(m["file_size"] > TINY)))


def _stretches(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, bytes, list[bytes]]]:
    """Rows of a batch that belong to one range, together: the values of the columns (file and start first) of the first of them, the
    separator, the lines."""
    for batch in batches:
        rows = zip(*[batch.column(c).to_pylist() for c in (*columns, "size", "line")], strict=True)
        for _, same in groupby(rows, key=lambda r: r[:2]):
            first = next(same)
            yield first[:-1], b"\n" if first[-2] is None else b";", [first[-1], *[r[-1] for r in same]]


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each range of the task: bytes, and for each state at its start the state at its end and whether a statement
    ends. The states are followed together; those that have become one are looked at once."""
    key, size, now, ended = None, 0, list(STATES), [False] * len(STATES)

    def row() -> pa.RecordBatch:
        values = [*key, size, *now, *ended]
        names = ["file", "start", "n_bytes", *[f"to{s}" for s in STATES], *[f"ends{s}" for s in STATES]]
        kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.int32()] * len(STATES), *[pa.bool_()] * len(STATES)]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

    for values, sep, lines in _stretches(batches, "file", "start"):
        if values[:2] != key:
            if key is not None:
                yield row()
            key, size, now, ended = values[:2], 0, list(STATES), [False] * len(STATES)
        text = sep.join([*lines, b""])
        size += len(text)
        done = {}
        for s in set(now):
            parts, after = parts_of_text(text, s)
            done[s] = any(p[2] for p in parts), after
        ended = [e or done[s][0] for e, s in zip(ended, now, strict=True)]
        now = [done[s][1] for s in now]
    if key is not None:
        yield row()


TRANSITIONS = ", ".join(["file string, start long, n_bytes long", *[f"to{s} int" for s in STATES], *[f"ends{s} boolean" for s in STATES]])
KNOWN = "file string, start long, state int, base long, began long"


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each range of a file: its state, the place of its first byte, and the range where the open statement began."""
    state, base, began, out = NORMAL, 0, 0, []
    for r in pdf.sort_values("start").to_dict("records"):
        out.append((r["file"], r["start"], state, base, began))
        if r[f"ends{state}"]:
            began = r["start"]
        state, base = r[f"to{state}"], base + r["n_bytes"]
    return pd.DataFrame(out, columns=["file", "start", "state", "base", "began"])


def _least(spark: SparkSession) -> int:
    """The length up to which Spark splits no file."""
    return min(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"spark.sql.files.{c}")) for c in ("openCostInBytes", "maxPartitionBytes"))


def ranges(spark: SparkSession, path: str, lines: DataFrame | None = None) -> DataFrame:
    """file, start, state, base, began of each range of the files that Spark splits; lines are the dump's _lines() where they are known.
    One task composes the ranges of a file, a row of some bytes for each of them."""
    long = (_lines(spark, path) if lines is None else lines).where(F.col("bytes") > _least(spark))
    split = long.where("split").select("file", "start", "size", "line")
    return split.mapInArrow(_transitions, TRANSITIONS).groupBy("file").applyInPandas(_composed, KNOWN)


PIECE = "file string, began long, start long, place int, offset long, ended boolean, text binary"
#: Bytes and rows after which statements are handed on, so files of one statement don't make a batch each.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 10_000


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The statements of the task's ranges. Statements within a range have place null; what belongs to a statement of an
    earlier range has place 0, what is left open at the end 1."""
    key, state, at, began, first, held, offset, after, size = None, NORMAL, 0, 0, False, [], -1, b"", None
    out: list[tuple] = []
    n_bytes = 0

    def close(ended: bool) -> None:
        nonlocal held, offset, first, n_bytes
        text = b"".join(held)
        n_bytes += len(text)
        if first:
            out.append((key[0], began, key[1], 0, offset, ended, text))
        elif text.strip() or not ended:
            out.append((key[0], key[1], key[1], None if ended else 1, offset, ended, text))
        held, offset, first = [], -1, False

    def batch_of_rows() -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=["file", "began", "start", "place", "offset", "ended", "text"])

    def add(text: bytes) -> None:
        nonlocal state, at, offset
        parts, state = parts_of_text(text, state)
        for a, b, ends in parts:
            part = text[a:b]
            if offset < 0 and part.strip():
                offset = at + a + len(part) - len(part.lstrip())
            held.append(part)
            if ends:
                close(True)
            elif b < len(text):
                held.append(b" ")  # where a comment was
        at += len(text)

    def finish() -> None:
        """The separator behind a range's last line, if it is there, and what is left open."""
        if size is None or at < size:
            add(after)
        close(False)

    for values, sep, lines in _stretches(batches, "file", "start", "state", "base", "began"):
        if values[:2] != key:
            if key is not None:
                finish()
            key, (from_state, base, before, size), after = values[:2], values[2:], b""
            state, at, began, first = from_state or NORMAL, base or 0, before or 0, key[1] > 0
        add(after + sep.join(lines))
        after = sep
        if len(out) >= BATCH_ROWS or n_bytes >= BATCH_BYTES:
            yield batch_of_rows()
            out.clear()
            n_bytes = 0
    if key is not None:
        finish()
        yield batch_of_rows()


def statements(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, ended, text: one row for each statement of the dumps, without comments and without its semicolon.

    offset is the place of its first byte in the file; ended is false for what a file ends with after its last semicolon.
    Statements and comments may begin and end anywhere, quoted text stays as it is, carriage returns included. A row holds one
    statement, which must fit into a task's memory, as it had to fit into a packet of the server that it is for.
    """
    least, listed = _least(spark), _listed(spark, path)
    size, packed = F.col("_metadata.file_size"), F.col("_metadata.file_path").rlike(PACKED)
    columns = ["file", "start", "state", "base", "began", "size", "line"]
    found = _whole_files(listed, least).select(*columns).mapInArrow(_pieces, PIECE).select("file", "offset", "ended", "text")
    if _any(listed, (size > least) | packed):
        lines = _lines(spark, path, listed).where((F.col("bytes") > least) | F.col("file").rlike(PACKED))
        none = {"state": F.lit(NORMAL), "base": F.lit(0).cast("long"), "began": F.lit(0).cast("long")}
        given = lines.withColumns(none)
        if _any(listed, size > least):
            known = save_table(ranges(spark, path, lines), scratch_path(spark, "ranges"))
            if known.count() <= RANGES:
                given = lines.join(F.broadcast(known), ["file", "start"], "left")
            else:
                order = F.monotonically_increasing_id()
                given = lines.withColumn("id", order).join(known, ["file", "start"], "left").repartition("file", "start").sortWithinPartitions("file", "start", "id")
        pieces = given.select(*columns).mapInArrow(_pieces, PIECE)
        whole = pieces.where("place IS NULL").select("file", "offset", "ended", "text")
        # The rest of a statement that crosses ranges: its beginning in one range, the others after it.
        parts = pieces.where("place IS NOT NULL").groupBy("file", "began").agg(
            F.sort_array(F.collect_list(F.struct("start", "place", "offset", "text"))).alias("parts"), F.max("ended").alias("ended")
        )
        offsets = F.filter(F.transform("parts", lambda p: p["offset"]), lambda o: o >= 0)
        text = F.reduce("parts", F.lit(b""), lambda all_, p: F.concat(all_, p["text"]))
        crossing = parts.select("file", F.coalesce(F.get(offsets, F.lit(0)), F.lit(0).cast("long")).alias("offset"), "ended", text.alias("text"))
        found = found.unionByName(whole).unionByName(crossing)
    both = found.select("file", "offset", "ended", F.col("text").cast("string").alias("text"))
    return both.where(F.trim(F.translate("text", "\n\r\t", "   ")) != "")
