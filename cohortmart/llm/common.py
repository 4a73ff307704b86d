"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separator of all word counts and shingles.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir. On a cluster it has to be set; in local mode,
    where all is one machine, one below the warehouse serves."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: tables between steps need a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Tables between steps that this process has written and not removed.
_written: list[str] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage and survives lost executors. The table stays
    until scratch_removed() or discard() takes it away."""
    path = scratch_path(df.sparkSession, name)
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables of stored() that nothing is read from any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        if path in _written:
            _written.remove(path)


@contextmanager
def scratch_removed(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within the block are removed at its end: for jobs that have written their result by then."""
    before = set(_written)
    yield
    discard(spark, [p for p in _written if p not in before])


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Those names, with underscores in front until no column of df has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def row_keys(*columns: str | Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of those columns, 128 bits together: the identity of a row."""
    return F.xxhash64(*columns), F.xxhash64(F.lit("row"), *columns)


def share(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`: the fixed split into learned and held-out rows."""
    return F.crc32(column.cast("string")) % modulus


def below(keys: Column, fraction: Column | float) -> Column:
    """True for a deterministic `fraction` of the keys."""
    return F.pmod(F.xxhash64(keys, F.lit("sample")), F.lit(1_000_003)) < F.lit(1_000_003) * fraction


def words(text: Column) -> Column:
    """Words of the text in order; empty for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def last_stored() -> str:
    """The path of the table that was stored last."""
    return _written[-1]


def crc_sql(value: str) -> str:
    """DuckDB SQL of the unsigned crc32 of a whole number's decimal text."""
    bits = "lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    step = f"lambda c, b: list_reduce(range(8), {bits}, xor(c, b))"
    codes = f"list_transform(string_split(CAST({value} AS VARCHAR), ''), lambda z: CAST(ascii(z) AS BIGINT))"
    return f"xor(list_reduce({codes}, {step}, CAST(4294967295 AS BIGINT)), 4294967295)"
