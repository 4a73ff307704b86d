"""Readers and writers of Parquet, CSV, TSV and JDBC tables, and what is known of written tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = "\\N"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: spark.checkpoint.dir, which a cluster has to set; in local
    mode without it, one below the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: tables between steps need a folder that all executors share")
        root = f"{spark.conf.get('spark.sql.warehouse.dir')}/shared"
    _scratch.append(f"{root}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


#: Paths that scratch_path() has given out and scratch_removed() has not removed.
_scratch: list[str] = []


@contextmanager
def scratch_removed(spark: SparkSession) -> Iterator[None]:
    """Tables in paths of scratch_path() that are asked for within the block are removed at its end: for jobs that have written
    their results elsewhere by then."""
    before = set(_scratch)
    yield
    for path in [p for p in _scratch if p not in before]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        _scratch.remove(path)


def load_raw(spark: SparkSession, path: str) -> DataFrame:
    """Parquet by path or glob; raises AnalysisException if there is none."""
    return spark.read.parquet(path)


def _exists(spark: SparkSession, glob: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def table_path(spark: SparkSession, folder: str, table: str) -> str:
    """<folder>/<table>/*.parquet if there is such a file, else <folder>/*.parquet."""
    own = f"{folder}/{table}/*.parquet"
    return own if _exists(spark, own) else f"{folder}/*.parquet"


def read_jdbc_table(spark: SparkSession, url: str, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1, **properties: str) -> DataFrame:
    """A whole table; with `column`, read by `parts` ranges of it at once."""
    if column is None:
        return spark.read.jdbc(url, table, properties=properties)
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=properties)


def jdbc_bounds(spark: SparkSession, url: str, table: str, column: str, parts: int = 8, **properties: str) -> list:
    """Values that cut the table's rows into about `parts` equal parts by a column, from its own quantiles. The database sends
    that column only."""
    values = read_jdbc_table(spark, url, table, **properties).select(F.col(column).alias("v")).where("v IS NOT NULL")
    cuts = values.agg(F.percentile_approx("v", [k / parts for k in range(1, parts)], 10_000).alias("q")).first()["q"] or []
    return sorted(set(cuts))


def read_jdbc_balanced(spark: SparkSession, url: str, table: str, column: str, parts: int = 8, **properties: str) -> DataFrame:
    """A whole table, read by ranges of about as many rows each, whatever the column's values are; rows without a value are in
    the first range."""
    cuts = jdbc_bounds(spark, url, table, column, parts, **properties)
    if not cuts:
        return read_jdbc_table(spark, url, table, **properties)
    text = [f"'{c}'" if isinstance(c, str) else str(c) for c in cuts]
    ranges = [f"{column} <= {text[0]} OR {column} IS NULL", *[f"{column} > {a} AND {column} <= {b}" for a, b in zip(text, text[1:], strict=False)], f"{column} > {text[-1]}"]
    return spark.read.jdbc(url, table, predicates=ranges, properties=properties)


def csv_rows_and_rejects(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> tuple[DataFrame, DataFrame]:
    """The rows of CSV chunks that fit the schema, and the others as file and text: lines with too few or too many values, or
    with values of another type. Both are read in one way, so their numbers add up."""
    given = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    bad = "_rejected"
    read = spark.read.schema(T.StructType([*given.fields, T.StructField(bad, T.StringType())])).option("columnNameOfCorruptRecord", bad).option("mode", "PERMISSIVE")
    rows = read.option("header", header).option("escape", "\\").option("nullValue", NULL).option("multiLine", True).csv(path)
    # All columns are looked at in both cases: a reader of some columns would not see what is wrong with the others.
    looked = F.concat_ws("", *[F.col(f"`{f.name}`").cast("string") for f in given.fields]) >= ""
    good = rows.where(looked & F.col(bad).isNull()).drop(bad)
    return good, rows.where(looked & F.col(bad).isNotNull()).select(F.col("_metadata.file_path").alias("file"), F.col(bad).alias("text"))


def read_csv_chunks(spark: SparkSession, path: str, schema: T.StructType | str, header: bool = True) -> DataFrame:
    return spark.read.schema(schema).option("header", header).option("escape", "\\").option("nullValue", NULL).option("multiLine", True).csv(path)


def write_csv_chunks(df: DataFrame, path: str, chunk_size: int = 1_000_000, header: bool = True) -> None:
    """Files of at most chunk_size rows; nulls as \\N, backslash as the escape, quotes where they are needed."""
    df.write.option("header", header).option("escape", "\\").option("nullValue", NULL).option("maxRecordsPerFile", chunk_size).csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.option("sep", "\t").option("header", True).option("escape", "\\").option("nullValue", NULL).csv(path)


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("escape", "\\").option("nullValue", NULL).option("multiLine", True).csv(path)


def write_sharded(df: DataFrame, path: str, file_rows: int = 2_000_000, row_group_rows: int = 500_000, compression: str = "snappy", mode: str = "errorifexists") -> None:
    """Parquet files of at most file_rows rows with row groups of at most row_group_rows; mode 'ignore' keeps what is there.

    Columns without a type are written as strings. An empty table leaves a file with the schema only.
    """
    typed = df.select(*[F.col(f"`{f.name}`").cast("string").alias(f.name) if isinstance(f.dataType, T.NullType) else F.col(f"`{f.name}`") for f in df.schema.fields])
    (
        typed.write.mode(mode)
        .option("maxRecordsPerFile", file_rows)
        .option("parquet.block.row.count.limit", row_group_rows)
        .option("compression", compression)
        .parquet(path)
    )


def save_table(df: DataFrame, path: str) -> DataFrame:
    """Replaces the table at `path` and reads it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Files in a folder of write_each(); Spark lists more than 32 folders by tasks.
FOLDER = 1024


def write_each(df: DataFrame, path: str) -> None:
    """A file for each row of a table of one text column, in folders of up to 1,024 files: path/*/*. It holds the text and nothing else
    (null: it is empty).

    In a folder that is mounted, tasks write the files themselves: Hadoop's local file system starts two processes for each file
    that Spark's writer opens. Names are the rows' numbers, so a task that runs again writes the same files.
    """
    spark, text = df.sparkSession, df.columns[0]
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    to = to.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(to).toUri()
    if to.getScheme() != "file":
        # A task moves the files to their folder itself. An empty separator is not allowed.
        df.write.option("maxRecordsPerFile", 1).option("mapreduce.fileoutputcommitter.algorithm.version", 2).option("lineSep", "\n").text(f"{path}/0")
        return
    root = to.getPath()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder = None
        for batch in batches:
            for k, value in zip(batch.column("k").to_pylist(), batch.column("value").to_pylist(), strict=True):
                if folder != f"{root}/{k // FOLDER}":
                    folder = f"{root}/{k // FOLDER}"
                    os.makedirs(folder, exist_ok=True)
                with open(f"{folder}/{k}.txt", "wb") as out:
                    out.write(value or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    numbered = df.select(F.monotonically_increasing_id().alias("k"), F.col(f"`{text}`").cast("binary").alias("value"))
    numbered.mapInArrow(written, "n long").agg(F.sum("n")).collect()


def save_layouts(best: DataFrame, name: str, buckets: int = 16) -> tuple[DataFrame, DataFrame]:
    """Two bucketed copies of the best plays: by item, sorted by pp, and by user, sorted by item."""
    spark = best.sparkSession
    for column, order in (("item_id", "pp"), ("user_id", "item_id")):
        best.write.mode("overwrite").bucketBy(buckets, column).sortBy(column, order).saveAsTable(f"{name}_by_{column}")
    return spark.table(f"{name}_by_item_id"), spark.table(f"{name}_by_user_id")


def save_clustered(best: DataFrame, path: str, row_group_rows: int = 100_000, lookup: str = "user_id") -> DataFrame:
    """The best plays in ranges of (item_id, pp), sorted within each file, with Bloom filters on `lookup`.

    A question for an item and a least pp reads the row groups whose ranges hold it, by their statistics; one for a user skips
    the row groups whose filter says no. Page indexes, which Parquet always writes, narrow a row group down to pages.
    """
    ranged = best.repartitionByRange("item_id", "pp").sortWithinPartitions("item_id", "pp")
    written = ranged.write.mode("overwrite").option("parquet.block.row.count.limit", row_group_rows)
    written.option(f"parquet.bloom.filter.enabled#{lookup}", "true").option(f"parquet.bloom.filter.expected.ndv#{lookup}", row_group_rows).parquet(path)
    return best.sparkSession.read.schema(best.schema).parquet(path)


def save_by_item(table: DataFrame, name: str, buckets: int = 16) -> DataFrame:
    """A table of items in the buckets of the layout by item, which joins with that layout by item_id where it lies. Joins by
    item and variant do so too with spark.sql.requireAllClusterKeysForCoPartition set to false."""
    table.write.mode("overwrite").bucketBy(buckets, "item_id").sortBy("item_id").saveAsTable(name)
    return table.sparkSession.table(name)


def save_by_user(table: DataFrame, name: str, buckets: int = 16) -> DataFrame:
    """A table of users, for instance a cohort, in the buckets of the layout by user."""
    table.write.mode("overwrite").bucketBy(buckets, "user_id").sortBy("user_id").saveAsTable(name)
    return table.sparkSession.table(name)


def save_observed(df: DataFrame, path: str, **violations: Column) -> tuple[DataFrame, dict[str, int]]:
    """Replaces the table at `path`; what is true of how many rows (and n_rows) is counted by the job that writes them."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *[F.count_if(c).alias(name) for name, c in violations.items()]).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), dict(seen.get)


#: Bytes of a file that is hashed as a whole; larger ones are hashed by their rows.
WHOLE_FILE = 1 << 30


def row_digests(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, hash of the Parquet files: a digest of the rows of each, whatever their order. Ranges of a file are hashed by
    themselves and combined, so a file of any size spreads over tasks. Columns of maps are left out, as they have no hash."""
    rows = spark.read.parquet(*([path] if isinstance(path, str) else path))
    columns = [F.col(f"`{c}`") for c, kind in rows.dtypes if "map<" not in kind]
    one = rows.select(F.col("_metadata.file_name").alias("file"), F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit("row"), *columns).alias("b"))
    summed = one.groupBy("file").agg(F.count("*").alias("n"), F.sum(F.col("a").cast("decimal(20,0)")).alias("a"), F.sum(F.col("b").cast("decimal(20,0)")).alias("b"))
    return summed.select("file", F.concat(F.lit("rows:"), F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in ("n", "a", "b")]), 256)).alias("hash"))


def parquet_manifest(spark: SparkSession, path: str, table: str, whole: int = WHOLE_FILE) -> DataFrame:
    """table_name, version, file, rows, size_bytes, hash of each file: sha256 of its bytes, or for files of more than `whole`
    bytes a digest of their rows (row_digests()), as a row of bytes may have 2 GB at most."""
    size, name = F.col("_metadata.file_size"), F.col("_metadata.file_name")
    counted = spark.read.parquet(path).groupBy(name.alias("file"), size.alias("size_bytes")).agg(F.count("*").alias("rows"))
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    file = F.element_at(F.split("path", "/"), -1).alias("file")
    hashed = listed.where(F.col("length") <= whole).select(file, F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("hash"))
    large = [r["path"] for r in listed.where(F.col("length") > whole).select("path").collect()]
    if large:
        hashed = hashed.unionByName(row_digests(spark, large))
    both = hashed.join(counted, "file", "left")
    return both.select(F.lit(table).alias("table_name"), F.lit("1.0").alias("version"), "file", F.coalesce("rows", F.lit(0)).alias("rows"), "size_bytes", "hash")


def manifest_summary(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One row: table_name, version, created_at, files, total_rows, schema (name and type of each column)."""
    fields = [F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for f in spark.read.parquet(path).schema.fields]
    files = F.sort_array(F.collect_list(F.struct("file", "rows", "size_bytes", "hash")))
    return parquet_manifest(spark, path, table).groupBy("table_name", "version").agg(files.alias("files"), F.sum("rows").alias("total_rows")).select(
        "table_name", "version", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "files", "total_rows", F.array(*fields).alias("schema")
    )


def table_counts(tables: dict[str, DataFrame | None], spark: SparkSession) -> DataFrame:
    """table, n_rows; 0 for a missing table."""
    one = lambda name, df: (spark.range(0) if df is None else df).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
    return reduce(DataFrame.unionByName, [one(name, df) for name, df in tables.items()])


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
