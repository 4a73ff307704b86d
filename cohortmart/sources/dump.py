"""SQL dumps as DataFrames: statements are rows, so a dump of many statements spreads over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortmart.functions.literals import literal
from cohortmart.sources.statements import statements as all_statements

END = ";\n"
NAME = r"(?:[`\"]?\w+[`\"]?\.)?[`\"]?(\w+)[`\"]?"
#: A quoted string, what parentheses of a value hold (calls within calls), and a value; possessive, so no backtracking.
STRING = r"""(?:'(?:[^'\\]++|\\.|'')*+'|"(?:[^"\\]++|\\.|"")*+")"""
CALL = rf"""\((?:[^'"()]++|{STRING}|\((?:[^'"()]++|{STRING})*+\))*+\)"""
VALUE = rf"""(?:[^'"(),]++|{STRING}|{CALL})*+"""
#: A list of values, directly behind the one before it (group 1), and a value of it (group 1).
TUPLES = rf"(?s)\G[\s,]*+(\({VALUE}(?:,{VALUE})*+\))"
FIELD = rf"(?s)(?:^\(|\G(?!^),)({VALUE})"
HEAD = rf"(?is)^\s*(?:INSERT|REPLACE)\s+(?:(?:IGNORE|DELAYED|LOW_PRIORITY|HIGH_PRIORITY)\s+)*INTO\s+{NAME}\s*(\([^)]*\))?\s*VALUES?(?=[\s(]|$)"
INSERT = rf"(?is)^\s*(?:INSERT|REPLACE)\s+(?:\w+\s+)*?INTO\s+{NAME}"
#: What may follow the lists of values.
CLAUSE = r"(?is)^\s*(?:ON\s+(?:DUPLICATE|CONFLICT)|AS|RETURNING)\b"
BLANK = " \n\r\t"
CREATE = rf"(?is)^\s*CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?{NAME}\s*\((.*)"
#: A column or constraint of a table (group 1), and a column's name and type.
DEFINITION = rf"(?s)(?:^|\G(?!^),)({VALUE})"
COLUMN = r"(?is)^\s*[`\"]?(?!(?:PRIMARY|UNIQUE|KEY|INDEX|CONSTRAINT|FOREIGN|CHECK|FULLTEXT|SPATIAL)\b)(\w+)[`\"]?\s+(\w+)"


def statements(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, ended (see cohortmart.sources.statements), head (up to VALUES, or a statement of another kind), body."""
    s = all_statements(spark, path)
    head = F.regexp_extract("text", HEAD, 0)
    body = F.when(head != "", F.substring("text", F.length(head) + 1, F.length("text")))
    return s.select("file", "offset", "ended", F.btrim(F.when(head == "", F.col("text")).otherwise(head), F.lit(BLANK)).alias("head"), body.alias("body"))


def unclosed_files(spark: SparkSession, path: str) -> DataFrame:
    """file: the dumps that end within a statement; only the complete tuples of that are read."""
    return statements(spark, path).where(~F.col("ended") & F.col("head").rlike(INSERT)).select("file").distinct()


def _inserts(spark: SparkSession, path: str, found: DataFrame | None = None) -> DataFrame:
    """file, offset, ended, table, names, body of the INSERT statements; found are the dump's statements() where they are known."""
    s = statements(spark, path) if found is None else found
    return s.where(F.col("body").isNotNull()).select("file", "offset", "ended", F.regexp_extract("head", HEAD, 1).alias("table"), F.regexp_extract("head", HEAD, 2).alias("names"), "body")


def dump_tables(spark: SparkSession, path: str) -> DataFrame:
    """Sorted names of the tables that a dump inserts into or creates."""
    s = statements(spark, path)
    made = s.where(F.col("head").rlike(CREATE)).select(F.regexp_extract("head", CREATE, 1).alias("table"))
    return made.unionByName(_inserts(spark, path).select("table")).distinct().orderBy("table")


def dump_schemas(spark: SparkSession, path: str, found: DataFrame | None = None) -> DataFrame:
    """table, position (from 0), column, sql_type of all CREATE TABLE statements; keys and other constraints are left out."""
    s = (statements(spark, path) if found is None else found).where(F.col("head").rlike(CREATE))
    parts = F.regexp_extract_all(F.regexp_extract("head", CREATE, 2), F.lit(DEFINITION), 1)
    columns = F.filter(parts, lambda d: d.rlike(COLUMN))
    pair = F.transform(columns, lambda d: F.struct(F.regexp_extract(d, COLUMN, 1).alias("n"), F.regexp_extract(d, COLUMN, 2).alias("k")))
    pairs = s.select(F.regexp_extract("head", CREATE, 1).alias("table"), F.posexplode_outer(pair).alias("position", "c")).where("c IS NOT NULL")
    return pairs.select("table", "position", F.col("c.n").alias("column"), F.lower("c.k").alias("sql_type"))


def dump_schema(spark: SparkSession, path: str, table: str, found: DataFrame | None = None) -> DataFrame:
    """position (from 0), column, sql_type of the table's CREATE TABLE statement; of several, one."""
    return dump_schemas(spark, path, found).where(F.col("table") == table).drop("table").dropDuplicates(["position"])


WHOLE, REAL = {"tinyint", "smallint", "mediumint", "int", "integer", "bigint"}, {"float", "double", "real", "decimal"}


def _struct(columns: list) -> T.StructType:
    out = T.StructType()
    for r in columns:
        kind = r["sql_type"]
        out.add(r["column"], T.LongType() if kind in WHOLE else T.DoubleType() if kind in REAL else T.StringType())
    return out


def dump_struct(spark: SparkSession, path: str, table: str) -> T.StructType:
    """The schema of a table as a Spark type, from its CREATE TABLE statement."""
    return _struct(dump_schema(spark, path, table).orderBy("position").collect())


def tuples(body: Column) -> Column:
    """The lists of values at the start of a body; text after them that is no list ends them."""
    return F.regexp_extract_all(body, F.lit(TUPLES), 1)


def fields(one: Column) -> Column:
    return F.regexp_extract_all(one, F.lit(FIELD), 1)


def dump_rejects(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, table, reason, n_rows_kept, text: what of the INSERT statements is not read, or not as a whole.

    offset is that of the statement, n_rows_kept the number of its lists that are read, text what is left out: all from the
    first list that does not end on ("incomplete list"), the whole of a statement without lists ("no lists"), or a list with
    more values than there are names, whose first values are kept ("values without a name"; one row for each list).
    """
    s = statements(spark, path)
    found = s.where(F.col("head").rlike(INSERT)).select(
        "file", "offset", F.regexp_extract("head", INSERT, 1).alias("table"), F.regexp_extract_all(F.regexp_extract("head", HEAD, 2), F.lit(r"(\w+)"), 1).alias("names"),
        "head", "body", tuples(F.coalesce("body", F.lit(""))).alias("t"),
    )
    left = F.regexp_replace(F.regexp_replace("body", TUPLES, ""), r"^[\s,]+|\s+$", "")
    # One row for each statement, with all that is left out of it: the dump is read once.
    said = lambda reason, text: F.struct(F.lit(reason).alias("reason"), text.alias("text"))
    tail = F.filter(F.array(said("incomplete list", left)), lambda r: (r["text"] != "") & ~r["text"].rlike(CLAUSE))
    long = F.transform(F.filter("t", lambda x: (F.size("names") > 0) & (F.size(fields(x)) > F.size("names"))), lambda x: said("values without a name", x))
    out = F.when(F.col("body").isNull(), F.array(said("no lists", F.col("head")))).otherwise(F.concat(tail, long))
    each = found.select("file", "offset", "table", F.size("t").cast("long").alias("n_rows_kept"), F.explode_outer(out).alias("r")).where("r IS NOT NULL")
    return each.select("file", "offset", "table", "r.reason", "n_rows_kept", "r.text")


def dump_row_counts(spark: SparkSession, path: str) -> DataFrame:
    """table, n_rows: the number of complete tuples."""
    return _inserts(spark, path).groupBy("table").agg(F.sum(F.size(tuples(F.col("body")))).alias("n_rows"))


def insert_columns(spark: SparkSession, path: str, table: str) -> list[str]:
    """Names in the column list of the table's INSERT statements; [] without one."""
    first = _inserts(spark, path).where((F.col("table") == table) & (F.col("names") != "")).select(F.regexp_extract_all("names", F.lit(r"(\w+)"), 1).alias("n")).first()
    return list(first["n"]) if first else []


def read_insert_dump(spark: SparkSession, path: str, table: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of one table of a dump. Columns by `schema`, else by the column list, else by CREATE TABLE, else col_0, col_1, ....

    Without a schema the values of a column list are strings. Short rows are filled with nulls, incomplete tuples left out.
    Statements and comments may be anywhere; dump_rejects() has what is left out.
    """
    found = statements(spark, path)
    inserts = _inserts(spark, path, found).where(F.col("table") == table)
    if schema is None:
        first = inserts.where(F.col("names") != "").select(F.regexp_extract_all("names", F.lit(r"(\w+)"), 1).alias("n")).first()
        names = list(first["n"]) if first else []
        schema = _struct(dump_schema(spark, path, table, found).orderBy("position").collect())
        if names:
            kinds = {f.name: f.dataType for f in schema.fields}
            schema = T.StructType([T.StructField(n, kinds.get(n, T.StringType())) for n in names])
    # Not explode(): of that Spark infers a filter on the size of the lists, for which it looks for them twice.
    rows = inserts.select(F.explode_outer(tuples(F.col("body"))).alias("t")).where("t IS NOT NULL")
    listed = rows.select(fields(F.col("t")).alias("f"))
    if not schema.fields:
        width = listed.agg(F.max(F.size("f"))).first()[0] or 0
        schema = T.StructType([T.StructField(f"col_{k}", T.StringType()) for k in range(width)])
    return listed.select(*[literal(F.get("f", F.lit(k)), x.dataType.simpleString()).alias(x.name) for k, x in enumerate(schema.fields)])


def shown(df: DataFrame, c: str, raw_breaks: bool = False) -> Column:
    """A column's values as literals of a dump."""
    x = F.col(f"`{c}`").cast("string")
    if isinstance(df.schema[c].dataType, (T.StringType, T.TimestampType, T.DateType)):
        x = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("''"))
        if not raw_breaks:
            x = F.replace(F.replace(x, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
        x = F.concat(F.lit("'"), x, F.lit("'"))
    return F.coalesce(x, F.lit("NULL"))


def write_insert_dump(df: DataFrame, path: str, table: str, rows_per_statement: int = 1000, raw_breaks: bool = False) -> None:
    """A dump of INSERT statements, one file for each partition; every statement ends with a semicolon and a line break.

    Line breaks in values are written as backslash and n or r, or with raw_breaks as they are.
    """
    row = F.concat(F.lit("("), F.concat_ws(",", *[shown(df, c, raw_breaks) for c in df.columns]), F.lit(")"))
    numbered = df.select(row.alias("row"), F.floor(F.monotonically_increasing_id() / rows_per_statement).alias("s"))
    listed = ", ".join(f"`{c}`" for c in df.columns)
    made = numbered.groupBy("s").agg(F.concat(F.lit(f"INSERT INTO `{table}` ({listed}) VALUES\n"), F.array_join(F.collect_list("row"), ",\n")).alias("value"))
    made.select("value").write.option("lineSep", END).text(path)
