"""Literals of SQL dumps: values, comments and column types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal_text(raw: Column) -> Column:
    """Text of a literal: null for NULL in any case and for nothing; quotes of both kinds taken off, doubled ones and backslash
    escapes undone. A character set before a quoted text (_binary 'x') goes; numbers in hexadecimal and calls stay as they are."""
    x = F.btrim(raw, F.lit(" \n\r\t"))
    x = F.when(x.startswith("_"), F.regexp_replace(x, r"^_\w+\s*(?=['\"])", "")).otherwise(x)
    single = (F.length(x) >= 2) & x.startswith("'") & x.endswith("'")
    double = (F.length(x) >= 2) & x.startswith('"') & x.endswith('"')

    def undone(part: Column) -> Column:
        out = F.when(double, F.regexp_replace(part, r"""\\(['"])|"(")""", "$1$2")).otherwise(F.regexp_replace(part, r"""\\(['"])|'(')""", "$1$2"))
        for escape, sign in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\0", "\0")):
            out = F.replace(out, F.lit(escape), F.lit(sign))
        return out

    # Between escaped backslashes, so that none of those is taken for the start of another escape.
    body = F.substring(x, F.lit(2), F.length(x) - 2)
    parts = F.split(body, r"\\\\", -1)
    plain = ~body.contains("\\") & F.when(double, ~body.contains('"')).otherwise(~body.contains("'"))
    inner = F.when(plain, body).otherwise(F.array_join(F.transform(parts, undone), "\\"))
    return F.when((x == "") | (F.upper(x) == "NULL"), None).when(single | double, inner).otherwise(x)


def literal(raw: Column, kind: str = "string") -> Column:
    """A literal as a value of a Spark type; null where it is not one."""
    return literal_text(raw).try_cast(kind)


def without_comments(prefix: Column) -> Column:
    """A statement's text before its values, without /* */ and -- comments."""
    return F.regexp_replace(F.regexp_replace(prefix, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")


#: What a whole number and a double may look like. Other text is not even tried: each failed attempt makes an exception, which takes
#: microseconds.
WHOLE = r"^[\x00-\x20\x7f-\x9f]*+[+-]?[0-9]++[\x00-\x20\x7f-\x9f]*+$"
NUMBER = r"(?i)^[\x00-\x20]*+[+-]?(?:(?:[0-9]++\.?[0-9]*+|\.[0-9]++)(?:e[+-]?[0-9]++)?[df]?|0x[0-9a-f.]++p[+-]?[0-9]++[df]?|inf|infinity|nan)[\x00-\x20]*+$"


def infer_types(df: DataFrame) -> DataFrame:
    """column, type: bigint if every non-null value of the column is one, else double, else string; one pass over all rows.

    A column without a value is a string.
    """
    names = df.columns
    counts = []
    for k, c in enumerate(names):
        text = F.col(f"`{c}`").cast("string")
        counts += [F.count(text).alias(f"n{k}"), F.count(F.when(text.rlike(WHOLE), text.try_cast("bigint"))).alias(f"i{k}"), F.count(F.when(text.rlike(NUMBER), text.try_cast("double"))).alias(f"d{k}")]
    flat = df.agg(*counts)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("n"), F.col(f"i{k}").alias("i"), F.col(f"d{k}").alias("d")) for k, c in enumerate(names)])
    each = flat.select(F.explode(rows).alias("r")).select("r.*")
    kind = F.when(F.col("n") == 0, "string").when(F.col("i") == F.col("n"), "bigint").when(F.col("d") == F.col("n"), "double").otherwise("string")
    return each.select("column", kind.alias("type"))
