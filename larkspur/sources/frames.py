"""DataFrames and Parquet files as tables of the dialect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sql.select import Source


def dialect_class(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "INT"
    if isinstance(t, T.BooleanType):
        return "BOOL"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "REAL"
    return "BLOB" if isinstance(t, T.BinaryType) else "TEXT"


def source(df: DataFrame, rowid: str | None = None, collations: dict | None = None) -> Source:
    """Integers, reals, texts and blobs stay as they are, so that filters reach the scan; times become texts ``YYYY-MM-DD HH:MM:SS``, nested values JSON texts."""
    cols, out = [], []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cls = dialect_class(f.dataType)
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        elif isinstance(f.dataType, (T.DecimalType, T.FloatType)):
            c = c.cast("double")
        elif cls == "TEXT" and not isinstance(f.dataType, T.StringType):
            c = c.cast("string")
        cols.append(c.alias(f.name))
        out.append((f.name, cls, (collations or {}).get(f.name)))
    return Source(df.select(*cols), out, rowid)


def parquet(spark: SparkSession, path: str, rowid: str | None = None, collations: dict | None = None) -> Source:
    return source(spark.read.parquet(path), rowid, collations)
