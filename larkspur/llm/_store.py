"""Intermediate tables in the folder that driver and executors share.

``stage`` writes a DataFrame there and reads it again: it cuts the lineage, and
a lost executor costs no more than the tasks that it ran.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


_OWN: list[str] = []
#: A page or row group is looked at after a few rows, not only after a hundred: packed values are long, and a writer holds what it has not written.
PARQUET = {"parquet.page.size.row.check.min": "4", "parquet.block.size.row.check.min": "4", "parquet.block.size": str(32 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset (as in tests), one temporary folder for this process."""
    place = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not place:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="larkspur-"))
        place = _OWN[0]
    return place.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    path = new_path(df.sparkSession, name)
    df.write.options(compression=compression, **PARQUET).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._larkspur_path = path
    return out


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of some rows that the driver has; as Arrow, so that no Python worker unpickles them."""
    kinds = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kinds)
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow), kinds)


def drop(*tables: DataFrame | str) -> None:
    """Deletes staged tables (or paths) that are of no more use."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_larkspur_path", None)
        if path:
            jvm, sc = (spark := SparkSession.getActiveSession())._jvm, spark.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Inside, Arrow batches hold fewer rows: texts and sets are long, and several batches are in memory at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+``; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def text_key(text: Column) -> Column:
    """128 bits of the text; null counts as empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return F.substring(F.unhex(F.sha2(whole.cast("binary"), 256)), 1, 16)
