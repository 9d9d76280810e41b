"""Structured Streaming into tables and full-text indexes.

Each micro-batch is one transaction; the batch's number is kept in the table that
``applied`` names, so a batch that is delivered twice is applied once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..sources.frames import source

APPLIED = "stream_batches"


def _once(engine: Engine, name: str, number: int, f: Callable) -> None:
    def run(e: Engine) -> None:
        e.run(f"CREATE TABLE IF NOT EXISTS {APPLIED} (stream TEXT, batch INTEGER, PRIMARY KEY (stream, batch))")
        seen = e.writer.rows(e.writer.info(APPLIED)).where((F.col("stream") == F.lit(name)) & (F.col("batch") == F.lit(number))).limit(1).count()
        if not seen:
            f(e)
            e.run(f"INSERT INTO {APPLIED}(stream, batch) VALUES (?, ?)", (name, number))

    engine.transaction(run)


def into_table(stream: DataFrame, engine: Engine, table: str, checkpoint: str, on_conflict: str = "") -> StreamingQuery:
    """Appends a stream's rows; on_conflict is the end of the INSERT, such as ``ON CONFLICT(k) DO NOTHING``."""
    cols = ", ".join(f'"{c}"' for c in stream.columns)

    def batch(df: DataFrame, number: int) -> None:
        engine.external["__batch"] = source(df)
        _once(engine, table, number, lambda e: e.run(f'INSERT INTO "{table}" ({cols}) SELECT {cols} FROM __batch {on_conflict}'))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def into_fts(stream: DataFrame, engine: Engine, index: str, checkpoint: str) -> StreamingQuery:
    """Adds a stream's documents (rowid and the index's columns) to a full-text index."""
    cols = ", ".join(f'"{c}"' for c in stream.columns)

    def batch(df: DataFrame, number: int) -> None:
        engine.external["__batch"] = source(df)
        _once(engine, index, number, lambda e: e.run(f'INSERT INTO "{index}" ({cols}) SELECT {cols} FROM __batch'))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
