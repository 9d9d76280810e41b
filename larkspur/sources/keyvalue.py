"""An ordered store of byte keys and values: parts of a two-column table, newer ones over older ones.

A write adds a part of its own; a null value marks a deleted key.  Many parts become one.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import Files, FtsInfo
from ..errors import EngineError

MOST_KEY_BYTES = 1024
MOST_PARTS = 16
SCHEMA = "key binary, value binary"
STORE = "store"


class KeyValue:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.files = spark, Files(spark, root)
        self.catalog = self.files.newest()

    def frame(self) -> DataFrame:
        """Current pairs: of equal keys the newest part's."""
        newer, rows = None, self.spark.createDataFrame([], SCHEMA)
        for _, path in reversed(self.parts()):
            part = self.spark.read.schema(SCHEMA).parquet(path)
            rows = rows.unionByName(part if newer is None else part.join(newer, "key", "left_anti"))
            newer = part.select("key") if newer is None else newer.unionByName(part.select("key"))
        return rows.where("value is not null")

    def parts(self) -> list:
        return self.catalog.fts[STORE].data if STORE in self.catalog.fts else []

    def _write(self, part: DataFrame) -> None:
        kept = self.parts()
        if len(kept) >= MOST_PARTS:
            kept, part = [], self.frame().join(part, "key", "left_anti").unionByName(part).where("value is not null")
        path = self.files.new("kv")
        part.repartitionByRange("key").sortWithinPartitions("key").write.parquet(path)
        self.catalog = self.catalog.copy()
        self.catalog.version += 1
        self.catalog.fts[STORE] = FtsInfo(STORE, [], {}, [*kept, ["add", path]])
        self.files.commit(self.catalog)

    def put(self, pairs: list[tuple[bytes, bytes]]) -> None:
        """The last of equal keys counts.  Keys that begin with a zero byte are reserved."""
        for k, _ in pairs:
            if not k or k[:1] == b"\0" or len(k) > MOST_KEY_BYTES:
                raise EngineError("keys are 1 to 1,024 bytes and do not begin with a zero byte")
        self._write(self.spark.createDataFrame([(bytearray(k), bytearray(v)) for k, v in dict(pairs).items()], SCHEMA))

    def delete(self, keys: list[bytes]) -> None:
        self._write(self.spark.createDataFrame([(bytearray(k), None) for k in set(keys)], SCHEMA))

    def get(self, key: bytes) -> bytes | None:
        got = self.frame().where(F.col("key") == F.lit(bytearray(key))).select("value").limit(1).collect()
        return bytes(got[0][0]) if got else None

    def scan(self, start: bytes | None = None, end: bytes | None = None, reverse: bool = False) -> Iterator[tuple[bytes, bytes]]:
        """Pairs in the order of keys (unsigned bytes), from start on, before end."""
        df = self.frame()
        if start is not None:
            df = df.where(F.col("key") >= F.lit(bytearray(start)))
        if end is not None:
            df = df.where(F.col("key") < F.lit(bytearray(end)))
        for r in df.orderBy(F.desc("key") if reverse else F.asc("key")).toLocalIterator():
            yield bytes(r[0]), bytes(r[1])
