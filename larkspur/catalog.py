"""Managed tables: a JSON catalog and immutable versions of Parquet data.

A version of a table is a directory; the catalog names the current one of each table.
A commit writes the new directories first and then a new catalog file, whose number is
the highest: readers that have the former go on with the versions it names.  All files
go through Hadoop's FileSystem, so the root may be any store that Spark reads.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import NameFault

SPARK = {"INTEGER": T.LongType(), "REAL": T.DoubleType(), "TEXT": T.StringType(), "BLOB": T.BinaryType()}
CLASS = {"INTEGER": "INT", "REAL": "REAL", "TEXT": "TEXT", "BLOB": "BLOB"}
ROWID = "__rowid"


@dataclass
class ColumnInfo:
    name: str
    type: str
    not_null: bool = False
    default: object = None
    default_now: bool = False
    collate: str = "BINARY"


@dataclass
class TableInfo:
    name: str
    columns: list
    pk: str | None = None  # the column that is the row id
    autoincrement: bool = False
    high: int = 0  # the highest row id ever, with autoincrement
    indexes: dict = field(default_factory=dict)  # name: [columns, unique]
    foreign: list = field(default_factory=list)  # [column, parent table, action]
    data: list = field(default_factory=list)  # folders of Parquet files, whose rows together are the table

    def column(self, name: str) -> ColumnInfo:
        for c in self.columns:
            if c.name == name:
                return c
        raise NameFault(f"no such column: {self.name}.{name}")

    def schema(self) -> T.StructType:
        fields = [T.StructField(c.name, SPARK[c.type]) for c in self.columns]
        return T.StructType([T.StructField(ROWID, T.LongType()), *fields])

    def uniques(self) -> list:
        return [cols for cols, unique in self.indexes.values() if unique]


@dataclass
class FtsInfo:
    name: str
    columns: list
    options: dict
    data: list = field(default_factory=list)  # ["add", folder of an index] or ["del", folder of document ids], each after those before it


@dataclass
class Catalog:
    version: int = 0
    tables: dict = field(default_factory=dict)
    fts: dict = field(default_factory=dict)
    triggers: dict = field(default_factory=dict)  # name: its statement's text

    def dump(self) -> str:
        return json.dumps(asdict(self), default=lambda b: {"blob": b.hex()})

    @staticmethod
    def parse(text: str) -> Catalog:
        raw = json.loads(text, object_hook=lambda d: bytes.fromhex(d["blob"]) if set(d) == {"blob"} else d)
        tables = {}
        for n, t in raw["tables"].items():
            tables[n] = TableInfo(**{**t, "columns": [ColumnInfo(**c) for c in t["columns"]]})
        return Catalog(raw["version"], tables, {n: FtsInfo(**f) for n, f in raw["fts"].items()}, raw["triggers"])

    def copy(self) -> Catalog:
        return Catalog.parse(self.dump())


class Files:
    """The few file operations that the catalog needs."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(conf)
        self.fs.mkdirs(self._path("catalog"))
        self.fs.mkdirs(self._path("lock"))

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def newest(self) -> Catalog:
        names = sorted(str(s.getPath().getName()) for s in self.fs.listStatus(self._path("catalog")))
        names = [n for n in names if n.endswith(".json")]
        if not names:
            return Catalog()
        stream = self.fs.open(self._path(f"catalog/{names[-1]}"))
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return Catalog.parse(text)

    def commit(self, c: Catalog) -> None:
        """Fails if another writer was first: the new name must not exist."""
        name = f"catalog/{c.version:012d}.json"
        try:  # one writer gets the version's lock file
            self.fs.create(self._path(f"lock/{c.version:012d}"), False).close()
        except Py4JJavaError as e:
            raise RuntimeError(f"catalog version {c.version} was written by another writer") from e
        draft = self._path(f"catalog/.{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(c.dump().encode()))
        out.close()
        if not self.fs.rename(draft, self._path(name)):
            raise RuntimeError(f"catalog version {c.version} could not be written")

    def new(self, table: str) -> str:
        return f"{self.root}/data/{table}/{uuid.uuid4().hex}"

    def copy_to(self, target: str) -> None:
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        to = self.jvm.org.apache.hadoop.fs.Path(target)
        self.jvm.org.apache.hadoop.fs.FileUtil.copy(self.fs, self._path(""), to.getFileSystem(conf), to, False, True, conf)

    def delete(self, paths: list) -> None:
        for p in paths:
            self.fs.delete(self.jvm.org.apache.hadoop.fs.Path(p), True)

    def vacuum(self, c: Catalog) -> int:
        """Deletes data that the catalog does not name, and older catalogs, which readers may still hold.  Not while a writer is at work."""
        keep = {p.rsplit("/", 1)[1] for t in c.tables.values() for p in t.data} | {p.rsplit("/", 1)[1] for f in c.fts.values() for _, p in f.data}
        base, n = self._path("data"), 0
        for t in self.fs.listStatus(base) if self.fs.exists(base) else []:
            for v in self.fs.listStatus(t.getPath()):
                if v.getPath().getName() not in keep:
                    self.fs.delete(v.getPath(), True)
                    n += 1
        for s in self.fs.listStatus(self._path("lock")):  # also that of a writer that died
            self.fs.delete(s.getPath(), False)
        for s in self.fs.listStatus(self._path("catalog")):
            if s.getPath().getName() < f"{c.version:012d}.json":
                self.fs.delete(s.getPath(), False)
        return n


def read(spark: SparkSession, t: TableInfo) -> DataFrame:
    """Columns that older files lack read as their defaults."""
    if not t.data:
        return spark.createDataFrame([], t.schema())
    df = spark.read.schema(t.schema()).parquet(*t.data)
    if t.pk:
        df = df.withColumn(t.pk, F.col(ROWID))
    return df
