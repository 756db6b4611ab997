"""SQLite files as a Spark data source.

A Python data source that reads rows by rowid ranges, so a table is read by
several tasks; the file is opened read-only. Declared types decide what rows hold:
amounts become decimals, dates dates; the rest follows SQLite's own affinity.
"""

from __future__ import annotations

import sqlite3
from datetime import date, datetime
from decimal import Decimal
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .catalog import Source, Table

AMOUNTS = ("DECIMAL", "CURRENCY", "NUMERIC", "MONEY")
#: Rows that a task reads.
BATCH = 100_000


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def spark_type(declared: str) -> T.DataType:
    """Of a declared type; values that don't fit are refused by the conversion, not changed."""
    d = declared.upper()
    if d.startswith(AMOUNTS):
        inside = d.partition("(")[2].rstrip(") ").split(",")
        scale = int(inside[1]) if len(inside) == 2 and inside[1].strip().isdigit() else 4
        return T.DecimalType(38 if not inside[0].strip().isdigit() else min(38, int(inside[0])), scale)
    if d in ("DATETIME", "TIMESTAMP"):
        return T.TimestampNTZType()
    if d == "DATE":
        return T.DateType()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return T.DoubleType()
    return T.BinaryType() if "BLOB" in d else T.StringType()


def converter(kind: T.DataType):
    if isinstance(kind, T.DecimalType):
        return lambda v: Decimal(repr(v) if isinstance(v, float) else str(v))
    if isinstance(kind, T.TimestampNTZType):
        return lambda v: datetime.fromisoformat(v) if isinstance(v, str) else v
    if isinstance(kind, T.DateType):
        return lambda v: date.fromisoformat(v) if isinstance(v, str) else v
    if isinstance(kind, T.StringType):
        return str
    return {T.LongType: int, T.DoubleType: float, T.BinaryType: bytes}[type(kind)]


def describe(path: str, table: str) -> tuple[list[tuple[str, str]], tuple[str, ...]]:
    """(column, declared type) in order, and the primary key in its own order."""
    with connect(path) as con:
        infos = con.execute(f"PRAGMA table_info({quoted(table)})").fetchall()
    return [(i[1], i[2] or "") for i in infos], tuple(i[1] for i in sorted((i for i in infos if i[5]), key=lambda i: i[5]))


class _Piece(InputPartition):
    def __init__(self, rest: str, values: tuple):
        self.rest, self.values = rest, values


class _Reader(DataSourceReader):
    """Pieces of BATCH rows: ranges of row numbers where the table has them, however sparse, else of its primary key's order."""

    def __init__(self, path: str, table: str, schema: T.StructType):
        self.path, self.table, self.schema = path, table, schema

    def partitions(self):
        name = quoted(self.table)
        with connect(self.path) as con:
            try:
                cuts = con.execute(f"SELECT min(rowid), max(rowid) FROM (SELECT rowid, row_number() OVER (ORDER BY rowid) - 1 AS n FROM {name}) GROUP BY n / {BATCH}").fetchall()
                pieces = [_Piece("WHERE rowid BETWEEN ? AND ?", c) for c in cuts]
            except sqlite3.OperationalError:  # WITHOUT ROWID
                key = ", ".join(quoted(c) for c in describe(self.path, self.table)[1])
                n = con.execute(f"SELECT count(*) FROM {name}").fetchone()[0]
                pieces = [_Piece(f"ORDER BY {key} LIMIT ? OFFSET ?", (BATCH, k)) for k in range(0, n, BATCH)]
        return pieces or [_Piece("LIMIT ?", (0,))]

    def read(self, partition):
        convert = [converter(f.dataType) for f in self.schema]
        names = ", ".join(quoted(f.name) for f in self.schema)
        con = connect(self.path)
        try:
            for row in con.execute(f"SELECT {names} FROM {quoted(self.table)} {partition.rest}", partition.values):
                yield tuple(None if v is None else c(v) for c, v in zip(convert, row, strict=True))
        finally:
            con.close()


class SqliteDataSource(DataSource):
    """spark.read.format("sqlite_file").option("table", name).load(path); the path is one that executors reach."""

    @classmethod
    def name(cls):
        return "sqlite_file"

    def schema(self):
        columns, _ = describe(self.options["path"], self.options["table"])
        return T.StructType([T.StructField(c, spark_type(d)) for c, d in columns])

    def reader(self, schema):
        return _Reader(self.options["path"], self.options["table"], schema)


class SqliteSource(Source):
    """The tables of a SQLite file, with the primary keys it declares."""

    def __init__(self, spark: SparkSession, path: str):
        super().__init__(spark)
        self.path = path
        spark.dataSource.register(SqliteDataSource)

    def names(self):
        with connect(self.path) as con:
            return [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")]

    def load(self, name):
        return self.spark.read.format("sqlite_file").option("table", name).load(self.path)

    def table(self, name):
        columns, key = describe(self.path, name)
        return Table(name, self.load(name), key, {c: d for c, d in columns if d})
