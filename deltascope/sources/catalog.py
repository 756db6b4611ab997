"""Where tables come from: a name, a DataFrame, declared types and a primary key.

Sources only read. Spark enforces no keys, so they are kept here.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical, family, has_text

#: Names that are never user tables: system and temporary ones.
HIDDEN = re.compile(r"^(?:MSys|USys|~|sqlite_)")


@dataclass(frozen=True)
class Table:
    name: str
    df: DataFrame
    primary_key: tuple[str, ...] = ()
    declared: dict[str, str] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        """Comparable columns; those without a canonical text are reported by `skipped`."""
        return [f.name for f in self.df.schema if family(f.dataType) is not None]

    @property
    def skipped(self) -> list[str]:
        return [f.name for f in self.df.schema if family(f.dataType) is None]

    def kind(self, column: str):
        return self.df.schema[column].dataType

    def declared_type(self, column: str) -> str:
        return self.declared.get(column) or self.kind(column).simpleString().upper()

    @cached_property
    def non_ascii(self) -> frozenset[str]:
        """Columns that hold text with anything but ASCII. One aggregate without a shuffle of rows; other text columns skip the NFC function."""
        texts = [c for c in self.columns if has_text(self.kind(c))]
        if not texts:
            return frozenset()
        found = self.df.agg(*[F.max((F.col(f"`{c}`") if isinstance(self.kind(c), T.StringType) else canonical(F.col(f"`{c}`"), self.kind(c))).rlike(r"[^\x00-\x7F]")).alias(f"c{i}") for i, c in enumerate(texts)]).first()
        return frozenset(c for i, c in enumerate(texts) if found[i])

    def signature(self) -> tuple:
        return tuple((c, self.declared_type(c)) for c in self.columns), self.primary_key


class Source:
    """list_tables(), table(name), refresh(). Subclasses say how a table is loaded."""

    def __init__(self, spark: SparkSession, keys: dict[str, tuple[str, ...]] | None = None):
        self.spark, self.keys = spark, {k: tuple(v) for k, v in (keys or {}).items()}

    def names(self) -> list[str]:
        raise NotImplementedError

    def load(self, name: str) -> DataFrame:
        raise NotImplementedError

    def list_tables(self) -> list[str]:
        return sorted(n for n in self.names() if not HIDDEN.match(n))

    def table(self, name: str) -> Table:
        return Table(name, self.load(name), self.keys.get(name, ()))

    def refresh(self) -> None:
        """The next read sees what others have written since."""
        self.spark.catalog.clearCache()


class FrameSource(Source):
    """Tables given as DataFrames, or as functions that make them."""

    def __init__(self, spark, frames: dict, keys=None):
        super().__init__(spark, keys)
        self.frames = frames

    def names(self):
        return list(self.frames)

    def load(self, name):
        frame = self.frames[name]
        return frame() if callable(frame) else frame


class FileSource(Source):
    """A folder of tables, one file or folder each, in any format Spark reads."""

    def __init__(self, spark, path: str, names: list[str], keys=None, format="parquet", suffix=".parquet", options=None):
        super().__init__(spark, keys)
        self.path, self.given, self.format, self.suffix, self.options = path, names, format, suffix, options or {}

    def names(self):
        return list(self.given)

    def load(self, name):
        return self.spark.read.format(self.format).options(**self.options).load(f"{self.path}/{name}{self.suffix}")

    def refresh(self):
        super().refresh()
        for name in self.given:
            self.spark.catalog.refreshByPath(f"{self.path}/{name}{self.suffix}")


class CatalogSource(Source):
    """The tables of a Spark catalog's database."""

    def __init__(self, spark, database: str = "default", keys=None):
        super().__init__(spark, keys)
        self.database = database

    def names(self):
        return [t.name for t in self.spark.catalog.listTables(self.database) if not t.isTemporary]

    def load(self, name):
        return self.spark.table(f"{quoted(self.database)}.{quoted(name)}")

    def refresh(self):
        super().refresh()
        for name in self.names():
            self.spark.catalog.refreshTable(f"{quoted(self.database)}.{quoted(name)}")


class JdbcSource(Source):
    """Tables behind JDBC: names, declared types and primary keys from the database's own metadata, rows read in batches by a connection that refuses writes.

    A table whose key starts with a whole number is read in `partitions` ranges of it.
    """

    def __init__(self, spark, url: str, names: list[str] | None = None, keys=None, schema: str | None = None, fetch_size: int = 10_000, partitions: int = 8, options=None):
        super().__init__(spark, keys)
        self.url, self.given, self.schema, self.partitions = url, names, schema, partitions
        every = {"url": url, "fetchsize": str(fetch_size), "sessionInitStatement": "SET TRANSACTION READ ONLY"} | (options or {})
        self.options = {k: v for k, v in every.items() if v}

    def _metadata(self, read):
        """read(metadata) on a connection of its own."""
        jvm = self.spark._jvm
        properties = jvm.java.util.Properties()
        for k, v in self.options.items():
            properties.setProperty(k, v)
        connection = jvm.java.sql.DriverManager.getConnection(self.url, properties)
        try:
            return read(connection.getMetaData())
        finally:
            connection.close()

    @staticmethod
    def _rows(found, *columns) -> list[tuple]:
        rows = []
        while found.next():
            rows.append(tuple(found.getString(c) for c in columns))
        return rows

    def names(self):
        if self.given is not None:
            return list(self.given)
        kinds = self.spark.sparkContext._gateway.new_array(self.spark._jvm.java.lang.String, 1)
        kinds[0] = "TABLE"
        return [r[0] for r in self._metadata(lambda m: self._rows(m.getTables(None, self.schema, "%", kinds), "TABLE_NAME"))]

    def _quoted(self, name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def _qualified(self, name: str) -> str:
        return ".".join(map(self._quoted, [self.schema, name] if self.schema else [name]))

    def table(self, name):
        def read(metadata):
            key = sorted(self._rows(metadata.getPrimaryKeys(None, self.schema, name), "KEY_SEQ", "COLUMN_NAME"), key=lambda r: int(r[0]))
            return tuple(c for _, c in key), dict(self._rows(metadata.getColumns(None, self.schema, name, "%"), "COLUMN_NAME", "TYPE_NAME"))

        key, declared = self._metadata(read)
        key = self.keys.get(name, key)
        return Table(name, self._load(name, key), key, declared)

    def load(self, name):
        return self._load(name, self.keys.get(name, ()))

    def _load(self, name: str, key: tuple[str, ...]) -> DataFrame:
        reader = self.spark.read.format("jdbc").options(**self.options)
        whole = reader.option("dbtable", self._qualified(name)).load()
        if not key or not isinstance(whole.schema[key[0]].dataType, T.IntegralType):
            return whole
        column = self._quoted(key[0])
        low, high = self.spark.read.format("jdbc").options(**self.options).option("query", f"SELECT min({column}) AS low, max({column}) AS high FROM {self._qualified(name)}").load().first()
        if low is None or low == high:
            return whole
        return reader.options(partitionColumn=key[0], lowerBound=str(low), upperBound=str(high), numPartitions=str(self.partitions)).option("dbtable", self._qualified(name)).load()


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _nodes(plan):
    """Every node of a parsed plan, those of its WITH clauses and subqueries too."""
    yield plan
    for group in (plan.children(), plan.innerChildren()):
        for i in range(group.size()):
            yield from _nodes(group.apply(i))


def select_only(spark: SparkSession, sql: str, **frames) -> DataFrame:
    """Runs a query, and nothing but a query: the parsed statement may hold no command and no write, wherever it stands."""
    named = re.sub(r"\{(\w+)\}", r"\1", sql)
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(named)
    refused = [spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.plans.logical.{kind}") for kind in ("Command", "ParsedStatement", "InsertIntoStatement")]
    if any(kind.isInstance(node) for node in _nodes(parsed) for kind in refused):
        raise PermissionError("only SELECT is allowed on a source")
    return spark.sql(sql, **frames)


def read_keys(spark: SparkSession, path: str) -> dict[str, tuple[str, ...]]:
    """Primary keys from JSON: {"table": ["column", ...]}."""
    text = spark.read.text(path, wholetext=True).first()[0]
    return {k: tuple(v) for k, v in json.loads(text.lstrip("﻿")).items()}


#: The signature of a database file from byte 4, and its versions at byte 20.
SIGNATURE, VERSIONS = "Standard Jet DB", {0: "Jet 3", 1: "Jet 4"}


def file_versions(spark: SparkSession, path: str) -> DataFrame:
    """path, version of database files; NULL for files that aren't."""
    files = spark.read.format("binaryFile").load(path)
    is_base = F.substring(F.col("content"), 5, 15) == F.lit(SIGNATURE).cast("binary")
    code = F.hex(F.substring(F.col("content"), 21, 1))
    version = F.when(code == "00", VERSIONS[0]).when(code == "01", VERSIONS[1]).otherwise("other")
    return files.select("path", F.when(is_base, version).alias("version"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
