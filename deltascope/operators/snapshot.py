"""Snapshots: every table's rows in canonical text, with counts and fingerprints."""

from __future__ import annotations

import time
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import NESTED, canonical, family, nfc, row_fingerprint
from ..sources.catalog import Source, Table
from ..sources.storage import bucketed, open_bucketed
from .running import Run

#: A snapshot's column of row places in source order: unique and rising, not consecutive.
ORD = "__ord"
#: Two 64-bit hashes name a row among the rows of two snapshots; a snapshot that is stored in buckets has them beside its rows, of its values and not of texts, so only where types are the same are they comparable.
PRINTS = ["__p1", "__p2"]


@dataclass
class TableSnapshot:
    """A table as it was: `rows` has one canonical text column for each column of the table, and ORD. `layout` names the columns and the number of the buckets that it is stored in; then `stored` has PRINTS too."""

    table: Table
    rows: DataFrame
    n_rows: int
    fingerprint: str
    seconds: float = 0.0
    layout: tuple[tuple[str, ...], int] | None = None
    stored: DataFrame | None = None

    @property
    def columns(self) -> list[str]:
        return self.table.columns


@dataclass
class Snapshot:
    tables: dict[str, TableSnapshot]

    @property
    def n_rows(self) -> int:
        return sum(t.n_rows for t in self.tables.values())


def canonical_rows(table: Table, normalise: set[str] | None = None, columns: list[str] | None = None) -> DataFrame:
    which = table.non_ascii if normalise is None else normalise
    return table.df.select(*[canonical(F.col(f"`{c}`"), table.kind(c), c in which).alias(c) for c in (columns or table.columns)])


def in_order(rows: DataFrame) -> DataFrame:
    """rows with ORD, as a scan gives them; kept where it is there."""
    return rows if ORD in rows.columns else rows.withColumn(ORD, F.monotonically_increasing_id())


def prints_of(texts: list[F.Column]) -> list[F.Column]:
    return [F.xxhash64(*texts), F.xxhash64(F.lit("second"), *texts)]


def prints(columns: list[str]) -> list[F.Column]:
    return [p.alias(name) for name, p in zip(PRINTS, prints_of([F.col(f"`{c}`") for c in columns]), strict=True)]


def with_fingerprint(rows: DataFrame, columns: list[str], name: str = "fingerprint") -> DataFrame:
    return rows.withColumn(name, row_fingerprint([F.col(f"`{c}`") for c in columns]))


def exact_table_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-256 over the sorted row fingerprints, in one row. It gathers them all: for tables of moderate size."""
    prints = with_fingerprint(rows, columns)
    return prints.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws("", F.sort_array(F.collect_list("fingerprint"))).cast("binary"), 256).alias("fingerprint"))


def table_digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The same in partial sums, for tables of any size: free of order, sensitive to repeats. One row: n_rows, fingerprint. Words of 60 bits are summed as three longs of 20 bits each, decimals made of the sums alone."""
    prints = with_fingerprint(rows, columns).select(*[F.conv(F.substring("fingerprint", 1 + 15 * k, 15), 16, 10).cast("bigint").alias(f"w{k}") for k in range(4)])
    part = lambda k, i: F.sum(F.shiftright(f"w{k}", 20 * i).bitwiseAND(F.lit(0xFFFFF))).cast("decimal(38,0)") * F.lit(1 << 20 * i).cast("decimal(13,0)")
    words = [F.coalesce(reduce(lambda a, b: a + b, [part(k, i) for i in range(3)]).cast("decimal(38,0)"), F.lit(0)).cast("string") for k in range(4)]
    return prints.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), *words).cast("binary"), 256).alias("fingerprint"))


def _dealt(column, kind: T.DataType, normalise: bool) -> tuple[F.Column, F.Column, F.Column]:
    """What is shuffled of a column under its own name; the canonical text made of that; and what stands for it in PRINTS, equal exactly where texts are (NULL apart)."""
    name = F.col(f"`{column}`")
    if family(kind) == "text":
        return nfc(name.cast("string")) if normalise else name, canonical(name, T.StringType()), name
    if isinstance(kind, (*NESTED, T.VariantType)):
        return canonical(name, kind, normalise), name, name
    text = canonical(name, kind)
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):  # a hash doesn't tell -0.0 from 0.0
        return name, text, text
    return name, text, name.cast("bigint") if isinstance(kind, T.IntegralType) else name.cast("timestamp_ntz") if isinstance(kind, T.TimestampType) else name


def _in_buckets(table: Table, path: str, columns: list[str], buckets: int) -> DataFrame:
    """Canonical rows with ORD and PRINTS, in buckets. Texts are several times as long as the values that they are made of, so values are hashed and shuffled, and texts made where they are written."""
    parts = {c: _dealt(c, table.kind(c), c in table.non_ascii) for c in table.columns}
    rows = in_order(table.df.select(*[shuffled.alias(c) for c, (shuffled, _, _) in parts.items()]))
    values = [v for _, _, value in parts.values() for v in (value, value.isNull())]  # a hash passes over NULL
    made = {c: text for c, (_, text, _) in parts.items()} | {ORD: F.col(ORD)} | dict(zip(PRINTS, prints_of(values), strict=True))
    return bucketed(rows, path, made, columns, buckets)


def take_table(table: Table, path: str | None = None, buckets: int | None = None) -> TableSnapshot:
    """With a path the rows are written there, so later changes of the source don't reach the snapshot; with `buckets`, by hash of the primary key or, without one, of whole rows."""
    began, layout, stored = time.monotonic(), None, None
    if buckets is not None:
        if path is None:
            raise ValueError("a snapshot in buckets needs a path")
        layout = (tuple(table.primary_key) or tuple(PRINTS), buckets)
        stored = _in_buckets(table, path, list(layout[0]), buckets)
        rows = stored.drop(*PRINTS)
    else:
        rows = in_order(canonical_rows(table))
    if buckets is None and path is not None:
        rows.write.mode("overwrite").parquet(path)
        rows = table.df.sparkSession.read.schema(rows.schema).parquet(path)
    n, fingerprint = table_digest(rows, table.columns).first()
    return TableSnapshot(table, rows, n, fingerprint, time.monotonic() - began, layout, stored)


def stored_table(table: Table, path: str, buckets: int) -> TableSnapshot:
    """A snapshot that was stored in buckets, opened again; `table` says its columns, types and key, and isn't read."""
    layout = (tuple(table.primary_key) or tuple(PRINTS), buckets)
    stored = open_bucketed(table.df.sparkSession, path, list(layout[0]), buckets)
    n, fingerprint = table_digest(stored, table.columns).first()
    return TableSnapshot(table, stored.drop(*PRINTS), n, fingerprint, 0.0, layout, stored)


def take_snapshot(source: Source, ignored=(), path: str | None = None, progress=None, buckets: int | None = None, run: Run | None = None) -> Snapshot:
    """All tables but the ignored ones (in any case of letters). `progress(table, n, of)` may raise to cancel between tables; a `run` reports and stops within a table."""
    skip = {i.lower() for i in ignored}
    names = [n for n in source.list_tables() if n.lower() not in skip]
    taken = {}
    for k, name in enumerate(names):
        if progress is not None:
            progress(name, k, len(names))
        take = lambda name=name: take_table(source.table(name), None if path is None else f"{path}/{name}", buckets)
        taken[name] = take() if run is None else run.table(name, k, len(names), take, lambda t: t.n_rows)
    return Snapshot(taken)


def stats(snapshot: Snapshot, spark) -> DataFrame:
    rows = [(n, t.n_rows, t.fingerprint, t.seconds) for n, t in snapshot.tables.items()]
    return spark.createDataFrame(rows, "table string, n_rows long, fingerprint string, seconds double").orderBy(F.desc("seconds"))


def snapshot_of(table: Table) -> TableSnapshot:
    """Rows of a table without counting or fingerprinting them: for comparing two tables outright."""
    return TableSnapshot(table, in_order(canonical_rows(table)), -1, "")
