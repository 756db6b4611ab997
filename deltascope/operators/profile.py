"""Profiles: column statistics, candidate keys and inclusion relations.

Every column's values are counted once, in a long table (table, column, family,
key, n). Distinct counts and all relations come from it, so relations between all
columns and all keys cost one self-join on (family, key), not a loop over pairs.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.canonical import canonical, family, family_key, observed_tag
from ..sources.catalog import Source, Table
from ..sources.storage import by_shuffle, few, many, written

#: Tables profiled at the same time, and one in how many values of a pair is looked at for a witness.
TABLES_AT_ONCE, SAMPLE_SHARE = 8, 64
#: One in how many values is looked at to refute relations, which takes over 1 % of all rows.
RELATION_SHARE = 16
#: Least rows for a key, least distinct values for a relation to count, longest text of a key, declared types that are never keys (by prefix).
MIN_KEY_ROWS, MIN_RELATION_VALUES, MAX_KEY_TEXT = 2, 3, 255
NEVER_KEYS = ("DECIMAL", "NUMERIC", "CURRENCY", "MONEY", "FLOAT", "DOUBLE", "REAL", "SINGLE", "DATE", "TIME", "MEMO", "LONGTEXT", "LONGCHAR", "CLOB", "BLOB", "BINARY", "VARBINARY", "LONGBINARY", "OLE", "IMAGE")

COLUMN_PROFILE = "table string, column string, ordinal int, declared_type string, family string, n_rows long, n_nulls long, pct_nulls decimal(5,2), n_distinct long, min string, max string, max_length int"
RELATIONS = "src_table string, src_column string, dst_table string, dst_column string, inclusion_rate decimal(5,4), n_values long, n_included long, inclusion_rate_distinct decimal(5,4), n_distinct_src long, n_distinct_included long, confidence string"


#: Fields that hold values as they are while they are counted; texts are made of the different values alone, not of every row's.
AS_THEY_ARE = {"l": "bigint", "d": "double", "t": "timestamp_ntz", "s": "string"}


def _held(column, kind: T.DataType, normalise: bool) -> tuple[str, F.Column]:
    """The field of AS_THEY_ARE for a value, and what it holds: equal exactly where `family_key` is."""
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return "l", column.cast("bigint")
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return "d", column.cast("double")
    if family(kind) == "date":
        return "t", column.cast("timestamp_ntz")
    return "s", family_key(column, kind, normalise)


def _key_of(kind: T.DataType) -> F.Column:
    """`family_key` of what `_held` gave."""
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        return family_key(F.col("d").cast(kind), kind)
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        return family_key(F.col("l").cast(kind), kind)
    return family_key(F.col("t"), T.TimestampNTZType()) if family(kind) == "date" else F.col("s")


def value_counts(table: Table, normalise: set[str] | None = None) -> DataFrame:
    """table, column, family, key, n over the non-null values of all columns."""
    which = table.non_ascii if normalise is None else normalise
    kinds = [table.kind(c) for c in table.columns]
    held = [_held(F.col(f"`{c}`"), kind, c in which) for c, kind in zip(table.columns, kinds, strict=True)]
    used = [f for f in AS_THEY_ARE if any(f == own for own, _ in held)]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), *[(value if f == own else F.lit(None).cast(AS_THEY_ARE[f])).alias(f) for f in used]) for i, (own, value) in enumerate(held)])
    found = table.df.select(F.explode(cells).alias("c")).select("c.*").filter(reduce(lambda a, b: a | b, [F.col(f).isNotNull() for f in used]))
    found = found.groupBy("i", *used).agg(F.count("*").alias("n"))
    by_kind = {kind: [i for i, k in enumerate(kinds) if k == kind] for kind in kinds}
    key = F.coalesce(*[F.when(F.col("i").isin(own), _key_of(kind)) for kind, own in by_kind.items()])
    listed = lambda texts: F.element_at(F.array(*[F.lit(t) for t in texts]), F.col("i") + 1)
    return found.select(F.lit(table.name).alias("table"), listed(table.columns).alias("column"), listed([family(k) for k in kinds]).alias("family"), key.alias("key"), "n")


def column_facts(table: Table, bounds: bool = True) -> DataFrame:
    """COLUMN_PROFILE but for the distinct counts: one aggregate in one row. Bounds need one ordered family: a NaN in a float column leaves it without."""
    aggs = []
    for i, c in enumerate(table.columns):
        kind, col = table.kind(c), F.col(f"`{c}`")
        which = family(kind)
        usable = F.lit(which not in ("binary", "nested"))
        if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
            usable = ~F.coalesce(F.max(F.isnan(col)), F.lit(False))
        low, high = (F.lit(None).cast("string"),) * 2
        if bounds and which not in ("binary", "nested"):
            low, high = (F.substring(canonical(f(col), kind), 3, 1 << 30) for f in (F.min, F.max))
        longest = F.max(F.length(col)) if which == "text" else F.lit(None)
        aggs += [F.count(F.when(observed_tag(col, kind) == "N", 1)).alias(f"nulls{i}"), F.when(usable & (F.count(col) > 0), low).alias(f"min{i}"), F.when(usable & (F.count(col) > 0), high).alias(f"max{i}"), longest.cast("int").alias(f"long{i}")]
    wide = table.df.agg(F.count("*").alias("n_rows"), *aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("column"), F.lit(i).alias("ordinal"), F.lit(table.declared_type(c)).alias("declared_type"), F.lit(family(table.kind(c))).alias("family"),
                 F.col(f"nulls{i}").alias("n_nulls"), F.col(f"min{i}").alias("min"), F.col(f"max{i}").alias("max"), F.col(f"long{i}").alias("max_length"))
        for i, c in enumerate(table.columns)
    ])
    return wide.select("n_rows", F.explode(rows).alias("c")).select("n_rows", "c.*")


def column_profile(table: Table, counts: DataFrame | None = None) -> DataFrame:
    """COLUMN_PROFILE rows."""
    long = column_facts(table)
    distinct = (value_counts(table) if counts is None else counts.filter(F.col("table") == table.name)).groupBy("column").agg(F.count("*").alias("n_distinct"))
    share = F.bround(F.col("n_nulls").cast("decimal(20,0)") * 100 / F.greatest(F.col("n_rows"), F.lit(1)), 2).cast("decimal(5,2)")
    return long.join(distinct, "column", "left").select(
        F.lit(table.name).alias("table"), "column", "ordinal", "declared_type", "family", "n_rows", "n_nulls", share.alias("pct_nulls"), F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"), "min", "max", "max_length"
    )


def observed_types(table: Table) -> DataFrame:
    """table, column, type, n: how many values of each column have each type (canonical tags, `N` for NULL), counted value by value. Only VARIANT columns can have several."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), observed_tag(F.col(f"`{c}`"), table.kind(c)).alias("type")) for c in table.columns])
    return table.df.select(F.explode(cells).alias("c")).groupBy("c.column", "c.type").agg(F.count("*").alias("n")).select(F.lit(table.name).alias("table"), "column", "type", "n")


def key_rank(column) -> int | None:
    """Of a COLUMN_PROFILE row: integers before short texts before booleans; None: never a key."""
    declared = column.declared_type.upper()
    if declared.startswith(NEVER_KEYS) or column.n_rows == column.n_nulls:
        return None
    if column.family == "number":
        return 0
    if column.family == "text":
        return 1 if (column.max_length or 0) <= MAX_KEY_TEXT else None
    return 2 if column.family == "boolean" else None


def candidate_keys(table: Table, columns: list) -> list[tuple[str, ...]]:
    """Unique non-null columns, then unique pairs of the others, by preference. `columns`: collected COLUMN_PROFILE rows (as many as the table has columns)."""
    if not columns or columns[0].n_rows < MIN_KEY_ROWS:
        return []
    n, rank, place = columns[0].n_rows, {c.column: key_rank(c) for c in columns}, {c.column: c.ordinal for c in columns}
    eligible = [c for c in sorted(columns, key=lambda c: c.ordinal) if rank[c.column] is not None and c.n_nulls == 0]
    single = [c.column for c in eligible if c.n_distinct == n]
    rest = [c for c in eligible if c.column not in single]
    pairs = [(a.column, b.column) for a, b in combinations(rest, 2) if a.n_distinct * b.n_distinct >= n]
    unique = unique_pairs(table, pairs) if pairs else []
    return sorted([(c,) for c in single] + unique, key=lambda k: (max(rank[c] for c in k), len(k), tuple(place[c] for c in k)))


def _as_held(column, kind: T.DataType, normalise: bool) -> F.Column:
    """Equal exactly where canonical texts are; numbers and plain texts stay as they are stored."""
    plain = isinstance(kind, (T.IntegralType, T.BooleanType)) or (isinstance(kind, T.StringType) and not normalise)
    return column if plain else canonical(column, kind, normalise)


def unique_pairs(table: Table, pairs: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Those of the pairs of columns whose values never repeat.

    Refuted by witnesses: for each pair one in SAMPLE_SHARE of its values is chosen
    by hash, all rows with such a value are grouped, and a value met twice discards
    the pair for certain. Pairs without a witness are counted over all rows, together
    in one pass of grouping sets.
    """
    names, which = list(dict.fromkeys(c for p in pairs for c in p)), table.non_ascii
    place = {c: f"c{i}" for i, c in enumerate(names)}
    held = table.df.select(*[_as_held(F.col(f"`{c}`"), table.kind(c), c in which).alias(place[c]) for c in names])
    chosen = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(SAMPLE_SHARE)) == 0
    text = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))
    values = F.array(*[F.when(chosen(place[a], place[b]), F.struct(F.lit(i).alias("pair"), text(place[a]).alias("a"), text(place[b]).alias("b"))) for i, (a, b) in enumerate(pairs)])
    sample = held.select(F.explode(values).alias("v")).filter("v IS NOT NULL").select("v.*")
    refuted = {r.pair for r in sample.groupBy("pair", "a", "b").count().filter("count > 1").select("pair").distinct().collect()}  # as many as there are pairs
    left = [p for i, p in enumerate(pairs) if i not in refuted]
    if not left:
        return []
    sets = [[place[a], place[b]] for a, b in left]
    used = list(dict.fromkeys(c for s in sets for c in s))
    counted = held.groupingSets(sets, *used).agg(F.count("*").alias("n"), F.array(*[F.grouping(c) == 0 for c in used]).alias("has")).filter("n > 1")
    twice = {tuple(r.has) for r in counted.select("has").distinct().collect()}
    return [p for p, s in zip(left, sets, strict=True) if tuple(c in s for c in used) not in twice]


def relations(counts: DataFrame, keys: DataFrame) -> DataFrame:
    """RELATIONS: columns whose rows (at least 99 %) have their value in a single-column key. keys(table, column).

    Keys and totals are as many as there are columns and broadcast, so that no column's values meet in one task. Many
    values are looked at by one in RELATION_SHARE first: a pair of columns of which over 1 % of all rows are missing there
    is refuted for certain, and only columns of the pairs that are left are joined whole.
    """
    targets = counts.join(F.broadcast(keys.select(F.col("table").alias("dst_table"), F.col("column").alias("dst_column"))), (F.col("table") == F.col("dst_table")) & (F.col("column") == F.col("dst_column"))).select("family", "key", "dst_table", "dst_column")
    source = counts.select(F.col("table").alias("src_table"), F.col("column").alias("src_column"), "family", "key", "n")
    src, dst, large = ["src_table", "src_column"], ["dst_table", "dst_column"], many(counts)

    def included(source: DataFrame, targets: DataFrame) -> DataFrame:
        met = source.join(by_shuffle(targets, large), ["family", "key"]).filter("NOT (src_table = dst_table AND src_column = dst_column)")
        return met.groupBy(*src, "family", *dst).agg(F.sum("n").alias("n_included"), F.count("*").alias("n_distinct_included"))

    chosen = F.pmod(F.xxhash64("key"), F.lit(RELATION_SHARE)) == 0
    totals = source.groupBy(*src, "family").agg(F.sum("n").alias("n_values"), F.count("*").alias("n_distinct_src"), F.coalesce(F.sum(F.when(chosen, F.col("n"))), F.lit(0)).alias("n_chosen"))
    if large:
        totals = written(totals, "relation-totals")
        asked = keys.join(totals.select(F.col("src_table").alias("table"), F.col("src_column").alias("column"), "family"), ["table", "column"]).select(F.col("table").alias("dst_table"), F.col("column").alias("dst_column"), "family")
        seen = included(source.filter(chosen), targets.filter(chosen)).drop("n_distinct_included")
        pairs = totals.join(F.broadcast(asked), "family").join(seen, [*src, "family", *dst], "left").filter("NOT (src_table = dst_table AND src_column = dst_column)")
        pairs = written(pairs.filter((F.col("n_chosen") - F.coalesce("n_included", F.lit(0))) * 100 <= F.col("n_values")).select(*src, *dst), "relation-pairs")
        source, targets = (df.join(F.broadcast(pairs.select(*on).distinct()), on, "left_semi") for df, on in ((source, src), (targets, dst)))
    met, totals = included(source, targets), F.broadcast(totals.drop("family", "n_chosen"))
    rate = lambda a, b: F.bround(F.col(a).cast("decimal(20,0)") / F.col(b), 4).cast("decimal(5,4)")
    weak = (F.col("family") == "boolean") | (F.col("n_distinct_src") < MIN_RELATION_VALUES)
    return met.join(totals, src).filter(F.col("n_included") * 100 >= F.col("n_values") * 99).select(
        "src_table", "src_column", "dst_table", "dst_column", rate("n_included", "n_values").alias("inclusion_rate"), "n_values", "n_included",
        rate("n_distinct_included", "n_distinct_src").alias("inclusion_rate_distinct"), "n_distinct_src", "n_distinct_included", F.when(weak, "faible").otherwise("normale").alias("confidence"),
    )


@dataclass
class Profile:
    columns: DataFrame
    keys: dict[str, list[tuple[str, ...]]]
    relations: DataFrame
    primary_keys: dict[str, tuple[str, ...]]
    skipped: dict[str, list[str]]

    def first_keys(self) -> dict[str, tuple[str, ...]]:
        """The preferred candidate key of every table without a primary key."""
        return {t: k[0] for t, k in self.keys.items() if k and not self.primary_keys.get(t)}

    def key_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(t, list(k), i + 1) for t, keys in self.keys.items() for i, k in enumerate(keys)]
        return spark.createDataFrame(rows, "table string, columns array<string>, rank int")


def profile_tables(tables: list[Table], progress=None) -> tuple[list[DataFrame], list[DataFrame], dict[str, list[tuple[str, ...]]]]:
    """Value counts, column profiles and candidate keys of each table. The tables' jobs don't depend on each other, so several run at once."""

    def one(table: Table):
        counts = written(value_counts(table), "value-counts")
        columns = column_profile(table, counts)
        return counts, columns, candidate_keys(table, columns.collect())

    parts, columns, keys = [], [], {}
    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        for k, (table, found) in enumerate(zip(tables, pool.map(one, tables), strict=True)):
            if progress is not None:
                progress(table.name, k, len(tables))
            parts.append(found[0])
            columns.append(found[1])
            keys[table.name] = found[2]
    return parts, columns, keys


def table_keys(tables: list[Table]) -> dict[str, list[tuple[str, ...]]]:
    """The candidate keys of each table and nothing else: values are counted only of columns that may be keys, and no counts are kept."""

    def one(table: Table):
        facts = column_facts(table, bounds=False).collect()
        may = [c.column for c in facts if key_rank(c) is not None and c.n_nulls == 0]
        if not may or facts[0].n_rows < MIN_KEY_ROWS:
            return []
        narrow = replace(table, df=table.df.select(*[f"`{c}`" for c in may]))
        distinct = {r.column: r["count"] for r in value_counts(narrow).groupBy("column").count().collect()}
        return candidate_keys(narrow, [Row(**c.asDict(), n_distinct=distinct[c.column]) for c in facts if c.column in distinct])

    with ThreadPoolExecutor(TABLES_AT_ONCE) as pool:
        return dict(zip([t.name for t in tables], pool.map(one, tables), strict=True))


def profile(source: Source, ignored=(), progress=None) -> Profile:
    skip, spark = {i.lower() for i in ignored}, source.spark
    tables = [source.table(n) for n in source.list_tables() if n.lower() not in skip]
    parts, columns, keys = profile_tables(tables, progress)
    union = lambda frames, ddl: reduce(DataFrame.unionByName, frames) if frames else spark.createDataFrame([], ddl)
    counts = union(parts, "table string, column string, family string, key string, n long")
    singles = few(spark, [(t, k[0]) for t, own in keys.items() for k in own if len(k) == 1], "table string, column string")
    # small tables about columns, which every hypothesis reads again
    found = written(union(columns, COLUMN_PROFILE), "profile-columns"), written(relations(counts, singles), "profile-relations")
    return Profile(found[0], keys, found[1], {t.name: t.primary_key for t in tables}, {t.name: t.skipped for t in tables if t.skipped})
