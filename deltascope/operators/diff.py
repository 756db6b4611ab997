"""Differences of two snapshots.

Keyed tables are joined on their key's canonical text (never NULL, so the join is
a plain equi-join); keyless ones are compared as bags by one signed aggregate.
Both compare hashes of rows first and fetch rows only where something changed;
snapshots that are stored in equal buckets are compared in place, without a shuffle.
Results are long: row_changes(table, key_type, op, key, before, after, ord) and
field_changes(table, key, column, before, after), with canonical texts; `ord` is
the row's place in its source.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.catalog import Table
from ..sources.storage import FEW_ROWS, by_shuffle, written
from .snapshot import ORD, PRINTS, Snapshot, TableSnapshot, in_order, prints, prints_of

ROW_CHANGES = "table string, key_type string, op string, row_id long, key map<string,string>, before map<string,string>, after map<string,string>, ord long"
#: Fields in which a probable update may differ, comparisons beyond which none is sought, and rows under which a candidate key is doubtful.
MAX_FIELDS, PAIRING_CAP, SMALL_TABLE = 2, 1_000_000, 50
#: Changed keys up to which their hashes, longs, are broadcast (some 50 MB).
MANY_KEYS = 1_000_000

#: Hashes of rows' texts, which `bag_diff` makes; PRINTS of stored rows are of values.
TEXT_PRINTS = ["__f1", "__f2"]

PRIMARY, CANDIDATE, NO_KEY = "primaire", "candidate", "aucune"


def _map(columns: list[str], prefix: str = "") -> F.Column:
    return F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.col(f"{prefix}`{c}`") for c in columns]))


def _row_id(table: str) -> F.Column:
    """A number that depends only on the change itself and, among equal ones, on the copy."""
    return F.xxhash64(F.lit(table), "op", F.to_json("key"), F.to_json("before"), F.to_json("after"), "copy")


def with_row_id(changes: DataFrame, table: str) -> DataFrame:
    """ROW_CHANGES of rows that have `copy`."""
    return changes.withColumn("row_id", _row_id(table)).select(*[f.name for f in T.StructType.fromDDL(ROW_CHANGES)])


def is_unique(rows: DataFrame, key: list[str]) -> bool:
    """NULLs count as equal values."""
    return rows.groupBy(*[F.col(f"`{k}`") for k in key]).count().filter("count > 1").isEmpty()


def _named(key: list[str]) -> tuple[list[str], list[F.Column]]:
    on = [f"k{i}" for i in range(len(key))]
    return on, [F.col(f"`{k}`").alias(i) for i, k in zip(on, key, strict=True)]


def changed_keys(before: DataFrame, after: DataFrame, columns: list[str], key: list[str]) -> DataFrame | None:
    """The keys whose rows differ, with `op`, written as a table; None where a key repeats in a side. Both are found in one aggregate of keys and hashes of rows."""
    on, keys = _named(key)
    side = lambda df, mark: df.select(*keys, *prints(columns), F.lit(mark).alias("side"))
    held = side(before, -1).unionAll(side(after, 1)).groupBy(*on).agg(F.count_if(F.col("side") < 0).alias("b"), F.count_if(F.col("side") > 0).alias("a"), *[f(p).alias(f"{n}{p}") for p in PRINTS for n, f in (("low", F.min), ("high", F.max))])
    unequal = " OR ".join(f"low{p} <> high{p}" for p in PRINTS)
    op = F.when(F.col("b") == 0, "insert").when(F.col("a") == 0, "delete").when(F.expr(unequal), "update")
    found = written(held.select(*on, op.alias("op"), F.expr("b > 1 OR a > 1").alias("repeats")).filter("op IS NOT NULL OR repeats"), "changed-keys")
    return found.drop("repeats") if found.filter("repeats").isEmpty() else None


def keyed_diff(name: str, before: DataFrame, after: DataFrame, columns: list[str], key: list[str], key_type: str, in_place: bool = False, differ: DataFrame | None = None) -> DataFrame:
    """Rows after only: insert; before only: delete; both and unequal: update.

    Keys and hashes of rows are compared (unless `differ` has the result already), and
    the keys that differ written as a table; then each side's rows meet that table
    alone, so unchanged rows aren't shuffled where Spark can broadcast it. Beyond
    FEW_ROWS of them their hashes alone are broadcast, and rows with such a hash meet
    the keys by shuffle. Beyond MANY_KEYS whole rows are joined outright, and so they
    are where a side is empty (without a shuffle). With `in_place` both sides are
    stored in buckets of their key, and whole rows are joined where they are.
    """
    on, keys = _named(key)
    b, a = in_order(before), in_order(after)
    whole = lambda df, side: df.select(*keys, F.struct(*[F.col(f"`{c}`") for c in columns]).alias(side), F.col(ORD).alias(f"{side}_ord"))
    op = F.when(F.col("b").isNull(), "insert").when(F.col("a").isNull(), "delete").when(F.col("b") != F.col("a"), "update")
    if differ is None and not in_place and not before.isEmpty() and not after.isEmpty():
        differ = changed_keys(b, a, columns, key)
    n = 0 if differ is None else differ.count()
    if differ is None or n > MANY_KEYS:
        both = whole(b, "b").join(whole(a, "a"), on, "full_outer").withColumn("op", op).filter("op IS NOT NULL")
    elif n > FEW_ROWS:
        hashes = F.broadcast(differ.select(F.xxhash64(*on).alias("hash")).distinct())
        fetched = lambda df, mark: written(whole(df, mark).withColumn("hash", F.xxhash64(*on)).join(hashes, "hash", "left_semi").drop("hash"), "changed-rows")
        both = by_shuffle(differ).join(by_shuffle(fetched(b, "b")), on, "left").join(by_shuffle(fetched(a, "a")), on, "left")
    else:
        fetched = lambda df, mark: whole(df, mark).join(differ.select(*on), on)
        both = differ.join(fetched(b, "b"), on, "left").join(fetched(a, "a"), on, "left")
    shown = F.map_from_arrays(F.array(*[F.lit(k) for k in key]), F.array(*[F.col(i) for i in on]))
    changed = both.select(
        F.lit(name).alias("table"), F.lit(key_type).alias("key_type"), "op", F.lit(0).alias("copy"), shown.alias("key"), F.when(F.col("b").isNotNull(), _map(columns, "b.")).alias("before"),
        F.when(F.col("a").isNotNull(), _map(columns, "a.")).alias("after"), F.coalesce("a_ord", "b_ord").alias("ord"),
    )
    return with_row_id(changed, name)


def bag_diff(name: str, before: DataFrame, after: DataFrame, columns: list[str], in_place: bool = False) -> DataFrame:
    """Copies that one side has more, the last ones in source order: row_added and row_removed.

    Hashes of rows are counted with their sign, summed before the shuffle; rows are
    fetched only for hashes whose sum isn't zero. Copies are listed by pieces of the
    source, so copies of one row, however many, are dealt out. Where a side is empty
    the other's rows are all listed where they are, and only repeated ones met with
    their number. With `in_place` both sides have PRINTS and are stored in buckets of
    these, so nothing is shuffled.
    """
    on = PRINTS if in_place else TEXT_PRINTS
    hashes = (lambda df: PRINTS) if in_place else (lambda df: [p.alias(n) for n, p in zip(on, prints_of([F.col(f"`{c}`") for c in columns]), strict=True)])
    side = lambda df: in_order(df).select(*hashes(df), F.col(ORD).alias("ord"), F.shiftright(ORD, 33).alias("piece"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    b, a = side(before), side(after)
    later = F.coalesce(F.sum("held").over(Window.partitionBy(*on).orderBy(F.desc("piece")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    def listed(copies: DataFrame, sign: int) -> DataFrame:
        row, none = _map(columns, "row."), F.lit(None).cast("map<string,string>")
        return copies.select(
            F.lit(name).alias("table"), F.lit(NO_KEY).alias("key_type"), F.lit("row_added" if sign > 0 else "row_removed").alias("op"), "copy",
            none.alias("key"), (none if sign > 0 else row).alias("before"), (row if sign > 0 else none).alias("after"), "ord",
        )

    def extra(df: DataFrame, sign: int, more: DataFrame) -> DataFrame:
        met = df.join(more, on)
        pieces = met.groupBy(*on, "piece").agg(F.sort_array(F.collect_list("ord"), asc=False).alias("ords"), F.first("row").alias("row"), F.first("n").alias("n"), F.count("*").alias("held"))
        pieces = pieces.withColumn("later", later).filter("later < n")
        copies = pieces.select("row", "later", F.posexplode(F.slice("ords", 1, F.least(F.col("n") - F.col("later"), F.col("held")).cast("int"))).alias("at", "ord"))
        return listed(copies.withColumn("copy", F.col("later") + F.col("at") + 1), sign)

    if not in_place and (before.isEmpty() or after.isEmpty()):
        sign, mine = (1, a) if before.isEmpty() else (-1, b)
        repeats = written(mine.groupBy(*on).agg(F.count("*").alias("n")).filter("n > 1"), "repeated-rows")
        repeats = by_shuffle(repeats, repeats.count() > FEW_ROWS)
        once = mine.join(repeats, on, "left_anti").withColumn("copy", F.lit(1).cast("long"))
        return with_row_id(listed(once, sign).unionByName(extra(mine, sign, repeats)), name)
    if in_place:
        counts = lambda df, n: df.groupBy(*on).agg(F.count("*").alias(n))
        extra_of = lambda mine, other: counts(mine, "own").join(counts(other, "theirs"), on, "left").select(*on, (F.col("own") - F.coalesce("theirs", F.lit(0))).alias("n")).filter("n > 0")
        more = {-1: extra_of(b, a), 1: extra_of(a, b)}
    else:
        signed = b.select(*on, F.lit(-1).alias("sign")).unionAll(a.select(*on, F.lit(1).alias("sign")))
        uneven = signed.groupBy(*on).agg(F.sum("sign").alias("n")).filter("n <> 0")
        more = {sign: uneven.filter(F.col("n") * sign > 0).select(*on, F.abs("n").alias("n")) for sign in (-1, 1)}
    return with_row_id(extra(b, -1, more[-1]).unionByName(extra(a, 1, more[1])), name)


def candidate_pairs(changes: DataFrame, columns: list[str]) -> DataFrame:
    """added, removed (row ids), their places a_ord and r_ord, and the number of fields in which they differ, at most MAX_FIELDS.

    With three or more columns the columns are dealt into MAX_FIELDS + 1 groups; two
    rows that differ in at most MAX_FIELDS fields agree on a whole group, so they meet in an
    equi-join. With fewer columns every pair qualifies, and the cap bounds their number.
    """
    texts = lambda side: F.transform(F.array(*[F.lit(c) for c in columns]), lambda c: F.element_at(side, c))
    added = changes.filter("op = 'row_added'").select(F.col("row_id").alias("added"), F.col("ord").alias("a_ord"), texts(F.col("after")).alias("a"))
    removed = changes.filter("op = 'row_removed'").select(F.col("row_id").alias("removed"), F.col("ord").alias("r_ord"), texts(F.col("before")).alias("b"))
    n = MAX_FIELDS + 1 if len(columns) > MAX_FIELDS else 1
    groups = [[i for i in range(len(columns)) if i % n == g] for g in range(n)] if n > 1 else [[]]
    key = lambda side: F.array(*[F.xxhash64(F.lit(g), *[F.element_at(side, i + 1) for i in own]) for g, own in enumerate(groups)])
    met = added.withColumn("k", F.explode(key(F.col("a")))).join(removed.withColumn("k", F.explode(key(F.col("b")))), "k")
    fields = F.size(F.filter(F.zip_with("a", "b", lambda x, y: x != y), lambda d: d))
    return met.select("added", "removed", "a_ord", "r_ord", fields.alias("fields")).filter(F.col("fields") <= MAX_FIELDS).distinct()


def _greedy(pairs: pd.DataFrame) -> pd.DataFrame:
    """Each added row, in source order, takes the nearest removed row that is still free, of equally near ones the first."""
    taken, rows = set(), []
    for _, own in pairs.sort_values(["a_ord", "fields", "r_ord"]).groupby(["a_ord", "added"], sort=True):
        for added, removed in zip(own["added"], own["removed"], strict=True):
            if removed not in taken:
                taken.add(removed)
                rows.append((added, removed))
                break
    return pd.DataFrame(rows, columns=["added", "removed"])


def _in_rounds(pairs: DataFrame) -> DataFrame:
    """The same choice without gathering the pairs: a pair is settled once its removed row is the best left for the added one and no earlier added row is left that could want it. Rounds are as many as the longest chain of such waits."""
    pairs, settled = pairs.checkpoint(), []
    while not pairs.isEmpty():
        best = pairs.groupBy("added").agg(F.min(F.struct("fields", "r_ord", "removed")).alias("best")).select("added", "best.removed")
        first = pairs.groupBy("removed").agg(F.min(F.struct("a_ord", "added")).alias("first")).select("removed", "first.added")
        settled.append(best.join(first, ["added", "removed"]).checkpoint())
        done = settled[-1]
        pairs = pairs.join(done.select("added"), "added", "left_anti").join(done.select("removed"), "removed", "left_anti").checkpoint()
    return reduce(DataFrame.unionByName, settled) if settled else pairs.select("added", "removed")


def probable_updates(changes: DataFrame, columns: list[str], name: str, cap: int | None = PAIRING_CAP) -> tuple[DataFrame, dict | None]:
    """Pairs of an added and a removed row become probable updates. Beyond the cap there are none, and a warning; with a cap of None there is no limit."""
    changes = written(changes, "bag-changes")  # read some ten times below, and far less than the two tables they come from
    n = {r.op: r["count"] for r in changes.groupBy("op").count().collect()}
    added, removed = n.get("row_added", 0), n.get("row_removed", 0)
    if cap is not None and added * removed > cap:
        details = {"lignes_ajoutees_non_appariees": str(added), "lignes_supprimees_non_appariees": str(removed)}
        message = f"{name}: {added} added and {removed} removed rows are too many to look for probable updates (cap: {cap} comparisons)."
        return changes, {"table": name, "code": "appariement_plafond_atteint", "message": message, "details": details}
    if not added or not removed:
        return changes, None
    pairs = candidate_pairs(changes, columns)
    if cap is None:
        chosen = _in_rounds(pairs)
    else:  # sequential by definition; the cap bounds the group
        chosen = pairs.withColumn("table", F.lit(name)).groupBy("table").applyInPandas(lambda p: _greedy(p), "added long, removed long")
    left = changes.filter("op = 'row_added'").select(F.col("row_id").alias("added"), F.col("after").alias("new"), "ord")
    right = changes.filter("op = 'row_removed'").select(F.col("row_id").alias("removed"), F.col("before").alias("old"))
    paired = chosen.join(left, "added").join(right, "removed").select(
        F.lit(name).alias("table"), F.lit(NO_KEY).alias("key_type"), F.lit("probable_update").alias("op"), F.col("added").alias("row_id"),
        F.lit(None).cast("map<string,string>").alias("key"), F.col("old").alias("before"), F.col("new").alias("after"), "ord",
    )
    used = chosen.select(F.explode(F.array("added", "removed")).alias("row_id"))
    return changes.join(used, "row_id", "left_anti").select(*changes.columns).unionByName(paired), None


def field_changes(changes: DataFrame) -> DataFrame:
    """One row for each field that an update changed."""
    updates = changes.filter("op IN ('update', 'probable_update')").select("table", "row_id", "key", "before", F.explode("after").alias("column", "new"))
    old = F.element_at("before", F.col("column"))
    return updates.filter(~old.eqNullSafe(F.col("new"))).select("table", "row_id", "key", "column", old.alias("before"), F.col("new").alias("after"))


@dataclass
class DiffResult:
    changes: DataFrame
    noise: DataFrame
    schema_changes: list[dict] = field(default_factory=list)
    warnings: list[dict] = field(default_factory=list)


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ROW_CHANGES)


def _whole_table(snapshot: TableSnapshot, op_keyed: str, op_bag: str) -> DataFrame:
    """All rows of a table that came or went."""
    table, name = snapshot.table, snapshot.table.name
    none = snapshot.rows.limit(0)
    before, after = (none, snapshot.rows) if op_keyed == "insert" else (snapshot.rows, none)
    if table.primary_key and is_unique(snapshot.rows, list(table.primary_key)):
        return keyed_diff(name, before, after, table.columns, list(table.primary_key), PRIMARY)
    return bag_diff(name, before, after, table.columns)


def _describe(table: Table) -> list[dict]:
    return [{"name": c, "type": table.declared_type(c)} for c in table.columns]


def diff_table(before: TableSnapshot, after: TableSnapshot, candidate_key=None, cap: int | None = PAIRING_CAP) -> tuple[DataFrame, dict | None, list[dict]]:
    """Row changes, the schema change if any, and warnings."""
    old, new, name, warnings, schema_change = before.table, after.table, after.table.name, [], None
    columns, rows_before, rows_after, key = new.columns, before.rows, after.rows, new.primary_key
    alike = before.layout is not None and before.layout == after.layout and [(c, old.kind(c)) for c in old.columns] == [(c, new.kind(c)) for c in new.columns]
    layout = before.layout[0] if alike else ()
    if old.signature() != new.signature():
        columns = [c for c in new.columns if c in old.columns]
        lost, gained = [c for c in old.columns if c not in columns], [c for c in new.columns if c not in columns]
        retyped = [c for c in columns if old.declared_type(c) != new.declared_type(c)]
        schema_change = {"table": name, "change": "colonnes_modifiees", "before": _describe(old), "after": _describe(new)}
        warnings.append({
            "table": name, "code": "schema_modifie_colonnes_communes", "message": f"{name}: the schema changed; only common columns are compared.",
            "details": {"colonnes_ajoutees": ",".join(gained), "colonnes_supprimees": ",".join(lost), "colonnes_retypees": ",".join(retyped)},
        })
        layout = ()
        rows_before, rows_after = (in_order(t.rows).select(*[f"`{c}`" for c in columns], ORD) for t in (before, after))
        key = new.primary_key if new.primary_key == old.primary_key and set(new.primary_key) <= set(columns) else ()
    found = None

    def by_key(own: list[str], key_type: str, in_place: bool = False) -> DataFrame | None:
        if in_place or rows_before.isEmpty() or rows_after.isEmpty():
            unique = is_unique(rows_before, own) and is_unique(rows_after, own)
            return keyed_diff(name, rows_before, rows_after, columns, own, key_type, in_place) if unique else None
        differ = changed_keys(rows_before, rows_after, columns, own)
        return None if differ is None else keyed_diff(name, rows_before, rows_after, columns, own, key_type, differ=differ)

    if key:  # a declared key that isn't unique doesn't hand over to a candidate
        found = by_key(list(key), PRIMARY, layout == tuple(key))
    elif candidate_key and set(candidate_key) <= set(columns):
        found = by_key(list(candidate_key), CANDIDATE)
        if found is not None:
            if (most := max(before.n_rows, after.n_rows)) < SMALL_TABLE:
                warnings.append({"table": name, "code": "cle_candidate_petite_table", "message": f"{name}: the candidate key was found on {most} rows only.", "details": {"nb_lignes": str(most)}})
    if found is None:
        by_row = layout == tuple(PRINTS)
        bags = (before.stored, after.stored) if by_row else (rows_before, rows_after)
        found, warning = probable_updates(bag_diff(name, *bags, columns, by_row), columns, name, cap)
        warnings += [warning] if warning else []
    return found, schema_change, warnings


def diff_snapshots(spark: SparkSession, before: Snapshot, after: Snapshot, candidate_keys=None, noise_tables=(), cap: int | None = PAIRING_CAP) -> DiffResult:
    """Tables that are equal in count and fingerprint aren't read. Changes of noise tables (named in any case) go to `noise`; their warnings stay."""
    noisy = {n.lower() for n in noise_tables}
    found, noise, schema, warnings = [], [], [], []
    for name in sorted(before.tables.keys() | after.tables.keys()):
        old, new = before.tables.get(name), after.tables.get(name)
        change = None
        if old is None or new is None:
            rows = _whole_table(new or old, "insert" if old is None else "delete", "")
            change = {"table": name, "change": "table_ajoutee" if old is None else "table_supprimee", "before": _describe(old.table) if old else [], "after": _describe(new.table) if new else []}
        elif (old.fingerprint, old.n_rows) == (new.fingerprint, new.n_rows) and old.table.signature() == new.table.signature():
            continue
        else:
            rows, change, more = diff_table(old, new, (candidate_keys or {}).get(name), cap)
            warnings += more
        schema += [change] if change else []
        (noise if name.lower() in noisy else found).append(rows)
    whole = lambda parts: reduce(DataFrame.unionByName, parts) if parts else _empty(spark)
    return DiffResult(whole(found), whole(noise), schema, warnings)


def summary(changes: DataFrame) -> DataFrame:
    """table, added, modified, deleted and a sentence with plural forms."""
    counts = changes.groupBy("table").agg(
        F.count_if(F.col("op").isin("insert", "row_added")).alias("added"), F.count_if(F.col("op").isin("update", "probable_update")).alias("modified"),
        F.count_if(F.col("op").isin("delete", "row_removed")).alias("deleted"),
    )
    part = lambda c, one, many: F.when(F.col(c) > 0, F.concat(F.col(c).cast("string"), F.lit(" "), F.when(F.col(c) > 1, many).otherwise(one)))
    text = F.concat_ws(", ", part("added", "ligne ajoutée", "lignes ajoutées"), part("modified", "ligne modifiée", "lignes modifiées"), part("deleted", "ligne supprimée", "lignes supprimées"))
    return counts.withColumn("summary", text)
