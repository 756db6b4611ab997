"""Diffs, profiles, links and hypotheses on small tables with known outcomes."""

import unicodedata
from datetime import date, datetime
from decimal import Decimal as M

import pytest
from pyspark.sql import functions as F

from deltascope.functions import canonical as K
from deltascope.functions.matching import amount, one_edit_apart, typed_day
from deltascope.operators import cells as C
from deltascope.operators import diff as D
from deltascope.operators import hypotheses as H
from deltascope.operators import links as L
from deltascope.operators import profile as P
from deltascope.operators import snapshot as S
from deltascope.plans import pipeline, trace
from deltascope.sources.catalog import FrameSource, Table, select_only

DAY = datetime(2024, 1, 15, 10)


def table(spark, rows, ddl, key=(), name="T"):
    return Table(name, spark.createDataFrame(rows, ddl), tuple(key))


def texts(spark, rows, ddl):
    t = table(spark, rows, ddl)
    return [tuple(r) for r in S.canonical_rows(t).collect()]


def changes_of(spark, before, after, ddl, key=(), candidate=None, cap=D.PAIRING_CAP):
    take = lambda rows: S.take_table(table(spark, rows, ddl, key))
    return D.diff_table(take(before), take(after), candidate, cap)


def ops(changes):
    return {r.op: r["count"] for r in changes.groupBy("op").count().collect()}


# Canonical text


def test_types_are_part_of_a_value(spark):
    row = texts(spark, [(1, "1", M("1.00"), True, 1.5, date(2024, 1, 1), datetime(2024, 1, 1), datetime(2024, 1, 1, 2, 3, 4, 5), bytearray(b"x"), None, "")], "a int, b string, c decimal(9,2), d boolean, e double, f date, g timestamp_ntz, h timestamp_ntz, i binary, j int, k string")[0]
    assert row[:8] == ("I:1", "T:1", "M:1.00", "L:1", "F:1.5", "J:2024-01-01", "D:2024-01-01T00:00:00", "D:2024-01-01T02:03:04.000005")
    assert row[8].startswith("B:") and row[9:] == ("N:", "T:") and len(set(row)) == len(row)


def test_text_is_nfc_and_not_trimmed(spark):
    rows = texts(spark, [("e\u0301",), ("é",), ("ACH",), ("ACH ",)], "a string")
    assert rows[0] == rows[1] == (f"T:{unicodedata.normalize('NFC', 'é')}",) and rows[2] != rows[3]


def test_nested_columns_have_texts(spark):
    kinds = "a array<string>, b struct<x: int, y: array<double>>, c map<string,int>, d interval day to second"
    rows = [(["a,b", None, "c\\"], (1, [1.5]), {"k": 1, "j": 2}, None), (["a", "b", None, "c\\"], (None, []), {"j": 2, "k": 1}, None), (["e\u0301"], None, {}, None), (["é"], None, None, None), ([], None, None, None), ([""], None, None, None)]
    t = table(spark, rows, kinds)
    assert t.columns == ["a", "b", "c"] and t.skipped == ["d"]
    found = [tuple(r[c] for c in t.columns) for r in S.canonical_rows(t).collect()]
    assert found[0] == ("A:T:a\\,b,N:,T:c\\\\", "S:I:1,A:F:1.5", "K:T:j,I:2,T:k,I:1") and found[1][1:] == ("S:N:,A:", found[0][2])
    assert len({r[0] for r in found}) == 5 and found[2][0] == found[3][0] and found[3][1:] == ("N:", "N:")
    with pytest.raises(TypeError):
        K.canonical(F.col("d"), t.kind("d"))
    profile = {r.column: r for r in P.column_profile(t).collect()}
    assert (profile["a"].n_distinct, profile["b"].n_nulls, profile["c"].min) == (5, 4, None)


def test_an_update_of_one_element_is_a_field_change(spark):
    old, new = (table(spark, [(1, [1.0, 2.0]), (2, [x, 4.0])], "a int, b array<double>") for x in (3.0, 3.5))
    found = D.field_changes(D.keyed_diff("T", S.snapshot_of(old).rows, S.snapshot_of(new).rows, ["a", "b"], ["a"], D.PRIMARY)).collect()
    assert [(r.column, r.before, r.after) for r in found] == [("b", "A:F:3.0,F:4.0", "A:F:3.5,F:4.0")]


def test_fingerprints(spark):
    fp = lambda rows: [r.fingerprint for r in S.with_fingerprint(S.canonical_rows(table(spark, rows, "a string, b string")), ["a", "b"]).collect()]
    assert len(set(fp([("ab", "c"), ("a", "bc"), ("a", None), (None, "a")]))) == 4
    whole = lambda rows, f: f(S.canonical_rows(table(spark, rows, "a string, b string")), ["a", "b"]).first().fingerprint
    for f in (S.exact_table_fingerprint, S.table_digest):
        assert whole([("a", "b"), ("c", "d")], f) == whole([("c", "d"), ("a", "b")], f) != whole([("a", "b"), ("c", "d"), ("c", "d")], f)


# Differences


def test_keyed_changes(spark):
    ddl = "ID int, M decimal(9,2), T string"
    got, schema, warnings = changes_of(spark, [(1, M("10.00"), "TEST"), (2, M("5.00"), "x"), (4, None, None)], [(1, M("25.50"), "TEST "), (3, M("1.00"), "y"), (4, None, "")], ddl, ["ID"])
    assert ops(got) == {"insert": 1, "update": 2, "delete": 1} and schema is None and warnings == []
    fields = {(r.key["ID"], r.column, r.before, r.after) for r in D.field_changes(got).collect()}
    assert fields == {("I:1", "M", "M:10.00", "M:25.50"), ("I:1", "T", "T:TEST", "T:TEST "), ("I:4", "T", "N:", "T:")}


def test_null_keys_are_equal_and_count_for_uniqueness(spark):
    assert ops(changes_of(spark, [(None, "a")], [(None, "b")], "ID int, A string", ["ID"])[0]) == {"update": 1}
    assert "update" not in ops(changes_of(spark, [(None, "a"), (None, "b")], [(None, "c"), (None, "d")], "ID int, A string", ["ID"])[0])


def test_keyless_copies(spark):
    ddl = "A string, B int, C int"
    assert ops(changes_of(spark, [("a", 1, 1)] * 2, [("a", 1, 1)] * 3, ddl)[0]) == {"row_added": 1}
    assert ops(changes_of(spark, [("a", 1, 1)], [("b", 2, 2)], ddl)[0]) == {"row_added": 1, "row_removed": 1}
    assert ops(changes_of(spark, [("a", 1, 1)], [("a", 1, 2)], ddl)[0]) == {"probable_update": 1}
    assert ops(changes_of(spark, [("a", 1)], [("b", 2)], "A string, B int")[0]) == {"probable_update": 1}


def test_pairing_takes_the_nearest_and_stops_at_the_cap(spark):
    ddl = "A string, B int, C int, D int"
    before, after = [("a", 1, 1, 1), ("a", 1, 2, 2)], [("a", 1, 2, 9)]
    got, _, _ = changes_of(spark, before, after, ddl)
    pair = got.filter("op = 'probable_update'").first()
    assert pair.before["C"] == "I:2" and ops(got) == {"probable_update": 1, "row_removed": 1}
    rows = [(str(i), i, i, i) for i in range(3)], [(str(i), i, i, -1) for i in range(5)]
    got, _, warnings = changes_of(spark, *rows, ddl, cap=3)
    assert "probable_update" not in ops(got) and warnings[0]["code"] == "appariement_plafond_atteint"
    assert warnings[0]["details"] == {"lignes_ajoutees_non_appariees": "5", "lignes_supprimees_non_appariees": "3"}


@pytest.mark.parametrize(("n", "warned"), [(3, True), (49, True), (50, False)])
def test_candidate_keys_on_small_tables(spark, n, warned):
    rows = [(i, "a") for i in range(n)]
    got, _, warnings = changes_of(spark, rows, [*rows[:-1], (n - 1, "b")], "ID int, A string", candidate=("ID",))
    assert ops(got) == {"update": 1} and got.first().key_type == "candidate" and bool(warnings) == warned


def test_broken_keys_fall_back_to_bags(spark):
    got, _, _ = changes_of(spark, [(1, "a", 1)], [(1, "a", 1), (1, "b", 7)], "ID int, A string, B int", candidate=("ID",))
    assert {r.key_type for r in got.collect()} == {"aucune"}
    got, _, _ = changes_of(spark, [(1, "a", 1)], [(1, "a", 1), (1, "b", 7)], "ID int, A string, B int", key=("ID",), candidate=("A",))
    assert {r.key_type for r in got.collect()} == {"aucune"}


def test_schema_changes_compare_common_columns(spark):
    old = S.take_table(table(spark, [(1, "a", 5)], "ID int, A string, X int", ["ID"]))
    new = S.take_table(table(spark, [(1, "b", 7), (2, "c", 8)], "ID int, A string, Y int", ["ID"]))
    got, schema, warnings = D.diff_table(old, new)
    assert ops(got) == {"update": 1, "insert": 1} and schema["change"] == "colonnes_modifiees"
    assert warnings[0]["details"] == {"colonnes_ajoutees": "Y", "colonnes_supprimees": "X", "colonnes_retypees": ""}


def test_tables_that_come_and_go_and_noise(spark):
    t = lambda rows, name, key=(): S.take_table(table(spark, rows, "ID int, A string", key, name))
    before = S.Snapshot({"OLD": t([(1, "a")], "OLD", ["ID"]), "SAME": t([(1, "a")], "SAME"), "Noise": t([(1, "a")], "Noise", ["ID"])})
    after = S.Snapshot({"NEW": t([(1, "a"), (2, "b")], "NEW"), "SAME": t([(1, "a")], "SAME"), "Noise": t([(1, "b")], "Noise", ["ID"])})
    result = D.diff_snapshots(spark, before, after, noise_tables=["NOISE"])
    assert {(r["table"], r.op) for r in result.changes.collect()} == {("OLD", "delete"), ("NEW", "row_added")}
    assert {(c["table"], c["change"]) for c in result.schema_changes} == {("OLD", "table_supprimee"), ("NEW", "table_ajoutee")}
    assert [tuple(r) for r in D.summary(result.noise).collect()] == [("Noise", 0, 1, 0, "1 ligne modifiée")]
    assert D.diff_snapshots(spark, before, before).changes.isEmpty()


def sequential(before, after):
    """Added and removed copies, then pairs, one row after the other as they stand in the source."""
    left = {}
    for r in before:
        left[r] = left.get(r, 0) + 1
    added = []
    for r in after:
        if left.get(r, 0):
            left[r] -= 1
        else:
            added.append(r)
    left = {}
    for r in after:
        left[r] = left.get(r, 0) + 1
    removed = []
    for r in before:
        if left.get(r, 0):
            left[r] -= 1
        else:
            removed.append(r)
    pairs = []
    for a in list(added):
        found = min(((sum(x != y for x, y in zip(a, r)), k) for k, r in enumerate(removed)), default=(9, 0))
        if found[0] <= 2:
            pairs.append((removed.pop(found[1]), a))
            added.remove(a)
    return sorted(pairs), sorted(added), sorted(removed)


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("cap", [D.PAIRING_CAP, None])
def test_pairs_follow_the_source_order(spark, seed, cap):
    import random

    rng = random.Random(seed)
    made = lambda n: [tuple(rng.randrange(3) for _ in range(4)) for _ in range(n)]
    before, after = made(40), made(45)
    got = changes_of(spark, before, after, "a int, b int, c int, d int", cap=cap)[0].collect()
    row = lambda m: tuple(int(m[c][2:]) for c in "abcd")
    of = lambda op, f: sorted(f(r) for r in got if r.op == op)
    want = sequential(before, after)
    assert of("probable_update", lambda r: (row(r.before), row(r.after))) == want[0] and want[0]
    assert of("row_added", lambda r: row(r.after)) == want[1] and of("row_removed", lambda r: row(r.before)) == want[2]


def test_diffs_compare_hashes_before_rows(spark):
    """Plans: the signed sum is a hash aggregate, and what is shuffled to compare carries no text."""
    rows = [(i, f"text {i}") for i in range(50)]
    b, a = (S.canonical_rows(table(spark, r, "ID int, T string")) for r in (rows, rows[1:]))
    plan = D.bag_diff("T", b, a, ["ID", "T"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate(keys=[__f1" in plan and "SortAggregate" not in plan
    assert D.keyed_diff("T", b, a, ["ID", "T"], ["ID"], D.PRIMARY).count() == 1


def test_many_copies_of_one_row(spark):
    same = spark.range(5000).selectExpr("'x' AS A", "1 AS B", "2 AS C").repartition(7)
    b, a = S.canonical_rows(Table("T", same.limit(1200))), S.canonical_rows(Table("T", same))
    got = D.bag_diff("T", b, a, ["A", "B", "C"])
    assert ops(got) == {"row_added": 3800} and got.select("row_id").distinct().count() == 3800


def test_applying_a_diff_gives_the_second_snapshot(spark):
    ddl = "A int, B string, C int"
    before, after = [(i % 5, str(i % 3), i % 2) for i in range(30)], [(i % 5, str(i % 4), i % 2) for i in range(34)]
    b, a = (S.canonical_rows(table(spark, rows, ddl)) for rows in (before, after))
    got = D.bag_diff("T", b, a, ["A", "B", "C"])
    side = lambda op, col: got.filter(F.col("op") == op).select(*[F.element_at(col, F.lit(c)).alias(c) for c in "ABC"])
    applied = b.exceptAll(side("row_removed", "before")).unionAll(side("row_added", "after"))
    assert applied.exceptAll(a).isEmpty() and a.exceptAll(applied).isEmpty()


def test_ignored_tables_in_any_case(spark):
    source = FrameSource(spark, {"Keep": spark.range(3).toDF("a"), "Skip": spark.range(3).toDF("a"), "MSysX": spark.range(1).toDF("a")})
    snap = S.take_snapshot(source, ["SKIP"])
    assert list(snap.tables) == ["Keep"] and snap.n_rows == 3


# Profiles


def profile_of(spark, tables, keys=None):
    return P.profile(FrameSource(spark, tables, keys))


def test_profile_of_invoices(spark):
    clients = spark.range(20).selectExpr("id + 101 AS ID", "concat('NOM', id) AS NOM", "concat('C', id + 101) AS CODE")
    invoices = spark.range(200).selectExpr(
        "id + 1001 AS NUM", "id % 20 + 101 AS CLIENT_ID", "concat('C', id % 20 + 101) AS CODE_CLIENT", "cast(id + 1001 AS string) AS NUM_TEXTE", "cast(id + 1001.37 AS decimal(12,2)) AS MONTANT",
        "date_add(date '2024-01-01', cast(id % 10 AS int)) AS DATE_F", "if(id % 2 = 0, 'P', 'E') AS STATUT", "if(id % 4 = 0, NULL, 'x') AS NOTE")
    lines = spark.range(400).selectExpr("id div 2 + 1001 AS NUM_FACT", "id % 2 + 1 AS RANG", "concat('R', id div 2 % 7) AS REF", "id div 2 % 5 AS QTE")
    found = profile_of(spark, {"CLIENTS": clients, "FACTURES": invoices, "LIGNES": lines}, {"CLIENTS": ("ID",), "FACTURES": ("NUM",)})
    cols = {(r["table"], r.column): r for r in found.columns.collect()}
    note, total = cols["FACTURES", "NOTE"], cols["FACTURES", "MONTANT"]
    assert (note.n_nulls, str(note.pct_nulls), total.min, total.max, cols["FACTURES", "DATE_F"].n_distinct) == (50, "25.00", "1001.37", "1200.37", 10)
    assert found.keys["FACTURES"] == [("NUM",), ("NUM_TEXTE",)] and found.keys["LIGNES"] == [("NUM_FACT", "RANG")]
    strong = {(r.src_table, r.src_column, r.dst_table, r.dst_column) for r in found.relations.filter("confidence = 'normale'").collect()}
    assert {("FACTURES", "CLIENT_ID", "CLIENTS", "ID"), ("FACTURES", "CODE_CLIENT", "CLIENTS", "CODE"), ("LIGNES", "NUM_FACT", "FACTURES", "NUM")} <= strong
    assert found.first_keys() == {"LIGNES": ("NUM_FACT", "RANG")}


def test_distinct_numbers_are_told_apart(spark):
    values = [1e-11, 2e-11, 3e-12, 1e30, 1e30 + 2e14, 0.5, -0.0, 0.0, float("nan"), 123456789.0, 1.5e300]
    frame = spark.createDataFrame([(v,) for v in values], "D double")
    assert P.column_profile(Table("T", frame)).first().n_distinct == 10  # 0.0 and -0.0 are one
    texts = [r[0] for r in frame.select(K.exact_number(F.col("D").cast("string"))).collect()]
    assert texts[:4] == ["0.00000000001", "0.00000000002", "0.000000000003", "1" + "0" * 30] and texts[5:8] == ["0.5", "0", "0"] and texts[9] == "123456789"
    same = spark.range(1).select(*[K.exact_number(F.lit(t)) for t in ("5", "5.00", "5.0", "5.0E0", "-1.50", "-1.5E0", "1.25E3", "0E-18", "1.2345E2")]).first()
    assert tuple(same) == ("5", "5", "5", "5", "-1.5", "-1.5", "1250", "0", "123.45")
    view = spark.range(1).select(*[K.number(F.lit(t)).cast("string") for t in ("F:0.12345678901", "M:0.1234567890", "F:1.0E30", "I:7", "F:1.0E-11", "F:2.5E3")]).first()
    assert tuple(view) == (None, "0.1234567890", None, "7.0000000000", None, "2500.0000000000")


def test_key_exclusions_and_order(spark):
    rows = spark.range(5).selectExpr("concat('t', id) AS TXT", "cast(id AS decimal(9,2)) AS D", "cast(id AS double) AS R", "date_add(date '2024-01-01', cast(id AS int)) AS J", "repeat(cast(id AS string), 300) AS LONG", "id AS ENT")
    assert profile_of(spark, {"T": rows}).keys["T"] == [("ENT",), ("TXT",)]
    pairs = spark.range(4).selectExpr("concat('x', id) AS T1", "id % 2 AS A", "id div 2 AS B")
    assert profile_of(spark, {"T": pairs}).keys["T"] == [("A", "B"), ("T1",)] or profile_of(spark, {"T": pairs}).keys["T"] == [("T1",), ("A", "B")]
    assert profile_of(spark, {"T": spark.range(1).toDF("a")}).keys["T"] == [] and profile_of(spark, {"T": spark.range(0).toDF("a")}).keys["T"] == []


@pytest.mark.parametrize(("orphans", "kept"), [(1, True), (2, False)])
def test_relations_allow_one_percent(spark, orphans, kept):
    parent = spark.range(50).toDF("ID")
    child = spark.range(100).selectExpr(f"cast(if(id < {orphans}, 9000 + id, id % 50) AS decimal(9,2)) AS FK", "id AS N")
    found = profile_of(spark, {"P": parent, "E": child}).relations.filter("src_column = 'FK' AND dst_table = 'P'").collect()
    assert [str(r.inclusion_rate) for r in found] == (["0.9900"] if kept else [])


def test_weak_relations_and_distinct_rates(spark):
    parent = spark.range(50).toDF("ID")
    two = spark.range(10).selectExpr("id % 2 AS FK")
    skewed = spark.range(1002).selectExpr("if(id < 1000, 1, 8000 + id) AS FK")
    found = {r.src_table: r for r in profile_of(spark, {"P": parent, "TWO": two, "SKEW": skewed}).relations.filter("dst_table = 'P'").collect()}
    assert found["TWO"].confidence == "faible"
    assert (str(found["SKEW"].inclusion_rate), str(found["SKEW"].inclusion_rate_distinct)) == ("0.9980", "0.3333")


# Links


@pytest.mark.parametrize(("kind", "value", "cell", "expected"), [
    ("montant", "1 234,56", "M:1234.56", "exacte"), ("montant", "1\u00a0234,56", "M:1234.5600", "exacte"), ("montant", "1234.56", "M:-1234.56", "signe_inverse"), ("montant", "1234,56", "I:123456", "x100"), ("montant", "1234,56", "M:12.3456", "div100"),
    ("montant", "500", "I:500", "exacte"), ("montant", "0", "M:0.00", "exacte"), ("montant", "1234.56", "T:1234.56", None), ("montant", "1", "L:1", None), ("montant", "7", "F:7.0", "exacte"),
    ("date", "15/01/2024", "D:2024-01-15T00:00:00", "exacte"), ("date", "2024-01-15", "J:2024-01-15", "exacte"), ("date", "15-01-2024", "T:15.01.2024", "exacte"), ("date", "15.1.2024", "D:2024-01-15T00:00:01", "date_heure"), ("date", "15/01/2024", "J:2024-01-16", None),
    ("code", "6111", "I:6111", "exacte"), ("code", "6111", "M:6111.00", "exacte"), ("code", "0042", "I:42", None), ("code", "0042", "T:0042", "exacte"), ("code", "6111", "T:6111  ", "espaces_fin"),
    ("texte", "Test-S003", "T:Test-S003", "exacte"), ("texte", "Test-S003", "T:Test-S003 ", "espaces_fin"), ("texte", "Test-S003", "T:TEST-S003", "majuscules"), ("texte", "Test-S003", "T:Test-S", "tronque"),
    ("texte", "Test-S003", "T:Te", None), ("texte", "Test-S003", "T: Test-S003", None), ("texte", "Test-S003", "T:Test-S003\t", None), ("texte", "e\u0301t\u00e9", "T:\u00e9t\u00e9", "exacte"), ("texte", "abc", "N:", None),
])
def test_match_types(spark, kind, value, cell, expected):
    inputs = spark.createDataFrame([(1, "f", "s", value, kind)], L.INPUTS)
    cells = spark.createDataFrame([("T", 1, "C", True, cell, None, {})], "table string, row_id long, column string, is_insert boolean, value string, before string, row map<string,string>")
    assert [r.match_type for r in L.matches(inputs, cells).collect()] == ([expected] if expected else [])


def test_reading_what_was_typed(spark):
    row = spark.range(1).select(*[amount(F.lit(x)).cast("string") for x in ("1.234,56", "abc", "-1 000", "NaN")], *[typed_day(F.lit(x)).cast("string") for x in ("31/02/2024", " 1/2/2024 ", "2024-1-2")]).first()
    assert row[0] is None and row[1] is None and row[2].startswith("-1000") and row[3] is None and row[4:] == (None, "2024-02-01", "2024-01-02")


@pytest.mark.parametrize(("a", "b", "near"), [("abcd", "abdc", True), ("abcd", "abcd", True), ("abcd", "abc", True), ("abcd", "abxd", True), ("abcd", "badc", False), ("abcd", "dcba", False), ("", "", True), ("", "a", True), ("a", "b", True), ("ab", "ba", True), ("", "ab", False)])
def test_one_edit(spark, a, b, near):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(one_edit_apart(F.col("a"), F.col("b"))).first()[0] is near


# Hypotheses


def cells_of(spark, before, after, ddl, key=("ID",), name="T"):
    b, a = table(spark, before, ddl, key, name), table(spark, after, ddl, key, name)
    old, new = S.canonical_rows(b), S.canonical_rows(a)
    changes = D.keyed_diff(name, old, new, b.columns, list(key), D.PRIMARY)
    cells = C.extract_cells(changes)
    context = H.Context(changes, cells, spark.createDataFrame([], L.INPUTS), DAY, datetime(2024, 1, 15, 12), {name: old})
    return cells, context


def hits(test, cells, context):
    return {(r.column, r.detail) for r in test(cells, context).collect()}


@pytest.mark.parametrize(("before", "new", "hit"), [([1, 2, 3], [4], True), ([10, 20, 30], [40], True), ([10, 20, 30], [35], False), ([1, 2, 100], [101, 102, 103], True), ([1, 2, 3], [9], False)])
def test_counters(spark, before, new, hit):
    cells, context = cells_of(spark, [(i,) for i in before], [(i,) for i in before + new], "ID int")
    assert hits(H.counter, cells, context) == ({("ID", f"max avant = {max(before)}")} if hit else set())


@pytest.mark.parametrize(("new", "hit"), [("ACH-0100", True), ("ACH-100", False), ("ACH-0102", False), ("VTE-0100", False)])
def test_code_counters(spark, new, hit):
    cells, context = cells_of(spark, [(1, "ACH-0099")], [(1, "ACH-0099"), (7, new)], "ID int, C string")
    assert ("C" in {c for c, _ in hits(H.counter, cells, context)}) is hit


def test_details_of_updated_counters(spark):
    cells, context = cells_of(spark, [(1, 41, "ACH-0099")], [(1, 42, "ACH-0100")], "ID int, N int, C string")
    assert hits(H.counter, cells, context) == {("N", "41 → 42"), ("C", "ACH-0099 → ACH-0100")}


@pytest.mark.parametrize(("after", "n"), [([6, 7, 3], 2), ([6, 2, 3], 0), ([2, 2, 3], 1)])
def test_updated_counters(spark, after, n):
    cells, context = cells_of(spark, [(i, v) for i, v in enumerate([1, 2, 3])], list(enumerate(after)), "ID int, N int")
    assert H.counter(cells, context).count() == n


def test_system_times(spark):
    stamps = [datetime(2024, 1, 15, 9, 58), datetime(2024, 1, 15, 9, 57, 59), datetime(2024, 1, 15), datetime(2024, 1, 16)]
    cells, context = cells_of(spark, [], list(enumerate(stamps)), "ID int, D timestamp_ntz")
    assert {d[:19] for _, d in hits(H.system_time, cells, context)} == {"2024-01-15T09:58:00", "2024-01-15T00:00:00"}


def test_copies_and_constants(spark):
    clients = S.canonical_rows(table(spark, [(1, "ann", "tel1"), (2, "bob", "tel2")], "ID int, NOM string, TEL string"))
    cells, context = cells_of(spark, [], [(9, 2, "tel2", "A"), (10, 1, "tel2", "A")], "ID int, CLIENT int, TEL string, K string", name="F")
    context.before["CLIENTS"] = clients
    context.relations = spark.createDataFrame([("F", "CLIENT", "CLIENTS", "ID", "normale")], "src_table string, src_column string, dst_table string, dst_column string, confidence string")
    assert hits(H.copied, cells, context) == {("TEL", "copie de CLIENTS.TEL (ligne ID = 2)")}
    context.column_profile = P.column_profile(table(spark, [(1, 1, "t", "A"), (2, 2, "u", "A")], "ID int, CLIENT int, TEL string, K string", name="F"))
    assert hits(H.constant, cells, context) == {("K", "valeur constante sur toute la table (A)")}


def test_account_chains(spark):
    accounts = [("6", 1), ("61", 5), ("612", 5), ("61263", 5), ("34", 5), ("345", 7), ("70  ", 5)]
    cells, context = cells_of(spark, [(a, M(0)) for a, _ in accounts], [(a, M(d)) for a, d in accounts], "Compte string, Debit decimal(15,4)", ("Compte",), "compte")
    got = hits(H.hierarchical_total, cells, context)
    assert got == {("Debit", "delta 5 identique sur 3 comptes liés par préfixe : 61, 612, 61263")}


# Pipelines


def test_interpretation_and_re_analysis_agree(spark, tmp_path):
    before = S.Snapshot({"T": S.take_table(table(spark, [(1, M("10.0000"), "a"), (2, M("20.0000"), "b")], "ID int, S decimal(15,4), A string", ["ID"]))})
    after = S.Snapshot({"T": S.take_table(table(spark, [(1, M("1244.5600"), "a"), (2, M("20.0000"), "b"), (3, M("5.0000"), "typed")], "ID int, S decimal(15,4), A string", ["ID"]))})
    result = D.diff_snapshots(spark, before, after)
    values = [{"champ_ecran": "Montant", "ecran": "E", "valeur": "1234,56", "type": "montant"}, {"champ_ecran": "Libelle", "ecran": "E", "valeur": "typed", "type": "texte"}, {"champ_ecran": "Date", "ecran": "E", "valeur": "31/02/2024", "type": "date"}]
    inputs = spark.createDataFrame([(i, v["champ_ecran"], v["ecran"], v["valeur"], v["type"]) for i, v in enumerate(values)], L.INPUTS)
    found = pipeline.interpret(spark, result.changes, before, inputs, DAY, DAY)
    computed = {(r.column, tuple(r.hypotheses)) for r in found.computed.collect()}
    assert computed == {("S", ("cumul_mis_a_jour",)), ("ID", ("compteur",)), ("S", ("inconnu",))}
    assert {r.code for r in found.warnings.collect()} == {"valeur_saisie_invalide", "profil_absent"}
    assert [(r.field, r.kind) for r in found.deviations.collect()] == [("Montant", "introuvable")] and found.has_deviation
    document = trace.build_trace({"id": "S-1", "titre": "t", "valeurs_saisies": values}, {"debut": "2024-01-15T10:00:00", "fin": "2024-01-15T10:01:00", "statut": pipeline.status(False, found)}, {"chemin": "x"}, result, found)
    assert set(document) == {"format_version", "fiche", "execution", "base", "changements", "bruit", "liens", "champs_calcules", "ecarts_saisie", "schema_modifie", "avertissements"}
    folder = trace.write_trace(document, str(tmp_path))
    assert trace.write_trace(document, str(tmp_path)) == folder + "_2"
    again = trace.read_trace(f"{folder}/trace.json")
    assert again == document and "<table>" in trace.render_report(again)
    original = spark.createDataFrame([(c["table"], c["colonne"], trace.typed_text(c["valeur"]), c["hypotheses"], c["details"]) for c in again["champs_calcules"]], "table string, column string, value string, hypotheses array<string>, details string")
    redone = pipeline.reanalyse(spark, trace.changes_from_json(spark, again["changements"]), inputs, DAY, DAY, original)
    flat = lambda df: {(r["table"], r.column, r.value, tuple(r.hypotheses), r.details) for r in df.collect()}
    assert flat(redone.computed) == flat(found.computed)
    assert {tuple(r) for r in redone.links.collect()} == {tuple(r) for r in found.links.collect()}
    assert "non_recalculable_hors_ligne" in {r.code for r in redone.warnings.collect()}
    share = tmp_path / "share"
    assert trace.publish(folder, str(share / "missing" / "x")) in ("pending", "published")
    share.mkdir(exist_ok=True)
    assert trace.publish(folder, str(share)) == trace.publish(folder, str(share)) == "published"
    listed = trace.read_trace_folder(spark, f"file://{tmp_path}").collect()
    assert {r.id for r in listed} == {"S-1"} and len(listed) == 2


def test_calibration(spark):
    turn = {"n": 0}

    def sessions():
        turn["n"] += 1
        return spark.createDataFrame([(1, str(turn["n"]))], "ID int, DERNIER string")

    def journal():
        return spark.createDataFrame([("a",), ("b",)][: 0 if turn["n"] < 2 else 2], "MSG string")

    source = FrameSource(spark, {"SESSIONS": sessions, "JOURNAL": journal, "ECRITURES": spark.range(1).toDF("ID")}, {"SESSIONS": ("ID",)})
    turn["n"] = 0
    found = pipeline.calibrate(source, 0.0, sleep=lambda _: turn.__setitem__("n", 2))
    assert found.proposed == {"JOURNAL": "2 lignes ajoutées", "SESSIONS": "1 ligne modifiée"}
    found.validate(["SESSIONS"])
    assert found.noise == ["SESSIONS"]
    with pytest.raises(ValueError):
        found.validate(["ECRITURES"])


def test_values_survive_json():
    for text in ("N:", "I:5", "M:1234.5600", "D:2024-01-15T10:00:00", "J:2024-01-15", "T:26", "T:12.5", "T:2024-02-30"):
        assert trace.typed_text(trace.json_value(text)) == text


def test_sources_only_read(spark):
    spark.sql("CREATE TABLE IF NOT EXISTS kept (a INT) USING parquet")
    for refused in ("DROP TABLE kept", "WITH a AS (SELECT 1 AS a) INSERT INTO kept SELECT * FROM a", "INSERT INTO kept VALUES (1)", "FROM (SELECT 1 AS a) INSERT INTO kept SELECT a", "/* SELECT */ DROP TABLE kept", "SET a = 1"):
        with pytest.raises(PermissionError):
            select_only(spark, refused)
    assert spark.table("kept").count() == 0
    assert select_only(spark, "SELECT 1 AS a").first().a == 1
    assert select_only(spark, "-- all\nWITH b AS (SELECT * FROM {t}) SELECT count(*) AS n FROM b WHERE id IN (SELECT id FROM {t})", t=spark.range(3)).first().n == 3
    spark.sql("DROP TABLE kept")
    assert trace.mask("key abc abcdef", ["abc", "abcdef"]) == "key *** ***"
