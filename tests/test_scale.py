"""What must hold at any size: plans without a shuffle, joins without hot keys, trees that read only what changed."""

import hashlib
import json
import random
import sqlite3
from collections import Counter
from datetime import datetime
from decimal import Decimal
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from deltascope.functions.canonical import family, family_key, number
from deltascope.functions.matching import deletion_keys, one_edit_apart
from deltascope.operators import diff as D
from deltascope.operators import hypotheses as H
from deltascope.operators import links as L
from deltascope.operators import merkle as M
from deltascope.operators import profile as P
from deltascope.operators import snapshot as S
from deltascope.operators.cells import extract_cells
from deltascope.plans import files, pipeline, trace
from deltascope.sources.catalog import FrameSource, Table
from deltascope.sources.sqlite import SqliteSource
from deltascope.sources.storage import buckets_for, new_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def never_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def two_sides(spark):
    before = spark.range(3000).select("id", (F.col("id") % 7).alias("k"), F.concat(F.lit("t"), F.col("id") % 50).alias("t"))
    after = before.filter("id % 100 <> 3").withColumn("t", F.when(F.col("id") % 90 == 5, "changed").otherwise(F.col("t")))
    after = after.unionByName(spark.range(5000, 5010).select("id", F.lit(1).cast("long").alias("k"), F.lit("new").alias("t")))
    return before, after


def as_set(changes):
    return Counter((r.op, json.dumps(r.before, sort_keys=True), json.dumps(r.after, sort_keys=True)) for r in changes.collect())


@pytest.mark.parametrize("key", [("id",), ()])
def test_stored_snapshots_are_compared_without_a_shuffle(spark, never_broadcast, key):
    frames = two_sides(spark)
    if not key:  # copies, and rows without the key
        frames = [f.select("k", "t") for f in frames]
    paths = [new_path(spark, "test") for _ in frames]
    stored = [S.take_table(Table("T", f, key), p, 8) for f, p in zip(frames, paths, strict=True)]
    found, _, warnings = D.diff_table(*stored, cap=0)
    assert "Exchange" not in plan(found) and "Exchange" not in plan(D.field_changes(found))
    plain = D.diff_table(*[S.snapshot_of(Table("T", f, key)) for f in frames], cap=0)[0]
    assert as_set(found) == as_set(plain) and found.count() > 30
    again = [S.stored_table(Table("T", f, key), p, 8) for f, p in zip(frames, paths, strict=True)]
    assert [(s.n_rows, s.fingerprint) for s in again] == [(s.n_rows, s.fingerprint) for s in stored]
    reopened = D.diff_table(*again, cap=0)[0]
    assert "Exchange" not in plan(reopened) and as_set(reopened) == as_set(plain)
    assert again[0].rows.columns == [*again[0].table.columns, S.ORD]


def test_stored_rows_of_every_type_are_told_apart(spark):
    """Values are shuffled, and texts made where they are written; hashes of values are equal exactly where texts are."""
    ddl = "i int, j int, s string, d double, m decimal(9,2), t timestamp, b boolean, y binary, a array<string>"
    row = (1, None, "e\u0301", 0.0, Decimal("1.50"), datetime(2024, 1, 1, 0, 0, 0, 500000), True, b"x", ["e\u0301"])
    changed = [(None, 1, *row[2:]), (*row[:3], -0.0, *row[4:]), (*row[:7], None, row[8]), (*row[:8], [None]), (*row[:2], None, *row[3:])]
    before = spark.createDataFrame([row, row], ddl)
    after = spark.createDataFrame([(*row[:2], "\u00e9", *row[3:8], ["\u00e9"]), *changed], ddl)  # the first has the same text
    stored = [S.take_table(Table("T", f), new_path(spark, "test"), 3) for f in (before, after)]
    plain = [S.take_table(Table("T", f)) for f in (before, after)]
    assert [s.fingerprint for s in stored] == [s.fingerprint for s in plain]
    found = as_set(D.diff_table(*stored, cap=0)[0])
    assert found == as_set(D.diff_table(*plain, cap=0)[0]) and Counter(op for op, _, _ in found.elements()) == {"row_removed": 1, "row_added": 5}
    ascii_only = [S.take_table(Table("T", spark.createDataFrame([("a",), (t,)], "s string")), new_path(spark, "test"), 3) for t in ("b", "\u00e9")]
    assert Counter(r.op for r in D.diff_table(*ascii_only, cap=0)[0].collect()) == {"row_removed": 1, "row_added": 1}
    # the same declared type over other types: hashes of values say nothing, texts do
    retyped = [S.take_table(Table("T", spark.createDataFrame([(Decimal("1.00"),)], f"m {kind}"), (), {"m": "MONEY"}), new_path(spark, "test"), 3) for kind in ("decimal(9,2)", "decimal(20,2)")]
    assert D.diff_table(*retyped, cap=0)[0].count() == 0


def test_values_and_not_texts_are_shuffled_into_buckets(spark, monkeypatch):
    dealt, frame = [], type(spark.range(0))
    repartition = frame.repartition
    monkeypatch.setattr(frame, "repartition", lambda df, *by: dealt.append(df.dtypes) or repartition(df, *by))
    S.take_table(Table("T", spark.range(10).selectExpr("id", "CAST(id AS DECIMAL(18,2)) AS m")), new_path(spark, "test"), 3)
    assert dealt == [[("id", "bigint"), ("m", "decimal(18,2)"), (S.ORD, "bigint")]]
    assert [buckets_for(n) for n in (0, 8_000_000, 8_000_001, 216_000_000)] == [16, 16, 17, 432]


def test_changed_rows_are_fetched_without_shuffling_the_others(spark):
    before, after = (S.snapshot_of(Table("T", f, ("id",))) for f in two_sides(spark))
    changes = D.keyed_diff("T", before.rows, after.rows, ["id", "k", "t"], ["id"], D.PRIMARY)
    steps = [line for line in plan(changes).splitlines() if "Exchange" in line or "Join" in line]
    # both sides' rows meet the few keys in a broadcast join; what is shuffled afterwards are changed rows only
    assert sum("BroadcastHashJoin" in line for line in steps) >= 2
    assert "FullOuter" not in plan(changes)
    empty = D.keyed_diff("T", before.rows, before.rows, ["id", "k", "t"], ["id"], D.PRIMARY)
    assert empty.count() == 0


def test_deletion_keys_meet_for_one_edit(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(600):
        a = "".join(rng.choices("abc1é\U0001f600", k=rng.randrange(0, 9)))
        i = rng.randrange(len(a) + 1)
        b = rng.choice([a[:i] + "x" + a[i:], a[:i] + a[i + 1 :], a[:i] + "y" + a[i + 1 :], a[:i] + a[i + 1 : i + 2] + a[i : i + 1] + a[i + 2 :], "".join(rng.choices("abc1", k=rng.randrange(0, 5)))])
        rows.append((a, b))
    rows += [("x" * 5000 + "a", "x" * 5000 + "b"), ("", "")]
    found = spark.createDataFrame(rows, "a string, b string").select("a", "b", one_edit_apart(F.col("a"), F.col("b")).alias("near"), (F.size(F.array_intersect(deletion_keys("a"), deletion_keys("b"))) > 0).alias("met"), F.size(deletion_keys("a")).alias("n")).collect()
    assert all(r.met for r in found if r.near) and sum(r.near for r in found) > 300
    assert all(r.n <= len(r.a) + 1 for r in found)
    assert sum(not r.met for r in found) > 30
    assert spark.range(1).select(deletion_keys(F.lit(None).cast("string")).alias("k")).first().k is None


def test_deviations_of_many_inputs_under_one_field(spark):
    """As many inputs as cells under one field: joined rows stay in proportion."""
    n = 4000
    codes = [f"C{i * 7919 % 1_000_003:06d}" for i in range(n)]
    cells = spark.createDataFrame([("T", i, "c", True, f"T:{c}", None, {"c": f"T:{c}"}, i) for i, c in enumerate(codes)], "table string, row_id long, column string, is_insert boolean, value string, before string, row map<string,string>, ord long")
    typed = [codes[0], *[c[:3] + c[4] + c[3] + c[5:] for c in codes[1:]]]
    inputs = spark.createDataFrame([(i, "F", "S", c, "code") for i, c in enumerate(typed)], L.INPUTS)
    found = L.matches(inputs, cells)
    rows = L.deviations(inputs, cells, found).collect()
    linked = {r.input_id for r in found.collect()}
    explained = {r.row_id for r in found.collect()}

    def near(a, b):
        if len(a) != len(b):
            return False
        off = [i for i in range(len(a)) if a[i] != b[i]]
        return len(off) == 1 or len(off) == 2 and off[1] == off[0] + 1 and a[off[0]] == b[off[1]] and a[off[1]] == b[off[0]]

    by_digits = {}
    for i, c in enumerate(codes):
        if i not in explained:
            for j in range(7):
                by_digits.setdefault((j, c[:j] + c[j + 1 :]), []).append(i)
            by_digits.setdefault("".join(sorted(c)), []).append(i)
    want = Counter()
    for i, c in enumerate(typed):
        if i not in linked:
            around = sorted({k for j in range(7) for k in by_digits.get((j, c[:j] + c[j + 1 :]), [])} | set(by_digits.get("".join(sorted(c)), [])))
            hit = next((k for k in around if near(c, codes[k])), None)
            want[c, codes[hit] if hit is not None else None] += 1
    assert Counter((r.expected, r.found) for r in rows) == want and sum(x[1] is not None for x in want) > 2000


def test_merkle_tree(spark):
    before, after = two_sides(spark)
    one = before.withColumn("t", F.when(F.col("id") == 1234, "x").otherwise(F.col("t")))
    snapshots = [S.snapshot_of(Table("T", f, ("id",))) for f in (before, one, after, before.repartition(5), before.limit(0))]
    trees = [M.store(s, depth=2) for s in snapshots]
    assert trees[0].root() == trees[3].root() != trees[1].root() and trees[0].root()[0] == 3000 and trees[4].root() == (0, "")
    assert M.differing(trees[0], trees[3]).count() == 0
    leaves = [r.prefix for r in M.differing(trees[0], trees[1]).collect()]
    assert 1 <= len(leaves) <= 2  # the old row's leaf and the new one's
    parts = M.changed_parts(trees[0], trees[1])
    assert all(p.count() < 3000 * 2 * 4 / 256 for p in parts)
    folders = {r[0] for r in trees[0].rows.filter(F.col(M.FOLDER).isin([x[0] for x in leaves])).select(F.input_file_name()).distinct().collect()}
    assert len(folders) <= 2 * max(1, len({x[0] for x in leaves}))
    for pair in ((0, 1), (0, 2), (0, 4), (4, 2)):
        whole = D.keyed_diff("T", *[snapshots[i].rows for i in pair], ["id", "k", "t"], ["id"], D.PRIMARY)
        small = D.keyed_diff("T", *M.changed_parts(*[trees[i] for i in pair]), ["id", "k", "t"], ["id"], D.PRIMARY)
        assert as_set(whole) == as_set(small)
    bags = [S.snapshot_of(Table("T", f.select("k", "t"))) for f in (before, before.unionByName(before.limit(3)))]
    bag_trees = [M.store(s, depth=1) for s in bags]
    assert as_set(D.bag_diff("T", *M.changed_parts(*bag_trees), ["k", "t"])) == as_set(D.bag_diff("T", *[s.rows for s in bags], ["k", "t"]))
    with pytest.raises(ValueError):
        M.differing(bag_trees[0], trees[0])
    assert [M.depth_for(n) for n in (0, 4096 * 16, 4096 * 16 + 1, 10**12)] == [1, 1, 2, 7]


def test_values_are_counted_as_they_are_stored(spark):
    """Texts of numbers and moments are made of the different values, after they were counted."""
    rows = [(1, 1.5, 2.5, "2024-01-01 00:00:00", True, "x"), (1, -0.0, 1e-5, "2024-01-01 00:00:00", False, "y" * 70), (2, 0.0, 1e300, None, None, None), (None, float("nan"), 0.1, "2024-01-01 00:00:00.5", True, "1")]
    frame = spark.createDataFrame(rows, "i int, d double, e double, t string, b boolean, s string").select("i", "d", F.col("e").cast("float").alias("f"), F.col("t").cast("timestamp").alias("t"), "b", "s", F.col("i").cast("decimal(9,2)").alias("m"), F.to_date("t").alias("j"))
    table = Table("t", frame)
    want = Counter((c, family(table.kind(c)), k[0]) for c in table.columns for k in frame.select(family_key(F.col(c), table.kind(c))).collect() if k[0] is not None)
    below = plan(P.value_counts(table)).split("partial_count", 1)[1]
    assert "regexp_replace" not in below and "date_format" not in below
    assert {(r.column, r.family, r.key): r.n for r in P.value_counts(table).collect()} == want


def test_keys_alone_count_columns_that_may_be_keys(spark, monkeypatch):
    frame = spark.range(300).selectExpr("id DIV 10 AS a", "id % 10 AS b", "CAST(id AS DOUBLE) AS d", "repeat('x', 300) || id AS long", "CAST(id AS STRING) AS s", "nullif(id, 5) AS n")
    tables = [Table("t", frame), Table("one", frame.limit(1)), Table("none", frame.limit(0))]
    assert P.table_keys(tables) == P.profile_tables(tables)[2] == {"t": [("a", "b"), ("s",)], "one": [], "none": []}
    counted, count = [], P.value_counts
    monkeypatch.setattr(P, "value_counts", lambda table, *more: counted.append(table.columns) or count(table, *more))
    P.table_keys(tables)
    assert counted == [["a", "b", "s"]]


def test_pairs_with_null_are_told_apart(spark):
    """A NULL is a value like another here, and no column that isn't in the set."""
    table = Table("t", spark.createDataFrame([(None, 1, 1), (None, 2, 1), (1, 1, 2), (1, 2, 2)], "a int, b int, c int"))
    assert P.unique_pairs(table, [("a", "b"), ("a", "c"), ("b", "c")]) == [("a", "b"), ("b", "c")]


@pytest.mark.parametrize("share", [1, 3, 10**6])
def test_unique_pairs(spark, monkeypatch, share):
    monkeypatch.setattr(P, "SAMPLE_SHARE", share)
    rng = random.Random(share)
    rows = [(i // 20, i % 20, rng.randrange(30), i % 7, None if i % 5 else "x") for i in range(400)]
    rows[399] = (*rows[399][:3], *rows[398][3:])
    table = Table("T", spark.createDataFrame(rows, "a int, b int, c int, d int, e string"))
    pairs = list(combinations("abcde", 2))
    at = dict(zip("abcde", range(5), strict=True))
    want = [(x, y) for x, y in pairs if len({(r[at[x]], r[at[y]]) for r in rows}) == 400]
    assert P.unique_pairs(table, pairs) == want and ("a", "b") in want
    assert P.unique_pairs(table, [("c", "d")]) == []


def test_constant_steps_of_columns(spark):
    columns = {"one": [5], "two": [5, 9], "step": [-4, 0, 4, 8, 8], "gap": [0, 4, 8, 16], "uneven": [0, 1, 4, 6], "even_range": [0, 3, 4, 8, 12], "same": [7, 7, 7]}
    before = spark.createDataFrame([(c, f"I:{v}") for c, values in columns.items() for v in values], "column string, value string")
    wide = {"T": before.groupBy(F.monotonically_increasing_id().alias("i")).pivot("column", list(columns)).agg(F.first("value")).na.fill("N:").drop("i")}
    step = {c: (s[1] - s[0] if len(s := sorted(set(values))) > 1 and len({b - a for a, b in zip(s, s[1:])}) == 1 else 1) for c, values in columns.items()}  # noqa: B905
    for add in (1, 2, 4, 8, 12):
        cells = spark.createDataFrame([("T", i, c, True, f"I:{max(v) + add}", None, {}, 1) for i, (c, v) in enumerate(columns.items())], "table string, row_id long, column string, is_insert boolean, value string, before string, row map<string,string>, ord long")
        changes = spark.createDataFrame([("T", D.NO_KEY, "row_added", i, None, None, {"a": "b"}, i) for i in range(2)], D.ROW_CHANGES)
        found = {r.column for r in H.counter(cells, H.Context(changes, cells, spark.createDataFrame([], L.INPUTS), None, None, wide)).collect()}
        assert found == {c for c in columns if add % step[c] == 0 and add <= 2 * step[c]}


def test_calibration_without_a_path_sees_updates(spark, tmp_path):
    path = str(tmp_path / "base.db")
    base = sqlite3.connect(path)
    base.executescript("CREATE TABLE T (id INTEGER PRIMARY KEY, v TEXT); INSERT INTO T VALUES (1, 'a'), (2, 'b'), (3, 'c');")

    def change(_):
        base.executescript("UPDATE T SET v = 'z' WHERE id = 2; INSERT INTO T VALUES (9, 'n');")

    assert pipeline.calibrate(SqliteSource(spark, path), 0.0, sleep=change).proposed == {"T": "1 ligne ajoutée, 1 ligne modifiée"}


def example():
    return {
        "format_version": "1.0", "fiche": {"id": "S-003", "titre": "t", "valeurs_saisies": [{"champ_ecran": "Débit", "ecran": "001", "valeur": "1234.56", "type": "montant"}]},
        "execution": {"debut": "2026-10-05T10:15:22", "fin": "2026-10-05T10:18:04", "poste": "PC", "utilisateur_windows": "u", "statut": "terminee", "remarques": ""}, "base": {"chemin": "x", "empreinte_fichier_avant": "sha256:0"},
        "changements": [
            {"table": "ECRITURES", "cle_utilisee": {"type": "primaire", "colonnes": ["NUM"]}, "inserts": [{"cle": {"NUM": 18342}, "valeurs": {"NUM": 18342, "PIECE": "0042"}}], "updates": [], "deletes": [], "updates_probables": []},
            {"table": "LIGNES", "cle_utilisee": {"type": "aucune", "colonnes": []}, "lignes_ajoutees": [{"valeurs": {"NUM": 18342, "DEBIT": "1234.5600"}}], "lignes_supprimees": [], "updates_probables": []},
            {"table": "COMPTEURS", "cle_utilisee": {"type": "candidate", "colonnes": ["CODE"]}, "inserts": [], "updates": [{"cle": {"CODE": "ACH"}, "champs": [{"colonne": "DERNIER", "avant": "41", "apres": "42"}]}], "deletes": [], "updates_probables": []},
        ],
        "bruit": [], "liens": [], "ecarts_saisie": [], "schema_modifie": [], "avertissements": [],
        "champs_calcules": [{"table": "ECRITURES", "colonne": "PIECE", "valeur": "0042", "hypotheses": ["compteur"], "details": "max avant = 0041"}],
    }


def test_trace_documents_of_format_1_0(spark):
    given = example()
    changes = trace.changes_from_json(spark, given["changements"])
    by_table = lambda ts: sorted(ts, key=lambda t: t["table"])
    assert by_table(trace.changes_to_json(changes)) == by_table(given["changements"])
    made = files.reanalyse_trace(spark, given)
    assert [(x["table"], x["colonne"], x["type_correspondance"]) for x in made["liens"]] == [("LIGNES", "DEBIT", "exacte")]
    assert {"table": "ECRITURES", "colonne": "PIECE", "valeur": "0042", "hypotheses": ["compteur"], "details": "max avant = 0041"} in made["champs_calcules"]
    assert "lignes_ajoutees" in trace.render_report(made)


def test_amounts_of_all_total_tables_are_anonymised():
    given = example()
    for i, name in enumerate(("compte", "SCompte", "journal", "sjournal")):
        fields = [{"colonne": "Debit", "avant": f"9876{i}.4300", "apres": f"9880{i}.0000"}]
        given["changements"].append({"table": name, "cle_utilisee": {"type": "primaire", "colonnes": ["C"]}, "inserts": [], "updates": [{"cle": {"C": "1"}, "champs": fields}], "deletes": [], "updates_probables": []})
    made = files.anonymise_trace(given)
    for old, new in zip(given["changements"][3:], made["changements"][3:], strict=True):
        (a, b), (x, y) = ([Decimal(t["updates"][0]["champs"][0][side]) for side in ("avant", "apres")] for t in (old, new))
        assert b - a == y - x and {a, b}.isdisjoint({x, y})


def test_values_of_several_types_in_one_column(spark):
    """A VARIANT's texts are those of columns of each value's own type; types are counted value by value; an update of the type alone is a change."""
    values = {
        "CAST(1 AS VARIANT)": "I:1", "parse_json('1')": "I:1", "parse_json('\"1\"')": "T:1", "parse_json('1.50')": "M:1.5", "CAST(CAST(1 AS DOUBLE) AS VARIANT)": "F:1.0", "parse_json('true')": "L:1", "parse_json('false')": "L:0", "parse_json('null')": "N:",
        "CAST(NULL AS VARIANT)": "N:", "CAST(DATE'2024-01-02' AS VARIANT)": "J:2024-01-02", "CAST(TIMESTAMP'2024-01-02 03:04:05' AS VARIANT)": "D:2024-01-02T03:04:05", "CAST(TIMESTAMP_NTZ'2024-01-02 03:04:05.5' AS VARIANT)": "D:2024-01-02T03:04:05.500000",
        "parse_json('[1, \"x\"]')": 'V:ARRAY<VARIANT>:[1,"x"]', "parse_json('{\"b\": 1, \"a\": null}')": 'V:OBJECT<a: VOID, b: BIGINT>:{"a":null,"b":1}', "parse_json('\"\"')": "T:", "CAST(X'00ff' AS VARIANT)": "B:" + hashlib.sha256(b"\x00\xff").hexdigest(),
        "parse_json('\"e\u0301\"')": "T:\u00e9",
    }
    rows = spark.sql(" UNION ALL ".join(f"SELECT {i} AS id, {v} AS v" for i, v in enumerate(values)))
    table = Table("t", rows, ("id",))
    assert table.columns == ["id", "v"] and table.non_ascii == {"v"}
    got = {int(r.id[2:]): r.v for r in S.canonical_rows(table).collect()}
    assert [got[i] for i in range(len(values))] == list(values.values())
    counted = Counter(text[0] for text in values.values())
    assert {r.type: r.n for r in P.observed_types(table).filter("column = 'v'").collect()} == counted
    profile = P.column_profile(table).filter("column = 'v'").first()
    assert (profile.n_nulls, profile.n_distinct, profile.min) == (counted["N"], len(set(values.values()) - {"N:"}), None)
    assert P.observed_types(Table("t", rows.limit(0))).isEmpty()


def test_many_changed_keys_are_never_broadcast(spark, monkeypatch):
    before, after = (S.snapshot_of(Table("T", f, ("id",))).rows for f in two_sides(spark))
    added = D.keyed_diff("T", before.limit(0), before, ["id", "k", "t"], ["id"], D.PRIMARY)
    assert "Join" not in plan(added) and added.count() == 3000
    few = D.keyed_diff("T", before, after, ["id", "k", "t"], ["id"], D.PRIMARY)
    monkeypatch.setattr(D, "FEW_ROWS", 10)
    found = D.keyed_diff("T", before, after, ["id", "k", "t"], ["id"], D.PRIMARY)
    assert "Broadcast" not in plan(found) and as_set(found) == as_set(few)


def test_links_and_deviations_of_many_inputs_are_joined_by_shuffle(spark, monkeypatch):
    from deltascope.sources import storage

    monkeypatch.setattr(storage, "FEW_ROWS", 10)
    rows = [("T", i, "total", True, f"M:{1000 + i}.00", None, {"id": f"I:{i}"}) for i in range(60)]
    cells = spark.createDataFrame(rows, "table string, row_id long, column string, is_insert boolean, value string, before string, row map<string,string>")
    inputs = spark.createDataFrame([(i, "Total", "S", str(1000 + i if i < 40 else 9000 + i), "montant") for i in range(60)], L.INPUTS)
    found = L.matches(inputs, cells)
    lost = L.deviations(inputs, cells, found)
    # only sisters and kinds, as many as screens have fields, may be broadcast, and these are in tables already
    assert "Broadcast" not in plan(found) and "Broadcast" not in plan(lost)
    assert found.count() == 40 and Counter(r.kind for r in lost.collect()) == {"valeur_differente": 20}


def test_copies_from_a_large_table_are_joined_by_shuffle(spark, monkeypatch):
    from deltascope.sources import storage

    monkeypatch.setattr(storage, "FEW_ROWS", 10)
    rows = [("T", i, c, True, v, None, {"id": f"I:{i}", "fk": f"I:{i}", "name": f"T:n{i}"}) for i in range(40) for c, v in (("fk", f"I:{i}"), ("name", f"T:n{i}"))]
    cells = spark.createDataFrame(rows, "table string, row_id long, column string, is_insert boolean, value string, before string, row map<string,string>")
    held = storage.written(spark.createDataFrame([(f"I:{i}", f"T:n{i if i < 30 else 0}") for i in range(40)], "key string, label string"), "test")
    rel = spark.createDataFrame([("T", "fk", "U", "key", "normale")], "src_table string, src_column string, dst_table string, dst_column string, confidence string")
    found = H.copied(cells, H.Context(cells, cells, None, None, None, {"U": held}, relations=rel))
    assert found.count() == 30 and plan(found).count("SortMergeJoin") >= 2


def test_probable_updates_read_the_compared_tables_once(spark):
    before, after = (S.snapshot_of(Table("T", f)).rows for f in two_sides(spark))
    found, _ = D.probable_updates(D.bag_diff("T", before, after, ["id", "k", "t"]), ["id", "k", "t"], "T", cap=None)
    assert "Range (" not in plan(found)


def test_equal_inputs_and_cells_meet_by_value(spark):
    """300 inputs and 300 cells of one amount: one pair of values, whatever is asked of the 90,000 links."""
    cells = spark.createDataFrame([("T", i, "total", True, "M:12.50", None, {"id": f"I:{i}"}, i) for i in range(300)] + [("T", 900, "total", True, "M:-12.50", None, {"id": "I:900"}, 900)], "table string, row_id long, column string, is_insert boolean, value string, before string, row map<string,string>, ord long")
    inputs = spark.createDataFrame([(i, "Total", "S", "12,50" if i < 299 else "-7", "montant") for i in range(300)], L.INPUTS)
    assert Counter(r.match_type for r in L.value_pairs(inputs, cells).collect()) == {"exacte": 1, "signe_inverse": 1}
    counts = L.match_counts(inputs, cells).collect()
    assert Counter((r.n, r.is_exact) for r in counts) == {(300, True): 299}
    found = L.matches(inputs, cells, carry=("ord",))
    assert found.count() == 299 * 300 and found.select("input_id", "ord").distinct().count() == 299 * 300
    lost = L.deviations(inputs, cells)
    assert [tuple(r) for r in lost.collect()] == [tuple(r) for r in L.deviations(inputs, cells, found).collect()] == [("Total", "S", "-7", "introuvable", None, None, None)]


def test_relations_of_many_values_refute_pairs_first(spark, monkeypatch, never_broadcast):
    from deltascope.sources import storage

    wide = spark.range(4000).select("id", (F.col("id") % 50).alias("few"), F.when(F.col("id") % 200 == 7, -F.col("id")).otherwise(F.col("id") * 3 % 4000).alias("most"), (F.col("id") + 41).alias("moved"), (F.col("id") + 40).alias("near"), (F.col("id") + 0.5).alias("half"), F.concat(F.lit("t"), "id").alias("text"))
    small = spark.range(20).select(F.col("id").alias("no"), F.concat(F.lit("t"), "id").alias("name"))
    parts, _, keys = P.profile_tables([Table("W", wide), Table("S", small)])
    singles = storage.few(spark, [(t, k[0]) for t, own in keys.items() for k in own if len(k) == 1], "table string, column string")
    whole = P.relations(parts[0].unionByName(parts[1]), singles)
    # no column's values meet in one task
    assert "hashpartitioning(table" not in plan(whole) and "hashpartitioning(dst_table" not in plan(whole)
    monkeypatch.setattr(storage, "FEW_ROWS", 10)
    found = P.relations(parts[0].unionByName(parts[1]), singles)
    assert set(found.collect()) == set(whole.collect())
    pairs = {(r.src_column, r.dst_column) for r in found.collect()}
    assert {("few", "id"), ("most", "id"), ("near", "id"), ("no", "id"), ("name", "text")} <= pairs and not {("moved", "id"), ("half", "id"), ("id", "no")} & pairs


def test_many_changed_keys_fetch_their_rows_alone(spark, monkeypatch):
    before, after = (S.snapshot_of(Table("T", f, ("id",))).rows for f in two_sides(spark))
    small = D.keyed_diff("T", before, after, ["id", "k", "t"], ["id"], D.PRIMARY)
    monkeypatch.setattr(D, "FEW_ROWS", 10)
    found = D.keyed_diff("T", before, after, ["id", "k", "t"], ["id"], D.PRIMARY)
    assert "Range (" not in plan(found) and as_set(found) == as_set(small)
    monkeypatch.setattr(D, "MANY_KEYS", 10)
    assert as_set(D.keyed_diff("T", before, after, ["id", "k", "t"], ["id"], D.PRIMARY)) == as_set(small)
    # a key that repeats in either side is none
    for pair in ((before, after.unionAll(after)), (before.unionAll(before), after)):
        assert D.changed_keys(*pair, ["id", "k", "t"], ["id"]) is None


def test_counters_read_the_snapshot_for_what_was_written_alone(spark):
    before = spark.range(1000).select(F.concat(F.lit("I:"), "id").alias("id"), F.concat(F.lit("I:"), F.col("id") * 4).alias("four"), F.concat(F.lit("T:no"), "id").alias("code"), F.concat(F.lit("M:"), "id").alias("m"))
    written = {"id": "I:1000", "four": "I:4000", "m": "M:1000"}
    cells = spark.createDataFrame([("T", 1, c, True, v, None, {}, 1) for c, v in written.items()], "table string, row_id long, column string, is_insert boolean, value string, before string, row map<string,string>, ord long")
    changes = spark.createDataFrame([("T", D.NO_KEY, "row_added", 1, None, None, written, 1)], D.ROW_CHANGES)
    found = H.counter(cells, H.Context(changes, cells, None, None, None, {"T": before}))
    assert "Range (" not in plan(found)
    assert {(r.column, r.detail) for r in found.collect()} == {("id", "max avant = 999"), ("four", "max avant = 3996")}
    far = spark.createDataFrame([("I:99999999999999999990",), ("I:-5",), ("I:-4",)], "id string")
    cells = cells.filter("column = 'id'").withColumn("value", F.lit("I:99999999999999999991"))
    assert [r.detail for r in H.counter(cells, H.Context(changes, cells, None, None, None, {"T": far})).collect()] == ["max avant = 99999999999999999990"]


def test_sums_of_children_are_dealt_by_row_and_not_by_table(spark, never_broadcast):
    """Relations are few and broadcast whatever Spark knows of their size: joined by shuffle they sent all children of a table to one task."""
    changes = spark.createDataFrame([("child", None, "row_added", i, None, None, {"fk": f"I:{i % 5}", "v": f"M:{i}.50"}, i) for i in range(20)] + [("parent", "primaire", "insert", 100 + i, {"id": f"I:{i}"}, None, {"id": f"I:{i}", "total": f"M:{30 + 4 * i + 2}.00"}, i) for i in range(5)], D.ROW_CHANGES)
    cells = extract_cells(changes)
    rel = spark.createDataFrame([("child", "fk", "parent", "id", "normale")], "src_table string, src_column string, dst_table string, dst_column string, confidence string")
    hit = H.sum_of_children(cells.filter("column = 'total'"), H.Context(changes, cells, None, datetime(2024, 1, 1), datetime(2024, 1, 2), relations=rel))
    assert not [line for line in plan(hit).splitlines() if "SortMergeJoin [src_table" in line and "fk" not in line or "SortMergeJoin [table" in line]
    assert sorted((r.row_id, r.detail) for r in hit.collect()) == [(100 + i, "somme de child.v (4 lignes liées)") for i in range(5)]


@pytest.mark.parametrize("few_rows", [D.FEW_ROWS, 1])
def test_rows_of_a_new_table_are_listed_where_they_are(spark, monkeypatch, never_broadcast, few_rows):
    """Where a side is empty only hashes are shuffled to find repeated rows; changes, their numbers and places are the same as when both sides are compared."""
    monkeypatch.setattr(D, "FEW_ROWS", few_rows)
    rows = S.in_order(S.canonical_rows(Table("T", spark.range(300).selectExpr("id % 250 AS a", "concat('text ', CASE WHEN id < 40 THEN 0 ELSE id % 250 END) AS b").repartition(5))))
    rows = rows.union(rows.limit(7)).localCheckpoint()
    other = S.in_order(S.canonical_rows(Table("T", spark.createDataFrame([(-1, "no such row")], "a long, b string"))))
    shown = lambda df, op: sorted((r.row_id, r.ord, sorted((r.after or r.before).items())) for r in df.filter(F.col("op") == op).collect())
    for op, sides, both in (("row_added", (rows.limit(0), rows), (other, rows)), ("row_removed", (rows, rows.limit(0)), (rows, other))):
        alone = D.bag_diff("T", *sides, ["a", "b"])
        assert shown(alone, op) == shown(D.bag_diff("T", *both, ["a", "b"]), op)
        assert alone.count() == 307 == alone.select("row_id").distinct().count()
    # rows that occur once meet the repeated ones' hashes alone, and aren't grouped
    assert "SortAggregate" not in plan(alone) and plan(alone).count("LeftAnti") == 1


def test_short_numbers_are_read_as_they_are(spark):
    texts = ["M:1.50", "M:-0.10", "F:0.1", "F:1.0E10", "F:NaN", "I:12", "T:1", "M:" + "9" * 28 + ".1234567891", "M:0.12345678911", "M:0.12345678910000", "M:" + "9" * 29]
    want = [Decimal("1.50"), Decimal("-0.10"), Decimal("0.1"), Decimal("1E10"), None, Decimal(12), None, Decimal("9" * 28 + ".1234567891"), None, Decimal("0.1234567891"), None]
    assert [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(number(F.col("t"))).collect()] == want
