"""The rules on cases stated one by one: links, deviations, counters, totals by prefix and retyped values, against SQL or listed results."""

import pytest
from pyspark.sql import functions as F

from deltascope.operators import diff as D
from deltascope.operators import hypotheses as H
from deltascope.operators import links as L
from deltascope.plans import catalog, trace

INPUT_ROWS = [
    (1, "Montant", "S", "1 234,56", "montant"), (2, "Montant", "S", "500", "montant"), (3, "Date", "S", "15/01/2024", "date"), (4, "Date", "S", "2024-02-01", "date"),
    (5, "Code", "S", "6111", "code"), (6, "Code", "S", "0042", "code"), (7, "Libelle", "S", "Test-S003", "texte"), (8, "Libelle", "S", "Facture Dupont", "texte"),
    (9, "Montant", "S", "1.234,56", "montant"), (10, "Date", "S", "31/02/2024", "date"), (11, "Montant", "S", "0", "montant"), (12, "Montant", "S", "7,25", "montant"),
    (13, "Libelle", "S", "Test-S030", "texte"), (14, "Autre", "S", "Rien du tout", "texte"), (15, "Montant", "S", "1243,56", "montant"), (16, "Date", "S", "3.2.2024", "date"),
]
CELL_ROWS = [
    (1, "ECR", "MONTANT", "M:1234.56"), (2, "ECR", "CREDIT", "M:-1234.56"), (3, "ECR", "CENTIMES", "I:123456"), (4, "ECR", "TAUX", "M:12.3456"), (5, "ECR", "MONTANT", "M:-500.00"), (6, "ECR", "CENTIMES", "I:50000"),
    (7, "ECR", "DATE_ECR", "D:2024-01-15T00:00:00"), (8, "ECR", "SAISIE", "D:2024-01-15T00:00:01"), (9, "ECR", "JOUR", "J:2024-01-15"), (10, "ECR", "TEXTE", "T:15.01.2024"), (11, "ECR", "JOUR", "J:2024-02-02"),
    (12, "CPT", "COMPTE", "I:6111"), (13, "CPT", "COMPTE", "T:6111  "), (14, "CPT", "NUM", "I:42"), (15, "CPT", "NUM", "T:0042"), (16, "CPT", "LIB", "T:TEST-S003"), (17, "CPT", "LIB", "T:Test-S"), (18, "CPT", "LIB", "T:Te"),
    (19, "CPT", "LIB2", "T:Facture Dupont "), (20, "CPT", "LIB2", "T: Facture Dupont"), (21, "CPT", "TXT", "T:1234.56"), (22, "ECR", "ZERO", "M:0.00"), (23, "ECR", "MONTANT", "M:7.250"), (24, "CPT", "LIB", "T:Test-S003\t"),
    (25, "ECR", "MONTANT", "M:1234.65"), (26, "CPT", "NUL", "N:"), (27, "CPT", "LOG", "L:1"), (28, "ECR", "JOUR", "J:2024-02-03"), (29, "CPT", "LIB", "T:TEST-S0031"),
]

INPUTS_SQL = f"SELECT * FROM (VALUES {catalog.rows_sql(INPUT_ROWS)}) t(input_id, field, screen, value, type)"
CELLS_SQL = f"SELECT * FROM (VALUES {catalog.rows_sql(CELL_ROWS)}) t(row_id, tab, col, v)"
ACCOUNTS = [
    ("6", "1234.5600"), ("61", "1234.5600"), ("612", "1234.5600"), ("6126", "1234.5600"), ("61263", "1234.5600"), ("3", "246.9100"), ("34", "246.9100"), ("345", "246.9100"), ("3455", "246.9100"),
    ("34552", "246.9100"), ("44", "-1481.4700"), ("441", "-1481.4700"), ("4411", "-1481.4700"), ("441110024", "-1481.4700"), ("70", "50.0000"), ("512", "80.0000"),
]
JSON_VALUES = ["1234.5600", "12.5", "26", "2024-01-15T10:00:00", "2024-01-15", "2024-02-30", "-0.0100", "texte", "", "2024-01-15T25:00:00"]
COUNTERS = [("ACH", 41, 42), ("VTE", 57, 62), ("OD", 3, 8)]
UPDATES = "table string, row_id long, column string, is_insert boolean, value string, before string, row map<string,string>"


@pytest.fixture(scope="module")
def frames(spark):
    return spark.createDataFrame(INPUT_ROWS, L.INPUTS), spark.createDataFrame([(t, i, c, True, v, None, {c: v}) for i, t, c, v in CELL_ROWS], UPDATES)


def test_links(duck, frames):
    got = {(r.input_id, r.row_id, r.match_type) for r in L.matches(*frames).collect()}
    assert got == set(duck.execute(f"{catalog.matched_sql(INPUTS_SQL, CELLS_SQL)} SELECT input_id, row_id, m FROM kept").fetchall())


def test_deviations(duck, frames):
    found = L.deviations(*frames, L.matches(*frames))
    columns = ["field", "screen", "expected", "kind", "table", "column", "found"]
    want = duck.execute(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({catalog.deviations_sql(INPUTS_SQL, CELLS_SQL)})").fetchall()
    assert sorted(map(tuple, found.select(*columns).collect()), key=str) == sorted(want, key=str)


def test_invalid_inputs(frames):
    assert {r.input_id for r in L.prepared(frames[0]).filter("NOT valid").collect()} == {9, 10}


def _updates(spark, table, rows, key, column):
    return spark.createDataFrame([(table, i + 1, column, False, after, before, {key: k, column: after}) for i, (k, before, after) in enumerate(rows)], UPDATES)


def _context(spark, cells):
    return H.Context(spark.createDataFrame([], D.ROW_CHANGES), cells, spark.createDataFrame([], L.INPUTS), catalog.START, catalog.END, {})


def test_counters_of_updates(spark):
    cells = _updates(spark, "COMPTEURS", [(f"T:{k}", f"I:{a}", f"I:{b}") for k, a, b in COUNTERS], "CODE_JOURNAL", "DERNIER_NUM")
    assert [r.detail for r in H.counter(cells, _context(spark, cells)).collect()] == ["41 → 42"]


def test_totals_by_prefix(spark):
    cells = _updates(spark, "compte", [(f"T:{a}  ", "M:1000.0000", f"M:{1000 + float(d):.4f}") for a, d in ACCOUNTS], "Compte", "Debit")
    hit = H.hierarchical_total(cells, _context(spark, cells)).join(cells, H.REF)
    got = {r.account: r.detail.split(" : ")[1] for r in hit.select(F.trim(F.substring(F.element_at("row", F.lit("Compte")), 3, 20)).alias("account"), "detail").collect()}
    chains = [["61", "612", "6126", "61263"], ["34", "345", "3455", "34552"], ["44", "441", "4411", "441110024"]]
    related = lambda a, chain: [b for b in chain if a.startswith(b) or b.startswith(a)]
    assert got == {a: ", ".join(related(a, chain)) for chain in chains for a in chain}


def test_retyped_values(spark, duck):
    got = {r.value: r.typed for r in spark.createDataFrame([(v,) for v in JSON_VALUES], "value string").select("value", trace.retyped(F.col("value")).alias("typed")).collect()}
    assert got == dict(duck.execute(catalog.retype_sql(f"SELECT * FROM (VALUES {catalog.rows_sql([(v,) for v in JSON_VALUES])}) t(value)")).fetchall())


def test_the_ledger_meets_every_rule(duck):
    """The SQL of the registered queries has matches of every type, deviations of both kinds and inputs that can't be read."""
    sql = catalog.oracle_sql()
    kinds = lambda query, column: {r[0] for r in duck.execute(f"SELECT DISTINCT {column} FROM ({sql[query]})").fetchall()}
    assert kinds("links_all", "match_type") == set(L.CONFIDENCE)
    assert kinds("deviation_osa1", "kind") == {"introuvable", "valeur_differente"}
    assert kinds("retype_json_values", "substr(typed, 1, 1)") == set("MDJT") and kinds("invalid_inputs", "type") == {"montant"}
