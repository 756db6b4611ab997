"""SQLite sources, profiles on disk, re-analysed and anonymised traces."""

import copy
import json
import logging
import sqlite3
from datetime import date, datetime
from decimal import Decimal

import pytest

from deltascope.__main__ import main
from deltascope.operators import profile as P
from deltascope.operators import snapshot as S
from deltascope.plans import files, pipeline, trace
from deltascope.sources import sqlite
from deltascope.sources.catalog import FrameSource


@pytest.fixture
def base(tmp_path):
    path = str(tmp_path / "base.db")
    with sqlite3.connect(path) as con:
        con.execute('CREATE TABLE "LIGNES DE" (B TEXT, A INTEGER, M DECIMAL(12,2), D DATE, T DATETIME, F REAL, X BLOB, PRIMARY KEY (A, B))')
        con.execute("CREATE TABLE VIDE (ID INTEGER PRIMARY KEY)")
        con.executemany('INSERT INTO "LIGNES DE" VALUES (?, ?, ?, ?, ?, ?, ?)', [("x", i, i + 0.25, "2024-01-15", "2024-01-15T10:00:00", 0.5, b"z") for i in range(5)] + [("y", 9, None, None, None, None, None)])
    return path


def test_sqlite_tables(spark, base, monkeypatch):
    monkeypatch.setattr(sqlite, "BATCH", 2)
    source = sqlite.SqliteSource(spark, base)
    assert source.list_tables() == ["LIGNES DE", "VIDE"]
    table = source.table("LIGNES DE")
    assert table.primary_key == ("A", "B") and table.declared_type("M") == "DECIMAL(12,2)"
    rows = {r.A: r for r in table.df.collect()}
    assert len(rows) == 6 and rows[1].M == Decimal("1.25") and rows[1].D == date(2024, 1, 15) and rows[1]["T"] == datetime(2024, 1, 15, 10) and rows[9].M is None
    assert source.table("VIDE").df.count() == 0 and S.take_snapshot(source).n_rows == 6
    with sqlite.connect(base) as con, pytest.raises(sqlite3.OperationalError):
        con.execute("DELETE FROM VIDE")


def test_sqlite_rows_in_sparse_places_or_without_numbers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sqlite, "BATCH", 3)
    path = str(tmp_path / "sparse.db")
    with sqlite3.connect(path) as con:
        con.execute("CREATE TABLE FAR (ID INTEGER PRIMARY KEY, A TEXT)")
        con.executemany("INSERT INTO FAR VALUES (?, 'x')", [(10**k,) for k in range(8)])
        con.execute("CREATE TABLE KEYED (K TEXT, N INTEGER, PRIMARY KEY (K, N)) WITHOUT ROWID")
        con.executemany("INSERT INTO KEYED VALUES (?, ?)", [(f"k{i % 3}", i) for i in range(10)])
    source = sqlite.SqliteSource(spark, path)
    far, keyed = source.table("FAR").df, source.table("KEYED").df
    assert sorted(r.ID for r in far.collect()) == [10**k for k in range(8)] and far.rdd.getNumPartitions() == 3
    assert sorted((r.K, r.N) for r in keyed.collect()) == sorted((f"k{i % 3}", i) for i in range(10)) and source.table("KEYED").primary_key == ("K", "N")


def test_logs_are_masked():
    record = logging.LogRecord("x", logging.INFO, "", 0, "key %s", ("s3cret",), None)
    assert files.MaskingFormatter(["s3cret"]).format(record) == "key ***"


def test_profiles_and_noise_on_disk(spark, tmp_path):
    frames = {"P": spark.range(50).toDF("ID"), "C": spark.range(60).selectExpr("id % 50 AS FK", "cast(id AS decimal(9,2)) AS M", "concat('t', id) AS T")}
    found = P.profile(FrameSource(spark, frames, {"P": ("ID",)}))
    document = files.write_profile(found, str(tmp_path), datetime(2024, 1, 15))
    back = files.read_profile(spark, str(tmp_path / "profil.json"))
    assert back.keys == found.keys and back.first_keys() == found.first_keys() and "<svg" in (tmp_path / "profil.html").read_text()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(back.columns.select(*found.columns.columns)) == rows(found.columns) and rows(back.relations) == rows(found.relations)
    assert {"table_source", "taux_inclusion", "confiance"} <= document["relations_candidates"][0].keys()
    noise = pipeline.Calibration(datetime(2024, 1, 1), datetime(2024, 1, 1, 0, 0, 30), 30.0, {"S": "1 ligne modifiée"}, [], ["S"])
    files.write_noise(noise, str(tmp_path / "bruit.json"))
    assert json.loads((tmp_path / "bruit.json").read_text())["tables_bruit"] == ["S"]


def trace_document():
    update = lambda a, b, c: {"cle": {"Compte": a}, "champs": [{"colonne": "Debit", "avant": b, "apres": c}]}
    changes = [
        {"table": "compte", "cle_utilisee": {"type": "primaire", "colonnes": ["Compte"]}, "inserts": [], "updates": [update("61", "100.0000", "150.0000"), update("612", "7.5000", "57.5000"), update("70", "57.5000", "60.0000")], "deletes": [], "updates_probables": []},
        {"table": "ecrit", "cle_utilisee": {"type": "primaire", "colonnes": ["N"]}, "inserts": [{"cle": {"N": 4}, "valeurs": {"N": 4, "M": "50.0000", "K": "A"}}], "updates": [], "deletes": [], "updates_probables": []},
    ]
    computed = [{"table": "ecrit", "colonne": "N", "valeur": 4, "hypotheses": ["compteur"], "details": "max avant = 3"}, {"table": "ecrit", "colonne": "K", "valeur": "A", "hypotheses": ["copie", "constante"], "details": "copie : copie de sauve1.K (ligne N = 1) ; constante : valeur constante sur toute la table (A)"}]
    values = [{"champ_ecran": "Montant", "ecran": "E", "valeur": "50", "type": "montant"}]
    return {
        "format_version": "1.0", "fiche": {"id": "S-1", "titre": "t", "valeurs_saisies": values}, "execution": {"debut": "2024-01-15T10:00:00", "fin": "2024-01-15T10:01:00", "statut": "terminee"}, "base": {}, "changements": changes, "bruit": [],
        "liens": [], "champs_calcules": computed, "ecarts_saisie": [], "schema_modifie": [], "avertissements": [{"table": None, "code": "profil_absent", "message": "", "details": {}}],
    }


def test_re_analysis_of_a_file(spark, tmp_path):
    old = trace_document()
    path = tmp_path / "trace.json"
    path.write_text(json.dumps(old))
    target, summary = files.reanalyse_file(spark, str(path))
    new = json.loads(open(target).read())
    assert json.loads(path.read_text()) == old and "liens: 0 -> 1" in summary
    assert [(x["table"], x["colonne"]) for x in new["liens"]] == [("ecrit", "M")] and new["execution"]["statut"] == "terminee"
    found = {(c["table"], c["colonne"], str(c["valeur"])): c["hypotheses"] for c in new["champs_calcules"]}
    assert found["ecrit", "N", "4"] == ["compteur"] and found["ecrit", "K", "A"] == ["constante"]  # copies of saved tables aren't admitted
    assert found["compte", "Debit", "150.0000"] == ["cumul_mis_a_jour", "cumul_hierarchique"] and found["compte", "Debit", "60.0000"] == ["inconnu"]
    codes = [w["code"] for w in new["avertissements"]]
    assert "profil_absent" not in codes and "non_recalculable_hors_ligne" in codes and codes[-1] == "reanalyse"
    again = files.reanalyse_trace(spark, new)
    order = lambda xs: sorted(json.dumps(x, sort_keys=True) for x in xs)
    assert all(order(again[k]) == order(new[k]) for k in ("liens", "ecarts_saisie", "champs_calcules"))
    assert main(["reanalyse", str(path), "--to", str(tmp_path / "other")]) == 0
    assert files.write_index(spark, str(tmp_path)) == 0


def test_anonymised_traces_keep_differences():
    old = trace_document()
    new = files.anonymise_trace(old)
    amounts = lambda d: [(Decimal(f["avant"]), Decimal(f["apres"])) for u in d["changements"][0]["updates"] for f in u["champs"]]
    assert [b - a for a, b in amounts(new)] == [b - a for a, b in amounts(old)] and not {a for p in amounts(new) for a in p} & {a for p in amounts(old) for a in p}
    assert amounts(new)[1][1] == amounts(new)[2][0]  # equal amounts stay equal
    assert new["changements"][1] == old["changements"][1] and old == trace_document() and copy.deepcopy(new) == files.anonymise_trace(old)


def test_anonymised_traces_leak_nothing():
    old = trace_document()
    old["execution"] |= {"poste": "PC-DUPONT", "utilisateur_windows": "dupont", "remarques": "vu avec M. Dupont"}
    old["base"] = {"chemin": "C:\\CLIENTS\\DUPONT\\BASE.mdb", "empreinte_fichier_avant": "sha256:" + "a" * 64}
    old["fiche"]["valeurs_saisies"] += [{"champ_ecran": "Solde", "ecran": "E", "valeur": "1 150,00", "type": "montant"}, {"champ_ecran": "Tiers", "ecran": "E", "valeur": "Dupont SA", "type": "texte"}, {"champ_ecran": "Solde", "ecran": "E", "valeur": "57,50", "type": "montant"}]
    old["changements"][0]["updates"][0]["champs"][0]["apres"] = "1150.0000"
    old["champs_calcules"].append({"table": "compte", "colonne": "Debit", "valeur": "1150.0000", "hypotheses": ["cumul_mis_a_jour"], "details": "delta 1050 = montant saisi ; solde 1150.0000 puis 7.5000, 100.00"})
    old["avertissements"].append({"table": "compte", "code": "x", "message": "57.5000 est rare", "details": {"tiers": "Dupont SA".ljust(40)}})
    new = files.anonymise_trace(old, names={"Dupont SA": "Tiers Un", "Dupont": "Un"})
    whole = json.dumps(new, ensure_ascii=False)
    assert not any(real in whole for real in ("1150.0000", "1 150,00", "7.5000", "57.5000", "57,50", "100.00", "60.0000", "upont", "DUPONT", "PC-", "vu avec"))
    assert "delta 1050 = montant" in whole and new["avertissements"][-1]["details"]["tiers"] == "Tiers Un".ljust(40)
    typed = new["fiche"]["valeurs_saisies"]
    assert "," in typed[1]["valeur"] and Decimal(typed[3]["valeur"].replace(",", ".")) == Decimal(new["changements"][0]["updates"][2]["champs"][0]["avant"])
    assert list(new) == list(old) and old["execution"]["poste"] == "PC-DUPONT"
    with pytest.raises(ValueError):
        files.anonymise_trace(old, names={"S-1": "S-1"})


def test_reports_say_how_long_a_run_took():
    assert [trace.duration({"debut": "2024-01-15T10:00:00", "fin": f}) for f in ("2024-01-15T10:01:05", "2024-01-15T10:00:07", "?")] == ["1 min 05 s", "7 s", ""]
    assert "(1 min 00 s)" in trace.render_report(trace_document())


def test_diagnosis(spark, tmp_path):
    said = []
    assert files.diagnose(FrameSource(spark, {"T": spark.range(30).toDF("ID")}), say=said.append) and "snapshot in" in said[-1]
