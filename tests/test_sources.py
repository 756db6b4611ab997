"""Sources, small documents, sessions and the change feed."""

import json
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import types as T

from deltascope.operators import diff as D
from deltascope.operators import profile as P
from deltascope.plans import pipeline
from deltascope.sources import scenarios
from deltascope.sources.catalog import CatalogSource, FileSource, FrameSource, JdbcSource, file_digests, file_versions, read_keys
from deltascope.streaming import feed
from tests.conftest import SF


def test_folders_and_catalogs(spark, tmp_path):
    source = FileSource(spark, SF, ["region", "~tmp", "nation"], {"region": ["r_regionkey"]})
    assert source.list_tables() == ["nation", "region"] and source.table("region").primary_key == ("r_regionkey",)
    source.refresh()
    spark.range(3).write.mode("overwrite").saveAsTable("kept_numbers", path=f"file://{tmp_path}/t")
    tables = CatalogSource(spark)
    assert "kept_numbers" in tables.list_tables() and tables.table("kept_numbers").df.count() == 3
    tables.refresh()
    spark.sql("DROP TABLE kept_numbers")
    (tmp_path / "keys.json").write_text("﻿" + json.dumps({"region": ["r_regionkey"]}), encoding="utf-8")
    assert read_keys(spark, f"file://{tmp_path}/keys.json") == {"region": ("r_regionkey",)}


def test_jdbc_metadata_keys_and_ranges(spark):
    """The Derby database that Spark's own jars hold, in memory."""
    url = "jdbc:derby:memory:shop;create=true"
    manager = spark._jvm.java.sql.DriverManager
    connection = manager.getConnection(url)
    statement = connection.createStatement()
    for text in (
        "CREATE TABLE ORDERS (NUM INT NOT NULL, CLIENT VARCHAR(20), TOTAL DECIMAL(12,2), PRIMARY KEY (NUM))", "CREATE TABLE LINES (RANG INT NOT NULL, NUM INT NOT NULL, QTE INT, PRIMARY KEY (NUM, RANG))", "CREATE TABLE NOTES (T VARCHAR(20))",
        "INSERT INTO ORDERS VALUES " + ", ".join(f"({i}, 'c{i % 3}', {i}.25)" for i in range(1, 41)), "INSERT INTO LINES VALUES (1, 7, 3), (2, 7, 4)",
    ):
        statement.execute(text)
    connection.commit()
    connection.close()
    source = JdbcSource(spark, url, schema="APP", partitions=4, options={"sessionInitStatement": ""})
    assert source.list_tables() == ["LINES", "NOTES", "ORDERS"]
    orders, lines, notes = (source.table(n) for n in ("ORDERS", "LINES", "NOTES"))
    assert orders.primary_key == ("NUM",) and lines.primary_key == ("NUM", "RANG") and notes.primary_key == () and orders.declared_type("TOTAL") == "DECIMAL"
    assert orders.df.rdd.getNumPartitions() == 4 and sorted(r.NUM for r in orders.df.collect()) == list(range(1, 41)) and notes.df.count() == 0


def test_file_headers_and_digests(spark, tmp_path):
    for name, code in (("a.mdb", 0), ("b.mdb", 1), ("c.mdb", 5)):
        (tmp_path / name).write_bytes(b"\0\1\0\0Standard Jet DB\0" + bytes([code]) + b"\0" * 10)
    (tmp_path / "d.mdb").write_bytes(b"no base")
    found = {r.path.rsplit("/", 1)[1]: r.version for r in file_versions(spark, f"file://{tmp_path}").collect()}
    assert found == {"a.mdb": "Jet 3", "b.mdb": "Jet 4", "c.mdb": "other", "d.mdb": None}
    assert all(len(r.sha256) == 64 for r in file_digests(spark, f"file://{tmp_path}").collect())


def sheet(name, **more):
    return {"id": name, "titre": "t", "etapes": [], "valeurs_saisies": [{"champ_ecran": "M", "ecran": "E", "valeur": "1", "type": "montant"}]} | more


def test_sheets(spark, tmp_path):
    path = tmp_path / "sheets.json"
    path.write_text(json.dumps({"format_version": "1.0", "lot": 2, "fiches": [sheet("S-1"), sheet("S-2", lot=5)]}))
    assert {(r.id, r.lot) for r in scenarios.read_sheets(spark, f"file://{path}").collect()} == {("S-1", 2), ("S-2", 5)}
    for wrong in ([sheet("S-1"), sheet("S-1")], [sheet("")], [sheet("S-1", valeurs_saisies=[{"champ_ecran": "M", "ecran": "E", "valeur": "1", "type": "?"}])]):
        path.write_text(json.dumps({"format_version": "1.0", "lot": 2, "fiches": wrong}))
        with pytest.raises(ValueError):
            scenarios.read_sheets(spark, f"file://{path}")
    noise = tmp_path / "noise.json"
    noise.write_text(json.dumps({"tables_bruit": ["A", "B"]}))
    assert scenarios.read_noise(spark, f"file://{noise}") == ["A", "B"]


def test_a_scenario_from_start_to_end(spark, tmp_path):
    tables, turn = scenarios.synthetic(spark, 40), {"after": False}
    moved = scenarios.one_transaction(tables)
    keys = {"CLIENTS": ("ID",), "FACTURES": ("NUM",), "SESSIONS": ("ID",)}
    source = FrameSource(spark, {n: (lambda n=n: (moved if turn["after"] else tables)[n]) for n in tables}, keys)
    profile = P.profile(source)
    assert profile.first_keys() == {"LIGNES": ("NUM_FACT", "RANG"), "COMPTEURS": ("CODE_JOURNAL",)}
    clock = iter([datetime(2024, 6, 1, 10, 14), datetime(2024, 6, 1, 10, 16)])
    session = pipeline.Session(source, f"file://{tmp_path}", profile, noise=["sessions"], sleep=lambda _: None, now=lambda: next(clock))
    with pytest.raises(RuntimeError):
        session.end()
    session.choose({"id": "S", "titre": "t", "valeurs_saisies": [{"champ_ecran": "Montant", "ecran": "F", "valeur": "1 234,56", "type": "montant"}]})
    session.begin()
    turn["after"] = True
    result, found = session.end()
    assert {(r["table"], r.op) for r in result.changes.collect()} == {("CLIENTS", "delete"), ("COMPTEURS", "update"), ("FACTURES", "insert"), ("LIGNES", "insert")}
    assert {(r["table"], r.column, r.match_type) for r in found.links.collect()} == {("FACTURES", "MONTANT", "exacte")}
    computed = {(r["table"], r.column): r.hypotheses for r in found.computed.collect()}
    assert computed["FACTURES", "NUM"] == ["compteur"] and computed["COMPTEURS", "DERNIER_NUM"] == ["compteur"] and "horodatage_systeme" in computed["FACTURES", "DATE_F"]
    assert {r["table"] for r in result.noise.collect()} == {"SESSIONS"} and session.state == "REPOS"


SCHEMA = "id int, v string, gone boolean"


class Feed:
    """Batches, one file each, watched until all are read."""

    def __init__(self, spark, path, **options):
        self.spark, self.path, self.options, self.progress = spark, f"file://{path}", options, []

    def send(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{self.path}/in")

    def run(self):
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{self.path}/in")
        query = feed.watch(stream, "T", ["id"], f"{self.path}/changes", f"{self.path}/check", "gone", **self.options)
        query.awaitTermination()
        self.progress += query.recentProgress

    def changes(self, batch):
        rows = self.spark.read.parquet(f"{self.path}/changes/batch={batch}").collect()
        return {(r.op, r.key["id"], r.before and r.before["v"], r.after and r.after["v"]) for r in rows}


def test_a_feed_gives_the_same_changes_as_snapshots(spark, tmp_path):
    """Repeats in a batch, equal rows, nulls, deletes of keys that are and aren't there; keys that come back; a second run goes on."""
    fed, held = Feed(spark, tmp_path), {}
    batches = [
        [(1, "a", None), (2, "b", False)], [(2, "c", None), (3, "d", None)], [(1, "a", None), (3, None, None)],
        [(9, "z first", None), (9, "a last", None), (2, "b2", None), (2, "c", None)], [(1, "a", True), (8, "x", True), (3, "e", None), (3, "e", True)], [(1, "back", None), (3, "e\u0301", None)],
    ]
    for n, rows in enumerate(batches):
        fed.send(rows)
        if n in (2, 5):
            fed.run()
    text = lambda v: "N:" if v is None else "T:" + unicodedata.normalize("NFC", v)
    for n, rows in enumerate(batches):
        after = dict(held)
        for k, v, gone in rows:
            after[k] = None if gone else text(v)
        want = {("insert" if held.get(k) is None else "delete" if v is None else "update", f"I:{k}", held.get(k), v) for k, v in after.items() if held.get(k) != v}
        assert fed.changes(n) == want
        held = {k: v for k, v in after.items() if v is not None}
    one = spark.read.parquet(f"{fed.path}/changes/batch=1")
    assert [f.name for f in one.schema] == [f.name for f in T.StructType.fromDDL(D.ROW_CHANGES)]


def test_a_batch_of_a_feed_costs_what_it_holds_and_runs_again_alike(spark, tmp_path):
    """Later batches read and write as much state as early ones; a batch whose end wasn't noted gives the same rows again."""
    begun = spark.range(1000).selectExpr("CAST(id AS INT) AS id", "'old' AS v")
    fed = Feed(spark, tmp_path, initial=begun)
    for n in range(12):
        fed.send([(i, f"{n}", None) for i in range(5 * n, 5 * n + 20)])
    fed.run()
    updated = [p.stateOperators[0].numRowsUpdated for p in fed.progress if p.numInputRows]
    assert [p.numInputRows for p in fed.progress if p.numInputRows] == [20] * 12 and updated[1:] == [20] * 11
    assert {p.stateOperators[0].numRowsTotal for p in fed.progress} == {1000}
    first = fed.changes(11)
    assert first == {("update", f"I:{i}", "T:10" if i < 70 else "T:old", "T:11") for i in range(55, 75)}
    for name in ("11", ".11.crc"):
        (tmp_path / "check" / "commits" / name).unlink(missing_ok=True)
    fed.run()
    assert [p.batchId for p in fed.progress if p.numInputRows].count(11) == 2 and fed.changes(11) == first
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")  # the session's own settings are back


def test_many_keys_of_a_feed_share_values_of_the_state(spark, tmp_path, monkeypatch):
    """A call of the state serves a group of keys; the groups are those that the stream began with, whatever it is given later."""
    monkeypatch.setattr(feed, "many", lambda rows: True)
    monkeypatch.setattr(feed, "MANY_GROUPS", 8)
    begun = spark.range(200).selectExpr("CAST(id AS INT) AS id", "CASE WHEN id % 2 = 0 THEN 'a\"\\\\\u00e9' END AS v")
    fed = Feed(spark, tmp_path, initial=begun)
    fed.send([(i, "new", i % 3 == 0) for i in range(150, 250)])
    fed.run()
    old = lambda i: None if i >= 200 else "N:" if i % 2 else "T:a\"\\\u00e9"
    want = {("delete" if i % 3 == 0 else "insert" if i >= 200 else "update", f"I:{i}", old(i), None if i % 3 == 0 else "T:new") for i in range(150, 250) if i < 200 or i % 3}
    assert fed.changes(0) == want
    assert {p.stateOperators[0].numRowsTotal for p in fed.progress} == {8}
    monkeypatch.setattr(feed, "MANY_GROUPS", 5)
    fed.options = {}
    fed.send([(i, None, True) for i in range(250)])
    fed.run()
    gone = {("delete", f"I:{i}", "T:new" if i >= 150 else old(i), None) for i in range(250) if i < 150 or i % 3}
    assert fed.changes(1) == gone and fed.progress[-1].stateOperators[0].numRowsTotal == 0
