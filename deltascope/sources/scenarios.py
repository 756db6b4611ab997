"""Scenario sheets and other small documents, and data to try the engine on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHEETS = (
    "format_version string, lot int, fiches array<struct<id:string,titre:string,lot:int,duree_min:int,prerequis:array<string>,reinitialiser_avant:boolean,"
    "etapes:array<struct<n:int,texte:string,capture_ref:string>>,valeurs_saisies:array<struct<champ_ecran:string,ecran:string,valeur:string,type:string>>,a_noter:array<string>>>"
)
INPUT_TYPES = ("montant", "date", "texte", "code")


def read_sheets(spark: SparkSession, path: str) -> DataFrame:
    """One row a sheet; a sheet without a lot has its file's. Raises on sheets without id, unknown input types and repeated ids."""
    files = spark.read.schema(SHEETS).option("multiLine", True).json(path)
    sheets = files.select("lot", F.explode("fiches").alias("f")).select(*[F.coalesce("f.lot", "lot").alias("lot") if c == "lot" else F.col(f"f.{c}") for c in ("id", "titre", "lot", "duree_min", "prerequis", "reinitialiser_avant", "etapes", "valeurs_saisies", "a_noter")])
    wrong = F.exists(F.coalesce("valeurs_saisies", F.array().cast("array<struct<champ_ecran:string,ecran:string,valeur:string,type:string>>")), lambda v: ~v["type"].isin(*INPUT_TYPES))
    bad = sheets.filter(F.col("id").isNull() | (F.trim("id") == "") | wrong).select("id").take(3)
    twice = sheets.groupBy("id").count().filter("count > 1").take(3)
    if bad or twice:
        raise ValueError(f"invalid sheets {[r.id for r in bad]}, repeated ids {[r.id for r in twice]}")
    return sheets


def read_noise(spark: SparkSession, path: str) -> list[str]:
    rows = spark.read.schema("tables_bruit array<string>").option("multiLine", True).json(path)
    return [r.t for r in rows.select(F.explode("tables_bruit").alias("t")).collect()]


def synthetic(spark: SparkSession, n: int) -> dict[str, DataFrame]:
    """Clients, invoices, lines, counters and sessions; deterministic, any size."""
    clients = spark.range(max(20, n // 20)).selectExpr("cast(id + 1 AS INT) AS ID", "concat('CLIENT ', id + 1) AS NOM", "concat('C', lpad(id + 1, 5, '0')) AS CODE", "cast(id * 1.25 AS DECIMAL(19,4)) AS SOLDE", "timestamp_ntz '2020-01-01 00:00:00' + make_interval(0, 0, 0, int(id % 365)) AS CREE")
    m = max(20, n // 20)
    invoices = spark.range(n).selectExpr("cast(1001 + id AS INT) AS NUM", f"cast(1 + id % {m} AS INT) AS CLIENT_ID", "cast(100 + id * 0.37 AS DECIMAL(19,4)) AS MONTANT", "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id % 365)) AS DATE_F", "if(id % 2 = 0, 'P', 'E') AS STATUT", "if(id % 4 = 0, cast(NULL AS STRING), 'RAS') AS COMMENTAIRE")
    lines = spark.range(2 * n).selectExpr("cast(1001 + id div 2 AS INT) AS NUM_FACT", "cast(1 + id % 2 AS SMALLINT) AS RANG", "concat('REF', id % 50) AS REF", "cast(1 + id % 7 AS INT) AS QTE", "cast(id * 0.11 AS DECIMAL(19,4)) AS DEBIT", "cast(0 AS DECIMAL(19,4)) AS CREDIT")
    counters = spark.createDataFrame([("ACH", 40), ("VTE", 40), ("OD", 3)], "CODE_JOURNAL string, DERNIER_NUM int")
    sessions = spark.range(3).selectExpr("cast(id + 1 AS INT) AS ID", "timestamp_ntz '2024-06-01 08:00:00' AS DERNIER_ACCES")
    return {"CLIENTS": clients, "FACTURES": invoices, "LIGNES": lines, "COMPTEURS": counters, "SESSIONS": sessions}


def one_transaction(tables: dict[str, DataFrame], at: str = "2024-06-01 10:15:00") -> dict[str, DataFrame]:
    """What another program writes in one go: an invoice with two lines, its counter, a session's time; the last client goes."""
    last = tables["FACTURES"].agg(F.max("NUM").alias("last"))
    invoice = last.selectExpr("cast(last + 1 AS INT) AS NUM", "5 AS CLIENT_ID", "cast(1234.56 AS DECIMAL(19,4)) AS MONTANT", f"timestamp_ntz '{at}' AS DATE_F", "'P' AS STATUT", "'TEST-SIM' AS COMMENTAIRE")
    lines = last.selectExpr("cast(last + 1 AS INT) AS NUM_FACT", "explode(array(named_struct('r', 1, 'd', 1000.00), named_struct('r', 2, 'd', 234.56))) AS x").selectExpr("NUM_FACT", "cast(x.r AS SMALLINT) AS RANG", "'REF-SIM' AS REF", "1 AS QTE", "cast(x.d AS DECIMAL(19,4)) AS DEBIT", "cast(0 AS DECIMAL(19,4)) AS CREDIT")
    gone = tables["CLIENTS"].agg(F.max("ID").alias("ID"))
    return {
        "CLIENTS": tables["CLIENTS"].join(gone, "ID", "left_anti"), "FACTURES": tables["FACTURES"].unionByName(invoice), "LIGNES": tables["LIGNES"].unionByName(lines),
        "COMPTEURS": tables["COMPTEURS"].withColumn("DERNIER_NUM", F.expr("if(CODE_JOURNAL = 'ACH', DERNIER_NUM + 1, DERNIER_NUM)")),
        "SESSIONS": tables["SESSIONS"].withColumn("DERNIER_ACCES", F.expr(f"if(ID = 1, timestamp_ntz '{at}', DERNIER_ACCES)")),
    }
