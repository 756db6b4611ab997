"""Traces: one JSON document a run, its HTML report, and publication of both.

These are small documents about a single run; they are assembled on the driver
from results that a person is going to read.
"""

from __future__ import annotations

import hashlib
import html
import json
import os
import re
import shutil
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.canonical import NULL
from ..operators.diff import ROW_CHANGES, DiffResult, summary

FORMAT_VERSION = "1.0"
COLLAPSE_BEYOND = 30


def json_value(text: str | None):
    """A canonical text as JSON: integers and booleans as numbers, amounts and floats as exact strings, dates in ISO form."""
    if text is None or text == NULL:
        return None
    kind, value = text[0], text[2:]
    if kind in "IL":
        return int(value)
    return f"sha256:{value}" if kind == "B" else value


def typed_text(value) -> str:
    """The way back: JSON value -> canonical text. Four decimals make an amount, ISO forms make dates if they exist; other texts stay texts."""
    if value is None:
        return NULL
    if isinstance(value, bool):
        return f"L:{int(value)}"
    if isinstance(value, int):
        return f"I:{value}"
    if re.fullmatch(r"-?\d+\.\d{4}", value):
        return f"M:{value}"
    for shape, tag in ((r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?", "D"), (r"\d{4}-\d\d-\d\d", "J")):
        if re.fullmatch(shape, value):
            try:
                datetime.fromisoformat(value)
            except ValueError:
                break
            return f"{tag}:{value}"
    return f"T:{value}"


def retyped(value: F.Column) -> F.Column:
    """typed_text for a column of JSON strings."""
    stamp = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,6})?$"
    return (
        F.when(value.isNull(), NULL).when(value.rlike(r"^-?\d+\.\d{4}$"), F.concat(F.lit("M:"), value))
        .when(value.rlike(stamp) & F.try_to_timestamp(value).isNotNull(), F.concat(F.lit("D:"), value))
        .when(value.rlike(r"^\d{4}-\d\d-\d\d$") & value.try_cast("date").isNotNull(), F.concat(F.lit("J:"), value))
        .otherwise(F.concat(F.lit("T:"), value))
    )


def _values(row: dict | None) -> dict:
    return {k: json_value(v) for k, v in (row or {}).items()}


def _fields(before: dict, after: dict) -> list[dict]:
    return [{"colonne": k, "avant": json_value(before.get(k)), "apres": json_value(v)} for k, v in after.items() if before.get(k) != v]


#: The list of a table's entry that holds each kind of change.
LISTS = {"insert": "inserts", "update": "updates", "delete": "deletes", "row_added": "lignes_ajoutees", "row_removed": "lignes_supprimees", "probable_update": "updates_probables"}


def _change_to_json(r) -> dict:
    if r.op in ("insert", "delete"):
        return {"cle": _values(r.key), "valeurs": _values(r.after if r.op == "insert" else r.before)}
    if r.op == "update":
        return {"cle": _values(r.key), "champs": _fields(r.before, r.after)}
    if r.op == "probable_update":
        return {"avant": _values(r.before), "apres": _values(r.after), "champs": _fields(r.before, r.after)}
    return {"valeurs": _values(r.after if r.op == "row_added" else r.before)}


def changes_to_json(changes: DataFrame) -> list[dict]:
    tables: dict[str, dict] = {}
    for r in changes.orderBy("table", "op", "ord", "row_id").toLocalIterator():
        if r["table"] not in tables:
            own = ("row_added", "row_removed") if r.key_type == "aucune" else ("insert", "update", "delete")
            key = {"type": r.key_type, "colonnes": list(r.key or ())}
            tables[r["table"]] = {"table": r["table"], "cle_utilisee": key} | {LISTS[op]: [] for op in (*own, "probable_update")}
        tables[r["table"]][LISTS[r.op]].append(_change_to_json(r))
    return list(tables.values())


def changes_from_json(spark: SparkSession, changes: list[dict]) -> DataFrame:
    """ROW_CHANGES again; updates hold only their key and changed fields."""
    rows, n = [], 0
    text = lambda d: None if d is None else {k: typed_text(v) for k, v in d.items()}
    for t in changes:
        for op, name in LISTS.items():
            for c in t.get(name) or []:
                n += 1
                before, after = c.get("avant"), c.get("apres")
                if op == "update":
                    before, after = ({f["colonne"]: f[side] for f in c["champs"]} for side in ("avant", "apres"))
                elif op in ("insert", "row_added"):
                    after = c["valeurs"]
                elif op in ("delete", "row_removed"):
                    before = c["valeurs"]
                rows.append((t["table"], t["cle_utilisee"]["type"], op, n, text(c.get("cle")), text(before), text(after), n))
    return spark.createDataFrame(rows, ROW_CHANGES)


def _records(df: DataFrame, **names) -> list[dict]:
    return [{names.get(k, k): v for k, v in r.asDict().items()} for r in df.toLocalIterator()]


def interpretation_parts(found) -> dict:
    """Links, computed fields, deviations and warnings of an interpretation, under the document's names."""
    return {
        "liens": _records(found.links, field="champ_ecran", screen="ecran", value="valeur", column="colonne", match_type="type_correspondance", confidence="confiance"),
        "champs_calcules": [c | {"valeur": json_value(c["valeur"])} for c in _records(found.computed, column="colonne", value="valeur")],
        "ecarts_saisie": _records(found.deviations, field="champ_ecran", screen="ecran", expected="valeur_attendue", kind="type", column="colonne", found="valeur_trouvee"),
        "avertissements": _records(found.warnings),
    }


def build_trace(scenario: dict, execution: dict, base: dict, diff: DiffResult | None, interpretation) -> dict:
    """The document; a cancelled run keeps no comparison."""
    if execution.get("statut") == "annulee":
        diff, interpretation = None, None
    parts = interpretation_parts(interpretation) if interpretation else {"liens": [], "champs_calcules": [], "ecarts_saisie": [], "avertissements": []}
    return {
        "format_version": FORMAT_VERSION, "fiche": {k: scenario[k] for k in ("id", "titre", "valeurs_saisies")}, "execution": execution, "base": base,
        "changements": changes_to_json(diff.changes) if diff else [],
        "bruit": [{"table": r["table"], "resume": r["summary"]} for r in summary(diff.noise).orderBy("table").collect()] if diff else [],
        "liens": parts["liens"], "champs_calcules": parts["champs_calcules"], "ecarts_saisie": parts["ecarts_saisie"],
        "schema_modifie": list(diff.schema_changes) if diff else [], "avertissements": [*(diff.warnings if diff else []), *parts["avertissements"]],
    }


def duration(execution: dict) -> str:
    """How long a run took, in minutes and seconds; empty if its bounds can't be read."""
    try:
        seconds = int((datetime.fromisoformat(execution["fin"]) - datetime.fromisoformat(execution["debut"])).total_seconds())
    except (KeyError, TypeError, ValueError):
        return ""
    return f"{seconds // 60} min {seconds % 60:02d} s" if seconds >= 60 else f"{seconds} s"


def read_trace(path: str) -> dict:
    with open(path, encoding="utf-8-sig") as f:
        found = json.load(f)
    missing = {"format_version", "fiche", "execution", "changements"} - found.keys()
    if missing or found["format_version"] != FORMAT_VERSION:
        raise ValueError(f"not a trace of version {FORMAT_VERSION}: {sorted(missing)}")
    return found


def read_trace_folder(spark: SparkSession, folder: str) -> DataFrame:
    """path, id, start, status of all */trace.json; hidden folders are left out, unreadable files have nulls. Newest first."""
    schema = "fiche struct<id:string,titre:string>, execution struct<debut:string,statut:string>, _corrupt_record string"
    read = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
    try:
        rows = read.json(f"{folder}/*/trace.json")
    except AnalysisException as none:
        if "PATH_NOT_FOUND" not in str(none):
            raise
        return spark.createDataFrame([], "path string, id string, start string, status string")
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("fiche.id").alias("id"), F.col("execution.debut").alias("start"), F.col("execution.statut").alias("status"))
    return rows.filter(~F.element_at(F.split("path", "/"), -2).startswith(".")).orderBy(F.desc("start"), "path")


def render_report(trace: dict) -> str:
    """A self-contained page; long tables are collapsed."""
    e = lambda v: html.escape("" if v is None else str(v))

    def section(title: str, rows: list[dict]) -> str:
        if not rows:
            return ""
        heads = list(dict.fromkeys(k for r in rows for k in r))
        cell = lambda v: e(json.dumps(v, ensure_ascii=False) if isinstance(v, (dict, list)) else v)
        lines = "".join("<tr>" + "".join(f"<td>{cell(r.get(h))}</td>" for h in heads) + "</tr>" for r in rows)
        table = "<table><tr>" + "".join(f"<th>{e(h)}</th>" for h in heads) + f"</tr>{lines}</table>"
        if len(rows) > COLLAPSE_BEYOND:
            table = f"<details><summary>{len(rows)} lignes</summary>{table}</details>"
        return f"<h2>{e(title)}</h2>{table}"

    parts = [f"<h1>{e(trace['fiche']['id'])} – {e(trace['fiche'].get('titre'))}</h1>", f"<p>{e(trace['execution'].get('debut'))} – {e(trace['execution'].get('fin'))} ({e(duration(trace['execution']))}) : {e(trace['execution'].get('statut'))}</p>"]
    for t in trace["changements"]:
        for name in filter(t.get, LISTS.values()):
            parts.append(section(f"{t['table']} – {name}", t[name]))
    for name in ("liens", "champs_calcules", "ecarts_saisie", "schema_modifie", "bruit", "avertissements"):
        parts.append(section(name, trace[name]))
    style = "body{font-family:sans-serif}table{border-collapse:collapse}td,th{border:1px solid #999;padding:2px 6px}"
    return f"<!doctype html><html lang='fr'><meta charset='utf-8'><style>{style}</style><body>{''.join(parts)}</body></html>"


def render_index(entries: list[dict]) -> str:
    rows = "".join(f"<tr><td>{html.escape(x['start'] or '')}</td><td>{html.escape(x['id'] or 'illisible')}</td><td>{html.escape(x['status'] or '')}</td></tr>" for x in entries)
    return f"<!doctype html><meta charset='utf-8'><table>{rows}</table>"


def render_relations(relations: list[dict]) -> str:
    """An SVG of tables in a circle and the relations between them; weak ones are left out."""
    from math import cos, pi, sin

    strong = [r for r in relations if r["confidence"] != "faible"]
    names = sorted({r["src_table"] for r in strong} | {r["dst_table"] for r in strong})
    at = {n: (300 + 220 * cos(2 * pi * i / max(1, len(names))), 300 + 220 * sin(2 * pi * i / max(1, len(names)))) for i, n in enumerate(names)}
    lines = "".join("<line x1='{:.0f}' y1='{:.0f}' x2='{:.0f}' y2='{:.0f}' stroke='#888'/>".format(*at[r["src_table"]], *at[r["dst_table"]]) for r in strong)
    texts = "".join(f"<text x='{x:.0f}' y='{y:.0f}'>{html.escape(n)}</text>" for n, (x, y) in at.items())
    return f"<svg xmlns='http://www.w3.org/2000/svg' width='600' height='600'>{lines}{texts}</svg>"


def safe_name(text: str) -> str:
    return re.sub(r"[^A-Za-z0-9_-]+", "_", text)


def write_trace(trace: dict, folder: str) -> str:
    """A new folder, written under a hidden name and renamed; an existing one is never overwritten."""
    name = base = f"{re.sub(r'[^0-9]', '', trace['execution']['debut'])}_{safe_name(trace['fiche']['id'])}"
    n = 1
    while os.path.exists(f"{folder}/{name}"):
        n += 1
        name = f"{base}_{n}"
    hidden = f"{folder}/.{name}"
    os.makedirs(hidden)
    with open(f"{hidden}/trace.json", "w", encoding="utf-8") as f:
        json.dump(trace, f, ensure_ascii=False, indent=2)
    with open(f"{hidden}/rapport.html", "w", encoding="utf-8") as f:
        f.write(render_report(trace))
    os.rename(hidden, f"{folder}/{name}")
    return f"{folder}/{name}"


def _digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def publish(local: str, share: str) -> str:
    """Copies a trace folder to the share: hidden, verified by SHA-256, then renamed. `published`, or `pending` with a marker when the share fails."""
    name = os.path.basename(local)
    hidden, final, marker = f"{share}/.{name}", f"{share}/{name}", f"{local}/.en_attente"
    try:
        if os.path.exists(final):
            if _digest(f"{final}/trace.json") != _digest(f"{local}/trace.json"):
                raise FileExistsError(final)
        else:
            shutil.rmtree(hidden, ignore_errors=True)
            shutil.copytree(local, hidden, ignore=shutil.ignore_patterns(".en_attente"))
            for f in os.listdir(hidden):
                if _digest(f"{hidden}/{f}") != _digest(f"{local}/{f}"):
                    raise OSError(f"copy differs: {f}")
            os.rename(hidden, final)
    except OSError:
        open(marker, "w").close()
        return "pending"
    if os.path.exists(marker):
        os.remove(marker)
    return "published"


def publish_pending(folder: str, share: str) -> dict[str, str]:
    return {n: publish(f"{folder}/{n}", share) for n in sorted(os.listdir(folder)) if os.path.exists(f"{folder}/{n}/.en_attente")}


def mask(text: str, secrets) -> str:
    """Secrets become asterisks, longest first."""
    for s in sorted(filter(None, secrets), key=len, reverse=True):
        text = text.replace(s, "***")
    return text


def fake_amount(amount: F.Column, salt: str = "") -> F.Column:
    """An amount that depends only on the given one: two decimals, below ten million."""
    digits = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), amount.cast("string")).cast("binary"), 256), 1, 10), 16, 10).cast("decimal(20,0)")
    return ((digits % 1_000_000_000) / 100).cast("decimal(18,4)")


def anonymised(updates: DataFrame, salt: str = "") -> DataFrame:
    """before, after -> fictitious amounts with the same difference."""
    start = fake_amount(F.col("before"), salt)
    return updates.withColumns({"fake_before": start, "fake_after": (start + (F.col("after") - F.col("before"))).cast("decimal(18,4)")})
