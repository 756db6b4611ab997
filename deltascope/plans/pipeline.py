"""The pipelines users call: interpret, calibrate, re-analyse, run a scenario."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.matching import glob, trivial
from ..operators import cells as C
from ..operators import diff as D
from ..operators import hypotheses as H
from ..operators import links as L
from ..operators.profile import Profile
from ..operators.snapshot import Snapshot, take_snapshot
from ..sources.catalog import Source
from ..sources.storage import few, new_path, written

WARNINGS = "table string, code string, message string, details map<string,string>"
#: Hypotheses that need the first snapshot or the profile: offline they are taken over from the original.
NOT_OFFLINE = ("compteur", "somme_lignes", "copie", "constante")
#: Warnings of an interpretation, which a new one replaces.
INTERPRETATION_WARNINGS = ("valeur_saisie_invalide", "profil_absent", "non_recalculable_hors_ligne", "reanalyse")


@dataclass
class Interpretation:
    links: DataFrame
    deviations: DataFrame
    computed: DataFrame
    warnings: DataFrame

    @property
    def has_deviation(self) -> bool:
        return not self.deviations.isEmpty()


def interpret(
    spark: SparkSession, changes: DataFrame, before: Snapshot | None, inputs: DataFrame, start: datetime, end: datetime,
    profile: Profile | None = None, ignored_tables=H.IGNORED_TABLES,
) -> Interpretation:
    """Links and deviations of the inputs, then hypotheses for every cell that no input explains."""
    changes = written(changes, "changes")
    cells = written(C.extract_cells(changes), "cells")
    found = written(L.matches(inputs, cells), "matches")
    warnings = L.invalid_inputs(L.prepared(inputs))
    if profile is None:
        names = ", ".join(H.NEEDS_PROFILE)
        row = (None, "profil_absent", f"Sans profil, ces hypothèses ne sont pas examinées : {names}.", {"hypotheses_desactivees": names})
        warnings = warnings.unionByName(spark.createDataFrame([row], WARNINGS))
    rows = {n: t.rows for n, t in before.tables.items()} if before else {}
    context = H.Context(changes, cells, inputs, start, end, rows, profile.columns if profile else None, profile.relations if profile else None, tuple(ignored_tables))
    return Interpretation(L.links(found), L.deviations(inputs, cells, found), H.computed_fields(cells, L.explained(found), context), warnings)


@dataclass
class Calibration:
    start: datetime
    end: datetime
    interval: float
    proposed: dict[str, str] = field(default_factory=dict)
    ignored: list[str] = field(default_factory=list)
    noise: list[str] = field(default_factory=list)

    def validate(self, tables) -> None:
        """The user's choice, a subset of what is proposed, in the order proposed."""
        unknown = set(tables) - self.proposed.keys()
        if unknown:
            raise ValueError(f"not proposed by the calibration: {sorted(unknown)}")
        self.noise = [t for t in self.proposed if t in set(tables)]


def calibrate(source: Source, interval: float = 30.0, ignored=(), path: str | None = None, sleep: Callable = time.sleep, now: Callable = datetime.now) -> Calibration:
    """Two snapshots without an action between them: what changes anyway is noise. Keys aren't guessed here. Both are written (without a path, to the shared folder): the source changes meanwhile."""
    start, path = now(), path or new_path(source.spark, "calibration")
    before = take_snapshot(source, ignored, f"{path}/before")
    sleep(interval)
    source.refresh()
    after = take_snapshot(source, ignored, f"{path}/after")
    result = D.diff_snapshots(source.spark, before, after)
    found = Calibration(start, now(), interval, ignored=sorted(ignored))
    found.proposed = {r["table"]: r["summary"] for r in D.summary(result.changes).orderBy("table").collect()}  # a row a table
    for change in result.schema_changes:
        found.proposed.setdefault(change["table"], "schéma modifié")
    found.noise = list(found.proposed)
    return found


def original_hypotheses(computed: DataFrame) -> DataFrame:
    """computed(table, column, value, hypotheses, details) of a trace -> one row a hypothesis, with its own detail."""
    parts = F.filter(F.split("details", " ; "), lambda p: p.contains(" : "))
    own = F.element_at(F.filter(parts, lambda p: F.split_part(p, F.lit(" : "), F.lit(1)) == F.col("h")), -1)
    rest = F.substr(own, F.length("h") + 4)
    detail = F.when(F.size("hypotheses") == 1, F.col("details")).otherwise(F.coalesce(rest, F.lit("")))
    return computed.withColumn("h", F.explode("hypotheses")).select("table", "column", "value", F.col("h").alias("hypothesis"), detail.alias("detail"))


def reusable(cells: DataFrame, original: DataFrame, ignored_tables=H.IGNORED_TABLES) -> DataFrame:
    """Original hypotheses that can't be recomputed offline, as far as today's rules still admit them."""
    met = cells.join(original.filter(F.col("hypothesis").isin(*NOT_OFFLINE)), ["table", "column", "value"])
    source = F.regexp_extract("detail", r"(?s)^copie de (.+)\.[^.]+ \(ligne ", 1)
    copy_ok = ~trivial(F.col("value")) & ~((source != "") & glob(source, ignored_tables))
    digits = H.split_code(F.col("value"))[1]
    counter_ok = F.col("is_insert") & ((F.substring("value", 1, 2) == "I:") | digits.isNotNull())
    kept = F.when(F.col("hypothesis") == "copie", copy_ok).when(F.col("hypothesis") == "compteur", counter_ok).otherwise(F.lit(True))
    place = F.array_position(F.array(*[F.lit(h) for h in H.ORDER]), F.col("hypothesis")) - 1
    return met.filter(kept).select(*H.REF, "detail", "hypothesis", place.cast("int").alias("place")).distinct()


def reanalyse(spark: SparkSession, changes: DataFrame, inputs: DataFrame, start: datetime, end: datetime, original: DataFrame, ignored_tables=H.IGNORED_TABLES) -> Interpretation:
    """The interpretation of a trace read back, without the database: links, deviations and the hypotheses that the trace alone decides are found anew."""
    cells = C.extract_cells(changes).persist()
    found = L.matches(inputs, cells).persist()
    explained = L.explained(found)
    context = H.Context(changes, cells, inputs, start, end, ignored_tables=tuple(ignored_tables))
    open_cells = cells.join(explained, H.REF, "left_anti").filter("value <> 'N:'")
    reused = reusable(open_cells, original_hypotheses(original), ignored_tables)
    message = F.concat("table", F.lit("."), "column", F.lit(" : « "), "hypothesis", F.lit(" » vient de la première analyse, la base manquant pour la vérifier."))
    notes = reused.select("table", "column", "hypothesis").distinct().select(
        "table", F.lit("non_recalculable_hors_ligne").alias("code"), message.alias("message"), F.create_map(F.lit("colonne"), "column", F.lit("hypothese"), "hypothesis").alias("details")
    )
    warnings = L.invalid_inputs(L.prepared(inputs)).unionByName(notes)
    return Interpretation(L.links(found), L.deviations(inputs, cells, found), H.computed_fields(cells, explained, context, reused), warnings)


def status(cancelled: bool, interpretation: Interpretation | None) -> str:
    if cancelled:
        return "annulee"
    return "ecart_saisie" if interpretation is not None and interpretation.has_deviation else "terminee"


def latest_status(runs: DataFrame, sheets: DataFrame) -> DataFrame:
    """runs(id, start, status), sheets(id) -> id, status of the latest run; `a_faire` without one."""
    last = runs.groupBy("id").agg(F.max_by("status", "start").alias("status"))
    return sheets.join(last, "id", "left").select("id", F.coalesce("status", F.lit("a_faire")).alias("status"))


class Session:
    """One scenario at a time: choose, start (first snapshot), end (second snapshot, diff, interpretation), or cancel."""

    def __init__(self, source: Source, work: str, profile: Profile | None = None, noise=(), ignored=(), settle: float = 3.0, sleep=time.sleep, now=datetime.now):
        self.source, self.work, self.profile, self.noise, self.ignored = source, work, profile, tuple(noise), tuple(ignored)
        self.settle, self.sleep, self.now, self.state, self.scenario = settle, sleep, now, "REPOS", None

    def _expect(self, *states: str) -> None:
        if self.state not in states:
            raise RuntimeError(f"not possible in state {self.state}")

    def choose(self, scenario: dict) -> None:
        self._expect("REPOS", "FICHE_CHOISIE")
        self.scenario, self.state = scenario, "FICHE_CHOISIE"

    def begin(self) -> None:
        self._expect("FICHE_CHOISIE")
        self.state = "DEBUT_EN_COURS"
        self.source.refresh()
        self.before = take_snapshot(self.source, self.ignored, f"{self.work}/before")
        self.start, self.state = self.now(), "EN_COURS"

    def cancel(self) -> None:
        self._expect("EN_COURS")
        self.state = "REPOS"

    def end(self) -> tuple[D.DiffResult, Interpretation]:
        self._expect("EN_COURS")
        self.state, end = "FIN_EN_COURS", self.now()
        self.sleep(self.settle)  # the other program may still be writing
        self.source.refresh()
        spark = self.source.spark
        after = take_snapshot(self.source, self.ignored, f"{self.work}/after")
        result = D.diff_snapshots(spark, self.before, after, self.profile.first_keys() if self.profile else None, self.noise)
        inputs = [(i, v["champ_ecran"], v["ecran"], v["valeur"], v["type"]) for i, v in enumerate(self.scenario["valeurs_saisies"])]
        frame = few(spark, inputs, L.INPUTS)
        found = interpret(spark, result.changes, self.before, frame, self.start, end, self.profile)
        self.state = "REPOS"
        return result, found
