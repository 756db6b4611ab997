"""Links from typed values to written cells, and deviations where there is none.

Inputs are few (a scenario's sheet); each is turned into the texts, numbers and
days it may appear as, so most rules are equi-joins on one of these; only the
truncation rule compares prefixes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import body, day, moment, nfc, number, plain, tag
from ..functions.matching import amount, deletion_keys, one_edit_apart, typed_day
from ..sources.storage import by_shuffle, many, written

INPUTS = "input_id int, field string, screen string, value string, type string"
#: Match types with their confidence; exact ones suppress the others.
CONFIDENCE = {"exacte": "haute", "espaces_fin": "haute", "date_heure": "haute", "signe_inverse": "moyenne", "majuscules": "moyenne", "tronque": "moyenne", "x100": "faible", "div100": "faible"}
EXACT = ("exacte", "espaces_fin")
MIN_PREFIX, MIN_DEVIATION = 3, 4


def prepared(inputs: DataFrame) -> DataFrame:
    """Inputs with amt, d (day) and txt (NFC); `valid` is false for an amount or a day that can't be read."""
    amt = F.when(F.col("type") == "montant", amount(F.col("value")))
    d = F.when(F.col("type") == "date", typed_day(F.col("value")))
    valid = F.when(F.col("type") == "montant", F.col("amt").isNotNull()).when(F.col("type") == "date", F.col("d").isNotNull()).otherwise(F.lit(True))
    return inputs.withColumns({"amt": amt, "d": d, "txt": nfc(F.col("value"))}).withColumn("valid", valid)


def invalid_inputs(ready: DataFrame) -> DataFrame:
    """Warnings for inputs that can't be sought; these are no deviations."""
    message = F.concat("field", F.lit(" : « "), "value", F.lit(" » ne se lit pas comme "), "type", F.lit(", saisie laissée de côté."))
    details = F.create_map(F.lit("champ_ecran"), "field", F.lit("ecran"), "screen")
    return ready.filter("NOT valid").select(F.lit(None).cast("string").alias("table"), F.lit("valeur_saisie_invalide").alias("code"), message.alias("message"), details.alias("details"))


def match_type(cell: Column) -> Column:
    """How a canonical cell matches the input beside it; NULL if it doesn't."""
    kind, amt, d, txt = F.col("type"), F.col("amt"), F.col("d"), F.col("txt")
    n, text, is_text = number(cell), body(cell), tag(cell) == "T"
    at_midnight = F.date_trunc("day", moment(cell)) == moment(cell)
    money = (
        F.when(n == amt, "exacte").when((n == -amt) & (amt != 0), "signe_inverse")
        .when(n == F.try_multiply(amt, F.lit(100).cast("decimal(3,0)")), "x100").when(F.try_multiply(n, F.lit(100).cast("decimal(3,0)")) == amt, "div100")
    )
    date = F.when(day(cell) == d, F.when((tag(cell) == "D") & ~at_midnight, "date_heure").otherwise("exacte")).when(is_text & (typed_day(text) == d), "exacte")
    trailing = is_text & (F.rtrim(text) == F.rtrim(txt))
    code = F.when((n == F.floor(n)) & (n.cast("decimal(38,0)").cast("string") == txt), "exacte").when(is_text & (text == txt), "exacte").when(trailing, "espaces_fin")
    cut = (F.length(text) >= MIN_PREFIX) & (F.length(text) < F.length(txt)) & txt.startswith(text)
    prose = F.when(is_text & (text == txt), "exacte").when(trailing, "espaces_fin").when(is_text & (text == F.upper(txt)), "majuscules").when(is_text & cut, "tronque")
    return F.when(kind == "montant", money).when(kind == "date", date).when(kind == "code", code).when(kind == "texte", prose)


def meeting_keys(ready: DataFrame) -> DataFrame:
    """Inputs, once for each key under which a matching cell can be found."""
    amt = F.col("amt")
    numbers = F.array(*[plain(x) for x in (amt, -amt, F.try_multiply(amt, F.lit(100).cast("decimal(3,0)")), amt * F.lit("0.01").cast("decimal(3,2)"))])
    txt = F.col("txt")
    cuts = F.when(F.length(txt) > MIN_PREFIX, F.transform(F.sequence(F.lit(MIN_PREFIX), F.length(txt) - 1), lambda i: F.concat(F.lit("t:"), F.rtrim(F.substr(txt, F.lit(1), i))))).otherwise(F.array().cast("array<string>"))
    texts = F.array(F.concat(F.lit("t:"), F.rtrim(txt)), F.concat(F.lit("t:"), F.rtrim(F.upper(txt))))
    keys = (
        F.when(F.col("type") == "montant", F.transform(numbers, lambda x: F.concat(F.lit("n:"), x)))
        .when(F.col("type") == "date", F.array(F.concat(F.lit("d:"), F.col("d").cast("string"))))
        .when(F.col("type") == "code", F.concat(texts, F.array(F.concat(F.lit("n:"), txt))))
        .otherwise(F.concat(texts, cuts))
    )
    return ready.filter("valid").withColumn("k", F.explode(F.array_distinct(F.filter(keys, lambda x: x.isNotNull()))))


def cell_keys(cells: DataFrame) -> DataFrame:
    cell = F.col("value")
    when = F.coalesce(day(cell), F.when(tag(cell) == "T", typed_day(body(cell))))
    keys = F.array(F.concat(F.lit("n:"), plain(number(cell))), F.concat(F.lit("d:"), when.cast("string")), F.when(tag(cell) == "T", F.concat(F.lit("t:"), F.rtrim(body(cell)))))
    return cells.withColumn("k", F.explode(F.filter(keys, lambda x: x.isNotNull())))


def value_pairs(inputs: DataFrame, cells: DataFrame) -> DataFrame:
    """input, type, value, match_type: typed values with the written ones that they match. Values are compared once, however many inputs and cells hold them, so pairs grow with the different values."""
    left = meeting_keys(prepared(inputs.select("value", "type").distinct())).withColumnRenamed("value", "input")
    # a typed and a written value share one key at most, so no pair is met twice
    met = by_shuffle(left, many(inputs)).join(cell_keys(cells.select("value").distinct()), "k").withColumn("match_type", match_type(F.col("value"))).filter("match_type IS NOT NULL")
    return written(met.select("input", "type", "value", "match_type"), "value-pairs")


def linked_inputs(inputs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Inputs (equal ones once) with a match, and `has_exact`: whether an exact one suppresses the tolerated ones of the same input_id."""
    best = pairs.groupBy("input", "type").agg(F.max(F.col("match_type").isin(*EXACT)).alias("has_exact"))
    asked = inputs.filter("input_id IS NOT NULL").select("input_id", "field", "screen", F.col("value").alias("input"), "type").distinct().join(by_shuffle(best, many(pairs)), ["input", "type"])
    return asked.withColumn("has_exact", F.max("has_exact").over(Window.partitionBy("input_id")))


def _kept(df: DataFrame) -> DataFrame:
    return df.filter(F.col("match_type").isin(*EXACT) | ~F.col("has_exact"))


def matches(inputs: DataFrame, cells: DataFrame, carry=()) -> DataFrame:
    """input_id, field, screen, input, table, row_id, column, match_type and the cells' columns of `carry`: what stays after exact matches have suppressed tolerated ones of the same input. Inputs and cells with equal values meet last, and nothing is shuffled after that."""
    pairs = value_pairs(inputs, cells)
    at = by_shuffle(pairs, many(pairs)).join(cells.select("table", "row_id", "column", "value", *carry), "value")
    found = _kept(linked_inputs(inputs, pairs).join(by_shuffle(at, many(inputs)), ["input", "type"]))
    return found.select("input_id", "field", "screen", "input", "type", "table", "row_id", "column", "match_type", *carry)


def match_counts(inputs: DataFrame, cells: DataFrame) -> DataFrame:
    """input_id, n, is_exact: how many of `matches` each input has, counted by values and not by pairs of inputs and cells."""
    pairs = value_pairs(inputs, cells)
    held = cells.groupBy("value").agg(F.count("*").alias("n"))
    exact = F.col("match_type").isin(*EXACT).alias("exact")
    n = by_shuffle(pairs, many(pairs)).join(held, "value").groupBy("input", "type", "match_type").agg(F.sum("n").alias("n"))
    found = _kept(linked_inputs(inputs, pairs).join(by_shuffle(n, many(inputs)), ["input", "type"]))
    return found.groupBy("input_id").agg(F.sum("n").alias("n"), F.max(exact).alias("is_exact"))


def links(found: DataFrame) -> DataFrame:
    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])[F.col("match_type")]
    return found.select("field", "screen", F.col("input").alias("value"), "table", "column", "match_type", confidence.alias("confidence")).distinct()


def explained(found: DataFrame) -> DataFrame:
    return found.select("table", "row_id", "column").distinct()


def deviations(inputs: DataFrame, cells: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """Inputs without any link: `valeur_differente` where an unexplained cell in a sister's column is one edit away (the first such cell), else `introuvable`. Without `found` (the matches) these are sought by values, and pairs of inputs and cells are never made."""
    if found is None:
        pairs = value_pairs(inputs, cells)
        asked = written(linked_inputs(inputs, pairs), "linked-inputs")
        shown = asked.select("field", "screen", "input", "type", "has_exact").distinct().join(by_shuffle(pairs, many(pairs)), ["input", "type"])
        shown = written(_kept(shown).select("field", "screen", "value").distinct(), "explained")
        # which cells are explained depends on their values alone
        known, on, linked = shown.select("value").distinct(), ["value"], asked.select("input_id").distinct()
        sisters = cells.select("table", "column", "value").distinct().join(by_shuffle(shown, many(shown)), "value").select("field", "screen", "table", "column").distinct()
    else:
        known, on, linked = written(explained(found), "explained"), ["table", "row_id", "column"], found.select("input_id").distinct()
        sisters = found.select("field", "screen", "table", "column").distinct()
    lost = prepared(inputs).filter("valid").join(by_shuffle(linked, many(inputs)), "input_id", "left_anti")
    target = F.when(F.col("type") == "montant", plain(F.col("amt"))).when(F.col("type") == "date", F.col("d").cast("string")).otherwise(F.rtrim("txt"))
    lost = lost.withColumn("target", target)
    # sisters and kinds are as many as screens have fields: broadcast, lest all cells of a column meet in one task
    free = cells.select("table", "row_id", "column", "value", *(["ord"] if "ord" in cells.columns else [])).join(F.broadcast(sisters), ["table", "column"])
    free = free.join(by_shuffle(known, many(known)), on, "left_anti")
    cell = F.col("found")
    n = number(cell)
    whole = F.when(n == F.floor(n), n.cast("decimal(38,0)").cast("string"))
    shape = (
        F.when(F.col("type") == "montant", plain(n)).when(F.col("type") == "date", F.coalesce(day(cell), F.when(tag(cell) == "T", typed_day(body(cell)))).cast("string"))
        .otherwise(F.when(tag(cell) == "T", F.rtrim(body(cell))).otherwise(whole))
    )
    sought, order = ["field", "screen", "type", "target"], ["table", *(["ord"] if "ord" in cells.columns else []), "row_id", "column"]
    long_enough = ~F.col("type").isin("texte", "code") | (F.length("target") >= MIN_DEVIATION)
    wanted = lost.filter(long_enough & F.col("target").isNotNull()).select(*sought).distinct()
    # each value once, with its first cell; a value and a target one edit apart share a key of their deletion neighbourhoods
    kinds = wanted.select("field", "screen", "type").distinct()
    values = free.withColumnRenamed("value", "found").join(F.broadcast(kinds), ["field", "screen"]).withColumn("shape", shape).filter("shape IS NOT NULL")
    values = written(values.groupBy("field", "screen", "type", "shape").agg(F.min(F.struct(*order, "found")).alias("first")), "free-values")
    shapes = values.select("field", "screen", "type", "shape").withColumn("k", F.explode(deletion_keys("shape")))
    near = by_shuffle(wanted.withColumn("k", F.explode(deletion_keys("target")))).join(shapes, ["field", "screen", "type", "k"])
    near = near.filter((F.col("shape") != F.col("target")) & one_edit_apart(F.col("shape"), F.col("target"))).select(*sought, "shape").distinct()
    near = near.join(by_shuffle(values), ["field", "screen", "type", "shape"])
    near = near.groupBy(*sought).agg(F.min("first").alias("first")).select(*sought, "first.table", "first.column", "first.found")
    kind = F.when(F.col("found").isNotNull(), "valeur_differente").otherwise("introuvable")
    return lost.join(by_shuffle(near), sought, "left").select("field", "screen", F.col("value").alias("expected"), kind.alias("kind"), "table", "column", F.substring("found", 3, 1 << 30).alias("found"))
