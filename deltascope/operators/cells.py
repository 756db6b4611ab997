"""Written cells: one row for each field that an insert or update wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INSERTS = ("insert", "row_added")
CELLS = "table string, row_id long, column string, is_insert boolean, value string, before string, row map<string,string>, ord long"


def extract_cells(changes: DataFrame) -> DataFrame:
    """CELLS: `row` has the whole row, `ord` its place in the source. Deletes write nothing; updates write only the fields they change."""
    written = changes.filter("op IN ('insert', 'row_added', 'update', 'probable_update')")
    # an update read back from a trace knows only its key and its changed fields
    row = F.coalesce(F.when(F.col("key").isNull(), F.col("after")), F.map_concat(F.map_filter("key", lambda k, _: ~F.map_contains_key(F.col("after"), k)), F.col("after")))
    cells = written.select("table", "row_id", "ord", F.col("op").isin(*INSERTS).alias("is_insert"), "before", row.alias("row"), F.explode("after").alias("column", "value"))
    old = F.element_at("before", F.col("column"))
    cells = cells.filter(F.col("is_insert") | ~old.eqNullSafe(F.col("value")))
    return cells.select("table", "row_id", "column", "is_insert", "value", F.when(~F.col("is_insert"), old).alias("before"), "row", "ord")


def inserted_rows(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("op").isin(*INSERTS)).select("table", "row_id", F.col("after").alias("row"))
