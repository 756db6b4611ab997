"""A feed of rows as a stream of changes.

The last row of every key is keyed state of the stream, by group of keys, so a
micro-batch costs what it holds and the groups of its keys, however much came
before: each key's last row is compared with the one in the state, and only what
differs goes out.
The result is that of a diff of two snapshots that differ by the batch. State is
kept by RocksDB and written as changes to it beside the stream's checkpoint, so a
lost executor restores it there; a batch that runs again after a failure starts
from the state before it and replaces its own output.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.canonical import has_text
from ..operators import diff as D
from ..operators.snapshot import canonical_rows
from ..sources.catalog import Table
from ..sources.storage import many

#: What changed: the texts of a key and of its rows, in the order of their columns. The state's operator gives them as JSON.
CHANGED = "op string, key array<string>, before array<string>, after array<string>, ord long"
_GIVEN = "op string, key string, before string, after string, ord long"
#: Groups that keys are dealt into by hash: for a stream that begins with many rows, where a batch then reads and writes rows / MANY_GROUPS (some 200 at 54 million) for each key that it holds, and for others, where hardly two keys share one.
MANY_GROUPS, GROUP_A_KEY = 1 << 18, 1 << 62
#: The column that marks the end of a key while canonical texts are made.
GONE = "__gone"
#: Session settings while a stream starts: a store with named states, whose commits write what changed and not the whole.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@F.pandas_udf(T.LongType())
def _place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Rows of a batch numbered as the source gives them, as `monotonically_increasing_id` does, which streams don't have."""
    at = TaskContext.get().partitionId() << 33
    for part in parts:
        yield pd.Series(np.arange(at, at + len(part)))
        at += len(part)


class LastRows(StatefulProcessor):
    """Compares each key's last row of a batch with the one held, and holds it from then on. One value of the state holds the rows of a group of keys, as a JSON object of texts, since every call of the state costs far more than a row. Rows are read one by one, so a key may have any number of them."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("rows", "texts string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        last = {}
        for k, texts, gone, place in ((r.k, r.texts, r.gone, r.place) for r in rows):
            if k not in last or place > last[k][1]:
                last[k] = (None if gone else texts, place)
        found = self.held.get()
        held, moved = {} if found is None else json.loads(found[0]), False
        for k, (after, place) in last.items():
            before = held.get(k)
            if after == before:
                continue
            moved = True
            if after is None:
                del held[k]
            else:
                held[k] = after
            yield Row(op="insert" if before is None else "delete" if after is None else "update", key=k, before=before, after=after, ord=place)
        if moved and held:
            self.held.update((json.dumps(held, ensure_ascii=False),))
        elif moved:
            self.held.clear()

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        self.held.update((initialState.held,))

    def close(self) -> None:
        pass


def _texts(rows: DataFrame, name: str, key: list[str], columns: list[str], groups: int, *more) -> DataFrame:
    """group, k and texts, the canonical texts of a key and of a row as JSON: with NFC for every text, as a stream can't be asked whether it needs it."""
    table = Table(name, rows.select(*[f"`{c}`" for c in columns]))
    texts = canonical_rows(table, {c for c in columns if has_text(table.kind(c))}, columns)
    listed = lambda names: F.to_json(F.array(*[F.col(f"`{c}`") for c in names]))
    group = F.pmod(F.xxhash64(*[F.col(f"`{k}`") for k in key]), F.lit(groups)).alias("group")
    return texts.select(group, listed(key).alias("k"), listed([c for c in columns if c != GONE]).alias("texts"), *more)


def _columns(stream: DataFrame, name: str, deleted: str | None) -> list[str]:
    return [c for c in Table(name, stream).columns if c != deleted]


def changes_of(stream: DataFrame, name: str, key: list[str], deleted: str | None = None, initial: DataFrame | None = None, groups: int = GROUP_A_KEY) -> DataFrame:
    """CHANGED rows of a stream. `deleted` names a boolean column that marks a row as the end of its key; `initial` holds the rows that the keys have when the stream begins, one a key.

    Of rows with the same key the last one of a batch counts, in the order in which
    the source gives them. A mark for a key that isn't there changes nothing.
    """
    columns = _columns(stream, name, deleted)
    gone = F.lit(False) if deleted is None else F.coalesce(F.col(f"`{deleted}`").cast("boolean"), F.lit(False))
    ends = stream.select(*[f"`{c}`" for c in columns], gone.alias(GONE))
    # the mark travels as one more canonical column: canonical texts are made by one projection of the source
    rows = _texts(ends, name, key, [*columns, GONE], groups, (F.col(GONE) == "L:1").alias("gone"), _place.asNondeterministic()(F.lit(0)).alias("place"))
    begun = None
    if initial is not None:
        begun = _texts(initial, name, key, columns, groups).groupBy("group").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("k", "texts")))).alias("held")).groupBy("group")
    found = rows.groupBy("group").transformWithState(LastRows(), _GIVEN, "Update", "None", begun)
    listed = [F.from_json(c, "array<string>").alias(c) for c in ("key", "before", "after")]
    return found.select("op", *listed, "ord")


def as_row_changes(changed: DataFrame, name: str, key: list[str], columns: list[str]) -> DataFrame:
    """CHANGED as ROW_CHANGES, the form of every other diff."""
    named = lambda names, texts: F.when(F.col(texts).isNotNull(), F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.col(texts)))
    rows = changed.select(F.lit(name).alias("table"), F.lit(D.PRIMARY).alias("key_type"), "op", named(key, "key").alias("key"), named(columns, "before").alias("before"), named(columns, "after").alias("after"), "ord", F.lit(0).alias("copy"))
    return D.with_row_id(rows, name)


def watch(stream: DataFrame, name: str, key: list[str], changes: str, checkpoint: str, deleted: str | None = None, initial: DataFrame | None = None, **trigger) -> StreamingQuery:
    """Starts the stream, which writes ROW_CHANGES under {changes}/batch=n. How many groups its state has is noted under {changes}/_groups when it begins, and holds whenever it goes on."""
    spark, noted = stream.sparkSession, f"{changes}/_groups"
    groups = MANY_GROUPS if initial is not None and many(initial) else GROUP_A_KEY
    spark.createDataFrame([(groups,)], "groups long").coalesce(1).write.mode("ignore").parquet(noted)
    groups = spark.read.schema("groups long").parquet(noted).first().groups
    columns, conf = _columns(stream, name, deleted), stream.sparkSession.conf
    write = lambda batch, number: as_row_changes(batch, name, key, columns).write.mode("overwrite").parquet(f"{changes}/batch={number}")
    was = {setting: conf.get(setting, None) for setting in STATE_STORE}
    try:  # a query keeps the settings that it starts with
        for setting, value in STATE_STORE.items():
            conf.set(setting, value)
        found = changes_of(stream, name, key, deleted, initial, groups)
        return found.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        for setting, value in was.items():
            conf.unset(setting) if value is None else conf.set(setting, value)
