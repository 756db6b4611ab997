"""Fill-in-the-middle by overlapping-chunk decomposition.

A text is n units (characters, words or lines); two cuts, each after a number of
units, make prefix, middle and suffix, which are put together again around
markers. A unit ends between two adjacent bytes for which a predicate holds, so
texts are taken in chunks that overlap by one byte: all chunks' boundaries are
counted side by side, prefix sums over the counts give each text's n and send
both cut ranks to the chunks that own them, and only those are read once more,
for the places of the cuts. Python sees bytes of Arrow buffers and returns slices
of them; markers, forms and digests are Spark's own functions.

Which text is cut where depends on its id alone, so reruns agree. Rows stay where
they are: nothing is shuffled, and a task holds one Arrow batch, a slab of
predicates and one output slice at a time.

Defined results: null text is empty; an empty text, and one that holds a marker,
is plain; a null id counts as the empty text; equal rows give equal rows; texts
of any length are cut as a whole; an empty table gives an empty result; other
columns, whatever their names, are kept where `carry` names them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: Bytes of a chunk, chunks whose predicates are evaluated at once, and bytes of texts in one output slice.
CHUNK, SLAB, SLICE = 1024, 1024, 1 << 26
MARKERS = ("<P>", "<S>", "<M>")


def _space(byte: np.ndarray) -> np.ndarray:
    return (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))


#: Whether a unit ends between two adjacent bytes of UTF-8.
UNITS = {
    "character": lambda left, right: (right & 0xC0) != 0x80,
    "word": lambda left, right: _space(left) & ~_space(right),
    "line": lambda left, right: left == 0x0A,
}


class Chunks:
    """Texts that follow each other in one buffer, text i from starts[i] to starts[i + 1], and their units."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, unit: str, chunk: int = CHUNK):
        self.data, self.starts, self.holds = data, starts, UNITS[unit]
        per_text = -(-np.diff(starts) // chunk)
        self.first = np.concatenate([[0], np.cumsum(per_text)])  # each text's first chunk
        within = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per_text)
        self.begins = np.append(np.repeat(starts[:-1], per_text) + chunk * within, starts[-1])
        #: Boundaries up to each chunk's end; a text's last byte isn't followed by one of its own.
        self.upto = np.concatenate([[0], np.cumsum(self._counts())])
        self.n = self.upto[self.first[1:]] - self.upto[self.first[:-1]] + (np.diff(starts) > 0)

    def _marks(self, a: int, b: int) -> np.ndarray:
        """For each byte of [a, b), whether a unit ends after it inside its text."""
        marks = np.zeros(b - a, bool)
        overlap = self.data[a : b + 1]
        marks[: len(overlap) - 1] = self.holds(overlap[:-1], overlap[1:])
        ends = self.starts[np.searchsorted(self.starts, a + 1) : np.searchsorted(self.starts, b, side="right")]
        marks[ends - 1 - a] = False
        return marks

    def _counts(self) -> np.ndarray:
        counts = np.zeros(len(self.begins) - 1, np.int64)
        for p in range(0, len(counts), SLAB):
            q = min(p + SLAB, len(counts))
            a = self.begins[p]
            counts[p:q] = np.add.reduceat(self._marks(a, self.begins[q]), self.begins[p:q] - a, dtype=np.int64)
        return counts

    def places(self, ranks: np.ndarray) -> np.ndarray:
        """Where ranks[i] units of text i end, as a place in the buffer."""
        at = np.where(ranks > 0, self.starts[1:], self.starts[:-1])
        inner = np.nonzero((ranks > 0) & (ranks < self.n))[0]
        wanted = self.upto[self.first[inner]] + ranks[inner]
        owner = np.searchsorted(self.upto, wanted) - 1
        for i, p, rank in zip(inner.tolist(), owner.tolist(), (wanted - self.upto[owner]).tolist(), strict=True):
            at[i] = self.begins[p] + np.flatnonzero(self._marks(self.begins[p], self.begins[p + 1]))[rank - 1] + 1
        return at


def _cutter(unit: str):
    """Batches (..., h1, h2, text) -> (..., n, low, high, pieces)."""

    def run(batches):
        for whole in batches:
            k = whole.num_columns - 3
            starts, done = _offsets(whole.column(k + 2)), 0
            while done < whole.num_rows:
                upto = max(done + 1, int(np.searchsorted(starts, starts[done] + SLICE, side="right")) - 1)
                yield _cut(whole.slice(done, upto - done), k, unit)
                done = upto

    return run


def _offsets(texts: pa.Array) -> np.ndarray:
    wide = texts.cast(pa.large_string())
    return np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]


def _cut(batch: pa.RecordBatch, k: int, unit: str) -> pa.RecordBatch:
    texts = batch.column(k + 2)
    buffer, starts = texts.buffers()[2], _offsets(texts)
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    data, starts = data[starts[0] : starts[-1]], starts - starts[0]
    chunks = Chunks(data, starts, unit)
    h1, h2 = (batch.column(i).to_numpy() % (chunks.n + 1) for i in (k, k + 1))
    low, high = np.minimum(h1, h2), np.maximum(h1, h2)
    edges = np.stack([starts[:-1], chunks.places(low), chunks.places(high)], 1).ravel()
    bounds = np.append(edges, starts[-1]).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data)))
    triples = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bounds), 3, dtype=np.int32)), pieces)
    made = [pa.array(chunks.n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), triples]
    return pa.RecordBatch.from_arrays([*batch.columns[:k], *made], [*batch.schema.names[:k], "n", "low", "high", "pieces"])


def random_word(doc_id: Column, i: int, seed: str = "1") -> Column:
    """The i-th (from 0) 32-bit number that belongs to an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, *, doc_id="doc_id", text="text", unit="character", seed="1", markers=MARKERS, plain_from=90, spm_below=20, carry=()) -> DataFrame:
    """The columns of `carry` as a struct `row` where there are any, and doc_id, n, form (plain, psm or spm), prefix_units and middle_units (null if plain), output."""
    first, second, third = markers
    whole, own = F.coalesce(F.col(text), F.lit("")), F.col(doc_id)
    is_plain = (whole == "") | whole.contains(first) | whole.contains(second) | whole.contains(third) | (random_word(own, 2, seed) % 100 >= plain_from)
    form = F.when(is_plain, "plain").when(random_word(own, 3, seed) % 100 < spm_below, "spm").otherwise("psm")
    rows = docs.select(
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []), own.alias("doc_id"), form.alias("form"),
        random_word(own, 0, seed).alias("h1"), random_word(own, 1, seed).alias("h2"), whole.alias("text"),
    )
    made = [T.StructField(c, T.LongType()) for c in ("n", "low", "high")]
    cut = rows.mapInArrow(_cutter(unit), T.StructType([*rows.schema.fields[:-3], *made, T.StructField("pieces", T.ArrayType(T.StringType()))]))
    prefix, middle, suffix = (F.col("pieces")[i] for i in range(3))
    output = (
        F.when(F.col("form") == "plain", F.concat(prefix, middle, suffix))
        .when(F.col("form") == "psm", F.concat(F.lit(first), prefix, F.lit(second), suffix, F.lit(third), middle))
        .otherwise(F.concat(F.lit(second), suffix, F.lit(first), prefix, F.lit(third), middle))
    )
    moved = F.col("form") != "plain"
    return cut.select(
        *(["row"] if carry else []), "doc_id", "n", "form", F.when(moved, F.col("low")).alias("prefix_units"), F.when(moved, F.col("high") - F.col("low")).alias("middle_units"), output.alias("output"),
    )


def restored(output: Column, form: Column, markers=MARKERS) -> Column:
    """The text again, from output and form alone: no piece holds a marker, so each marker is found where it was put."""
    first, second, third = markers
    head, middle = F.substring_index(output, third, 1), F.substring_index(output, third, -1)
    psm = F.concat(F.substring(F.substring_index(head, second, 1), len(first) + 1, 1 << 30), middle, F.substring_index(head, second, -1))
    spm = F.concat(F.substring_index(head, first, -1), middle, F.substring(F.substring_index(head, first, 1), len(second) + 1, 1 << 30))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark, sf_dir):
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
w AS (SELECT doc_id, t, length(t) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2, ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM w),
p AS (SELECT *, substr(t, 1, low) AS a, substr(t, low + 1, high - low) AS b, substr(t, high + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN low END AS prefix_chars, CASE WHEN form <> 'plain' THEN high - low END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
