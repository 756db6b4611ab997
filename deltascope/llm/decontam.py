"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and their white space is collapsed. An item of m
characters may differ from a passage in k = m * ERROR_RATE edits; cut into k + 1
pieces, one of them is left whole in every such passage. All pieces are sought at
once by an Aho-Corasick automaton, and around each hit Myers' bit-parallel
algorithm (the item's rows are the bits of one number) gives the exact distance.

Items of under MIN_CHARS characters leave no room for edits: they are one piece,
found as it is between word borders.

Items are handled in blocks of BLOCK_CHARS characters, so an automaton has a
bounded size whatever the benchmark's; each block is one pass over the documents
and nothing is shuffled.

Defined results: null texts and items match nothing, nor do items without a
character but white space; ids of items may be null and of any type; items with
equal text are all reported; a document that repeats a passage reports it once,
at its least distance; texts of any length are searched whole; equal documents
are all reported, null ids too; `clean` keeps all columns, whatever their names;
empty tables give empty results.
"""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import table

ERROR_RATE, MIN_CHARS, BLOCK_CHARS = 0.08, 24, 2_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def myers(masks: dict[str, int], m: int, text: str, most: int) -> tuple[int, int]:
    """The least distance of a pattern (masks: the places of each character) to any substring of text, and where the first such substring ends; above `most` only that it is more."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end, left = full, 0, m, m + 1, 0, len(text)
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 & full  # a match may start anywhere: no cost moves in at the top
        pv = (mh << 1 & full) | ~(xv | ph) & full
        mv = ph & xv
        left -= 1
        if score < best:
            best, end = score, len(text) - left
        elif score - left > most:
            break
    return best, end


class Matcher:
    """Finds items (id, normalised text) in texts."""

    def __init__(self, items: list[tuple], error_rate: float = ERROR_RATE):
        self.groups: dict[str, list] = {}
        for item_id, text in items:
            self.groups.setdefault(text, []).append(item_id)
        self.items, self.automaton = [], ahocorasick.Automaton()
        places: dict[str, list] = {}
        for n, text in enumerate(self.groups):
            k = int(len(text) * error_rate) if len(text) >= MIN_CHARS else 0
            masks: dict[str, int] = {}
            for i, c in enumerate(text):
                masks[c] = masks.get(c, 0) | 1 << i
            self.items.append((text, k, masks))
            cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                places.setdefault(text[a:b], []).append((n, a))
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        self.automaton.make_automaton()

    def hits(self, text: str | None, first: bool = False) -> list[tuple]:
        """item id, distance, end in the normalised text; with `first`, as soon as there is one."""
        body, best, seen = normal(text), {}, {}
        if not body or not self.items:
            return []
        for last, (size, found) in self.automaton.iter(body):
            for n, offset in found:
                item, k, masks = self.items[n]
                start = last - size + 1 - offset
                if n in best and best[n][0] == 0:
                    continue
                if len(item) < MIN_CHARS:
                    if not (body[start - 1 : start].isalnum() or body[last + 1 : last + 2].isalnum()):
                        best[n] = (0, last + 1)
                        if first:
                            return [(i, *best[n]) for i in self.groups[item]]
                    continue
                low, high = seen.get(n, (1, 0))
                if low <= start <= high:  # an earlier window held all passages with this start, give or take the budget
                    continue
                if start >= 0 and body.startswith(item, start):
                    best[n] = (0, start + len(item))
                else:
                    a = max(0, start - 2 * k)
                    distance, end = myers(masks, len(item), body[a : start + len(item) + 2 * k], k)
                    seen[n] = (start - k, start + k)
                    if distance > k:
                        continue
                    if n not in best or distance < best[n][0]:
                        best[n] = (distance, a + end)
                if first:
                    return [(i, *best[n]) for i in self.groups[item]]
        return [(i, *found) for n, found in best.items() for i in self.groups[self.items[n][0]]]


def item_blocks(benchmark: DataFrame, *, item_id="item_id", text="text", min_chars=1):
    """The items of at least `min_chars` characters, normalised, in lists of about BLOCK_CHARS characters; one list is on the driver at a time."""
    items = benchmark.select(F.col(item_id).alias("id"), F.col(text).alias("text")).filter("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // BLOCK_CHARS))
    for k in range(n):
        block = items.filter(F.pmod(F.xxhash64("text"), F.lit(n)) == k).collect()
        yield [(r.id, t) for r in block if len(t := normal(r.text)) >= max(1, min_chars)]


def find(docs: DataFrame, benchmark: DataFrame, *, doc_id="doc_id", text="text", item_id="item_id", error_rate=ERROR_RATE) -> DataFrame:
    """doc_id, item_id, distance: one row for each document and item found in it."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = benchmark.schema[item_id].dataType
    schema = T.StructType([rows.schema["doc_id"], T.StructField("item_id", kind), T.StructField("distance", T.IntegerType())])
    found = None
    for block in item_blocks(benchmark, item_id=item_id):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, error_rate)
            for batch in batches:
                hits = [(i, *h) for i, t in enumerate(batch.column(1)) for h in matcher.hits(t.as_py())]
                ids = batch.column(0).take(pa.array([h[0] for h in hits], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([h[1] for h in hits], to_arrow_type(kind)), pa.array([h[2] for h in hits], pa.int32())], ["doc_id", "item_id", "distance"])

        part = rows.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, *, text="text", item_id="item_id", error_rate=ERROR_RATE, min_chars=MIN_CHARS) -> DataFrame:
    """The documents that hold no item, with all their columns. Items under `min_chars` are no evidence of a leak: ordinary prose holds them too."""
    at = docs.columns.index(text)
    for block in item_blocks(benchmark, item_id=item_id, min_chars=min_chars):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            matcher = Matcher(shared.value, error_rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.hits(t.as_py(), first=True) for t in batch.column(at)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op9_decontaminate(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
