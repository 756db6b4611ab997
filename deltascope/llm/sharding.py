"""Sharding by minimax contiguous partition.

Documents with equal texts form a group and stay together. Groups are ordered by
the hash of their text; runs of groups that agree in the first ATOM_BITS bits of
the hash are the atoms that are laid out, so that their number has a fixed bound
whatever the input. The smallest feasible shard capacity is found by binary
search, each guess checked by filling shards greedily in order. It bounds every
shard; within it the cuts are placed by fair shares of what is left, so that a
large group leaves the other shards even. Search and cuts run on the driver over
at most 2**ATOM_BITS sums.

Slots number the rows of a shard without gaps. They are prefix sums over shard,
atom and salt, so a group of copies that holds a third of all rows is still
numbered by many tasks.

Defined results: null text has no bytes (size 8, crc 0) and forms a group of its
own; a group larger than a fair share makes its shard as large as it is and the
other shards share the rest; shards stay empty only when there are fewer atoms
than shards; equal rows are interchangeable; of atoms that fit either side of a
cut the side nearer to the fair share is taken, the earlier cut on a tie; texts of
any length enter by their length and hashes; other columns, whatever their names,
are left; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

ATOM_BITS = 16
SALTS = 256



def ends(sizes: np.ndarray, shards: int) -> list[int]:
    """The end of every shard used, as positions in sizes (positive): the largest shard is as small as it can be, all shards are used where there are atoms enough, and sizes are near equal."""
    n, upto = len(sizes), np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    reach = lambda a, capacity: int(np.searchsorted(upto, upto[a] + capacity, side="right")) - 1

    def fits(capacity):
        a = 0
        for _ in range(shards):
            a = reach(a, capacity)
        return a == n

    low, high = max(int(sizes.max()), -(-int(upto[n]) // shards)), int(upto[n])
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fits(middle) else (middle + 1, high)
    # atoms above the fair share of the others are hot: their shards are no measure for the rest
    rest, hot = int(upto[n]), []
    for i in np.argsort(-sizes, kind="stable")[: shards - 1].tolist():
        if sizes[i] * (shards - len(hot)) <= rest:
            break
        hot.append(i)
        rest -= int(sizes[i])
    hot.sort()
    # from since[m] on, the atoms fit in m shards
    since = [n]
    for _ in range(shards):
        since.append(int(np.searchsorted(upto, upto[since[-1]] - low, side="left")))
    found, a = [], 0
    while a < n:
        left = shards - len(found) - 1
        earliest, latest = max(since[left], a + 1), min(reach(a, low), max(n - left, a + 1))
        hot = [i for i in hot if i >= a]
        if hot[:1] == [a]:
            wanted = a + 1
        else:
            until = hot[0] if hot else n
            # the run up to the next hot atom is cut in equal parts, as many as its share of the shards
            others = int(upto[n] - upto[a] - sizes[hot].sum())
            run = int(upto[until] - upto[a])
            parts = max(1, round(run * max(left + 1 - len(hot), 0) / others))
            target = upto[a] + run / parts
            wanted = int(np.searchsorted(upto, target))
            wanted -= wanted > a + 1 and target - upto[wanted - 1] < upto[wanted] - target
        a = min(max(wanted, earliest), latest)
        found.append(a)
    return found


def cut_points(atoms: DataFrame, shards: int) -> list[int]:
    """atoms(atom, bytes), at most 2**ATOM_BITS rows -> the first atom of every shard but the first."""
    line = atoms.agg(F.sort_array(F.collect_list(F.struct("atom", "bytes"))).alias("line")).select("line.atom", "line.bytes").first()
    return [line.atom[e] for e in ends(np.array(line.bytes, np.int64), shards)[:-1]] if line.atom else []


def shard(docs: DataFrame, shards: int = 24, *, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"),
    )
    rows = written(rows, "shard")
    rows = rows.withColumns({"atom": F.shiftrightunsigned("h", 64 - ATOM_BITS), "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))})
    cells = rows.groupBy("atom", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    atoms = written(cells.groupBy("atom").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")), "shard-atoms")
    cuts = cut_points(atoms.select("atom", "bytes"), shards)
    at = "size(filter(cast(array({}) AS array<bigint>), c -> c <= atom))".format(", ".join(f"{c}L" for c in cuts))
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    atoms = atoms.withColumn("shard", F.expr(at)).withColumn("start", F.coalesce(F.sum("n").over(upto("shard", "atom")), F.lit(0)))
    cells = (
        cells.drop("bytes").join(atoms.select("atom", "shard", "start"), "atom")
        .withColumn("start", F.col("start") + F.coalesce(F.sum("n").over(upto("atom", "salt")), F.lit(0)))
        .drop("n")
    )
    here = Window.partitionBy("atom", "salt").orderBy("h", "doc_id", "size", "text_crc32")
    return rows.join(cells, ["atom", "salt"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("start") + F.row_number().over(here) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_shards(spark, sf_dir):
    return shard(table(spark, sf_dir, "documents"))
