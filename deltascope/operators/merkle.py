"""A snapshot as a Merkle tree: which parts of a table changed, without reading the others.

Rows are dealt into leaves by the first hexadecimal digits of their fingerprints.
A leaf's digest covers its fingerprints in order, each with its number of copies;
a node's digest covers its children's. Digests of equal tables are equal whatever
the order of rows. No step gathers more than one leaf (LEAF_ROWS different rows on
average, fingerprints being evenly spread) or one node's 16 children.

Stored rows lie in folders by the first digits and sorted by fingerprint inside,
so a comparison goes down only where digests differ and reads only the leaves that
do. Copies of one row, however many, are one entry of their leaf.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.storage import new_path, written
from .snapshot import TableSnapshot, with_fingerprint

#: Different rows that a leaf holds on average, at most; hexadecimal digits of a folder; the deepest leaves.
LEAF_ROWS, FOLDER_DIGITS, MAX_DEPTH = 4096, 1, 12
FOLDER = "__folder"


def depth_for(n_rows: int) -> int:
    """Digits of a leaf's prefix for a table of this size."""
    depth = FOLDER_DIGITS
    while n_rows > LEAF_ROWS * 16**depth and depth < MAX_DEPTH:
        depth += 1
    return depth


def _above(nodes: DataFrame) -> DataFrame:
    up = F.substring("prefix", 1, F.length("prefix") - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda c: F.concat(c["prefix"], F.lit(":"), c["digest"])), ",")
    return nodes.groupBy(up.alias("prefix")).agg(F.sum("n_rows").alias("n_rows"), F.sha2(text.cast("binary"), 256).alias("digest"))


def tree(rows: DataFrame, columns: list[str], depth: int) -> DataFrame:
    """level, prefix, n_rows, digest of all nodes, from the leaves (level `depth`) up to the root (level 0, empty prefix). An empty table has no node."""
    held = rows if "fingerprint" in rows.columns else with_fingerprint(rows, columns)
    copies = held.groupBy("fingerprint").agg(F.count("*").alias("n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fingerprint", "n"))), lambda c: F.concat(c["fingerprint"], F.lit(":"), c["n"].cast("string"))), ",")
    leaves = copies.groupBy(F.substring("fingerprint", 1, depth).alias("prefix")).agg(F.sum("n").alias("n_rows"), F.sha2(text.cast("binary"), 256).alias("digest"))
    levels = [written(leaves, "merkle-leaves")]
    for _ in range(depth):
        levels.append(_above(levels[-1]))
    return reduce(DataFrame.unionByName, [nodes.select(F.length("prefix").alias("level"), "prefix", "n_rows", "digest") for nodes in levels])


@dataclass
class MerkleSnapshot:
    """Rows in folders, with their fingerprints, and the tree of their digests, both stored."""

    columns: list[str]
    depth: int
    path: str
    rows: DataFrame
    nodes: DataFrame

    def root(self) -> tuple[int, str]:
        """Number of rows and digest of the whole table."""
        top = self.nodes.filter("level = 0").first()
        return (top.n_rows, top.digest) if top else (0, "")


def store(snapshot: TableSnapshot, path: str | None = None, depth: int | None = None) -> MerkleSnapshot:
    """`depth`: trees are compared leaf by leaf if they have the same; without it, by the number of rows."""
    spark, columns = snapshot.rows.sparkSession, snapshot.columns
    path = path or new_path(spark, "merkle")
    depth = depth or depth_for(snapshot.n_rows if snapshot.n_rows >= 0 else snapshot.rows.count())
    rows = with_fingerprint(snapshot.rows, columns).withColumn(FOLDER, F.substring("fingerprint", 1, FOLDER_DIGITS))
    rows.repartitionByRange("fingerprint").sortWithinPartitions("fingerprint").write.partitionBy(FOLDER).parquet(f"{path}/rows")
    stored = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    tree(stored, columns, depth).write.parquet(f"{path}/tree")
    return MerkleSnapshot(columns, depth, path, stored, spark.read.parquet(f"{path}/tree"))


def differing(before: MerkleSnapshot, after: MerkleSnapshot) -> DataFrame:
    """Prefixes of the leaves that differ, found from the root down: nodes are compared only below nodes that differ."""
    if before.depth != after.depth:
        raise ValueError("trees of different depths")
    spark, found = before.nodes.sparkSession, None
    for level in range(before.depth + 1):
        sides = [t.nodes.filter(F.col("level") == level).select("prefix", F.col("digest").alias(name)) for t, name in ((before, "b"), (after, "a"))]
        if found is not None:
            sides = [s.join(found, F.substring("prefix", 1, level - 1) == F.col("above"), "left_semi") for s in sides]
        unequal = sides[0].join(sides[1], "prefix", "full_outer").filter(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("prefix").alias("above"))
        found = written(unequal, "merkle-differing")
        if found.isEmpty():
            return spark.createDataFrame([], "prefix string")
    return found.select(F.col("above").alias("prefix"))


def changed_parts(before: MerkleSnapshot, after: MerkleSnapshot) -> tuple[DataFrame, DataFrame]:
    """Both sides' rows in leaves that differ: their difference is that of the whole tables."""
    leaves = differing(before, after)
    folders = [r[0] for r in leaves.select(F.substring("prefix", 1, FOLDER_DIGITS)).distinct().collect()]  # at most 16 ** FOLDER_DIGITS
    prefix = F.substring("fingerprint", 1, before.depth)
    return tuple(t.rows.filter(F.col(FOLDER).isin(folders)).join(leaves, prefix == F.col("prefix"), "left_semi").drop(FOLDER, "fingerprint") for t in (before, after))
