"""Mixing sources to target weights by systematic sampling.

Every document has an expected number of copies: its source's target words over
its source's words. Within a source the documents are laid on a line, each as
long as its expected copies; one random offset places a comb of unit step over
the line, and a document is emitted once for each tooth that falls on it.

The line is a prefix sum over all rows of a source, so it is built in three
levels (source, size class, hash bucket) and no task sees more than one bucket.
Lengths are integers of 2**-24 copies: sums are exact in any order, and reruns
agree. Documents are ordered by size class first, which spreads the teeth over
short and long documents alike, so the words taken come near the target.

The words taken differ from a source's target by less than its longest document
(systematic sampling takes whole documents): with few documents, some of them
very long, that may be a large share of a small source's target.

Defined results: null text has size 0; the null source is a source of its own
and comes last; a source without words has target 0 and none of its documents
is taken; null ids are ordered first; equal rows are interchangeable; an empty
table gives an empty result; texts of any length are counted whole. Other
columns, whatever their names, are only carried on request.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, written

UNIT_BITS = 24
#: Hexadecimal digits of the hash that make a bucket: 4096 for each source and size class.
BUCKET_DIGITS = 3


def source_targets(sizes: DataFrame, weights=(5, 2, 1), budget: float = 1.5, cap: float = 2.0) -> DataFrame:
    """sizes(skey, words) -> skey, source_size, target, step, offset.

    Targets share `budget` times all words by weight. A target stops at `cap`
    times its source's words and the excess is shared again: with sources in the
    order of cap over weight, the final level is the greatest of the levels
    reached when all earlier ones are capped.
    """
    every, by_key = Window.partitionBy(), Window.partitionBy().orderBy("skey")
    fill = Window.partitionBy().orderBy("ratio", "skey")
    before, onward = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    levels = (
        sizes.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_key) - 1) % len(weights) + 1))
        .withColumn("most", F.lit(cap) * F.col("words"))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("total", F.lit(budget) * F.sum("words").over(every))
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("weight").over(onward))
        .withColumn("level", F.max("level").over(every))
    )
    target = F.least("most", F.col("level") * F.col("weight"))
    rate = F.when(F.col("words") > 0, target / F.col("words")).otherwise(0.0)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit("mix:"), F.col("skey")).cast("binary")), 1, UNIT_BITS // 4), 16, 10)
    return levels.select(
        "skey", F.col("words").alias("source_size"), target.alias("target"),
        F.round(rate * (1 << UNIT_BITS)).cast("long").alias("step"), offset.cast("long").alias("offset"),
    )


def mix(docs: DataFrame, *, doc_id="doc_id", text="text", source="source", weights=(5, 2, 1), budget=1.5, cap=2.0, carry=()) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, and a struct `row` of the columns in `carry`."""
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    bits = F.length(F.bin("size"))
    base = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"),
        F.concat(F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(F.col(source).cast("string"), F.lit(""))).alias("skey"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("h"),
        *([F.struct(*[F.col(c) for c in carry]).alias("row")] if carry else []),
    )
    base = base.withColumns({"band": (bits * 16 + F.call_function("shiftright", F.col("size"), F.greatest(bits - 4, F.lit(0)))).cast("int"), "bucket": F.substring("h", 1, BUCKET_DIGITS)})
    if not carry:
        base = written(base, "mix")
    cells = base.groupBy("skey", "band", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    cells = written(cells, "mix-cells")
    bands = cells.groupBy("skey", "band").agg(F.sum("n").alias("n"), F.sum("words").alias("words"))
    targets = source_targets(bands.groupBy("skey").agg(F.sum("words").alias("words")), weights, budget, cap)
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.drop("words").join(targets, "skey").withColumn("start", F.col("offset") + F.coalesce(F.sum(F.col("n") * F.col("step")).over(upto("skey", "band")), F.lit(0)))
    cells = (
        cells.drop("words").join(bands.drop("n", "offset"), ["skey", "band"])
        .withColumn("start", F.col("start") + F.coalesce(F.sum(F.col("n") * F.col("step")).over(upto("skey", "band", "bucket")), F.lit(0)))
        .drop("n")
    )
    line = Window.partitionBy("skey", "band", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = base.join(cells, ["skey", "band", "bucket"]).withColumn("end", F.col("start") + F.sum("step").over(line))
    copies = F.shiftright("end", UNIT_BITS) - F.shiftright(F.col("end") - F.col("step"), UNIT_BITS)
    return placed.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), *(["row"] if carry else [])
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as many times as it is taken, with all its columns."""
    placed = mix(docs, carry=docs.columns, **options)
    return placed.select(F.explode(F.expr("array_repeat(row, cast(copies as int))")).alias("row")).select("row.*")


def op2_mix_sources(spark, sf_dir):
    from .common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH base AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey, md5(coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
banded AS (SELECT *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) AS band FROM base),
sizes AS (SELECT skey, sum(size)::BIGINT AS words FROM base GROUP BY skey),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY encode(skey)) - 1) % 3 + 1)::INT] AS weight,
         2.0::DOUBLE * words AS most, 1.5::DOUBLE * (sum(words) OVER ())::DOUBLE AS total FROM sizes),
levels AS (
  SELECT *, (total - coalesce(sum(most) OVER (ORDER BY most / weight, encode(skey) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY most / weight, encode(skey) ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
targets AS (
  SELECT skey, words, least(most, (max(level) OVER ()) * weight) AS target,
         ('0x' || substr(md5('mix:' || skey), 1, 6))::BIGINT AS start FROM levels),
steps AS (SELECT *, CASE WHEN words > 0 THEN round(target / words * 16777216)::BIGINT ELSE 0 END AS step FROM targets),
line AS (
  SELECT doc_id, size, words, target, step,
         start + sum(step) OVER (PARTITION BY skey ORDER BY band, h, doc_id, size ROWS UNBOUNDED PRECEDING) AS finish
  FROM banded JOIN steps USING (skey))
SELECT doc_id, size, words AS source_size, target, (size * ((finish::BIGINT >> 24) - ((finish::BIGINT - step) >> 24)))::BIGINT AS taken FROM line
"""
