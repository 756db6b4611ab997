"""SimHash near-duplicates, compared bit-sliced.

``fingerprint_documents`` makes one fingerprint per document; ``near_links``
finds all pairs of distinct fingerprints within a radius: the bits are cut into
radius + 2 blocks, of which any such pair shares two, so fingerprints meet under
the values of each pair of blocks. Values shared by many fingerprints are split
into blocks of BLOCK rows and pairs of blocks, so a task's memory and time have a
bound. Each comparison emits a spanning forest, never all pairs, and the links
are closed to components by star steps.

``near_duplicate_groups`` is for similar rather than nearly equal fingerprints
(five words, similarity 0.8): see there. Texts of any length are read whole.

Defined results: null text counts as empty; a text without words has fingerprint
zero, which is linked like any other; a text of fewer words than a shingle is one
shingle; equal fingerprints are always one component; null ids never name a
component unless all its ids are null; equal rows give equal rows; other columns,
whatever their names, are carried or left, never read; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bitslice import forest, near_pairs
from .common import table, written
from .components import components

#: Fingerprints of one shared value that are compared in one piece.
BLOCK = 4096
#: Byte -> the same bits, each in a byte of its own.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8")[:, 0]


def words(text: str | None) -> list[bytes]:
    """The words, A-Z lower-cased; bytes know only ASCII letters and ASCII white space."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(found: list[bytes], size: int) -> np.ndarray:
    """XXH64 (seed 42) of all shingles, repeats included."""
    if len(found) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 42)] if found else [], "<u8")
    flat, ends = memoryview(b" ".join(found)), list(accumulate(len(w) + 1 for w in found))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a : b - 1], 42) for a, b in zip([0, *ends], ends[size - 1 :], strict=False)], "<u8")


def majority(hashes: np.ndarray) -> np.ndarray:
    """Per bit of hashes (n x bytes): 1 if set in over half of them. Packed bytes."""
    n, width = hashes.shape
    if not n:
        return np.zeros(width, np.uint8)
    sums = np.add.reduceat(SPREAD[hashes], np.arange(0, n, 255), axis=0)  # a byte counts to 255
    counts = np.ascontiguousarray(sums).view(np.uint8).reshape(-1, width * 8).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > n, bitorder="little")


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """As a signed 64-bit number."""
    hashes = shingle_hashes(words(text), shingle)
    return int(majority(hashes.view(np.uint8).reshape(-1, 8)).view("<i8")[0])


def _texts(batch: pa.RecordBatch):
    return (x.as_py() for x in batch.column(batch.num_columns - 1))


def fingerprint_documents(docs: DataFrame, *, doc_id="doc_id", text="text", shingle=3) -> DataFrame:
    """doc_id, fp (signed 64-bit)."""

    def run(batches):
        for batch in batches:
            prints = pa.array([fingerprint(t, shingle) for t in _texts(batch)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), prints], ["doc_id", "fp"])

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return ids.mapInArrow(run, T.StructType([ids.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _runs(batches, keys: int, limit: int = 1 << 15, most: int = 1 << 25):
    """Rows sorted by their first columns, the keys -> tables of whole runs of equal keys, several at a time, and where the runs start."""
    held = None
    for batch in _ended(batches):
        last = batch is None
        if not last:
            held = batch if held is None else pa.concat_tables([held, batch])
            if held.num_rows < limit and held.nbytes < most:
                continue
        if held is None or not held.num_rows:
            continue
        cols = [held.column(k).to_numpy() for k in range(keys)]
        new = np.ones(held.num_rows, bool)
        new[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        starts = np.nonzero(new)[0]
        end = held.num_rows if last else starts[-1]  # the last run may go on
        if not last and end == 0:
            continue
        yield held.slice(0, end), starts[starts < end]
        held = held.slice(end)


def _ended(batches):
    for batch in batches:
        yield pa.Table.from_batches([batch])
    yield None


def _in_blocks(met: DataFrame, blocks) -> DataFrame:
    """met(t, key, id) -> t, key, lo, hi, id: the rows of each (t, key) dealt into blocks, every pair of blocks once."""
    met = met.withColumns({"blocks": blocks.cast("int"), "own": F.pmod(F.xxhash64("id"), blocks.cast("int")).cast("int")})
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return met.select("t", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "id")


def compare_within(entries: DataFrame, radius: int) -> DataFrame:
    """entries(t, key, id): links (u, v) between ids, taken as bits, that share a (t, key) and differ in at most `radius` bits."""
    shared = entries.groupBy("t", "key").agg(F.count("*").alias("n")).filter("n > 1")
    met = _in_blocks(entries.join(shared, ["t", "key"]), F.ceil(F.col("n") / BLOCK))
    met = met.repartition("t", "key", "lo", "hi").sortWithinPartitions("t", "key", "lo", "hi", "id")

    def run(batches):
        for rows, starts in _runs(batches, 4):
            ids = rows.column(4).to_numpy()
            prints = ids.view(np.uint8).reshape(len(ids), 8) if ids.flags.c_contiguous else np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), 8)
            for i, j in near_pairs(prints, starts, np.diff(np.append(starts, len(ids))), radius):
                if len(i):
                    u, v = forest(i, j)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["u", "v"])

    return met.mapInArrow(run, "u long, v long").distinct()


def near_links(prints: DataFrame, radius: int = 3, bits: int = 64) -> DataFrame:
    """prints(fp), distinct -> links (u, v) that connect all fingerprints within the radius of each other."""
    n = radius + 2
    edges = [bits * k // n for k in range(n + 1)]
    masks = [sum((1 << b) - (1 << a) for a, b in ((edges[i], edges[i + 1]), (edges[j], edges[j + 1]))) for i, j in combinations(range(n), 2)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(signed)])
    entries = prints.select("fp", F.explode(keys).alias("k")).select("k.t", "k.key", F.col("fp").alias("id"))
    return compare_within(entries, radius)


def linked_documents(docs: DataFrame, *, doc_id="doc_id", text="text", shingle=3, radius=3) -> DataFrame:
    """doc_id, fp, component_id: the smallest id that a document's links reach."""
    prints = written(fingerprint_documents(docs, doc_id=doc_id, text=text, shingle=shingle), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    roots = components(near_links(distinct.select("fp"), radius))
    placed = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op7_simhash_components(spark, sf_dir):
    found = linked_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Similar documents: five words, similarity 0.8

#: Bits of the sketch, a SimHash of the set of shingles.
SKETCH_BITS = 512
#: Tables under which documents meet, each keyed by KEY_SHINGLES min-hashes of the set of shingles. A pair of similarity s
#: meets with probability 1 - (1 - s^5)^16 whatever the kind of edit: 0.998 at 0.8.
TABLES, KEY_SHINGLES = 16, 5
#: Distances above the expected one at which a pair is still verified: over five standard deviations (8 to 9 bits), and three
#: for sets of four shingles and five, which lie further apart than expected.
SLACK_BITS = 48
_MIX = np.array([2 * k * 0x9E3779B97F4A7C15 % (1 << 64) | 1 for k in range(1, SKETCH_BITS // 64 + 1)], "<u8")
_ORDERS = np.random.default_rng(7).integers(0, 1 << 63, (TABLES * KEY_SHINGLES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def radius_for(similarity: float, bits: int = SKETCH_BITS) -> int:
    """The distance expected at a Jaccard similarity, for SimHashes of sets of like size: bits * angle / pi."""
    return int(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SimHash of the distinct hashes with SKETCH_BITS bits; further bits come from remixing each hash."""
    h = np.unique(hashes)[:, None] * _MIX
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return majority(np.ascontiguousarray(h).view(np.uint8).reshape(len(h), SKETCH_BITS // 8))


def meeting_keys(distinct: np.ndarray) -> list[int]:
    """One signed 64-bit key a table; none for an empty set."""
    if not len(distinct):
        return []
    least = np.full(len(_ORDERS), np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(distinct), 4096):
        h = distinct[None, a : a + 4096] * _ORDERS
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(29)
        np.minimum(least, h.min(1), out=least)
    return [xxhash.xxh64_intdigest(row.tobytes(), 42) - (1 << 63) for row in least.reshape(TABLES, KEY_SHINGLES)]


def sketches(text: str | None, shingle: int) -> tuple[int, int, bytes, list[int]]:
    """The hash of the set of shingles, which names it, its size, its sketch and the keys it meets others under."""
    distinct = np.unique(shingle_hashes(words(text), shingle))
    return xxhash.xxh64_intdigest(distinct.tobytes(), 42) - (1 << 63), len(distinct), sketch(distinct).tobytes(), meeting_keys(distinct)


def similar(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs (i, j), by i, of sets (sorted hashes) have a Jaccard similarity of `similarity` or more.

    CHUNK rows i at a time: their hashes number the places of a bit set, so the sizes
    of all intersections come from counting bits.
    """
    size = np.array([len(s) for s in sets])
    both = np.zeros(len(i), np.int64)
    fits = np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j])
    left = np.nonzero(fits)[0]
    at = 0
    while at < len(left):
        own = np.unique(i[left[at : at + CHUNK * 64]])[:CHUNK]
        upto = at + int(np.searchsorted(i[left[at:]], own[-1], side="right"))
        pairs, at = left[at:upto], upto
        if len(pairs) < 16:
            both[pairs] = [len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i[pairs], j[pairs], strict=True)]
            continue
        places = np.unique(np.concatenate([sets[r] for r in own]))
        rows = np.unique(np.concatenate([own, j[pairs]]))
        if not len(places):  # sets without elements are equal
            continue
        flat = np.concatenate([sets[r] for r in rows])
        place = np.minimum(np.searchsorted(places, flat), len(places) - 1)
        known = places[place] == flat
        row, place = np.repeat(np.arange(len(rows)), size[rows])[known], place[known]
        bits = np.zeros((len(rows), -(-len(places) // 64)), np.uint64)
        np.bitwise_or.at(bits, (row, place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
        a, b = np.searchsorted(rows, i[pairs]), np.searchsorted(rows, j[pairs])
        step = max(1, (1 << 21) // bits.shape[1])
        for k in range(0, len(pairs), step):
            both[pairs[k : k + step]] = np.bitwise_count(bits[a[k : k + step]] & bits[b[k : k + step]]).sum(1, dtype=np.int64)
    return fits & (both >= similarity * (size[i] + size[j] - both))


#: Rows whose sets are compared with others at once, bytes of sets in a block, and hashes of a set in a row.
CHUNK, BLOCK_BYTES, PIECE = 64, 1 << 25, 1024


def verified_links(met: DataFrame, prints: DataFrame, sets: DataFrame, radius: int, similarity: float) -> DataFrame:
    """met(t, key, lo, hi, id), prints(id, bits), sets(id, pieces): links (u, v) that connect all ids of the same (t, key, lo, hi) whose sets are similar, among those whose sketches are near. Pairs are compared where they meet; a run leaves a spanning forest."""
    keys = ["t", "key", "lo", "hi"]
    rows = met.join(prints.select("id", "bits"), "id").join(sets, "id").select(*keys, "id", "bits", F.posexplode("pieces").alias("piece", "part"))
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "id", "piece")

    def run(batches):
        for rows, starts in _runs(batches, 4):
            first = np.nonzero(rows["piece"].to_numpy() == 0)[0]
            parts, ends = rows["part"].to_pylist(), np.append(first[1:], rows.num_rows)
            sets = [np.frombuffer(b"".join(parts[a:b]), "<u8") for a, b in zip(first, ends, strict=True)]
            ids = rows["id"].to_numpy()[first]
            prints = np.frombuffer(b"".join(rows["bits"].take(pa.array(first)).to_pylist()), np.uint8).reshape(len(ids), -1)
            starts = np.searchsorted(first, starts)
            links = [np.zeros((2, 0), np.int64)]
            for i, j in near_pairs(prints, starts, np.diff(np.append(starts, len(ids))), radius):
                order = np.argsort(i, kind="stable")
                i, j = i[order], j[order]
                hit = similar(sets, i, j, similarity)
                links.append(np.stack([i[hit], j[hit]]))
                if sum(x.shape[1] for x in links) > 1 << 20:
                    links = [np.stack(forest(*np.concatenate(links, axis=1)))]
            u, v = np.concatenate(links, axis=1)
            if len(u):
                u, v = forest(u, v)
                yield pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], ["u", "v"])

    return rows.mapInArrow(run, "u long, v long").distinct()


def near_duplicate_groups(docs: DataFrame, *, doc_id="doc_id", text="text", shingle=5, similarity=0.8) -> DataFrame:
    """doc_id, text_hash, root (which names the group), group_id (the smallest doc_id of the group) for every document.

    Two documents are linked if the Jaccard similarity of their sets of shingles
    (of 64-bit hashes of them) is at least `similarity`. Candidates meet under
    min-hashes; those that are near by a 512-bit SimHash, compared bit-sliced, are
    verified on the whole sets where they meet, so no pair is ever written or joined.
    Of keys under which the same documents meet one is used.
    """

    def sketched(batches):
        for batch in batches:
            made = [sketches(t, shingle) for t in _texts(batch)]
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["doc_id", "text_hash", "id", "size", "bits", "keys"])

    def split(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(words(t), shingle)) for t in _texts(batch)]
            pieces = [[s[k : k + PIECE].tobytes() for k in range(0, len(s), PIECE)] for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pieces, pa.list_(pa.binary()))], ["id", "pieces"])

    ids = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    schema = T.StructType([*ids.schema.fields[:2], *T.StructType.fromDDL("id long, size long, bits binary, keys array<long>").fields])
    made = written(ids.mapInArrow(sketched, schema), "sketches")
    distinct = made.groupBy("id").agg(F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("example"), F.first("keys").alias("keys"), F.first("bits").alias("bits"), F.first("size").alias("size"))
    distinct = written(distinct, "sketches-distinct")
    entries = distinct.select("id", "size", F.posexplode("keys").alias("t", "key"))
    shared = entries.groupBy("t", "key").agg(F.count("*").alias("n"), F.sum("size").alias("hashes"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).filter("n > 1")
    shared = shared.groupBy("n", "hashes", "x", "y").agg(F.min(F.struct("t", "key")).alias("k")).select("k.t", "k.key", "n", "hashes")
    met = written(entries.join(shared, ["t", "key"]).select("t", "key", "id", "n", "hashes"), "sketches-met")
    example = distinct.join(met.select("id").distinct(), "id", "left_semi").select("id", "example.*")
    found = ids.select("text", *_identity("doc_id", "text_hash")).join(example.select("id", *_identity("doc_id", "text_hash")), _IDENTITY).dropDuplicates(_IDENTITY)
    sets = written(found.select("id", "text").mapInArrow(split, "id long, pieces array<binary>"), "sketches-sets")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(8 * F.col("hashes") / BLOCK_BYTES))
    links = verified_links(_in_blocks(met, blocks), distinct, sets, radius_for(similarity) + SLACK_BITS, similarity)
    roots = components(links)
    placed = distinct.join(roots, distinct.id == roots.node, "left").select("id", "first_id", F.coalesce("root", "id").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("first_id").alias("group_id")), "root").select("id", "root", "group_id")
    return made.join(named, "id").select("doc_id", "text_hash", "root", "group_id")


#: Columns that name a row by id and text, never null: joins and windows over them need one shuffle between them.
_IDENTITY = ["__id", "__no_id", "__text_hash"]


def _identity(doc_id, text_hash):
    named = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    hashed = F.col(text_hash) if isinstance(text_hash, str) else text_hash
    return F.coalesce(named.cast("string"), F.lit("")).alias("__id"), named.isNull().alias("__no_id"), hashed.alias("__text_hash")


def one_of_each_group(docs: DataFrame, *, doc_id="doc_id", text="text", **options) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, with all its columns; of equal rows one, of different texts under that id (or without any id) the one with the smallest hash."""
    named = near_duplicate_groups(docs, doc_id=doc_id, text=text, **options).filter(F.col("doc_id").eqNullSafe(F.col("group_id")))
    kept = named.groupBy("root").agg(F.first("doc_id").alias("doc_id"), F.min("text_hash").alias("text_hash")).select("doc_id", "text_hash")
    kept = kept.select(*_identity("doc_id", "text_hash"))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_identity(doc_id, F.xxhash64(text)))
    once = Window.partitionBy(*_IDENTITY).orderBy(F.lit(0))
    return keyed.join(kept, _IDENTITY, "left_semi").withColumn("__copy", F.row_number().over(once)).filter("__copy = 1").select("row.*")
