"""Phrase collocations: counts by slot of a minimal perfect hash over Apriori-safe candidates.

A phrase of 2 to MAX_WORDS words can occur MIN_COUNT times only if its parts do.
Passes over the texts find out, level by level, which phrases still may: each
task sums occurrences by a 64-bit hash of (lang, phrase), Spark sums these over
all tasks, and hashes of at least MIN_COUNT set a bit of a filter. Colliding
hashes only add up, so no frequent phrase is lost. Phrases that pass with all
their parts are the candidates, as texts in a table.

A minimal perfect hash gives each candidate a slot; it is built in shards of a
bounded size. Mappers look up every phrase of their texts that passes the filters
(those are the candidates, so the hash needs no keys to tell others apart),
bincount the slots and write what they found by blocks of slots; blocks are summed
in a tree. What a mapper writes has a bound by its own texts, so all of it grows
with the input, not with mappers times candidates. A candidate and both sides of
all its cuts are then joined with the sums by slot. Where candidates are more than
GROUP_KEYS, groups of shards follow each other, each with a pass of its own, so
what a task or the driver holds has a bound that no input moves: filters of at
most FILTER_BITS bits (fuller ones only let more candidates through), and a hash
of GROUP_KEYS keys.

Defined results: null text is empty, a null lang is `und`; only A-Z are lowered;
words and pieces are as PIECE_END and BLANK say, in bytes of UTF-8; texts of any
length are counted whole; equal rows count each; ties go to the smaller cut and
to the smaller phrase in byte order; an empty table gives an empty result; other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

from functools import cached_property, reduce
from itertools import chain, starmap

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written
from .perfect_hash import PerfectHash, build_shard, mix, shard_of

MIN_COUNT, MAX_WORDS, TOP, COVERED = 30, 4, 2000, 80
PIECE_END, BLANK = b".,;:!?\n\x0b\x0c\r", b" \t"
#: Bytes of texts handled at once, most bits of a filter, keys of a shard and of a group of shards, slots of a block, blocks summed by one task.
SLAB, FILTER_BITS, SHARD_KEYS, GROUP_KEYS, BLOCK, FAN_IN = 1 << 22, 1 << 30, 1 << 15, 1 << 27, 1 << 14, 32

#: Slots of a phrase, and of the left and the right side of each of its cuts.
SIDES = [f"{side}{cut}" for cut in range(1, MAX_WORDS) for side in ("left", "right")]
SLOTS = ["slot", *SIDES]

_LOWER, _KIND = np.arange(256, dtype=np.uint8), np.zeros(256, np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_KIND[list(BLANK)], _KIND[list(PIECE_END)] = 1, 2


def text_hash(texts: pa.Array) -> np.ndarray:
    """64-bit hashes of texts."""
    return pd.util.hash_array(texts.to_numpy(zero_copy_only=False), categorize=False)


class Words:
    """The words of some texts: hashes, the hash of each one's lang, and the piece that each is in (equal for neighbours in one piece only). langs: hashes by text."""

    def __init__(self, texts: pa.Array, langs: np.ndarray):
        wide = texts.cast(pa.large_string())
        starts = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
        data = np.frombuffer(wide.buffers()[2], np.uint8)[starts[0] : starts[-1]] if wide.buffers()[2] is not None else np.zeros(0, np.uint8)
        data, starts = _LOWER[data], starts - starts[0]
        kind = _KIND[data]
        in_word = kind == 0
        edge = np.ones(len(data) + 1, bool)
        np.not_equal(in_word[1:], in_word[:-1], out=edge[1:-1])
        edge[starts] = True  # a word ends with its text
        places = np.flatnonzero(edge).astype(np.int32)
        is_word = in_word[places[:-1]]
        begins = places[:-1][is_word]
        ends = np.flatnonzero(kind == 2).astype(np.int32)
        del kind, in_word, edge  # two tasks of an executor each have a slab: what is as long as its texts goes first
        parts = pa.StringArray.from_buffers(len(places) - 1, pa.py_buffer(places), pa.py_buffer(data)) if len(data) else pa.array([], pa.string())
        coded = parts.filter(pa.array(is_word)).dictionary_encode()
        self.distinct, self.codes = coded.dictionary, coded.indices.to_numpy()
        self.text = np.repeat(np.arange(len(starts) - 1, dtype=np.int32), np.diff(np.searchsorted(begins, starts.astype(np.int32))))
        self.piece = np.searchsorted(ends, begins).astype(np.int32) + self.text
        self.langs = langs
        self.distinct_hash = text_hash(self.distinct)

    @cached_property
    def hash(self) -> np.ndarray:
        return self.distinct_hash[self.codes]

    @cached_property
    def lang(self) -> np.ndarray:
        return self.langs[self.text]

    def __len__(self) -> int:
        return len(self.codes)

    def words_by_lang(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes of all distinct words in each lang, and how often they occur; and each word's place among these."""
        names, lang = np.unique(self.langs, return_inverse=True)
        code = self.codes.astype(np.int64) * len(names) + lang[self.text]
        counts = np.bincount(code, minlength=len(self.distinct) * len(names))
        seen = np.flatnonzero(counts)
        place = np.zeros(len(counts), np.int32)
        place[seen] = np.arange(len(seen))
        return phrase_hash(names[seen % len(names)], [self.distinct_hash[seen // len(names)]]), counts[seen], place[code]

    def whole(self, at: np.ndarray, k: int) -> np.ndarray:
        """Of places, those where k words follow in one piece."""
        at = at[at + k <= len(self.piece)]
        return at[self.piece[at] == self.piece[at + k - 1]]

    def phrase(self, at: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
        return phrase_hash(self.lang[at], [self.hash[at + j] for j in range(k)], seed)


def phrase_hash(lang: np.ndarray, words: list[np.ndarray], seed: int = 1) -> np.ndarray:
    h = mix(lang + np.uint64(seed * 1000 + len(words)))
    for w in words:
        h = mix((h ^ w) + np.uint64(0x9E3779B97F4A7C15))
    return h


def _slabs(batch: pa.RecordBatch):
    """Batches (lang, text) in runs of rows of about SLAB bytes: Words, with the runs' langs."""
    texts = batch.column(1)
    wide = texts.cast(pa.large_string())
    starts, done = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1], 0
    coded = batch.column(0).dictionary_encode()
    names, langs = coded.dictionary, coded.indices.to_numpy()
    hashes = text_hash(names)
    while done < len(texts):
        upto = max(done + 1, int(np.searchsorted(starts, starts[done] + SLAB, side="right")) - 1)
        own = langs[done:upto]
        yield Words(texts.slice(done, upto - done), hashes[own]), names, own
        done = upto


def _by_slab(batches, work):
    """What work(words, names, langs) yields for every slab; one is gone before the next is made."""
    return chain.from_iterable(starmap(work, chain.from_iterable(map(_slabs, batches))))


class Filter:
    """A set of hashes with false positives, as bits."""

    def __init__(self, size: int, blocks: dict[int, bytes]):
        self.mask, self.bits = np.uint64(size - 1), np.zeros(size // 8, np.uint8)
        for block, held in blocks.items():
            self.bits[block * (BLOCK // 8) : block * (BLOCK // 8) + len(held)] = np.frombuffer(held, np.uint8)

    def has(self, h: np.ndarray) -> np.ndarray:
        place = (h & self.mask).astype(np.int64)
        return (self.bits[place >> 3] >> (place & 7).astype(np.uint8) & 1) == 1


def filter_of(counts: DataFrame, least: int) -> Filter:
    """counts(h, n), summed, -> the hashes of at least `least`. The driver gets its bits, never the hashes."""
    kept = written(counts.groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("h"), "phrase-hashes")
    size = BLOCK
    while size < min(8 * kept.count(), FILTER_BITS):
        size *= 2

    def set_bits(keys, rows):
        bits = np.zeros(BLOCK, np.uint8)
        bits[rows.column("place").to_numpy()] = 1
        return pa.table({"block": [keys[0].as_py()], "bits": [np.packbits(bits, bitorder="little").tobytes()]}, schema=pa.schema([("block", pa.int64()), ("bits", pa.binary())]))

    place = F.col("h").bitwiseAND(size - 1)
    placed = kept.select(F.shiftright(place, BLOCK.bit_length() - 1).alias("block"), place.bitwiseAND(BLOCK - 1).alias("place")).distinct()
    return Filter(size, {r.block: bytes(r.bits) for r in placed.groupBy("block").applyInArrow(set_bits, "block long, bits binary").collect()})


def _summed(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)


def safe_places(words: Words, filters: list, upto: int):
    """(k, places): phrases of 1 to `upto` words that pass the filters with all their parts. filters[0]: words; [1]: pairs; [2]: all longer ones. Phrases of a length without a filter yet pass if their parts do."""
    hashes, _, place = words.words_by_lang()
    last = np.flatnonzero(filters[0].has(hashes)[place])
    yield 1, last
    for k in range(2, upto + 1):
        marked = np.zeros(len(words) + 1, bool)
        marked[last] = True
        last = words.whole(last[marked[last + 1]], k)
        held = filters[min(k, 3) - 1] if len(filters) >= min(k, 3) else None
        if held is not None:
            last = last[held.has(words.phrase(last, k))]
        yield k, last


def _level(rows: DataFrame, filters: list, levels: tuple[int, ...], totals: bool) -> DataFrame:
    """lang, h, n: occurrences by hash of the phrases of these lengths that may be frequent; and with `totals` those of all words by lang, with a null hash."""
    shared = rows.sparkSession.sparkContext.broadcast(filters)

    def count(words, names, langs):
        if shared.value:
            hashes, counts = _summed([words.phrase(at, k) for k, at in safe_places(words, shared.value, max(levels)) if k in levels])
        else:
            hashes, counts, _ = words.words_by_lang()
        if len(hashes):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(hashes), pa.string()), pa.array(hashes.view(np.int64)), pa.array(counts, pa.int64())], ["lang", "h", "n"])
        if totals:
            n = np.bincount(langs[words.text], minlength=len(names))
            yield pa.RecordBatch.from_arrays([names.cast(pa.string()), pa.nulls(len(names), pa.int64()), pa.array(n, pa.int64())], ["lang", "h", "n"])

    return rows.mapInArrow(lambda batches: _by_slab(batches, count), "lang string, h long, n long")


def _candidates(rows: DataFrame, filters: list, upto: int) -> DataFrame:
    """lang, phrase (words in order) of all candidates, each once."""
    shared = rows.sparkSession.sparkContext.broadcast(filters)

    def texts(words, names, langs):
        for k, at in safe_places(words, shared.value, upto):
            at = at[~pd.Series(words.phrase(at, k)).duplicated().to_numpy()]
            if len(at):
                text = pc.binary_join_element_wise(*[words.distinct.take(pa.array(words.codes[at + j])) for j in range(k)], " ")
                own = names.take(pa.array(langs[words.text[at]]))
                yield pa.RecordBatch.from_arrays([own.cast(pa.string()), text], ["lang", "phrase"])

    return rows.mapInArrow(lambda batches: _by_slab(batches, texts), "lang string, phrase string").distinct()


class Phrases:
    """Phrases as texts: how many words each has, and hashes of their parts."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        words = pc.split_pattern(texts, " ")
        coded, lang = words.flatten().dictionary_encode(), langs.dictionary_encode()
        self.n, begins = pc.list_value_length(words).to_numpy(), words.offsets.to_numpy()
        self.begins, self.words = begins[:-1] - begins[0], text_hash(coded.dictionary)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
        self.langs = text_hash(lang.dictionary)[lang.indices.to_numpy()] if len(lang) else np.zeros(0, np.uint64)

    def part(self, rows: np.ndarray, a: int, b: int, seed: int = 1) -> np.ndarray:
        return phrase_hash(self.langs[rows], [self.words[self.begins[rows] + j] for j in range(a, b)], seed)


def hash_shards(candidates: DataFrame, n_shards: int) -> DataFrame:
    """shard, sizes, bits."""

    def place(batches):
        for batch in batches:
            phrases = Phrases(batch.column(0), batch.column(1))
            for k in np.unique(phrases.n).tolist():
                rows = np.flatnonzero(phrases.n == k)
                h1, h2 = phrases.part(rows, 0, k), phrases.part(rows, 0, k, 2)
                yield pa.RecordBatch.from_arrays([pa.array(shard_of(h1, n_shards)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], ["shard", "h1", "h2"])

    def build(keys, rows):
        sizes, bits, _ = build_shard(*(rows.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")))
        kinds = [("shard", pa.int64()), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary())]
        return pa.Table.from_pylist([{"shard": keys[0].as_py(), "sizes": sizes, "bits": bits}], pa.schema(kinds))

    return candidates.select("lang", "phrase").mapInArrow(place, "shard long, h1 long, h2 long").groupBy("shard").applyInArrow(build, "shard long, sizes array<long>, bits binary")


def _cells(values: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Runs of an array as bytes."""
    offsets = np.append(begins, len(values)).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def _blocks(slots: np.ndarray, n: np.ndarray):
    """Sums of some slots, in order, as batches (block, places, n): the slots' places in their block as 16 bits each and the sums as 8 bits each, or as 64 bits each in rows of their own if they are larger."""
    for some, kind in ((n < 256, np.uint8), (n >= 256, np.int64)):
        own = slots[some]
        block = own // BLOCK
        begins = np.flatnonzero(np.append(True, block[1:] != block[:-1])) if len(own) else np.zeros(0, np.int64)
        if len(begins):
            yield pa.RecordBatch.from_arrays([pa.array(block[begins].astype(np.int64)), _cells((own % BLOCK).astype(np.uint16), begins), _cells(n[some].astype(kind), begins)], ["block", "places", "n"])


def _from_cells(places: pa.Scalar, n: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    at = np.frombuffer(places.as_buffer(), np.uint16)
    return at, np.frombuffer(n.as_buffer(), np.uint8 if n.as_buffer().size == len(at) else np.int64)


def slot_counts(rows: DataFrame, filters: list, upto: int, hashed: PerfectHash, base: int) -> DataFrame:
    """slot, n: how often each key of the hash, whose slots begin at `base`, occurs in the texts."""
    shared = rows.sparkSession.sparkContext.broadcast((filters, hashed))

    def look_up(words, names, langs):
        filters, hashed = shared.value
        slots = np.concatenate([hashed.slots(words.phrase(at, k), words.phrase(at, k, 2)) for k, at in safe_places(words, filters, upto)])
        return _blocks(*np.unique(slots[slots >= 0], return_counts=True))

    def total_of(rows):
        total = np.zeros(BLOCK, np.int64)
        for places, n in zip(rows.column("places"), rows.column("n"), strict=True):
            at, own = _from_cells(places, n)
            total[at] += own
        some = np.flatnonzero(total)
        return some, total[some]

    def add(keys, rows):
        some, n = total_of(rows)
        batches = [pa.RecordBatch.from_arrays([b.column(0), pa.array([keys[1].as_py()] * len(b), pa.int64()), b.column(1), b.column(2)], ["block", "task", "places", "n"]) for b in _blocks(keys[0].as_py() * BLOCK + some, n)]
        return pa.Table.from_batches(batches)

    def listed(keys, rows):
        some, n = total_of(rows)
        return pa.table({"slot": base + keys[0].as_py() * BLOCK + some, "n": n})

    # one Python process a task: more would each keep memory that the next pass needs
    parts, width = rows.mapInArrow(lambda batches: _by_slab(batches, look_up), "block long, places binary, n binary").withColumn("task", F.spark_partition_id().cast("long")), rows.rdd.getNumPartitions()
    while width > FAN_IN:
        parts, width = parts.withColumn("task", F.floor(F.col("task") / FAN_IN)).groupBy("block", "task").applyInArrow(add, "block long, task long, places binary, n binary"), -(-width // FAN_IN)
    return parts.groupBy("block").applyInArrow(listed, "slot long, n long")


def _with_slots(candidates: DataFrame, hashed: PerfectHash, base: int) -> DataFrame:
    """candidates(lang, phrase, SLOTS): those in this hash are filled in, others stay as they are."""
    shared = candidates.sparkSession.sparkContext.broadcast(hashed)

    def run(batches):
        hashed = shared.value
        for batch in batches:
            phrases = Phrases(batch.column(0), batch.column(1))
            found = np.full((len(SLOTS), len(phrases.n)), -1, np.int64)
            for k in np.unique(phrases.n).tolist():
                rows = np.flatnonzero(phrases.n == k)
                for column, (a, b) in enumerate([(0, k), *[part for cut in range(1, k) for part in ((0, cut), (cut, k))]]):
                    slots = hashed.slots(phrases.part(rows, a, b), phrases.part(rows, a, b, 2))
                    found[column, rows[slots >= 0]] = base + slots[slots >= 0]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pc.coalesce(pa.array(new, mask=new < 0), batch.column(c)) for c, new in zip(SLOTS, found, strict=True)]], ["lang", "phrase", *SLOTS])

    return candidates.mapInArrow(run, f"lang string, phrase string, {', '.join(f'{c} long' for c in SLOTS)}")


def phrase_counts(docs: DataFrame, *, text="text", lang="lang", least=MIN_COUNT, upto=MAX_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, counts, totals): lang, phrase, SLOTS of all candidates of 1 to `upto` words, sides that they don't have null; slot, n of those that occur `least` times; lang, n."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    first = written(_level(rows, [], (1,), True).groupBy("lang", "h").agg(F.sum("n").alias("n")), "phrase-words")
    totals = first.filter("h IS NULL").select("lang", "n")
    filters = [filter_of(first.filter("h IS NOT NULL").select("h", "n"), least)]
    for levels in [(2,), tuple(range(3, upto + 1))]:
        filters.append(filter_of(_level(rows, filters, levels, False).select("h", "n"), least))
    candidates = written(_candidates(rows, filters, upto), "phrase-candidates")
    n_shards = max(1, -(-candidates.count() // SHARD_KEYS))
    shards = written(hash_shards(candidates, n_shards), "phrase-shards")
    found, counts, base = candidates.select("lang", "phrase", *[F.lit(None).cast("long").alias(c) for c in SLOTS]), [], 0
    step = max(1, GROUP_KEYS // SHARD_KEYS)
    for a in range(0, n_shards, step):
        own = {r.shard: (r.sizes, r.bits, None) for r in shards.filter(F.col("shard").between(a, a + step - 1)).collect()}
        hashed = PerfectHash([own.get(s, ([], b"", None)) for s in range(a, min(a + step, n_shards))], a, n_shards)
        counts.append(written(slot_counts(rows, filters, upto, hashed, base).filter(F.col("n") >= least), "phrase-counts"))
        found, base = _with_slots(found, hashed, base), base + len(hashed)
        if a + step < n_shards:
            found = written(found, "phrase-slots")
    return found, reduce(DataFrame.unionByName, counts), totals


def _score(a: Column, l: Column, r: Column) -> Column:
    """floor(2000000 a / (l + r)), exactly."""
    return F.call_function("div", F.lit(2_000_000).cast("decimal(7,0)") * a.cast("decimal(20,0)"), l.cast("decimal(20,0)") + r.cast("decimal(20,0)"))


def collocations(docs: DataFrame, *, text="text", lang="lang", least=MIN_COUNT, upto=MAX_WORDS, top=TOP, covered=COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each lang's `top` phrases by the score of their weakest cut, without those that a longer one covers."""
    found, counts, totals = phrase_counts(docs, text=text, lang=lang, least=least, upto=upto)
    # by shuffle: compressed, slots are a small part of what they are in a driver's memory
    count = lambda slot, n: counts.select(F.col("slot").alias(slot), F.col("n").alias(n)).hint("merge")
    # parts of a phrase that occurs `least` times do so too, so no join loses one
    rows = written(found.filter("left1 IS NOT NULL").join(count("slot", "a"), "slot"), "phrases")
    sides = F.array(*[F.struct(F.lit(cut).alias("cut"), F.col(f"left{cut}").alias("left"), F.col(f"right{cut}").alias("right")) for cut in range(1, MAX_WORDS)])
    cuts = rows.select("slot", "a", F.explode(F.filter(sides, lambda side: side["left"].isNotNull())).alias("side")).select("slot", "a", "side.*").join(count("left", "l"), "left").join(count("right", "r"), "right")
    best = cuts.groupBy("slot").agg(F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r")).alias("best"))
    # a longer phrase occurs no more often than the one within it that is longer by one word, so these alone say what is covered
    inner = rows.filter("left2 IS NOT NULL").select("a", F.explode(F.array("right1", F.coalesce(*[f"left{cut}" for cut in range(MAX_WORDS - 1, 1, -1)]))).alias("slot"))
    most = inner.groupBy("slot").agg(F.max("a").alias("over"))
    kept = rows.drop(*SIDES).join(best, "slot").join(most, "slot", "left").filter(F.col("over").isNull() | (F.col("over").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered))
    kept = kept.select("lang", "phrase", "a", "best.score", "best.l", "best.r")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return kept.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = """
WITH p AS (SELECT doc_id, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\n\\x0B\\x0C\\r]') AS pieces FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^ \\t]+') AS ws FROM (SELECT lang, unnest(pieces) AS piece FROM p)),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM g WHERE k = 1 GROUP BY lang),
s AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM c WHERE k > 1),
cuts AS (SELECT s.lang, s.k, s.phrase, s.a, cut, x.f AS l, y.f AS r, ((2000000::HUGEINT * s.a) // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM s) s JOIN c x ON x.lang = s.lang AND x.phrase = array_to_string(s.ws[1:s.cut], ' ') JOIN c y ON y.lang = s.lang AND y.phrase = array_to_string(s.ws[s.cut + 1:s.k], ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
subs AS (SELECT s.lang, s.a AS over_a, array_to_string(s.ws[i:i + m - 1], ' ') AS phrase FROM s, (SELECT unnest([2, 3]) AS m) JOIN (SELECT unnest([1, 2, 3]) AS i) ON true WHERE m < s.k AND i + m - 1 <= s.k),
kept AS (SELECT b.* FROM best b LEFT JOIN (SELECT lang, phrase, max(over_a) AS over_a FROM subs GROUP BY ALL) o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.over_a IS NULL OR 100 * o.over_a < 80 * b.a)
SELECT k.lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) k JOIN n ON n.lang = k.lang WHERE rank <= 2000"""
