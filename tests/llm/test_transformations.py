"""Fill-in-the-middle, collocations and byte-pair encoding against brute force, SQL and the public library."""

import hashlib
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltascope.llm import bpe, catalog, fim, perfect_hash, phrases
from tests.conftest import SF
from tests.llm.conftest import CLASH, DOCS, prose
from tests.test_queries import plain


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def equals_sql(spark, duck, name):
    found, want = catalog.queries()[name](spark, SF), duck.execute(catalog.oracle_sql()[name])
    columns = sorted(found.columns)
    at = [[d[0] for d in want.description].index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in found.collect()), key=str)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)
    return rows


# Fill-in-the-middle


def units(text, unit):
    if unit == "character":
        return list(text)
    return re.findall(r"[^ \t-\r]*[ \t-\r]*" if unit == "word" else r"[^\n]*\n?", text)[:-1] if text else []


def by_hand(doc_id, text, unit):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    parts = units(text, unit)
    n = len(parts)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b, c = "".join(parts[:low]), "".join(parts[low:high]), "".join(parts[high:])
    if not text or any(m in text for m in fim.MARKERS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    spm = h[3] % 100 < 20
    return doc_id, n, "spm" if spm else "psm", low, high - low, f"<S>{c}<P>{a}<M>{b}" if spm else f"<P>{a}<S>{c}<M>{b}"


@pytest.mark.parametrize("unit", ["character", "word", "line"])
def test_fill_in_middle(edge_docs, edge_rows, spark, unit):
    more = [(500 + i, t) for i, t in enumerate(["x<P>y", "a<S", "<", "<<P", "\n\n\n", "a\nb\n\nc", "  lead and trail \t", "\U0001f600" * 3000, ("né " * 40 + "\n") * 300, "<S<M<P"] * 3)]
    docs = edge_docs.unionByName(spark.createDataFrame([(*r, "en", "a", None, *CLASH) for r in more], DOCS))
    made = fim.fill_in_middle(docs, unit=unit, carry=("text", "row"))
    rows = made.withColumn("again", fim.restored(F.col("output"), F.col("form"))).collect()
    want = Counter(by_hand(i, t, unit) for i, t in [(r[0], r[1]) for r in edge_rows] + more)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_units, r.middle_units, r.output) for r in rows) == want
    assert all(r.again == (r.row.text or "") and r.row.row == "row" for r in rows)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_chunks_of_any_size_give_the_same_cuts():
    texts = ["", "é", prose(1, 50), "", "a b\n" * 40, " ", "x" * 33, ""]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    for unit in fim.UNITS:
        whole = fim.Chunks(data, starts, unit, 1 << 20)
        for chunk in (1, 2, 3, 7, 64):
            parts = fim.Chunks(data, starts, unit, chunk)
            assert (parts.n == whole.n).all()
            for share in (0, 0.3, 0.5, 0.99, 1):
                ranks = np.floor(whole.n * share).astype(int)
                assert (parts.places(ranks) == whole.places(ranks)).all()


def test_slices_of_a_batch(edge_docs, monkeypatch):
    want = sorted(map(str, fim.fill_in_middle(edge_docs).collect()))
    monkeypatch.setattr(fim, "SLICE", 100)
    data = [r[1] or "" for r in [(0, prose(3, 100)), (1, ""), (2, "é" * 90), (3, None)]]
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3]), pa.array([7, 8, 9, 10]), pa.array([3, 4, 5, 6]), pa.array(data)], ["doc_id", "h1", "h2", "text"])
    slices = list(fim._cutter("character")(iter([batch])))
    assert len(slices) > 1 and ["".join(p) for s in slices for p in s.column("pieces").to_pylist()] == data
    assert [n for s in slices for n in s.column("n").to_pylist()] == list(map(len, data))
    assert sorted(map(str, fim.fill_in_middle(edge_docs.repartition(2)).collect())) == want


def test_fill_in_middle_of_nothing(no_docs):
    assert fim.fill_in_middle(no_docs).collect() == []


def test_fill_in_middle_query(spark, duck):
    assert len(equals_sql(spark, duck, "op11_fill_in_middle")) == 200


# Byte-pair encoding


@pytest.fixture(scope="module")
def library():
    tokenizers, public_tokenizers = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def tokenizer():
    return bpe.load(pytest.importorskip("public_tokenizers").path("word_bpe_49k.json"))


def hard_texts():
    rng = random.Random(4)
    some = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    codes = [*range(0x20, 0x3000), *range(0xA000, 0xD7FF), *range(0xE000, 0x20000)]
    texts = [some("aab'strevmld é1İΣ\n\t!' 　\x1c\x85", rng.randrange(40)) for _ in range(2000)]
    texts += ["".join(map(chr, rng.choices(codes, k=12))) for _ in range(2000)]
    special = ["<|endoftext|>", "a<|endoftext|>b <|startoftext|><|startoftext|>", "<|endoftext|", "é<|endoftext|>́x", "<|ENDOFTEXT|>"]
    return [*texts, *special, "x" * 3000, "haha" * 500, "ab" * 900 + "'s", "'''''s", "''s 's's 'res 'll'lls", "é ́", "", " ", "\U0001f600" * 50, "1" * 400]


def test_encoding_equals_the_library(tokenizer, library, monkeypatch):
    texts = hard_texts()
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    encoder = bpe.Encoder(tokenizer)
    assert encoder(texts).to_pylist() == want
    assert 0 < encoder.merged_words < len(encoder.known)
    assert encoder(texts[::-1]).to_pylist() == want[::-1]  # with remembered words
    monkeypatch.setattr(bpe, "PIECE", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 100)
    monkeypatch.setattr(bpe, "LONG_WORD", 5)
    assert bpe.Encoder(tokenizer)(texts).to_pylist() == want


def test_every_token_and_pairs_of_tokens(tokenizer, library):
    byte = {c: b for b, c in enumerate(bpe.byte_characters())}
    shown = [bytes(byte[c] for c in name.removesuffix("</w>") if c in byte).decode(errors="ignore") for name in tokenizer.names[: len(tokenizer.vocab)]]
    rng = random.Random(9)
    texts = shown + ["".join(rng.choices(shown, k=rng.choice([2, 2, 3, 5]))) for _ in range(5000)]
    assert bpe.Encoder(tokenizer)(texts).to_pylist() == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_ways_of_merging_agree(tokenizer):
    merges, rng = tokenizer.merges, random.Random(2)
    words = ["".join(rng.choices("aeinrst", k=rng.randrange(1, 30))).encode() for _ in range(300)]
    ids, counts, failed = merges.encode(words)
    assert failed
    symbols = [[*merges.inner[list(w[:-1])].tolist(), int(merges.final[w[-1]])] for w in words]
    want = [merges.exact(list(s)) for s in symbols]
    again, sizes = merges.merge_words(np.array([x for s in symbols for x in s]), np.array(list(map(len, symbols))))
    flat = [x for w in want for x in w]
    assert ids.tolist() == again.tolist() == flat and counts.tolist() == sizes.tolist() == list(map(len, want))


def test_encode_and_decode_documents(edge_docs, edge_rows, no_docs, tokenizer, library):
    found = bpe.decode(bpe.encode(edge_docs, tokenizer, carry=("text", "row")), tokenizer).collect()
    want = Counter()
    for doc_id, text, *_ in edge_rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc_id, text, tuple(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert Counter((r.doc_id, r.row.text, tuple(r.ids), r.decoded) for r in found) == want
    assert bpe.decode(bpe.encode(no_docs, tokenizer), tokenizer).collect() == []


def test_bpe_query(spark, library):
    found = {r.doc_id: r for r in catalog.queries()["op13_bpe"](spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows) == 200
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        got = found[r.doc_id]
        assert (got.n_tokens, got.ids_sha256, got.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))


def test_tokenizers_of_another_kind_are_refused():
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    with pytest.raises((ValueError, KeyError, TypeError)):
        bpe.load(path)


# Collocations


def collocations_by_hand(rows, least, upto=4, top=2000):
    """lang -> the phrases with a, l, r, n, score, by rank."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    f, n, out = Counter(), Counter(), {}
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(low)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, upto + 1) for i in range(len(words) - k + 1))
    often = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    over = Counter()
    for (lang, words), a in often.items():
        for k in range(2, len(words)):
            for i in range(len(words) - k + 1):
                over[lang, words[i : i + k]] = max(over[lang, words[i : i + k]], a)
    for (lang, words), a in often.items():
        if 100 * over[lang, words] < 80 * a:
            cuts = [(2_000_000 * a // (f[lang, words[:k]] + f[lang, words[k:]]), k) for k in range(1, len(words))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), f[lang, words[:k]], f[lang, words[k:]], n[lang]))
    return {lang: [(i + 1, p.decode(), -a, l, r, m, -s) for i, (s, a, p, l, r, m) in enumerate(sorted(own)[:top])] for lang, own in out.items()}


def ranked(found):
    out = {}
    for r in found.orderBy("lang", "rank").collect():
        out.setdefault(r.lang, []).append((r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score))
    return out


def test_collocations(edge_docs, edge_rows, spark, monkeypatch):
    more = [(700 + i, "New York, new\tyork. NEW YORK city! é à é à  x x x x\ny\vy\fy\ry " * 3 + "Ünder ÜNDER", lang) for i, lang in enumerate(["en", None, "und", "en", "fr"])]
    docs = edge_docs.unionByName(spark.createDataFrame([(*r, "a", None, *CLASH) for r in more], DOCS))
    rows = [(r[1], r[2]) for r in edge_rows] + [(t, lang) for _, t, lang in more]
    for least in (3, 12):
        want = collocations_by_hand(rows, least)
        assert len(want) >= 3 and ranked(phrases.collocations(docs, least=least)) == want
    monkeypatch.setattr(phrases, "SHARD_KEYS", 20)
    monkeypatch.setattr(phrases, "GROUP_KEYS", 300)  # several groups of shards, so counts come from several passes
    monkeypatch.setattr(phrases, "BLOCK", 64)
    monkeypatch.setattr(phrases, "FILTER_BITS", 64)  # full filters: every phrase is a candidate
    monkeypatch.setattr(phrases, "FAN_IN", 2)
    monkeypatch.setattr(phrases, "SLAB", 500)
    assert ranked(phrases.collocations(docs, least=12, top=7)) == collocations_by_hand(rows, 12, top=7)


def test_collocations_of_nothing(no_docs, edge_docs):
    assert phrases.collocations(no_docs).collect() == []
    assert phrases.collocations(edge_docs, least=10**6).collect() == []


def test_scores_beyond_64_bits(spark):
    a, l, r = 9 * 10**18, 9 * 10**18, 123
    got = spark.createDataFrame([(a, l, r)], "a long, l long, r long").select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 2_000_000 * a // (l + r)


def test_perfect_hash():
    rng = np.random.default_rng(1)
    h1, h2 = rng.integers(0, 2**64, (2, 20_000), dtype=np.uint64)
    h1[1] = h1[0]  # told apart by the second hash
    shard = perfect_hash.shard_of(h1, 7)
    parts = [perfect_hash.build_shard(h1[shard == s], h2[shard == s]) for s in range(7)]
    whole = perfect_hash.PerfectHash(parts, 0, 7)
    slots = whole.slots(h1, h2)
    assert sorted(slots.tolist()) == list(range(20_000))
    assert (whole.slots(*rng.integers(0, 2**64, (2, 20_000), dtype=np.uint64)) == -1).all()
    some = perfect_hash.PerfectHash(parts[2:4], 2, 7).slots(h1, h2)
    assert ((some >= 0) == ((shard == 2) | (shard == 3))).all() and len(set(some[some >= 0].tolist())) == (some >= 0).sum()
    none = perfect_hash.PerfectHash([perfect_hash.build_shard(h1[:0], h2[:0])], 0, 1)
    assert len(none) == 0 and (none.slots(h1[:5], h2[:5]) == -1).all()


def test_sums_of_slots_grow_with_the_texts_and_not_with_the_candidates():
    """A mapper of few phrases writes few bytes, however many candidates there are; large sums are kept whole."""
    slots, n = np.array([0, 5, 5_000_000, 5_000_001, 90_000_000]), np.array([1, 10**12, 255, 256, 7])
    batches = list(phrases._blocks(slots, n))
    assert sum(len(x.as_py()) for b in batches for c in ("places", "n") for x in b.column(c)) == 3 * 3 + 2 * 10
    found = {}
    for b in batches:
        for block, places, own in zip(*b.columns, strict=True):
            at, own = phrases._from_cells(places, own)
            found |= dict(zip((block.as_py() * phrases.BLOCK + at.astype(np.int64)).tolist(), own.tolist(), strict=True))
    assert found == dict(zip(slots.tolist(), n.tolist(), strict=True))


def test_slots_without_stored_keys():
    """Where only keys are looked up a key takes a few bits, so a mapper can hold many of them in one pass."""
    h1, h2 = np.random.default_rng(2).integers(0, 2**64, (2, 20_000), dtype=np.uint64)
    shard = perfect_hash.shard_of(h1, 7)
    parts = [(*perfect_hash.build_shard(h1[shard == s], h2[shard == s])[:2], None) for s in range(7)]
    hashed = perfect_hash.PerfectHash(parts, 0, 7)
    assert len(hashed) == 20_000 and sorted(hashed.slots(h1, h2).tolist()) == list(range(20_000))
    assert hashed.keys is None and hashed.words.nbytes + hashed.before.nbytes < 20_000


def test_counts_of_phrases_are_joined_by_slot(spark, edge_docs, edge_rows):
    """Sums and slots are tables: the driver gathers no counts, and every side of a cut has a sum."""
    found, counts, _ = phrases.phrase_counts(edge_docs, least=3)
    slots, n = [r.asDict() for r in found.collect()], {r.slot: r.n for r in counts.collect()}
    frequent = [r for r in slots if r["slot"] in n]
    assert len({r["slot"] for r in slots}) == len(slots) and len(frequent) == len(n) > 100
    for r in frequent:
        k = len(r["phrase"].split(" "))
        assert [r[c] is None for c in phrases.SIDES] == [c >= 2 * (k - 1) for c in range(len(phrases.SIDES))]
        assert all(n[r[c]] >= n[r["slot"]] for c in phrases.SIDES if r[c] is not None)


def test_collocations_query(spark, duck):
    equals_sql(spark, duck, "op12_collocations")


def test_bpe_encoder_holds_little(tokenizer):
    """Two tasks of an executor each have an encoder: the bound of what it remembers and handles at once holds whatever the texts."""
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcdefghijklmnop  ", k=60_000)) for _ in range(60)]
    encoder = bpe.Encoder(tokenizer)
    encoder(texts[:1])
    tracemalloc.start()
    for text in texts:
        encoder([text])
    encoder(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20 and len(encoder.sizes) < 200_000


def test_bpe_query_needs_one_python_process_a_task(spark, tokenizer, edge_docs):
    assert catalog.queries()["op13_bpe"](spark, SF)._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    two = bpe.decode(bpe.encode(edge_docs, tokenizer, carry=("row",)), tokenizer).collect()
    assert Counter(map(str, bpe.encode(edge_docs, tokenizer, carry=("row",), decoded=True).collect())) == Counter(map(str, two))
