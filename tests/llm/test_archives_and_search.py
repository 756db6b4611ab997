"""WARC round trips, benchmark passages and top-k search against brute force."""

import base64
import gzip
import hashlib
import math
import random
import re

import numpy as np
import pytest

from deltascope.llm import decontam, topk, warc

PAGES = [
    (5, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (9, None, None), (8, "http://a/4", ""), (1, "http://a\r\n/5", "ends with\r\n"), (3, "http://a/6", "é ü\r\n\r\nmiddle\r\n\r\n"),
    (4, "x", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.1\r\nContent-Length: 99999\r\n\r\n"), (7, "x", "a\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nfake\r\n\r\n"),
    (6, "x", "long " * 20_000), (10, "x", "\r\n\r\n\r\n\r\n"), (11, "x", "\r"), (12, "x", "\n\r\n"),
]


def expected(pages):
    first = {}
    for i, _, h in pages:
        first[h or ""] = min(first.get(h or "", i), i)
    out = set()
    for i, _, h in pages:
        raw = (h or "").encode()
        own = first[h or ""] == i
        out.add((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if own else "revisit", None if own else first[h or ""]))
    return out


def round_trip(spark, pages, tmp_path, **options):
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "'x' AS payload", "2 AS value")
    path = f"file://{tmp_path}/warc"
    warc.write_archives(frame, path, **options)
    return path, warc.verified(warc.page_records(warc.scan_archives(spark, path)))


@pytest.mark.parametrize("per_file", [1, 3, 1024])
def test_warc_round_trip(spark, tmp_path, per_file):
    path, found = round_trip(spark, PAGES, tmp_path, records_per_file=per_file)
    assert {tuple(r) for r in found.drop("file", "off", "next").collect()} == expected(PAGES)
    payloads = {bytes(r.payload) for r in warc.read_archives(spark, path).collect()}
    assert {(h or "").encode() for _, _, h in PAGES} <= payloads


def test_candidates_in_payloads_are_seen_and_rejected(spark, tmp_path):
    path, _ = round_trip(spark, PAGES, tmp_path)
    assert warc.scan_archives(spark, path).count() > warc.read_archives(spark, path).count() == len(PAGES)


def test_the_files_are_well_formed(spark, tmp_path):
    path, _ = round_trip(spark, PAGES, tmp_path)
    n = 0
    for f in (tmp_path / "warc").glob("part-*"):
        data = gzip.decompress(f.read_bytes())
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            size = int(dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])[b"Content-Length"])
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            data, n = rest[size + 4 :], n + 1
    assert n == len(PAGES)


def test_chains_of_any_length(spark):
    rows = [(f, i, i + 1) for f in (1, 2) for i in range(37)] + [(1, 100, 101), (1, 101, 5)]
    found = warc.reachable(spark.createDataFrame(rows, "file long, off long, next long")).collect()
    assert sorted(map(tuple, found)) == [(f, i) for f in (1, 2) for i in range(37)]


def test_no_pages(spark, tmp_path):
    assert round_trip(spark, [], tmp_path)[1].collect() == []


def test_repeated_pages_and_null_ids(spark, tmp_path):
    pages = [(1, "a", "x"), (1, "a", "x"), (None, "b", "x"), (None, "c", "only")]
    _, found = round_trip(spark, pages, tmp_path)
    assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in found.collect()) == [("1", "response", "None")] * 2 + [("None", "response", "None"), ("None", "revisit", "1")]


# Benchmark passages


def substring_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_is_the_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 90)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 120)))
        masks = {}
        for i, c in enumerate(item):
            masks[c] = masks.get(c, 0) | 1 << i
        assert decontam.myers(masks, len(item), text, len(item))[0] == substring_distance(item, text)


def spoil(text, edits, rng):
    text = list(text)
    for _ in range(edits):
        i = rng.randrange(len(text))
        text[i : i + 1] = rng.choice([[], ["q"], [text[i], "z"]])
    return "".join(text)


def test_leaks_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 30)))) for i in range(12)] + [(50, None), (51, ""), (52, "too short"), (53, "short"), (54, "ort"), (55, " "), (56, "What is 7 * 6?")]
    items.append((60, items[0][1].upper()))
    docs = [(0, None), (1, ""), (2, "too short"), (3, "so what is\n7 * 6? ask"), (4, "tooshort shorts"), (5, "short")]
    for k in range(60):
        item = items[k % 12][1]
        docs.append((10 + k, " ".join(word() for _ in range(20)) + " " + spoil(item, k // 12 * 2, rng).replace(" ", "\n ") + " " + " ".join(word() for _ in range(9))))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, text in docs:
        for i, item in items:
            body, it = decontam.normal(text), decontam.normal(item)
            if len(it) >= decontam.MIN_CHARS and body and (n := substring_distance(it, body)) <= int(len(it) * decontam.ERROR_RATE):
                want.add((d, i, n))
            elif 0 < len(it) < decontam.MIN_CHARS and re.search(rf"(?<![^\W_]){re.escape(it)}(?![^\W_])", body):
                want.add((d, i, 0))
    assert len(want) > 30
    assert {tuple(r) for r in decontam.find(frame, bench).collect()} == want
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 600)
    assert {tuple(r) for r in decontam.find(frame, bench).collect()} == want
    clean = decontam.clean(frame.selectExpr("*", "1 AS item_id"), bench)
    long = {i for i, t in items if len(decontam.normal(t)) >= decontam.MIN_CHARS}
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {w[0] for w in want if w[1] in long} and clean.columns == ["doc_id", "text", "item_id"]


@pytest.mark.parametrize("kind", ["short", "string", "decimal(9,0)", "double"])
def test_items_with_ids_of_any_type(spark, kind):
    bench = spark.createDataFrame([(1, "a passage of more than twenty-four characters"), (None, "brief one")], "item_id int, text string").selectExpr(f"cast(item_id AS {kind}) AS item_id", "text")
    docs = spark.createDataFrame([(7, "x a passage of more than twenty four characters, and brief one")], "doc_id long, text string")
    found = decontam.find(docs, bench)
    assert found.schema["item_id"].dataType == bench.schema["item_id"].dataType
    assert sorted((r.doc_id, r.item_id is None, r.distance) for r in found.collect()) == [(7, False, 1), (7, True, 0)]


def test_no_benchmark_and_no_documents(spark, no_docs, edge_docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find(edge_docs, bench).collect() == [] and decontam.clean(edge_docs, bench).count() == edge_docs.count()
    assert decontam.find(no_docs, spark.createDataFrame([(1, "a" * 50)], "item_id long, text string")).collect() == []


# Top-k


def brute_top(rows, every, k):
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q, a in ok:
        if q % every == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])}
    return out


def vectors(n, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 0.3, (4, 8))
    return [(i, [float(np.float32(x)) for x in centers[i % 4] + rng.normal(0, spread, 8)]) for i in range(n)]


@pytest.mark.parametrize("seed", [0, 1])
def test_top_k_is_exact(spark, seed):
    rows = vectors(400, seed) + [(400 + i, [0.25] * 8) for i in range(60)]
    rows += [(1000, None), (1001, [0.1] * 7 + [None]), (1020, [float("nan")] * 8), (1040, [float("inf")] + [0.0] * 7), (None, [0.1] * 8), (1060, [0.5, -0.5]), (1061, [0.25, 0.25]), (1080, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank", "3 AS v", "4 AS dim")
    got = {tuple(r) for r in topk.top_k(frame, data_block=100, query_block=10).collect()}
    assert got == brute_top(rows, 20, 20)


@pytest.mark.parametrize("spread", [0.0, 0.002, 0.05, 3.0])
def test_trees_are_nets_that_cover(spread):
    x = np.floor(64 * np.array([v for _, v in vectors(3000, 3, spread=spread)]))
    order, nodes = topk.build(x)
    assert sorted(order.tolist()) == list(range(len(x))) and len(nodes) > 1
    radius = nodes[:, 4].copy().view(np.float64)
    for n, (a, b, child, many, _, up) in enumerate(nodes.tolist()):
        away = np.sqrt(((x[order[a:b]] - x[order[a]]) ** 2).sum(1))
        assert away.max() == radius[n] <= up
        if not many:
            assert b - a <= topk.LEAF or radius[n] == 0
            continue
        kids = nodes[child : child + many]
        assert kids[0, 0] == a and kids[-1, 1] == b and (kids[1:, 0] == kids[:-1, 1]).all()
        centers = x[order[kids[:, 0]]]
        apart = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(2)) + 1e12 * np.eye(many)
        assert apart.min() >= radius[child : child + many].max()


def test_clusters_are_pruned_and_noise_stays_exact(spark):
    """Products made by top_k itself, of all 40 x 799 products that there are."""
    made = {}
    for name, spread, data_block in (("one block", 0.002, 4000), ("many blocks", 0.002, 100), ("noise", 3.0, 100)):
        rows = vectors(800, 5, spread)
        counter = spark.sparkContext.accumulator(0)
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = topk.top_k(frame, k=5, data_block=data_block, query_block=10, products=counter).collect()
        assert {tuple(r) for r in found} == brute_top(rows, 20, 5)
        made[name] = counter.value
    assert made["one block"] < 0.3 * 40 * 799 and made["many blocks"] < 0.6 * 40 * 799


@pytest.mark.parametrize("seed", range(12))
def test_search_equals_sorting(seed):
    rng = np.random.default_rng(seed)
    n, m, dim, k = rng.integers(1, 900, 2).tolist() + [int(rng.integers(0, 6)), int(rng.integers(1, 40))]
    wide = 2**40 if seed % 4 == 3 else 3
    def made(size):
        v = rng.integers(-wide, wide + 1, (size, dim))
        ids = rng.permutation(1000)[:size].astype(np.int64)
        order, nodes = topk.build(v.astype(float))
        return topk.Tree(v[order], ids[order], nodes)

    q, d = made(n), made(m)
    at, ids, scores, _, _ = topk.search(q, d, k)
    got = {(int(a), int(i), int(s)) for a, i, s in zip(at, ids, scores, strict=True)}
    products = np.clip(q.v.astype(object) @ d.v.astype(object).T, -(2**63), 2**63 - 1) if dim else np.zeros((n, m), object)
    want = set()
    for a in range(n):
        own = sorted((-int(s), int(i)) for s, i in zip(products[a], d.ids, strict=True) if i != q.ids[a])
        want |= {(a, i, -s) for s, i in own[:k]}
    assert got == want


def test_repeated_rows_and_a_hot_vector(spark):
    rows = [(i, [0.5, 0.25, 0.0]) for i in range(300)] + [(7, [0.5, 0.25, 0.0])] * 20 + [(400 + i, [i / 64, 1.0, -1.0]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(frame, k=12, data_block=50, query_block=8).collect())
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows]
    want = []
    for q, a in ok:
        if q % 20 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:12])]
    assert got == sorted(want)


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0**40 * (i + 1), -(2.0**39), float(i)]) for i in range(30)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    got = {(r.query_id, r.vec_id, r.score) for r in topk.top_k(frame, k=30).collect()}
    assert got == {(q, i, clip(s)) for q, _, i, s in brute_top(rows, 20, 30)}


def test_no_vectors(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
