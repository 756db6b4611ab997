"""Mixing, sharding, language, quality and near-duplicates on small tables with every edge case."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltascope.llm import bitslice, langid, mixing, quality, sharding, simhash
from deltascope.llm.components import components
from tests.llm.conftest import prose


def n_words(text):
    return len((text or "").encode().split())


# Mixing


def targets(sizes):
    """Shares by weight; what is above twice a source's size is shared again until none is."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, 1.5 * sum(sizes.values()), list(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not full:
            return out | {s: level * weight[s] for s in free}
        for s in full:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            free.remove(s)
    return out


def test_mix(edge_docs, edge_rows):
    rows = mixing.mix(edge_docs).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, n_words(t)) for i, t, *_ in edge_rows)
    sizes, taken = Counter(), Counter()
    for _, t, _, s in edge_rows:
        sizes[s] += n_words(t)
    want = targets(sizes)
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and r.taken <= 2 * r.size
        taken[r.source] += r.taken
    largest = defaultdict(int)
    for _, t, _, s in edge_rows:
        largest[s] = max(largest[s], n_words(t))
    assert all(abs(taken[s] - want[s]) <= 2 * largest[s] for s in sizes)
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(edge_docs.repartition(3)).collect()))


def test_mixed_documents_are_whole_rows(edge_docs):
    copies = {(r.doc_id, r.size): r.copies for r in mixing.mix(edge_docs).collect() if r.doc_id is not None and r.doc_id != 5}
    out = mixing.mixed_documents(edge_docs)
    assert out.columns == edge_docs.columns
    seen = Counter((r.doc_id, n_words(r.text)) for r in out.collect())
    assert all(seen.get(k, 0) == n for k, n in copies.items())


def test_mix_of_nothing(no_docs):
    assert mixing.mix(no_docs).collect() == [] and mixing.mixed_documents(no_docs).collect() == []


# Sharding


def test_shards(edge_docs, edge_rows):
    rows = sharding.shard(edge_docs, 6).collect()
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in edge_rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(6))
    where = defaultdict(set)
    for r in rows:
        where[r.text_crc32, r.size].add(r.shard)
    assert all(len(v) == 1 for (crc, _), v in where.items() if crc)


def brute_capacity(sizes, shards):
    def needed(cap):
        n, load = 1, 0
        for s in sizes:
            n, load = (n, load + s) if load + s <= cap else (n + 1, s)
        return n

    cap = max(sizes)
    while needed(cap) > shards:
        cap += 1
    return cap


def test_cuts_reach_the_least_capacity(spark):
    rng = random.Random(3)
    for shards in (1, 3, 7):
        sizes = [rng.randint(1, 400) for _ in range(50)]
        atoms = spark.createDataFrame(list(enumerate(sizes)), "atom long, bytes long")
        cuts = [0, *sharding.cut_points(atoms, shards), len(sizes)]
        loads = [sum(sizes[a:b]) for a, b in zip(cuts, cuts[1:])]
        assert len(loads) <= shards and max(loads) == brute_capacity(sizes, shards)


def test_a_hot_group_leaves_the_other_shards_even():
    """All shards are used and even beside atoms larger than a fair share, within the least capacity."""
    rng = np.random.default_rng(4)
    for part in (0, 1 / 3, 0.08, 0.05):
        for at in (0, 5_000, 12_345, 19_999):
            sizes = rng.integers(90, 110, 20_000)
            sizes[at] = max(sizes[at], int(sizes.sum() * part / (1 - part)))
            ends = sharding.ends(sizes, 24)
            loads = np.diff([0, *np.cumsum(sizes)[np.array(ends) - 1]])
            fair = (sizes.sum() - sizes[at]) / 23
            assert len(loads) == 24 and loads.max() <= max(sizes[at] + fair * 0.01, fair * 1.1)
            assert np.sort(loads)[:-1].min() > 0.5 * fair and sorted(loads)[2] > 0.9 * fair
    for _ in range(300):
        sizes, shards = rng.integers(1, 400, int(rng.integers(1, 40))), int(rng.integers(1, 9))
        sizes[rng.integers(0, len(sizes), 2)] *= rng.integers(1, 20)
        ends = sharding.ends(sizes, shards)
        loads = [int(sizes[a:b].sum()) for a, b in zip([0, *ends], ends)]
        assert ends[-1] == len(sizes) and len(loads) == min(shards, len(sizes)) and max(loads) == brute_capacity(sizes.tolist(), shards)


def test_shards_of_nothing(no_docs):
    assert sharding.shard(no_docs).collect() == []


# Language


def test_language_rules_and_held_out_accuracy(spark, edge_docs):
    german = "der die das und nicht mit schule zeichen wieder unter".split()
    rows = [(1000 + i, prose(i, 30) if i % 2 else prose(i, 30, german), "la" if i % 2 else "de") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, learn=~langid.held_out())
    found = langid.identify(docs, model, carry=("doc_id", "lang")).filter(langid.held_out()).collect()
    assert len(found) > 20 and all(r.lang == r.lang_pred and 0 <= r.score <= 1 for r in found)
    edge = langid.identify(edge_docs, model).collect()
    assert len(edge) == edge_docs.count()
    assert {r.doc_id for r in edge if r.lang_pred == "und"} == {0, 1, 2, 15, None} and all(r.score == 0 for r in edge if r.lang_pred == "und")
    kept = langid.identified(edge_docs, model)
    assert kept.columns == edge_docs.columns and not {0, 1, 2, 15} & {r.doc_id for r in kept.collect()}


def test_language_without_training(no_docs, edge_docs):
    model = langid.train(no_docs, learn=F.lit(True))
    assert {(r.lang_pred, r.score) for r in langid.identify(edge_docs, model).collect()} == {("und", 0.0)}
    assert langid.identify(no_docs, model).collect() == []


def test_unseen_words_back_off():
    import numpy as np

    model = {"langs": ["x", "y"], "prior": np.zeros(2), "tables": [(["known"], np.array([[0.0, -5.0]]))] + [([], np.zeros((0, 2))) for _ in range(4)]}
    model["tables"][2] = (["zz"], np.array([[-9.0, -1.0]]))
    score = langid.Scorer(model)
    assert score("known")[0] == "x" and score("zzzz")[0] == "y" and score("???") == ("und", 0.0)


# Quality


def test_quality_separates_held_out(spark, edge_docs, no_docs):
    rows = [(i, prose(i, 60) if i % 4 else " ".join(w.upper() + "!!" for w in prose(i, 60).split())) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(0, 400, 2)] + [(None, 1), (7, None)], "doc_id long, quality int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    net = quality.train(docs.filter(~held), labels.filter(~held))
    found = quality.classify(docs.filter(held), net, ["doc_id"]).collect()
    right = [(r.score >= 0.3) == (r.doc_id % 4 > 0) for r in found]
    assert len(right) > 40 and sum(right) / len(right) > 0.9
    assert all(0 <= r.score <= 1 for r in quality.classify(edge_docs, net, ["doc_id"]).collect())
    assert quality.classify(no_docs, net, ["doc_id"]).collect() == []


def test_quality_without_labels(spark, edge_docs, no_docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.classify(edge_docs, quality.train(no_docs, labels), ["doc_id"]).collect()} == {0.5}


# Near-duplicates


def brute_components(rows, radius=3):
    prints = [(i, simhash.fingerprint(t) & (2**64 - 1)) for i, t, *_ in rows]
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(prints):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return Counter((i, f, least.get(root(k))) for k, (i, f) in enumerate(prints))


def test_fingerprint_is_the_majority_of_shingle_bits():
    xxhash = pytest.importorskip("xxhash")
    text = "The Quick  brown\tfox\njumps É over"
    w = "the quick brown fox jumps É over".split()
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(5)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > 5)
    assert simhash.fingerprint(text) & (2**64 - 1) == want
    assert simhash.fingerprint("") == simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("One two") & (2**64 - 1) == xxhash.xxh64_intdigest(b"one two", 42)


def test_components_of_documents(edge_docs, edge_rows):
    found = Counter((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.linked_documents(edge_docs).collect())
    assert found == brute_components(edge_rows)


def test_near_links_miss_none(spark, monkeypatch):
    """Clusters of fingerprints up to 4 flips around a centre; blocks are small enough to be split."""
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        center = rng.getrandbits(64)
        for _ in range(40):
            x = center
            for b in rng.sample(range(64), rng.randint(0, 4)):
                x ^= 1 << b
            prints.add(x - (1 << 64) if x >> 63 else x)
    prints = sorted(prints)
    links = simhash.near_links(spark.createDataFrame([(p,) for p in prints], "fp long"))
    roots = {r.node: r.root for r in components(links).collect()}
    group = {p: roots.get(p, p) for p in prints}
    mask = (1 << 64) - 1
    near = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if ((a ^ b) & mask).bit_count() <= 3]
    assert near and all(group[a] == group[b] for a, b in near)
    assert all(((r.u ^ r.v) & mask).bit_count() for r in links.collect())


def test_bitslice_counts_exactly():
    import numpy as np

    rng = np.random.default_rng(0)
    prints = rng.integers(0, 4, (150, 8), dtype=np.uint8)
    starts, sizes = np.array([0, 70, 71]), np.array([70, 1, 79])
    bits = np.unpackbits(prints, axis=1).astype(int)
    for radius in (0, 3, 6, 9):
        got = {(int(a), int(b)) for i, j in bitslice.near_pairs(prints, starts, sizes, radius) for a, b in zip(i, j)}
        want = {(a, b) for s, n in zip(starts, sizes) for a in range(s, s + n) for b in range(a + 1, s + n) if abs(bits[a] - bits[b]).sum() <= radius}
        assert got == want


@pytest.mark.parametrize("width", [8, 64])
def test_bitslice_of_few_rows(width):
    import numpy as np

    rng = np.random.default_rng(width)
    for n in (1, 2, 3, 63, 64, 65, 129):
        prints = rng.integers(0, 2, (n, width), dtype=np.uint8)
        prints[n // 2 :] = prints[: n - n // 2]
        got = {(int(a), int(b)) for i, j in bitslice.near_pairs(prints, np.array([0]), np.array([n]), 0) for a, b in zip(i, j)}
        assert got == {(a, b) for a in range(n) for b in range(a + 1, n) if (prints[a] == prints[b]).all()}


def test_component_chains(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (300, 200), (7, 7)]
    roots = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert roots == {i: 0 for i in range(1, 51)} | {200: 100, 300: 100}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_one_document_of_each_group_stays(spark, edge_docs, no_docs):
    kept = simhash.one_of_each_group(edge_docs)
    ids = Counter(r.doc_id for r in kept.collect())
    assert kept.columns == edge_docs.columns and ids[5] == 1 and not ids[6] and not ids[7] and ids[4] == 1
    assert ids[0] == 1 and not ids[1] and not ids[2]  # texts without words are one group
    assert simhash.one_of_each_group(no_docs).collect() == [] and simhash.linked_documents(no_docs).collect() == []


def test_similar_documents_are_caught_and_others_left(spark):
    rows, rng = [], random.Random(1)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(800)]
    for k in range(60):
        text = [rng.choice(vocabulary) for _ in range(rng.randint(80, 500))]
        rows.append((2 * k, " ".join(text)))
        for _ in range(max(1, len(text) // 100)):
            text[rng.randrange(len(text))] = "changed"
        rows.append((2 * k + 1, " ".join(text)))
    groups = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(groups[2 * k + 1] == 2 * k for k in range(60))
    assert caught >= 58 and all(groups[2 * k] == 2 * k for k in range(60))


def test_links_are_exact_whatever_the_edit(spark):
    """Pairs at or just above a similarity of 0.8 are joined and pairs just below are not, by kind of edit."""
    rng = random.Random(2)
    fresh = lambda n: [f"w{rng.getrandbits(60):x}" for _ in range(n)]
    rows, joined, kinds = [], set(), defaultdict(list)

    def pair(kind, a, b):
        k = 2 * len(rows)
        rows.extend([(k, " ".join(a)), (k + 1, " ".join(b))])
        sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a, b)]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            joined.add(k)
        kinds[kind].append(k)

    for n in [8, 12, 20, 44, 104, 404] * 8:
        tail = (n - 4) // 4
        for kind, text in ((kind, fresh(n)) for kind in ("appended", "truncated", "too much appended", "inserted")):
            other = fresh(tail) + text if kind == "inserted" else text + fresh(tail + (1 + n // 40) * (kind == "too much appended"))
            pair(kind, *((other, text) if kind == "truncated" else (text, other)))
        if n > 44:
            text = fresh(n)
            edited = list(text)
            for w in range(10, 10 + 25 * (n // 250 + 1) // 2, 12):
                edited[w] = "changed"
            pair("edited", text, edited)
    groups = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()}
    for kind, found in kinds.items():
        want = [k for k in found if k in joined]
        assert sum(groups[k + 1] == k for k in want) >= 0.96 * len(want), kind
        assert all(groups[k + 1] == k + 1 for k in found if k not in joined), kind
    assert not joined & set(kinds["too much appended"]) and all(joined & set(kinds[k]) for k in ("appended", "truncated", "inserted", "edited"))


def test_similarity_of_sets_is_exact():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 60, 300, dtype=np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, rng.integers(200, 300), replace=False), rng.integers(0, 1 << 60, rng.integers(0, 60), dtype=np.uint64)])) for _ in range(150)]
    sets += [np.zeros(0, np.uint64), np.zeros(0, np.uint64), base[:1], np.unique(base)]
    i, j = np.nonzero(np.triu(np.ones((len(sets), len(sets)), bool), 1))
    for s in (0.5, 0.7, 0.8):
        got = simhash.similar(sets, i, j, s)
        want = [len(set(sets[a]) & set(sets[b])) >= s * len(set(sets[a]) | set(sets[b])) for a, b in zip(i, j)]
        assert got.tolist() == want and 0 < sum(want) < len(want)


@pytest.mark.parametrize("block", [4096, 40])
def test_a_large_group_of_near_copies_equals_brute_force(spark, monkeypatch, block):
    """Copies of one text with none to many scattered edits: their mutual similarities lie on both sides of 0.8."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = random.Random(3)
    base = [f"w{rng.getrandbits(40):x}" for _ in range(140)]
    rows = []
    for k in range(130):
        text = list(base)
        for _ in range(rng.randint(0, 9)):
            text[rng.randrange(len(text))] = f"e{rng.getrandbits(40):x}"
        rows.append((k, " ".join(text)))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t in rows)]
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    found = {r.doc_id: r.group_id for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert [found[k] for k in range(len(rows))] == label and 1 < len(set(label)) < len(rows)


def test_ids_that_repeat_or_are_missing_keep_one_row_of_each_group(spark):
    words = [[f"{c}{i}" for i in range(120)] for c in "abc"]
    one, two, three = (" ".join(w) for w in words)
    rows = [(1, one), (1, one + " tail"), (2, one), (1, two), (1, two), (None, three), (None, three + " tail")]
    kept = [tuple(r) for r in simhash.one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert Counter((i, t[0]) for i, t in kept) == {(1, "a"): 1, (1, "b"): 1, (None, "c"): 1}
