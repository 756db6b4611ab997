"""The pipeline, stage by stage, against brute force on a small fixture; and the registration of its parts."""

import random
from collections import Counter

import __spark_entry__
import corpus_pipeline
from deltascope.llm import decontam, simhash
from tests.llm.test_documents import n_words, targets

WORDS = {
    "en": "the of and to in is that for it with as was on be by this are from at which".split() + ["w" + a + b for a in "abcdefghijkl" for b in "mnopqrstuv"],
    "fr": "le la les de des et en un une que qui dans pour sur par avec est sont pas plus".split() + ["m" + a + b for a in "éèàçùâêîôû" for b in "abcdefghij"],
}


def fixture():
    rng = random.Random(8)
    write = lambda lang, n: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    rows, items = [], [(i, write("en", 30)) for i in range(4)]
    for i in range(80):
        lang = "en" if i % 3 else "fr"
        rows.append((i, write(lang, 60 + i), lang, f"s{i % 4}"))
    rows += [(100, "123 456 !!!", "en", "s0"), (101, None, "en", "s1"), (102, "", None, None)]
    rows += [(110 + i, rows[i][1], rows[i][2], "s3") for i in range(5)]
    for i in range(5):  # near copies: one word of many changed
        text = rows[40 + i][1].split()
        text[10] = "changed"
        rows.append((120 + i, " ".join(text), rows[40 + i][2], None))
    rows += [(130 + i, write("en", 20) + " " + t.upper() + " " + write("en", 20), "en", "s2") for i, t in items]
    return rows, items


def jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (simhash.words(a), simhash.words(b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = fixture()
    frame = spark.createDataFrame([(*r, len(r[1] or ""), 7) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, size int")
    sf_dir = f"file://{tmp_path}"
    frame.write.parquet(f"{sf_dir}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), {r[0]: r for r in rows}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        if name == "language_id":
            kept = {i: r for i, r in kept.items() if r[1] and any(c.isalpha() for c in r[1])}
        elif name == "near_dedup":
            for i in sorted(kept):
                if any(j in kept and j < i and jaccard(kept[i][1], kept[j][1]) >= 0.8 for j in list(kept)):
                    del kept[i]
            assert not {110, 111, 112, 113, 114, 120, 121, 122, 123, 124} & set(kept)
        elif name == "decontaminate":
            kept = {i: r for i, r in kept.items() if not any(decontam.normal(t) in decontam.normal(r[1]) for _, t in items)}
        if name != "shard":
            assert out.columns == docs.columns
            out.write.parquet(f"{sf_dir}/{name}")
            docs = spark.read.parquet(f"{sf_dir}/{name}")
        if name in ("language_id", "near_dedup", "decontaminate"):
            assert sorted(r.doc_id for r in docs.collect()) == sorted(kept)
        if name == "mix":
            copies = Counter(r.doc_id for r in docs.collect())
            sizes = Counter()
            for r in kept.values():
                sizes[r[3]] += n_words(r[1])
            taken = Counter()
            for i, n in copies.items():
                taken[kept[i][3]] += n * n_words(kept[i][1])
            assert max(copies.values()) <= 2 and all(abs(taken[s] - t) <= 300 for s, t in targets(sizes).items())
    assert Counter(r.doc_id for r in out.collect()) == copies
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()) == copies


def test_everything_is_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
