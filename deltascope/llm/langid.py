"""Language identification by word-first backoff.

A known word scores its log frequency in each language. An unseen word falls back
to its character n-grams, at each position the longest one known (from MAX_GRAM
letters down to one), averaged over the positions so that a word always weighs
one word. The score is the posterior of the best language.

The model is counted from a sample of SAMPLE_ROWS documents a language at most
(by a hash of the id) and holds every word and every n-gram of that sample, so
its size has the sample's bound, and it is broadcast.

Defined results: `und` with score 0 for null text, text without a letter, or an
untrained model; documents with null lang or text are never learned from; a null
id counts as the empty text for folds; ties go to the language that sorts first;
texts of any length are read whole, in pieces; equal rows give equal rows; an
empty table gives an empty result; other columns, whatever their names, are kept
by `identified` and left by `identify`.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_crc, table, written

#: Documents of each language that are counted, and the longest n-gram.
SAMPLE_ROWS, MAX_GRAM = 1000, 4
#: Unseen words whose scores a task remembers, and words that are looked up at once.
REMEMBERED, PIECE = 100_000, 50_000
RUN = re.compile(r"[^\W\d_]+")


def letter_runs(text: str | None) -> list[str]:
    return RUN.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def _count_words(batches):
    for batch in batches:
        counts = Counter()
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang = lang.as_py()
            counts.update((lang, w) for w in letter_runs(text.as_py()))
        rows = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def train(docs: DataFrame, *, learn: Column, text="text", lang="lang", doc_id="doc_id") -> dict:
    """The model: langs, and for words and for n-grams of each length the texts and the matrix of their log frequencies."""
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(F.col(lang).alias("lang")).count().collect()}  # as many as there are classes
    keep = F.lit(False)
    for name, n in counts.items():
        keep = F.when(F.col(lang) == name, F.pmod(F.xxhash64(doc_id), F.lit(1 << 30)) < int(min(1, SAMPLE_ROWS / n) * (1 << 30))).otherwise(keep)
    sample = rows.filter(keep).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    words = sample.mapInArrow(_count_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = written(words, "langid-words")
    langs = sorted(counts)
    model = {"langs": langs, "tables": []}
    sized = [words]
    for n in range(1, MAX_GRAM + 1):
        padded = F.concat(F.lit("^"), F.col("word"), F.lit("$"))
        places = F.when(F.length(padded) >= n, F.sequence(F.lit(1), F.length(padded) - n + 1)).otherwise(F.array().cast("array<int>"))
        found = words.select("lang", "n", padded.alias("p"), F.explode(places).alias("i")).select("lang", F.col("p").substr(F.col("i"), F.lit(n)).alias("word"), "n")
        sized.append(found)
    for found in sized if langs else []:
        by = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(langs)]
        held = found.groupBy("word").agg(*by).toArrow()  # the sample's vocabulary
        seen = np.stack([held[f"n{i}"].to_numpy() for i in range(len(langs))], 1).astype(float)
        model["tables"].append((held["word"].to_pylist(), np.log((seen + 0.5) / (seen.sum(0) + 0.5 * (len(seen) + 1)))))
    model["prior"] = np.log(np.array([counts[x] for x in langs], float) / max(1, sum(counts.values())))
    return model


class Scorer:
    """Scores texts by a model; rows of unseen words are remembered, up to a bound."""

    def __init__(self, model: dict):
        self.langs, self.prior = model["langs"], model["prior"]
        self.known, self.tables = (model["tables"] or [([], np.zeros((0, 0)))])[0], [({w: i for i, w in enumerate(words)}, rows) for words, rows in model["tables"][1:]]
        self.matrix = np.zeros((len(self.known[0]) + REMEMBERED + PIECE, len(self.langs)))
        self.matrix[: len(self.known[0])] = self.known[1]
        self.forget()

    def forget(self) -> None:
        self.index = {w: i for i, w in enumerate(self.known[0])}

    def unseen(self, word: str) -> np.ndarray:
        total, places, padded = np.zeros(len(self.langs)), 0, f"^{word}$"
        for i in range(len(padded) - MAX_GRAM + 1 if len(padded) > MAX_GRAM else 1):
            for n in range(min(MAX_GRAM, len(padded)), 0, -1):
                index, known = self.tables[n - 1]
                row = index.get(padded[i : i + n])
                if row is not None:
                    total += known[row]
                    places += 1
                    break
        return total / max(1, places)

    def row(self, word: str) -> int:
        at = self.index.get(word)
        if at is None:
            at = self.index[word] = len(self.index)
            self.matrix[at] = self.unseen(word)
        return at

    def __call__(self, text: str | None) -> tuple[str, float]:
        runs = letter_runs(text) if self.langs else []
        if not runs or not any(c.isalpha() for c in text):
            return "und", 0.0
        total = self.prior.copy()
        for k in range(0, len(runs), PIECE):
            piece = runs[k : k + PIECE]
            if len(self.index) > len(self.known[0]) + REMEMBERED:
                self.forget()
            rows = list(map(self.index.get, piece))
            if None in rows:
                rows = [self.row(w) if r is None else r for r, w in zip(rows, piece, strict=True)]
            total += self.matrix[rows].sum(0)
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.langs[best], float(odds[best] / odds.sum())


def identify(docs: DataFrame, model: dict, *, text="text", carry=("doc_id",)) -> DataFrame:
    """The columns of `carry`, and lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            made = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "lang_pred", "score"])

    rows = docs.select(*carry, F.col(text).alias("__text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def identified(docs: DataFrame, model: dict, *, text="text", min_score=0.5) -> DataFrame:
    """The documents that have a language, with all their columns: `und` and scores under `min_score` are rejected."""
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer(t.as_py()) for t in batch.column(at)]
            yield batch.filter(pa.array([lang != "und" and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id="doc_id") -> Column:
    return id_crc(doc_id) % 4 == 2


def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, learn=~held_out())
    found = identify(docs, model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
