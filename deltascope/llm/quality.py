"""A quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a small network by the
non-negative unbiased risk: prior * E_p[loss(f, 1)] + max(0, E_u[loss(f, 0)] -
prior * E_p[loss(f, 0)]). The class prior is estimated from the labelled rows.
Inputs are statistics of the text alone. Training uses at most SAMPLE_ROWS
positives and SAMPLE_ROWS unlabelled documents, chosen by a hash of the id.

Defined results: null text scores as the empty text; without positives or
unlabelled rows every score is the prior; a document labelled more than once is
positive if any label is; a null id counts as the empty text for folds; texts of
any length are read whole; equal texts have equal scores, so repeated rows do too;
a score of exactly 0.3 is predicted 1; an empty table gives an empty result; other
columns, whatever their names, are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import id_crc, table

SAMPLE_ROWS, HIDDEN, STEPS = 6000, 16, 600
_SYMBOLS = b"!|*$&%#@^~<>{}[]=_\\/+"


def features(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = max(1, len(raw))
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256).astype(float)
    share = seen / n
    upper, lower, digits, high = share[65:91].sum(), share[97:123].sum(), share[48:58].sum(), share[128:].sum()
    symbols = share[list(_SYMBOLS)]
    positive = share[share > 0]
    found = raw.split()
    words = max(1, len(found))
    distinct = set(found)
    lines = [x for x in raw.split(b"\n") if x]
    caps = sum(map(bytes.isupper, found)) / words
    odd = sum(1 for w in found if w[-1] in _SYMBOLS) / words
    return [
        np.log1p(len(raw)), np.log1p(len(found)), sum(map(len, found)) / words / 10, len(distinct) / words, np.log1p(len(distinct)),
        upper, lower, digits, high, caps, odd, upper / max(1e-9, upper + lower), symbols.sum(), symbols[0], symbols[1], symbols[2:].sum(),
        share[46], share[44], share[32], share[10], len(set(lines)) / max(1, len(lines)), len(lines) / words, -(positive * np.log(positive)).sum() if n else 0.0,
        max(map(len, found), default=0) / 50,
    ]


def with_features(docs: DataFrame, carry: list[str], text="text") -> DataFrame:
    def run(batches):
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "x"])

    rows = docs.select(*carry, F.col(text).alias("__text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("x", T.ArrayType(T.DoubleType()))]))


def _forward(net: dict, x: np.ndarray):
    z = np.clip((x - net["mean"]) / net["std"], -6, 6)
    h = np.tanh(z @ net["w1"] + net["b1"])
    return z, h, h @ net["w2"] + net["b2"]


def score(net: dict, x: np.ndarray) -> np.ndarray:
    if "w1" not in net:
        return np.full(len(x), net["prior"])
    return 1 / (1 + np.exp(-np.clip(_forward(net, x)[2], -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 11) -> dict:
    """Minimises the non-negative risk with logistic loss by Adam; where the negative part falls below zero its gradient is reversed."""
    net = {"prior": prior}
    if not len(positive) or not len(unlabelled):
        return net
    rng = np.random.default_rng(seed)
    x = np.concatenate([positive, unlabelled])
    net |= {"mean": x.mean(0), "std": x.std(0) + 1e-6, "w1": rng.normal(0, 0.3, (x.shape[1], HIDDEN)), "b1": np.zeros(HIDDEN), "w2": rng.normal(0, 0.3, HIDDEN), "b2": np.float64(np.log(prior / (1 - prior)))}
    names, n_p = ("w1", "b1", "w2", "b2"), len(positive)
    m, v = {k: 0.0 for k in names}, {k: 0.0 for k in names}
    for step in range(1, STEPS + 1):
        z, h, f = _forward(net, x)
        s = 1 / (1 + np.exp(-np.clip(f, -30, 30)))
        as_negative = np.logaddexp(0, f)
        negative_risk = as_negative[n_p:].mean() - prior * as_negative[:n_p].mean()
        sign = 1.0 if negative_risk >= 0 else -1.0
        g = np.empty(len(x))
        g[:n_p] = (prior * (s[:n_p] - 1) * (sign > 0) - sign * prior * s[:n_p]) / n_p
        g[n_p:] = sign * s[n_p:] / (len(x) - n_p)
        back = np.outer(g, net["w2"]) * (1 - h * h)
        grads = {"w2": h.T @ g + 1e-4 * net["w2"], "b2": g.sum(), "w1": z.T @ back + 1e-4 * net["w1"], "b1": back.sum(0)}
        for k in names:
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            v[k] = 0.999 * v[k] + 0.001 * grads[k] ** 2
            net[k] = net[k] - 0.01 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def _sampled(rows: DataFrame, n: int) -> DataFrame:
    return rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("quality")), F.lit(1 << 30)) < int(min(1, SAMPLE_ROWS / max(1, n)) * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """docs(doc_id, text), labels(doc_id, quality), both of the training folds only."""
    marks = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = {bool(r[0]): r[1] for r in marks.groupBy(F.col("quality") > 0).count().collect()}
    prior = min(0.99, max(0.01, (known.get(True, 0) + 1) / (sum(known.values()) + 2)))
    trusted = _sampled(marks.filter("quality > 0"), known.get(True, 0)).select("doc_id")
    every = docs.count()
    # unlabelled text stands for all web text: a random share of it, whatever labels there may be
    take = lambda rows: np.array([r.x for r in with_features(rows, ["doc_id"]).collect()], float)
    positive = take(docs.join(F.broadcast(trusted), "doc_id", "left_semi"))  # SAMPLE_ROWS ids
    unlabelled = take(_sampled(docs, every))
    return fit(positive, unlabelled, prior)


def classify(docs: DataFrame, net: dict, carry: list[str], text="text") -> DataFrame:
    """The columns of `carry`, and score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for batch in batches:
            made = [features(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            scores = score(shared.value, np.array(made, float)) if made else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*batch.schema.names[:-1], "score"])

    rows = docs.select(*carry, F.col(text).alias("__text"))
    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType())]))


def op4_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = id_crc("doc_id") % 5 == 0
    net = train(docs.filter(~held_out).select("doc_id", "text"), labels.filter(~held_out))
    found = classify(docs, net, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
