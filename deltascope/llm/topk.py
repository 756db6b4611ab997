"""Exact top-k inner products by dual-tree search over cover trees.

Rows near the same pivot form a cell, and cells are split into blocks of bounded
size. A first pass builds one cover tree for each block of queries and of data
and stores it with the block. Searches walk two trees together: a pair of nodes
is pruned when the greatest inner product that their centres and covering radii
allow is below the worst kth score of the queries in the group. Each query block
is searched in the data block whose centre suits it best; the kth scores found
there prune whole pairs of blocks before anything is moved, and the rest is
searched tree by tree. The blocks' top lists (k rows a query and block) are
merged at the end.

A node's children are a net of up to FANOUT centres taken farthest first, so they
lie further apart than the radius they cover; trees end in leaves of LEAF rows.
Vectors that are spread evenly over many dimensions leave little to prune; the
result is the same.

Defined results: components are floor(64 * x); vectors that are null or hold a
null or non-finite component take no part, nor do rows without an id; vectors of
different lengths aren't compared; a query never meets rows with its own id;
repeated rows count as often as they occur; ties go to the smaller id; with
fewer than k candidates all are returned; scores beyond 64 bits stop at them; an
empty table gives an empty result; other columns, whatever their names, are left.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table, written

K, DATA_BLOCK, QUERY_BLOCK, LEAF, FANOUT = 20, 16384, 4096, 256, 16
#: Rows that name the cells, at most; the ones with the smallest hashes.
MAX_PIVOTS = 256
#: Data blocks that share a task when pairs of blocks are bounded.
BLOCKS_A_SALT = 64
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in tree order, and the nodes: first row (the centre) and end, first child and number of children, the radius as the bits of a double and rounded up (-1: too large)."""
    order, nodes = np.arange(len(x)), [[0, len(x), 0, 0, 0, 0]]
    for node in nodes:
        a, b = node[:2]
        rows = order[a:b]
        nearest = np.sqrt(((x[rows] - x[rows[0]]) ** 2).sum(1))
        radius = float(nearest.max())
        node[4:] = int(np.float64(radius).view(np.int64)), math.ceil(radius) if radius < 2**62 else -1
        if b - a <= LEAF or radius == 0:
            continue
        owner, centers = np.zeros(len(rows), np.int64), [0]
        while len(centers) < FANOUT and nearest.max() > radius / 2:
            far = int(nearest.argmax())
            d = np.sqrt(((x[rows] - x[rows[far]]) ** 2).sum(1))
            owner[d < nearest] = len(centers)
            nearest = np.minimum(nearest, d)
            centers.append(far)
        behind = np.ones(len(rows), bool)
        behind[centers] = False
        order[a:b] = rows[np.lexsort((behind, owner))]
        node[2], node[3] = len(nodes), len(centers)
        ends = a + np.cumsum(np.bincount(owner, minlength=len(centers)))
        nodes += [[int(s), int(e), 0, 0, 0, 0] for s, e in zip([a, *ends[:-1]], ends, strict=True)]
    return order, np.array(nodes, np.int64)


class Tree:
    """A block in tree order: integer vectors v, ids, and nodes."""

    def __init__(self, v: np.ndarray, ids: np.ndarray, nodes: np.ndarray):
        self.v, self.x, self.ids, self.nodes = v, v.astype(np.float64), ids, nodes
        self.radius = nodes[:, 4].copy().view(np.float64)
        self.center = self.x[nodes[:, 0]]
        self.norm = np.sqrt((self.center**2).sum(1))
        self.reach = float(np.abs(self.x).max()) if self.x.size else 0.0


def bounds(q: Tree, i: np.ndarray, d: Tree, j: np.ndarray) -> np.ndarray:
    """For nodes i of q and j of d: no inner product of their points is greater."""
    qn, qr, dn, dr = q.norm[i][:, None], q.radius[i][:, None], d.norm[j][None, :], d.radius[j][None, :]
    most = q.center[i] @ d.center[j].T + qn * dr + dn * qr + qr * dr
    return np.maximum(most + 1e-9 * (np.abs(most) + (qn + qr) * (dn + dr)) + 1e-6, float(LEAST))


def search(q: Tree, d: Tree, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    """Each query's k best rows of d (all if fewer): places of queries, ids, scores; the worst kth score (LEAST if a query has fewer); and how many products were made."""
    exact = max(1, q.v.shape[1]) * q.reach * d.reach < 2.0**53
    if not exact:  # sums beyond a double: Python's integers
        qv, dv = q.v.astype(object), d.v.astype(object)
    top, ids = np.full((len(q.v), k), LEAST, np.int64), np.full((len(q.v), k), MOST, np.int64)
    full, least = np.zeros(len(q.v), bool), np.full(len(q.v), LEAST, np.int64)
    made = 1

    def leaves(qa: int, qb: int, da: int, db: int) -> None:
        if exact:
            scores = (q.x[qa:qb] @ d.x[da:db].T).astype(np.int64)
        else:
            scores = np.clip(qv[qa:qb] @ dv[da:db].T, int(LEAST), int(MOST)).astype(np.int64)
        fits = (scores >= least[qa:qb, None]) & (q.ids[qa:qb, None] != d.ids[None, da:db])
        rows = np.nonzero(fits.any(1))[0]
        if not len(rows):
            return
        at = qa + rows
        # what doesn't fit stands like an empty place
        s = np.concatenate([top[at], np.where(fits[rows], scores[rows], LEAST)], axis=1)
        i = np.concatenate([ids[at], np.where(fits[rows], d.ids[None, da:db], MOST)], axis=1)
        best = np.lexsort((i, ~s), axis=1)[:, :k]
        top[at], ids[at] = np.take_along_axis(s, best, 1), np.take_along_axis(i, best, 1)
        full[at] = ids[at, -1] != MOST
        least[at] = np.where(full[at], top[at, -1], LEAST)

    stack = [(float(bounds(q, np.array([0]), d, np.array([0]))[0, 0]), 0, 0)]
    while stack:
        most, i, j = stack.pop()
        (qa, qb, qc, qn), (da, db, dc, dn) = q.nodes[i, :4].tolist(), d.nodes[j, :4].tolist()
        if most < int(least[qa:qb].min()):
            continue
        if not qn and not dn:
            leaves(qa, qb, da, db)
            made += (qb - qa) * (db - da)
            continue
        own, other = np.arange(qc, qc + qn) if qn else np.array([i]), np.arange(dc, dc + dn) if dn else np.array([j])
        most = bounds(q, own, d, other)
        made += most.size
        for at in np.argsort(most, axis=None, kind="stable").tolist():  # the best pair is on top of the stack
            stack.append((float(most.flat[at]), int(own[at // len(other)]), int(other[at % len(other)])))
    at, col = np.nonzero(ids != MOST)
    return at, ids[at, col], top[at, col], int(least.min()), made


def _matrix(column, dim: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _plant(key, rows):
    """A block's rows with their places in its tree, and at place -1 the tree itself."""
    dim = key[0].as_py()
    v = _matrix(rows["v"], dim)
    order, nodes = build(v.astype(np.float64))
    ids = np.append(rows["vec_id"].to_numpy()[order], 0)
    vectors = pa.ListArray.from_arrays(np.append(np.arange(0, v.size + 1, dim) if dim else np.zeros(len(v) + 1, np.int64), v.size + nodes.size).astype(np.int32), np.concatenate([v[order].ravel(), nodes.ravel()]))
    fixed = {name: pa.repeat(k, len(ids)) for name, k in zip(("dim", "asks", "cell", "sub"), key, strict=True)}
    return pa.table(fixed | {"vec_id": ids, "v": vectors, "place": np.append(np.arange(len(order)), -1)})


def _tree(rows: pa.Table, dim: int) -> Tree:
    rows = rows.sort_by("place")
    nodes = rows["v"][0].values.to_numpy().reshape(-1, 6)
    return Tree(_matrix(rows["v"].slice(1), dim), rows["vec_id"].slice(1).to_numpy(), nodes)


def _in_cells(rows: DataFrame, data_cells: int, query_cells: int, every: int) -> DataFrame:
    """rows with `cell`, the nearest pivot, once as data and once more if it is a query (`asks`)."""
    pivots = rows.orderBy(F.xxhash64("vec_id", "place"), "place").limit(MAX_PIVOTS).collect()
    near = {}
    for r in pivots:
        near.setdefault(r.dim, []).append(r.v)
    near = {dim: np.array(v, np.float64).reshape(len(v), dim) for dim, v in near.items()}
    shared = rows.sparkSession.sparkContext.broadcast(near)

    def run(batches):
        for batch in batches:
            dims, ids = batch["dim"].to_numpy(), batch["vec_id"].to_numpy()
            cells = np.zeros((2, len(dims)), np.int32)
            for dim in np.unique(dims).tolist():
                if dim in shared.value and dim:
                    here = np.nonzero(dims == dim)[0]
                    x = _matrix(pa.chunked_array([batch["v"].take(pa.array(here))]), dim).astype(np.float64)
                    for k, most in enumerate((data_cells, query_cells)):
                        p = shared.value[dim][:most]
                        cells[k, here] = ((p**2).sum(1)[None, :] - 2 * (x @ p.T)).argmin(1)
            for k, chosen in enumerate((np.ones(len(ids), bool), ids % every == 0)):
                flags = [pa.array(np.full(len(ids), k == 1)), pa.array(cells[k])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *flags], [*batch.schema.names, "asks", "cell"]).filter(pa.array(chosen))

    return rows.mapInArrow(run, "vec_id long, dim int, v array<long>, place long, asks boolean, cell int")


def planted(vectors: DataFrame, every: int, vec_id: str, embedding: str, data_block: int, query_block: int) -> DataFrame:
    """dim, asks, cell, sub, vec_id, v, place: the blocks, each with its tree."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    rows = rows.select("vec_id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * 64).cast("long")).alias("v"), F.monotonically_increasing_id().alias("place"))
    rows = written(rows, "topk-vectors")
    n, asked = rows.agg(F.count("*"), F.count_if(F.col("vec_id") % every == 0)).first()
    cells = [max(1, min(MAX_PIVOTS, -(-m // size))) for m, size in ((n, data_block), (asked, query_block))]
    rows = written(_in_cells(rows, *cells, every), "topk-cells")
    cell = ["dim", "asks", "cell"]
    sizes = rows.groupBy(*cell).count().orderBy(F.desc("count"), *cell).limit(2 * MAX_PIVOTS).collect()
    most = lambda asks: query_block if asks else data_block
    known = rows.sparkSession.createDataFrame([(r.dim, r.asks, r.cell, -(-r["count"] // most(r.asks))) for r in sizes], "dim int, asks boolean, cell int, subs long")
    # cells beyond the largest have no more rows than the last of these
    least = sizes[-1]["count"] if sizes else 1
    other = F.when(F.col("asks"), -(-least // query_block)).otherwise(-(-least // data_block))
    rows = rows.join(F.broadcast(known), cell, "left").withColumn("sub", F.pmod(F.xxhash64("place"), F.coalesce("subs", other)))
    keys = ["dim", "asks", "cell", "sub"]
    blocks = rows.select(*keys, "vec_id", "v").groupBy(*keys).applyInArrow(_plant, "dim int, asks boolean, cell int, sub long, vec_id long, v array<long>, place long")
    return written(blocks, "topk-blocks")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """dim, q, d (cell and sub of a query block and a data block) and the greatest product that their centres and radii allow."""
    name = F.struct("cell", "sub")
    heads = blocks.filter("place <= 0").groupBy("dim", "asks", name.alias("block")).agg(
        F.max(F.when(F.col("place") == 0, F.col("v"))).alias("center"), F.max(F.when(F.col("place") == -1, F.element_at("v", 6))).alias("radius")
    )
    heads = written(heads.withColumn("radius", F.when(F.col("radius") < 0, F.lit(float("inf"))).otherwise(F.col("radius").cast("double"))), "topk-heads")
    salts = max(1, -(-heads.filter("NOT asks").count() // BLOCKS_A_SALT))
    q = heads.filter("asks").select("dim", F.col("block").alias("q"), F.col("center").alias("qc"), F.col("radius").alias("qr"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    d = heads.filter("NOT asks").select("dim", F.col("block").alias("d"), F.col("center").alias("dc"), F.col("radius").alias("dr"), F.pmod(F.hash("block"), F.lit(salts)).alias("salt"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    qn, dn = F.sqrt(dot("qc", "qc")), F.sqrt(dot("dc", "dc"))
    most = F.col("most") + F.lit(1e-9) * (F.abs("most") + (F.col("qn") + F.col("qr")) * (F.col("dn") + F.col("dr"))) + F.lit(1e-6)
    met = q.join(d, ["dim", "salt"]).withColumns({"product": dot("qc", "dc"), "qn": qn, "dn": dn})
    met = met.withColumn("most", F.col("product") + F.col("qn") * F.col("dr") + F.col("dn") * F.col("qr") + F.col("qr") * F.col("dr"))
    return met.select("dim", "q", "d", "product", most.alias("most"))


def _searched(blocks: DataFrame, pairs: DataFrame, k: int, products=None) -> DataFrame:
    """dim, q, worst, query_id, vec_id, score: the top lists of the pairs (dim, q, d) of blocks, and the worst kth score of each pair."""
    side = lambda asks, name: blocks.filter(F.col("asks") == asks).select(F.col("dim").alias("dim"), F.struct("cell", "sub").alias(name), *[F.col(c).alias(c) for c in ("vec_id", "v", "place")])
    keys = ["dim", "q", "d"]
    asked, given = (side(asks, name).join(pairs.select(*keys), ["dim", name]).select(*[F.col(c).alias(c) for c in (*keys, "vec_id", "v", "place")]) for asks, name in ((True, "q"), (False, "d")))

    def run(key, asked, given):
        dim = key[0].as_py()
        q, d = _tree(asked, dim), _tree(given, dim)
        at, found, scores, worst, made = search(q, d, k)
        if products is not None:
            products.add(made)
        block = {"dim": key[0], "cell": key[1]["cell"], "sub": key[1]["sub"], "worst": pa.scalar(worst)}
        return pa.table({name: pa.repeat(v, len(at)) for name, v in block.items()} | {"query_id": q.ids[at], "vec_id": found, "score": scores})

    found = asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInArrow(run, "dim int, cell int, sub long, worst long, query_id long, vec_id long, score long")
    return found.select("dim", F.struct("cell", "sub").alias("q"), "worst", "query_id", "vec_id", "score")


def top_k(vectors: DataFrame, *, every=20, k=K, vec_id="vec_id", embedding="embedding", data_block=DATA_BLOCK, query_block=QUERY_BLOCK, products=None) -> DataFrame:
    """query_id, rank, vec_id, score for the queries, the rows whose id is divisible by `every`. `products`: an accumulator that counts the inner products made."""
    blocks = planted(vectors, every, vec_id, embedding, data_block, query_block)
    pairs = written(block_pairs(blocks), "topk-pairs")
    first = pairs.groupBy("dim", "q").agg(F.max_by("d", F.struct("product", "d")).alias("d"))
    found = written(_searched(blocks, first, k, products), "topk-first")
    # a query block with a query of fewer than k rows so far prunes nothing
    rest = pairs.join(first.withColumn("done", F.lit(True)), ["dim", "q", "d"], "left").filter("done IS NULL").join(found.groupBy("dim", "q").agg(F.min("worst").alias("worst")), ["dim", "q"], "left")
    lone = F.coalesce("worst", F.lit(int(LEAST)))
    rest = rest.filter((lone == int(LEAST)) | (F.col("most") >= lone.cast("double"))).select("dim", "q", "d")
    found = found.unionByName(_searched(blocks, written(rest, "topk-rest"), k, products))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op10_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
