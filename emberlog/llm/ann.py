"""Approximate nearest neighbours: stable projections, kd-trees and a chi-square stopping test (SRS).

Vectors are projected on ``dims`` Gaussian directions. For a vector at distance d, the squared projected
distance over d^2 follows a chi-square law with ``dims`` degrees of freedom, so once the next projected
neighbour lies beyond sqrt(quantile) times the k-th verified distance, a nearer vector has been missed with
probability at most 1 - ``confidence``; the search stops there.

The kd-tree has two storeys. The upper one is fitted on a bounded sample of projections, but every row is
filed in its leaf; the table of leaves is written to the shared folder. A query first searches its own leaf,
which gives a k-th distance, then visits just those other leaves whose boxes pass the same test. Inside a
leaf a kd-tree of small buckets yields projected neighbours in order of their boxes. A leaf with very many
visits is served by several tasks, each with a copy of the leaf.

Equal vectors are filed at most k + 1 times, with their smallest ids: as ties go to smaller ids, no other
copy can be in any answer. So a vector that a third of all rows share costs nothing.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, as
queries or candidates; vectors of another length are no candidates; a query's own id never answers it;
repeated rows of one id and vector count once; fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import lean, small_batches, stored

ANSWER = "query_id long, vec_id long, score double"


def chi_square(dims: int, p: float) -> float:
    """The p-quantile for an even number of degrees of freedom, whose distribution has a closed form."""
    def cdf(x):
        term = total = 1.0
        for j in range(1, dims // 2):
            term *= x / 2 / j
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def halved(points: np.ndarray, leaf: int) -> tuple[list[np.ndarray], np.ndarray]:
    """A kd-tree's leaves: row numbers of each, and where it was cut: boxes (leaves, 2, dims)."""
    rows, boxes = [], []

    def cut(own, box):
        if len(own) <= leaf:
            rows.append(own)
            boxes.append(box)
            return
        axis = int(np.ptp(points[own], axis=0).argmax())
        half = len(own) // 2
        order = own[np.argpartition(points[own, axis], half)]
        at = points[order[half], axis]
        left, right = box.copy(), box.copy()
        left[1, axis], right[0, axis] = at, at
        cut(order[:half], left)
        cut(order[half:], right)

    d = points.shape[1]
    cut(np.arange(len(points)), np.stack([np.full(d, -np.inf), np.full(d, np.inf)]))
    return rows, np.stack(boxes)


def box_distance(q: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Squared distances of one point to boxes, or of points (n, 1, dims) to each."""
    out = np.maximum(np.maximum(boxes[:, 0] - q, q - boxes[:, 1]), 0)
    return (out * out).sum(axis=-1)


def leaf_of(points: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """The first box that holds each point (boxes touch, and together fill space)."""
    out = np.empty(len(points), np.int64)
    for at in range(0, len(points), 512):
        part = points[at : at + 512, None, :]
        out[at : at + 512] = ((part >= boxes[:, 0]) & (part <= boxes[:, 1])).all(axis=2).argmax(axis=1)
    return out


class Leaf:
    """One leaf's vectors, with tight boxes around small buckets of their projections."""

    def __init__(self, ids, vectors, proj, bucket: int = 64):
        rows, _ = halved(proj, bucket)
        order = np.concatenate(rows)
        self.ids, self.vectors, self.proj = ids[order], vectors[order], proj[order]
        self.starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        self.boxes = np.stack([np.stack([proj[r].min(axis=0), proj[r].max(axis=0)]) for r in rows])

    def search(self, qid, q, qp, k: int, limit: float, known: float) -> list[tuple[int, float]]:
        """The k nearest verified (id, distance); ``known``: a k-th distance found elsewhere."""
        far = box_distance(qp, self.boxes)
        order = np.argsort(far, kind="stable")
        ids, dist, worst = np.zeros(0, np.int64), np.zeros(0), known
        step, at = 4, 0
        while at < len(order) and far[order[at]] <= limit * worst * worst:
            own = np.concatenate([np.arange(self.starts[b], self.starts[b + 1]) for b in order[at : at + step]])
            at, step = at + step, min(step * 2, 64)
            gap = self.proj[own] - qp
            own = own[((gap * gap).sum(axis=1) <= limit * worst * worst) & (self.ids[own] != qid)]
            gap = self.vectors[own].astype(np.float64) - q
            d = np.sqrt((gap * gap).sum(axis=1))
            ids, dist = np.concatenate([ids, self.ids[own]]), np.concatenate([dist, d])
            best = np.lexsort((ids, dist))[:k]
            ids, dist = ids[best], dist[best]
            if len(ids) == k:
                worst = min(worst, dist[-1])
        return list(zip(ids.tolist(), dist.tolist()))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def search(vectors: DataFrame, query: Column, k: int = 10, dims: int = 8, confidence: float = 0.97, leaf: int = 16384, fit_rows: int = 20_000, per_task: int = 4096, seed: int = 41, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row of ``vectors`` that ``query`` picks.

    ``query`` is an expression over the column ``vec_id``. ``fit_rows`` bounds the sample that places the
    upper tree's cuts; nothing else is sampled.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    same = Window.partitionBy("v").orderBy("vec_id")
    filed = rows.withColumn("copy", F.dense_rank().over(same)).filter(F.col("copy") <= k + 1).groupBy("v", "vec_id").agg(F.lit(1).alias("one"))
    both = filed.select("vec_id", "v", F.lit(True).alias("filed"), F.lit(False).alias("asks"))
    both = both.union(rows.filter(query).distinct().select("vec_id", "v", F.lit(False), F.lit(True)))
    out = None
    for r in rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy("n").collect():
        part = _one_length(both.filter(F.size("v") == r["n"]), rows.filter(F.size("v") == r["n"]), r["n"], r["rows"], k, dims, confidence, leaf, fit_rows, per_task, seed)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return out


def _one_length(both: DataFrame, rows: DataFrame, length: int, count: int, k, dims, confidence, leaf, fit_rows, per_task, seed) -> DataFrame:
    spark = both.sparkSession
    lines = np.random.default_rng(seed + length).normal(size=(length, dims))
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(fit_rows).select("v").toArrow().column("v").to_pylist()
    fitted = np.unique(np.array(sample, dtype=np.float64) @ lines, axis=0)
    _, boxes = halved(fitted, max(1, math.ceil(len(fitted) * leaf / max(count, leaf))))
    limit = chi_square(dims, confidence)
    shared = spark.sparkContext.broadcast((lines, boxes))

    def file(batches):
        lines, boxes = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, length)
            proj = v.astype(np.float64) @ lines
            cols = [pa.array(leaf_of(proj, boxes)), b.column(0), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in proj], pa.binary()), b.column(2), b.column(3)]
            yield pa.RecordBatch.from_arrays(cols, ["leaf", "vec_id", "v", "p", "filed", "asks"])

    kind = {"float": "<f4", "double": "<f8"}.get(both.schema["v"].dataType.elementType.simpleString())
    if kind is None:
        both, kind = both.withColumn("v", F.col("v").cast("array<double>")), "<f8"
    placed = stored(both.mapInArrow(lean(file), "leaf long, vec_id long, v binary, p binary, filed boolean, asks boolean"), "leaves")
    index, asks = placed.filter("filed").drop("filed", "asks"), placed.filter("asks").drop("filed", "asks")

    def matrix(col, dtype, width):
        return np.frombuffer(b"".join(col), dtype=dtype).reshape(-1, width)

    def answer(left, right):
        import pandas as pd

        out = []
        if len(left) and len(right):
            tree = Leaf(left["vec_id"].to_numpy(), matrix(left["v"], kind, length), matrix(left["p"], "<f8", dims))
            for qid, q, qp, known in zip(right["q_vec_id"], matrix(right["q_v"], kind, length).astype(np.float64), matrix(right["q_p"], "<f8", dims), right["q_known"]):
                out += [(qid, i, d) for i, d in tree.search(qid, q, qp, k, limit, known)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    def visited(visits: DataFrame) -> DataFrame:
        """Answers of ``visits`` (leaf, vec_id, v, p, known), each leaf in as many copies as its visits need."""
        copies = visits.groupBy("leaf").agg(F.ceil(F.count("*") / per_task).cast("int").alias("copies"))
        dealt = visits.join(copies, "leaf").withColumn("copy", F.pmod(F.xxhash64("vec_id"), F.col("copies")).cast("int")).drop("copies")
        filed = index.join(copies, "leaf").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))).drop("copies")
        dealt = dealt.select(*[F.col(c).alias(f"q_{c}") for c in dealt.columns])
        return filed.groupBy("leaf", "copy").cogroup(dealt.groupBy("q_leaf", "q_copy")).applyInPandas(answer, ANSWER)

    home = stored(visited(asks.withColumn("known", F.lit(float("inf")))), "home")
    if len(boxes) > 1:
        reach = home.groupBy("query_id").agg(F.count("*").alias("n"), F.max("score").alias("far"))
        known = F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf")))
        rest = asks.join(reach.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("known", F.coalesce(known, F.lit(float("inf")))).drop("n", "far")

        def route(batches):
            _, boxes = shared.value
            for b in batches:
                if not b.num_rows:
                    continue
                points, near = matrix(b.column(3).to_pylist(), "<f8", dims), b.column(4).to_numpy()
                hits = [np.flatnonzero((box_distance(p, boxes) <= limit * w * w) & (np.arange(len(boxes)) != own)) for p, w, own in zip(points, near, b.column(0).to_pylist())]
                at = pa.array(np.repeat(np.arange(b.num_rows), [len(h) for h in hits]))
                cols = [pa.array(np.concatenate(hits).astype(np.int64)), *(b.column(c).take(at) for c in (1, 2, 3, 4))]
                yield pa.RecordBatch.from_arrays(cols, ["leaf", "vec_id", "v", "p", "known"])

        visits = stored(rest.select("leaf", "vec_id", "v", "p", "known").mapInArrow(lean(route), "leaf long, vec_id long, v binary, p binary, known double"), "visits")
        home = home.union(visited(visits))
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return home.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
