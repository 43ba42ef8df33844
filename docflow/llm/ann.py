"""Nearest neighbours by a block matrix join.

Queries are dealt into groups and candidates into lanes; every (lane, group)
cell is one tile strip, held by a task as one query block in memory and a stream
of candidate blocks.  Products of int8 codes, multiplied as floats that hold them
and their sums exactly, give each inner product with an error bound (Cauchy-Schwarz on the quantisation residuals); only pairs whose
upper bound reaches the k-th best so far are computed again in double
precision, and per-query heaps are merged over lanes.  The bound is strict, so
the neighbours are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAPS = "query_id long, found array<struct<s:double,vec_id:long>>"
#: Candidates of one tile, and pairs that are computed again at once.
TILE, PAIRS = 2048, 1 << 16


def usable(vectors: DataFrame, kind: str = "array<double>") -> DataFrame:
    """Rows that take part: an id, and a vector that is neither null nor empty nor zero and has finite components only."""
    own = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast(kind))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return own.where(F.col("vec_id").isNotNull() & finite & F.exists("embedding", lambda x: x != 0.0))


class Block:
    """Vectors with their int8 codes: x = scale * code + residual."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        self.ids, self.x = ids, x
        top = np.abs(x).max(axis=1)
        self.scale = top / 127.0
        code = np.rint(x / top[:, None] * 127.0)
        exact = np.float32 if 127 * 127 * x.shape[1] < 1 << 24 else np.float64
        self.code = code.astype(np.int8).astype(exact)
        self.norm = np.sqrt((x * x).sum(axis=1))
        coded = code * self.scale[:, None]
        self.coded_norm = np.sqrt((coded * coded).sum(axis=1))
        self.residual = np.sqrt(((x - coded) ** 2).sum(axis=1))


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, summed in order of the components."""
    return np.add.reduce(np.ascontiguousarray((a * b).T), axis=0)


class Heaps:
    """The k best of each query so far, best first, ties to the smaller id."""

    def __init__(self, queries: Block, k: int):
        self.q, self.k = queries, k
        n = len(queries.ids)
        self.score = np.full((n, k), -np.inf)
        self.found = np.full((n, k), np.iinfo(np.int64).max)
        self.held = np.zeros(n, np.int64)

    def add(self, c: Block) -> None:
        q, k = self.q, self.k
        near = (q.code @ c.code.T).astype(np.float64)
        near *= q.scale[:, None]
        near *= c.scale
        slack = np.outer(q.residual, c.norm) + np.outer(q.coded_norm, c.residual)
        slack = slack * (1 + 1e-9) + 1e-12 * np.outer(q.norm, c.norm)
        own = q.ids[:, None] == c.ids
        near[own] = -np.inf
        least = np.where(self.held >= k, self.score[:, k - 1], -np.inf)
        fresh = self.held < k
        if fresh.any() and len(c.ids) > k:
            low = near[fresh] - slack[fresh]
            least[fresh] = np.partition(low, -k, axis=1)[:, -k]
        qi, ci = np.nonzero(~(near + slack < least[:, None]) & ~own)  # a bound that overflows keeps its pair
        for at in range(0, len(qi), PAIRS):
            self._merge(qi[at : at + PAIRS], c.ids[ci[at : at + PAIRS]], inner(q.x[qi[at : at + PAIRS]], c.x[ci[at : at + PAIRS]]))

    def _merge(self, qi: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        rows = np.unique(qi)
        old = np.repeat(rows, self.k)
        who = np.concatenate([old, qi])
        s = np.concatenate([self.score[rows].ravel(), score])
        v = np.concatenate([self.found[rows].ravel(), ids])
        order = np.lexsort((v, -s, who))
        who, s, v = who[order], s[order], v[order]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        best = rank < self.k
        self.score[rows], self.found[rows] = s[best].reshape(-1, self.k), v[best].reshape(-1, self.k)
        self.held[rows] = (self.score[rows] > -np.inf).sum(axis=1)

    def rows(self) -> pa.RecordBatch:
        counts = self.held
        mask = np.arange(self.k) < counts[:, None]
        pairs = pa.StructArray.from_arrays([pa.array(self.score[mask]), pa.array(self.found[mask])], ["s", "vec_id"])
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(self.q.ids), pa.ListArray.from_arrays(offsets, pairs)], ["query_id", "found"])


def _strips(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Cells come one after another, each its queries first."""
    cell, queries, heaps = None, [], None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        dim, lane, group, kind, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        flat = batch.column(5).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
        ends = np.cumsum(dim)
        key = np.stack([dim, lane, group, kind])
        cuts = np.concatenate([[0], np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1, [len(dim)]])
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = tuple(key[:3, a].tolist())
            if own != cell:
                if heaps is not None:
                    yield heaps.rows()
                cell, queries, heaps = own, [], None
            x = flat[ends[a] - dim[a] : ends[b - 1]].reshape(b - a, -1)
            if kind[a] == 0:
                queries.append((ids[a:b], x))
                continue
            if heaps is None and queries:
                heaps = Heaps(Block(np.concatenate([i for i, _ in queries]), np.concatenate([x for _, x in queries])), k)
            for at in range(0, (b - a) if heaps is not None else 0, TILE):
                heaps.add(Block(ids[a:b][at : at + TILE], x[at : at + TILE]))
    if heaps is not None:
        yield heaps.rows()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, query_block: int = 8192, lane_rows: int = 1 << 16) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` rows of ``vectors`` with the largest inner product with each query.

    Largest first, ties to the smaller vec_id; a query never finds its own vec_id.  Rows without an id and vectors
    that are null, empty, zero or hold null or non-finite components take no part, nor do vectors of another length
    than the query's.  A vec_id repeated among the queries is asked once, with its smallest vector; repeated
    candidates count each.  Fewer than ``k`` candidates: all of them; empty tables: no rows.
    """
    spark = vectors.sparkSession
    # single-precision components travel as they are; tasks widen them, which changes no value
    kinds = {x.schema["embedding"].dataType.simpleString() for x in (vectors, queries)}
    kind = "array<float>" if kinds == {"array<float>"} else "array<double>"
    all_rows = usable(vectors, kind)
    asked = usable(queries, kind).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    n_queries, n_rows = asked.count(), all_rows.count()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, math.ceil(n_queries / query_block))
    lanes = max(1, math.ceil(n_rows / lane_rows), math.ceil(tasks / groups))
    own = F.xxhash64("vec_id")
    cells = [
        asked.select(F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.pmod(own, F.lit(groups)).cast("int").alias("grp"), F.lit(0).alias("kind"), "vec_id", "embedding"),
        all_rows.select(F.pmod(own, F.lit(lanes)).cast("int").alias("lane"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("grp"), F.lit(1).alias("kind"), "vec_id", "embedding"),
    ]
    cell = ["dim", "lane", "grp"]
    both = cells[0].unionByName(cells[1]).select(F.size("embedding").alias("dim"), "lane", "grp", "kind", "vec_id", "embedding")
    dealt = both.repartition(max(tasks, lanes * groups), *cell).sortWithinPartitions(*cell, "kind", "vec_id")
    heaps = dealt.mapInArrow(lambda batches: _strips(batches, k), HEAPS)
    merged = heaps.groupBy("query_id").agg(F.flatten(F.collect_list("found")).alias("found"))
    best = F.slice(F.array_sort(F.transform("found", lambda x: F.struct((-x["s"]).alias("m"), x["vec_id"].alias("vec_id")))), 1, k)
    ranked = merged.select("query_id", F.posexplode(best).alias("at", "x"))
    return ranked.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.m")).alias("score"))
