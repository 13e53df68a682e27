"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors are quantised to whole numbers. Blocks of vectors keep, for each
dimension, the greatest and least value; for a query these give an upper bound
of every score in the block. Blocks are taken by falling bound and scored
through their forward index (the rows themselves) until the bound falls below
the k-th score found. Queries and vectors meet in tiles of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a tile, queries of a tile, vectors of a block; least number of tiles along vectors.
TILE_ROWS, TILE_QUERIES, BLOCK, TILES = 8192, 2048, 64, 32
SCHEMA = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (array<double>) of the vectors without null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def matrix(lists: pa.ChunkedArray | pa.Array, width: int, scale: float) -> np.ndarray:
    """Rows of floor(scale * x), shorter ones filled with 0."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    flat, lengths = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.floor(scale * flat)
    return out


def order_alike(rows: np.ndarray, bits: int = 12) -> np.ndarray:
    """An order that puts vectors of alike direction together, for tighter blocks."""
    planes = np.random.default_rng(7).normal(size=(rows.shape[1], bits))
    return np.lexsort(((rows @ planes > 0).astype(np.int64) @ (1 << np.arange(bits)),))


class Blocks:
    """A tile of vectors cut into blocks, with bounds."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, block: int = BLOCK):
        order = order_alike(rows)
        self.ids, self.rows = ids[order], rows[order]
        self.edges = np.append(np.arange(0, len(ids), block), len(ids))
        self.high = np.maximum.reduceat(self.rows, self.edges[:-1], axis=0)
        self.low = np.minimum.reduceat(self.rows, self.edges[:-1], axis=0)
        self.scored = 0

    def best(self, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k best rows but the query's own; ties to smaller ids."""
        bound = self.high @ np.maximum(query, 0) + self.low @ np.minimum(query, 0)
        ids, scores = np.zeros(0, np.int64), np.zeros(0, self.rows.dtype)
        for b in np.argsort(-bound, kind="stable"):
            if len(ids) >= k and bound[b] < scores[-1]:
                break
            lo, hi = self.edges[b], self.edges[b + 1]
            self.scored += 1
            s, i = self.rows[lo:hi] @ query, self.ids[lo:hi]
            near = i != query_id
            if len(ids) >= k:
                near &= s >= scores[-1]
            if near.any():
                ids, scores = np.concatenate([ids, i[near]]), np.concatenate([scores, s[near]])
                order = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[order], scores[order]
        return ids, scores


def search(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best other rows.

    The score is the inner product of floor(scale * x). Ties go to the smaller
    vec_id. Vectors that are null, have null or non-finite components, or no
    vec_id take no part. A shorter vector counts as filled with zeros. Rows
    that repeat a vec_id are candidates (and queries) one by one, but never of
    a query with that id. No other columns are read; an empty table gives an
    empty result.

    Every vector meets every query in one tile; each tile sends on k rows a
    query, and these are ranked. Scores are exact: they stay below 2**53, or
    whole-number arithmetic is used; a score that a long can't hold is given
    as the nearest that it can.
    """
    rows = usable(vectors)
    n, queries, width = rows.agg(F.count(F.lit(1)), F.count_if(is_query), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    across, down = max(TILES, -(-n // TILE_ROWS)), max(1, -(-queries // TILE_QUERIES))
    tile = F.pmod(F.xxhash64("vec_id"), F.lit(across)).cast("int")
    batch = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(down)).cast("int")
    data = rows.select(tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("batch"), "vec_id", "x")
    asked = rows.where(is_query).select(F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("tile"), batch.alias("batch"), "vec_id", "x")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if left.num_rows and right.num_rows:
            data, asked = matrix(left["x"], width, scale), matrix(right["x"], width, scale)
            if np.abs(data).max(initial=0) * np.abs(asked).max(initial=0) * max(width, 1) >= 2.0**53:
                data, asked = (np.array([[int(v) for v in row] for row in m], object) for m in (data, asked))
                out = _plainly(left["vec_id"].to_numpy(), data, right["vec_id"].to_numpy(), asked, k)
            else:
                blocks = Blocks(left["vec_id"].to_numpy(), data)
                for q, row in zip(right["vec_id"].to_numpy(), asked, strict=True):
                    ids, scores = blocks.best(q, row, k)
                    out.append((np.full(len(ids), q), ids, scores))
        columns = [np.concatenate(x) if out else np.zeros(0) for x in (zip(*out, strict=True) if out else ((), (), ()))]
        return pa.table([pa.array(c.astype(np.int64)) for c in columns], ["query_id", "vec_id", "score"])

    found = data.groupBy("tile", "batch").cogroup(asked.groupBy("tile", "batch")).applyInArrow(run, SCHEMA)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _plainly(ids: np.ndarray, data: np.ndarray, query_ids: np.ndarray, asked: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Components too large for exact doubles: every row is scored, in Python's whole numbers."""
    out = []
    for q, row in zip(query_ids, asked, strict=True):
        scores = sorted((-(int(sum(a * b for a, b in zip(x, row, strict=True)))), int(i)) for i, x in zip(ids, data, strict=True) if i != q)[:k]
        out.append((np.full(len(scores), q), np.array([i for _, i in scores], np.int64), np.array([max(-(2**63), min(2**63 - 1, -s)) for s, _ in scores], np.int64)))
    return out
