"""Nearest neighbours by inner product: a block matrix join of int8 tiles with error bounds, and exact scores for what survives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vector_blocks import STRIP, Block, best_of, laid_out, merged, query_rows, tiles, vectors

#: Exact products computed at a time.
EXACT_ROWS = 32_768


def norms(v: np.ndarray) -> np.ndarray:
    """Norm of each row, also where squares would leave the range of doubles."""
    most = np.abs(v).max(axis=1)
    safe = np.where(most > 0, most, 1.0)
    return most * np.linalg.norm(v / safe[:, None], axis=1)


class Quantised:
    """Rows as int8 times a scale; ``size`` and ``error`` are the norms of the quantised row and of what it misses."""

    def __init__(self, v: np.ndarray):
        scale = np.abs(v).max(axis=1) / 127.0
        self.scale = np.where(scale > 0, scale, 1.0)
        whole = np.rint(v / self.scale[:, None])
        self.int8 = whole.astype(np.int8)
        near = whole * self.scale[:, None]
        self.size, self.error = norms(near), norms(v - near)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Row by row inner products in double precision, summed from the first component to the last, so that equal vectors get equal scores."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        out += q[:, d] * c[:, d]
    return out


def nearest_in_tile(query: Block, block: Block, k: int) -> Iterator[tuple]:
    """(query_id, key, ids, scores): each query's k nearest of one block."""
    with np.errstate(over="ignore", invalid="ignore"):
        yield from _nearest_in_tile(query, block, k)


def _nearest_in_tile(query: Block, block: Block, k: int) -> Iterator[tuple]:
    a, b = Quantised(query.v), Quantised(block.v)
    right = b.int8.astype(np.float32).T  # products of int8 numbers are whole and small: exact in float32 up to 1024 dimensions a slice
    for start in range(0, len(query.ids), STRIP):
        s = slice(start, start + STRIP)
        product = np.zeros((len(query.ids[s]), len(block.ids)))
        for d in range(0, right.shape[0], 1024):
            product += a.int8[s, d : d + 1024].astype(np.float32) @ right[d : d + 1024]
        product *= a.scale[s, None] * b.scale
        slack = a.size[s, None] * b.error + a.error[s, None] * (b.size + b.error)
        slack += 1e-9 * (a.size[s, None] + a.error[s, None]) * (b.size + b.error)
        own = query.ids[s, None] == block.ids
        low = np.where(own | np.isnan(product - slack), -np.inf, product - slack)  # bounds beyond the range of doubles prove nothing
        floor = np.partition(low, len(block.ids) - k, axis=1)[:, len(block.ids) - k] if k < len(block.ids) else np.full(len(low), -np.inf)
        row, column = np.nonzero(~(product + slack < floor[:, None]) & ~own)
        score = np.concatenate([exact(query.v[s][row[i : i + EXACT_ROWS]], block.v[column[i : i + EXACT_ROWS]]) for i in range(0, len(row), EXACT_ROWS)] or [np.empty(0)])
        score = np.where(np.isnan(score), -np.inf, score)
        ends = np.searchsorted(row, np.arange(len(low) + 1))
        for i in range(len(low)):
            part = slice(ends[i], ends[i + 1])
            ids = block.ids[column[part]]
            best = best_of(score[part], ids, k)
            if len(best):
                yield int(query.ids[start + i]), int(query.keys[start + i]), ids[best], score[part][best]


def nearest(table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product, ties to the smaller id, for each row whose id is divisible by ``every``.

    The bounds prove that what a tile drops isn't among the k, so the result is exact. Vectors that are null, empty or zero or
    hold a null or non-finite component take no part; vectors of another dimension aren't compared; with fewer candidates
    all are returned. Rows that share a query's id count as its own, however many; a query row that repeats answers once, and of an id
    with several vectors each is a query; a candidate that repeats is found as often as it occurs; one
    without an id is returned without one, after ties that have one. A score beyond the range of doubles is infinite; where
    infinities of both signs meet it is minus infinity. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = vectors(table, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    queries, candidates, slots = laid_out(rows, query_rows(rows, every))
    lists = tiles(queries, candidates, slots, k, lambda q, c: nearest_in_tile(q, c, k), "query_id long, key long, ids array<long>, scores array<double>")
    return merged(lists, k, "double")
