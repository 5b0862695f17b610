"""Exact top-k search by a three-phase uniform threshold over slices of the dimensions.

A slice of the dimensions has a list of partial scores for each query. Phase 1 gathers the best entries of every list; the sums of
what was seen, with the lists' minima for what wasn't, give a score that the k-th best reaches at least. That cutoff, shared
evenly among the lists, is joined to the queries. Phase 2 collects every entry that reaches its list's share: a row below the share in all lists
can't reach the cutoff. Phase 3 drops rows whose upper bound is too low and resolves the scores of the rest exactly.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .vector_blocks import STRIP, Block, best_of, laid_out, merged, packed, query_rows, tiles, vectors

SLICES = 4
NONE = -(2**62)


def whole(v: np.ndarray, factor: float) -> np.ndarray:
    return np.floor(factor * v).astype(np.int64)


def partials(q: np.ndarray, c: np.ndarray) -> Iterator[np.ndarray]:
    """Partial scores of each slice, in a floating type that holds them exactly, or else in int64."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
    for left, right in zip(np.array_split(q, SLICES, axis=1), np.array_split(c, SLICES, axis=1)):
        yield left.astype(kind) @ right.T.astype(kind)


def top_lists(query: Block, block: Block, k: int, factor: float) -> Iterator[tuple]:
    """Phase 1, (query_id, key, slice, least, ids, parts): the best k entries of each list, and its minimum."""
    q, c = whole(query.v, factor), whole(block.v, factor)
    for start in range(0, len(q), STRIP):
        own = query.ids[start : start + STRIP, None] == block.ids
        for number, part in enumerate(partials(q[start : start + STRIP], c)):
            least = part.min(axis=1)
            part = np.where(own, -np.inf, part)
            top = np.argpartition(part, -k, axis=1)[:, -k:] if k < part.shape[1] else np.tile(np.arange(part.shape[1]), (len(part), 1))
            for i, columns in enumerate(top):
                columns = columns[~own[i, columns]]
                yield int(query.ids[start + i]), int(query.keys[start + i]), number, int(least[i]), block.ids[columns], part[i, columns].astype(np.int64)


def cutoffs(lists: DataFrame, k: int) -> DataFrame:
    """(key, extra): the score that the k-th best reaches at least and each list's minimum. One query at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, least, seen, out = None, [], {}, []

        def close() -> None:
            if now is None:
                return
            # an id that several rows share counts once, with its smallest entry
            low = sorted((sum(parts.get(s, least[s]) for s in range(SLICES)) for parts in seen.values()), reverse=True)
            out.append((now, [low[k - 1] if len(low) >= k else NONE, *least]))

        for batch in batches:
            for key, number, lowest, ids, parts in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    close()
                    now, least, seen = key, [0] * SLICES, defaultdict(dict)
                    fresh = [True] * SLICES
                least[number] = lowest if fresh[number] else min(least[number], lowest)
                fresh[number] = False
                for i, p in zip(ids, parts):
                    seen[i][number] = min(p, seen[i].get(number, p))
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], ["cut_key", "extra"])
                out.clear()
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.list_(pa.int64()))], ["cut_key", "extra"])

    dealt = lists.select("key", "slice", "least", "ids", "parts").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "cut_key long, extra array<long>")


def resolved(query: Block, block: Block, k: int, factor: float) -> Iterator[tuple]:
    """Phases 2 and 3, (query_id, key, ids, scores): exact scores of the rows that the cutoff leaves in one block."""
    q, c = whole(query.v, factor), whole(block.v, factor)
    for start in range(0, len(q), STRIP):
        extra = query.extra[start : start + STRIP]
        cutoff, least = extra[:, :1].astype(np.float64), extra[:, 1:].astype(np.float64)
        share = (cutoff - least.sum(axis=1, keepdims=True)) / SLICES  # of the cutoff, above each list's minimum
        collected, bound = False, 0.0
        for number, part in enumerate(partials(q[start : start + STRIP], c)):
            edge = least[:, number : number + 1] + share
            reaches = part >= edge - 1e-6
            collected |= reaches
            bound = bound + np.where(reaches, part, edge)  # of a missing entry no more is known than that it is below the share
        collected &= (bound >= cutoff - 1e-3) & (query.ids[start : start + STRIP, None] != block.ids)
        row, column = np.nonzero(collected)
        ends = np.searchsorted(row, np.arange(len(extra) + 1))
        for i in range(len(extra)):
            at = column[ends[i] : ends[i + 1]]
            score = c[at] @ q[start + i]
            at, score = at[score >= extra[i, 0]], score[score >= extra[i, 0]]
            best = best_of(score, block.ids[at], k)
            if len(best):
                yield int(query.ids[start + i]), int(query.keys[start + i]), block.ids[at][best], score[best]


def exact(v: np.ndarray, factor: float) -> np.ndarray:
    """floor(factor * component) as Python integers, also where the product is beyond the range of doubles."""
    return np.array([math.floor(y) if math.isfinite(y := factor * x) else math.floor(Fraction(x) * Fraction(factor)) for x in v.ravel().tolist()], object).reshape(v.shape)


def wide_lists(query: Block, block: Block, k: int, factor: float) -> Iterator[tuple]:
    """(query_id, key, ids, scores as text): the best k of one block where scores may not fit into 64 bits.

    Doubles with a bound of their error leave few rows that can be among them; these are computed in whole numbers of any size.
    """
    q, c = exact(query.v, factor), exact(block.v, factor)
    with np.errstate(all="ignore"):
        qf, cf = np.floor(factor * query.v), np.floor(factor * block.v)
        for start in range(0, len(qf), STRIP):
            rows = qf[start : start + STRIP]
            score = rows @ cf.T
            slack = (np.abs(rows) @ np.abs(cf).T) * ((qf.shape[1] + 8) * 2.0**-52)
            low, high = score - slack, score + slack
            unsure = ~(np.isfinite(low) & np.isfinite(high))
            low[unsure], high[unsure] = -np.inf, np.inf
            own = query.ids[start : start + STRIP, None] == block.ids
            low[own] = high[own] = -np.inf
            edge = np.partition(low, -k, axis=1)[:, -k] if k < low.shape[1] else np.full(len(low), -np.inf)
            for i in range(len(rows)):
                at = np.flatnonzero((high[i] >= edge[i]) & ~own[i])
                best = sorted((-sum(a * b for a, b in zip(q[start + i], c[j])), block.ids[j]) for j in at)[:k]
                if best:
                    yield int(query.ids[start + i]), int(query.keys[start + i]), [int(j) for _, j in best], [str(-s) for s, _ in best]


def top_scores(table: DataFrame, k: int = 20, every: int = 20, factor: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of floor(factor * component), ties to the smaller id.

    Queries are the rows whose id is divisible by ``every``. Vectors that are null or empty or hold a null or non-finite component take no
    part; zero vectors do; vectors of another dimension aren't compared; with fewer candidates all are returned. Rows that
    share a query's id count as its own, however many; a query row that repeats answers once, and of an id with several vectors each is a
    query; a candidate that repeats is found as often as it occurs; one without an id is returned without
    one, after ties that have one. Scores beyond 2**53 are computed in 64-bit integers, and those of wide vectors, of n components with one of
    which floor(factor * component) is beyond sqrt(2**62 / n), in whole numbers of any size (see ``wide_lists``); only a score among a query's k largest that doesn't
    fit into a long is an error. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    rows = vectors(table, id_col, vector_col)
    fits = F.array_max(F.transform("v", lambda x: F.abs(x * factor))) + 1 <= F.sqrt(F.lit(2.0**62) / F.size("v"))
    every_row, rows = rows, rows.where(fits)
    wide = every_row.where(~fits)
    has_wide = not wide.isEmpty()
    queries = query_rows(rows, every)
    asked, candidates, slots = laid_out(rows, queries)
    candidates = cut(candidates)
    lists = tiles(asked, candidates, slots, k, lambda q, c: top_lists(q, c, k, factor), "query_id long, key long, slice int, least long, ids array<long>, parts array<long>")
    cuts = cut(cutoffs(lists, k))
    known = queries.join(cuts.hint("merge"), F.col("key") == F.col("cut_key")).select("id", "v", "key", "extra")
    asked = packed(known, 1, max(1, -(-cuts.count() // 2048)), 2048)
    found = tiles(asked, candidates, slots, k, lambda q, c: resolved(q, c, k, factor), "query_id long, key long, ids array<long>, scores array<long>")
    if not has_wide:
        return merged(found, k, "long")
    # pairs with a wide vector on either side, apart from all others: each pair is in one of the three
    text = "query_id long, key long, ids array<long>, scores array<string>"
    lists = found.withColumn("scores", F.col("scores").cast("array<string>"))
    for these, those in ((queries, wide), (query_rows(wide, every), every_row)):
        asked, candidates, slots = laid_out(those, these)
        lists = lists.unionByName(tiles(asked, candidates, slots, k, lambda q, c: wide_lists(q, c, k, factor), text))
    return merged(lists, k, "long", int)
