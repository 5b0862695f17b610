"""Vectors in packed blocks: a stated query set meets all rows tile by tile, and each query's best entries are merged by heaps."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Vectors in a block of queries, in a block of candidates, and queries that one product holds at a time.
QUERY_ROWS, CANDIDATE_ROWS, STRIP = 2048, 8192, 128
#: Candidates that a task holds at most, or about that.
SLOT_ROWS = 4 * CANDIDATE_ROWS
PACKED = "slot long, kind int, dim int, n int, ids binary, keys binary, vectors binary, extra binary"


def usable(vector: Column) -> Column:
    """Not null, not empty, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(math.inf)))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v as doubles) of the usable rows."""
    return table.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))


def query_rows(rows: DataFrame, every: int) -> DataFrame:
    """Rows whose id is divisible by ``every``, equal ones once, with a key for each."""
    return rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"]).withColumn("key", F.xxhash64("id", "v"))


def packed(rows: DataFrame, kind: int, slots: int, most: int) -> DataFrame:
    """Rows dealt evenly over ``slots`` slots (not by key, so that no value can crowd one) and packed into blocks of at most ``most`` vectors of one dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId()
        open_: dict[int, list] = {}

        def block(dim: int, part: list) -> pa.RecordBatch:
            ids, keys, v, extra = zip(*part)
            row = [slot, kind, dim, len(part), pa.array([None if x is None else x for x in ids], pa.int64()).fill_null(2**63 - 1).to_numpy().tobytes(), np.array(keys, np.int64).tobytes(), np.array(v, np.float64).tobytes(), np.array(extra, np.int64).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, [pa.int64(), pa.int32(), pa.int32(), pa.int32(), *[pa.binary()] * 4])], [x.split()[0] for x in PACKED.split(", ")])

        for batch in batches:
            for id_, key, v, extra in zip(*(c.to_pylist() for c in batch.columns)):
                part = open_.setdefault(len(v), [])
                part.append((id_, key, v, extra))
                if len(part) == most:
                    yield block(len(v), open_.pop(len(v)))
        for dim, part in open_.items():
            yield block(dim, part)

    key = F.col("key") if "key" in rows.columns else F.lit(0).cast("long")
    extra = F.col("extra") if "extra" in rows.columns else F.array().cast("array<long>")
    return rows.select("id", key.alias("key"), "v", extra.alias("extra")).repartition(slots).mapInArrow(run, PACKED)


class Block:
    def __init__(self, row: dict):
        n = row["n"]
        self.ids, self.keys = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["keys"], np.int64)
        self.v = np.frombuffer(row["vectors"], np.float64).reshape(n, row["dim"])
        self.extra = np.frombuffer(row["extra"], np.int64).reshape(n, -1)


def places(group: np.ndarray) -> np.ndarray:
    """How many rows of its group stand before each row; groups are runs."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))


def fewest_copies(block: Block, k: int) -> Block:
    """Of equal vectors only these can be among a query's best k: k rows of each id, and of these the 2k of smallest ids, as a query leaves out at most the k of its own id."""
    flat = np.ascontiguousarray(block.v) + 0.0  # one zero
    _, which = np.unique(flat.view(np.dtype((np.void, flat.shape[1] * 8))).ravel(), return_inverse=True)
    order = np.lexsort((block.ids, which))
    _, pair = np.unique(np.stack([which[order], block.ids[order]]), axis=1, return_inverse=True)
    order = order[places(pair.ravel()) < k]
    keep = np.sort(order[places(which[order]) < 2 * k])
    block.ids, block.v = block.ids[keep], block.v[keep]
    return block


def tiles(queries: DataFrame, candidates: DataFrame, slots: int, k: int, tile: Callable[[Block, Block], Iterator[tuple]], schema: str) -> DataFrame:
    """Runs ``tile`` on each block of queries with each block of candidates of its dimension.

    Blocks of candidates lie in ``slots`` slots, each a task of its own; every block of queries is sent once to each slot. A task holds one slot's
    candidate blocks and one query block at a time. ``tile`` yields rows of ``schema``.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, slot, blocks = to_arrow_schema(fields), None, []
        for batch in batches:
            for k_row in range(batch.num_rows):
                row = batch.slice(k_row, 1).to_pylist()[0]
                if row["slot"] != slot:
                    slot, blocks = row["slot"], []
                if row["kind"] == 0:
                    blocks.append(fewest_copies(Block(row), k))
                    continue
                query = Block(row)
                for block in blocks:
                    if block.v.shape[1] == query.v.shape[1]:
                        if out := list(tile(query, block)):
                            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    sent = queries.drop("slot").withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))))
    both = candidates.unionByName(sent).repartitionById(slots, F.col("slot").cast("int")).sortWithinPartitions("slot", "kind")
    return both.mapInArrow(run, schema)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by falling score, then rising id."""
    return np.lexsort((ids, -scores))[:k]


def merged(lists: DataFrame, k: int, kind: str, score_of: Callable | None = None) -> DataFrame:
    """(query_id, key, ids, scores) lists -> query_id, rank, vec_id, score: a heap of k entries a query, one query at a time. ``score_of`` makes a number of a score that comes in another form."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"query_id long, rank int, vec_id long, score {kind}"
    fields = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, now, heap, out = to_arrow_schema(fields), None, [], []

        def flush() -> list[tuple]:
            rows = sorted(heap, reverse=True)
            return [(now[0], rank, None if -i == 2**63 - 1 else -i, s) for rank, (s, i) in enumerate(rows, 1)]

        for batch in batches:
            for query, key, ids, scores in zip(*(c.to_pylist() for c in batch.columns)):
                if (query, key) != now:
                    out += flush() if now else []
                    now, heap = (query, key), []
                for i, s in zip(ids, map(score_of, scores) if score_of else scores):
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -i))
                    elif (s, -i) > heap[0]:
                        heapq.heapreplace(heap, (s, -i))
                    else:
                        break  # a list falls
                if len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                    out = []
        out += flush() if now else []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    dealt = lists.select("query_id", "key", "ids", "scores").repartition("query_id", "key").sortWithinPartitions("query_id", "key")
    return dealt.mapInArrow(run, schema)


def laid_out(rows: DataFrame, queries: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Packed queries, packed candidates and the number of candidate slots.

    A slot holds several blocks of candidates, so that queries are sent to few slots, but there are enough slots for all cores.
    """
    n, cores = rows.count(), rows.sparkSession.sparkContext.defaultParallelism
    slots = max(1, math.ceil(n / SLOT_ROWS), min(math.ceil(n / QUERY_ROWS), 2 * cores))
    return packed(queries, 1, max(1, math.ceil(queries.count() / QUERY_ROWS)), QUERY_ROWS), packed(rows, 0, slots, CANDIDATE_ROWS), slots
