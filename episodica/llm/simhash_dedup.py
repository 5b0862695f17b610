"""SimHash near-duplicates by a Gray-order hierarchical index.

Upper nodes of the index are bit patterns under a mask that all fingerprints below share. The first ones are routed by Spark: of
``bits + 1`` disjoint masks two linked fingerprints agree on one at least, so each fingerprint goes to one node a mask. A node with more
than ``LEAF_ROWS`` fingerprints is refined by masks over the bits that are still free, so no node grows beyond that, whatever the
skew. Below a node, a task sorts the fingerprints by Gray rank, gives runs of neighbours a node with their shared bits, and searches
from the top: differences add up along the path and a whole group is left once they exceed ``bits``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_columns, row_key, small_batches, written
from .components import components

BITS = 2
SHINGLE = 3
#: Most fingerprints below one routed node.
LEAF_ROWS = 2048
#: Fingerprints, and then nodes, below one node of the tree in a task.
FAN = 8
#: Queries that search the tree together.
QUERIES = 256


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the text's word shingles, repeats included; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[: len(words) - shingle] + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[i:j], 42) for i, j in zip(starts.tolist(), ends[shingle - 1 :].tolist())], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        ones += np.unpackbits(hashes[k : k + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Position of each 64-bit word in the Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class Node:
    """One level of the tree: for each run of neighbours the bits they share (mask, pattern), less those that the level above has."""

    def __init__(self, mask: np.ndarray, pattern: np.ndarray, first: np.ndarray, count: np.ndarray):
        self.mask, self.pattern, self.first, self.count = mask, pattern, first, count


def build(x: np.ndarray) -> list[Node]:
    """Levels from the top, of fingerprints (rows of words) in Gray order; the last one's children are the fingerprints."""
    levels = []
    mask, pattern = np.full_like(x, ~np.uint64(0)), x
    while len(pattern) > FAN or not levels:
        starts = np.arange(0, len(pattern), FAN)
        ones, zeros = np.bitwise_and.reduceat(pattern & mask, starts, axis=0), np.bitwise_and.reduceat(~pattern & mask, starts, axis=0)
        levels.insert(0, Node(ones | zeros, ones, starts, np.diff(np.r_[starts, len(pattern)])))
        mask, pattern = ones | zeros, ones
    return levels


def ones(words: np.ndarray) -> np.ndarray:
    """Set bits of each row of words."""
    return np.bitwise_count(words[:, 0]) if words.shape[1] == 1 else np.bitwise_count(words).sum(axis=1, dtype=np.int32)


def search(x: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of Gray-ordered distinct fingerprints that differ in at most ``bits`` bits, by blocks of queries."""
    levels = build(x)
    own = [levels[0].mask]  # bits that a node adds to those of its parent
    for above, below in zip(levels, levels[1:]):
        own.append(below.mask & ~np.repeat(above.mask, above.count, axis=0))
    for start in range(0, len(x), QUERIES):
        q = np.arange(start, min(start + QUERIES, len(x)))
        query, node = np.repeat(q, len(levels[0].mask)), np.tile(np.arange(len(levels[0].mask)), len(q))
        far = np.zeros(len(query), np.int32)
        for depth, level in enumerate(levels):
            far = far + ones((x[query] ^ level.pattern[node]) & own[depth][node])
            keep = (far <= bits) & (level.first[node] + level.count[node] > 0)
            query, node, far = query[keep], node[keep], far[keep]
            times = level.count[node]
            child = np.repeat(level.first[node] - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum()) if len(node) else node
            query, far, node = np.repeat(query, times), np.repeat(far, times), child
        query, node = query[query < node], node[query < node]
        near = ones(x[query] ^ x[node]) <= bits
        yield query[near], node[near]


def spanning(x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fingerprint, smallest one of its local component) that connect all linked ones among the given distinct fingerprints."""
    x = x[np.argsort(gray_rank(x), kind="stable")]
    moved, label = joined(len(x), search(x[:, None], bits))
    return x[moved], x[label[moved]]


def merge_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the components of each pair in place; a component's label is its smallest member."""
    while True:  # hang the larger label below the smaller one until all pairs agree
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            break
        np.minimum.at(label, np.maximum(la, lb)[differ], np.minimum(la, lb)[differ])
        while (label != label[label]).any():
            label[:] = label[label]


def joined(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(members that have a smaller one in their component, the smallest of each member's component) for pairs of 0 to n - 1."""
    label = np.arange(n)
    for a, b in pairs:
        merge_labels(label, a, b)
    return np.flatnonzero(label != np.arange(n)), label


def _masks(width: int, parts: int) -> list[tuple[int, int]]:
    edges = [round(k * width / parts) for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:]) if b > a]


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(fp) distinct longs -> (a, b): edges that connect every two fingerprints which differ in at most ``bits`` bits.

    The edges are a spanning forest of each routed node, not all pairs, so they are fewer than the routed rows.
    """
    free = list(range(64))
    # a routed row: the node's path, its fingerprint, and the fingerprint's free bits packed for the next refinement
    here = nodes.select(F.lit(0).cast("long").alias("path"), "fp", F.col("fp").alias("rest"))
    width, found = 64, []
    while True:
        routes = []
        for k, (at, n) in enumerate(_masks(width, bits + 1)):
            low = F.col("rest").bitwiseAND(F.lit((1 << at) - 1)) if at else F.lit(0).cast("long")
            value = F.shiftrightunsigned("rest", at).bitwiseAND(F.lit((1 << n) - 1))
            high = F.shiftleft(F.shiftrightunsigned("rest", at + n), at) if at + n < 64 else F.lit(0).cast("long")
            routes.append(F.struct(F.xxhash64("path", F.lit(k), value).alias("path"), low.bitwiseOR(high).alias("rest")))
        routed = here.select("fp", F.explode(F.array(*routes)).alias("r")).select("r.path", "fp", "r.rest")
        width -= min(n for _, n in _masks(width, bits + 1))
        # written first, so that the join has two plain exchanges and Spark splits a crowded node
        sizes = written(routed.groupBy(F.col("path").alias("p")).agg(F.count("*").alias("n")).where("n > 1"), "nodes")
        shared = cut(routed.join(sizes.hint("merge"), F.col("path") == F.col("p")).select("path", "fp", "rest", (F.col("n") > LEAF_ROWS).alias("large")))
        found.append(_local(shared.where("not large"), bits))
        here = shared.where("large").select("path", "fp", "rest")
        if width <= bits + 1 or here.isEmpty():
            break
    edges = found[0]
    for more in found[1:]:
        edges = edges.unionByName(more)
    return edges


def _local(routed: DataFrame, bits: int) -> DataFrame:
    """Builds and searches the tree below each routed node; holds one node's fingerprints at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_path, rest = np.empty(0, np.int64), np.empty(0, np.int64)

        def edges(path: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, path[1:] != path[:-1]]) if len(path) else np.empty(0, np.int64)
            out = [spanning(fp[i:j].view(np.uint64), bits) for i, j in zip(starts, np.r_[starts[1:], len(path)]) if j - i > 1]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).view(np.int64)) for c in zip(*out)], ["a", "b"])

        for batch in batches:
            path = np.concatenate([rest_path, batch.column(0).to_numpy()])
            fp = np.concatenate([rest, batch.column(1).to_numpy()])
            last = np.flatnonzero(path != path[-1])[-1] + 1 if len(path) and (path != path[-1]).any() else 0
            yield from edges(path[:last], fp[:last])
            rest_path, rest = path[last:], fp[last:]
        yield from edges(rest_path, rest)

    dealt = routed.select("path", "fp").repartition("path").sortWithinPartitions("path")
    return dealt.mapInArrow(run, "a long, b long")


def map_prints(keyed: DataFrame, shingle: int) -> DataFrame:
    """(id, k, fp as a signed long) of rows (id, k, text)."""
    small_batches(keyed.sparkSession)

    def make():
        def step(batch):
            x = np.array([fingerprint(t, shingle) for t in batch.column(2).to_pylist()], dtype=np.uint64)
            return [batch.column(0), batch.column(1), pa.array(x.view(np.int64))]

        return step

    return map_columns(keyed, make, f"id {keyed.dtypes[0][1]}, k {keyed.dtypes[1][1]}, fp long")


def class_of_print(prints: DataFrame, bits: int) -> DataFrame:
    """(f, root): for each distinct fingerprint of ``prints`` (fp) the smallest one that links reach."""
    nodes = cut(prints.select("fp").distinct())
    roots = components(links(nodes, bits))
    return nodes.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("root", "fp").alias("root"))


def classes(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: id, fp, component_id, the smallest id that links of at most ``bits`` differing bits reach.

    A text without words (null, empty, white space) has fingerprint 0 and is linked like any other. Rows that repeat are rows of
    one class; a null id counts only where a class has no other; an empty table gives an empty result. Other columns are ignored. Texts are read
    whole, whatever their length; a bit that is set in exactly half of the shingles is 0.
    """
    prints = cut(map_prints(docs.select(F.col(id_col).alias("id"), F.lit(0).cast("long").alias("k"), F.col(text_col).alias("text")), shingle).drop("k"))
    member = cut(class_of_print(prints, bits))
    least = prints.groupBy("fp").agg(F.min("id").alias("least")).join(member.hint("merge"), F.col("fp") == F.col("f"))
    best = least.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id"))
    named = written(member.join(best.hint("merge"), F.col("root") == F.col("r")).select("f", "component_id"), "classes")
    return prints.join(named.hint("merge"), F.col("fp") == F.col("f")).select("id", "fp", "component_id")


def simhash_classes(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``classes`` with the fingerprint as 16 hex digits: id, fingerprint, component_id."""
    return classes(docs, bits, shingle, id_col, text_col).select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that of its smallest id, and of several such rows one.

    Rows of a class without any id keep one row too.
    """
    rows, keyed = keyed_rows(docs, id_col, text_col)
    prints = cut(map_prints(keyed, shingle))
    return owned_rows(rows, prints, cut(class_of_print(prints, bits)))


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """((r: the row, k), (id, k, text)), where k is the same for rows of the same id and text."""
    key = row_key(id_col, text_col)
    return docs.select(F.struct("*").alias("r"), key.alias("k")), docs.select(F.col(id_col).alias("id"), key.alias("k"), F.col(text_col).alias("text"))


def owned_rows(rows: DataFrame, prints: DataFrame, member: DataFrame) -> DataFrame:
    """The rows that own a class; prints (id, k, fp) and member (f, root) say which class a row is of."""
    # the owner of a class is the row that is least by (has an id, id, key); equal rows are one
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("i"), F.col("k").alias("owner"))
    least = prints.groupBy("fp").agg(F.min(order).alias("first"))
    owner = least.join(member.hint("merge"), F.col("fp") == F.col("f")).groupBy("root").agg(F.min("first").alias("first")).select("first.owner")
    owner = written(owner, "owners")
    owned = rows.join(owner.hint("merge"), F.col("k") == F.col("owner"), "left_semi")
    return owned.dropDuplicates(["k"]).select("r.*")
