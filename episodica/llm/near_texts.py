"""Near copies of texts at a similarity of five-word shingle sets, by wide SimHash sketches in the Gray-order hierarchical index.

64 bits can't tell a similarity of 0.8 from 0.6, so a text's sketch has ``WORDS`` words of 64 bits over its distinct shingles. Two sketches
of sets with Jaccard similarity J differ in a share acos(2J / (1 + J)) / pi of their bits. That estimates J with a standard error of about
0.026 at 0.8, so pairs above the least similarity by ``ABOVE`` are links, pairs below it by ``BELOW`` are none, and those between are told
by the exact similarity of their shingle sets. A set of five with one of four that it holds is the pair whose sketches differ most for
its similarity (0.19 of the bits for 0.15); such pairs are found by a join on hashes of the sets without one shingle each. Of the unsure pairs a node gives a spanning forest between what sure links connect, which is linear;
only where a pair of the forest is refused, what it connects is searched again with the shingle sets at hand, and no pair leaves the task.

Upper nodes are again patterns under masks of the first four words, but at this radius no set of disjoint masks is sure to agree, so
masks are drawn until a pair at the least similarity shares one with probability ``recall``, nearer ones with more. A mask has more bits the more sketches
there are, so that a node stays small. A node that is large nevertheless holds a group of copies: all its sketches that are sure links of
one pivot are linked to it, which is linear, and only the others are still compared with all of the node, in tiles of two blocks that
hold at most about ``LEAF_ROWS``. So work is quadratic in such a node's texts out of its pivot's reach alone. Below a node a task builds and searches
the tree of ``simhash_dedup``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_columns, small_batches, written
from .components import components
from .simhash_dedup import gray_rank, keyed_rows, merge_labels, ones, owned_rows, search

SHINGLE, SIMILARITY = 5, 0.8
#: Similarities that far above or below the least one are told by sketches, nearer ones by the texts: over three standard errors.
ABOVE, BELOW = 0.08, 0.1
#: 64-bit words of a sketch; those that masks and trees use.
WORDS, INDEXED = 16, 4
#: Sketches aimed at in a node, and the most (or about that) below one node that a task searches.
NODE_ROWS, LEAF_ROWS = 1024, 4096
#: Standard errors by which the indexed bits of a pair at the least similarity may differ more than expected before the tree leaves it.
TREE_ERRORS = 4.5
#: Least bits of a mask.
LEAST_BITS = 8
#: Chance that a pair at the least similarity shares a node.
RECALL = 0.999
#: Most keys (large nodes, texts to compare) that are broadcast; beyond it they are joined by shuffle.
BROADCAST_NODES = 500_000
#: Unsure pairs that a task holds before it thins them to a forest.
HELD_PAIRS = 1_000_000


def mixed(h: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (the finaliser of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: What sets the words of a sketch apart, by rule.
SALTS = mixed(np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct word shingles (fewer words: the whole sequence)."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined_words, n = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[: len(words) - n] + 1]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined_words[i:j], 42) for i, j in zip(starts.tolist(), ends[n - 1 :].tolist())], dtype=np.uint64))


def less_one(hashes: np.ndarray) -> np.ndarray:
    """What joins sets of four and five: the hash of a set of four, those of the sets of four in a set of five, nothing of other sets."""
    if len(hashes) not in (4, 5):
        return np.empty(0, np.int64)
    single = mixed(hashes)
    return (single.sum() - (single if len(hashes) == 5 else np.zeros(1, np.uint64))).view(np.int64)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Words of the sketch of a shingle set: a bit is 1 if set in over half the shingles' hashes; 0 without shingles."""
    count = np.zeros(64 * WORDS, np.int64)
    for k in range(0, len(hashes), 255 * 64):
        block = mixed(hashes[k : k + 255 * 64, None] ^ SALTS).view(np.uint8)
        bits = np.unpackbits(block, axis=1, bitorder="little")
        for j in range(0, len(bits), 255):  # 255 rows can't overflow a byte
            count += bits[j : j + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")


def share(similarity: float) -> float:
    """Expected share of differing bits at a Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, WORDS)


def sketches(keyed: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(id, k, fp: 64-bit hash of the sketch, sketch, small: see ``less_one``) of rows (id, k, text)."""
    small_batches(keyed.sparkSession)

    def make():
        def step(batch):
            sets = [shingles(t, shingle) for t in batch.column(2).to_pylist()]
            found = [sketch(h).tobytes() for h in sets]
            fp = np.array([xxhash.xxh3_64_intdigest(x) for x in found], dtype=np.uint64).view(np.int64)
            return [batch.column(0), batch.column(1), pa.array(fp), found, [less_one(h) for h in sets]]

        return step

    return map_columns(keyed, make, f"id {keyed.dtypes[0][1]}, k {keyed.dtypes[1][1]}, fp long, sketch binary, small array<long>")


def _routed(rows: DataFrame, level: int, width: int, tables: int) -> DataFrame:
    """(path, fp, sketch) -> the same, one row for each of ``tables`` masks of ``width`` bits; a path stands for the patterns above and this one."""
    rng = np.random.default_rng([17, level])
    masks = np.zeros((tables, INDEXED), np.uint64)
    salts = mixed(np.arange(1, tables + 1, dtype=np.uint64))
    for mask in masks:
        for bit in rng.choice(64 * INDEXED, width, replace=False).tolist():
            mask[bit // 64] |= np.uint64(1 << bit % 64)

    def make():
        def step(batch):
            above, x = batch.column(0).to_numpy().view(np.uint64), _words(batch.column(2))
            paths = np.empty((len(x), tables), np.uint64)
            for t, mask in enumerate(masks):
                h = mixed(above ^ salts[t])
                for w in range(INDEXED):
                    h = mixed(h ^ (x[:, w] & mask[w])) + SALTS[w]
                paths[:, t] = h
            offsets = np.arange(0, paths.size + 1, tables, dtype=np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(paths.view(np.int64).ravel())), batch.column(1), batch.column(2)]

        return step

    return map_columns(rows, make, "paths array<long>, fp long, sketch binary").select(F.explode("paths").alias("path"), "fp", "sketch")


def _with_nodes(rows: DataFrame, nodes: DataFrame, count: int, how: str) -> DataFrame:
    side = nodes.hint("broadcast" if count <= BROADCAST_NODES else "merge")
    return rows.join(side, F.col("path") == F.col("p"), how)


def _limits(similarity: float) -> tuple[int, int]:
    """Most differing bits of a sure link and of a pair that may be one."""
    return tuple(round(share(s) * 64 * WORDS) for s in (min(similarity + ABOVE, 1), max(similarity - BELOW, 0)))


def forest(label: np.ndarray, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> np.ndarray:
    """Positions of pairs that connect all components of ``label`` which the pairs connect, the closest first and no more than needed."""
    label, at, chosen = label.copy(), np.argsort(far, kind="stable"), []
    while True:
        at = at[label[a[at]] != label[b[at]]]
        if not len(at):
            return np.concatenate(chosen) if chosen else at
        ends = np.stack([label[a[at]], label[b[at]]], axis=1).ravel()
        pick = at[np.unique(np.unique(ends, return_index=True)[1] // 2)]  # each component's closest pair
        chosen.append(pick)
        merge_labels(label, a[pick], b[pick])


def _by_node(rows: DataFrame, edges: Callable, schema: str) -> DataFrame:
    """(path, fp, sketch, more longs) -> what ``edges`` gives for the arrays (path, fp, sketches, ...) of each node; holds one node at a time."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def done(until: int) -> Iterator[pa.RecordBatch]:
            path = held[0]
            starts = np.flatnonzero(np.r_[True, path[1:until] != path[: until - 1]]) if until else np.empty(0, np.int64)
            for i, j in zip(starts, np.r_[starts[1:], until]):
                if j - i > 1:
                    for columns in edges(*(x[i:j] for x in held)):
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

        for batch in batches:
            fresh = [_words(c) if k == 2 else c.to_numpy(zero_copy_only=False) for k, c in enumerate(batch.columns)]
            held = fresh if held is None else [np.concatenate(x) for x in zip(held, fresh)]
            path = held[0]
            last = int(np.flatnonzero(path != path[-1])[-1]) + 1 if len(path) and path[0] != path[-1] else 0
            yield from done(last)
            held = [x[last:] for x in held]
        if held is not None:
            yield from done(len(held[0]))

    return rows.repartition("path").sortWithinPartitions("path").mapInArrow(run, schema)


def _close(x: np.ndarray, most: int, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, differing bits) of the pairs within ``most`` bits, by the tree, of sketches in Gray order."""
    p = share(similarity)
    reach = round(64 * INDEXED * p + TREE_ERRORS * math.sqrt(64 * INDEXED * p * (1 - p)))
    for a, b in search(np.ascontiguousarray(x[:, :INDEXED]), reach):
        far = ones(x[a] ^ x[b])
        near = far <= most
        yield a[near], b[near], far[near]


def _in_order(fp: np.ndarray, x: np.ndarray, *more: np.ndarray) -> list[np.ndarray]:
    fp, first = np.unique(fp, return_index=True)
    order = np.lexsort([gray_rank(x[first, w]) for w in reversed(range(INDEXED))])
    return [fp[order], *(y[first][order] for y in (x, *more))]


def _searched(rows: DataFrame, similarity: float) -> DataFrame:
    """(path, fp, sketch) -> (path, patch, a, b, sure) in each node: edges that connect what sure links do, and pairs to tell that connect all else that may link.

    Both kinds together connect a patch of the node, named by one of its sketches.
    """
    sure, most = _limits(similarity)

    def edges(path: np.ndarray, fp: np.ndarray, x: np.ndarray):
        fp, x = _in_order(fp, x)
        label, held, size = np.arange(len(fp)), [], 0

        def thinned() -> list:
            a, b, far = (np.concatenate(c) for c in zip(*held))
            keep = forest(label, a, b, far)
            return [(a[keep], b[keep], far[keep])]

        for a, b, far in _close(x, most, similarity):
            merge_labels(label, a[far <= sure], b[far <= sure])
            apart = (far > sure) & (label[a] != label[b])
            held.append((a[apart], b[apart], far[apart]))
            size += int(apart.sum())
            if size > HELD_PAIRS:
                held = thinned()
                size = len(held[0][0])
        moved, patch = np.flatnonzero(label != np.arange(len(fp))), label
        if size:
            a, b, _ = thinned()[0]
            patch = label.copy()
            merge_labels(patch, a, b)
            yield np.full(len(a), path[0]), fp[patch[a]], fp[a], fp[b], np.zeros(len(a), bool)
        yield np.full(len(moved), path[0]), fp[patch[moved]], fp[moved], fp[label[moved]], np.ones(len(moved), bool)

    return _by_node(rows, edges, "path long, patch long, a long, b long, sure boolean")


def _apart(rows: DataFrame, similarity: float) -> DataFrame:
    """(path, fp, sketch, root, hashes) -> (a, b): links that connect what is alike in each patch and has different roots.

    A task holds one patch: at most about ``LEAF_ROWS`` shingle sets.
    """
    most = _limits(similarity)[1]

    def edges(path: np.ndarray, fp: np.ndarray, x: np.ndarray, root: np.ndarray, hashes: np.ndarray):
        fp, x, root, hashes = _in_order(fp, x, root, hashes)
        label = np.unique(root, return_inverse=True)[1].astype(np.int64)
        label = np.unique(label, return_index=True)[1][label]  # the first row of each root
        sets, found = [np.frombuffer(h, np.uint64) for h in hashes], []
        for a, b, _ in _close(x, most, similarity):
            apart = label[a] != label[b]
            for i, j in zip(a[apart].tolist(), b[apart].tolist()):
                if label[i] != label[j] and _alike(sets[i], sets[j], similarity):
                    merge_labels(label, np.array([i]), np.array([j]))
                    found.append((fp[i], fp[j]))
        if found:
            yield np.array(found, np.int64).T

    return _by_node(rows, edges, "a long, b long")


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted shingle sets have the least similarity."""
    least, most = sorted((len(x), len(y)))
    if least < similarity * most - 1e-9:
        return False
    both = least and int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
    return both >= similarity * (len(x) + len(y) - both) - 1e-9


def _pivoted(rows: DataFrame, similarity: float) -> DataFrame:
    """(path, fp, sketch, pivot, centre) -> (path, fp, sketch, pivot, reached): whether the sketch is a sure link of the node's pivot."""
    sure = _limits(similarity)[0]

    def make():
        def step(batch):
            return [*(batch.column(k) for k in range(4)), pa.array(ones(_words(batch.column(2)) ^ _words(batch.column(4))) <= sure)]

        return step

    return map_columns(rows, make, "path long, fp long, sketch binary, pivot long, reached boolean")


def _sets(ends: DataFrame, nodes: DataFrame, keyed: DataFrame, shingle: int) -> DataFrame:
    """(e), distinct sketches by their fp -> (e, hashes): the shingle set of one text of each."""
    ends = written(ends, "unsure-texts")
    count = ends.count()
    side = lambda df: df.hint("broadcast" if count <= BROADCAST_NODES else "merge")
    chosen = written(nodes.join(side(ends), F.col("fp") == F.col("e")).select("e", F.col("k").alias("c")), "unsure-keys")
    texts = keyed.join(side(chosen), F.col("k") == F.col("c")).select("e", "text")

    def hashed():
        return lambda batch: [batch.column(0), [shingles(t, shingle).tobytes() for t in batch.column(1).to_pylist()]]

    return cut(map_columns(texts, hashed, "e long, hashes binary").dropDuplicates(["e"]))


def _told(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b), distinct -> (a, b, same): whether the shingle sets have the least similarity."""

    def compared():
        same = lambda x, y: _alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity)
        return lambda batch: [batch.column(0), batch.column(1), [same(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]]

    first, second = (sets.select(F.col("e").alias(f"{c}e"), F.col("hashes").alias(f"{c}h")).hint("merge") for c in "ab")
    rows = pairs.join(first, F.col("a") == F.col("ae")).join(second, F.col("b") == F.col("be")).select("a", "b", "ah", "bh")
    return cut(map_columns(rows, compared, "a long, b long, same boolean"))


def _small_links(nodes: DataFrame) -> DataFrame:
    """(a, b): sets of five shingles with the set of four that they hold, which have a similarity of 0.8; a set of four is one row, so no group's pairs are made."""
    four = nodes.where(F.size("small") == 1).select(F.element_at("small", 1).alias("key"), F.col("fp").alias("b"))
    five = nodes.where(F.size("small") == 5).select(F.explode("small").alias("held"), F.col("fp").alias("a"))
    return five.join(four.hint("merge"), F.col("held") == F.col("key")).select("a", "b")


def _routes(nodes: DataFrame, similarity: float, recall: float) -> tuple[list[DataFrame], list[DataFrame]]:
    """(fp, sketch), distinct -> (tables (path, fp, sketch) of nodes to search, tables (a, b) of sure links to pivots)."""
    agree = 1 - share(similarity)
    width = max(LEAST_BITS, math.ceil(math.log2(max(nodes.count(), 1) / NODE_ROWS)))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - agree**width))
    routed = _routed(nodes.select(F.lit(0).cast("long").alias("path"), "fp", "sketch"), 0, width, tables)
    sizes = routed.groupBy(F.col("path").alias("p")).agg(F.count("*").alias("n"), F.min("fp").alias("pivot"))
    large = written(sizes.where(F.col("n") > LEAF_ROWS), "large-nodes")
    count = large.count()
    if not count:
        return [routed], []
    crowd = cut(_with_nodes(routed, large, count, "inner").select("path", "fp", "sketch", "pivot"))
    centre = written(crowd.where("fp = pivot").groupBy(F.col("path").alias("p")).agg(F.first("sketch").alias("centre")), "pivots")
    told = cut(_pivoted(_with_nodes(crowd, centre, count, "inner").select("path", "fp", "sketch", "pivot", "centre"), similarity))
    # those out of reach meet each other and those within it, in tiles of two blocks
    left = told.groupBy(F.col("path").alias("p")).agg(*[F.ceil(F.count_if(c) * 2 / LEAF_ROWS).cast("int").alias(n) for c, n in ((F.col("reached"), "inner"), (~F.col("reached"), "outer"))])
    left = written(left.where("outer > 0"), "out-of-reach")
    block = F.pmod(F.xxhash64("fp"), F.when(F.col("reached"), F.col("inner")).otherwise(F.col("outer"))).cast("int")
    outer = F.sequence(F.lit(0), F.col("outer") - 1)
    tile = F.when(F.col("reached"), F.transform(outer, lambda o: F.xxhash64("path", F.lit("inner"), "block", o))).otherwise(
        F.concat(
            F.transform(outer, lambda o: F.xxhash64("path", F.lit("outer"), F.least("block", o), F.greatest("block", o))),
            F.when(F.col("inner") > 0, F.transform(F.sequence(F.lit(0), F.col("inner") - 1), lambda i: F.xxhash64("path", F.lit("inner"), i, "block"))).otherwise(F.array().cast("array<long>")),
        )
    )
    tiles = _with_nodes(told, left, count, "inner").withColumn("block", block).select(F.explode(tile).alias("path"), "fp", "sketch")
    small = _with_nodes(routed, large.select("p"), count, "left_anti")
    return [small, tiles], [told.where("reached and fp <> pivot").select(F.col("fp").alias("a"), F.col("pivot").alias("b"))]


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    return out


def classes(nodes: DataFrame, keyed: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, recall: float = RECALL) -> DataFrame:
    """(node, root) of what links of ``similarity`` connect, but for pairs that share no mask; only nodes that have a link.

    ``nodes`` has each distinct sketch (fp, sketch, small, k) with the key of one of its texts in ``keyed`` (id, k, text).
    """
    found, pivots = _routes(nodes, similarity, recall)
    searched = cut(_union([_searched(rows, similarity).withColumn("path", F.xxhash64("path", "patch")) for rows in found]))
    small = [cut(_small_links(nodes))] if similarity <= 0.8 else []
    edges = _union([searched.where("sure").select("a", "b"), *pivots, *small])
    pair = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")]
    unsure = written(searched.where("not sure").select(*pair, "path"), "unsure-pairs")
    if unsure.isEmpty():
        return components(edges)
    ends = unsure.select("a").distinct().unionByName(unsure.select(F.col("b").alias("a")).distinct()).select(F.col("a").alias("e")).distinct()
    told = _told(unsure.select("a", "b").distinct(), _sets(ends, nodes, keyed, shingle), similarity)
    edges = edges.unionByName(told.where("same").select("a", "b"))
    roots = components(edges)
    refused = told.where("not same").select(F.col("a").alias("ra"), F.col("b").alias("rb"))
    patches = written(unsure.join(refused.hint("merge"), (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb"))).select(F.col("path").alias("p")).distinct(), "refused-patches")
    count = patches.count()
    if not count:
        return roots
    # a refused pair of a forest may hide others between the same components: its patch is searched again with the sets
    roots = cut(roots)
    again = _with_nodes(searched, patches, count, "left_semi")
    again = cut(again.select("path", F.col("a").alias("e")).unionByName(again.select("path", F.col("b").alias("e"))).distinct())
    sets = _sets(again.select("e").distinct(), nodes, keyed, shingle)
    about = sets.join(nodes.hint("merge"), F.col("e") == F.col("fp")).join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "sketch", F.coalesce("root", "fp").alias("root"), "hashes")
    more = cut(_apart(again.join(about.hint("merge"), F.col("e") == F.col("fp")).select("path", "fp", "sketch", "root", "hashes"), similarity))
    return roots if more.isEmpty() else components(edges.unionByName(more))


def one_of_each(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", recall: float = RECALL) -> DataFrame:
    """``docs`` with one row of each class of near copies: that of its smallest id, and of several such rows one.

    A pair at the least similarity is met with probability ``recall``, which costs work in proportion to -log(1 - recall).

    Classes are connected: a row may be like the one that stays by way of others. Texts without words (null, empty, white space) are
    one class. Rows of a class without any id keep one row; an empty table stays empty; other columns are carried whatever their names.
    """
    rows, keyed = keyed_rows(docs, id_col, text_col)
    prints = cut(sketches(keyed, shingle))
    prints, odd = told_apart(prints)
    nodes = cut(prints.groupBy("fp").agg(F.first("sketch").alias("sketch"), F.first("small").alias("small"), F.min("k").alias("k")))
    roots = classes(nodes, keyed, similarity, shingle, recall)
    member = nodes.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("root", "fp").alias("root"))
    kept = owned_rows(rows, prints.select("id", "k", "fp"), cut(member))
    return kept if odd is None else kept.unionByName(rows.join(odd.hint("merge"), F.col("k") == F.col("odd_k"), "left_semi").dropDuplicates(["k"]).select("r.*"))


def told_apart(prints: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The prints whose fp stands for one sketch, and (odd_k) the rows to keep of the others, if there are any: sketches that share the 64 bits of another one's fp.

    Among very many texts a few such pairs are to be expected. All but one sketch of each fp keep a row of their own, so that none is lost for another's sake; near copies of theirs may stay.
    """
    checked = prints.withColumn("__check", F.xxhash64("sketch"))
    shared = cut(checked.groupBy(F.col("fp").alias("__f")).agg(F.min("__check").alias("__least"), F.max("__check").alias("__most")).where("__least != __most").select("__f", "__least"))
    if shared.isEmpty():
        return prints, None
    met = checked.join(shared.hint("merge"), F.col("fp") == F.col("__f"), "left")
    odd = F.col("__f").isNotNull() & (F.col("__check") != F.col("__least"))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("i"), F.col("k").alias("k"))
    owners = cut(met.where(odd).groupBy("fp", "__check").agg(F.min(order).alias("first")).select(F.col("first")["k"].alias("odd_k")))
    return cut(met.where(~odd).select(*prints.columns)), owners
