"""Ranked lexical search by dense blocked matrix products in float64.

Items (the queries) are rows of whole numbers over their own compact vocabulary, documents are columns of whole impacts. A tile of items times a tile of documents gives the scores of all pairs in one
product; vocabulary tiles are cut so that no partial sum reaches 2^53, so doubles hold every sum exactly, whatever the order in which the product adds. Each task keeps the
best k of every item, ties by the smaller document id, and few of these are merged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_columns, small_batches, written

#: Items, terms and documents of one product.
ITEM_ROWS, TERM_COLUMNS, DOC_COLUMNS = 256, 4096, 512
#: Distinct terms of items, counted with repeats over items, that one pass over the documents asks for; more items than that take several passes.
ENTRIES = 2_000_000
EXACT = 2**53
#: What a term's share of a score stays below, besides its weight.
IMPACT = 10**6
NO_ID = 2**63 - 1

# Bytes that stand between terms, all others being in terms; only A-Z are lower-cased.
_BETWEEN = {*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)}
_TABLE = bytes(0x20 if b in _BETWEEN else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text: letters and digits of ASCII and all characters beyond it."""
    return text.encode().translate(_TABLE).split() if text else []


def item_terms(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item_id, g, terms, counts) of items that have a term; rows that repeat once. ``g`` is a hash, by which items are dealt to passes."""

    def make():
        def step(batch):
            counts = [Counter(terms(t)) for t in batch.column(1).to_pylist()]
            return [batch.column(0), batch.column(2), [list(c) for c in counts], [list(c.values()) for c in counts]]

        return step

    rows = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).distinct().withColumn("g", F.xxhash64("item_id", "text"))
    return map_columns(rows, make, f"item_id {dict(rows.dtypes)['item_id']}, g long, terms array<binary>, counts array<long>").where(F.size("terms") > 0)


def item_occurrences(docs: DataFrame, vocabulary: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, ids, tf) of every text that has a term: how many terms, and which of the vocabulary how often."""

    def make():
        number = vocabulary.get

        def step(batch):
            n, ids, tf = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms(text)
                counts = Counter(map(number, words))
                counts.pop(None, None)
                n.append(len(words))
                ids.append(list(counts))
                tf.append(list(counts.values()))
            return [batch.column(0), n, ids, tf]

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_columns(rows, make, "doc_id long, n long, ids array<int>, tf array<long>").where("n > 0")


def holders(found: DataFrame, size: int) -> np.ndarray:
    """How many documents hold each term of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            counts += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(counts[there], pa.int64())], ["term", "n"])

    out = np.zeros(size, np.int64)
    for r in found.select("ids").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[r.term] = r.n
    return out


def exact_tiles(counts: np.ndarray, most: np.ndarray, columns: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(columns, counts) of vocabulary tiles: with impacts of at most ``most`` no row's sum reaches EXACT. One term that is too frequent in an item is split into parts."""
    if not len(columns):
        return
    if len(columns) <= TERM_COLUMNS and all(int(x) < EXACT for x in counts.astype(object) @ most[columns].astype(object)):
        yield columns, counts.astype(np.float64)
    elif len(columns) > 1:
        half = len(columns) // 2
        yield from exact_tiles(counts[:, :half], most, columns[:half])
        yield from exact_tiles(counts[:, half:], most, columns[half:])
    else:
        part = (EXACT - 1) // int(most[columns[0]])
        yield columns, np.minimum(counts, part).astype(np.float64)
        yield from exact_tiles(np.maximum(counts - part, 0), most, columns)


class Tile:
    """A block of items over their compact vocabulary, with the best documents of each so far."""

    def __init__(self, items: list[tuple[list[int], list[int]]], first: int, weight: np.ndarray, k: int):
        used = np.unique(np.concatenate([np.array(ids, np.int64) for ids, _ in items]))
        counts = np.zeros((len(items), len(used)), np.int64)
        for row, (ids, n) in enumerate(items):
            counts[row, np.searchsorted(used, ids)] = n
        most = np.maximum(weight[used], 1) * IMPACT
        if any(int(x) >= 2**63 for x in counts.astype(object) @ most.astype(object)):
            raise ValueError("an item has so many terms that scores may not fit into 64 bits")
        self.parts = [(used[c], q) for c, q in exact_tiles(counts, most, np.arange(len(used)))]
        self.first, self.k = first, k
        self.best = np.zeros((len(items), k), np.int64)
        self.docs = np.full((len(items), k), NO_ID, np.int64)

    def add(self, docs: np.ndarray, term: np.ndarray, column: np.ndarray, impact: np.ndarray) -> None:
        scores = np.zeros((len(self.best), len(docs)), np.int64)
        for used, counts in self.parts:
            at = np.minimum(np.searchsorted(used, term), len(used) - 1)
            here = used[at] == term
            dense = np.zeros((len(used), len(docs)))
            dense[at[here], column[here]] = impact[here]
            scores += (counts @ dense).astype(np.int64)
        least = np.maximum(self.best[:, -1], 1)
        hits = scores >= least[:, None]  # ties at the least score too: ids decide
        for row in np.flatnonzero(hits.any(axis=1)):
            at = np.flatnonzero(hits[row])
            if len(at) > self.k:  # no fewer than k reach the k-th score
                edge = np.partition(scores[row, at], -self.k)[-self.k]
                at = at[scores[row, at] >= edge]
            score, doc = np.r_[self.best[row], scores[row, at]], np.r_[self.docs[row], docs[at]]
            order = np.lexsort((doc, -score))[: self.k]
            self.best[row], self.docs[row] = score[order], doc[order]


def scored(found: DataFrame, items: list[tuple[list[int], list[int]]], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(item, doc_id, score): each task's best k of every item."""

    def impacts(n: np.ndarray, tf: np.ndarray, terms_: np.ndarray) -> np.ndarray:
        wide = 75 * int(n.max()) * n_docs >= 2**62 or int(tf.max()) * 10**9 >= 2**62
        n, tf = (n.astype(object), tf.astype(object)) if wide else (n, tf)
        m = 25 + (75 * n * n_docs) // n_terms
        return (weight[terms_] * ((10**9 * tf) // (1000 * tf + 8 * m))).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = [Tile(items[a : a + ITEM_ROWS], a, weight, k) for a in range(0, len(items), ITEM_ROWS)]
        for whole in batches:
            for a in range(0, whole.num_rows, DOC_COLUMNS):
                batch = whole.slice(a, DOC_COLUMNS)
                ids, tf = (batch.column(c).flatten().to_numpy() for c in (2, 3))
                if not len(ids):
                    continue
                docs, n = batch.column(0).fill_null(NO_ID).to_numpy(), batch.column(1).to_numpy()
                column = np.repeat(np.arange(len(n)), np.diff(batch.column(2).offsets.to_numpy()))
                impact = impacts(n[column], tf, ids)
                for block in blocks:
                    block.add(docs, ids, column, impact)
        for block in blocks:
            row, place = np.nonzero(block.best > 0)
            doc = block.docs[row, place]
            yield pa.RecordBatch.from_arrays([pa.array(row + block.first, pa.int64()), pa.array(doc, pa.int64(), mask=doc == NO_ID), pa.array(block.best[row, place], pa.int64())], ["item", "doc_id", "score"])

    return found.select("doc_id", "n", "ids", "tf").mapInArrow(run, "item long, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents of highest score above 0 of each item, equal scores by rising id, those without an id last.

    The weight of a term is floor(1000 ln((2 N + 2) / (2 df + 1))) with N documents that have a term and df that hold this one; a document of n terms, of all L, has m = 25 + (75 n N) div L;
    a term that it has tf times adds its weight times (10^9 tf) div (1000 tf + 8 m), for each time that the item has it. Texts are read whole.

    Items whose rows repeat are one item; an item id with several texts has a ranking for each. Documents whose rows repeat are documents each. Null and
    empty texts have no terms: such items have no rows, such documents count for nothing. Without items or documents the result is empty. Other columns are ignored, whatever their names.

    Items are dealt to passes of about ENTRIES terms, and the driver holds one pass's items; their number grows with the items only. A pass reads the texts once and
    writes what items ask for to the shared folder, from where it is weighted and scored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = written(item_terms(items, item_col, item_text_col), "items")
    entries = asked.agg(F.sum(F.size("terms")).alias("n")).first().n or 0
    passes = -(-entries // ENTRIES)
    kind = dict(asked.dtypes)["item_id"]
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for number in range(passes):
        rows = asked.where(F.pmod("g", F.lit(passes)) == number).orderBy("item_id", "g").collect()
        vocabulary: dict[bytes, int] = {}
        asks = [([vocabulary.setdefault(bytes(t), len(vocabulary)) for t in r.terms], list(r.counts)) for r in rows]
        if not rows:
            continue
        found = written(item_occurrences(docs, vocabulary, id_col, text_col), "item-occurrences")
        n_docs, n_terms = found.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            break
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holders(found, len(vocabulary)).tolist()], np.int64)
        best = scored(found, asks, weight, n_docs, n_terms, k)
        # few rows a task and item are left; in two steps, so that no item's rows of all tasks meet at once
        for keys in (["item", F.pmod(F.xxhash64("doc_id"), F.lit(64))], ["item"]):
            w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
            best = best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], f"item long, item_id {kind}")
        out = out.unionByName(best.join(names.hint("merge"), "item").select("item_id", "rank", "doc_id", "score"))
    return out
