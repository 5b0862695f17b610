"""Substring deduplication by content-defined chunks with a gear rolling hash.

A chunk ends after white space where the gear hash of the last 16 bytes says so, hence an insertion moves only the chunks around it. Where
white space is far away, as in scripts that don't write it, a chunk ends after any character where the hash says so.
A span is the fewest whole chunks from one on, or up to one, that have at least ``least_words`` words. Spans meet by digest; one found in several
documents belongs to the one with the smallest id, and in the others it is a repeated passage. Chunks that several documents hold one by one aren't.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, row_key, small_batches, written

#: Bytes of a chunk: least, most; of 2**SPREAD_BITS white-space positions one ends a chunk.
LEAST, MOST, SPREAD_BITS = 16, 256, 2
#: Bytes without white space from which on other characters end chunks too, of 2**FAR_BITS one.
FAR, FAR_BITS = 48, 3
#: Characters of one word; of a longer run each EACH characters beyond count as a word more.
WORD_CHARS, EACH = 24, 3
#: Words of a span from which it is a passage. The chunks at the ends of a repeated passage also hold text that differs, so a passage of 50 words must still count when it loses them.
LEAST_WORDS = 25
#: The gear table: one 16-bit number a byte value, by rule.
GEAR = np.array([xxhash.xxh32_intdigest(bytes([b]), 7) & 0xFFFF for b in range(256)], dtype=np.uint16)
#: Multiplier of the digests of spans, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
CHECK = 0xC2B2AE3D27D4EB4F
CHECK_INVERSE = pow(CHECK, -1, 1 << 64)
#: A span's digest has 96 bits, so that of any number of spans hardly two share one.
SPAN = np.dtype([("d", "<i8"), ("c", "<i4")])
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def boundaries(data: np.ndarray) -> list[int]:
    """Ends of the chunks of the bytes."""
    if not len(data):
        return []
    h = GEAR[data]
    for shift in (1, 2, 4, 8):  # the hash of 2, 4, 8 and 16 bytes
        if len(h) > shift:
            h = np.concatenate([h[:shift], h[shift:] + (h[:-shift] << np.uint16(shift))])
    space = SPACE[data]
    fit = space & (h >> np.uint16(16 - SPREAD_BITS) == 0)
    inner = np.r_[data[1:] & 0xC0 == 0x80, False]  # the next byte goes on with a character
    if len(data) > FAR and np.diff(np.r_[-1, np.flatnonzero(space), len(data)]).max() > FAR:
        at = np.arange(len(data))
        fit |= (at - np.maximum.accumulate(np.where(space, at, -1)) > FAR) & ~inner & (h >> np.uint16(16 - FAR_BITS) == 0)
    ends, out, last = (np.flatnonzero(fit) + 1).tolist(), [], 0
    ends.append(len(data))
    for end in ends:
        while end - last > MOST:  # no fit end: the last of those with the least hash, after white space if there is any, never within a character
            window = slice(last + LEAST - 1, last + MOST)
            may = space[window] if space[window].any() else ~inner[window]
            last += MOST - int(np.where(may, h[window].astype(np.int64), 1 << 16)[::-1].argmin())
            out.append(last)
        if end - last >= LEAST or end == len(data) > last:
            out.append(end)
            last = end
    return out


def chunks(text: str | None) -> tuple[list[int], np.ndarray, np.ndarray]:
    """(ends in bytes, words, digests: two columns of 64 bits) of the text's chunks.

    Of a run of over WORD_CHARS characters without white space each EACH characters beyond them count as a word more, so that texts in scripts
    without white space have words to count as well.
    """
    raw = (text or "").encode()
    data = np.frombuffer(raw, np.uint8)
    ends = boundaries(data)
    if not ends:
        return ends, np.empty(0, np.int64), np.empty((0, 2), np.uint64)
    space = SPACE[data]
    starts = ~space & np.r_[True, space[:-1]]
    if len(data) > WORD_CHARS and np.diff(np.r_[-1, np.flatnonzero(space), len(data)]).max() > WORD_CHARS:
        first = data & 0xC0 != 0x80
        beyond = np.cumsum(first)
        beyond = beyond - np.maximum.accumulate(np.where(starts, beyond, 0)) - WORD_CHARS
        starts |= first & ~space & (beyond >= 0) & (beyond % EACH == EACH - 1)
    before = np.r_[0, np.cumsum(starts)]
    words = np.diff(before[np.r_[0, ends]])
    digest = xxhash.xxh3_64_intdigest
    return ends, words, np.array([(digest(x := raw[i:j]), digest(x, 1)) for i, j in zip([0, *ends], ends)], dtype=np.uint64)


def spans(words: np.ndarray, digests: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first chunks, chunks after the last, digests) of the spans: the shortest from each chunk on and the shortest up to each, so that those in a run with enough words cover it."""
    total, least, n = np.r_[0, np.cumsum(words)], max(1, least_words), len(words) + 1
    after = np.searchsorted(total, total + least)
    before = np.searchsorted(total, total - least, "right") - 1
    first, last = np.flatnonzero(after < n), np.flatnonzero(before >= 0)
    first, after = np.divmod(np.unique(np.r_[first * n + after[first], before[last] * n + last]), n)
    found = np.empty(len(first), SPAN)
    for column, (name, base, inverse) in enumerate((("d", BASE, INVERSE), ("c", CHECK, CHECK_INVERSE))):
        power, back = (np.cumprod(np.r_[np.uint64(1), np.full(len(words), x, np.uint64)]) for x in (base, inverse))
        sums = np.r_[np.uint64(0), np.cumsum(digests[:, column] * power[:-1])]
        value = (sums[after] - sums[first]) * back[first]
        found[name] = value.view(np.int64) if name == "d" else (value >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return first, after, found


def distinct(found: np.ndarray) -> np.ndarray:
    """The distinct digests; sorted by their first part alone, which seldom has two second parts."""
    x = found[np.argsort(found["d"], kind="stable")]
    same = x["d"][1:] == x["d"][:-1]
    if (same & (x["c"][1:] != x["c"][:-1])).any():
        return np.unique(found)
    return x[np.r_[True, ~same]] if len(x) else x


def among(found: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which digests are among some."""
    out = np.isin(found["d"], some["d"])
    if out.any():
        pairs, at = set(some.tolist()), np.flatnonzero(out)
        out[at] = [x in pairs for x in found[at].tolist()]
    return out


def described(keyed: DataFrame, least_words: int) -> DataFrame:
    """(id, k, n_chunks, n_words, digests and checks: of its distinct spans) of rows (id, k, text), written, so that texts are cut into chunks once."""
    small_batches(keyed.sparkSession)

    def make():
        def step(batch):
            out = []
            for text in batch.column(2).to_pylist():
                ends, words, digests = chunks(text)
                found = distinct(spans(words, digests, least_words)[2])
                out.append((len(ends), int(words.sum()), found["d"], found["c"]))
            return [batch.column(0), batch.column(1), *([x[k] for x in out] for k in range(4))]

        return step

    kind = keyed.dtypes[0][1]
    return written(map_columns(keyed, make, f"id {kind}, k binary, n_chunks int, n_words int, digests array<long>, checks array<int>"), "chunks")


def repeated_spans(spans_of: DataFrame) -> DataFrame:
    """(id, k, digest, check) -> (digest, check, owner): digests that several documents hold, and the smallest id that does. Combined before the shuffle, so a frequent span costs a row a task."""
    # a null id is a document of its own beside those with ids; rows of one id are one document
    counted = spans_of.groupBy("digest", "check").agg(F.min("id").alias("owner"), F.max("id").alias("last"), F.max(F.col("id").isNull().cast("int")).alias("none"))
    return written(counted.where("owner != last or (owner is not null and none = 1)").select("digest", "check", "owner"), "spans")


def passages(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as (r: the row, n_chunks, n_words, repeated_words, cut_words, text: without the passages that another document owns).

    A null text stays null, an empty one empty. Rows with the same id are one document: they don't repeat each other. A null id owns a
    span only where no other holder has an id, and then no holder loses it. Of a passage repeated within one document nothing is cut.
    Texts of any length are read whole; an empty table gives an empty result; other columns are carried, whatever their names.
    """
    keyed = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    known = described(keyed, least_words)
    spans_of = known.select("id", "k", F.explode(F.arrays_zip("digests", "checks")).alias("s")).select("id", "k", F.col("s.digests").alias("digest"), F.col("s.checks").alias("check"))
    owners = repeated_spans(spans_of).withColumnsRenamed({"digest": "d", "check": "c"})
    held = spans_of.join(owners.hint("merge"), (F.col("digest") == F.col("d")) & (F.col("check") == F.col("c")))
    span = F.struct("digest", "check")
    mine = F.col("id").eqNullSafe(F.col("owner"))
    # a set, so that rows that repeat add nothing
    found = written(held.groupBy(F.col("k").alias("fk")).agg(F.collect_set(F.when(mine, span)).alias("kept"), F.collect_set(F.when(~mine, span)).alias("cut")), "held")
    counts = known.select("k", "n_chunks", "n_words").dropDuplicates(["k"])
    about = written(counts.join(found.hint("merge"), F.col("k") == F.col("fk"), "left").select(F.col("k").alias("ak"), "n_chunks", "n_words", "kept", "cut"), "known")
    rows = docs.select(F.struct("*").alias("r"), row_key(id_col, text_col).alias("k"), F.col(text_col).alias("text"))
    joined = rows.join(about.hint("merge"), F.col("k") == F.col("ak")).select("r", "text", "kept", "cut", "n_chunks", "n_words")
    return _cut(joined, least_words)


def runs(first: np.ndarray, after: np.ndarray, n: int) -> list[tuple[int, int]]:
    """(first, after the last) of the runs of chunks, of n, that the spans cover."""
    depth = np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(after, minlength=n + 1))
    edges = np.flatnonzero(np.diff(np.r_[0, (depth > 0).astype(np.int8)]))
    return edges.reshape(-1, 2).tolist()


def without_passages(text: str | None, kept: np.ndarray, cut: np.ndarray, least_words: int = LEAST_WORDS) -> tuple[str | None, int, int]:
    """(text without the passages to cut, words of repeated passages, words cut)."""
    if not len(kept) and not len(cut):
        return text, 0, 0
    ends, words, digests = chunks(text)
    first, after, found = spans(words, digests, least_words)
    cuts, repeats = (runs(first[x], after[x], len(ends)) for x in (among(found, cut), among(found, np.r_[kept, cut])))
    raw, starts = (text or "").encode(), [0, *ends]
    if cuts:
        edges = [0, *(starts[x] for run in cuts for x in run), len(raw)]
        text = b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2])).decode()
    total = lambda found: int(sum(words[i:j].sum() for i, j in found))
    return text, total(repeats), total(cuts)


def _cut(joined: DataFrame, least_words: int) -> DataFrame:
    small_batches(joined.sparkSession)

    def make():
        def digests(column, k):
            n = len(column[k]) if column[k].is_valid else 0
            out = np.empty(n, SPAN)
            if n:
                out["d"], out["c"] = (x.to_numpy() for x in column[k].values.flatten())
            return out

        def step(batch):
            out = [without_passages(t, digests(batch.column(2), k), digests(batch.column(3), k), least_words) for k, t in enumerate(batch.column(1).to_pylist())]
            return [batch.column(0), [x[0] for x in out], batch.column(4), batch.column(5), [x[1] for x in out], [x[2] for x in out]]

        return step

    row = joined.schema["r"].dataType.simpleString()
    return map_columns(joined, make, f"r {row}, text string, n_chunks int, n_words int, repeated_words int, cut_words int")


def deduplicated(docs: DataFrame, least_words: int = LEAST_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated passages cut from all texts but their owner's; a document that was nothing but such passages goes."""
    out = passages(docs, least_words, id_col, text_col)
    gone = (F.col("cut_words") > 0) & (F.col("cut_words") == F.col("n_words"))
    return out.where(~gone).select(*[F.col("text").alias(c) if c == text_col else F.col(f"r.`{c}`").alias(c) for c in docs.columns])
