"""Byte-level BPE by a minimal acyclic transducer of frequent words, memory-mapped, and by exact merges for all other words; decoding by the bytes of the tokens.

The words that are most frequent in all texts are compiled, with the ids that they become, into an automaton that shares prefixes and suffixes. The outputs along a word's path
add up to its number, under which its ids stand. The compiled file goes to the shared folder, Spark copies it to every executor, and workers map
it into memory, so that the workers of a machine share it. It has a bounded number of words.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections import Counter
from collections.abc import Callable
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns, shared_dir, small_batches, written
from .token_count import PATTERN, Merges, byte_symbols

#: Words that the automaton holds, and the bytes that such a word may have.
WORDS, WORD_BYTES = 1 << 17, 48
#: Merged pieces whose ids a worker remembers, and different words that it counts before it passes its counts on.
REMEMBERED, COUNTED = 250_000, 200_000
NONE = 1 << 30


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Tokens(Merges):
    """A byte-level BPE vocabulary file with its ids."""

    def __init__(self, path: str):
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        self.special_ids = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.of_byte = [vocab[s] for s in symbols]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.of_merge = {made: vocab[a + b] for made, (a, b) in zip(self.made, pairs)}
        raw = {s: b for b, s in enumerate(symbols)}
        self.bytes_of = {i: bytes(raw[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special_ids.items()}

        self.id_of = np.array([*self.of_byte, *(self.of_merge.get(256 + r, 0) for r in range(len(self.made)))], "<u4")
        pairs = sorted(self.rank.items())
        self.pair, self.pair_rank = np.array([k for k, _ in pairs] or [-1], np.int64), np.array([r for _, r in pairs] or [NONE], np.int64)
        self.made_by = np.array(self.made or [0], np.int64)

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The packed ids of each piece: the adjacent pair of lowest rank, of these the leftmost, is merged until none is left. Long pieces keep a heap of pairs, all others go in step."""
        out = [b""] * len(pieces)
        short = [k for k, p in enumerate(pieces) if 0 < len(p) <= WORD_BYTES]
        symbols, ends = self._in_step([pieces[k] for k in short])
        data, a = self.id_of[symbols].tobytes(), 0
        for k, z in zip(short, (4 * ends).tolist()):
            out[k], a = data[a:z], z
        for k, p in enumerate(pieces):
            if len(p) > WORD_BYTES:
                out[k] = self.id_of[self._by_heap(p)].tobytes()
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], NONE)

    def _in_step(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all pieces, merged, and where each piece ends; in each round every piece that has a pair left merges one."""
        symbols = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        owner = np.repeat(np.arange(len(pieces)), [*map(len, pieces)])
        done = []
        ranks = np.where(owner[1:] == owner[:-1], self._ranks(symbols[:-1], symbols[1:]), NONE) if len(owner) else owner
        ranks = np.r_[ranks, NONE][: len(owner)]
        while len(owner):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            best = np.minimum.reduceat(ranks << 32 | np.arange(len(owner)), starts)
            going = best >> 32 < NONE
            if not going.all():  # pieces without a pair are done
                still = np.repeat(going, np.diff(np.r_[starts, len(owner)]))
                done.append((owner[~still], symbols[~still]))
                best = best[going] - np.cumsum(~still)[best[going] & 0xFFFFFFFF]
                owner, symbols, ranks = owner[still], symbols[still], ranks[still]
            at, rank = best & 0xFFFFFFFF, best >> 32
            symbols[at] = self.made_by[rank]
            keep = np.ones(len(owner), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            owner, symbols, ranks = owner[keep], symbols[keep], ranks[keep]
            for left in (at, at[at > 0] - 1):
                right = np.minimum(left + 1, len(owner) - 1)
                ranks[left] = np.where((right > left) & (owner[left] == owner[right]), self._ranks(symbols[left], symbols[right]), NONE)
        owner = np.concatenate([x for x, _ in done]) if done else owner
        symbols = np.concatenate([x for _, x in done]) if done else symbols
        order = np.argsort(owner, kind="stable")
        return symbols[order], np.cumsum(np.bincount(owner, minlength=len(pieces)))

    def _by_heap(self, piece: bytes) -> list[int]:
        n = len(piece)
        rank, made = self.rank, self.made
        symbol, after, before = [*piece, -1], [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(symbol[i] << 20 | symbol[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            if symbol[i] < 0 or (j := after[i]) >= n or rank.get(symbol[i] << 20 | symbol[j]) != r:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(symbol[i] << 20 | symbol[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            if (k := before[i]) >= 0 and (r := rank.get(symbol[k] << 20 | symbol[i])) is not None:
                heapq.heappush(heap, r << 32 | k)
        return [x for x in symbol[:-1] if x >= 0]


@cache
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


# Fixed value: white space as the pattern of the pieces knows it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


@cache
def splitter(path: str) -> tuple[Callable[[str], list[str]], Callable[[str], list[str]]]:
    """Two functions: from a text to its words, and from a word to the pieces in which pairs are merged.

    A word is what stands between white space, with the white space before it. No piece reaches into another word, and what a word's pieces are doesn't hang on its neighbours.
    A special string is a word of its own, which no other word can be.
    """
    import re

    import regex

    pieces = regex.compile(PATTERN).findall
    words = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+").findall
    special = tokens_of(path).special
    inner = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def split(text: str) -> list[str]:
        if inner is None or not inner.search(text):
            return words(text)
        out: list[str] = []
        for k, part in enumerate(inner.split(text)):
            out += [part] if k % 2 else words(part)
        return out

    return split, pieces


def compiled(words: list[tuple[bytes, list[int]]]) -> bytes:
    """The automaton of distinct words and their ids: a head of counts, then its arrays.

    Words are added in order, so what can't change any more is closed; a closed state that equals an earlier one becomes that one. States are numbered as they are closed,
    after those that they lead to; the root is the last. An arc's output is how many words stand before those that it leads to.
    """
    register: dict[tuple, int] = {}
    path: list[tuple[list, bool]] = [([], False)]
    last = b""

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            arcs, final = path.pop()
            number = register.setdefault((final, tuple(arcs)), len(register))
            parent = path[-1][0]
            parent[-1] = (parent[-1][0], number)

    words = sorted(words)
    for word, _ in words:
        shared = next((k for k, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        close(shared)
        for byte in word[shared:]:
            path[-1][0].append((byte, -1))
            path.append(([], False))
        path[-1] = (path[-1][0], True)
        last = word
    close(0)
    states = [*register, (path[0][1], tuple(path[0][0]))]
    below = np.zeros(len(states), np.int64)
    key, target, output = [], [], []
    for number, (final, arcs) in enumerate(states):
        n = int(final)
        for byte, to in arcs:
            key.append(number << 8 | byte)
            target.append(to)
            output.append(n)
            n += int(below[to])
        below[number] = n
    final = np.array([f for f, _ in states], np.int64)
    starts = np.cumsum([0, *(len(ids) for _, ids in words)], dtype=np.int64)
    arrays = [np.array(x, np.int64) for x in (key, target, output)] + [final, starts, np.array([i for _, ids in words for i in ids], np.int64)]
    return b"".join(a.tobytes() for a in (np.array([len(a) for a in arrays], np.int64), *arrays))


class Lexicon:
    """A compiled automaton, mapped from its file (or from bytes)."""

    def __init__(self, source: str | bytes):
        flat = np.frombuffer(source, np.int64) if isinstance(source, bytes) else np.memmap(source, np.int64, "r")
        ends = 6 + np.cumsum(flat[:6])
        self.key, self.target, self.output, self.final, self.starts, ids = (flat[a:z] for a, z in zip([6, *ends], ends))
        self.packed = memoryview(ids.astype("<u4")).cast("B") if len(ids) else b""

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for one that isn't there: all words go through the automaton in step."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        flat, start = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        out, state, number = np.full(len(words), -1), np.full(len(words), len(self.final) - 1), np.zeros(len(words), np.int64)
        alive, depth = np.arange(len(words)), 0
        while len(alive) and len(self.key):
            ended = alive[lengths[alive] == depth]
            out[ended] = np.where(self.final[state[ended]] == 1, number[ended], -1)
            alive = alive[lengths[alive] > depth]
            arc = state[alive] << 8 | flat[start[alive] + depth]
            at = np.minimum(np.searchsorted(self.key, arc), len(self.key) - 1)
            there = self.key[at] == arc
            alive, at = alive[there], at[there]
            number[alive] += self.output[at]
            state[alive] = self.target[at]
            depth += 1
        return out


def frequent_words(docs: DataFrame, most: int, vocabulary: str | None, text_col: str) -> DataFrame:
    """(word, n): words of at most WORD_BYTES bytes that are more frequent in all texts than all others, ``most`` at most; words of about one frequency are in or out together, and one that occurs once is out.

    Workers count first, so the shuffle has each word once a task, or a few times. The counts are written, and how often they fall into steps of about one percent tells the least frequency.
    """

    def run(batches):
        import pyarrow as pa

        split, counts = splitter(vocabulary or default_vocabulary())[0], Counter()

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(split(text))
            if len(counts) > COUNTED:
                yield batch_of()
                counts.clear()
        yield batch_of()

    seen = docs.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).mapInArrow(run, "word string, n long")
    counts = written(seen.where(F.octet_length("word") <= WORD_BYTES).groupBy("word").agg(F.sum("n").alias("n")).where("n > 1").withColumn("step", F.floor(64 * F.log2("n"))), "word-counts")
    least, left = None, most
    for r in sorted(counts.groupBy("step").agg(F.count("*").alias("k")).collect(), key=lambda r: -r.step):
        left -= r.k
        if left < 0:
            break
        least = r.step
    return counts.where(F.lit(False) if least is None else F.col("step") >= least).select("word", "n")


def compile_lexicon(docs: DataFrame, vocabulary: str | None = None, most: int = WORDS, text_col: str = "text") -> str:
    """Compiles the frequent words of ``docs``, puts the file into the shared folder and gives it to all executors; returns its name for ``encode``.

    The driver gets ``most`` words at most (see ``frequent_words``). With no texts, the automaton has no words.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tokens = tokens_of(vocabulary or default_vocabulary())
    words = [r.word for r in frequent_words(docs, most, vocabulary, text_col).collect()]
    pieces = splitter(vocabulary or default_vocabulary())[1]
    words = [w for w in words if w not in tokens.special_ids]
    cut = [[p.encode() for p in pieces(w)] for w in words]
    ids = dict(zip(new := [*set().union(*cut)], tokens.encode(new)))
    data = compiled([(w.encode(), np.frombuffer(b"".join(ids[p] for p in ps), "<u4").tolist()) for w, ps in zip(words, cut)])
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(path.toString())
    return name


@cache
def _mapped(name: str) -> Lexicon:
    from pyspark import SparkFiles

    return Lexicon(SparkFiles.get(name))


class Encoder:
    """Ids of texts: words of the lexicon by the automaton, special strings by their id, all others by merges. It remembers words of the lexicon, and the last pieces that were merged, within bounds."""

    def __init__(self, path: str, lexicon: Lexicon):
        self.tokens, self.lexicon = tokens_of(path), lexicon
        self.split, self.pieces = splitter(path)
        self.words: dict[str, bytes] = {}
        self.merged: dict[str, bytes] = {}

    def _merge(self, words: list[str]) -> list[bytes]:
        """The packed ids of words that the automaton doesn't have."""
        special, merged = self.tokens.special_ids, self.merged
        if len(merged) > REMEMBERED:
            merged.clear()
        # a word of plain letters is one piece
        cut = [(w,) if w[1:].isalpha() and w.isascii() and (w[0] == " " or w[0].isalpha()) else () if w in special else self.pieces(w) for w in words]
        new = [p for p in set().union(*cut) if p not in merged]
        merged.update(zip(new, self.tokens.encode([p.encode() for p in new])))
        return [merged[w] if len(ps) == 1 else b"".join(map(merged.__getitem__, ps)) if ps else special[w].to_bytes(4, "little") for w, ps in zip(words, cut)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [*map(self.split, texts)]
        of = self.words
        words = [w for w in set().union(*split) if w not in of]
        data, starts = self.lexicon.packed, self.lexicon.starts
        numbers = self.lexicon.numbers([w.encode() for w in words])
        others = []
        for word, number, a, z in zip(words, numbers.tolist(), (4 * starts[numbers]).tolist(), (4 * starts[numbers + 1]).tolist()):
            if number >= 0:
                of[word] = bytes(data[a:z])
            else:
                others.append(word)
        of.update(zip(others, self._merge(others)))
        out = [b"".join(map(of.__getitem__, ws)) for ws in split]
        for word in others:  # most of them don't come again
            del of[word]
        return out


def encode(docs: DataFrame, lexicon: str | None = None, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): the token ids of every whole text, packed as little-endian unsigned 32-bit integers.

    ``lexicon``: what ``compile_lexicon`` returned; by default that of these texts. ``vocabulary``: path of a byte-level BPE file on each worker; by default that of the installed
    public tokenizers. A special string inside a text is one token. A null or empty text has no ids; rows that repeat are encoded each, a null id stays null; an empty
    table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    name = lexicon or compile_lexicon(docs, vocabulary, text_col=text_col)

    def make():
        path = vocabulary or default_vocabulary()
        encoder = Encoder(path, _mapped(name))
        return lambda batch: [batch.column(0), encoder.encode([t or "" for t in batch.column(1).to_pylist()])]

    kind = docs.select(id_col).dtypes[0][1]
    return map_columns(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, ids binary")


class Decoder:
    def __init__(self, tokens: Tokens):
        self.parts = [tokens.bytes_of.get(i, b"") for i in range(max(tokens.bytes_of) + 1)]

    def decode(self, packed: bytes) -> str:
        parts, n = self.parts, len(self.parts)
        return b"".join([parts[i] for i in np.frombuffer(packed, "<u4").tolist() if i < n]).decode("utf-8", "replace")


def decode(encoded: DataFrame, vocabulary: str | None = None, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """``encoded`` with the text of its packed ids: the bytes of the tokens, special ones included; bytes that are no UTF-8 are replaced, ids that no token has give nothing, null gives null."""
    columns = [c for c in encoded.columns if c != text_col]
    place = columns.index(ids_col)

    def make():
        decoder = Decoder(tokens_of(vocabulary or default_vocabulary()))
        return lambda batch: [*batch.columns, [None if x is None else decoder.decode(x) for x in batch.column(place).to_pylist()]]

    schema = ", ".join(f"`{c}` {kind}" for c, kind in encoded.select(*columns).dtypes)
    return map_columns(encoded.select(*columns), make, f"{schema}, `{text_col}` string")
