"""SentencePiece BPE encoding with seeded merge-dropout, and its lossless decoding.

The agenda holds candidate merges by score, then place. Each candidate that comes up is skipped with the dropout rate, by hashes keyed by
seed, document and the unit's place in it, so every occurrence of a word is segmented anew and reruns agree. The hashes give how many candidates
come up from one skipped to the next. The agendas of many units are processed in step, each giving up its best candidate a round; workers remember
only what units become where nothing is skipped. Segmentations are made of ordinary merges only and decode to the text.
"""

from __future__ import annotations

import heapq
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from .common import map_columns, small_batches

SPACE = "▁"
#: Units whose segmentation without skips a worker remembers, and the most characters of a unit that is processed in step with others.
CACHE, SHORT = 400_000, 40
#: Widths of the tables that hold the symbols of units, a row a unit.
WIDTHS = (4, 6, 8, 10, 13, 17, 24, SHORT)
#: Most rows of a table, so that it stays near the processor.
ROWS = 16384
#: Units that are encoded together, at least.
TOGETHER = 1 << 17
# a unit: spaces and what follows up to the next space; line ends and a literal U+2581 stand alone, as no piece joins them to others
UNITS = re.compile(r" *[^ \n▁]+| +|\n|▁").findall
MASK = (1 << 64) - 1
#: Candidates that one hash may pass over at most; more than come up in a short unit.
FAR = 4096
GOLDEN = 0x9E3779B97F4A7C15
#: No candidate.
NONE = np.iinfo(np.int32).max


class Pieces:
    """The vocabulary of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        self.id, self.byte, self.surface = {}, [0] * 256, [b""] * n
        scores = {}
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte[value], self.surface[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.id[piece], scores[piece] = i, model.get_score(i)
                self.surface[i] = piece.replace(SPACE, " ").encode()
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.id) or 0 in self.byte:
            raise ValueError(f"{path}: only BPE models with byte fallback whose pieces don't cross spaces are supported")
        place = {s: k for k, s in enumerate(sorted(set(scores.values()), reverse=True))}
        self.rank = {p: place[s] for p, s in scores.items()}
        # a symbol's number: its piece's id, or beyond them its code point
        self.of_char = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.of_char[ord(p)] = i
        number = lambda s: self.id[s] if s in self.id else n + ord(s)
        fits = lambda s: len(s) == 1 or s in self.id
        found = {number(p[:k]) << 32 | number(p[k:]): i for p, i in self.id.items() for k in range(1, len(p)) if fits(p[:k]) and fits(p[k:])}
        # a hash table of pairs; the last slot is that of all pairs that make nothing
        self.slots = 2 << max(4, len(found).bit_length())
        self.pairs, self.made = np.full(self.slots + 1, -1), np.full(self.slots + 1, -1, np.int32)
        keys, made = np.array([*found], np.int64), np.array([*found.values()], np.int32)
        at = self._slot(keys)
        while len(keys):  # each round keys that find their slot empty take it, of several one
            empty = np.flatnonzero(self.pairs[at] < 0)
            self.pairs[at[empty]] = keys[empty]
            there = self.pairs[at] == keys
            self.made[at[there]] = made[there]
            keys, made, at = keys[~there], made[~there], at[~there] + 1 & self.slots - 1
        ranks = np.full(n + 1, NONE, np.int32)
        ranks[[*self.id.values()]] = [self.rank[p] for p in self.id]
        self.ranks = ranks[self.made]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(GOLDEN) >> np.uint64(65 - self.slots.bit_length())).view(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of pairs of symbols, for ``made`` and ``ranks``; a symbol below 0 stands for none."""
        keys = left.astype(np.int64) << 32 | right
        at = self._slot(keys)
        there = self.pairs[at]
        on = np.flatnonzero((there != keys) & (there >= 0))
        while len(on):  # taken by another pair
            at[on] = at[on] + 1 & self.slots - 1
            there[on] = self.pairs[at[on]]
            on = on[(there[on] != keys[on]) & (there[on] >= 0)]
        return np.where((there == keys) & (keys >= 0), at, self.slots)

    def encode_unit(self, unit: str, skips: Iterable[int] = ()) -> tuple[int, list[int]]:
        """(candidates that come up, pieces) of the unit where the candidates of these ascending numbers are skipped."""
        if unit in (SPACE, "\n"):  # a literal U+2581 goes as bytes, or it would come back as a space
            return 0, [self.byte[b] for b in unit.encode()]
        symbol = [*unit.replace(" ", SPACE)]
        n, rank = len(symbol), self.rank
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        agenda = [r << 32 | i for i in range(n - 1) if (r := rank.get(symbol[i] + symbol[i + 1])) is not None]
        heapq.heapify(agenda)
        skips, count = iter(skips), 0
        skip = next(skips, -1)
        pop, push, get = heapq.heappop, heapq.heappush, rank.get
        while agenda:
            entry = pop(agenda)
            i = entry & 0xFFFFFFFF
            if not (left := symbol[i]) or (j := after[i]) >= n or get(made := left + symbol[j]) != entry >> 32:
                continue  # a neighbour has been merged meanwhile
            count += 1
            if count > skip >= 0:
                skip = next(skips, -1)
                continue  # dropped
            symbol[i], symbol[j] = made, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get(made + symbol[k])) is not None:
                    push(agenda, r << 32 | i)
            if (k := before[i]) >= 0 and (r := get(symbol[k] + made)) is not None:
                push(agenda, r << 32 | k)
        ids, out, i = self.id, [], 0
        while i < n:
            s = symbol[i]
            if (x := ids.get(s)) is not None:
                out.append(x)
            else:
                out += [self.byte[b] for b in (" " if s == SPACE else s).encode()]
            i = after[i]
        return count, out

    def decode(self, ids: list[int]) -> str:
        """The text; the space that encoding puts in front goes."""
        raw = b"".join(map(self.surface.__getitem__, ids)).decode(errors="replace")
        return raw[1:] if raw[:1] == " " else raw


@cache
def pieces(path: str | None) -> Pieces:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    return Pieces(path)


def mixed(x, mask=MASK):
    """A hash of a 64-bit number (the finish of SplitMix64), or of each one of an array."""
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
    x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
    return x ^ x >> 31


class Encoder:
    """Encodes whole texts; remembers what units become without skips, never what a key gave. ``variants``: documents share that many keys; without it each has its own."""

    def __init__(self, vocabulary: Pieces, dropout: float, seed: int, variants: int | None = None):
        self.p, self.dropout, self.seed, self.variants = vocabulary, dropout, seed, variants
        # a hash passes over at least g candidates below the g-th of these from the end
        self.limits = [min(MASK, int((1 - dropout) ** g * 2**64)) for g in range(FAR, 0, -1)]
        self.limits_array = np.array(self.limits, np.uint64)
        self._forget()

    def _forget(self) -> None:
        """Number of each unit, and by number: candidates that come up and place of its pieces in the pool; long units have FAR."""
        self.known: dict[str, int] = {}
        self.count, self.first, self.pool = np.empty(0, np.int64), np.zeros(1, np.int64), np.empty(0, np.int32)

    def _gaps(self, turns: np.ndarray) -> np.ndarray:
        """Candidates that come up before the next one is skipped."""
        if self.dropout <= 0:
            return np.full(len(turns), FAR)
        return FAR - np.searchsorted(self.limits_array, mixed(turns), "right")

    def _skips(self, start: int) -> Iterator[int]:
        """Numbers of the candidates that are skipped where the unit's hash is ``start``."""
        number, limits, turn = 0, self.limits, start
        while self.dropout > 0:
            gap = FAR - bisect_right(limits, mixed(turn))
            number += gap
            if gap < FAR:
                yield number
                number += 1
            turn = turn + GOLDEN & MASK

    def _in_step(self, units: list[str], turns: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(candidates that came up, number of pieces, pieces one unit after another) of short units; without ``turns`` nothing is skipped."""
        n = np.fromiter(map(len, units), np.int64, len(units))
        code = np.frombuffer("".join(units).replace(" ", SPACE).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, starts = self.p.of_char[code], np.cumsum(n) - n
        came, size, done = np.zeros(len(units), np.int64), np.zeros(len(units), np.int64), []
        for low, width in zip((0, *WIDTHS), WIDTHS):
            column, all_ = np.arange(width), np.flatnonzero((n > low) & (n <= width))
            for of in (all_[k : k + ROWS] for k in range(0, len(all_), ROWS)):
                table = np.where(column < n[of, None], symbols[np.minimum(starts[of, None] + column, len(symbols) - 1)], np.int32(-1))
                for rows, left, count in self._rounds(table, None if turns is None else turns[of]):
                    came[of[rows]] = count
                    size[of[rows]], pieces = self._pieces(left)
                    done.append((of[rows], pieces))
        # pieces stand by table and round; put them in the order of the units
        order, flat = (np.concatenate([x[k] for x in done]) if done else np.empty(0, np.int64) for k in (0, 1))
        ends = np.cumsum(size[order])
        begin = np.empty(len(units), np.int64)
        begin[order] = ends - size[order]
        return came, size, flat[ranges(begin, size)].astype(np.int32)

    def _rounds(self, symbol: np.ndarray, turns: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(rows, their symbols, round) as agendas run empty. Each round every agenda gives up its best candidate, the leftmost of equals, to be merged or skipped."""
        p, rows, column = self.p, np.arange(len(symbol)), np.arange(symbol.shape[1])
        # the rank of each symbol and the next one; the last column stays empty
        rank = np.full(symbol.shape, NONE, np.int32)
        row, at = np.nonzero(symbol[:, 1:] >= 0)
        rank[row, at] = p.ranks[p.pair(symbol[row, at], symbol[row, at + 1])]
        skip = None if turns is None else self._gaps(turns)
        number = 0
        while len(rows):
            at = rank.argmin(axis=1)
            live = rank[np.arange(len(rows)), at] != NONE
            if not live.all():
                yield rows[~live], symbol[~live], number
                rows, symbol, rank, at = rows[live], symbol[live], rank[live], at[live]
                if skip is not None:
                    skip, turns = skip[live], turns[live]
            merged, k = slice(None), np.arange(len(rows))
            if skip is not None and len(dropped := np.flatnonzero(skip == number)):
                rank[dropped, at[dropped]] = NONE
                merged = k[skip != number]
                turns[dropped] += np.uint64(GOLDEN)
                skip[dropped] += 1 + self._gaps(turns[dropped])
            s, r, i = symbol[merged], rank[merged], at[merged]
            k, behind = k[: len(s)], column[:-1] > i[:, None]
            made = p.made[p.pair(s[k, i], s[k, i + 1])]
            s[:, :-1], s[:, -1] = np.where(behind, s[:, 1:], s[:, :-1]), -1
            r[:, :-1] = np.where(behind, r[:, 1:], r[:, :-1])
            s[k, i] = made
            r[k, i] = p.ranks[p.pair(made, s[k, np.minimum(i + 1, len(column) - 1)])]
            k, i, made = k[i > 0], i[i > 0], made[i > 0]
            r[k, i - 1] = p.ranks[p.pair(s[k, i - 1], made)]
            symbol[merged], rank[merged] = s, r
            number += 1

    def _pieces(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of pieces of each row, pieces); a character without a piece goes as bytes."""
        flat, n = symbol[symbol >= 0], (symbol >= 0).sum(axis=1)
        n_pieces = len(self.p.surface)
        strange, out = flat >= n_pieces, flat
        if strange.any():
            row, parts = np.repeat(np.arange(len(n)), n), []
            for k in np.flatnonzero(strange).tolist():
                c = chr(flat[k] - n_pieces)
                parts.append([self.p.byte[b] for b in (" " if c == SPACE else c).encode()])
                n[row[k]] += len(parts[-1]) - 1
            cuts = np.split(out, np.flatnonzero(strange))
            out = np.concatenate([cuts[0], *(y for part, cut in zip(parts, cuts[1:]) for y in (part, cut[1:]))])
        return n, out

    def _learn(self, units: list[str]) -> None:
        short = [u for u in units if len(u) <= SHORT and u not in ("\n", SPACE)]
        alone = [u for u in units if len(u) > SHORT or u in ("\n", SPACE)]
        came, size, pieces = self._in_step(short, None)
        bytes_ = [[] if len(u) > SHORT else self.p.encode_unit(u)[1] for u in alone]
        self.known.update(zip([*short, *alone], range(len(self.known), len(self.known) + len(units))))
        self.count = np.concatenate([self.count, came, [FAR if len(u) > SHORT else 0 for u in alone]]).astype(np.int64)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.r_[size, np.array([*map(len, bytes_)], np.int64)])])
        self.pool = np.concatenate([self.pool, pieces, *bytes_]).astype(np.int32)

    def many(self, texts: list[str], keys: list[str]) -> list[np.ndarray]:
        """The pieces of each text. Texts are encoded together, and very long ones in parts, at about TOGETHER units at a time."""
        out, now, held = [[] for _ in texts], [], 0

        def flush() -> None:
            for (n, *_), found in zip(now, self._together([x[1:] for x in now])):
                out[n].append(found)
            now.clear()

        for n, (text, key) in enumerate(zip(texts, keys)):
            units = UNITS(" " + text) if text else []
            for at in range(0, len(units) or 1, TOGETHER):
                now.append((n, units[at : at + TOGETHER], key, at))
                held += len(now[-1][1])
                if held >= TOGETHER:
                    flush()
                    held = 0
        flush()
        return [np.concatenate(parts) for parts in out]

    def _together(self, texts: list[tuple[list[str], str, int]]) -> list[np.ndarray]:
        """Pieces of (units, key of the text, place of the first unit in it)."""
        seed, bases = self.seed & MASK, []
        for _, key, _ in texts:
            base = xxhash.xxh64_intdigest(key, seed)
            bases.append(xxhash.xxh64_intdigest(str(base % self.variants), seed) if self.variants else base)
        units = [u for part, _, _ in texts for u in part]
        n = np.array([len(part) for part, _, _ in texts], np.int64)
        ends = np.cumsum(n)
        place = np.arange(len(units)) - np.repeat(ends - n - np.array([at for _, _, at in texts], np.int64), n)
        turns = mixed(np.repeat(np.array(bases, np.uint64), n) + place.astype(np.uint64))
        if len(self.known) > CACHE:
            self._forget()
        if new := [u for u in dict.fromkeys(units) if u not in self.known]:
            self._learn(new)
        unit = np.fromiter(map(self.known.__getitem__, units), np.int64, len(units))
        first, size = self.first[unit], self.first[unit + 1] - self.first[unit]
        # the others have no skip among the candidates that come up
        varied = np.flatnonzero((self._gaps(turns) < self.count[unit]) | (self.count[unit] == FAR))
        long = self.count[unit[varied]] == FAR
        short, long = varied[~long], varied[long]
        _, short_size, short_pieces = self._in_step([units[k] for k in short.tolist()], turns[short])
        pools, at = [self.pool, short_pieces], len(self.pool) + len(short_pieces)
        size[short], first[short] = short_size, len(self.pool) + np.cumsum(short_size) - short_size
        for k in long.tolist():
            pieces = self.p.encode_unit(units[k], self._skips(int(turns[k])))[1]
            pools.append(np.array(pieces, np.int32))
            first[k], size[k] = at, len(pieces)
            at += len(pieces)
        flat = np.concatenate(pools)[ranges(first, size)]
        edges = np.r_[0, np.cumsum(size)][np.r_[0, ends]]
        return [flat[i:j] for i, j in zip(edges, edges[1:])]

    def __call__(self, text: str, key: str) -> np.ndarray:
        return self.many([text], [key])[0]


def ranges(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places from each first one on, as many as its size."""
    ends = np.cumsum(size)
    return np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


@cache
def encoder_of(model: str | None, dropout: float, seed: int, variants: int | None) -> Encoder:
    """One a worker process, so that its memory lasts from task to task."""
    return Encoder(pieces(model), dropout, seed, variants)


def encode(docs: DataFrame, model: str | None = None, dropout: float = 0.1, seed: int = 11, variants: int | None = None, id_col: str = "doc_id", text_col: str = "text", with_pieces: bool = True) -> DataFrame:
    """Pieces of every whole text: id, pieces (unless ``with_pieces`` is off), n_pieces, pieces_hash, lossless (whether decoding gives the text back).

    ``model``: path of the model on each worker, by default that of the installed public tokenizers. With dropout 0 the pieces are
    the library's (but for a literal U+2581, which goes as bytes). Otherwise the hash's key is the seed, the id (or which of
    ``variants`` it falls to, if given) and the place of the unit: reruns agree, documents and occurrences differ. One keyed hash draws how many candidates come up until the next one is skipped, so that
    each is skipped with the share of ``dropout``, as if it had a hash of its own. Null and empty texts have no pieces; rows that repeat get
    the same ones; a null id is a key of its own; texts may be of any length and are read whole; an empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)

    def make():
        vocabulary = pieces(model)
        encoder = encoder_of(model, dropout, seed, variants)

        def step(batch):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            out = encoder.many(texts, [*map(str, batch.column(0).to_pylist())])
            n = [*map(len, out)]
            hashes = np.array([xxhash.xxh3_64_intdigest(x.astype("<u4").tobytes()) for x in out], np.uint64).view(np.int64)
            same = [vocabulary.decode(x.tolist()) == t for x, t in zip(out, texts)]
            lists = [pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(np.concatenate([*out, np.empty(0, np.int32)])))] if with_pieces else []
            return [batch.column(0), *lists, n, hashes, same]

        return step

    kind = docs.select(id_col).dtypes[0][1]
    return map_columns(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, {'pieces array<int>, ' * with_pieces}n_pieces int, pieces_hash long, lossless boolean")


def decode(encoded: DataFrame, model: str | None = None, id_col: str = "doc_id", pieces_col: str = "pieces") -> DataFrame:
    """id, text of each row's pieces; null pieces give a null text, no pieces an empty one."""

    def make():
        vocabulary = pieces(model)
        return lambda batch: [batch.column(0), [None if x is None else vocabulary.decode(x) for x in batch.column(1).to_pylist()]]

    kind = encoded.select(id_col).dtypes[0][1]
    return map_columns(encoded.select(id_col, pieces_col), make, f"`{id_col}` {kind}, text string")
