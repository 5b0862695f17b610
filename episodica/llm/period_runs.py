"""Periodic runs in the words of a text, by online dyadic square catching.

Words are appended one after another. Each completed block of 2^k words at a multiple of 2^k is a catcher for the periods from 2^(k+1) - 1 to 2^(k+2) - 2: the second
half of any square of such a period holds a whole block, so the same words stand that far before it. What a catcher finds is compared to the left as far
as it goes, and to the right with every word that is appended, until a word differs. Squares of a period that touch merge into one stretch; a stretch of at least two
periods is a run of its smallest period. Periods up to 6 belong to the lowest blocks, whose first three words are their catchers, as a run has
at least 12 words and so six after its first period.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .common import map_columns, small_batches

#: Words that a run has at least.
LEAST = 12
#: Level of the lowest blocks, and the words of them that catch the periods below theirs.
LOWEST, SHORT = 2, 3


def same(s: str, i: int, j: int, most: int) -> int:
    """How many words from i on equal those from j on, at most ``most``."""
    n, step = 0, 4
    while n < most:
        step = min(step, most - n)
        if s[i + n : i + n + step] == s[j + n : j + n + step]:
            n, step = n + step, step * 4
        elif step == 1:
            return n
        else:
            step = max(1, step // 4)
    return n


def same_before(s: str, i: int, j: int, most: int) -> int:
    """How many words before i equal those before j, at most ``most``."""
    n, step = 0, 4
    while n < most:
        step = min(step, most - n)
        if s[i - n - step : i - n] == s[j - n - step : j - n]:
            n, step = n + step, step * 4
        elif step == 1:
            return n
        else:
            step = max(1, step // 4)
    return n


class Catchers:
    """The runs of a growing sequence of words; each word is one character of the strings that are appended."""

    def __init__(self):
        self.s = ""
        self.open: dict[int, int] = {}  # period: start of the stretch that the last word still continues
        self.ended: dict[int, int] = {}  # period: end of its last stretch
        self.found: dict[tuple[int, int], int] = {}  # start and end: smallest period
        self.within: list[tuple[int, int, int]] = []  # runs so far (period, start, end) whose inside needs no catchers of longer blocks

    def append(self, words: str) -> None:
        s, done = self.s + words, len(self.s)
        self.s, n = s, len(s)
        for q, start in list(self.open.items()):
            self._extend(q, start, done + same(s, done, done - q, n - done), done)
        size = 1 << LOWEST
        for at in range(max(0, done // size - 1) * size, n, size):
            end, near, far = at + size, max(0, at - 2 * size + 2), max(0, at - 4 * size + 2)
            # most blocks of plain text catch nothing, so that is asked first
            if done < at + SHORT <= n and s.find(s[at : at + SHORT], near, at + SHORT - 1) >= 0:
                self._catch(at, SHORT, 1, 2 * size - 2)
            if not done < end <= n:
                continue
            if s.find(s[at:end], far, max(0, end - 2 * size + 1)) >= 0:
                self._catch(at, size, 2 * size - 1, 4 * size - 2)
            block = 2 * size
            while not end & (block - 1) and end >= 3 * block:
                self._catch(end - block, block, 2 * block - 1, 4 * block - 2)
                block *= 2

    def _catch(self, at: int, size: int, low: int, high: int) -> None:
        """Squares of the periods low to high whose second half holds the block of ``size`` words at ``at``."""
        s, first, last = self.s, max(0, at - high), at - low
        if last < 0:
            return
        for q, start, end in self.within:
            # inside a run of a period that the block covers, the block comes again at multiples of that period only: squares of that run
            if q <= size and start <= last and at + size <= end:
                last = min(last, start - 1)
        block = s[at : at + size]
        where = s.find(block, first, last + size) if last >= first else -1
        while where >= 0:
            q = at - where
            if at + size > self.ended.get(q, 0) and q not in self.open:
                n = len(s)
                end = at + size + same(s, at + size, where + size, n - at - size)
                start = where - same_before(s, at, where, where)
                self._extend(q, start, end, at + size)
            where = s.find(block, where + 1, last + size)

    def _extend(self, q: int, start: int, end: int, now: int) -> None:
        """The stretch of period q from ``start`` reaches ``end`` so far; blocks up to ``now`` are done."""
        going_on = end == len(self.s)
        if going_on:
            self.open[q] = start
        else:
            self.open.pop(q, None)
            self.ended[q] = end
        if end - start < max(LEAST, 2 * q):
            return
        if not going_on:
            self.found[start, end] = min(q, self.found.get((start, end), q))
        self.within = [x for x in self.within if x[2] > now and x[:2] != (q, start)]
        self.within.append((q, start, end))

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of all runs, by start and period; those that the last word continues end there."""
        found, n = dict(self.found), len(self.s)
        for q, start in self.open.items():
            if n - start >= max(LEAST, 2 * q):
                found[start, n] = min(q, found.get((start, n), q))
        return sorted((start, end - start, q) for (start, end), q in found.items())


#: Different words that one character each can stand for.
CODES = 0x110000


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words."""
    number: dict = {}
    codes = [number.setdefault(w, len(number)) for w in words]
    if len(words) < LEAST or len(number) == len(words):
        return []
    catchers = Catchers()
    if len(number) <= CODES:
        catchers.append("".join(map(chr, codes)))
        return catchers.runs()
    # two characters a word, of alphabets that don't meet, so periods are even; a half word at an end of a stretch doesn't count
    catchers.append("".join(chr(0x8000 + (c >> 15)) + chr(c & 0x7FFF) for c in codes))
    found: dict = {}
    for start, length, q in catchers.runs():
        a, z, q = (start + 1) // 2, (start + length) // 2, q // 2
        if z - a >= max(LEAST, 2 * q):
            found[a, z] = min(q, found.get((a, z), q))
    return sorted((a, z - a, q) for (a, z), q in found.items())


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words outside of what runs repeat: of each run its first period stays, unless another run drops that."""
    out, at = [], 0
    for a, z in sorted((start + q, start + length) for start, length, q in runs):
        if a > at:
            out += words[at:a]
        at = max(at, z)
    return out + words[at:]


def find_runs(docs: DataFrame, edit: Callable[[object, list[bytes]], list[bytes]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of words of every whole text: id, n_words, runs (array of start, length, period), collapsed (the text without what runs repeat, words joined by a space).

    Words stand between white space of ASCII. A run is a stretch of at least 12 words and two of its smallest period q (words q apart are the same) that neither
    neighbour continues. ``edit`` changes the words of a text (id, words) before. A null text has no words, a text of few words no runs; rows
    that repeat are read each, and a null id stays null. An empty table gives no rows. Other columns are ignored.
    """
    small_batches(docs.sparkSession)

    def make():
        def step(batch):
            n_words, runs, texts = [], [], []
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = text.encode().split() if text else []
                words = edit(id_, words) if edit else words
                found = runs_of(words)
                n_words.append(len(words))
                runs.append([{"start": a, "length": n, "period": q} for a, n, q in found])
                texts.append(b" ".join(kept_words(words, found)).decode())
            return [batch.column(0), n_words, runs, texts]

        return step

    kind = docs.select(id_col).dtypes[0][1]
    return map_columns(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
