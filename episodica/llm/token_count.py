"""Token counts by heap-and-linked-list byte-pair merging; no identifiers are emitted."""

from __future__ import annotations

import heapq
import json
from functools import cache

from pyspark.sql import DataFrame

from .common import map_columns, small_batches

#: Pieces whose counts a worker remembers.
CACHE = 600_000
#: Pieces longer than this aren't remembered.
CACHED_CHARS = 40
# Fixed value: the pattern by which byte-level BPE tokenizers split text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class Merges:
    """Merge ranks of a byte-level BPE vocabulary file; ``count`` is symbols minus merges."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec["model"]["type"] != "BPE":
            raise ValueError(f"{path}: only plain byte-level BPE vocabularies are supported")
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        symbols = {s: b for b, s in enumerate(byte_symbols())}
        # a symbol's number: its byte, or 256 plus the rank of the first merge that makes it
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[symbols[left] << 20 | symbols[right]] = r
            self.made.append(symbols.setdefault(left + right, 256 + r))

    def count(self, piece: bytes) -> int:
        """Tokens of one piece: pop the lowest-rank adjacent pair until none is left."""
        n = left = len(piece)
        if n < 2:
            return n
        rank, made = self.rank, self.made
        symbol, after, before = [*piece, -1], [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [r << 32 | i for i in range(n - 1) if (r := rank.get(symbol[i] << 20 | symbol[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            r, i = entry >> 32, entry & 0xFFFFFFFF
            if symbol[i] < 0 or (j := after[i]) >= n or rank.get(symbol[i] << 20 | symbol[j]) != r:
                continue  # one of the two has been merged meanwhile
            symbol[i], symbol[j], left = made[r], -1, left - 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(symbol[i] << 20 | symbol[k])) is not None:
                    heapq.heappush(heap, r << 32 | i)
            if (k := before[i]) >= 0 and (r := rank.get(symbol[k] << 20 | symbol[i])) is not None:
                heapq.heappush(heap, r << 32 | k)
        return left


@cache
def counter(path: str):
    """A function from a text to its number of tokens; one a worker process, so that its memory lasts from task to task."""
    import regex

    merges = Merges(path)
    pieces = regex.compile(PATTERN).findall
    special = regex.compile("|".join(map(regex.escape, merges.special))) if merges.special else None

    class Known(dict):
        def __missing__(self, piece: str) -> int:
            n = merges.count(piece.encode())
            if len(piece) <= CACHED_CHARS:
                if len(self) >= CACHE:
                    self.clear()
                self[piece] = n
            return n

    known = Known().__getitem__

    def tokens(text: str) -> int:
        if special is None or not special.search(text):
            return sum(map(known, pieces(text)))
        parts = special.split(text)
        return len(parts) - 1 + sum(sum(map(known, pieces(p))) for p in parts)

    return tokens


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text: id, n_bytes, n_tokens, over_limit.

    ``vocabulary``: path of a byte-level BPE file on each worker; by default that of the installed public tokenizers.
    A null or empty text has 0 bytes and 0 tokens; rows that repeat are counted each, and a null id stays null.
    Special strings inside a text count as one token each. Texts of any length are counted whole; an empty table gives no rows. Other columns of ``docs`` are ignored.
    """
    small_batches(docs.sparkSession)

    def make():
        if vocabulary is None:
            import public_tokenizers

            tokens = counter(public_tokenizers.path("byte_bpe_50k.json"))
        else:
            tokens = counter(vocabulary)

        def step(batch):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [*map(tokens, texts)]
            return [batch.column(0), [len(t.encode()) for t in texts], counts, [n > limit for n in counts]]

        return step

    kind = docs.select(id_col).dtypes[0][1]
    return map_columns(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
