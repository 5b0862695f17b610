"""Language identification: averaged hashed subword embeddings, a linear softmax, SGD in numpy, calibrated rejection."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hash_share, map_columns, row_hash, small_batches

WORDS = re.compile(r"[^\W\d_]+").findall
#: Words whose sums a worker remembers, besides those of the batch at hand.
CACHE = 400_000


@dataclass(frozen=True)
class Settings:
    """``train_docs`` bounds the labelled sample that the driver gets: about as many of each language, at least one. A model has a weight for each bucket and language."""

    buckets: int = 1 << 15
    dim: int = 16
    least: int = 2
    most: int = 4
    train_docs: int = 1500
    epochs: int = 12
    rate: float = 0.5
    #: Share of the sample kept from training, for temperature and rejection.
    calibration: float = 0.2
    #: Share of right calibration answers that the rejection threshold still accepts.
    accepted: float = 0.99
    seed: int = 17


def lettered(words) -> list[str]:
    """The words that have a letter: the pattern also lets numerals through that aren't digits, such as ² or Ⅷ."""
    return [w for w in words if w.isalpha() or any(map(str.isalpha, w))]


def subwords(words: list[str], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashed character n-grams of the words with their ends marked, and the whole words: (buckets, number of the word) pairs, by word."""
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    owner = np.repeat(np.arange(len(words)), lengths)
    code = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    whole = np.fromiter((xxhash.xxh64_intdigest(w, s.seed) for w in words), np.uint64, len(words))
    out = [((whole % np.uint64(s.buckets)).astype(np.int64), np.arange(len(words)))]
    for n in range(s.least, s.most + 1):
        if n <= len(code):
            h = np.full(len(code) - n + 1, 14695981039346656037 - n, dtype=np.uint64)
            for k in range(n):  # one step a character, for all n-grams at once
                h = (h ^ code[k : k + len(h)]) * np.uint64(1099511628211)
            inside = owner[: len(h)] == owner[n - 1 :]
            h = h[inside]
            out.append((((h ^ (h >> np.uint64(29))) % np.uint64(s.buckets)).astype(np.int64), owner[: len(inside)][inside]))
    return out


def sums_by_word(table: np.ndarray, words: list[str], s: Settings) -> np.ndarray:
    """For each word the sum of its subwords' rows of ``table`` and, last, how many they are."""
    out = np.zeros((len(words), table.shape[1] + 1))
    for ids, owner in subwords(words, s):
        if len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[starts], :-1] += np.add.reduceat(table[ids], starts, axis=0)
            out[owner[starts], -1] += np.diff(np.r_[starts, len(ids)])
    return out


@dataclass
class Model:
    """``logits``: what each bucket adds to each language's score; the mean over a text's subwords plus ``bias`` is softmaxed at ``temperature``."""

    langs: list[str]
    settings: Settings
    logits: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    history: list[float] = field(default_factory=list)
    #: Row of each word met so far in ``sums``: a worker keeps the broadcast model, so these last from task to task.
    known: dict[str, int] = field(default_factory=dict, repr=False, compare=False)
    sums: np.ndarray | None = field(default=None, repr=False, compare=False)

    def learned(self, words: set[str]) -> tuple[dict[str, int], np.ndarray]:
        """(row of each word, sums by row); a word without a letter adds nothing."""
        new = [*(words - self.known.keys())]
        if self.sums is None or len(self.known) + len(new) > CACHE:  # start anew with these words
            self.known.clear()
            self.sums, new = np.zeros((0, len(self.langs) + 1)), [*words]
        if new:
            rows = np.zeros((len(new), len(self.langs) + 1))
            if real := lettered(new):
                rows[[k for k, w in enumerate(new) if w.isalpha() or any(map(str.isalpha, w))]] = sums_by_word(self.logits, real, self.settings)
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.sums = np.concatenate([self.sums, rows])
        return self.known, self.sums

    def probabilities(self, totals: np.ndarray, n: np.ndarray) -> np.ndarray:
        z = (totals / np.maximum(n, 1)[:, None] + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def features(docs: DataFrame, s: Settings) -> DataFrame:
    """(lang, ids, counts) of the whole texts: distinct buckets and how often each occurs."""

    def make():
        def step(batch):
            found = []
            for text in batch.column(1).to_pylist():
                total = np.zeros(s.buckets)
                seen = Counter(WORDS((text or "").lower()))
                if words := lettered(seen):
                    times = np.fromiter((seen[w] for w in words), np.float64, len(words))
                    for ids, owner in subwords(words, s):
                        total += np.bincount(ids, times[owner], s.buckets)
                ids = np.flatnonzero(total)
                found.append((ids, total[ids].astype(np.int64)))
            return [batch.column(0), [x for x, _ in found], [x for _, x in found]]

        return step

    return map_columns(docs, make, "lang string, ids array<int>, counts array<int>")


def sampled(labelled: DataFrame, sizes: dict[str, int], quota: int, seed: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, text): of each language the first ``quota`` texts by a hash of id and text, all of a smaller one. ``sizes``: how many texts each language has."""
    # few rows of each language pass, so that the order of the others needn't be told: about twice the quota by their hash, or all of a small language
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, (2.0 * quota + 20) / n))]), F.col(lang_col))
    h = row_hash(id_col, text_col, seed=seed)
    drawn = labelled.where(hash_share(h, share)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), h.alias("h"))
    w = Window.partitionBy("lang").orderBy("h", "text")
    return drawn.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= quota).select("lang", "text")


def fit(docs: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from a hash-chosen sample of the labelled texts, about ``s.train_docs`` in all and as many of each language, one at least.

    The texts of a language are taken in the order of a hash of id and text. The driver gets one row a language and the sample; without any labelled text
    with a letter every language is as likely. Languages of any number are learned.
    """
    small_batches(docs.sparkSession)
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = labelled.groupBy(F.col(lang_col).alias("l")).agg(F.count("*").alias("n")).collect()
    langs = sorted(r["l"] for r in sizes)
    if not langs:
        return Model(["und"], s, np.zeros((s.buckets, 1), np.float32), np.zeros(1, np.float32))
    quota = max(1, s.train_docs // len(langs))
    picked = sampled(labelled, {r["l"]: r["n"] for r in sizes}, quota, s.seed, id_col, text_col, lang_col)
    rows = features(picked, s).toArrow()
    order = sorted(range(rows.num_rows), key=lambda k: (rows["lang"][k].as_py(), rows["ids"][k].as_py()))
    at = {x: k for k, x in enumerate(langs)}
    cases = [(at[rows["lang"][k].as_py()], rows["ids"][k].values.to_numpy(), rows["counts"][k].values.to_numpy()) for k in order if len(rows["ids"][k])]
    return train(cases, langs, s)


def train(cases: list[tuple[int, np.ndarray, np.ndarray]], langs: list[str], s: Settings) -> Model:
    """SGD over the cases one by one: mean embedding, softmax, cross entropy; then temperature and threshold on the cases kept apart."""
    rng = np.random.default_rng(s.seed)
    embed = rng.uniform(-0.5, 0.5, (s.buckets, s.dim)) / s.dim
    out, bias = np.zeros((len(langs), s.dim)), np.zeros(len(langs))
    mixed = rng.permutation(len(cases))
    held, used = mixed[: int(s.calibration * len(cases))], mixed[int(s.calibration * len(cases)) :]
    history, step, steps = [], 0, max(1, s.epochs * len(used))
    for _ in range(s.epochs):
        loss = 0.0
        for k in rng.permutation(used):
            lang, ids, counts = cases[k]
            share = counts / counts.sum()
            hidden = share @ embed[ids]
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            loss -= np.log(max(p[lang], 1e-12))
            p[lang] -= 1.0
            rate = s.rate * (1 - step / steps)
            back = out.T @ p
            out -= rate * np.outer(p, hidden)
            bias -= rate * p * 0.1
            # a mean spreads the gradient thinly, so embeddings move by a larger rate
            embed[ids] -= (rate * 50.0) * np.outer(share, back)
            step += 1
        history.append(loss / max(1, len(used)))
    model = Model(langs, s, (embed @ out.T).astype(np.float32), bias.astype(np.float32), history=history)
    if len(held):
        z = np.array([(c / c.sum()) @ model.logits[i] + model.bias for _, i, c in (cases[k] for k in held)])
        y = np.array([cases[k][0] for k in held])

        def nll(t: float) -> float:
            v = z / t
            v = v - v.max(axis=1, keepdims=True)
            return float(np.mean(np.log(np.exp(v).sum(axis=1)) - v[np.arange(len(y)), y]))

        model.temperature = min(np.geomspace(0.1, 10, 61), key=nll)
        p = np.exp(z / model.temperature - (z / model.temperature).max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        right = p.max(axis=1)[p.argmax(axis=1) == y]
        model.threshold = float(np.quantile(right, 1 - s.accepted)) if len(right) else 0.0
    return model


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: id, lang_pred, score, accepted.

    ``score`` is the calibrated probability of ``lang_pred``; ``accepted`` says whether it reaches the model's rejection threshold.
    A text that is null or has no letter gets ``und``, 0 and false; rows that repeat get the same answer; of equally likely languages the
    first by name is given; texts of any length are read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x languages, both bounded by the settings

    def make():
        m = shared.value
        n_lang = len(m.langs)

        def step(batch):
            texts = [WORDS(t.lower()) if t else [] for t in batch.column(1).to_pylist()]
            known, sums = m.learned(set().union(*texts))
            totals = np.array([sums[np.fromiter(map(known.__getitem__, t), np.int64, len(t))].sum(axis=0) for t in texts]).reshape(-1, n_lang + 1)
            n = totals[:, n_lang]
            p = m.probabilities(totals[:, :n_lang], n)
            best, lettered = p.argmax(axis=1), n > 0
            score = np.where(lettered, p.max(axis=1), 0.0)
            return [batch.column(0), [m.langs[k] if x else "und" for k, x in zip(best, lettered)], score, lettered & (score >= m.threshold)]

        return step

    kind = docs.select(id_col).dtypes[0][1]
    return map_columns(docs.select(id_col, text_col), make, f"`{id_col}` {kind}, lang_pred string, score double, accepted boolean")


def held_out(id_col: str = "doc_id"):
    """The contract's held-out rows: crc32 of the id as text leaves 1 when divided by 3; null ids aren't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify_held_out(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of all documents, learned from those that aren't held out."""
    model = fit(docs.where(~held_out()), s)
    return predict(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "accepted")
