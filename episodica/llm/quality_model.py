"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

All grades share one weight vector, P(grade <= k) = sigmoid(threshold_k - score), with rising thresholds. Features are which words a text
has (hashed) and which shares of its tokens have which form (hashed shapes, repeats of the token before). An L1 penalty
keeps the weights of few features, so a model stays small and rare words don't add noise.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field
from functools import cache
from operator import itemgetter

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_share, map_columns, row_hash, small_batches

LETTERS = re.compile(r"[^\W\d_]+").findall
AGAIN = re.compile(r"(.)\1+", re.DOTALL).sub
#: Token types that a worker remembers, besides those of the batch at hand.
CACHE = 500_000
REPEAT = 1


@dataclass(frozen=True)
class Settings:
    """``train_docs`` bounds the rated sample that the driver gets; ``least_docs`` rated texts must have a feature for it to count."""

    train_docs: int = 6000
    least_docs: int = 4
    bits: int = 30
    penalty: float = 5e-4
    steps: int = 500
    seed: int = 23


@dataclass
class Model:
    """``ids``: the sorted hashed features that have a weight. Grades run from 0 to len(thresholds)."""

    ids: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    settings: Settings = Settings()
    losses: list[float] = field(default_factory=list)

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) of each score, a column for each k."""
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -60, 60)))


class _Forms(dict):
    """For str.translate: letters and digits to a, A or 0."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        self[code] = out = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        return out


FORMS = _Forms()


def shape(token: str) -> str:
    """Runs of lower case, upper case and digits as a, A, 0; each other run of one character once."""
    return AGAIN(r"\1", token.translate(FORMS))


class Tokens(dict):
    """Numbers token types and keeps, for each, its word's and its shape's feature."""

    def __init__(self, bits: int):
        self.bits, self.word, self.form = bits, array("q"), array("q")
        self.shapes = cache(lambda s: (xxhash.xxh64_intdigest("s" + s) & ((1 << bits) - 1)) | 1 << bits)

    def __missing__(self, token: str) -> int:
        k = self[token] = len(self.word)
        core = " ".join(LETTERS(token.lower()))
        self.word.append(xxhash.xxh64_intdigest("w" + core) & ((1 << self.bits) - 1) if core else -1)
        self.form.append(self.shapes(shape(token)))
        return k

    def start_anew_if_full(self) -> None:
        if len(self) > CACHE:
            self.clear()
            self.word, self.form = array("q"), array("q")
            self.shapes.cache_clear()

    def features(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(ids, values) of one text: 1 for each word that it has, and the shares of the forms."""
        tokens = text.split()
        seq = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        kinds, times = np.unique(seq, return_counts=True)
        pick = itemgetter(*kinds.tolist(), 0) if len(kinds) else lambda _: (0,)
        words = np.unique(np.array(pick(self.word)[:-1], np.int64))
        forms, which = np.unique(np.array(pick(self.form)[:-1], np.int64), return_inverse=True)
        share = np.bincount(which, times, len(forms)) / max(1, len(tokens))
        repeat = float((seq[1:] == seq[:-1]).mean()) if len(tokens) > 1 else 0.0
        words = words[words >= 0]
        return np.r_[words, forms, (2 << self.bits) + REPEAT], np.r_[np.ones(len(words)), 4 * share, 4 * repeat]


@cache
def tokens_of(bits: int) -> Tokens:
    """One a worker process, so that its memory lasts from task to task."""
    return Tokens(bits)


def rated_features(docs: DataFrame, bits: int) -> DataFrame:
    """(grade, ids, values) of rows (grade, text)."""
    small_batches(docs.sparkSession)

    def make():
        tokens = tokens_of(bits)

        def step(batch):
            tokens.start_anew_if_full()
            found = [tokens.features(t or "") for t in batch.column(1).to_pylist()]
            return [batch.column(0), [x for x, _ in found], [x for _, x in found]]

        return step

    return map_columns(docs, make, "grade int, ids array<long>, values array<double>")


def fit(docs: DataFrame, ratings: DataFrame, s: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade") -> Model:
    """Learn from ``ratings`` (id, grade from 0); a hash-chosen sample of about ``s.train_docs`` of them, joined to the texts as a broadcast of that bounded size.

    Ratings without an id or grade and texts that are null don't count; an id that is rated twice counts twice.
    """
    rated = ratings.where(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull())
    n = rated.count()
    picked = rated.where(hash_share(row_hash(id_col, seed=s.seed), min(1.0, s.train_docs / max(n, 1)))).limit(2 * s.train_docs)
    picked = picked.select(F.col(id_col).alias("rated_id"), F.col(grade_col).cast("int").alias("grade"))
    texts = docs.where(F.col(text_col).isNotNull()).join(F.broadcast(picked), F.col(id_col) == F.col("rated_id")).select("grade", F.col(text_col).alias("text"))
    rows = rated_features(texts, s.bits).limit(4 * s.train_docs).toArrow()
    cases = [(rows["grade"][k].as_py(), rows["ids"][k].values.to_numpy(), rows["values"][k].values.to_numpy()) for k in range(rows.num_rows)]
    cases.sort(key=lambda c: (c[0], len(c[1]), c[1].tobytes()))
    return train(cases, s)


def train(cases: list[tuple[int, np.ndarray, np.ndarray]], s: Settings) -> Model:
    """Proximal gradient steps on the cumulative-link likelihood with an L1 penalty on the weights; rare grades weigh more a text."""
    if not cases or len({c[0] for c in cases}) < 2:
        return Model(np.empty(0, np.int64), np.empty(0), np.full(1, -30.0), s)
    y = np.array([c[0] for c in cases])
    top = int(y.max())
    flat, value = np.concatenate([c[1] for c in cases]), np.concatenate([c[2] for c in cases])
    row = np.repeat(np.arange(len(cases)), [len(c[1]) for c in cases])
    ids, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
    keep = seen >= s.least_docs
    place = np.cumsum(keep) - 1
    used = keep[column]
    ids, column, row, value = ids[keep], place[column[used]], row[used], value[used]
    counts = np.bincount(y, minlength=top + 1)
    case_weight = (1 / np.sqrt(np.maximum(counts, 1)))[y]
    case_weight /= case_weight.sum()

    def loss_and_slope(w: np.ndarray, theta: np.ndarray):
        score = np.bincount(row, value * w[column], len(y))
        edges = np.r_[-np.inf, theta, np.inf]
        up, low = edges[y + 1] - score, edges[y] - score
        cdf = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
        a, b = np.where(np.isinf(up), 1.0, cdf(up)), np.where(np.isinf(low), 0.0, cdf(low))
        p = np.maximum(a - b, 1e-12)
        da, db = a * (1 - a), b * (1 - b)
        d_score = case_weight * -(db - da) / p
        d_theta = np.zeros(top)
        np.add.at(d_theta, np.minimum(y, top - 1), np.where(y < top, -case_weight * da / p, 0.0))
        np.add.at(d_theta, np.maximum(y - 1, 0), np.where(y > 0, case_weight * db / p, 0.0))
        return -(case_weight * np.log(p)).sum(), np.bincount(column, value * d_score[row], len(w)), d_theta

    # steps scaled by the running size of each slope; the penalty shrinks by the same step; thresholds stay ordered
    w, theta = np.zeros(len(ids)), np.linspace(-1, 0, top)
    size_w, size_t, losses = np.zeros(len(ids)), np.zeros(top), []
    for t in range(s.steps):
        loss, slope_w, slope_t = loss_and_slope(w, theta)
        size_w, size_t = 0.95 * size_w + 0.05 * slope_w**2, 0.95 * size_t + 0.05 * slope_t**2
        rate, warm = 0.2 / np.sqrt(1 + t / 10), 1 - 0.95 ** (t + 1)
        step_w, step_t = rate / (np.sqrt(size_w / warm) + 1e-4), rate / (np.sqrt(size_t / warm) + 1e-4)
        w = w - step_w * slope_w
        w = np.sign(w) * np.maximum(np.abs(w) - step_w * s.penalty, 0)
        theta = np.maximum.accumulate(theta - step_t * slope_t)
        losses.append(float(loss))
    kept = w != 0
    return Model(ids[kept], w[kept], theta, s, losses)


def grade(docs: DataFrame, model: Model, least_tail: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` as (r: the row, score, expected_grade, tail_probability of the highest grade, keep).

    ``keep``: the tail probability reaches ``least_tail``. A text that is null or has no word has nothing to grade: its
    values are null and it isn't kept. Rows that repeat get the same values; texts and tokens of any length are read whole; an empty table
    gives an empty result; other columns are carried, whatever their names. A model of no or one grade keeps what has a word.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most a weight for each feature of the bounded sample

    def make():
        m = shared.value
        tokens = tokens_of(m.settings.bits)

        def score(text: str | None) -> float | None:
            if not text or not text.strip():
                return None
            ids, values = tokens.features(text)
            at = np.searchsorted(m.ids, ids)
            hit = (at < len(m.ids)) & (m.ids[np.minimum(at, len(m.ids) - 1)] == ids) if len(m.ids) else np.zeros(len(ids), bool)
            return float(values[hit] @ m.weights[at[hit]]) if hit.any() else 0.0

        def step(batch):
            tokens.start_anew_if_full()
            scores = [score(t) for t in batch.column(1).to_pylist()]
            above = m.above(np.array([s or 0.0 for s in scores]))
            known = [s is not None for s in scores]
            tail = [float(a[-1]) if k else None for a, k in zip(above, known)]
            return [batch.column(0), scores, [float(a.sum()) if k else None for a, k in zip(above, known)], tail, [k and t >= least_tail for k, t in zip(known, tail)]]

        return step

    rows = docs.select(F.struct("*").alias("r"), F.col(text_col).alias("text"))
    return map_columns(rows, make, f"r {rows.schema['r'].dataType.simpleString()}, score double, expected_grade double, tail_probability double, keep boolean")


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): one for good quality and one for not being toxic, so 0, 1 or 2; rows that lack either aren't ratings."""
    return labels.where("quality is not null and toxic is not null").select("doc_id", (F.col("quality").cast("int") + 1 - F.col("toxic").cast("int")).alias("grade"))
