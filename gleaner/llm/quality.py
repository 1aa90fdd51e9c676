"""Quality scores from pairwise preferences (Bradley-Terry).

Every text becomes a few whole-text measures.  Weights are learned so that the
logistic loss of score differences is least over pairs of a better and a worse
labelled text.  The cut between good and bad is a quantile of the scores of
the labelled texts, and the logistic curve through it gives scores of 0 to 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rolling import U64, mix
from .runtime import content_key
from .shingles import windows, word_hashes

#: Classes of bytes: lower case, upper case, digits, sentence marks, other marks, space, line ends, bytes of other scripts.
_CLASS = np.full(256, 4, np.uint8)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[ord("0") : ord("9") + 1] = 2
_CLASS[list(b".,;:'\"()-?")] = 3
_CLASS[list(b" \t\r\v\f")] = 5
_CLASS[10] = 6
_CLASS[128:] = 7

NAMES = (
    "words", "word_bytes", "upper", "digits", "sentence_marks", "marks", "marked_words", "upper_words", "line_words", "distinct_words", "top_word", "next_equal",
    "repeated_pairs", "repeated_fives", "repeated_lines", "distinct_per_root", "short_text", "sentence_words", "long_words", "control",
)


def measures(text: bytes) -> np.ndarray:
    """The measures of one text, each between about 0 and 5; empty texts have a fixed place."""
    out = np.zeros(len(NAMES))
    data = np.frombuffer(text, np.uint8)
    words = word_hashes(text)
    n = len(words)
    if not n:
        out[[0, 16, 19]] = 0, 1, 5
        return out
    kinds = _CLASS[data]
    count = np.bincount(kinds, minlength=8).astype(float)
    letters = max(count[0] + count[1] + count[7] / 2, 1)
    inside = max(len(data) - count[5] - count[6], 1)
    spaces = np.concatenate((np.zeros(1, bool), (kinds == 5) | (kinds == 6), np.ones(1, bool)))
    word_of = np.cumsum(np.concatenate(([True], (~spaces[1:-1]) & np.concatenate(([True], spaces[1:-2])))))[1:] - 1
    solid = ~spaces[1:-1]
    at = word_of[solid]
    at = at - at[0]
    odd = np.bincount(at, weights=(kinds[solid] == 4), minlength=n)
    upper = np.bincount(at, weights=(kinds[solid] == 1), minlength=n)
    lower = np.bincount(at, weights=(kinds[solid] == 0), minlength=n)
    size = np.bincount(at, minlength=n)
    _, often = np.unique(words, return_counts=True)
    two, five = (np.unique(windows(words, k), return_counts=True)[1] if n > k else np.ones(1, int) for k in (2, 5))
    lines = [x for x in text.split(b"\n") if x.strip()]
    marks = float(count[3])
    out[:] = (
        np.log1p(n) / 2,
        min(inside / n / 4, 5),
        count[1] / letters * 2,
        min(count[2] / inside * 10, 5),
        min(count[3] / n * 4, 5),
        min(count[4] / inside * 10, 5),
        (odd > 0).mean() * 4,
        ((upper > 1) & (lower == 0)).mean() * 4,
        min(np.log1p(n / len(lines)) / 2, 5),
        len(often) / n,
        often.max() / n * 2 if n > 20 else 0.2,
        (words[1:] == words[:-1]).mean() * 4 if n > 1 else 0,
        (1 - len(two) / two.sum()) * 2,
        (1 - len(five) / five.sum()) * 4,
        (1 - len(set(lines)) / len(lines)) * 2,
        min(len(often) / np.sqrt(n) / 5, 5),
        1 / n,
        min(np.log1p(n / max((data == 46).sum(), 1)) / 2, 5),
        (size > 24).mean() * 4,
        min(marks / inside * 10, 5),
    )
    return out


def _expanded(x: np.ndarray) -> np.ndarray:
    """Measures, their squares and their roots, so that a score may bend."""
    return np.hstack((x, x * x, np.sqrt(np.maximum(x, 0))))


@dataclass(frozen=True)
class Ranking:
    """Fitted on preference pairs; everything a score needs."""

    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float
    at_cut: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((_expanded(x) - self.centre) / self.spread, -8, 8) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the quantile that parts good from bad gets ``at_cut``."""
        z = self.slope * (self.raw(x) - self.cut) + np.log(self.at_cut / (1 - self.at_cut))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, label: np.ndarray, at_cut: float = 0.3, pairs: int = 100_000, ridge: float = 1e-3, seed: int = 11, rounds: int = 40) -> Ranking:
    """Weights by Newton steps on the logistic loss of differences over up to
    ``pairs`` seeded pairs of a better and a worse text, each text in about as
    many pairs as others of its label.  Without texts of both labels, every
    text scores the share of good ones (a half without any)."""
    wide = _expanded(x)
    centre, spread = (wide.mean(0), wide.std(0) + 1e-3) if len(x) else (np.zeros(wide.shape[1]), np.ones(wide.shape[1]))
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    weights = np.zeros(wide.shape[1])
    if not len(good) or not len(bad):
        share = min(max(float(label.mean()) if len(label) else 0.5, 0.01), 0.99)
        return Ranking(centre, spread, weights, 0.0, 1.0, share)
    rng = np.random.default_rng(seed)
    n = min(pairs, 20 * max(len(good), len(bad)))
    z = np.clip((wide - centre) / spread, -8, 8)
    d = z[np.resize(rng.permutation(good), n)] - z[rng.permutation(np.resize(bad, n))]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(d @ weights, -30, 30)))  # of preferring the worse
        gradient = ridge * weights - d.T @ p / n
        hessian = (d * (p * (1 - p))[:, None]).T @ d / n + np.eye(len(weights)) * ridge
        step = np.linalg.solve(hessian, gradient)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    raw = z @ weights
    # The quantile at which the labelled scores part with the fewest errors.
    order = np.argsort(raw, kind="stable")
    sorted_label = label[order]
    errors = np.concatenate(([0], np.cumsum(sorted_label == 1))) + np.concatenate((np.cumsum((sorted_label == 0)[::-1])[::-1], [0]))
    best = np.flatnonzero(errors == errors.min())
    k = int(best[len(best) // 2])
    ends = np.concatenate(([raw[order[0]] - 1], raw[order], [raw[order[-1]] + 1]))
    cut = float((ends[k] + ends[k + 1]) / 2)
    slope = 1.0
    for _ in range(rounds):  # one-dimensional logistic fit through the cut
        t = np.clip(raw - cut, -50, 50)
        p = 1 / (1 + np.exp(-np.clip(slope * t, -30, 30)))
        slope += float((t * (label - p)).mean() - 1e-3 * slope) / (float((t * t * p * (1 - p)).mean()) + 1e-2)
        slope = min(max(slope, 0.05), 10.0)
    return Ranking(centre, spread, weights, cut, slope, at_cut)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = np.stack([measures(t.as_buffer().to_pybytes()) for t in batch.column("text")])
            kept = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.reshape(-1)))], [*kept, "x"])


def is_held_out(doc_id: str = "doc_id", folds: int = 5):
    """Whether the crc32 of the id, written as text, is divisible by ``folds``; false without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, sample: int = 12_000, at_cut: float = 0.3) -> Ranking:
    """Fits on at most ``sample`` labelled texts, the first by a hash of their
    id, none of them held out.  Labels other than 0 and 1 and rows without an
    id are left out; a doc_id with both labels counts as 0, and one with several
    texts is fitted by one of them, the first by a hash of the text."""
    known = labels.where("quality in (0, 1) and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    known = known.where(~is_held_out())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), content_key("text").alias("hash"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    # At most ``sample`` rows of two numbers, so the broadcast is bounded; one row
    # an id comes back, however often its text is repeated.
    measured = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", "hash", "text").mapInArrow(_measured, "doc_id long, quality int, hash long, x array<double>")
    rows = measured.groupBy("doc_id", "quality").agg(F.min_by("x", "hash").alias("x")).toPandas().sort_values("doc_id")
    x = np.stack(rows["x"].to_list()) if len(rows) else np.empty((0, len(NAMES)))
    return fit(x, rows["quality"].to_numpy(float), at_cut)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = model.value
        for batch in batches:
            if batch.num_rows:
                x = np.stack([measures(t.as_buffer().to_pybytes()) for t in batch.column("text")])
                kept = [batch.column(c) for c in batch.schema.names if c != "text"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(ranking.scores(x))], [*(c for c in batch.schema.names if c != "text"), "score"])

    return run


def score_quality(documents: DataFrame, labels: DataFrame, sample: int = 12_000, at_cut: float = 0.3) -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, score (0 to 1, from
    the text alone), predicted (1 if score >= at_cut, else 0).

    Null texts are empty; empty texts and texts of white space all get one
    score, which the labels of such texts, if any, decide.  Rows without a
    doc_id are scored and count as not held out; rows that repeat one get equal
    scores for equal texts.  Without usable labels every score is a half.
    Other columns are not looked at.
    """
    ranking = documents.sparkSession.sparkContext.broadcast(train(documents, labels, sample, at_cut))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    scored = texts.mapInArrow(_scored(ranking), "doc_id long, score double")
    return scored.select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= at_cut).cast("int").alias("predicted"))


def _kept(model, at_cut: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranking = model.value
        for batch in batches:
            if batch.num_rows:
                texts = batch.column("text").to_pylist()
                x = np.stack([measures((t or "").encode()) for t in texts])
                yield batch.filter(pa.array(ranking.scores(x) >= at_cut))

    return run


def keep_good(documents: DataFrame, labels: DataFrame, sample: int = 12_000, at_cut: float = 0.3) -> DataFrame:
    """``documents``, all columns, without the rows that score below ``at_cut``."""
    ranking = documents.sparkSession.sparkContext.broadcast(train(documents, labels, sample, at_cut))
    return documents.mapInArrow(_kept(ranking, at_cut), documents.schema)
