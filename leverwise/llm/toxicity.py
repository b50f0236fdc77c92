"""Toxic passages by maximum-scoring segments (operator 7).

Every word has a log-odds score from labelled documents: how much more toxic documents that hold it are than documents
at large. Rates are smoothed by a chain of Dirichlet priors: a word's prior is the rate of words that begin with the
same eight bytes, whose prior is that of six, of four, and of all documents. A linear-time scan finds all maximal
segments of positive total score. Segment scores of clean documents follow an extreme-value law, E = K n exp(-lambda S)
chance segments in n words; lambda is the root of the score distribution's generating function, K is fitted. The surplus
of the best segment over chance, the surplus of all significant ones and their number give the document's score through
a logistic calibration in which no document meets counts of its own.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverwise.llm.common import fold, ids_and_texts, map_arrow, stage
from leverwise.llm.text import ALPHANUMERIC, mix, run_hashes, words_of

# Labelled rows used for fitting, at most; above this they are thinned by a hash of their id.
FIT_ROWS = 20_000
PREFIXES = (4, 6, 8)
LEVELS = len(PREFIXES) + 1
BUCKETS = 1 << 19
# Rows a unit must occur in before it has a rate of its own.
LEAST_ROWS = 2
STRENGTH = 3.0
# Taken from every word's log-odds, so that ordinary words score below zero.
OFFSET = 1.0
SIGNIFICANT = 0.01
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1


def _units(part: np.ndarray, words) -> np.ndarray:
    """Bucket of each word at each level (levels x words)."""
    out = np.empty((LEVELS, len(words.hashes)), np.int64)
    for level, size in enumerate(PREFIXES):
        ends = np.minimum(words.ends, words.starts + size)
        out[level] = mix(run_hashes(part, words.starts, ends, ALPHANUMERIC.value)) >> np.uint64(64 - 19)
    out[LEVELS - 1] = mix(words.hashes) >> np.uint64(64 - 19)
    return out


@dataclass
class Model:
    """Counts of rows by level, label and bucket; totals; extreme-value and calibration parameters."""

    rows: np.ndarray
    total: np.ndarray
    rate: float = 1.0
    k: float = 1.0
    weights: np.ndarray | None = None

    def log_odds(self, units: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
        """Score of each word; ``label`` (per word) takes the word's own document out of the counts."""
        base = (self.total[1] + 0.5) / (self.total.sum() + 1.0)
        mean = np.full(units.shape[1], base)
        for level in range(LEVELS):
            clean, toxic = self.rows[level, 0, units[level]], self.rows[level, 1, units[level]]
            if label is not None:
                clean, toxic = np.maximum(clean - (label == 0), 0), np.maximum(toxic - (label == 1), 0)
            mean = (toxic + STRENGTH * mean) / (clean + toxic + STRENGTH)
        mean = np.clip(mean, 1e-6, 1 - 1e-6)
        return np.log(mean / (1 - mean)) - math.log(base / (1 - base)) - OFFSET

    def features(self, n: int, segments: list) -> tuple[float, float, float]:
        chance = math.log(self.k * max(n, 1))
        surplus = [self.rate * s[0] - chance for s in segments]
        clear = [x for x in surplus if x > -math.log(SIGNIFICANT)]
        best = max(surplus, default=-chance)
        return (min(max(best, -20.0), 40.0), min(sum(clear), 80.0) / 4, min(len(clear), 20))

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(rows), (self.total[1] + 0.5) / (self.total.sum() + 1.0))
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + rows @ self.weights[1:], -40, 40)))


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """All maximal segments (total, first word, end) of one text, by the linear-time method.

    Candidates are kept with the sums before and up to their end; only words above zero can begin or extend one.
    """
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    left, right, begin, end, back = [], [], [], [], []
    for i in np.flatnonzero(scores > 0).tolist():
        low, high, first = float(sums[i]), float(sums[i + 1]), i
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j = back[j]
            if j < 0 or right[j] >= high:
                break
            low, first = left[j], begin[j]
            del left[j:], right[j:], begin[j:], end[j:], back[j:]
        left.append(low)
        right.append(high)
        begin.append(first)
        end.append(i + 1)
        back.append(j)
    return [(r - lo, b, e) for lo, r, b, e in zip(left, right, begin, end, strict=True)]


def _scored(column: pa.Array, model: Model, labels: np.ndarray | None = None) -> Iterator[tuple]:
    """For each text: number of words, word scores, words' byte ranges."""
    for low, high, part, offsets, words in words_of(column, ALPHANUMERIC):
        own = None if labels is None else np.repeat(labels[low:high], np.diff(words.of))
        scores = model.log_odds(_units(part, words), own)
        for r in range(high - low):
            a, b = words.of[r], words.of[r + 1]
            yield int(b - a), scores[a:b], words.starts[a:b] - offsets[r], words.ends[a:b] - offsets[r]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that hold each unit, by label, summed within the task."""
    counts = np.zeros((LEVELS, 2, BUCKETS), np.int32)
    for batch in batches:
        labels = batch.column(1).to_numpy()
        for low, high, part, _, words in words_of(batch.column(0), ALPHANUMERIC):
            units = _units(part, words)
            row = np.repeat(np.arange(high - low), np.diff(words.of))
            for level in range(LEVELS):
                pair = np.unique(row * BUCKETS + units[level])
                np.add.at(counts[level], (labels[low + pair // BUCKETS], pair % BUCKETS), 1)
    flat = counts.reshape(-1)
    used = np.flatnonzero(flat)
    for begin in range(0, len(used), 100_000):
        some = used[begin : begin + 100_000]
        yield pa.record_batch([pa.array(some), pa.array(flat[some].astype(np.int64))], names=["cell", "n"])


def _calibrate(model: Model, examples: list) -> None:
    """lambda, K and the logistic weights from (label, words, segments, sum and number by score) of the sample."""
    clean = [e for e in examples if e.label == 0]
    if not clean or len(clean) == len(examples):
        return
    values = np.array([x for e in clean for x in e.values])
    often = np.array([x for e in clean for x in e.often], float)
    often /= often.sum()
    if (values > 0).any() and (values * often).sum() < 0:
        low, high = 0.0, 50.0
        for _ in range(80):
            middle = (low + high) / 2
            grown = (often * np.exp(np.minimum(middle * values, 500))).sum()
            low, high = (middle, high) if grown < 1 else (low, middle)
        model.rate = max(low, 0.05)
    spent = sum(e.n * math.exp(-model.rate * max((s[0] for s in _triples(e)), default=0.0)) for e in clean)
    model.k = max(len(clean) / max(spent, 1e-9), 1e-6)
    x = np.array([model.features(e.n, _triples(e)) for e in examples])
    y = np.array([e.label for e in examples], float)
    x = np.hstack([np.ones((len(x), 1)), x])
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -40, 40)))
        slope = x.T @ (y - p) - 0.1 * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(weights))
        step = np.linalg.solve(curve, slope)
        weights += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    model.weights = weights


def _triples(example) -> list[tuple[float, int, int]]:
    return [(s, 0, 0) for s in example.best]


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from labelled documents outside the held-out fold; only id, text and label are read.

    ``rows`` bounds the sample. What reaches the driver is bounded by the buckets and by this sample.
    """
    known = labels.select(F.col("doc_id").cast("bigint"), F.col("toxic").cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    )
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * rows / n))
    sample = stage(
        ids_and_texts(documents).join(F.broadcast(known), "doc_id").select("text", F.col("label").cast("int")), "toxic"
    )
    cells = map_arrow(sample, "cell long, n long", _count).groupBy("cell").agg(F.sum("n").cast("int").alias("n"))
    unit = F.col("cell") % BUCKETS + F.floor(F.col("cell") / (2 * BUCKETS)) * BUCKETS
    label = F.floor(F.col("cell") / BUCKETS) % 2
    per = cells.groupBy(unit.cast("int").alias("unit")).agg(
        F.sum(F.when(label == 0, F.col("n")).otherwise(0)).cast("int").alias("clean"),
        F.sum(F.when(label == 1, F.col("n")).otherwise(0)).cast("int").alias("toxic"),
    ).where(F.col("clean") + F.col("toxic") >= LEAST_ROWS)
    table = per.toArrow()
    counts = np.zeros((LEVELS, 2, BUCKETS), np.float32)
    place = table.column("unit").to_numpy()
    for k, name in enumerate(("clean", "toxic")):
        counts[place // BUCKETS, k, place % BUCKETS] = table.column(name).to_numpy()
    totals = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    model = Model(counts, np.array([totals.get(0, 0), totals.get(1, 0)], float))
    shared = Shared(documents, model)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.model
        for batch in batches:
            rows_out = []
            labels = batch.column(1).to_numpy()
            for r, (words, scores, *_) in enumerate(_scored(batch.column(0), own, labels)):
                best = sorted((s[0] for s in segments(scores)), reverse=True)[:40]
                values, often = np.unique(np.round(scores, 1), return_counts=True)
                rows_out.append((int(labels[r]), words, best, values.tolist(), often.tolist()))
            kinds = [pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int64())]
            names = ["label", "n", "best", "values", "often"]
            columns = [[x[k] for x in rows_out] for k in range(len(names))]
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    schema = "label int, n long, best array<double>, values array<double>, often array<long>"
    _calibrate(model, map_arrow(sample, schema, look).collect())
    return model


class Shared:
    """A model behind a broadcast variable; its size is fixed by the number of buckets."""

    def __init__(self, frame: DataFrame, model: Model):
        data = io.BytesIO()
        np.savez_compressed(data, rows=model.rows, total=model.total, rate=model.rate, k=model.k,
                            weights=np.zeros(0) if model.weights is None else model.weights)
        self.held = frame.sparkSession.sparkContext.broadcast(data.getvalue())

    @property
    def model(self) -> Model:
        with np.load(io.BytesIO(self.held.value)) as data:
            weights = data["weights"] if len(data["weights"]) else None
            return Model(data["rows"], data["total"], float(data["rate"]), float(data["k"]), weights)


def _judged(column: pa.Array, model: Model) -> tuple[np.ndarray, list[list[int]]]:
    """Score and byte ranges of the significant passages of each text."""
    features, passages = [], []
    for n, scores, starts, ends in _scored(column, model):
        found = segments(scores)
        features.append(model.features(n, found))
        least = math.log(model.k * max(n, 1)) - math.log(SIGNIFICANT)
        clear = [s for s in found if model.rate * s[0] > least]
        passages.append([int(x) for _, b, e in clear for x in (starts[b], ends[e - 1])])
    return model.score(np.array(features).reshape(-1, 3)), passages


def toxicity(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, score, predicted, passages.

    ``passages`` are byte ranges (start, end, start, end, ...) of all significant segments. A null or empty text has
    none and the score that goes with that. Without labels of both kinds every score is the share of toxic labels.
    Rows without id are scored and never held out; other columns are ignored.
    """
    shared = Shared(documents, fit(documents, labels, rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.model
        for batch in batches:
            score, passages = _judged(batch.column(1), model)
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)),
                 pa.array(passages, pa.list_(pa.int64()))],
                names=["doc_id", "held_out", "score", "predicted", "passages"],
            )

    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    schema = "doc_id long, held_out boolean, score double, predicted int, passages array<long>"
    return map_arrow(ids_and_texts(documents, held_out), schema, work)


def drop_toxic(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``documents`` that are not predicted toxic, with all columns unchanged."""
    shared = Shared(documents, fit(documents, labels, rows))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.model
        for batch in batches:
            score, _ = _judged(batch.column(batch.schema.get_field_index("text")), model)
            yield batch.filter(pa.array(score < THRESHOLD))

    return map_arrow(documents, documents.schema, work)
