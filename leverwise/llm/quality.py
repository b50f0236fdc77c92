"""Quality by importance resampling (operator 9).

Words and word pairs are hashed into buckets. Two generative models, bags of buckets with smoothed rates, are counted:
the target from the documents labelled good, the raw one from all documents. A document's importance weight is the ratio
of its likelihoods under both. Gumbel noise, made from its id and text, is added to the log weight, and the documents
with the k largest sums are kept: a sample of k documents without replacement in proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leverwise.functions.sizes import is_small
from leverwise.llm.common import fold, ids_and_texts, map_arrow, stage
from leverwise.llm.text import SPACED, Words, mix, words_of

BUCKET_BITS = 14
BUCKETS = 1 << BUCKET_BITS
SHARE = 0.8
SEED = 41
FOLDS, HELD_OUT = 3, 1
DIGIT_BITS = 16

_U = np.uint64


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words and pairs, text by text, and where each text's begin (n + 1)."""
    n = np.diff(words.of)
    size = n + np.maximum(n - 1, 0)
    of = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(of[-1], np.int64)
    row = np.repeat(np.arange(len(n)), n)
    place = of[:-1][row] + np.arange(len(row)) - words.of[:-1][row]
    out[place] = (mix(words.hashes + _U(1)) >> _U(64 - BUCKET_BITS)).astype(np.int64)
    pair = np.flatnonzero(row[1:] == row[:-1])
    both = mix(words.hashes[pair] * _U(3) + words.hashes[pair + 1] * _U(5))
    out[place[pair] + n[row[pair]]] = (both >> _U(64 - BUCKET_BITS)).astype(np.int64)
    return out, of


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences in all texts and in the target's, summed within the task."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        often = batch.column(1).to_numpy()
        for low, high, _, _, words in words_of(batch.column(0), SPACED):
            buckets, of = grams(words)
            raw += np.bincount(buckets, minlength=BUCKETS)
            weight = np.repeat(often[low:high], np.diff(of))
            target += np.bincount(buckets, weight, BUCKETS).astype(np.int64)
    used = np.flatnonzero(raw)
    if len(used):
        yield pa.record_batch([pa.array(used), pa.array(raw[used]), pa.array(target[used])],
                              names=["bucket", "raw", "target"])


def fit(documents: DataFrame, labels: DataFrame) -> np.ndarray:
    """Log ratio of the two models' rates for each bucket; both are counted over all their documents."""
    good = labels.where(
        (F.col("quality") == 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    ).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.count("*").alias("often"))
    own = ids_and_texts(documents)
    joined = own.join(F.broadcast(good) if is_small(good, 16 * 1024 * 1024) else good, "doc_id", "left")
    counted = map_arrow(
        joined.select("text", F.coalesce("often", F.lit(0)).alias("often")), "bucket long, raw long, target long", _count
    )
    table = counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[table.column("bucket").to_numpy()] = table.column("raw").to_numpy()
    target[table.column("bucket").to_numpy()] = table.column("target").to_numpy()
    rate = (raw + 1) / (raw.sum() + BUCKETS)
    # The target's prior is the raw model, with the weight of one occurrence a bucket.
    return np.log((target + BUCKETS * rate) / (target.sum() + BUCKETS)) - np.log(rate)


def sortable(values: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def kth_largest(table: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest long of a column by four counts over its digits; the driver sees 65,536 counts at a time."""
    if k < 1:
        return None
    unsigned = F.col(column).bitwiseXOR(F.lit(-(1 << 63)))
    prefix, left = 0, k
    for turn in range(64 // DIGIT_BITS):
        shift = 64 - DIGIT_BITS * (turn + 1)
        inside = table if turn == 0 else table.where(
            F.shiftrightunsigned(unsigned, shift + DIGIT_BITS) == F.lit(prefix)
        )
        digit = F.shiftrightunsigned(unsigned, shift).bitwiseAND(F.lit((1 << DIGIT_BITS) - 1))
        counts = {r.digit: r.n for r in inside.groupBy(digit.alias("digit")).agg(F.count("*").alias("n")).collect()}
        for value in sorted(counts, reverse=True):
            if counts[value] >= left:
                break
            left -= counts[value]
        else:
            return None
        prefix = (prefix << DIGIT_BITS) | value
    return prefix - (1 << 63)


def resample(documents: DataFrame, labels: DataFrame, share: float = SHARE, seed: int = SEED) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, n_grams, log_weight, gumbel_key, kept.

    k is the given share of the rows, rounded up. A null or empty text has weight 1 (log 0). Rows equal in id and text
    have equal keys and are kept or left together, so ties at the end may add rows. Without good labels all weights are
    about 1 and the sample is uniform. Rows without id take part; other columns are ignored.
    """
    ratio = fit(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(ratio)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in batches:
            weight, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for low, high, _, _, words in words_of(batch.column(1), SPACED):
                buckets, of = grams(words)
                sums = np.concatenate([[0.0], np.cumsum(ratio[buckets])])
                weight[low:high], size[low:high] = sums[of[1:]] - sums[of[:-1]], np.diff(of)
            noise = mix(batch.column(3).to_numpy().view(np.uint64) + _U(seed))
            uniform = ((noise >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
            key = weight - np.log(-np.log(uniform))
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(size), pa.array(weight), pa.array(key),
                 pa.array(sortable(key))],
                names=["doc_id", "held_out", "n_grams", "log_weight", "gumbel_key", "place"],
            )

    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    schema = "doc_id long, held_out boolean, n_grams long, log_weight double, gumbel_key double, place long"
    keyed = ids_and_texts(documents, held_out).withColumn("noise", F.xxhash64("doc_id", "text"))
    scored = stage(map_arrow(keyed, schema, work), "weights")
    limit = kth_largest(scored, "place", int(np.ceil(share * scored.count())))
    kept = F.col("place") >= F.lit(limit) if limit is not None else F.lit(False)
    return scored.withColumn("kept", kept).drop("place")
