"""Language of words and texts by a linear-chain conditional random field (operator 8).

The words of a text are a chain whose labels are languages. A word's score for a language sums the weights of its hashed
features: the word itself, its affixes, its byte trigrams, and whether it is in the lexicon of frequent words of each
language; pairs of neighbours add learned transition weights. Forward-backward gives every word's probabilities in the
context of the whole text, also where languages alternate. A text's language is the one with the largest share.

Weights are fitted on a bounded sample by stochastic gradient ascent on the conditional likelihood: each task goes over
its part of the sample, and the tasks' weights are averaged after every round.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leverwise.llm.common import fold, ids_and_texts, map_arrow, stage
from leverwise.llm.text import ALPHANUMERIC, Words, mix, run_hashes, words_of

# Distinct labelled texts used for fitting, at most, but one of each language at least; see ``sampled``.
FIT_ROWS = 3_000
ROUNDS = 3
TASKS = 6
LEXICON = 300
BITS = 16
RATE = 0.3
# Words of a text that make one training chain, and chains that share one update.
CHAIN = 48
CHAINS = 128
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

_U = np.uint64


@dataclass
class Model:
    """Languages, lexicon (word hash and number of its language), feature and transition weights."""

    languages: list[str]
    words: np.ndarray
    word_language: np.ndarray
    weights: np.ndarray
    moves: np.ndarray

    def pack(self) -> bytes:
        data = io.BytesIO()
        np.savez(data, languages=np.array(self.languages), words=self.words, word_language=self.word_language,
                 weights=self.weights, moves=self.moves)
        return data.getvalue()

    @staticmethod
    def unpack(packed: bytes) -> Model:
        with np.load(io.BytesIO(packed), allow_pickle=False) as d:
            return Model(d["languages"].tolist(), d["words"], d["word_language"], d["weights"], d["moves"])


def features(part: np.ndarray, words: Words, chosen: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the chosen words in a row, and where each word's begin (n + 1).

    The last numbers, one for each language, are the lexicon features; the rest are hashed.
    """
    starts, ends = words.starts[chosen], words.ends[chosen]
    value = ALPHANUMERIC.value
    columns = [np.full(len(chosen), 1, np.uint64), words.hashes[chosen]]
    for size in (1, 2, 3, 4):
        columns.append(run_hashes(part, starts, np.minimum(ends, starts + size), value))
        columns.append(run_hashes(part, np.maximum(starts, ends - size), ends, value))
    fixed = np.stack([mix(c + _U(977 * k)) for k, c in enumerate(columns)], axis=1) >> _U(64 - BITS)
    at = np.minimum(np.searchsorted(model.words, words.hashes[chosen]), max(len(model.words) - 1, 0))
    listed = model.words[at] == words.hashes[chosen] if len(model.words) else np.zeros(len(chosen), bool)
    trigrams = np.maximum(ends - starts - 2, 0)
    counts = len(columns) + trigrams + listed
    first = np.concatenate([[0], np.cumsum(counts)])
    out = np.empty(first[-1], np.int64)
    place = first[:-1, None] + np.arange(len(columns))[None, :]
    out[place] = fixed.astype(np.int64)
    begin = np.repeat(starts - (np.cumsum(trigrams) - trigrams), trigrams) + np.arange(trigrams.sum())
    three = value[part[begin]] * _U(3) + value[part[begin + 1]] * _U(5) + value[part[begin + 2]] * _U(7)
    target = np.repeat(first[:-1] + len(columns) - (np.cumsum(trigrams) - trigrams), trigrams) + np.arange(trigrams.sum())
    out[target] = (mix(three) >> _U(64 - BITS)).astype(np.int64)
    if listed.any():
        out[first[1:][listed] - 1] = (1 << BITS) + model.word_language[at[listed]]
    return out, first


def distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct word, in order, and for each word the number of its place."""
    _, chosen, which = np.unique(words.hashes, return_index=True, return_inverse=True)
    order = np.argsort(chosen)
    turn = np.empty(len(order), np.int64)
    turn[order] = np.arange(len(order))
    return chosen[order], turn[which]


def forward_backward(scores: np.ndarray, of: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each word's labels, and expected transitions, for all chains of[i]:of[i + 1] at once.

    Chains are sorted by length; step t works on those that are longer than t. Messages are scaled at every step.
    """
    lengths = np.diff(of)
    order = np.argsort(-lengths, kind="stable")
    lengths, heads = lengths[order], of[:-1][order]
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")
    first = np.concatenate([[0], np.cumsum(active)])
    step = np.repeat(np.arange(longest), active)
    place = heads[np.arange(first[-1]) - first[step]] + step
    local = np.exp(scores[place] - scores[place].max(axis=1, keepdims=True)) + 1e-300
    step_up = np.exp(moves)
    alpha, beta = np.empty_like(local), np.empty_like(local)
    for t in range(longest):
        now = slice(first[t], first[t + 1])
        row = local[now] if t == 0 else (alpha[first[t - 1] : first[t - 1] + active[t]] @ step_up) * local[now]
        alpha[now] = row / row.sum(axis=1, keepdims=True)
    pairs = np.zeros_like(moves)
    after = np.ones((0, local.shape[1]))
    for t in range(longest - 1, -1, -1):
        now = slice(first[t], first[t + 1])
        message = np.ones((active[t], local.shape[1]))
        if len(after):
            here = alpha[first[t] : first[t] + len(after)]
            joint = here.T[:, None, :] * step_up[:, :, None] * after.T[None, :, :]
            pairs += (joint / joint.sum(axis=(0, 1))).sum(axis=2)
            back = after @ step_up.T
            message[: len(after)] = back / back.sum(axis=1, keepdims=True)
        beta[now] = message
        after = message * local[now]
    both = alpha * beta
    out = np.empty_like(both)
    out[place] = both / both.sum(axis=1, keepdims=True)
    return out, pairs


def _emissions(part: np.ndarray, words: Words, model: Model) -> np.ndarray:
    """Score of every word by language, by way of the distinct words."""
    chosen, which = distinct(words)
    numbers, first = features(part, words, chosen, model)
    held = model.weights[numbers]
    scores = np.add.reduceat(held, first[:-1], axis=0) if len(chosen) else np.zeros((0, held.shape[1]))
    return scores[which]


def _train(model: Model, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, int]:
    """One pass over a task's texts: weights, transitions, number of words."""
    spread = np.full(model.weights.shape, 1.0)
    spread_moves = np.full(model.moves.shape, 1.0)
    seen = 0
    for batch in batches:
        labels = batch.column(1).to_numpy()
        for low, _, part, _, words in words_of(batch.column(0), ALPHANUMERIC):
            chosen, which = distinct(words)
            if not len(chosen):
                continue
            numbers, first = features(part, words, chosen, model)
            begins, sizes, own = [], [], []
            for r in range(len(words.of) - 1):
                for begin in range(words.of[r], words.of[r + 1], CHAIN):
                    begins.append(begin)
                    sizes.append(min(CHAIN, words.of[r + 1] - begin))
                    own.append(labels[low + r])
            turn = np.random.default_rng(len(begins)).permutation(len(begins))
            for k in range(0, len(turn), CHAINS):
                some = turn[k : k + CHAINS]
                size = np.array(sizes)[some]
                of = np.concatenate([[0], np.cumsum(size)])
                place = np.repeat(np.array(begins)[some] - of[:-1], size) + np.arange(of[-1])
                used, local = np.unique(which[place], return_inverse=True)
                many = first[used + 1] - first[used]
                flat = numbers[np.repeat(first[used] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
                head = np.concatenate([[0], np.cumsum(many)])[:-1]
                scores = np.add.reduceat(model.weights[flat], head, axis=0)[local]
                marginal, pairs = forward_backward(scores, of, model.moves)
                label = np.repeat(np.array(own)[some], size)
                slope = -marginal
                slope[np.arange(len(label)), label] += 1
                by_word = np.zeros((len(used), slope.shape[1]))
                np.add.at(by_word, local, slope)
                rows, back = np.unique(flat, return_inverse=True)
                gradient = np.zeros((len(rows), slope.shape[1]))
                np.add.at(gradient, back, np.repeat(by_word, many, axis=0))
                gradient = gradient / of[-1] - 1e-6 * model.weights[rows]
                spread[rows] += (gradient * 100) ** 2
                model.weights[rows] += RATE * gradient * 100 / np.sqrt(spread[rows])
                counts = np.bincount(np.array(own)[some], size - 1, len(model.languages))
                change = (np.diag(counts) - pairs) / of[-1]
                spread_moves += (change * 100) ** 2
                model.moves += RATE * change * 100 / np.sqrt(spread_moves)
                seen += int(of[-1])
    return model.weights, model.moves, seen


def _quota(sizes: list[int], rows: int) -> int:
    """The most texts of one language, so that all together are ``rows`` at most; languages with fewer keep all."""
    left = rows
    for k, n in enumerate(sorted(sizes)):
        if n * (len(sizes) - k) > left:
            return max(left // (len(sizes) - k), 1)
        left -= n
    return max(sizes, default=0)


def sampled(known: DataFrame, rows: int) -> DataFrame:
    """Distinct texts of each language: all of rare languages, and of each other one an equal number by their hash.

    Every language has one text at least, so the sample is bounded by ``rows`` or the number of languages.
    """
    key = F.xxhash64("text")
    texts = stage(known.groupBy("lang", key.alias("key")).agg(F.min("doc_id").alias("doc_id")), "texts")
    per = stage(texts.groupBy("lang").agg(F.count("*").alias("n")), "sizes")
    quota = _quota([r.n for r in per.select("n").collect()], rows)
    # A little more than the quota by a threshold, so that no language is ranked as a whole; then exactly the quota.
    near = quota + 6 * quota**0.5 + 20
    place = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
    some = texts.join(F.broadcast(per), "lang").where(place * F.col("n").cast("double") < F.lit(near * (1 << 40)))
    first = Window.partitionBy("lang").orderBy(place, "key")
    ids = some.withColumn("turn", F.row_number().over(first)).where(F.col("turn") <= quota).select("doc_id", "lang", "key")
    chosen = known.withColumn("key", key).join(F.broadcast(stage(ids, "chosen")), ["doc_id", "lang", "key"], "left_semi")
    return chosen.select("text", "lang").distinct()


def fit(documents: DataFrame, rows: int = FIT_ROWS) -> Model:
    """A model from text and language of documents outside the held-out fold.

    ``rows`` bounds the sample; the driver holds weights, a lexicon and the list of languages.
    """
    known = ids_and_texts(documents, F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
        & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    )
    sample = stage(sampled(known, rows).repartition(TASKS, F.xxhash64("text")), "languages")
    languages = sorted(r.lang for r in sample.select("lang").distinct().collect())
    number = {name: k for k, name in enumerate(languages)}

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = np.array([number[x] for x in batch.column(1).to_pylist()])
            for low, _, _, _, words in words_of(batch.column(0), ALPHANUMERIC):
                own = np.repeat(label[low : low + len(words.of) - 1], np.diff(words.of))
                yield pa.record_batch([pa.array(words.hashes.view(np.int64)), pa.array(own)], names=["word", "label"])

    often = map_arrow(sample, "word long, label long", spell).groupBy("word", "label").count()
    top = Window.partitionBy("label").orderBy(F.desc("count"), "word")
    listed = often.withColumn("turn", F.row_number().over(top)).where(F.col("turn") <= LEXICON)
    best = Window.partitionBy("word").orderBy(F.desc("count"), "label")
    lexicon = listed.withColumn("first", F.row_number().over(best)).where("first = 1").select("word", "label").collect()
    words = np.array([r.word for r in lexicon], np.int64).view(np.uint64)
    order = np.argsort(words)
    size = (1 << BITS) + len(languages)
    model = Model(
        languages, words[order], np.array([r.label for r in lexicon], np.int64)[order],
        np.zeros((size, len(languages))), np.zeros((len(languages), len(languages))),
    )
    for _ in range(ROUNDS if len(languages) > 1 else 0):
        held = documents.sparkSession.sparkContext.broadcast(model.pack())

        def work(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            own = Model.unpack(held.value)
            labelled = (
                pa.record_batch([b.column(0), pa.array([number[x] for x in b.column(1).to_pylist()], pa.int64())],
                                names=["text", "label"])
                for b in batches if b.num_rows
            )
            weights, moves, seen = _train(own, labelled)
            if seen:
                data = weights.astype(np.float32).tobytes(), moves.tobytes()
                yield pa.record_batch([pa.array([seen]), pa.array([data[0]]), pa.array([data[1]])],
                                      names=["seen", "weights", "moves"])

        made = map_arrow(sample, "seen long, weights binary, moves binary", work).collect()
        total = sum(r.seen for r in made)
        if not total:
            break
        shape = model.weights.shape
        model.weights = sum(np.frombuffer(r.weights, np.float32).reshape(shape) * (r.seen / total) for r in made)
        model.moves = sum(np.frombuffer(r.moves).reshape(model.moves.shape) * (r.seen / total) for r in made)
    return model


def languages(documents: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """Per row of ``documents``: doc_id, held_out, lang_pred, score, shares.

    ``shares`` are the languages' shares of the words, in the order of the learned languages; ``score`` is the largest
    share. A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing can be learned.
    Rows without id are never held out and nothing is learned from them; other columns are ignored.
    """
    model = fit(documents, rows)
    held = documents.sparkSession.sparkContext.broadcast(model.pack())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.unpack(held.value)
        for batch in batches:
            text = batch.column(1)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\pL"), False).to_numpy(zero_copy_only=False)
            names, best, shares = [], [], []
            for low, high, part, _, words in words_of(text, ALPHANUMERIC):
                share = np.zeros((high - low, max(len(own.languages), 1)))
                if len(own.languages) and len(words.hashes):
                    marginal, _ = forward_backward(_emissions(part, words, own), words.of, own.moves)
                    total = np.concatenate([np.zeros((1, marginal.shape[1])), np.cumsum(marginal, axis=0)])
                    count = np.diff(words.of)
                    share = (total[words.of[1:]] - total[words.of[:-1]]) / np.maximum(count, 1)[:, None]
                for r in range(high - low):
                    known = letters[low + r] and len(own.languages) > 0
                    k = int(np.argmax(share[r]))
                    names.append(own.languages[k] if known else UNKNOWN)
                    best.append(float(min(max(share[r, k], 0.0), 1.0)) if known else 0.0)
                    shares.append(share[r].tolist() if known else [])
            yield pa.record_batch(
                [batch.column(0), batch.column(2), pa.array(names, pa.string()), pa.array(best, pa.float64()),
                 pa.array(shares, pa.list_(pa.float64()))],
                names=["doc_id", "held_out", "lang_pred", "score", "shares"],
            )

    held_out = F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out")
    schema = "doc_id long, held_out boolean, lang_pred string, score double, shares array<double>"
    return map_arrow(ids_and_texts(documents, held_out), schema, work)
