"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with probability ``sigmoid(bias + weights of
its features)``, the document with the noisy-or of its sentences; the weights are trained from document
labels through that noisy-or. The sentence probabilities then locate what is offensive.

Features are hashed words and word beginnings. They are counted per document over the training
rows, the ones that go with the label are chosen by their log-likelihood ratio, and only the sentences that
hold a chosen feature are gathered for training. The number of training documents, of chosen
features and of iterations are parameters, so that what the driver holds is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quietwire.llm.common import Words, kept, mix, slices

TRAIN_DOCS = 20_000
FEATURES = 1_000
LEAST_RATIO = 20.0
MOST_SHARE = 0.2
BUCKETS = 1 << 22
BEGINNINGS = (4, 5, 6)
OFFENDING = 0.5

_TRIM = np.zeros(256, dtype=bool)
_TRIM[[ord(c) for c in ".,;:!?\"'()[]{}*#|-_"]] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True


def sentences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Index of each word's sentence, and the first word of each sentence.

    A sentence ends behind a word that ends with a full stop, a question or exclamation mark, at a
    line break, and at the end of a text.
    """
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lines = np.concatenate([[0], np.cumsum(words.data == 10)])
    opens = np.ones(n, dtype=bool)
    opens[1:] = (
        _STOP[words.data[words.end[:-1] - 1]]
        | (lines[words.start[1:]] > lines[words.end[:-1]])
        | (words.doc[1:] != words.doc[:-1])
    )
    return np.cumsum(opens) - 1, np.flatnonzero(opens)


def features(words: Words) -> list[np.ndarray]:
    """Feature numbers of every word: the word without outer marks, its beginnings, and the marks behind it."""
    start, end = words.start.copy(), words.end.copy()
    for _ in range(4):
        end -= _TRIM[words.data[np.maximum(end - 1, 0)]] & (end - start > 1)
        start += _TRIM[words.data[np.minimum(start, max(len(words.data) - 1, 0))]] & (end - start > 1)
    spans = [(start, end), *((start, np.minimum(start + n, end)) for n in BEGINNINGS), (end, words.end)]
    with np.errstate(over="ignore"):
        return [
            (mix(words.span_hash(a, b) + np.uint64(k)) & np.uint64(BUCKETS - 1)).astype(np.int64)
            for k, (a, b) in enumerate(spans)
        ]


@dataclass(frozen=True)
class ToxicityModel:
    """``weights`` of the chosen ``features`` (sorted feature numbers) and the bias of a sentence."""

    features: np.ndarray
    weights: np.ndarray
    bias: float


def _labelled(documents: DataFrame, labels: DataFrame, learn: Column, most: int) -> DataFrame:
    """``__text, __toxic`` of at most ``most`` labelled documents, the least by a hash of the id."""
    marks = (
        labels.select("doc_id", "toxic")
        .where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("__toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
        .withColumnRenamed("doc_id", "__id")
    )
    return documents.join(F.broadcast(marks), F.col("doc_id") == F.col("__id")).select(
        F.col("text").alias("__text"), F.col("__toxic")
    )


def train(
    documents: DataFrame,
    labels: DataFrame,
    learn: Column,
    most_documents: int = TRAIN_DOCS,
    most_features: int = FEATURES,
    rounds: int = 200,
) -> ToxicityModel:
    """Train from ``labels`` (``doc_id, toxic``) on the rows where ``learn`` (over ``doc_id``) holds.

    Null labels and ids don't count, of repeated labels the highest; null texts are empty. Without
    toxic or without clean documents every text gets the share of toxic ones. Runs jobs.
    """
    sample = kept(_labelled(documents, labels, learn, most_documents), "toxicity")
    totals = {bool(r[0]): r[1] for r in sample.groupBy(F.col("__toxic") >= 1).count().collect()}
    toxic, clean = totals.get(True, 0), totals.get(False, 0)
    prior = min(max((toxic + 0.5) / (toxic + clean + 1), 1e-6), 1 - 1e-6)
    if not toxic or not clean:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), float(np.log(prior / (1 - prior))))

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [{}, {}]
        for batch in batches:
            marks = batch.column("__toxic").to_numpy(zero_copy_only=False) >= 1
            for at, data, bounds in slices(batch.column("__text")):
                words = Words(data, bounds)
                found = features(words)
                owner = np.concatenate([words.doc] * len(found)).astype(np.int64)
                pairs = np.unique(owner * BUCKETS + np.concatenate(found))
                mark = marks[at + pairs // BUCKETS]
                for side in (0, 1):
                    numbers, n = np.unique(pairs[mark == bool(side)] % BUCKETS, return_counts=True)
                    for x, y in zip(numbers.tolist(), n.tolist(), strict=True):
                        counts[side][x] = counts[side].get(x, 0) + y
        for side in (0, 1):
            yield pa.record_batch(
                [pa.array(counts[side].keys(), pa.int64()), pa.array(counts[side].values(), pa.int64()), pa.array([side] * len(counts[side]), pa.int32())],
                names=["feature", "n", "side"],
            )

    n1, n0 = F.col("n1"), F.col("n0")

    def term(n: Column, expected: Column) -> Column:
        return F.when(n > 0, n * F.log(n / expected)).otherwise(0.0)

    total = toxic + clean
    ratio = 2 * (
        term(n1, (n1 + n0) * toxic / total)
        + term(n0, (n1 + n0) * clean / total)
        + term(toxic - n1, (total - n1 - n0) * toxic / total)
        + term(clean - n0, (total - n1 - n0) * clean / total)
    )
    chosen = (
        sample.mapInArrow(seen, "feature long, n long, side int")
        .groupBy("feature")
        .agg(
            F.sum(F.when(F.col("side") == 1, F.col("n")).otherwise(0)).alias("n1"),
            F.sum(F.when(F.col("side") == 0, F.col("n")).otherwise(0)).alias("n0"),
        )
        .where((n1 + n0 <= max(MOST_SHARE * total, 1.5 * toxic)) & (n1 / toxic > n0 / clean))
        .withColumn("ratio", ratio)
        .where(F.col("ratio") >= LEAST_RATIO)
        .orderBy(F.desc("ratio"), "feature")
        .limit(most_features)
        .collect()
    )
    numbers = np.sort(np.array([r["feature"] for r in chosen], dtype=np.int64))

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = batch.column("__toxic").to_numpy(zero_copy_only=False) >= 1
            for at, data, bounds in slices(batch.column("__text")):
                words = Words(data, bounds)
                sentence, first = sentences(words)
                hits = []
                for found in features(words):
                    where = np.flatnonzero(np.isin(found, numbers))
                    hits.append(np.stack([sentence[where], np.searchsorted(numbers, found[where])], axis=1))
                hits = np.unique(np.concatenate(hits), axis=0)
                owner = words.doc[first][hits[:, 0]] if len(hits) else np.zeros(0, np.int64)
                cuts = np.searchsorted(owner, np.arange(len(bounds)))
                n = np.bincount(words.doc[first], minlength=len(bounds) - 1) if len(first) else np.zeros(len(bounds) - 1, int)
                yield pa.record_batch(
                    [
                        pa.array(marks[at : at + len(bounds) - 1]),
                        pa.array(n.astype(np.int64)),
                        *(
                            pa.array(
                                [hits[a:b, k].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)],
                                pa.binary(),
                            )
                            for k in (0, 1)
                        ),
                    ],
                    names=["toxic", "sentences", "at", "feature"],
                )

    gathered = sample.mapInArrow(
        bags, "toxic boolean, sentences long, at binary, feature binary"
    ).toArrow()
    return _fit(gathered, numbers, prior, rounds)


def _fit(bags: pa.Table, numbers: np.ndarray, prior: float, rounds: int, ridge: float = 2e-5) -> ToxicityModel:
    """Gradient ascent (Adam) of the noisy-or likelihood."""
    toxic = bags["toxic"].to_numpy().astype(bool)
    order = np.lexsort((bags["sentences"].to_numpy(), toxic))  # one order of summation for every run
    toxic, total = toxic[order], np.maximum(bags["sentences"].to_numpy()[order], 1)
    at, feature = bags["at"].to_pylist(), bags["feature"].to_pylist()
    counts = np.array([len(at[row]) // 4 for row in order.tolist()])
    hit = np.frombuffer(b"".join(feature[row] for row in order.tolist()), "<i4").astype(np.int64)
    place = np.frombuffer(b"".join(at[row] for row in order.tolist()), "<i4").astype(np.int64)
    # Sentences with a chosen feature, numbered in a row; hits stand sorted by sentence.
    owner = np.repeat(np.arange(len(order)), counts)
    opens = np.ones(len(hit), dtype=bool)
    opens[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
    sentence, doc = np.cumsum(opens) - 1, owner[opens]
    n = len(doc)
    rest = total - np.bincount(doc, minlength=len(toxic))  # sentences without any chosen feature
    weights = np.full(len(numbers), 0.5)
    bias = float(np.log(prior / (1 - prior)) - 3.0)
    m, v = np.zeros(len(numbers) + 1), np.zeros(len(numbers) + 1)
    for step in range(1, rounds + 1):
        x = bias + np.bincount(sentence, weights[hit], minlength=n)
        p, p0 = 1 / (1 + np.exp(-x)), 1 / (1 + np.exp(-bias))
        none = np.bincount(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=len(toxic)) + rest * np.log1p(-p0)
        whole = np.maximum(-np.expm1(none), 1e-12)
        # d log P(label) / d x of a sentence is p * (1 - P) / P for toxic documents, -p for clean ones.
        pull = np.where(toxic, np.exp(none) / whole, -1.0)
        by_sentence = p * pull[doc]
        g = np.append(np.bincount(hit, by_sentence[sentence], minlength=len(numbers)), by_sentence.sum() + (rest * p0 * pull).sum())
        g = g / len(toxic) - ridge * np.append(weights, 0.0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        weights, bias = weights + move[:-1], float(bias + move[-1])
    return ToxicityModel(numbers, weights, bias)


def score(documents: DataFrame, model: ToxicityModel, offending: float = OFFENDING, spans: bool = True) -> DataFrame:
    """``doc_id, score, n_sentences, offending`` of every document.

    ``offending``: byte ranges in the UTF-8 text, with probability, of the sentences at or above the
    threshold. A text without words is one sentence without features. Repeated rows are scored alike.
    """
    numbers, weights, bias = model.features, model.weights, model.bias  # at most `most_features` of them
    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(BUCKETS, dtype=np.float32)
        weight[numbers] = weights
        empty = 1 / (1 + np.exp(-bias))
        for batch in batches:
            for at, data, bounds in slices(batch.column("text")):
                words, n = Words(data, bounds), len(bounds) - 1
                sentence, first = sentences(words)
                # A feature counts once in a sentence.
                hits = []
                for found in features(words):
                    where = np.flatnonzero(weight[found])
                    hits.append(np.stack([sentence[where], found[where]], axis=1))
                hits = np.unique(np.concatenate(hits), axis=0)
                x = bias + np.bincount(hits[:, 0], weight[hits[:, 1]], minlength=len(first))
                p = 1 / (1 + np.exp(-x))
                owner = words.doc[first]
                none = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-15)), minlength=n)
                count = np.bincount(owner, minlength=n)
                value = np.where(count > 0, -np.expm1(none), empty)
                bad = np.flatnonzero(p >= offending) if spans else np.zeros(0, np.int64)
                cuts = np.searchsorted(owner[bad], np.arange(n + 1))
                last = np.append(first[1:], len(words.start)) - 1
                base = words.bounds[owner[bad]]
                struct = pa.StructArray.from_arrays(
                    [pa.array(words.start[first[bad]] - base), pa.array(words.end[last[bad]] - base), pa.array(p[bad])],
                    names=["start", "end", "score"],
                )
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(at, n),
                        pa.array(np.clip(value, 0.0, 1.0)),
                        pa.array(count.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), struct),
                    ],
                    names=["doc_id", "score", "n_sentences", "offending"],
                )

    return documents.select("doc_id", "text").mapInArrow(
        run,
        f"doc_id {kind}, score double, n_sentences long, offending array<struct<start: long, end: long, score: double>>",
    )
