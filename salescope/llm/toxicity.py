"""Counterfactual-regularised toxicity classifier.

A logistic model over the presence of words and of word beginnings, fitted in numpy on a bounded
sample of labelled documents. Besides the usual loss it pays for every change of a training
document's logit when the identity terms in it are swapped for others of their group, so that
the mention of a group alone moves no score. Which words and beginnings the model sees is
chosen by their association with the label, counted by Spark over the sample.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from salescope.llm.common import map_batches, stored
from salescope.llm.contamination import item_words

# Terms of a group stand for each other; a swap puts the next of the group.
IDENTITY_GROUPS = (
    ("man", "woman"), ("men", "women"), ("male", "female"), ("he", "she"), ("his", "her"), ("boy", "girl"), ("boys", "girls"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrant", "citizen", "refugee"), ("immigrants", "citizens", "refugees"),
    ("old", "young"), ("disabled", "abled"),
)

SAMPLE_ROWS = 16_000  # labelled documents that the model is fitted on
FEATURES = 3_000
BEGINNINGS = (4, 5, 6)  # letters of a word's beginning that is a feature
MIN_DOCS = 8
MIN_RATIO = 3.0  # of a feature's rates in the two classes
THRESHOLD = 0.3
CACHED_WORDS = 500_000
SCORED_ROWS = 500  # texts that a task holds besides a batch


def word_features(word: bytes) -> list[bytes]:
    """The word itself, and its beginnings marked by a trailing star."""
    text = word.decode("utf-8", "replace")
    return [word] + [text[:n].encode() + b"*" for n in BEGINNINGS if len(text) >= n]


def swapped(words: set[bytes], groups=IDENTITY_GROUPS) -> set[bytes] | None:
    """The words with each identity term replaced by the next of its group; None without one."""
    after = {a.encode(): b.encode() for g in groups for a, b in zip(g, g[1:] + g[:1])}
    if words.isdisjoint(after):
        return None
    return {after.get(w, w) for w in words}


def _label_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic, clean) counts of documents, summed for a task as far as memory allows."""
    counts: dict[bytes, list[int]] = {}

    def out() -> pa.RecordBatch:
        toxic, clean = zip(*counts.values()) if counts else ((), ())
        rows = [pa.array(list(counts), pa.binary()), pa.array(toxic, pa.int64()), pa.array(clean, pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(rows, names=["feature", "toxic", "clean"])

    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            for feature in {f for w in set(item_words(text)) for f in word_features(w)}:
                counts.setdefault(feature, [0, 0])[0 if label else 1] += 1
            if len(counts) > 400_000:
                yield out()
    yield out()


def _association(toxic: Column, clean: Column, all_toxic: int, all_clean: int) -> Column:
    """Log-likelihood ratio of label and presence."""
    total = all_toxic + all_clean
    cells = [
        (toxic, all_toxic, toxic + clean), (clean, all_clean, toxic + clean),
        (all_toxic - toxic, all_toxic, total - toxic - clean), (all_clean - clean, all_clean, total - toxic - clean),
    ]
    return 2 * sum(F.when(n > 0, n * F.log(n * total / (F.lit(float(side)) * both))).otherwise(0.0) for n, side, both in cells)


@dataclass(frozen=True)
class Toxicity:
    """Weights of features and the bias; small enough to go to every task."""

    weights: dict[bytes, float]
    bias: float

    def score(self, text: bytes | None, cache: dict[bytes, tuple[bytes, ...]]) -> float:
        logit, seen = self.bias, set()
        for word in set(item_words(text)):
            known = cache.get(word)
            if known is None:
                known = cache[word] = tuple(f for f in word_features(word) if f in self.weights)
            seen.update(known)
        logit += math.fsum(self.weights[f] for f in seen)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, logit))))


def fit_logistic(
    rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[int, np.ndarray]], width: int,
    penalty: float = 1.0, ridge: float = 1e-3, steps: int = 400,
) -> tuple[np.ndarray, float]:
    """Weights and bias. ``pairs`` has (row, features after the swap); Adam on the whole sample, so always the same."""
    def packed(lists):
        sizes = np.array([len(x) for x in lists], dtype=np.int64)
        flat = np.concatenate(lists) if len(lists) else np.empty(0, np.int64)
        return flat.astype(np.int64), np.repeat(np.arange(len(lists)), sizes)

    flat, owner = packed(rows)
    changed, changed_owner = packed([x for _, x in pairs])
    origin = np.array([i for i, _ in pairs], dtype=np.int64)
    weights, bias = np.zeros(width), math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
    first, second = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        logits = np.bincount(owner, weights[flat], len(rows)) + bias
        error = (1 / (1 + np.exp(-np.clip(logits, -60, 60))) - labels) / max(1, len(rows))
        if len(pairs):
            moved = (logits[origin] - (np.bincount(changed_owner, weights[changed], len(pairs)) + bias)) * (2 * penalty / len(pairs))
            error_all = error + np.bincount(origin, moved, len(rows))
            gradient = np.bincount(flat, error_all[owner], width) - np.bincount(changed, moved[changed_owner], width)
        else:
            gradient = np.bincount(flat, error[owner], width)
        gradient = np.append(gradient + ridge * weights / 10, error.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        change = 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights, bias = weights - change[:-1], bias - change[-1]
    return weights, float(bias)


def _indexed(places: dict[bytes, int]):
    schema = pa.schema([("toxic", pa.int32()), ("features", pa.list_(pa.int32())), ("changed", pa.list_(pa.int32()))])

    def held(words: set[bytes]) -> list[int]:
        return sorted({places[f] for w in words for f in word_features(w) if f in places})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, changed = [], []
            for text in batch.column("text").to_pylist():
                words = set(item_words(text))
                other = swapped(words)
                features.append(held(words))
                changed.append(None if other is None else held(other))
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic").cast(pa.int32()), pa.array(features, pa.list_(pa.int32())), pa.array(changed, pa.list_(pa.int32()))],
                schema=schema,
            )

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, penalty: float = 1.0, sample_rows: int = SAMPLE_ROWS) -> Toxicity:
    """Fit on the labelled rows whose hash is lowest, about ``sample_rows`` of them.

    ``labels`` has (doc_id, toxic); null ids and labels are left out. What comes to the
    driver is the chosen features and, for each sampled row, the places of those it holds.
    Without labels every score is a half; with labels of one class it is that class's share.
    """
    marked = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    total = marked.count()
    if not total:
        return Toxicity({}, 0.0)
    share = min(1.0, sample_rows / total)
    picked = marked.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
    texts = docs.where("doc_id IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("text"))
    # the sampled labels are at most a few hundred kilobytes, whatever the size of the tables
    sample = stored(texts.join(F.broadcast(picked), "doc_id").select("text", "toxic").repartition(16), "toxicity-sample")
    sizes = {r[0]: r[1] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sum(n for k, n in sizes.items() if k != 1)
    if not toxic or not clean:
        return Toxicity({}, math.log((toxic + 1) / (clean + 1)))
    counts = (
        map_batches(sample, _label_counts, "feature binary, toxic long, clean long")
        .groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )
    ratio = ((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1))
    chosen = (
        counts.where(F.col("toxic") + F.col("clean") >= MIN_DOCS).where((ratio >= MIN_RATIO) | (ratio <= 1 / MIN_RATIO))
        .select("feature", _association(F.col("toxic"), F.col("clean"), toxic, clean).alias("strength"))
        .where("strength > 12").orderBy(F.desc("strength"), "feature").limit(FEATURES).collect()
    )
    identity = {f for g in IDENTITY_GROUPS for t in g for f in word_features(t.encode())}
    places = {f: n for n, f in enumerate(sorted({bytes(r[0]) for r in chosen} | identity))}
    rows, marks, pairs = [], [], []
    for r in map_batches(sample, _indexed(places), "toxic int, features array<int>, changed array<int>").orderBy("features", "toxic").toLocalIterator():
        if r["changed"] is not None:
            pairs.append((len(rows), np.array(r["changed"], dtype=np.int64)))
        rows.append(np.array(r["features"], dtype=np.int64))
        marks.append(r["toxic"])
    weights, bias = fit_logistic(rows, np.array(marks, dtype=float), pairs, len(places), penalty)
    return Toxicity({f: float(weights[n]) for f, n in places.items() if weights[n]}, bias)


def _scored(model: Toxicity, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, tuple[bytes, ...]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, SCORED_ROWS):
                part = batch.slice(at, SCORED_ROWS)
                scores = []
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    scores.append(model.score(text, cache))
                    if len(cache) > CACHED_WORDS:
                        cache.clear()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())],
                    names=[*part.schema.names, "score", "predicted"],
                )

    return run


def score_toxicity(docs: DataFrame, model: Toxicity, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on), judged on the whole text alone.

    A null text scores like an empty one. Columns of the two names are replaced, all others and
    every row, repeated ones too, pass through. A task holds one copy of its texts.
    """
    docs = docs.drop("score", "predicted")
    schema = StructType([*docs.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    return map_batches(docs, _scored(model, threshold), schema)


def id_remainder(doc_id: Column, by: int) -> Column:
    """CRC-32 of the id as text, modulo ``by``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(by))
