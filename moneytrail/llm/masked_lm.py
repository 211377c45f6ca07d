"""Masked pseudo-likelihood of documents by a bidirectional window network (operator 5).

A word is the bucket of its hash, and buckets belong to classes: the most frequent ones to one of their own, the others
to classes of about equal weight. The network sees the classes of the two words before and the two after and gives the
probabilities of the class between them; times the share of the bucket in its class, that is the probability of the
word given both sides. Its sum of logarithms over all words is the score of a document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moneytrail.llm.common import let, words, written

BUCKETS = 1 << 16
OFFSETS = (-2, -1, 1, 2)
BATCH = 8192
MERGED = 16


@dataclass(frozen=True)
class Model:
    """``class_of`` and ``log_share`` per bucket; the weights of the network. Its size does not depend on the corpus."""

    class_of: np.ndarray
    log_share: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)

    @property
    def classes(self) -> int:
        return int(self.class_of.max()) + 1


def word_ids(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, ids)``: the buckets of the lower-cased words of every whole text, none for null."""
    ids = let(words(F.lower(F.col(text_col))), lambda w: F.transform(
        w, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int")))
    return docs.select(F.col(id_col).alias("id"), ids.alias("ids"))


def _flat(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column without nulls."""
    lengths = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy().astype(np.int64), lengths


def bucket_counts(ids: DataFrame) -> np.ndarray:
    """How often every bucket occurs in the corpus: counted per task, added up by Spark; a number for each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            total += np.bincount(_flat(batch.column(0))[0], minlength=BUCKETS)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["bucket", "n"])

    rows = ids.select("ids").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in rows:
        counts[bucket] = n
    return counts


def classes_of(counts: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(class of each bucket, log share in its class). Three quarters of the classes are single frequent buckets; the
    rest share what is left in order of frequency. Counts are raised by one, so that no word is impossible."""
    weight = counts + 1.0
    order = np.argsort(-weight, kind="stable")
    single = classes * 3 // 4
    class_of = np.empty(len(counts), np.int64)
    class_of[order[:single]] = np.arange(single)
    rest = weight[order[single:]]
    place = np.minimum((np.cumsum(rest) - rest / 2) / rest.sum() * (classes - single), classes - single - 1).astype(np.int64)
    class_of[order[single:]] = single + place
    return class_of, np.log(weight / np.bincount(class_of, weight, classes)[class_of]).astype(np.float32)


def first_weights(classes: int, width: int, seed: int = 0) -> list[np.ndarray]:
    """Embeddings of (offset, class or edge of the text), hidden bias, output matrix and bias."""
    rng = np.random.default_rng(seed)
    return [rng.normal(0, 0.1, (len(OFFSETS) * (classes + 1), width)).astype(np.float32), np.zeros(width, np.float32),
            rng.normal(0, 0.1, (width, classes)).astype(np.float32), np.zeros(classes, np.float32)]


def windows(class_ids: np.ndarray, lengths: np.ndarray, classes: int) -> np.ndarray:
    """Rows of the embedding table for the context of every word; beyond the ends of a text stands class ``classes``."""
    pad = max(OFFSETS)
    starts = np.cumsum(lengths) - lengths
    where = np.arange(len(class_ids)) + pad * np.repeat(np.arange(len(lengths)) + 1, lengths)
    padded = np.full(len(class_ids) + pad * (len(lengths) + 1), classes, np.int64)
    padded[where] = class_ids
    assert len(starts) == len(lengths)
    return np.stack([padded[where + o] + k * (classes + 1) for k, o in enumerate(OFFSETS)], axis=1)


def log_probabilities(weights: list[np.ndarray], context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hidden layer, log probability of every class) for rows of contexts."""
    embed, bias, out, out_bias = weights
    hidden = np.tanh(embed[context].sum(axis=1) + bias)
    logits = hidden @ out + out_bias
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return hidden, logits


class Trainer:
    """Adagrad over batches, in place."""

    def __init__(self, weights: list[np.ndarray], rate: float):
        self.weights, self.rate = [w.copy() for w in weights], rate
        self.squares = [np.full(w.shape, 1e-6, np.float32) for w in weights]

    def step(self, context: np.ndarray, target: np.ndarray) -> None:
        embed, _, out, _ = self.weights
        hidden, logits = log_probabilities(self.weights, context)
        slope = np.exp(logits)
        slope[np.arange(len(target)), target] -= 1
        slope /= len(target)
        back = (slope @ out.T) * (1 - hidden * hidden)
        width = embed.shape[1]
        cells = (context[:, :, None] * width + np.arange(width)).reshape(len(context), -1)
        spread = np.bincount(cells.ravel(), np.tile(back, (1, context.shape[1])).ravel(), embed.size).reshape(embed.shape)
        for w, s, g in zip(self.weights, self.squares, (spread.astype(np.float32), back.sum(axis=0), hidden.T @ slope, slope.sum(axis=0))):
            s += g * g
            w -= self.rate * g / np.sqrt(s)


def _train(ids: DataFrame, model: Model, rate: float) -> DataFrame:
    """``(slot, n, weights)``: what each task has learned from all its documents, and from how many words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen = Trainer(model.weights, rate), 0
        for batch in batches:
            values, lengths = _flat(batch.column(0))
            target = model.class_of[values]
            context = windows(target, lengths, model.classes)
            order = np.random.default_rng(seen).permutation(len(target))
            for at in range(0, len(order), BATCH):
                rows = order[at:at + BATCH]
                trainer.step(context[rows], target[rows])
            seen += len(target)
        if seen:
            flat = np.concatenate([w.ravel() for w in trainer.weights]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([float(seen)]),
                                              pa.array([flat], pa.binary())], ["slot", "n", "weights"])

    return ids.select("ids").mapInArrow(run, "slot bigint, n double, weights binary")


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("slot")
    total = rows["n"].sum()
    mean = sum(np.frombuffer(w, np.float32) * np.float32(n / total) for w, n in zip(rows["weights"], rows["n"]))
    return pd.DataFrame({"slot": [rows["slot"].iloc[0] // MERGED], "n": [total], "weights": [mean.astype(np.float32).tobytes()]})


def averaged(learned: DataFrame) -> np.ndarray | None:
    """The mean of all weights by number of words: sixteen at a time, in as many rounds as it takes, so that neither a
    task nor the driver ever holds more than sixteen networks."""
    rows = written(learned, "learned")
    top = rows.agg(F.max("slot")).first()[0]
    if top is None:
        return None
    while top >= MERGED:
        rows = written(rows.groupBy(F.expr(f"slot DIV {MERGED}").alias("g")).applyInPandas(
            _merged, "slot bigint, n double, weights binary"), "learned")
        top //= MERGED
    last = _merged(pd.DataFrame([r.asDict() for r in rows.collect()]))
    return np.frombuffer(last["weights"].iloc[0], np.float32)


def train(ids: DataFrame, classes: int = 128, width: int = 16, rate: float = 0.1, rounds: int = 1) -> Model:
    """Counts all words and trains on all documents: every task on its own share, from the same start, and the weights
    are averaged after each round."""
    counts = bucket_counts(ids)
    class_of, log_share = classes_of(counts, classes)
    weights = first_weights(classes, width)
    # the network starts from the frequencies and learns what the context adds
    weights[3] = np.log(np.bincount(class_of, counts + 1.0, classes) / (counts + 1.0).sum()).astype(np.float32)
    for _ in range(rounds):
        flat = averaged(_train(ids, Model(class_of, log_share, weights), rate))
        if flat is None:
            break
        cuts = np.cumsum([w.size for w in weights])[:-1]
        weights = [x.reshape(w.shape) for x, w in zip(np.split(flat, cuts), weights)]
    return Model(class_of, log_share, weights)


def score(ids: DataFrame, model: Model) -> DataFrame:
    """``(id, n_words, pll)``: words of each document and the sum of their log probabilities given both sides."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lengths = _flat(batch.column(1))
            target = model.class_of[values]
            context = windows(target, lengths, model.classes)
            each = model.log_share[values].astype(np.float64)
            for at in range(0, len(target), BATCH):
                found = log_probabilities(model.weights, context[at:at + BATCH])[1]
                each[at:at + BATCH] += found[np.arange(len(found)), target[at:at + BATCH]]
            upto = np.concatenate(([0.0], np.cumsum(each)))
            ends = np.cumsum(lengths)
            sums = np.array([each[e - n:e].sum() for e, n in zip(ends, lengths)]) if len(ends) else upto[:0]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths.astype(np.int64)), pa.array(sums)],
                                             ["id", "n_words", "pll"])

    kind = ids.schema["id"].dataType.simpleString()
    return ids.select("id", "ids").mapInArrow(run, f"id {kind}, n_words bigint, pll double")


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``(id, n_words, pll, pll_per_word)`` of every document by a network trained on all of them.

    A text without words, or null, has a sum of 0 and no mean; an empty table gives no rows. Repeated rows are scored
    alike. Words are hashed once and kept as a table in the shared folder, from which counting, training and scoring read.
    """
    ids = written(word_ids(docs, id_col, text_col), "word-ids")
    rows = score(ids, train(ids, **options))
    return rows.withColumn("pll_per_word", F.when(F.col("n_words") > 0, F.col("pll") / F.col("n_words")))
