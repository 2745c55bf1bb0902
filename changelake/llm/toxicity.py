"""Toxicity scores: logistic regression by follow-the-regularised-leader (FTRL-proximal) over hashed word n-grams and skip-grams.

Each coordinate has its own learning rate, from the squares of its past gradients, and an L1 threshold keeps all weights at zero but those
with steady evidence. So the model is a few thousand (slot, weight) pairs, whatever the corpus, and goes to the executors with the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelake.llm.frames import slices, texts_of
from changelake.llm.words import Words

SLOTS_LOG2 = 20
#: Offsets of the features' words: single words, pairs, and pairs with one word skipped.
SHAPES = ((0,), (0, 1), (0, 2))
#: The classifier is fitted on about this many labelled rows at most, picked by a hash of doc_id.
SAMPLE = 20_000
EPOCHS, ALPHA, BETA, L1, L2 = 6, 4.0, 1.0, 8.0, 0.0
THRESHOLD = 0.7
#: Bytes of texts that are made into features at once: the arrays over them take some thirty times as much of a worker's memory.
SLICE = 250_000
BIAS = 1 << SLOTS_LOG2


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) of the hashed features, once for each place where one stands."""
    words = Words([t.lower().encode("utf-8", "surrogatepass") for t in texts])
    at, slot = [], []
    for salt, shape in enumerate(SHAPES):
        i, h = words.grams(shape, salt) if len(shape) > 1 else (np.arange(words.hash.size), words.hash)
        at.append(words.text[i])
        slot.append((h >> np.uint64(64 - SLOTS_LOG2)).astype(np.int64))
    return np.concatenate(at), np.concatenate(slot)


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SLICE):
        at, slot = features(texts_of(batch.column(2)))
        pairs = np.unique((at << SLOTS_LOG2) | slot)
        bounds = np.searchsorted(pairs >> SLOTS_LOG2, np.arange(batch.num_rows + 1))
        ids = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array((pairs & (BIAS - 1)).astype(np.int32)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), ids], names=["doc_id", "toxic", "ids"])


def fit(examples: list[np.ndarray], labels: list[int], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) other than zero; slot BIAS is the bias. Examples are arrays of distinct slots, met in the given order."""
    z, n = np.zeros(BIAS + 1), np.zeros(BIAS + 1)

    def weights(i):
        x = z[i]
        w = -(x - np.sign(x) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
        w[np.abs(x) <= L1] = 0
        return w

    if len(set(labels)) > 1:
        for _ in range(epochs):
            for slots, y in zip(examples, labels, strict=True):
                i = np.append(slots, BIAS)
                w = weights(i)
                g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
                z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
                n[i] += g * g
    kept = np.flatnonzero(np.abs(z) > L1)
    return kept, weights(kept)


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    examples, labels = [], []
    for batch in batches:
        ids = batch.column(1)
        bounds, flat = np.asarray(ids.offsets), np.asarray(ids.values)
        examples += [flat[a:b].astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        labels += batch.column(0).to_pylist()
    slots, weights = fit(examples, labels)
    yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int64)), pa.array(weights)], names=["slot", "weight"])


def held_out(doc_id: str = "doc_id"):
    """Whether a document's label is withheld from learning; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def sampled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic) to learn from: one row for each labelled document that is not held out, about `sample` of them, picked by a hash, if there are more."""
    known = labels.where(~held_out()).where("toxic is not null and doc_id is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    total = known.count()
    if total > sample:
        known = known.where(F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("sample")), 11) < int(sample / total * (1 << 53)))
    return known


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The model of `labels` (doc_id, toxic) over the texts of `docs` (doc_id, text), as (slots, weights).

    Held-out rows and null ids or labels are left out. Of several labels of a document the highest counts, of several texts the least, so
    repeated rows change nothing. Beyond `sample` labelled documents, a hash of doc_id picks that many, give or take
    chance; features are made where the texts are, and one task learns from them. No rows or one class only: no weights, all scores 0.5.
    """
    known = sampled(labels, sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chosen = texts.join(F.broadcast(known), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    made = chosen.mapInArrow(_featurise, "doc_id long, toxic int, ids array<int>")
    once = made.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id").select("toxic", "ids")
    found = once.mapInArrow(_train, "slot long, weight double").toPandas()
    return found["slot"].to_numpy(), found["weight"].to_numpy()


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], score: str = "score", predicted: str = "predicted") -> DataFrame:
    """The rows of `docs` with a score from 0 to 1 and the prediction, under these names, which replace columns of the same names.

    Null and empty texts get the bias alone; every text is read whole.
    """
    docs = docs.drop(score, predicted)
    slots, weights = model
    schema = docs.schema
    place = docs.columns.index("text")

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(BIAS + 1)
        dense[slots] = weights
        for batch in slices(batches, "text", SLICE):
            at, slot = features(texts_of(batch.column(place)))
            hit = dense[slot] != 0
            pairs = np.unique((at[hit] << SLOTS_LOG2) | slot[hit])
            total = np.bincount(pairs >> SLOTS_LOG2, weights=dense[pairs & (BIAS - 1)], minlength=batch.num_rows) + dense[BIAS]
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], names=[*batch.schema.names, score, predicted]
            )

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema) + f", `{score}` double, `{predicted}` int"
    return docs.mapInArrow(scored, out)
