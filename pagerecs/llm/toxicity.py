"""Toxicity of texts by a factorization machine over hashed terms.

A term is a run of letters (bytes a-z, A-Z lower-cased, and every byte from 128
on), known by the hash of its bytes; so are its beginnings of 4 and 5 bytes, as
languages that join words hide a stem in many of them. A document's features
are the buckets of all its terms, each present or absent, however often it
occurs; a feature's value is the logarithm of how much likelier the bucket is
in documents of one label, so that words which say little stay small in very
long texts. The logit is a constant, a weight for each feature and, for each pair
of features, the inner product of their factor vectors: so two terms can mean
together what neither does alone (an insult and the mention of a group). The
sum over all pairs costs no more than the sum over features.

Learned in numpy on the driver from a bounded sample of labelled documents
(``TRAIN_ROWS``, chosen by a hash of id and text, so that a group of equal
texts takes no more than its share; each with its whole text) by AdaGrad steps
on the cross-entropy.

Results for odd input: a null or empty text, or one without letters, scores as
the document without features does; without labels every score is 0.5;
documents whose labels disagree are learned once with each; repeated rows and
null or repeated ids each give their row; an empty table gives none; columns
named score or predicted are replaced by the results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerecs.llm.common import byte_runs, give_back
from pagerecs.llm.words import Terms

#: Buckets of terms, factors of each, and the bytes of a term's beginnings.
BUCKETS, FACTORS, BEGINNINGS = 1 << 18, 4, (4, 5)
#: Labelled documents in the training sample, at most.
TRAIN_ROWS = 8000
#: A bucket is learned if the logarithm of its documents' ratio between the labels
#: (each count raised by ``SMOOTHING``) is this far from 0 at least.
SMOOTHING, LEAST_RATIO = 5.0, 0.5
EPOCHS, STEPS, BATCH, RATE, DECAY = 6, 600, 64, 0.05, 1e-3
#: A score from here on predicts label 1.
THRESHOLD = 0.5


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature of a run's rows, each once, by row and bucket."""
    found, keys = Terms(data, offsets), []
    for kind, width in enumerate((None, *BEGINNINGS)):
        whole = width is None
        some = np.arange(len(found.starts)) if whole else np.flatnonzero(found.ends - found.starts >= width)
        value = found.hashes(some, found.ends[some] if whole else found.starts[some] + width, kind)
        keys.append(found.rows[some] * BUCKETS + (value % np.uint64(BUCKETS)).astype(np.int64))
    keys = np.unique(np.concatenate(keys))
    return keys // BUCKETS, keys % BUCKETS


@dataclass
class Model:
    bias: float
    buckets: np.ndarray  # learned ones, ascending
    values: np.ndarray  # of a feature where it is present
    weights: np.ndarray
    factors: np.ndarray  # buckets x FACTORS

    def logits(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` documents with the given (row, bucket) features."""
        known, at = _found(self.buckets, buckets)
        return _logits(self, rows[known], at, n)[0]


def _found(learned: np.ndarray, buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``buckets`` are learned, and their places among those."""
    if not len(learned):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(learned, buckets), len(learned) - 1)
    known = np.flatnonzero(learned[at] == buckets)
    return known, at[known]


def _logits(model: Model, rows: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Logits, and each document's sum of factor vectors."""
    v = model.factors[at] * model.values[at, None]
    sums = np.stack([np.bincount(rows, v[:, f], n) for f in range(FACTORS)], axis=1)
    pairs = ((sums**2).sum(axis=1) - np.bincount(rows, (v * v).sum(axis=1), n)) / 2
    return model.bias + np.bincount(rows, (model.weights * model.values)[at], n) + pairs, sums


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def log_ratios(documents: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets that one label has clearly more often, and the logarithm of how much more."""
    toxic = labels > 0.5
    n = max(toxic.sum(), 1), max((~toxic).sum(), 1)
    of_toxic, of_clean = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for document, is_toxic in zip(documents, toxic, strict=True):
        (of_toxic if is_toxic else of_clean)[document] += 1
    part = min(n)  # both counts as among so many documents
    ratio = np.log((of_toxic * part / n[0] + SMOOTHING) / (of_clean * part / n[1] + SMOOTHING))
    buckets = np.flatnonzero(np.abs(ratio) >= LEAST_RATIO)
    return buckets, ratio[buckets]


def train(documents: list[np.ndarray], labels: np.ndarray, seed: int = 12) -> Model:
    """A model of documents given by their buckets, with labels 0 and 1."""
    random = np.random.default_rng(seed)
    buckets, values = log_ratios(documents, labels)
    known = [_found(buckets, document)[1] for document in documents]
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    model = Model(
        float(np.log(share / (1 - share))),
        buckets,
        values,
        np.zeros(len(buckets)),
        random.normal(0, 0.02, (len(buckets), FACTORS)),
    )
    bias_sum, weight_sum, factor_sum = 1e-6, np.full(len(buckets), 1e-6), np.full((len(buckets), FACTORS), 1e-6)
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(documents)))):
        order = random.permutation(len(documents))
        for begin in range(0, len(order), BATCH):
            chosen = order[begin : begin + BATCH]
            at = np.concatenate([known[i] for i in chosen])
            rows = np.repeat(np.arange(len(chosen)), [len(known[i]) for i in chosen])
            logit, sums = _logits(model, rows, at, len(chosen))
            error = (sigmoid(logit) - labels[chosen]) / len(chosen)
            bias_sum += error.sum() ** 2
            model.bias -= RATE * error.sum() / np.sqrt(bias_sum)
            used, which = np.unique(at, return_inverse=True)
            each = error[rows] * values[at]
            slope = np.bincount(which, each, len(used)) + DECAY * model.weights[used]
            weight_sum[used] += slope**2
            model.weights[used] -= RATE * slope / np.sqrt(weight_sum[used])
            pull = each[:, None] * (sums[rows] - model.factors[at] * values[at, None])
            slopes = np.stack([np.bincount(which, pull[:, f], len(used)) for f in range(FACTORS)], axis=1)
            slopes = slopes + DECAY * model.factors[used]
            factor_sum[used] += slopes**2
            model.factors[used] -= RATE * slopes / np.sqrt(factor_sum[used])
    return model


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model of ``labelled`` (doc_id, text, toxic 0 or 1); None without labels."""
    labelled = labelled.where(F.col("toxic").isin(0, 1)).select("doc_id", "text", "toxic")
    n = labelled.count()
    if not n:
        return None
    place = F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(12)), F.lit(1_000_000_000))
    # a share that gives more than ``rows`` but for odds beyond measure; the limit makes them exact
    part = int(1e9 * min(1, (rows + 6 * rows**0.5) / n))
    chosen = labelled.withColumn("place", place).where(F.col("place") < part).orderBy("place").limit(rows)

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for first, end, data, offsets in byte_runs(batch.column(0)):
                of, buckets = features(data, offsets)
                cut = np.searchsorted(of, np.arange(end - first + 1))
                out += [buckets[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["buckets", "toxic"])
        give_back()

    sample = chosen.select("text", "toxic").mapInArrow(documents, "buckets binary, toxic int").collect()
    sample = sorted((bytes(r.buckets), r.toxic) for r in sample)
    if not sample:
        return None
    labels = np.array([float(t) for _, t in sample])
    return train([np.frombuffer(b, np.int32).astype(np.int64) for b, _ in sample], labels)


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer")
    at = names.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0)]
            for first, end, data, offsets in byte_runs(batch.column(at)):
                n = end - first
                found.append(sigmoid(model.logits(*features(data, offsets), n)) if model else np.full(n, 0.5))
            found = np.concatenate(found)
            columns = [*batch.columns, pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "score", "predicted"])
        give_back()

    return docs.select(*names).mapInArrow(scored, schema)
