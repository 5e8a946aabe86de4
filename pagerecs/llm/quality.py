"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of a fixed number of bytes, and only the
document has a label. Every passage is encoded (shares of byte classes and
how its words repeat, through a learned tanh layer), gated attention weighs
the passages of a document, and a logistic unit scores the weighted sum of
their codes. All weights are learned together in numpy on the driver from a
bounded sample of labelled documents; scoring covers every passage.

Results for odd input: a null or empty text is one passage without any byte;
without labels every score is 0.5; a label given twice is learned twice; repeated rows and null or repeated ids
each give their row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerecs.llm.common import byte_runs, give_back
from pagerecs.llm.words import words

#: Bytes of a passage, sizes of its code and of the attention's layer.
PASSAGE, CODE, ATTENTION = 512, 16, 8
#: Labelled documents in the training sample, at most; all passages of each are learned.
TRAIN_ROWS = 6000
#: Passes over the sample, and steps at least, so that a small sample is learned too.
EPOCHS, STEPS, BATCH, RATE = 30, 1000, 64, 0.01
#: A score from here on predicts label 1.
THRESHOLD = 0.3

_MARKS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASS = np.full(256, len(_MARKS) + 5, np.int64)  # control bytes
for _k, _b in enumerate(_MARKS):
    _CLASS[_b] = _k
_CLASS[np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)] = len(_MARKS)
_CLASS[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8)] = len(_MARKS) + 1
_CLASS[np.frombuffer(b"0123456789", np.uint8)] = len(_MARKS) + 2
_CLASS[[32, 10]] = len(_MARKS) + 3, len(_MARKS) + 4
_CLASS[128:] = len(_MARKS) + 6
CLASSES = len(_MARKS) + 7
FEATURES = CLASSES + 4


def passage_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, features) of every passage of a run's rows, float32. An empty row has one."""
    size = np.diff(offsets)
    count = np.maximum(-(-size // PASSAGE), 1)
    base = np.r_[0, np.cumsum(count)]
    rows = np.repeat(np.arange(len(size)), count)
    starts = offsets[rows] + (np.arange(base[-1]) - base[rows]) * PASSAGE
    ends = np.minimum(starts + PASSAGE, offsets[rows + 1])
    passage = np.repeat(np.arange(base[-1]), ends - starts)
    features = np.zeros((base[-1], FEATURES), np.float32)
    counts = np.bincount(passage * CLASSES + _CLASS[data], minlength=base[-1] * CLASSES)
    features[:, :CLASSES] = np.sqrt(counts.reshape(-1, CLASSES) / np.maximum(ends - starts, 1)[:, None])
    # words of each passage, cut where passages are
    of, hashes = words(data, np.r_[starts, len(data)])
    n = np.bincount(of, minlength=base[-1])
    order = np.lexsort((hashes, of))
    distinct = np.r_[True, (of[order][1:] != of[order][:-1]) | (hashes[order][1:] != hashes[order][:-1])][: len(of)]
    again = np.r_[False, (of[1:] == of[:-1]) & (hashes[1:] == hashes[:-1])][: len(of)]
    features[:, CLASSES] = np.bincount(of[order], distinct, base[-1]) / np.maximum(n, 1)
    features[:, CLASSES + 1] = np.bincount(of, again, base[-1]) / np.maximum(n, 1)
    features[:, CLASSES + 2] = np.minimum((ends - starts) / np.maximum(n, 1) / 20, 2)
    features[:, CLASSES + 3] = (ends - starts) / PASSAGE
    return rows, features


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    encode: np.ndarray  # features x CODE
    value: np.ndarray  # CODE x ATTENTION
    gate: np.ndarray  # CODE x ATTENTION
    weigh: np.ndarray  # ATTENTION
    out: np.ndarray  # CODE and a constant

    def codes(self, features: np.ndarray) -> np.ndarray:
        return np.tanh((features - self.mean) / self.spread @ self.encode)

    def forward(self, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
        """Scores of documents whose passages begin at ``first``."""
        value, gate = np.tanh(code @ self.value), 1 / (1 + np.exp(-(code @ self.gate)))
        raw = (value * gate) @ self.weigh
        n = np.diff(np.r_[first, len(code)])
        weight = np.exp(raw - np.repeat(np.maximum.reduceat(raw, first), n))
        weight /= np.repeat(np.add.reduceat(weight, first), n)
        pooled = np.add.reduceat(code * weight[:, None], first)
        logit = np.clip(pooled @ self.out[:-1] + self.out[-1], -30, 30)
        return 1 / (1 + np.exp(-logit)), pooled, weight, value, gate

    def scores(self, rows: np.ndarray, features: np.ndarray) -> np.ndarray:
        first = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        return self.forward(self.codes(features), first)[0]


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
    """Adam on the cross-entropy of documents."""
    random = np.random.default_rng(seed)
    everything = np.concatenate(bags)
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    model = Model(
        everything.mean(axis=0),
        everything.std(axis=0) + 0.05,
        random.normal(0, 0.2, (FEATURES, CODE)),
        random.normal(0, 0.3, (CODE, ATTENTION)),
        random.normal(0, 0.3, (CODE, ATTENTION)),
        random.normal(0, 0.3, ATTENTION),
        np.r_[random.normal(0, 0.3, CODE), np.log(share / (1 - share))],
    )
    values = [model.encode, model.value, model.gate, model.weigh, model.out]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    step = 0
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(bags)))):
        order = random.permutation(len(bags))
        for at in range(0, len(order), BATCH):
            chosen = order[at : at + BATCH]
            features = (np.concatenate([bags[i] for i in chosen]) - model.mean) / model.spread
            n = np.array([len(bags[i]) for i in chosen])
            first = np.r_[0, np.cumsum(n)[:-1]]
            code = np.tanh(features @ model.encode)
            score, pooled, weight, value, gate = model.forward(code, first)
            error = (score - labels[chosen]) / len(chosen)
            d_pooled = np.repeat(error[:, None] * model.out[:-1], n, axis=0)
            d_weight = (d_pooled * code).sum(axis=1)
            d_raw = weight * (d_weight - np.repeat(np.add.reduceat(weight * d_weight, first), n))
            d_value = d_raw[:, None] * gate * model.weigh * (1 - value**2)
            d_gate = d_raw[:, None] * value * model.weigh * gate * (1 - gate)
            d_code = d_pooled * weight[:, None] + d_value @ model.value.T + d_gate @ model.gate.T
            gradients = [
                features.T @ (d_code * (1 - code**2)) + 1e-4 * model.encode,
                code.T @ d_value,
                code.T @ d_gate,
                (value * gate).T @ d_raw,
                np.r_[pooled.T @ error, error.sum()],
            ]
            step += 1
            for v, g, (m, s) in zip(values, gradients, moments, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model of ``labelled`` (text, quality 0 or 1); None without labels."""
    labelled = labelled.where(F.col("quality").isin(0, 1)).select("doc_id", "text", "quality")
    n = labelled.count()
    if not n:
        return None
    # chosen by a hash of id and text, so that a group of equal texts takes no more than its share;
    # a share that gives more than ``rows`` but for odds beyond measure, the limit makes them exact
    part = int(1e9 * min(1, (rows + 6 * rows**0.5) / n))
    place = F.pmod(F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(5)), F.lit(1_000_000_000))
    chosen = labelled.withColumn("place", place).where(F.col("place") < part).orderBy("place").limit(rows)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            out = []
            for _, _, data, offsets in byte_runs(batch.column(0), 1 << 20):
                of, features = passage_features(data, offsets)
                for bag in np.split(features, np.flatnonzero(of[1:] != of[:-1]) + 1):
                    out.append(bag.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), batch.column(1)], ["bag", "quality"])
        give_back()

    sample = sorted((bytes(r.bag), r.quality) for r in chosen.select("text", "quality").mapInArrow(bags, "bag binary, quality int").collect())
    if not sample:
        return None
    features = [np.frombuffer(bag, np.float32).reshape(-1, FEATURES) for bag, _ in sample]
    return train(features, np.array([float(q) for _, q in sample]))


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1, higher: label 1 likelier) and predicted."""
    names = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = docs.select(*names).schema.add("score", "double").add("predicted", "integer")
    at = names.index(text)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            found = [np.zeros(0)]
            for first, end, data, offsets in byte_runs(batch.column(at), 1 << 20):
                found.append(model.scores(*passage_features(data, offsets)) if model else np.full(end - first, 0.5))
            found = np.concatenate(found)
            columns = [*batch.columns, pa.array(found, pa.float64()), pa.array((found >= THRESHOLD).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "score", "predicted"])
        give_back()

    return docs.select(*names).mapInArrow(scored, schema)
