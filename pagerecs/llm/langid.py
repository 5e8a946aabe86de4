"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of a fixed length. The network
embeds bytes, applies filters of several widths at every place, keeps each
filter's maximum over the window and classifies by softmax; a text's
distribution is the mean of its windows', weighted by their bytes. It is
trained in numpy on the driver from all windows of a bounded sample of
labelled texts.
A filter's response is a sum of one table entry per byte it covers, so
prediction is gathers and additions over whole batches of windows.

Results for odd input: ``und`` with score 0 where the text is null or has no
letter, or where nothing was labelled; repeated rows and null or repeated
ids each give their row; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagerecs.llm.common import byte_runs, give_back

#: Bytes of a window; filter widths, filters of each width, embedding size.
WINDOW, WIDTHS, FILTERS, EMBEDDING = 256, (2, 3, 4), 8, 8
#: Labelled rows in the training sample, at most; all windows of each are learned.
TRAIN_ROWS = 2000
#: Passes over the sample, and steps at least, so that a small sample is learned too.
EPOCHS, STEPS, BATCH, RATE = 2, 750, 64, 0.01
PAD = 256
UNDETERMINED = "und"


@dataclass
class Model:
    labels: list[str]
    embed: np.ndarray  # byte (and padding) x EMBEDDING
    filters: list[np.ndarray]  # of each width: width x EMBEDDING x FILTERS
    bias: np.ndarray
    dense: np.ndarray
    dense_bias: np.ndarray

    def tables(self) -> list[np.ndarray]:
        """For each place in a filter: what each byte there adds to each
        filter (to those as wide as that at least, widest first)."""
        out = []
        for k in range(max(WIDTHS)):
            reach = [f[k] for f in reversed(self.filters) if len(f) > k]
            out.append(np.ascontiguousarray(self.embed @ np.concatenate(reach, axis=1), np.float32))
        return out

    def responses(self, windows: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """Filter responses at each place: windows x places x filters."""
        places = windows.shape[1] - max(WIDTHS) + 1
        out = tables[0][windows[:, :places]]
        for k in range(1, len(tables)):
            out[:, :, : tables[k].shape[1]] += tables[k][windows[:, k : k + places]]
        return out


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of the rows of a run, their rows, and how many bytes each has.
    A window is padded at its end; an empty row has none."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    base = np.r_[0, np.cumsum(count)]
    flat = np.full((base[-1], WINDOW), PAD, np.int16)
    flat.reshape(-1)[np.arange(len(data)) + np.repeat(base[:-1] * WINDOW - offsets[:-1], size)] = data
    rows = np.repeat(np.arange(len(size)), count)
    filled = np.minimum(size[rows] - (np.arange(base[-1]) - base[rows]) * WINDOW, WINDOW)
    return flat, rows, filled


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def train(windows: np.ndarray, classes: np.ndarray, labels: list[str], seed: int = 7) -> Model:
    """Adam on the cross-entropy of single windows."""
    random = np.random.default_rng(seed)
    model = Model(
        labels,
        random.normal(0, 0.3, (257, EMBEDDING)),
        [random.normal(0, 0.3, (w, EMBEDDING, FILTERS)) for w in WIDTHS],
        np.zeros(FILTERS * len(WIDTHS)),
        random.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))),
        np.zeros(len(labels)),
    )
    values = [model.embed, *model.filters, model.bias, model.dense, model.dense_bias]
    moments = [(np.zeros_like(v), np.zeros_like(v)) for v in values]
    step = 0
    for _ in range(max(EPOCHS, -(-STEPS * BATCH // len(windows)))):
        order = random.permutation(len(windows))
        for at in range(0, len(order), BATCH):
            x, y = windows[order[at : at + BATCH]], classes[order[at : at + BATCH]]
            response = model.responses(x, model.tables())
            place = response.argmax(axis=1)
            pooled = np.take_along_axis(response, place[:, None, :], 1)[:, 0] + model.bias
            active = np.maximum(pooled, 0)
            error = _softmax(active @ model.dense + model.dense_bias)
            error[np.arange(len(y)), y] -= 1
            error /= len(y)
            back = (error @ model.dense.T) * (pooled > 0)
            embed, filters = np.zeros_like(model.embed), [np.zeros_like(f) for f in model.filters]
            for k, width in enumerate(WIDTHS):
                own = slice((len(WIDTHS) - 1 - k) * FILTERS, (len(WIDTHS) - k) * FILTERS)  # widest first
                for j in range(width):
                    seen = np.take_along_axis(x, place[:, own] + j, 1)
                    filters[k][j] = np.einsum("bfe,bf->ef", model.embed[seen], back[:, own])
                    spread = back[:, own, None] * model.filters[k][j].T
                    np.add.at(embed, seen.reshape(-1), spread.reshape(-1, EMBEDDING))
            step += 1
            gradients = [embed, *filters, back.sum(axis=0), active.T @ error, error.sum(axis=0)]
            for v, g, (m, s) in zip(values, gradients, moments, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return model


def training_sample(labelled: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str, bytes]]:
    """(lang, whole text) of at most ``rows`` rows, about as many of each
    language, chosen by a hash of id and text."""
    labelled = labelled.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("doc_id", "text", "lang")
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, int(1e9 * min(1, rows / len(counts) / n))).otherwise(share)
    chosen = labelled.withColumn("place", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000_000)))
    chosen = chosen.where(F.col("place") < share).orderBy("place").limit(rows)
    return sorted((r.lang, bytes(r.text)) for r in chosen.select("lang", F.col("text").cast("binary").alias("text")).collect())


def fit(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """A model of the languages in ``labelled`` (text, lang); None without any."""
    sample = training_sample(labelled, rows)
    if not sample:
        return None
    labels = sorted({lang for lang, _ in sample})
    offsets = np.r_[0, np.cumsum([len(text) for _, text in sample])]
    windows, rows, _ = cut_windows(np.frombuffer(b"".join(text for _, text in sample), np.uint8), offsets)
    return train(windows, np.array([labels.index(lang) for lang, _ in sample])[rows], labels)


def _has_letter(texts: pa.Array, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    total = np.r_[0, np.cumsum(letter)]
    found = total[offsets[1:]] > total[offsets[:-1]]
    for k in np.flatnonzero(~found & (np.diff(offsets) > 0)):
        found[k] = any(c.isalpha() for c in texts[k].as_py())
    return found


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred (a learned language or ``und``) and score, the
    share of the prediction in the text's distribution."""
    names = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double")
    at = names.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        tables = model.tables() if model else []
        for batch in batches:
            langs, scores = [], []
            for first, end, data, offsets in byte_runs(batch.column(at), 1 << 20):
                windows, rows, filled = cut_windows(data, offsets)
                total = np.zeros((end - first, len(model.labels) if model else 1))
                for k in range(0, len(windows) if model else 0, BATCH):
                    part = slice(k, k + BATCH)
                    pooled = model.responses(windows[part], tables).max(axis=1) + model.bias
                    shares = _softmax(np.maximum(pooled, 0) @ model.dense + model.dense_bias)
                    np.add.at(total, rows[part], shares * filled[part, None])
                total /= np.maximum(np.diff(offsets), 1)[:, None]
                found = _has_letter(batch.column(at).slice(first, end - first), data, offsets) & bool(model)
                best = total.argmax(axis=1)
                langs += [model.labels[b] if f else UNDETERMINED for b, f in zip(best, found, strict=True)]
                scores.append(np.where(found, np.clip(total.max(axis=1), 0, 1), 0.0))
            columns = [*batch.columns, pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "lang_pred", "score"])
        give_back()

    return docs.select(*names).mapInArrow(predict, schema)

