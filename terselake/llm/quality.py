"""Quality classifier: a byte-level convolutional network in numpy.

Every byte of a text is covered: it is cut into overlapping chunks, learned filters slide over
the embedded bytes of each chunk and are max-pooled; the chunks' maxima and means feed one
logistic unit. The network is fitted on the driver over a bounded sample of labelled texts, all
chunks of each: at most ``sample_rows`` texts of at most ``sample_bytes`` in all. Scoring uses all
chunks, too, and a text's score does not depend on the texts scored beside it.

Edge cases: a null or empty text is one chunk of padding and gets a score like any other text;
an empty table gives no rows; repeated rows get equal scores; without labelled rows the
network keeps its seeded initial weights, and scores are still probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terselake.llm import common

CHUNK, STEP = 576, 512  # bytes of a chunk, bytes between the starts of chunks
STRIDE, WIDTH = 4, 8  # of the filters; a filter sees two blocks of STRIDE bytes
EMBED, FILTERS = 4, 32
PAD = 0
#: Chunks convolved at once, which bounds the memory of a long text.
_AT_ONCE = 512


@dataclass(frozen=True)
class ConvParams:
    sample_rows: int = 6000
    sample_bytes: int = 40 << 20
    epochs: int = 10
    batch: int = 64
    rate: float = 4e-3
    seed: int = 5


@dataclass
class ConvModel:
    embed: np.ndarray  # 256 x EMBED
    first: np.ndarray  # STRIDE*EMBED x FILTERS: a filter's first block
    second: np.ndarray  # its second block
    bias: np.ndarray  # FILTERS
    out: np.ndarray  # 2*FILTERS + 1

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.first, self.second, self.bias, self.out]


def initial(seed: int) -> ConvModel:
    r = np.random.default_rng(seed)
    n = lambda *shape, by=1.0: (r.standard_normal(shape) * by).astype(np.float32)
    return ConvModel(n(256, EMBED, by=0.7), n(STRIDE * EMBED, FILTERS, by=0.2), n(STRIDE * EMBED, FILTERS, by=0.2), np.zeros(FILTERS, np.float32), n(2 * FILTERS + 1, by=0.05))


def chunk_count(n_bytes: int) -> int:
    return 1 + max(0, -(-(n_bytes - CHUNK) // STEP))


def chunks(data: bytes) -> np.ndarray:
    """All chunks of a text as rows; the last one is padded."""
    n = chunk_count(len(data))
    padded = np.full((n - 1) * STEP + CHUNK, PAD, np.uint8)
    padded[:len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


def convolve(model: ConvModel, rows: np.ndarray) -> np.ndarray:
    """chunks x positions x FILTERS, before the non-linearity."""
    blocks = model.embed[rows].reshape(len(rows), CHUNK // STRIDE, STRIDE * EMBED)
    return blocks[:, :-1] @ model.first + blocks[:, 1:] @ model.second


def pooled(model: ConvModel, rows: np.ndarray) -> np.ndarray:
    """chunks x FILTERS: relu and the maximum over positions commute."""
    out = np.empty((len(rows), FILTERS), np.float32)
    for k in range(0, len(rows), _AT_ONCE):
        out[k:k + _AT_ONCE] = convolve(model, rows[k:k + _AT_ONCE]).max(axis=1)
    return np.maximum(out + model.bias, 0)


def probabilities(model: ConvModel, maxima: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """One for each text; starts: the first row of each text in maxima."""
    counts = np.diff(np.append(starts, len(maxima)))[:, None]
    whole = np.hstack([np.maximum.reduceat(maxima, starts), np.add.reduceat(maxima, starts) / counts, np.ones_like(counts)])
    # a sum for each row: a product with all rows at once rounds by the number of its rows
    return 1 / (1 + np.exp(-np.clip((whole * model.out.astype(np.float64)).sum(axis=1), -35, 35)))


def score_texts(model: ConvModel, texts) -> np.ndarray:
    """Scores of whole texts, a bounded number of chunks at a time."""
    scores: list[float] = []
    rows: list[np.ndarray] = []
    held = 0

    def flush():
        nonlocal held
        if rows:
            sizes = [len(r) for r in rows]
            scores.extend(probabilities(model, pooled(model, np.concatenate(rows)), np.cumsum([0, *sizes[:-1]])))
            rows.clear()
            held = 0

    for text in texts:
        data = text.encode("utf-8", "surrogatepass")
        if chunk_count(len(data)) > 8 * _AT_ONCE:  # a very long text goes alone
            flush()
            c = chunks(data)
            scores.extend(probabilities(model, pooled(model, c), np.zeros(1, int)))
            continue
        rows.append(chunks(data))
        held += len(rows[-1])
        if held >= _AT_ONCE:
            flush()
    flush()
    return np.array(scores, dtype=float)


def fit(examples: list[tuple[np.ndarray, int]], params: ConvParams = ConvParams()) -> ConvModel:
    """Adam on the logistic loss; examples: (chunks of a text, label)."""
    model = initial(params.seed)
    if not examples:
        return model
    labels = np.array([y for _, y in examples], np.float32)
    rate1 = np.clip(labels.mean(), 0.02, 0.98)
    weight = np.where(labels == 1, 1.0, min(4.0, rate1 / (1 - rate1)))  # the rarer class counts for more, within a bound
    model.out[-1] = np.log(rate1 / (1 - rate1))
    m, v, step = [np.zeros_like(p) for p in model.parts()], [np.zeros_like(p) for p in model.parts()], 0
    for epoch in range(params.epochs):
        order = np.random.default_rng(params.seed + epoch).permutation(len(examples))
        for at in range(0, len(order), params.batch):
            ids = order[at:at + params.batch]
            rows = np.concatenate([examples[k][0] for k in ids])
            sizes = np.array([len(examples[k][0]) for k in ids])
            starts, doc = np.cumsum(np.append(0, sizes[:-1])), np.repeat(np.arange(len(ids)), sizes)
            at_most, h = np.empty((len(rows), FILTERS), int), np.empty((len(rows), FILTERS), np.float32)
            for k in range(0, len(rows), _AT_ONCE):
                conv = convolve(model, rows[k:k + _AT_ONCE])
                at_most[k:k + _AT_ONCE] = best = conv.argmax(axis=1)
                h[k:k + _AT_ONCE] = np.maximum(np.take_along_axis(conv, best[:, None], axis=1)[:, 0] + model.bias, 0)
            top = np.maximum.reduceat(h, starts)
            whole = np.hstack([top, np.add.reduceat(h, starts) / sizes[:, None], np.ones((len(ids), 1), np.float32)])
            p = 1 / (1 + np.exp(-np.clip(whole @ model.out, -35, 35)))
            d = ((p - labels[ids]) * weight[ids] / len(ids)).astype(np.float32)
            d_h = (d[:, None] * model.out[FILTERS:2 * FILTERS] / sizes[:, None])[doc]
            is_top = h == top[doc]
            d_h += is_top * (d[:, None] * model.out[:FILTERS])[doc]
            d_h *= h > 0
            blocks = rows.reshape(len(rows), CHUNK // STRIDE, STRIDE)
            r = np.arange(len(rows))[:, None]
            b1, b2 = blocks[r, at_most], blocks[r, at_most + 1]  # chunks x FILTERS x STRIDE
            e1, e2 = (model.embed[b].reshape(len(rows), FILTERS, STRIDE * EMBED) for b in (b1, b2))
            g_first, g_second = np.einsum("cfk,cf->kf", e1, d_h), np.einsum("cfk,cf->kf", e2, d_h)
            g_embed = np.zeros_like(model.embed)
            for b, w in ((b1, model.first), (b2, model.second)):
                g = (d_h[:, :, None] * w.T[None]).reshape(-1, EMBED)
                for j in range(EMBED):
                    g_embed[:, j] += np.bincount(b.ravel(), weights=g[:, j], minlength=256)
            grads = [g_embed, g_first, g_second, d_h.sum(0), whole.T @ d + 1e-4 * model.out]
            step += 1
            for k, (part, g) in enumerate(zip(model.parts(), grads, strict=True)):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                part -= (params.rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, params: ConvParams = ConvParams(), target: str = "quality") -> ConvModel:
    sample = common.labelled_sample(docs, labels, target, params.sample_rows, params.sample_bytes, lambda text: text.encode("utf-8", "surrogatepass"))
    model = fit([(chunks(data), label) for data, label in sample], params)
    del sample
    common.give_back()  # what the examples took on the driver
    return model


def score(docs: DataFrame, model: ConvModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row, from its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some thousand numbers, whatever the data

    def run(batch: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score_texts(sent.value, common.texts_of(batch, "text")))], ["doc_id", "score"])

    return common.map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double")
