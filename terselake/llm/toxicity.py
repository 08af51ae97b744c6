"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text becomes the set of its hashed unigrams (words, their stems, and stems that occur twice and
thrice), bigrams and one-word-gap skip-grams. The fit runs on the driver over a bounded sample of
labelled texts (``sample_rows``, ``sample_bytes``), whose features are made on the executors;
per-coordinate learning rates and L1 sparsity leave a few thousand weights, which are what the
executors receive.

Edge cases: a null or empty text has only the bias feature and gets the score of the bias;
repeated rows get equal scores; an empty table gives no rows; without any labelled row
every score is 0.5 (a weightless model), and with one class only that class's prior.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terselake.llm import common

BITS = 20
DIM = 1 << BITS
#: ASCII upper case to lower case; every other ASCII byte that is no letter or digit to a space.
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_SALTS = np.array([0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35], dtype=np.uint64)
#: Besides the word itself, its stems of these many bytes are unigrams: compounding and inflecting languages share them.
STEM_BYTES = (5, 6, 7)
#: A stem that occurs at least so often is a feature of its own for each of these numbers.
REPEATS = (2, 3)
_REPEAT_SALTS = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
#: Words hashed at once; longer texts are hashed piece by piece (pieces overlap by the two words an n-gram reaches back).
_PIECE = 200_000
_TABLE_ROWS = 200_000


class _WordTable(dict):
    """word -> row of its hashes (word, stems); starts again when it is full."""

    def __init__(self):
        super().__init__()
        self.rows = np.zeros((_TABLE_ROWS + _PIECE + 2, 1 + len(STEM_BYTES)), dtype=np.uint64)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self)
        self.rows[k, 0] = xxhash.xxh64_intdigest(word, 7)
        for j, n in enumerate(STEM_BYTES, 1):
            self.rows[k, j] = xxhash.xxh64_intdigest(word[:n], 11)
        return k


def features(text: str, table: _WordTable | None = None) -> np.ndarray:
    """The sorted distinct feature indices of a whole text; index 0 is the bias."""
    words = text.encode("utf-8", "surrogatepass").translate(_TABLE).split()
    known = table if table is not None else common.kept_in_worker("word hashes", _WordTable)
    grams = []
    stems, times = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for start in range(0, len(words), _PIECE):
        piece = words[max(0, start - 2):start + _PIECE]
        if len(known) > _TABLE_ROWS:  # a piece adds at most its own length, for which the table has room
            known.clear()
        rows = np.fromiter(map(known.__getitem__, piece), dtype=np.int64, count=len(piece))
        h = known.rows[rows, 0]
        for gap, salt in ((1, _SALTS[0]), (2, _SALTS[1])):
            if len(h) > gap:
                grams.append(((h[:-gap] * _MIX) ^ (h[gap:] + salt)) * _MIX)
        own, n = np.unique(rows[len(piece) - min(_PIECE, len(words) - start):], return_counts=True)
        hashes = known.rows[own]
        grams.append(hashes[:, 0])
        stems, where = np.unique(np.concatenate([stems, hashes[:, 1:].ravel()]), return_inverse=True)
        times = np.bincount(where, np.concatenate([times, np.repeat(n, len(STEM_BYTES))]), len(stems)).astype(np.int64)
    grams.append(stems)
    grams += [(stems[times >= least] ^ salt) * _MIX for least, salt in zip(REPEATS, _REPEAT_SALTS)]
    return np.unique(np.concatenate([np.zeros(1, np.int64), (np.concatenate(grams) >> np.uint64(64 - BITS)).astype(np.int64)]))


@dataclass(frozen=True)
class FtrlParams:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    epochs: int = 4
    positive_weight: float = 2.0
    sample_rows: int = 8000
    sample_bytes: int = 40 << 20


@dataclass(frozen=True)
class SparseModel:
    """The non-zero weights only."""

    index: np.ndarray
    weight: np.ndarray

    def dense(self) -> np.ndarray:
        w = np.zeros(DIM)
        w[self.index] = self.weight
        return w


def fit(examples: list[tuple[np.ndarray, int]], params: FtrlParams = FtrlParams()) -> SparseModel:
    """FTRL-proximal, one example at a time, each coordinate with its own rate."""
    z, n = np.zeros(DIM), np.zeros(DIM)

    def weights(ids: np.ndarray) -> np.ndarray:
        zi = z[ids]
        w = -(zi - np.sign(zi) * params.l1) / ((params.beta + np.sqrt(n[ids])) / params.alpha + params.l2)
        w[np.abs(zi) <= params.l1] = 0.0
        if ids[0] == 0:  # the bias is not penalised
            w[0] = -zi[0] / ((params.beta + np.sqrt(n[0])) / params.alpha)
        return w

    for epoch in range(params.epochs):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            ids, label = examples[k]
            w = weights(ids)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            g *= params.positive_weight if label else 1.0
            sigma = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / params.alpha
            z[ids] += g - sigma * w
            n[ids] += g * g
    every = np.flatnonzero((n > 0) & (np.abs(z) > params.l1) | (np.arange(DIM) == 0))
    w = weights(every)
    keep = (w != 0) | (every == 0)
    return SparseModel(every[keep], w[keep])


def train(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams(), target: str = "toxic") -> SparseModel:
    # sorted indices travel as compressed differences, which takes a third of the room on the driver
    packed = lambda text: zlib.compress(np.diff(features(text), prepend=0).astype("<u4").tobytes(), 1)
    sample = common.labelled_sample(docs, labels, target, params.sample_rows, params.sample_bytes, packed)
    model = fit([(np.cumsum(np.frombuffer(zlib.decompress(cell), "<u4"), dtype=np.int32), label) for cell, label in sample], params)
    del sample
    common.give_back()  # what the examples took on the driver
    return model


class Scorer:
    """The dense weights and the word table of a worker."""

    def __init__(self, model: SparseModel):
        self.dense, self.table = model.dense(), _WordTable()

    def score(self, text: str) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(self.dense[features(text, self.table)].sum(), -35, 35))))


def _scorer(model: SparseModel) -> Scorer:
    return common.kept_in_worker((len(model.index), model.index.tobytes(), model.weight.tobytes()), lambda: Scorer(model))


def score(docs: DataFrame, model: SparseModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` for every row, from its whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most a few thousand weights

    def run(batch: pa.RecordBatch):
        scorer = _scorer(sent.value)
        s = np.fromiter((scorer.score(t) for t in common.texts_of(batch, "text")), dtype=float, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], ["doc_id", "score"])

    return common.map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: SparseModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows below the threshold, with every column they came with."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch):
        scorer = _scorer(sent.value)
        keep = pa.array([scorer.score(t) < threshold for t in common.texts_of(batch, text_col)], pa.bool_())
        yield batch.filter(keep)

    return common.map_batches(docs, run, docs.schema)
