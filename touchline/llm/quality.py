"""Operator 4: a quality classifier by hashed word n-grams.

Features are hashed unigrams and bigrams of a text's words and marks, and bigrams of their shapes (letters or marks, upper
case, length), each weighted by its share among all of the text. A logistic regression learns their weights by
follow-the-regularised-leader updates on a bounded sample of the labelled rows; a text's score is a sparse dot product.

Null and empty texts have no features and get the score of the bias. A label of a missing document, or a null label, is
not learnt from; a doc_id labelled more than once counts as often. Without any label the score is 0.5 throughout.
Repeated rows get equal scores; extra columns pass through, but for one that bears the score's name. Very long texts are
blocks of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import LOWER, SPACES, Hasher, mix, text_blocks
from .shared import spare, table

#: Hash buckets of the features.
BUCKETS = 1 << 18
#: Labelled rows learnt from at most, drawn by a hash of doc_id.
LEARN_FROM = 8_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.6, 1.0, 1e-4, 1e-3
#: A text's shares of its features add up to this.
SCALE = 20.0

_WORDY = np.zeros(256, bool)
_WORDY[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), 95]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the runs of word bytes and of the runs of one mark."""
    n = len(data)
    kind = np.where(_WORDY[data], 256, data).astype(np.int16)
    edge = np.ones(n, bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(edge)
    ends = np.append(starts[1:], n)
    ink = ~SPACES[data[starts]]
    starts, ends = starts[ink], ends[ink]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def features(data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of a block of texts, and the text of each, in order of the texts."""
    if not len(data):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    starts, ends, text = _tokens(data, offsets)
    if not len(starts):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    word = hasher.load(LOWER[data]).slices(starts, ends)
    uppers = np.concatenate(([0], np.cumsum(_UPPER[data])))
    size = ends - starts
    wordy = _WORDY[data[starts]]
    shape = np.where(wordy, np.minimum(size, 12) + 16 * (uppers[ends] - uppers[starts] >= np.maximum(size * 0.6, 2)) + 32 * _UPPER[data[starts]], 64 + data[starts]).astype(np.uint64)
    run = np.where(wordy, 0, np.minimum(size, 4)).astype(np.uint64)
    shape = mix(shape + (run << np.uint64(20)) + np.uint64(0x51ED))
    pair = text[1:] == text[:-1]
    bigram = mix(word[:-1][pair] + mix(word[1:][pair] ^ np.uint64(0xA5A5)))
    shapes = mix(shape[:-1][pair] + mix(shape[1:][pair] ^ np.uint64(0x5A5A)))
    hashes = np.concatenate((word, bigram, shapes))
    of = np.concatenate((text, text[1:][pair], text[1:][pair]))
    order = np.argsort(of, kind="stable")
    return (hashes % np.uint64(BUCKETS)).astype(np.int32)[order], of[order]


class FTRL:
    """Logistic regression over sparse rows, one update a row (McMahan et al., 2013). The last weight is the bias."""

    def __init__(self, buckets: int = BUCKETS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(buckets + 1), np.zeros(buckets + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int, offset: float = 0.0) -> None:
        """offset: what is known of the row's logit beforehand."""
        w = self.weights(at)
        g = (1 / (1 + np.exp(-np.clip(w @ x + offset, -35, 35))) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """rows: distinct buckets, their shares, label. The order of updates is drawn anew each epoch, from a fixed seed."""
    model = FTRL()
    dice = np.random.default_rng(7)
    for _ in range(epochs if rows else 0):
        for i in dice.permutation(len(rows)):
            at, x, label = rows[i]
            model.learn(np.append(at, BUCKETS), np.append(x, 1.0), label)
    return model.weights().astype(np.float32)


def scores(weights: np.ndarray, data: np.ndarray, offsets: np.ndarray, hasher: Hasher) -> np.ndarray:
    at, of = features(data, offsets, hasher)
    n = len(offsets) - 1
    total = np.bincount(of, weights[at], n) * SCALE / np.maximum(np.bincount(of, minlength=n), 1)
    return 1 / (1 + np.exp(-np.clip(total + weights[-1], -35, 35)))


def fold(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """The remainder of crc32 of an id's decimal text; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % folds


def _sampled(df: DataFrame, key: str, share: float) -> DataFrame:
    return df if share >= 1 else df.where(F.pmod(F.xxhash64(key), F.lit(1_000_000)) < int(share * 1_000_000))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", learn_from: int = LEARN_FROM) -> np.ndarray:
    """Weights learnt from at most about `learn_from` labelled rows, drawn by a hash of the key. labels must hold only rows to learn from."""
    labels = labels.where(F.col(label).isNotNull()).select(key, F.col(label).cast("int").alias("_label"))
    share = learn_from / max(1, labels.count())
    docs = _sampled(docs.select(key, text), key, share).join(_sampled(labels, key, share), key)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            marks = batch.column(batch.schema.get_field_index("_label"))
            for i, j, data, offsets in text_blocks(batch.column(batch.schema.get_field_index(text))):
                at, of = features(data, offsets, hasher)
                code, count = np.unique(of * BUCKETS + at, return_counts=True)
                of, at = code // BUCKETS, (code % BUCKETS).astype(np.int32)
                total = np.bincount(of, count, j - i)
                x = (count * SCALE / total[of]).astype(np.float32)
                ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=j - i))))
                yield pa.RecordBatch.from_pydict({"at": [at[a:b].tobytes() for a, b in zip(ends, ends[1:])], "x": [x[a:b].tobytes() for a, b in zip(ends, ends[1:])], "label": marks.slice(i, j - i)})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((x, at, label) for b in batches for at, x, label in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("at", "x", "label"))))
        made = train([(np.frombuffer(at, np.int32), np.frombuffer(x, np.float32), label) for x, at, label in found])
        yield pa.RecordBatch.from_pydict({"weights": [made.tobytes()]})

    sparse = docs.mapInArrow(rows, "at binary, x binary, label int")
    got = sparse.repartition(1).mapInArrow(learn, "weights binary").collect()
    return np.frombuffer(got[0].weights, np.float32)


def score(df: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """Add double `out`; all other columns stay, but for one of that name."""
    names = [c for c in df.columns if c != out]
    schema = T.StructType([df.schema[c] for c in names] + [T.StructField(out, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            made = [scores(shared.value, data, offsets, hasher) for _, _, data, offsets in text_blocks(batch.column(batch.schema.get_field_index(text)))]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + [pa.array(np.concatenate(made) if made else np.empty(0))], names=[*names, out])

    return df.mapInArrow(run, schema)


def learn_from_tables(spark: SparkSession, sf_dir: str) -> np.ndarray:
    labels = table(spark, sf_dir, "labels").where(fold() != 0)
    return fit(table(spark, sf_dir, "documents"), labels)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every document's quality."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learn_from_tables(spark, sf_dir)).drop("text")
    return found.select("doc_id", (fold() == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.3) -> DataFrame:
    """Pipeline stage: the documents whose score is `least` or more."""
    name = spare(docs, "quality")
    found = score(docs, learn_from_tables(spark, sf_dir), out=name)
    return found.where(F.col(name) >= least).select(*docs.columns)
