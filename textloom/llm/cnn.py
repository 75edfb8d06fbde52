"""A byte-level convolutional network in numpy that scores the quality of whole documents.

A document's bytes are cut in chunks that overlap, so that they cover all of it. Bytes are embedded, filters slide
over each chunk by STRIDE bytes, and every filter keeps its maximum in the chunk. With a stride of two every byte lies
under a filter, but places at odd offsets are none of its own: that halves the work. The mean and
the maximum over the chunks feed one logistic unit. Only bytes enter: no label, language, source or id.

Training takes a bounded sample of labelled rows on the driver; the network it gives is a few thousand numbers.
Scoring is a map over all documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from textloom.llm.common import map_batches, slices, utf8

CHUNK, HOP = 512, 448
WIDTH, STRIDE, DIMS, FILTERS = 8, 2, 8, 32
PLACES = (CHUNK - WIDTH) // STRIDE + 1
#: Bounds of the training sample: rows and bytes.
TRAIN_ROWS, TRAIN_BYTES = 4000, 24 << 20
EPOCHS, GROUP, RATE = 8, 32, 0.004


@dataclass
class Network:
    embed: np.ndarray  # 256 x DIMS
    filters: np.ndarray  # WIDTH * DIMS x FILTERS
    bias: np.ndarray  # FILTERS
    weights: np.ndarray  # 2 * FILTERS
    offset: np.ndarray  # 1

    def parts(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.weights, self.offset]


def fresh(seed: int = 11) -> Network:
    pick = np.random.default_rng(seed)
    normal = lambda scale, *shape: (pick.standard_normal(shape) * scale).astype(np.float32)
    return Network(normal(0.5, 256, DIMS), normal(0.125, WIDTH * DIMS, FILTERS), np.zeros(FILTERS, np.float32), normal(0.1, 2 * FILTERS), np.zeros(1, np.float32))


def chunks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All chunks of all texts as rows of bytes (zeros behind the end), and where each text's chunks begin."""
    counts = [max(1, -(-(len(t) - (CHUNK - HOP)) // HOP)) for t in texts]
    begins = np.cumsum([0, *counts])
    rows = np.zeros((begins[-1], CHUNK), dtype=np.uint8)
    for text, at, n in zip(texts, begins.tolist(), counts, strict=False):
        padded = np.zeros((n - 1) * HOP + CHUNK, dtype=np.uint8)
        padded[: len(text)] = np.frombuffer(text, dtype=np.uint8)
        rows[at : at + n] = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::HOP]
    return rows, begins[:-1]


def windows(net: Network, rows: np.ndarray) -> np.ndarray:
    """The embedded bytes under each place of the filters: chunks x PLACES x (WIDTH * DIMS)."""
    flat = net.embed[rows].reshape(len(rows), CHUNK * DIMS)
    view = np.lib.stride_tricks.sliding_window_view(flat, WIDTH * DIMS, axis=1)
    return view[:, :: STRIDE * DIMS]


def pooled(net: Network, rows: np.ndarray, places: bool = False):
    """The rectified maximum of each filter in each chunk, and its place if asked for."""
    highest = np.empty((len(rows), FILTERS), dtype=np.float32)
    where = np.empty((len(rows), FILTERS), dtype=np.int32) if places else None
    for i in range(0, len(rows), 64):  # what is in hand stays within the cache
        out = (np.ascontiguousarray(windows(net, rows[i : i + 64])).reshape(-1, WIDTH * DIMS) @ net.filters).reshape(-1, PLACES, FILTERS)
        if places:
            where[i : i + 64] = at = out.argmax(axis=1)
            highest[i : i + 64] = np.take_along_axis(out, at[:, None], axis=1)[:, 0]
        else:
            highest[i : i + 64] = out.max(axis=1)
    return np.maximum(highest + net.bias, 0), where


def features(highest: np.ndarray, begins: np.ndarray) -> np.ndarray:
    counts = np.diff(np.append(begins, len(highest)))
    return np.hstack([np.add.reduceat(highest, begins, axis=0) / counts[:, None], np.maximum.reduceat(highest, begins, axis=0)])


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score(net: Network, texts: list[bytes]) -> np.ndarray:
    """The probability that each text is good."""
    if not texts:
        return np.empty(0)
    rows, begins = chunks(texts)
    return squash(features(pooled(net, rows)[0], begins).astype(np.float64) @ net.weights.astype(np.float64) + float(net.offset[0]))


def gradients(net: Network, texts: list[bytes], labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy, for each part of the network."""
    rows, begins = chunks(texts)
    highest, where = pooled(net, rows, places=True)
    own = features(highest, begins)
    counts = np.diff(np.append(begins, len(rows)))
    owner = np.repeat(np.arange(len(texts)), counts)
    off = ((squash(own @ net.weights + net.offset[0]) - labels) / len(texts)).astype(np.float32)
    slope = off[owner, None] * net.weights[None, :FILTERS] / counts[owner, None]
    top = highest == own[owner, FILTERS:]
    ties = np.add.reduceat(top, begins, axis=0, dtype=np.float32)[owner]
    slope = (slope + off[owner, None] * net.weights[None, FILTERS:] * top / ties) * (highest > 0)
    spans = where[:, :, None] * STRIDE + np.arange(WIDTH)  # chunks x FILTERS x WIDTH
    under = np.take_along_axis(rows[:, None, :], spans, axis=2)
    seen = net.embed[under].reshape(len(rows), FILTERS, WIDTH * DIMS)
    to_filters = np.einsum("cf,cfk->kf", slope, seen)
    back = (slope[:, :, None] * net.filters.T[None]).reshape(-1, DIMS)
    to_embed = np.zeros_like(net.embed)
    np.add.at(to_embed, under.reshape(-1), back)
    return [to_embed, to_filters, slope.sum(axis=0), own.T @ off, off.sum(keepdims=True)]


def train(texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> Network:
    """Fits by Adam on groups of whole texts; the same rows in the same order give the same network."""
    net, pick = fresh(seed), np.random.default_rng(seed)
    marks = np.array(labels, dtype=np.float32)
    if not len(marks):
        return net
    rate = np.clip(marks.mean(), 0.01, 0.99)
    net.offset[0] = np.log(rate / (1 - rate))
    first, second, step = [np.zeros_like(x) for x in net.parts()], [np.zeros_like(x) for x in net.parts()], 0
    total = epochs * -(-len(texts) // GROUP)
    for _ in range(epochs):
        order = pick.permutation(len(texts))
        for at in range(0, len(order), GROUP):
            some = order[at : at + GROUP]
            step += 1
            rate = RATE * (1 - step / (total + 1))
            for part, g, m, v in zip(net.parts(), gradients(net, [texts[i] for i in some], marks[some]), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                part -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(id_column: Column) -> Column:
    """Rows that training never sees: crc32 of the id's decimal text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES):
    """At most ``most_rows`` labelled texts of ``most_bytes`` together, by the hash of their ids, as two lists.

    The ids are chosen among the labels, then by the texts' sizes; no text moves before that, so what is sent to the
    driver is of bounded size. A text of over a 64th of the bytes is not trained on (it is scored like any other).
    Labels that are null or contradict each other for an id are left out; equal rows count once."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    one = marked.groupBy(id_col).agg(F.min(label_col).alias("label"), F.max(label_col).alias("__most")).where(F.col("label") == F.col("__most"))
    ranked = one.select(id_col, "label", F.xxhash64(id_col).alias("__rank")).orderBy("__rank").limit(most_rows)
    texts = docs.select(id_col, text_col).where(F.col(text_col).isNotNull()).withColumn("__hash", F.xxhash64(text_col))
    sizes = texts.join(F.broadcast(ranked), id_col).select("__rank", id_col, "label", "__hash", F.octet_length(text_col).alias("__size")).distinct()
    sizes = sizes.where(F.col("__size") <= most_bytes // 64).orderBy("__rank", id_col, "__hash").limit(most_rows)
    fits = sizes.withColumn("__upto", F.sum("__size").over(Window.orderBy("__rank", id_col, "__hash").rowsBetween(Window.unboundedPreceding, 0)))
    chosen = fits.where(F.col("__upto") <= most_bytes).drop("__size", "__upto")
    found = texts.join(F.broadcast(chosen), [id_col, "__hash"]).select("__rank", id_col, "__hash", text_col, "label").distinct()
    found = found.orderBy("__rank", id_col, "__hash", text_col).select(text_col, "label").collect()
    return [r[0].encode() for r in found], [int(r[1]) for r in found]


def classify(df: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per input row: its id column, ``score`` (0 to 1) and ``predicted`` (1 if score >= threshold, else 0).

    A null text is empty and has a score like any other; a long one is scored by all its chunks. Repeated rows score
    alike, null ids stay; other columns are left behind; an empty table gives an empty one."""
    kind = df.schema[id_col].dataType.simpleString()

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(1))
        found = np.concatenate([score(net, texts[run]) for run in slices([len(t) + CHUNK for t in texts], 1 << 20)])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found), pa.array((found >= threshold).astype(np.int32))], [id_col, "score", "predicted"])

    return map_batches(df, [id_col, text_col], f"`{id_col}` {kind}, score double, predicted int", kernel)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7, **bounds) -> DataFrame:
    """Trains on the labelled rows and scores every row; adds ``held_out``. Rows and columns as in ``classify``; without
    labels the network stays as it was drawn."""
    texts, marks = training_rows(docs, labels, id_col=id_col, text_col=text_col, **bounds)
    scored = classify(docs, train(texts, marks), id_col, text_col, threshold)
    return scored.select(id_col, held_out(F.col(id_col)).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all columns; texts pass through the map once.

    Null and empty texts and null ids are scored like any other, long texts whole, repeated rows alike; an empty table
    stays empty; columns of any other name pass through."""
    texts, marks = training_rows(docs, labels, id_col=id_col, text_col=text_col)
    net = train(texts, marks)

    def kernel(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = utf8(batch.column(batch.schema.get_field_index(text_col)))
        found = np.concatenate([score(net, own[run]) for run in slices([len(t) + CHUNK for t in own], 1 << 20)])
        return batch.filter(pa.array(found >= threshold))

    return map_batches(docs, docs.columns, docs.schema, kernel)
