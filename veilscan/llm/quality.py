"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage is encoded
by what its bytes and words look like (shares of character classes, word
lengths, repeated words and word runs), a learned layer embeds it, gated
attention weights the embeddings,

    h = tanh(W x + b),  a = softmax(w . (tanh(V h) * sigmoid(U h))),

and the score is the logistic of a linear map of the weighted sum of h. Only
document labels are used, so the attention learns which passages tell.

Learning uses at most ``SAMPLE`` labelled rows (the smallest id hashes, a
documented bound), one text of each id (the smallest), and ``TRAIN_PASSAGES``
passages of it at most; their passage features are the only data that reaches the
driver. Scoring maps over all rows without a shuffle.

Defined cases: null and empty texts are a bag of one empty passage; without
labels of both kinds every score is the share of label 1 (0.5 without any);
repeated rows score alike; conflicting labels of an id count as 1; ids that are
null are scored, and held out by the fold of the empty text; of a very long text
every passage is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import workers

PASSAGE = 64
SAMPLE = 8000
#: Passages of one document that learning uses at most; scoring uses all.
TRAIN_PASSAGES = 512
THRESHOLD = 0.3
HIDDEN, GATE = 16, 8
EPOCHS, BAGS, RATE, DECAY = 40, 128, 0.01, 1e-4
#: Passages that are scored at once in a task.
CHUNK = 20_000
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Byte classes: white space, lower, upper, digit, other controls, continuation and lead bytes, each mark.
CLASSES = 7 + len(MARKS)
FEATURES = CLASSES + 7


def _class_table() -> np.ndarray:
    table = np.full(256, 4, dtype=np.int64)
    table[[32, *range(9, 14)]] = 0
    table[97:123], table[65:91], table[48:58] = 1, 2, 3
    table[128:192], table[192:256] = 5, 6
    for k, c in enumerate(MARKS):
        table[ord(c)] = 7 + k
    return table


TABLE = _class_table()


def encode(text: str | None) -> np.ndarray:
    """One feature row for each passage of the text."""
    words = (text or "").encode().split()
    n = len(words)
    if not n:
        return np.zeros((1, FEATURES), dtype=np.float32)
    passages = (n + PASSAGE - 1) // PASSAGE
    if n % PASSAGE and n % PASSAGE < PASSAGE // 4 and passages > 1:
        passages -= 1  # a short tail joins the passage before it
    raw = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=n)
    ends = np.cumsum(sizes + 1)
    first = np.arange(passages) * PASSAGE
    of_word = np.minimum(np.arange(n) // PASSAGE, passages - 1)
    count = np.bincount(of_word, minlength=passages)
    starts = np.concatenate(([0], ends[first[1:] - 1]))
    widths = np.diff(np.append(starts, len(raw)))
    out = np.zeros((passages, FEATURES), dtype=np.float32)
    classes = np.bincount(np.repeat(np.arange(passages) * CLASSES, widths) + TABLE[raw], minlength=passages * CLASSES)
    out[:, :CLASSES] = classes.reshape(passages, CLASSES) / widths[:, None]
    share = lambda flags: np.bincount(of_word, weights=flags, minlength=passages) / count
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    out[:, CLASSES] = share(sizes) / 10
    out[:, CLASSES + 1] = share(sizes * sizes) / 100
    out[:, CLASSES + 2] = np.maximum.reduceat(sizes, first) / 20
    same = np.zeros(n)
    same[1:] = codes[1:] == codes[:-1]
    out[:, CLASSES + 3] = share(same)
    out[:, CLASSES + 4] = share(repeats(codes))
    if n >= 4:
        runs = codes[:-3] * np.uint64(0x9E3779B97F4A7C15) + codes[1:-2] * np.uint64(0xD6E8FEB86659FD93) + codes[2:-1] * np.uint64(0xA0761D6478BD642F) + codes[3:]
        flags = np.zeros(n)
        flags[: n - 3] = repeats(runs)
        out[:, CLASSES + 5] = share(flags)
    out[:, CLASSES + 6] = np.log1p(count) / 5
    return out


def repeats(codes: np.ndarray) -> np.ndarray:
    """1 for values that occur earlier in the array."""
    order = np.argsort(codes, kind="stable")
    again = np.zeros(len(codes))
    again[order[1:]] = codes[order[1:]] == codes[order[:-1]]
    return again


class Net(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    params: tuple[np.ndarray, ...]  # W, b, V, U, w, c, c0
    constant: float | None = None


def forward(params, x: np.ndarray, first: np.ndarray):
    """Logit of each bag, and what the backward pass needs; bags start at rows ``first``."""
    W, b, V, U, w, c, c0 = params
    bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
    h = np.tanh(x @ W + b)
    v, u = np.tanh(h @ V), 1 / (1 + np.exp(-(h @ U)))
    e = (v * u) @ w
    e = np.exp(e - np.maximum.reduceat(e, first)[bag])
    a = e / np.add.reduceat(e, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return z @ c + c0, (bag, h, v, u, a, z)


def backward(params, x, first, kept, slope):
    """Gradient for the bags' logit slopes."""
    W, b, V, U, w, c, c0 = params
    bag, h, v, u, a, z = kept
    dz = slope[:, None] * c
    dh = a[:, None] * dz[bag]
    da = (h * dz[bag]).sum(axis=1)
    de = a * (da - np.add.reduceat(a * da, first)[bag])
    dvu = de[:, None] * w
    dv, du = dvu * u * (1 - v * v), dvu * v * u * (1 - u)
    dh += dv @ V.T + du @ U.T
    dp = dh * (1 - h * h)
    return x.T @ dp, dp.sum(axis=0), h.T @ dv, h.T @ du, (v * u).T @ de, z.T @ slope, np.array(slope.sum())


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 6) -> Net:
    """Adam on the logistic loss, with a fixed order of steps."""
    if not len(labels) or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.5
        return Net(np.zeros(FEATURES), np.ones(FEATURES), (), share)
    every = np.concatenate(bags).astype(np.float64)
    mean, scale = every.mean(axis=0), every.std(axis=0)
    scale[scale < 1e-6] = 1
    scaled = [np.clip((b - mean) / scale, -8, 8) for b in bags]
    rng = np.random.default_rng(seed)
    draw = lambda *shape: rng.standard_normal(shape) / np.sqrt(shape[0])
    params = [draw(FEATURES, HIDDEN), np.zeros(HIDDEN), draw(HIDDEN, GATE), draw(HIDDEN, GATE), draw(GATE), draw(HIDDEN), np.array(0.0)]
    m, s = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BAGS):
            own = order[at : at + BAGS]
            x = np.concatenate([scaled[k] for k in own])
            first = np.concatenate(([0], np.cumsum([len(scaled[k]) for k in own])[:-1]))
            logit, kept = forward(params, x, first)
            slope = (1 / (1 + np.exp(-logit)) - labels[own]) / len(own)
            step += 1
            pace = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in enumerate(backward(params, x, first, kept, slope)):
                g = g + DECAY * params[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                s[k] = 0.999 * s[k] + 0.001 * g * g
                params[k] = params[k] - pace * m[k] / (np.sqrt(s[k]) + 1e-8)
    return Net(mean, scale, tuple(params))


def predict(net: Net, bags: list[np.ndarray]) -> np.ndarray:
    if net.constant is not None:
        return np.full(len(bags), net.constant)
    x = np.clip((np.concatenate(bags) - net.mean) / net.scale, -8, 8)
    first = np.concatenate(([0], np.cumsum([len(b) for b in bags])[:-1]))
    return 1 / (1 + np.exp(-forward(net.params, x, first)[0]))


def labelled(labels: DataFrame, learn: Column, label_col: str, sample: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``sample`` (id, label) rows to learn from, those with the smallest id hashes."""
    rows = labels.where(learn & F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col)).cast("int").alias("__label"))
    return rows.orderBy(F.xxhash64("__id"), "__id").limit(sample)


def spread(bag: np.ndarray) -> np.ndarray:
    """``TRAIN_PASSAGES`` passages at most, evenly spread over the document (for learning only)."""
    if len(bag) <= TRAIN_PASSAGES:
        return bag
    return bag[np.linspace(0, len(bag) - 1, TRAIN_PASSAGES).astype(np.int64)]


def train(documents: DataFrame, labels: DataFrame, learn: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Net:
    """Fit on the labelled rows for which ``learn`` (over the labels table) holds."""
    chosen = labelled(labels, learn, label_col, sample, id_col)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            made = [spread(encode(t.as_py())).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(made, pa.binary())], names=["id", "label", "bag"])

    # the chosen labels are bounded by ``sample``; one text for each of them
    rows = documents.join(F.broadcast(chosen), documents[id_col] == chosen["__id"]).select("__id", F.col(text_col).cast("string").alias("text"), "__label")
    rows = rows.groupBy("__id").agg(F.min("text").alias("text"), F.max("__label").alias("__label"))
    kind = chosen.schema["__id"].dataType.simpleString()
    made = workers(rows).mapInArrow(run, f"id {kind}, label int, bag binary").collect()
    made.sort(key=lambda r: (str(r["id"]), bytes(r["bag"])))
    bags = [np.frombuffer(r["bag"], dtype=np.float32).reshape(-1, FEATURES) for r in made]
    return fit(bags, np.array([r["label"] for r in made], dtype=np.float64))


def score(documents: DataFrame, net: Net, text_col: str = "text", out: str = "score") -> DataFrame:
    """The rows with their score between 0 and 1 in column ``out``."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            made, bags, size = [], [], 0
            for text in batch.column(batch.num_columns - 1):
                bags.append(encode(text.as_py()))
                size += len(bags[-1])
                if size >= CHUNK:
                    made.append(predict(net, bags))
                    bags, size = [], 0
            if bags:
                made.append(predict(net, bags))
            scores = np.concatenate(made) if made else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], schema=pa.schema([*list(batch.schema)[:-1], pa.field(out, pa.float64())]))

    kept = documents.drop(out)
    schema = kept.schema.add(out, "double")
    return workers(kept).withColumn("__text", F.col(text_col).cast("string")).mapInArrow(run, schema)
