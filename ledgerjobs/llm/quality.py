"""Quality classifier: random-indexing word vectors, pooled, and a calibrated two-layer network."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+|[^\w\s]+")


@dataclass(frozen=True)
class Space:
    """Sizes of the word space: words are hashed to ``buckets``, vectors have ``dim`` numbers, ``ones`` of an index vector are +-1."""

    buckets: int = 4096
    dim: int = 48
    ones: int = 4

    def index_vectors(self) -> np.ndarray:
        rng = np.random.default_rng(20240501)
        out = np.zeros((self.buckets, self.dim), dtype=np.int8)
        rows = np.arange(self.buckets)[:, None]
        places = np.argsort(rng.random((self.buckets, self.dim)), axis=1)[:, : self.ones]
        out[rows, places] = rng.choice(np.array([-1, 1], dtype=np.int8), size=places.shape)
        return out


class _Words(dict):
    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = x = crc32(word.encode("utf-8", "replace")) * 0x9E3779B1 % (1 << 32) * self.buckets >> 32
        return x


def _ids(text: str | None, words: _Words) -> np.ndarray:
    tokens = TOKEN.findall(text or "")
    return np.fromiter(map(words.__getitem__, tokens), dtype=np.int32, count=len(tokens))


def add_neighbours(total: np.ndarray, texts: list[np.ndarray], index: np.ndarray, step: int = 32_768) -> None:
    """Adds to the row of each word of ``texts`` the index vectors of the words one and two places away.

    The last row of ``index`` is zero: that word stands between texts.
    """
    between = np.full(2, len(index) - 1, dtype=np.int32)
    row = np.concatenate([between, *(part for ids in texts for part in (ids, between))])
    for low in range(2, len(row) - 2, step):
        high = min(low + step, len(row) - 2)
        # sums of four entries of -1, 0 or 1, then of up to ``step`` of those: neither overflows
        near = index[row[low - 2 : high - 2]] + index[row[low - 1 : high - 1]] + index[row[low + 1 : high + 1]] + index[row[low + 2 : high + 2]]
        order = np.argsort(row[low:high], kind="stable")
        word = row[low:high][order]
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        total[word[first]] += np.add.reduceat(near[order].astype(np.int32), first, axis=0)


def context_vectors(docs: DataFrame, space: Space, *, text: str = "text", block: int = 512) -> np.ndarray:
    """Sum, over all occurrences of each word bucket in all texts, of the index vectors one and two words away.

    Every task adds up its own texts and gives one integer matrix in blocks of rows; the blocks
    are summed in groups of 64 tasks at a time, so no group grows with the input. What comes to
    the driver is one matrix of fixed size. Integer sums do not depend on the partitioning.
    """
    index = np.concatenate([space.index_vectors(), np.zeros((1, space.dim), dtype=np.int8)])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        words, total = _Words(space.buckets), np.zeros((space.buckets + 1, space.dim), dtype=np.int64)
        for batch in batches:
            some, size = [], 0
            for text in batch["text"]:
                ids = _ids(text, words)
                some.append(ids)
                size += len(ids)
                if size > 200_000:
                    add_neighbours(total, some, index)
                    some, size = [], 0
            add_neighbours(total, some, index)
        part = TaskContext.get().partitionId()
        sums = [total[i : i + block].tobytes() for i in range(0, space.buckets, block)]
        yield pd.DataFrame({"part": part, "block": np.arange(space.buckets // block), "sums": sums})

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(s, dtype=np.int64) for s in frame["sums"])
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // 64], "block": [int(frame["block"].iloc[0])], "sums": [total.tobytes()]})

    schema = "part long, block long, sums binary"
    slim = docs.select(F.col(text).cast("string").alias("text"))
    sums, parts = slim.mapInPandas(count, schema), max(1, slim.rdd.getNumPartitions())
    while True:
        sums = sums.groupBy(F.floor(F.col("part") / 64), "block").applyInPandas(add, schema)
        parts = -(-parts // 64)
        if parts == 1:
            break
    out = np.zeros((space.buckets, space.dim), dtype=np.int64)
    for r in sums.collect():
        out[r["block"] * block : (r["block"] + 1) * block] += np.frombuffer(r["sums"], dtype=np.int64).reshape(block, space.dim)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Unit context vectors, after the mean direction is taken out."""
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    unit = sums / np.where(norm == 0, 1, norm)
    unit = unit - unit[norm[:, 0] > 0].mean(axis=0) if (norm > 0).any() else unit
    unit[norm[:, 0] == 0] = 0
    return unit.astype(np.float32)


def pool(text: str | None, words: _Words, index: np.ndarray, context: np.ndarray, block: int = 32_768) -> np.ndarray:
    """Mean index vector and mean context vector of the words of a text, and mean product of the context vectors of each two neighbours."""
    ids = _ids(text, words)
    out = np.zeros(index.shape[1] + 2 * context.shape[1])
    i, c = index.shape[1], index.shape[1] + context.shape[1]
    for at in range(0, len(ids), block):
        some = context[ids[at : at + block + 1]]
        out[:i] += index[ids[at : at + block]].sum(axis=0)
        out[i:c] += some[:block].sum(axis=0)
        out[c:] += np.einsum("ij,ij->j", some[1:], some[:-1])
    return (out / max(1, len(ids))).astype(np.float32)


@dataclass
class Network:
    """Standardised input, one hidden layer, a logit, and the temperature it is divided by."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    @property
    def learned(self) -> bool:
        return bool(np.any(self.w2))

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, *, hidden: int = 32, epochs: int = 40, rate: float = 3e-3, decay: float = 1e-3, seed: int = 7) -> Network:
    """Adam on the logistic loss over four fifths of the rows; the temperature minimises the loss on the others.

    Without rows, or with one class only, the score is the smoothed share of label 1.
    """
    d = x.shape[1] if len(x) else 1
    prior = (float(y.sum()) + 1) / (len(y) + 2)
    net = Network(np.zeros(d), np.ones(d), np.zeros((d, hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(prior / (1 - prior))))
    if len(y) < 10 or y.min() == y.max():
        return net
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    net.mean, net.scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-3
    net.w1 = rng.normal(0, d**-0.5, (d, hidden))
    net.w2 = rng.normal(0, hidden**-0.5, hidden)
    z = (x - net.mean) / net.scale
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(used), max(1, len(used) // 128)):
            h = np.tanh(z[batch] @ params[0] + params[1])
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
            g = (p - y[batch]) / len(batch)
            back = np.outer(g, params[2]) * (1 - h * h)
            grads = [z[batch].T @ back + decay * params[0], back.sum(axis=0), h.T @ g + decay * params[2], np.array([g.sum()])]
            t += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad * grad
                params[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    logits, truth = net.logits(x[held]), y[held]
    losses = [(np.mean(np.logaddexp(0, np.where(truth == 1, -logits, logits) / t)), t) for t in np.exp(np.linspace(-1.5, 2.0, 71))]
    net.temperature = float(min(losses)[1])
    return net


@dataclass
class Model:
    space: Space
    context: np.ndarray
    network: Network | None = None


def _pooled(model: Model, frame: pd.Series) -> np.ndarray:
    words, index = _Words(model.space.buckets), model.space.index_vectors().astype(np.float32)
    rows = [pool(t, words, index, model.context) for t in frame]
    return np.stack(rows) if rows else np.zeros((0, 3 * model.space.dim), dtype=np.float32)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most_labelled: int = 20_000, space: Space = Space()) -> Model:
    """Word vectors from all of ``docs``; the network from at most ``most_labelled`` labelled rows (those with the smallest hashes of the id).

    ``labels`` has (doc_id, label 0/1); null labels and ids are left out, of repeated labels the largest counts.
    """
    context = word_vectors(context_vectors(docs, space, text=text))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Model(space, context))
    wanted = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("l_id")).agg(F.max(label).cast("int").alias("l_y"))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"l_id": batch["l_id"], "x": [r.tobytes() for r in _pooled(shared.value, batch["text"])], "y": batch["l_y"]})

    # at most most_labelled rows of two numbers: a proven bound for the broadcast
    bound = F.broadcast(wanted.orderBy(F.xxhash64("l_id"), "l_id").limit(most_labelled))
    slim = docs.select(F.col(doc_id).alias("d_id"), F.col(text).cast("string").alias("text"))
    both = slim.join(bound, slim["d_id"] == bound["l_id"]).select(F.col("l_id").cast("long").alias("l_id"), "text", "l_y")
    # of repeated rows of an id one is learned from
    one = both.mapInPandas(features, "l_id long, x binary, y int").groupBy("l_id").agg(F.min(F.struct("x", "y")).alias("r"))
    sample = one.select("l_id", "r.x", "r.y").toPandas().sort_values("l_id")
    x = np.stack([np.frombuffer(b, dtype=np.float32) for b in sample["x"]]).astype(np.float64) if len(sample) else np.zeros((0, 3 * space.dim))
    return Model(space, context, train(x, sample["y"].to_numpy(dtype=np.float64)))


def score_udf(spark, model: Model):
    """Pandas UDF from a text (null: empty) to the calibrated probability of label 1."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        m = shared.value
        x = _pooled(m, texts)
        if not m.network.learned:
            x = np.zeros((len(texts), len(m.network.mean)))
        p = m.network.probability(x.astype(np.float64))
        return pd.Series(p)

    return score


def held_out(doc_id: str):
    """crc32 of the id as text leaves remainder 2 by 4; null ids are not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted (1 from ``threshold`` on).

    Labels of held-out ids are never seen. Null texts count as empty and get the score of an
    empty text. Empty tables of documents give empty results; without labels all scores are equal.
    """
    model = fit(docs, labels.where(~held_out(doc_id)), doc_id=doc_id, text=text, **options)
    score = score_udf(docs.sparkSession, model)
    out = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), score(F.col(text).cast("string")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, **options) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns; all of them where the labels teach nothing (under ten, or of one class)."""
    model = fit(docs, labels.where(~held_out("doc_id")), **options)
    if not model.network.learned:
        return docs
    score = score_udf(docs.sparkSession, model)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return packed.where(score(F.col("row.text").cast("string")) >= threshold).select("row.*")
