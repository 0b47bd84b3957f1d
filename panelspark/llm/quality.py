"""Quality of whole texts: random-indexing word vectors pooled per document, then a two-layer network."""
from __future__ import annotations

import re
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import held_out, sliced

#: Rows of the word table (tokens share them by hash), width of a vector, neighbours on either side that
#: count, and the dimensions a token's index vector touches.
ROWS, WIDTH, REACH, TOUCHED = 1 << 13, 48, 2, 2
#: Labelled rows the network is fitted on: about this many of each label, chosen by hash of the id.
SAMPLE_PER_LABEL = 6000
#: Hidden units, passes over the sample, rows of a step, step size, weight decay.
HIDDEN, PASSES, STEP_ROWS, STEP, DECAY = 32, 40, 64, 3e-3, 1e-4
#: Characters whose tokens are counted together before they go to the table.
CHUNK = 400_000

_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\s]{1,3}")
#: Table rows of the marks of repetition.
_AGAIN = (1, 2)


def token_rows(text: bytes) -> np.ndarray:
    """Table row of each token: words by their lower-case letters, after a mark if they are all capitals;
    numbers as one token; punctuation by three characters; line ends. A token that repeats the one before it,
    or the one before that, counts as a mark of that instead."""
    out = []
    for token in _TOKEN.findall(text.replace(b"\n", b" \x02 ")):
        if token[0] < 48 or token.isdigit():
            out.append(b"0" if token.isdigit() else token)
        elif len(token) > 1 and token.isupper():
            out += (b"\x01caps", token.lower())
        else:
            out.append(token.lower())
    codes = np.fromiter(map(crc32, out), np.uint32, len(out))
    rows = ((codes * np.uint32(0x9E3779B1)) >> np.uint32(19)).astype(np.int64)
    rows[2:][codes[2:] == codes[:-2]] = _AGAIN[1]
    rows[1:][codes[1:] == codes[:-1]] = _AGAIN[0]
    return rows


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Sparse random index vector of every row: dimensions and signs."""
    rng = np.random.default_rng(11)
    return rng.integers(0, WIDTH, (ROWS, TOUCHED)), rng.choice([-1.0, 1.0], (ROWS, TOUCHED))


def cooccurrence(rows: np.ndarray, dims: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sum of the index vectors of the neighbours of each token, by table row; -1 separates texts."""
    total = np.zeros(ROWS * WIDTH)
    for step in range(1, REACH + 1):
        a, b = rows[:-step], rows[step:]
        real = (a >= 0) & (b >= 0)
        if step > 1:
            real &= rows[1:len(rows) - step + 1] >= 0
        a, b = a[real], b[real]
        for word, near in ((a, b), (b, a)):
            for k in range(TOUCHED):
                total += np.bincount(word * WIDTH + dims[near, k], weights=signs[near, k], minlength=ROWS * WIDTH)
    return total.reshape(ROWS, WIDTH)


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray  # of each table row, direction only
    weight: np.ndarray  # of each table row, inverse document frequency
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float = 1.0

    def pooled(self, text: bytes) -> np.ndarray:
        """Mean and deviation of the weighted word vectors of a whole text, and its length."""
        rows = token_rows(text)
        if not len(rows):
            return np.zeros(2 * WIDTH + 1)
        counts = np.bincount(rows, minlength=ROWS)
        used = np.flatnonzero(counts)
        share = counts[used] / len(rows) * self.weight[used]
        vectors = self.vectors[used]
        mean = share @ vectors
        spread = np.sqrt(np.maximum(share @ (vectors * vectors), 0.0))
        return np.concatenate((mean, spread, [np.log1p(len(rows))]))

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        z = self.logits(np.stack([self.pooled(t) for t in texts]))
        return 1.0 / (1.0 + np.exp(-np.clip(z / self.temperature, -500, 500)))


def fit_network(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Two layers (tanh, logistic) by mini-batch descent with adaptive moments."""
    rng = np.random.default_rng(5)
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    m, v, t = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(PASSES):
        order = rng.permutation(len(x))
        for at in range(0, len(x), STEP_ROWS):
            xs, ys = x[order[at:at + STEP_ROWS]], y[order[at:at + STEP_ROWS]]
            h = np.tanh(xs @ p[0] + p[1])
            error = (1.0 / (1.0 + np.exp(-np.clip(h @ p[2] + p[3], -500, 500))) - ys) / len(xs)
            back = error[:, None] * p[2] * (1 - h * h)
            grads = [xs.T @ back + DECAY * p[0], back.sum(axis=0), h.T @ error + DECAY * p[2], error.sum()]
            t += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - STEP * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
    return tuple(p)


def calibrated_temperature(z: np.ndarray, y: np.ndarray) -> float:
    """Temperature with the least log loss on a fixed grid of its logarithm."""
    if not len(y):
        return 1.0
    grid = np.exp(np.linspace(-2, 3, 201))
    loss = [np.logaddexp(0, np.where(y == 1, -z, z) / t).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def word_table(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Neighbour sums of each table row, the texts each row occurs in, and all texts, over all of ``docs(text)``."""
    def run(batches):
        dims, signs = index_vectors()
        total, seen, n = np.zeros((ROWS, WIDTH)), np.zeros(ROWS, np.int64), 0
        held, size = [], 0
        for b in sliced(batches):
            for text in b.column(0).cast(pa.binary()).to_pylist():
                rows = token_rows(text or b"")
                n += 1
                seen[np.unique(rows)] += 1
                held += (rows, [-1])
                size += len(rows)
                if size > CHUNK:
                    total += cooccurrence(np.concatenate(held).astype(np.int64), dims, signs)
                    held, size = [], 0
        if size:
            total += cooccurrence(np.concatenate(held).astype(np.int64), dims, signs)
        used = np.append(np.flatnonzero(seen), ROWS)
        values = [total[r].tobytes() if r < ROWS else b"" for r in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used), pa.array(np.append(seen, n)[used]), pa.array(values, pa.binary())], names=["row", "n", "sums"])

    def add(batches):
        sums, counts = {}, {}
        for b in batches:
            for row, n, data in zip(*(b.column(k).to_pylist() for k in range(3))):
                counts[row] = counts.get(row, 0) + n
                sums[row] = sums.get(row, 0.0) + np.frombuffer(data)
        rows = sorted(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.int64()), pa.array([counts[r] for r in rows], pa.int64()), pa.array([np.asarray(sums[r]).tobytes() for r in rows], pa.binary())],
            names=["row", "n", "sums"])

    schema = "row long, n long, sums binary"
    parts = docs.mapInArrow(run, schema).repartition("row").mapInArrow(add, schema).collect()  # ROWS + 1 at most
    total, seen = np.zeros((ROWS, WIDTH)), np.zeros(ROWS + 1, np.int64)
    for r in parts:
        seen[r.row] += r.n
        if r.row < ROWS:
            total[r.row] += np.frombuffer(r.sums)
    return total, seen[:ROWS], int(seen[ROWS])


def train_quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
                        learn: Column | None = None, per_label: int = SAMPLE_PER_LABEL) -> QualityModel:
    """Word vectors from all of ``docs``, the network from about ``per_label`` labelled rows of each label.

    Only rows where ``learn`` holds lend their label (by default all that are not held out); a fifth of the draw
    only sets the temperature. Rows with a null id, text or label teach nothing. Without both labels the score
    is the share of label 1, or one half without any label.
    """
    learn = ~held_out(id_col) if learn is None else learn
    sums, seen, n = word_table(docs.select(F.col(text_col).alias("text")))
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    vectors = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
    dims, signs = index_vectors()
    np.add.at(vectors, (np.arange(ROWS)[:, None], dims), signs)  # a word's own index vector tells it from its neighbours
    weight = np.log((1.0 + n) / (1.0 + seen)) + 0.1
    blank = QualityModel(vectors, weight, np.zeros(2 * WIDTH + 1), np.ones(2 * WIDTH + 1), (np.zeros((2 * WIDTH + 1, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(())))
    known = labels.where(learn).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").distinct()
    sizes = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        share = {0: -20.0, 1: 20.0}.get(next(iter(sizes), -1), 0.0)
        return QualityModel(vectors, weight, blank.mean, blank.scale, (*blank.layers[:3], np.array(share)))
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit("sample")), 11) / float(1 << 53)
    take = F.when(F.col("y") == 1, F.lit(min(1.0, per_label / sizes[1]))).otherwise(F.lit(min(1.0, per_label / sizes[0])))
    drawn = known.where(draw < take).withColumn("aside", F.xxhash64("id", F.lit("part")) % 5 == 0)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    shared = docs.sparkSession.sparkContext.broadcast(blank)

    def run(batches):
        for b in sliced(batches):
            found = [shared.value.pooled(t) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), b.column(1), b.column(2)], names=["x", "y", "aside"])

    # the draw has a bounded size, so it may be sent to the texts
    rows = texts.join(F.broadcast(drawn), "id").select("text", "y", "aside").mapInArrow(run, "x array<double>, y int, aside boolean").toArrow()
    x = np.array(rows.column("x").to_pylist()).reshape(-1, 2 * WIDTH + 1)
    y, aside = rows.column("y").to_numpy().astype(float), rows.column("aside").to_numpy().astype(bool)
    order = np.lexsort(x.T)  # rows come back in any order
    x, y, aside = x[order], y[order], aside[order]
    mean, scale = (x[~aside].mean(axis=0), x[~aside].std(axis=0)) if (~aside).any() else (blank.mean, blank.scale)
    scale = np.where(scale > 1e-9, scale, 1.0)
    # each label is drawn at its own rate: the bias takes the odds of the draw back to those of the rows
    odds = np.log(min(1.0, per_label / sizes[0]) / min(1.0, per_label / sizes[1]))
    w1, b1, w2, b2 = fit_network((x[~aside] - mean) / scale, y[~aside])
    model = QualityModel(vectors, weight, mean, scale, (w1, b1, w2, b2 + odds))
    z = model.logits(x[aside]) if aside.any() else np.zeros(0)
    return QualityModel(vectors, weight, mean, scale, model.layers, calibrated_temperature(z, y[aside]))


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """``(id, held_out, score, predicted)`` of every row: the probability of label 1, and 1 from ``least`` on.

    Null texts score as empty ones; null and repeated ids are kept as they are; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in sliced(batches):
            score = shared.value.score([t or b"" for t in b.column(2).cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score), pa.array((score >= least).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
