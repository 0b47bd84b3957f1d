"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams."""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import held_out, sliced

#: Hashed n-gram columns (2 ** 14), the n-gram lengths, and the label of texts without a letter.
SLOTS, LENGTHS, UNKNOWN = 1 << 14, (1, 2, 3), "und"
#: Labelled rows a model is fitted on: about this many of each language, chosen by hash of the id.
SAMPLE_PER_LANGUAGE = 1000
#: Follow-the-regularised-leader: step scale, step offset, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.05, 3

_LETTER = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x10000)])
_MULT = (np.uint32(1), np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B))


def _letters(text: str) -> np.ndarray:
    """Lower-case code points, each run of other characters one zero; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    wide = codes >= 0x10000
    letter = _LETTER[np.where(wide, 0, codes)]
    if wide.any():
        letter[wide] = [chr(c).isalpha() for c in codes[wide]]
    if not letter.any():
        return np.zeros(0, np.uint32)
    codes = np.concatenate((np.zeros(1, np.uint32), np.where(letter, codes, 0).astype(np.uint32), np.zeros(1, np.uint32)))
    return codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the hashed n-grams in a text, ascending, and their damped counts ``1 + log(n)``."""
    codes = _letters(text or "")
    if not len(codes):
        return np.zeros(0, np.int64), np.zeros(0)
    counts = np.zeros(SLOTS, np.int64)
    for n in LENGTHS:
        if len(codes) < n:
            break
        h = np.full(len(codes) - n + 1, n * 0x27D4EB2F & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ codes[k:len(codes) - n + 1 + k]) * _MULT[1] + _MULT[2]
        counts += np.bincount((h ^ (h >> np.uint32(15))) & np.uint32(SLOTS - 1), minlength=SLOTS)
    slots = np.flatnonzero(counts)
    return slots, 1.0 + np.log(counts[slots])


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    idf: np.ndarray  # of each slot
    weights: np.ndarray  # slot x language
    bias: np.ndarray
    temperature: float = 1.0

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        slots, tf = ngram_counts(text)
        x = tf * self.idf[slots]
        norm = np.sqrt(x @ x)
        return slots, x / norm if norm else x

    def logits(self, slots: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[slots] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        slots, x = self.features(text)
        if not len(slots) or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(slots, x) / self.temperature)
        k = int(p.argmax())
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by follow-the-regularised-leader, proximal form, elastic net; one row at a time."""
    z, n = np.zeros((SLOTS + 1, languages)), np.zeros((SLOTS + 1, languages))

    def leader(at):
        zs, ns = z[at], n[at]
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(ns)) / ALPHA + L2)), ns

    rng = np.random.default_rng(7)
    for _ in range(PASSES):
        for r in rng.permutation(len(rows)):
            slots, x, y = rows[r]
            at, x1 = np.append(slots, SLOTS), np.append(x, 1.0)  # the last one is the bias
            w, ns = leader(at)
            error = softmax(x1 @ w)
            error[y] -= 1.0
            g = x1[:, None] * error
            z[at] += g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * w
            n[at] = ns + g * g
    w, _ = leader(np.arange(SLOTS + 1))
    return w[:SLOTS], w[SLOTS]


def calibrated_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """Temperature with the least log loss, by golden-section search on its logarithm between 1/20 and 20."""
    if not len(y):
        return 1.0

    def loss(t):
        p = softmax(logits / np.exp(t))
        return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).mean()

    low, high, ratio = -3.0, 3.0, (5 ** 0.5 - 1) / 2
    while high - low > 1e-4:
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def _document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts with a letter, and of each slot the texts that have it, over all rows of ``docs(text)``."""
    def run(batches):
        df, total = np.zeros(SLOTS, np.int64), 0
        for b in sliced(batches):
            for text in b.column(0).to_pylist():
                slots, _ = ngram_counts(text)
                df[slots] += 1
                total += bool(len(slots))
        slots = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(slots, SLOTS)), pa.array(np.append(df[slots], total))], names=["slot", "n"])

    rows = docs.mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()  # SLOTS + 1 at most
    out = np.zeros(SLOTS + 1, np.int64)
    for r in rows:
        out[r.slot] = r.n
    return int(out[SLOTS]), out[:SLOTS]


def train_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                         learn: Column | None = None, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Fit on the rows where ``learn`` holds and the language is known (by default all that are not held out).

    Document frequencies come from all those rows; the weights from about ``per_language`` rows of each
    language, drawn by hash of the id; a fifth of the draw only sets the temperature. Without any such row the
    model knows no language.
    """
    learn = ~held_out(id_col) if learn is None else learn
    rows = docs.where(learn).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang is not null and text is not null")
    total, df = _document_frequencies(rows.select("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    blank = LanguageModel(languages, idf, np.zeros((SLOTS, len(languages))), np.zeros(len(languages)))
    if not languages:
        return blank
    share = F.lit(None).cast("double")
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))).otherwise(share)
    draw = F.shiftrightunsigned(F.xxhash64("id", F.lit("sample")), 11) / float(1 << 53)
    sample = rows.where(draw < share).select("text", "lang", (F.xxhash64("id", F.lit("part")) % 5 == 0).alias("aside"))

    def run(batches):
        for b in sliced(batches):
            found = [blank.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s.astype(np.int16) for s, _ in found], type=pa.list_(pa.int16())), pa.array([x.astype(np.float32) for _, x in found], type=pa.list_(pa.float32())),
                 b.column(1), b.column(2)], names=["slots", "x", "lang", "aside"])

    # slots fit 16 bits; the driver reads the flat Arrow buffers and holds no other copy of the sample
    table = sample.mapInArrow(run, "slots array<smallint>, x array<float>, lang string, aside boolean").toArrow().combine_chunks()
    order = {name: k for k, name in enumerate(languages)}
    flat = [table.column(k).chunk(0) if table.num_rows else pa.array([], pa.list_(pa.float32())) for k in (0, 1)]
    ends = flat[0].offsets.to_numpy()
    slots, values = (x.values.to_numpy() for x in flat)
    drawn = [(slots[a:e], values[a:e], order[lang], aside) for a, e, lang, aside in zip(ends, ends[1:], table.column(2).to_pylist(), table.column(3).to_pylist()) if e > a]
    drawn.sort(key=lambda r: (r[2], len(r[0]), float(r[1].sum())))  # rows come back in any order
    weights, bias = fit_ftrl([r[:3] for r in drawn if not r[3]], len(languages))
    fitted = LanguageModel(languages, idf, weights, bias)
    aside = [r for r in drawn if r[3]]
    logits = np.array([fitted.logits(s, x) for s, x, _, _ in aside]).reshape(-1, len(languages))
    model = LanguageModel(languages, idf, weights, bias, calibrated_temperature(logits, np.array([r[2] for r in aside], np.int64)))
    del table, flat, slots, values, drawn, aside
    pa.default_memory_pool().release_unused()  # the driver goes on with other stages
    return model


def predict_language(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, lang_pred, score)`` of every row: the likeliest language and its calibrated probability.

    Null texts and texts without a letter: ``und`` with score 0, as everything if the model knows no language.
    Null and repeated ids are kept as they are; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in sliced(batches):
            found = [shared.value.predict(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                names=["id", "held_out", "lang_pred", "score"])

    schema = T.StructType([
        T.StructField("id", docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def with_known_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose language is known with probability ``least`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches):
        for b in sliced(batches):
            found = [shared.value.predict(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([n != UNKNOWN and s >= least for n, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
