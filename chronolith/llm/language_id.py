"""Language identification by string kernels.

Kernel: the share of character n-grams, of several lengths blended, that two texts
both have (presence, not counts; the cosine of 0/1 vectors). Nystroem: a few landmark
texts stand for the training texts; ridge regression on their feature map gives one
scorer per language against the rest. A batch of texts is scored by two matrix
products: presence by landmarks, then kernels by weights.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fold

#: n-gram lengths; n-grams share DIM slots by hash.
LENGTHS, DIM = (1, 2, 3), 1 << 13
#: Bounds of the training sample, by language and in all, and of the landmarks among it.
PER_LANG, MAX_TRAIN, LANDMARKS = 300, 6000, 256
RIDGE = 1e-3
#: Texts scored at once; a text is read in pieces of so many characters.
BLOCK, PIECE = 256, 1 << 20


def _slots(x: np.ndarray) -> Iterator[np.ndarray]:
    """Slots of the n-grams of folded code points."""
    c = x.astype(np.uint64)
    for n in LENGTHS:
        if len(c) >= n:
            h = np.full(len(c) - n + 1, n, np.uint64)
            for i in range(n):
                h = (h ^ c[i : len(c) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            yield (h >> np.uint64(51)).astype(np.int64)


def presence(text: str, out: np.ndarray) -> bool:
    """Sets the slots of text's n-grams in out to 1; False, and none, if it has no letter."""
    if not any(map(str.isalpha, text)):
        return False
    low = max(LENGTHS) - 1
    for i in range(0, len(text), PIECE):
        x = fold(text[max(0, i - low) : i + PIECE])[0]
        for slots in _slots(x):
            out[slots] = 1
    return True


@dataclass(frozen=True)
class Model:
    langs: list[str]
    landmarks: np.ndarray  # DIM x landmarks, columns of length 1
    weights: np.ndarray  # landmarks x languages

    def scores(self, x: np.ndarray) -> np.ndarray:
        """x: texts x DIM, presence."""
        norm = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        return (x @ self.landmarks / norm) @ self.weights


def fit(bits: np.ndarray, langs: list[str]) -> Model:
    """Landmarks, feature map and ridge regression from training texts' presence."""
    names = sorted(set(langs))
    x = bits.astype(np.float64)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    y = np.array([[float(a == b) for b in names] for a in langs])
    # Landmarks in turn from each language; rows come in the sample's own (hashed) order.
    turn = np.zeros(len(langs))
    for name in names:
        at = [i for i, a in enumerate(langs) if a == name]
        turn[at] = np.arange(len(at))
    chosen = np.argsort(turn, kind="stable")[:LANDMARKS]
    marks = x[chosen]
    value, vector = np.linalg.eigh(marks @ marks.T)
    good = value > 1e-8 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])
    z = x @ marks.T @ whiten
    share = np.array([1.0 / langs.count(a) for a in langs])[:, None] * len(langs) / len(names)  # each language counts alike
    ridge = np.linalg.solve(z.T @ (share * z) + RIDGE * len(langs) * np.eye(z.shape[1]), z.T @ (share * y))
    return Model(names, marks.T.astype(np.float32), (whiten @ ridge).astype(np.float32))


def train(docs: DataFrame, id_col: str, text_col: str, lang_col: str, usable: Column) -> Model | None:
    """Fits a Model on at most PER_LANG rows of a language, MAX_TRAIN in all, by hash of id.

    Of repeated ids one row counts for the bounds. Only the sample's presence bits (DIM /
    8 bytes a text) come to the driver.
    """
    able = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang")).dropDuplicates(["id"])
    order = W.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    sample = able.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= PER_LANG).orderBy("n", "lang").limit(MAX_TRAIN)
    rows = docs.filter(usable).select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(sample.select("id", "lang", "n")), "id").dropDuplicates(["id"])

    def bits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed, has = [], []
            for t in b.column(0):
                x = np.zeros(DIM, np.uint8)
                has.append(presence(t.as_py(), x))
                packed.append(np.packbits(x).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(packed, pa.binary()), b.column(1), b.column(2), pa.array(has, pa.bool_())], ["bits", "lang", "n", "has"])

    got = rows.select("text", F.col("lang").cast("string"), F.col("n").cast("int")).mapInArrow(bits, "bits binary, lang string, n int, has boolean").filter("has").collect()
    got.sort(key=lambda r: (r["n"], r["lang"], bytes(r["bits"])))
    if not got:
        return None
    return fit(np.unpackbits(np.array([np.frombuffer(r["bits"], np.uint8) for r in got]), axis=1), [r["lang"] for r in got])


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score; one row per row of docs, read from id and text alone.

    `und` with score 0 where text is null or has no letter, or where nothing was learned.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        x = np.zeros((BLOCK, DIM), np.float32)
        for whole in batches:
            for b in (whole.slice(i, BLOCK) for i in range(0, whole.num_rows, BLOCK)):
                x[:] = 0
                has = np.array([m is not None and t.is_valid and presence(t.as_py(), x[i]) for i, t in enumerate(b.column(1))])
                lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
                if has.any():
                    s = m.scores(x[: b.num_rows])
                    best = s.argmax(1)
                    score = np.where(has, np.clip(s.max(1), 0, 1), 0).astype(np.float64)
                    lang = [m.langs[k] if ok else "und" for k, ok in zip(best, has, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score)], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id, held_out, lang_pred, score; learned from the rows that are not held out.

    Null ids are not held out and not learned from; repeated rows get the same answer.
    Very long texts are read whole, in pieces; of equal scores the first language by name
    counts. An empty table gives no rows; a table without usable languages gives `und`;
    other columns, and their names, have no effect.
    """
    model = train(docs, id_col, text_col, lang_col, ~held_out(id_col) & F.col(id_col).isNotNull())
    return identify(docs, model, id_col, text_col).select(id_col, held_out(id_col).alias("held_out"), "lang_pred", "score")
