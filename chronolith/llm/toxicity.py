"""Toxicity by a classifier chain.

Categories are predicted in order. Each one's linear model sees the text's evidence for
the category (the share of words that speak for it, by themselves or by how they begin,
times how strongly) and the probabilities of the earlier categories. In training both
come from counts and models that didn't see the row.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.store import written
from .common import first_of_each

#: Columns of labels, with the value that means the category, in the order of the chain.
CATEGORIES = (("quality", 0), ("toxic", 1))
#: A word counts whole (0), and by its beginnings of these lengths, as inflected words share them.
BEGINNINGS = (5, 7, 0)
#: Most labelled rows of one combination of labels that are learned from.
PER_CLASS = 2500
#: Rows that a word's prior counts for; the least log odds, and labelled rows, that are evidence.
PRIOR, LEAST, ROWS = 20.0, 1.0, 2
FOLDS, RIDGE = 3, 1e-3
THRESHOLD = 0.5
#: Words whose evidence a task remembers.
KEPT = 1 << 17
_MARKS = tuple((str(n), n or None) for n in BEGINNINGS)
_WORD = re.compile(r"[^\W\d_]+")


def beginnings(text: str | None) -> tuple[Counter, int]:
    """Counts of the beginnings of text's words, marked with their length, and the number of words."""
    words = _WORD.findall((text or "").lower())
    return Counter(f"{n}{w[:n] if n else w}" for n in BEGINNINGS for w in words), len(words)


def evidence(text: str | None, odds: dict[str, np.ndarray], width: int, kept: dict[str, np.ndarray | None] | None = None) -> np.ndarray:
    """Root of the share of words times their log odds: a value for each length and column of odds.

    `kept` remembers what a word adds, None where nothing; it forgets all at KEPT words.
    """
    out = np.zeros((len(BEGINNINGS), width))
    kept = {} if kept is None else kept
    words = _WORD.findall((text or "").lower())
    for w, c in Counter(words).items():
        row = kept.get(w, odds)  # odds stands for a word not seen yet
        if row is odds:
            rows = [odds.get(mark + w[:n]) for mark, n in _MARKS]
            row = np.array([np.zeros(width) if r is None else r for r in rows]) if any(r is not None for r in rows) else None
            if len(kept) >= KEPT:
                kept.clear()
            kept[w] = row
        if row is not None:
            out += c * row
    return np.sqrt(out / (len(words) + 5)).ravel()


@dataclass(frozen=True)
class Chain:
    odds: dict[str, np.ndarray]  # beginning -> log odds for each category
    weights: list[np.ndarray]  # of a category: its evidence, earlier probabilities, constant

    def probabilities(self, text: str | None, kept: dict[str, np.ndarray | None] | None = None) -> list[float]:
        width, p = len(self.weights), []
        x = evidence(text, self.odds, width, kept).reshape(len(BEGINNINGS), width) if width else None
        for i, w in enumerate(self.weights):
            p.append(float(_sigmoid(np.r_[x[:, i], p, 1.0] @ w)))
        return p


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the constant is the last input."""
    w, ridge = np.zeros(x.shape[1]), RIDGE * np.eye(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, columns: Sequence[str]) -> DataFrame:
    """(id, text, weight, fold, labels...) of at most PER_CLASS labelled rows of each combination.

    Rows are taken by hash of id; weights restore the combinations' shares.
    """
    labelled = labels.select(F.col(id_col).alias("id"), *[F.col(c).cast("int").alias(c) for c in columns]).filter(F.col("id").isNotNull()).dropDuplicates(["id"])
    sizes = labelled.groupBy(*columns).agg(F.count("*").alias("all"))
    taken = first_of_each(labelled, columns, PER_CLASS)
    same = reduce(lambda a, b: a & b, [taken[c].eqNullSafe(sizes[c]) for c in columns])
    weight = (F.col("all") / F.least(F.col("all"), F.lit(PER_CLASS))).alias("weight")
    fold = F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int").alias("fold")
    taken = taken.join(F.broadcast(sizes), same).select(taken["*"], weight, fold)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    return written(rows.join(F.broadcast(taken), "id"), "labelled")


def _log_odds(rows: DataFrame, categories: Sequence[tuple[str, int]]) -> dict[str, np.ndarray]:
    """Of each beginning its positive log odds for every category, over all rows and without each fold.

    Columns: category by category, first over all rows, then without fold 0, 1, ...
    """

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list(beginnings(t.as_py())[0]) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), *b.columns[1:]], ["found", *b.schema.names[1:]])

    marks = [F.when(F.col(c) == v, F.lit(1)).when(F.col(c).isNotNull(), F.lit(0)).alias(f"y{i}") for i, (c, v) in enumerate(categories)]
    fields = ", ".join(f"y{i} int" for i in range(len(categories)))
    found = rows.select("text", "fold", *marks).mapInArrow(split, f"found array<string>, fold int, {fields}")
    found = written(found, "beginnings")
    sums = [
        F.sum(((F.col(f"y{i}") == y) & (F.lit(f < 0) | (F.col("fold") != f))).cast("double")).alias(f"s{i}_{f + 1}_{y}")
        for i in range(len(categories))
        for f in range(-1, FOLDS)
        for y in (0, 1)
    ]
    total = np.array([x or 0.0 for x in found.agg(*sums).first()]).reshape(-1, 2)
    by = found.select(F.explode("found").alias("b"), "fold", *[f"y{i}" for i in range(len(categories))]).groupBy("b").agg(*sums)
    share = total / np.maximum(total.sum(1, keepdims=True), 1)
    odds = []
    for j, name in enumerate(dict.fromkeys(s.rsplit("_", 1)[0] for s in by.columns[1:])):
        a, b = (F.log((F.coalesce(f"{name}_{y}", F.lit(0.0)) + PRIOR * float(share[j, y]) + 1e-9) / (float(total[j, y]) + PRIOR)) for y in (1, 0))
        odds.append(F.when(a - b > LEAST, a - b).otherwise(0.0).alias(f"o{j}"))
    seen_by = F.greatest(*[F.coalesce(f"s{i}_0_0", F.lit(0.0)) + F.coalesce(f"s{i}_0_1", F.lit(0.0)) for i in range(len(categories))], F.lit(0.0))
    kept = by.filter(seen_by >= ROWS).select("b", *odds).filter(" or ".join(f"o{j} > 0" for j in range(len(odds))))
    return {r[0]: np.array(r[1:]) for r in kept.toLocalIterator()}  # words of the bounded sample


def fit_chain(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, categories: Sequence[tuple[str, int]]) -> Chain:
    """The chain, from the bounded sample of labelled rows; only evidence comes to the driver."""
    rows = training_rows(docs, labels, id_col, text_col, [c for c, _ in categories])
    if rows.isEmpty():
        return Chain({}, [])
    odds = _log_odds(rows, categories)
    width, spark = len(categories) * (FOLDS + 1), docs.sparkSession
    shared = spark.sparkContext.broadcast(odds)

    @F.pandas_udf("array<double>")
    def seen(text: pd.Series) -> pd.Series:
        kept: dict[str, np.ndarray | None] = {}
        return pd.Series([evidence(t, shared.value, width, kept) for t in text])

    marks = [F.when(F.col(c) == v, F.lit(1.0)).when(F.col(c).isNotNull(), F.lit(0.0)) for c, v in categories]
    got = rows.select("id", "fold", "weight", F.array(*marks).alias("y"), seen("text").alias("x")).collect()
    got.sort(key=lambda r: r["id"])
    fold, weight = np.array([r["fold"] for r in got]), np.array([r["weight"] for r in got])
    y = np.array([[np.nan if v is None else v for v in r["y"]] for r in got])
    x = np.array([r["x"] for r in got]).reshape(len(got), len(BEGINNINGS), len(categories), FOLDS + 1)
    weights, x = [], x[np.arange(len(got)), :, :, fold + 1]  # evidence without the row's own fold
    one, earlier = np.ones((len(got), 1)), np.zeros((len(got), 0))
    for i in range(len(categories)):
        inputs, known = np.hstack([x[:, :, i], earlier, one]), ~np.isnan(y[:, i])
        weights.append(_logistic(inputs[known], y[known, i], weight[known]))
        out = np.zeros(len(got))
        for f in range(FOLDS):
            rest = known & (fold != f)
            out[fold == f] = _sigmoid(inputs[fold == f] @ _logistic(inputs[rest], y[rest, i], weight[rest]))
        earlier = np.hstack([earlier, out[:, None]])
    return Chain({b: o.reshape(len(categories), FOLDS + 1)[:, 0].copy() for b, o in odds.items()}, weights)


def chain_probabilities(chain: Chain, docs: DataFrame, text: Column, categories: int) -> Column:
    """Array of the categories' probabilities of a text column; zeros where nothing was learned."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    @F.pandas_udf("array<double>")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        kept: dict[str, np.ndarray | None] = {}
        for texts in parts:
            yield pd.Series([shared.value.probabilities(t, kept) or [0.0] * categories for t in texts])

    return predict(text.cast("string"))


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    categories: Sequence[tuple[str, int]] = CATEGORIES,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """id, p_<column> for each category, toxic: the last one's probability reaches the threshold.

    One row per row of docs. Null and empty texts get what a text without words gets.
    Rows with a null id get predictions like any other and aren't learned from; of rows
    of labels with one id one is learned from. Without labels all probabilities are 0.
    """
    chain = fit_chain(docs, labels, id_col, text_col, categories)
    p = chain_probabilities(chain, docs, F.col(text_col), len(categories))
    rows = docs.select(F.col(id_col), p.alias("p"))
    named = [F.col("p")[i].alias(f"p_{c}") for i, (c, _) in enumerate(categories)]
    return rows.select(id_col, *named, (F.col("p")[len(categories) - 1] >= threshold).alias("toxic"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text is toxic; columns as before, nothing joined or shuffled.

    Each row counts by itself, as in toxicity: null and empty texts as texts without
    words, very long ones whole, repeated rows and null ids like any other. Without
    labels nothing goes; an empty table stays empty.
    """
    chain = fit_chain(docs, labels, id_col, text_col, CATEGORIES)
    p = chain_probabilities(chain, docs, F.col(text_col), len(CATEGORIES))
    return docs.filter(p[len(CATEGORIES) - 1] < THRESHOLD)
