"""Mixing to target weights by soft membership (DataFrame and Spark ML functions only).

A classifier learned from a labelled table gives every document a posterior over
domains. Nonnegative document rates then make the expected tokens of each domain meet
its target: projected-gradient least squares, whose every step is one aggregation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.store import written
from .common import first_of_each, small

#: Most labelled rows of one domain that are learned from; most domains.
PER_DOMAIN, MAX_DOMAINS = 2000, 32
#: Rows that a word's prior counts for; least log odds that speak for a domain.
PRIOR, LEAST = 20.0, 1.0
#: The miss of a target, as a share of all tokens, at which steps end; steps after which rates are written; the gain by which they must have lessened the miss.
CLOSE, TOGETHER, GAIN = 1e-6, 6, 1e-3
#: Where targets can't be met steps end when the projected gradient is so small, or when the miss is within this share of the least one.
STILL, NEAR = 1e-4, 0.02
#: Cells of like posteriors in which steps are begun anew then, and how finely posteriors are told apart at most.
CELLS, FINE = 50_000, 64
_SYMBOLS = "[&%$#*|!]"


def _features(docs: DataFrame, text_col: str) -> DataFrame:
    """docs with tokens, words (hashes of the different ones), how many those are, and plain (a few figures of the text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    all_words = F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}]+)"), 1)
    with_words = docs.withColumn("__w", all_words).withColumn("tokens", F.size("__w").cast("double")).withColumn("words", F.transform(F.array_distinct("__w"), lambda w: F.xxhash64(w)))
    length = F.greatest(F.char_length(text), F.lit(1))
    plain = [
        F.log1p("tokens"),
        F.size("words") / (F.col("tokens") + 1),
        F.regexp_count(text, F.lit(_SYMBOLS)) / length,
        length / (F.col("tokens") + 1) / 100,
    ]
    return with_words.withColumns({"plain": F.array(*plain), "different": F.size("words")}).drop("__w")


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, domain_col: str, names: Sequence[str]) -> DataFrame:
    """Features of at most PER_DOMAIN labelled rows of each domain, by hash of id, with domain number and weight."""
    number = F.array_position(F.array(*map(F.lit, names)), F.col(domain_col)) - 1
    known = labels.select(F.col(id_col).alias("id"), number.cast("int").alias("label")).filter("id is not null and label >= 0").dropDuplicates(["id"])
    sizes = known.groupBy("label").agg(F.count("*").alias("all"))
    taken = first_of_each(known, ["label"], PER_DOMAIN).join(F.broadcast(sizes), "label")
    taken = taken.withColumn("weight", F.col("all") / F.least(F.col("all"), F.lit(PER_DOMAIN)))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(taken), "id")
    return written(_features(rows, "text").drop("text").withColumn("row", F.monotonically_increasing_id()), "labelled")


def _speaking(rows: DataFrame, domains: int) -> DataFrame:
    """(word, s0, s1, ...): 1 for the domains that a word speaks for, by smoothed log odds against the others; others 0."""
    total = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n = [float(total.get(d, 0)) for d in range(domains)]
    counts = rows.select("label", F.explode("words").alias("word")).groupBy("word").agg(*[F.count_if(F.col("label") == d).alias(f"c{d}") for d in range(domains)])
    speaks = []
    for d in range(domains):
        rest, everything = sum(n) - n[d], max(sum(n), 1.0)
        a = (F.col(f"c{d}") + PRIOR * n[d] / everything + 1e-9) / (n[d] + PRIOR)
        others = reduce(lambda x, y: x + y, [F.col(f"c{e}") for e in range(domains) if e != d], F.lit(0))
        b = (others + PRIOR * rest / everything + 1e-9) / (rest + PRIOR)
        speaks.append((F.log(a / b) > LEAST).cast("int").alias(f"s{d}"))
    return written(counts.select("word", *speaks).filter(" or ".join(f"s{d} > 0" for d in range(domains))), "speaking")


def _vector(rows: DataFrame, speaking: DataFrame, domains: int) -> DataFrame:
    """rows(row, words, plain, ...), a written table, with features: the plain figures, and the share of different words that speak for each domain."""
    hits = rows.select("row", F.explode("words").alias("word")).join(small(speaking), "word").groupBy("row").agg(*[F.sum(f"s{d}").alias(f"s{d}") for d in range(domains)])
    share = [F.sqrt(F.coalesce(f"s{d}", F.lit(0)) / (F.col("different") + 5)).alias(f"f{4 + d}") for d in range(domains)]
    kept = [c for c in rows.columns if c not in ("words", "plain", "different")]
    wide = rows.drop("words").join(hits.hint("shuffle_hash"), "row", "left").select(*kept, *[F.col("plain")[i].alias(f"f{i}") for i in range(4)], *share)
    named = [f"f{i}" for i in range(4 + domains)]
    return VectorAssembler(inputCols=named, outputCol="features", handleInvalid="keep").transform(wide).drop(*named)


def posteriors(docs: DataFrame, labels: DataFrame, names: Sequence[str], domain_col: str, id_col: str = "doc_id", text_col: str = "text", known: DataFrame | None = None) -> DataFrame:
    """(id, tokens, p) of every row of docs; p has the posterior of each domain in names.

    Learned from the labelled rows of known, or of docs. Alike for all domains where
    there is nothing to learn from.
    """
    featured = _features(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").drop("text")
    rows = written(featured.withColumn("row", F.monotonically_increasing_id()), "words")
    training = _training(docs if known is None else known, labels, id_col, text_col, domain_col, names)
    if training.isEmpty():
        return written(rows.select("id", "tokens", F.array(*[F.lit(1.0 / len(names))] * len(names)).alias("p")), "posteriors")
    speaking = _speaking(training, len(names))
    learner = LogisticRegression(family="multinomial", weightCol="weight", regParam=1e-3, maxIter=1000)
    model = learner.fit(written(_vector(training, speaking, len(names)).coalesce(6), "training"))
    out = model.setProbabilityCol("prob").transform(_vector(rows, speaking, len(names))).select("id", "tokens", vector_to_array("prob").alias("p"))
    pad = F.array(*[F.lit(0.0)] * len(names))
    return written(out.select("id", "tokens", F.slice(F.concat("p", pad), 1, len(names)).alias("p")), "posteriors")


def _stepped(steps: Sequence[tuple[float, np.ndarray]]) -> Column:
    """Struct (rate, last) of a row of (p, rate, last) after some steps of (momentum, how far to go along each domain)."""
    state = F.struct(F.col("rate"), F.col("last"))
    if not steps:
        return state
    each = F.array(*[F.struct(F.lit(float(b)).alias("b"), F.array(*[F.lit(float(x)) for x in c]).alias("c")) for b, c in steps])

    def step(at: Column, s: Column) -> Column:
        along = reduce(lambda a, b: a + b, [F.col("p")[i] * s["c"][i] for i in range(len(steps[0][1]))])
        return F.struct(F.greatest(F.lit(0.0), at["rate"] + s["b"] * (at["rate"] - at["last"]) - along).alias("rate"), at["rate"].alias("last"))

    return F.aggregate(each, state, step)


def _bound(least: float, w: np.ndarray, goal: np.ndarray, m: np.ndarray) -> float:
    """What twice the squared miss can't fall below, by the dual problem; least is the smallest p . w of all rows."""
    w = w + max(0.0, -least)
    return float(-goal @ w - w @ m @ w / 2)


def _cell_rates(p: np.ndarray, share: np.ndarray, goal: np.ndarray, even: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Projected gradient over cells (mean posterior, share of tokens), with momentum that starts anew when the miss grows."""
    r = last = np.ones(len(p))
    since, before = 0, np.inf
    while True:
        miss, pull = (share * r) @ p - goal, (share * last) @ p
        w = even @ miss
        size, g = float(miss @ w) / 2, p @ w
        still = np.sqrt((share * (r - np.maximum(0, r - g)) ** 2).sum())
        if np.abs(miss).max() < CLOSE / 10 or still < STILL / 100 or size - _bound(float(g.min()), w, goal, m) < NEAR / 10 * size:
            return r
        since = 0 if size > before else since
        before, momentum = size, max(0.0, (since - 1) / (since + 2))
        along = even @ (miss + momentum * (miss + goal - pull))
        r, last, since = np.maximum(0, r + momentum * (r - last) - p @ along), r, since + 1


def _anew(at: DataFrame, share: Column, goal: np.ndarray, even: np.ndarray, m: np.ndarray) -> DataFrame:
    """Rows of at with the rates of their cells: what steps would come to that move all rows of a cell alike.

    At most CELLS rows of sums, one a cell, are worked on in the driver.
    """
    k, fine = len(goal), FINE
    while True:
        cell = F.transform("p", lambda x: F.round(x * fine).cast("int"))
        sums = written(at.groupBy(cell.alias("__cell")).agg(F.sum(share).alias("share"), *[F.sum(share * F.col("p")[i]).alias(f"q{i}") for i in range(k)]), "cells")
        if fine == 1 or sums.count() <= CELLS:
            break
        fine //= 2
    rows = sums.filter("share > 0").limit(CELLS).collect()
    weight = np.array([r["share"] for r in rows])
    p = np.array([[r[f"q{i}"] for i in range(k)] for r in rows]) / weight[:, None]
    rates = _cell_rates(p, weight, goal, even, m)
    table = at.sparkSession.createDataFrame([(list(r["__cell"]), float(x)) for r, x in zip(rows, rates, strict=True)], "__cell array<int>, __rate double")
    found = at.drop("rate", "last").withColumn("__cell", cell).join(F.broadcast(table), "__cell", "left").drop("__cell")
    rate = F.coalesce("__rate", F.lit(1.0))
    return written(found.withColumns({"rate": rate, "last": rate}).drop("__rate"), "rates")


def fit_rates(rows: DataFrame, targets: Sequence[float], close: float = CLOSE) -> DataFrame:
    """rows(tokens, p, ...), a written table, with the rate of each row.

    Least squares over rates r >= 0 of the miss: sum of share of tokens * p * r, less
    the targets. Rates start at 1; a step goes on as the last one did, with growing
    momentum, then along the gradient of the miss, in which the domains' Gram matrix
    evens out how large and how alike they are, and is cut at 0; with it no step is too
    long. A step reads the rows once and brings a few figures a domain to the driver.
    Steps end when the targets are met. Where they can't be, steps gain less and less: they
    go on from the rates that cells of rows with like posteriors come to, until the
    projected gradient is still or the miss is as good as the least one.
    """
    k = len(targets)
    goal = np.array(targets, float) / sum(targets)
    total = rows.agg(F.sum("tokens")).first()[0] or 0.0
    if not total:
        return rows.withColumn("rate", F.lit(1.0))
    share = F.col("tokens") / F.lit(float(total))
    gram = rows.agg(*[F.sum(share * F.col("p")[i] * F.col("p")[j]) for i in range(k) for j in range(k)]).first()
    m = np.array(gram, float).reshape(k, k)
    m = m + 1e-6 * np.trace(m) * np.eye(k)
    even = np.linalg.inv(m)
    at, steps, done, before, anew = rows.withColumns({"rate": F.lit(1.0), "last": F.lit(1.0)}), [], 0, np.inf, False
    while True:
        now = at.withColumn("__s", _stepped(steps))
        sums = now.agg(*[F.sum(share * F.col("p")[i] * F.col(f"__s.{c}")) for c in ("rate", "last") for i in range(k)]).first()
        rate, last = np.array(sums, float).reshape(2, k)
        miss = rate - goal
        enough = np.abs(miss).max() < close
        if done % TOGETHER == 0 and done and not enough:
            size = float(miss @ even @ miss)
            stalled, before = before - size < GAIN * size, size
            at, steps = written(now.withColumns({"rate": F.col("__s.rate"), "last": F.col("__s.last")}).drop("__s"), "rates"), []
            if stalled and not anew:
                at, done, before, anew = _anew(at, share, goal, even, m), 0, np.inf, True
                continue
            if stalled:
                done = 0  # momentum starts anew
        if anew and not steps and not enough:
            w = even @ miss
            g = reduce(lambda a, b: a + b, [F.col("p")[i] * F.lit(float(w[i])) for i in range(k)])
            moved = F.col("rate") - F.greatest(F.lit(0.0), F.col("rate") - g)
            still, least = at.agg(F.sum(share * moved * moved), F.min(F.when(F.col("tokens") > 0, g))).first()
            size = float(miss @ w) / 2
            enough = still**0.5 < STILL or size - _bound(least, w, goal, m) < NEAR * size
        if enough:
            return at.withColumn("__s", _stepped(steps)).withColumn("rate", F.col("__s.rate")).drop("__s", "last")
        momentum = max(0.0, (done - 1) / (done + 2))
        steps.append((momentum, even @ (miss + momentum * (rate - last))))
        done += 1


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: Mapping[str, float],
    domain_col: str = "domain",
    id_col: str = "doc_id",
    text_col: str = "text",
    known: DataFrame | None = None,
) -> DataFrame:
    """id, tokens, p_<domain> for each target, rate, copies; one row per row of docs.

    rate is how often a document is to be drawn for the domains' expected tokens to
    stand as the targets do, with as many tokens in all as now; copies is the rate
    rounded up or down by the hash of the id, right on average. Targets that no rates
    meet are met as nearly as least squares can. Repeated rows count as often as they
    stand there. known has the texts of the labels where
    docs no longer has all of them. Null and empty texts have no tokens;
    labels of other domains, null ids and nulls in labels aren't learned from. Very long
    texts count with all their tokens; ties don't arise but in the samples, where the id's
    hash decides. An empty table gives no rows; other columns, and their names, have no
    effect. At most MAX_DOMAINS domains.
    """
    names = sorted(targets)
    if not names or len(names) > MAX_DOMAINS or min(targets.values()) < 0 or not sum(targets.values()):
        raise ValueError(f"targets: 1 to {MAX_DOMAINS} domains, no negative weights, not all zero")
    rows = posteriors(docs, labels, names, domain_col, id_col, text_col, known)
    rows = fit_rates(rows, [targets[n] for n in names])
    chance = F.pmod(F.xxhash64(F.lit("copies"), "id"), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor("rate") + (chance < F.col("rate") - F.floor("rate")).cast("long")).alias("copies")
    out = rows.select("id", F.col("tokens").cast("long").alias("tokens"), *[F.col("p")[i].alias(f"p_{n}") for i, n in enumerate(names)], "rate")
    return out.select("*", copies).withColumnRenamed("id", id_col)


#: Domains of the given labels, and the token shares wanted.
TARGETS = {"good": 0.87, "low": 0.08, "toxic": 0.05}


def label_domains(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality, toxic) as doc_id, domain."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))
