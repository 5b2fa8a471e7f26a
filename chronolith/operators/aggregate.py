"""Aggregations of frames to trials, of trials to subjects, and of predictions to reports."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .percentiles import exact_percentiles, percentile_columns

STATS = ("mean", "std", "min", "max", "sum", "first", "last")


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def ratio0(a: Column, b: Column) -> Column:
    return F.coalesce(ratio(a, b), F.lit(0.0))


def aggregate_trials(frames: DataFrame, keys: Sequence[str], values: Sequence[str], stats: Sequence[str] = STATS, frame: str = "frame") -> DataFrame:
    """keys, frame_count, frame_start, frame_end and <value>_<stat>; partial and final, map side first."""
    how = {
        "mean": F.avg,
        "std": F.stddev_samp,
        "min": F.min,
        "max": F.max,
        "sum": F.sum,
        "first": lambda c: F.min_by(c, frame),
        "last": lambda c: F.max_by(c, frame),
    }
    out = [F.count("*").alias("frame_count"), F.min(frame).alias("frame_start"), F.max(frame).alias("frame_end")]
    return frames.groupBy(*keys).agg(*out, *[how[s](v).alias(f"{v}_{s}") for v in values for s in stats])


def responder_aggregates(frames: DataFrame, keys: Sequence[str], value: str = "value", high: float = 75.0, fps: int = 40, frame: str = "frame") -> DataFrame:
    """Ten figures of each trial from flagged frames(is_before, is_during, on_idx, off_idx, coordinates)."""
    v, before, during = F.col(value), F.col("is_before") == 1, F.col("is_during") == 1
    dx, dy = F.col("prob_x") - F.col("eye_x"), F.col("prob_y") - F.col("eye_y")
    size = F.hypot(dx, dy)
    moves = during & v.isNotNull() & (size > 0)
    one = (F.min("on_idx") == F.max("on_idx")) & (F.min("off_idx") == F.max("off_idx"))
    first = during & (F.col(frame) >= F.col("on_idx")) & (F.col(frame) < F.least(F.col("on_idx") + fps, F.col("off_idx") + 1))
    agg = frames.groupBy(*keys).agg(
        F.avg(F.when(before, v)).alias("before_mean"),
        F.stddev_samp(F.when(before, v)).alias("before_std"),
        F.avg(F.when(during, v)).alias("during_mean"),
        F.stddev_samp(F.when(during, v)).alias("during_std"),
        F.avg(F.when(moves, dx / size)).alias("direction_cos"),
        F.avg(F.when(moves, dy / size)).alias("direction_sin"),
        ratio(F.count_if(during & (v >= high)), F.count(F.when(during, v))).alias("high_fraction"),
        F.when(one, F.avg(F.when(first, v))).alias("first_second"),
    )
    return agg.select(
        *keys,
        "before_mean",
        "before_std",
        "during_mean",
        "during_std",
        (F.col("during_mean") - F.col("before_mean")).alias("during_minus_before"),
        "direction_cos",
        "direction_sin",
        F.hypot("direction_cos", "direction_sin").alias("direction_consistency"),
        "high_fraction",
        (F.col("first_second") - F.col("before_mean")).alias("rise_speed"),
    )


def assemble_traces(frames: DataFrame, keys: Sequence[str], value: str = "value", frame: str = "frame") -> DataFrame:
    """keys, trace, contiguous: the values in order of frame, and whether frames run 0, 1, 2, ..."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), F.col(value).alias("v"))))
    out = frames.groupBy(*keys).agg(pairs.alias("p"), ((F.min(frame) == 0) & (F.max(frame) + 1 == F.count("*")) & (F.count_distinct(frame) == F.count("*"))).alias("contiguous"))
    return out.select(*keys, F.transform("p", lambda x: x["v"]).alias("trace"), "contiguous")


def with_group(frames: DataFrame, targets: Sequence[int] = (2, 4, 5), trial: str = "trial") -> DataFrame:
    return frames.withColumn("grp", F.when(F.col(trial).isin(*targets), "A").otherwise("B"))


def mean_traces(frames: DataFrame, subject: str = "subject", frame: str = "frame", value: str = "value", order: Sequence[str] = ()) -> DataFrame:
    """(subject, grp, frame, mean_value, n) of frames with a group.

    With `order` values are added up in this order, not as the shuffle brings them: sums in
    another order differ in their last bits, and so do the signs of differences of equal means.
    """
    by = [subject, "grp", frame]
    if not order:
        return frames.groupBy(*by).agg(F.avg(value).alias("mean_value"), F.count(value).alias("n"))
    so_far = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    sums = frames.select(*by, F.sum(value).over(so_far).alias("__sum"), F.count(value).over(so_far).alias("__n"))
    return sums.groupBy(*by).agg(F.max_by("__sum", "__n").alias("__sum"), F.max("__n").alias("n")).select(*by, F.try_divide("__sum", "n").alias("mean_value"), "n")


def difference_matrix(means: DataFrame, subject: str = "subject", frame: str = "frame") -> DataFrame:
    """(subject, frame, a, b, diff) where the subject has both groups at that frame."""
    wide = means.groupBy(subject, frame).agg(F.max(F.when(F.col("grp") == "A", F.col("mean_value"))).alias("a"), F.max(F.when(F.col("grp") == "B", F.col("mean_value"))).alias("b"))
    return wide.filter("a is not null and b is not null").withColumn("diff", F.col("a") - F.col("b"))


def effects(diffs: DataFrame, frame: str = "frame") -> DataFrame:
    return diffs.groupBy(frame).agg(F.avg("diff").alias("effect_mean"), F.percentile("diff", 0.5).alias("effect_median"), F.count("*").alias("n"))


def subject_responses(responses: DataFrame, trained: Sequence[int], untrained: Sequence[int], subject: str = "subject", trial: str = "trial", hit: str = "hit") -> DataFrame:
    """(subject, trained, untrained): any response in those trials; no trial counts as none."""
    any_in = lambda t: F.coalesce(F.bool_or(F.when(F.col(trial).isin(*t), F.col(hit))), F.lit(False))
    return responses.groupBy(subject).agg(any_in(trained).alias("trained"), any_in(untrained).alias("untrained"))


def contingency_counts(by_subject: DataFrame) -> DataFrame:
    """One row a, b, c, d, total: both, trained only, untrained only, neither."""
    t, u = F.col("trained"), F.col("untrained")
    return by_subject.agg(F.count_if(t & u).alias("a"), F.count_if(t & ~u).alias("b"), F.count_if(~t & u).alias("c"), F.count_if(~t & ~u).alias("d"), F.count("*").alias("total"))


def contingency_table(by_subject: DataFrame) -> DataFrame:
    """(trained, untrained, n) with row, column and grand totals as "all"."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("all")).alias(c)
    return by_subject.cube("trained", "untrained").agg(F.count("*").alias("n")).select(name("trained"), name("untrained"), "n")


def class_balance(df: DataFrame, label: str, weight: str | None = None) -> DataFrame:
    """(label, n, fraction, weights' min, mean, max)."""
    w = F.col(weight) if weight else F.lit(1.0)
    counts = df.groupBy(label).agg(F.count("*").alias("n"), F.min(w).alias("weight_min"), F.avg(w).alias("weight_mean"), F.max(w).alias("weight_max"))
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(W.partitionBy()))


def block_stats(df: DataFrame, keys: Sequence[str], frame: str = "frame") -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_distinct(F.struct(*keys)).alias("n_blocks"), F.min(frame).alias("frame_min"), F.max(frame).alias("frame_max"))


def cluster_summary(df: DataFrame, cluster: str, value: str) -> DataFrame:
    s = df.groupBy(cluster).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    m = percentile_columns(df, value, {"median": 0.5}, [cluster])
    return s.join(m, s[cluster].eqNullSafe(m[cluster]), "left").select(s[cluster], "n", "mean", "median", "max")


def confusion(preds: DataFrame, label: str = "label", predicted: str = "predicted", weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """(by, label, predicted, n, weight, row_share): counts, weights and the share of the label's weight."""
    w = F.col(weight) if weight else F.lit(1.0)
    counts = preds.groupBy(*by, label, predicted).agg(F.count("*").alias("n"), F.sum(w).alias("weight"))
    return counts.withColumn("row_share", F.col("weight") / F.sum("weight").over(W.partitionBy(*by, label)))


def binary_metrics(preds: DataFrame, by: Sequence[str] = (), label: str = "label", predicted: str = "predicted", weight: str | None = None) -> DataFrame:
    """(by, tp, fp, fn, tn, accuracy, precision, recall, f1, fpr, tnr, fnr); 0 where nothing is divided by."""
    w = F.col(weight) if weight else F.lit(1.0)
    y, p = F.col(label) == 1, F.col(predicted) == 1
    s = preds.groupBy(*by).agg(*[F.sum(F.when(c, w).otherwise(0.0)).alias(n) for n, c in (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("tn", ~y & ~p))])
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    precision, recall = ratio0(tp, tp + fp), ratio0(tp, tp + fn)
    return s.select(
        "*",
        ratio0(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        precision.alias("precision"),
        recall.alias("recall"),
        ratio0(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio0(fp, fp + tn).alias("fpr"),
        ratio0(tn, fp + tn).alias("tnr"),
        ratio0(fn, tp + fn).alias("fnr"),
    )


def multiclass_metrics(preds: DataFrame, label: str, predicted: str) -> DataFrame:
    """One row: accuracy, and precision, recall and F1 as macro and weighted means over the labels."""
    pairs = preds.select(F.explode(F.array(F.struct(F.col(label).alias("c"), F.lit(1).alias("is_label")), F.struct(F.col(predicted).alias("c"), F.lit(0).alias("is_label")))).alias("x"), (F.col(label) == F.col(predicted)).alias("hit"))
    per = pairs.groupBy("x.c").agg(F.count_if(F.col("x.is_label") == 1).alias("support"), F.count_if(F.col("x.is_label") == 0).alias("named"), F.count_if(F.col("hit") & (F.col("x.is_label") == 1)).alias("tp"))
    per = per.select("*", ratio0(F.col("tp"), F.col("named")).alias("p"), ratio0(F.col("tp"), F.col("support")).alias("r"), ratio0(2 * F.col("tp"), F.col("named") + F.col("support")).alias("f"))
    macro = [F.avg(c).alias(f"{n}_macro") for n, c in (("precision", "p"), ("recall", "r"), ("f1", "f"))]
    weighted = [(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"{n}_weighted") for n, c in (("precision", "p"), ("recall", "r"), ("f1", "f"))]
    return per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"), *macro, *weighted)


def subject_rates(trials: DataFrame, subject: str = "subject", label: str = "label") -> DataFrame:
    return trials.groupBy(subject).agg(F.count("*").alias("n"), F.avg(label).alias("rate"))


def error_profile(preds: DataFrame, by: str = "split") -> DataFrame:
    """Counts, precision, recall, F1, and the probabilities of false positives and negatives, by split."""
    out = binary_metrics(preds, [by]).select(by, "tp", "fp", "fn", "tn", "precision", "recall", "f1")
    kinds = {"fp": (F.col("label") == 0) & (F.col("predicted") == 1), "fn": (F.col("label") == 1) & (F.col("predicted") == 0)}
    stats = [f(F.when(c, F.col("prob"))).alias(f"{k}_{n}") for k, c in kinds.items() for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))]
    out = out.join(preds.groupBy(by).agg(*stats), by)
    wrong = preds.select(by, F.when(kinds["fp"], "fp").when(kinds["fn"], "fn").alias("__kind"), "prob").filter("__kind is not null")
    medians = percentile_columns(wrong, "prob", {"median": 0.5}, [by, "__kind"]).groupBy(by).agg(*[F.max(F.when(F.col("__kind") == k, F.col("median"))).alias(f"{k}_median") for k in kinds])
    return out.join(medians, by, "left")


def missed_by_intensity(preds: DataFrame, by: str = "split") -> DataFrame:
    """(split, map text): false negatives for each intensity, as "intensity:n" in order."""
    missed = preds.filter("label = 1 and predicted = 0").groupBy(by, "intensity").agg(F.count("*").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct("intensity", "n")))
    return missed.groupBy(by).agg(F.array_join(F.transform(pairs, lambda x: F.concat_ws(":", x["intensity"].cast("string"), x["n"].cast("string"))), ",").alias("missed"))


def misclassified(preds: DataFrame, subject: str = "subject") -> DataFrame:
    """(subject, n, errors, error_rate, uncertain, confident_wrong, mean_prob_correct, mean_prob_error)."""
    wrong = F.col("label") != F.col("predicted")
    return preds.groupBy(subject).agg(
        F.count("*").alias("n"),
        F.count_if(wrong).alias("errors"),
        F.avg(wrong.cast("double")).alias("error_rate"),
        F.count_if((F.col("prob") > 0.3) & (F.col("prob") < 0.7)).alias("uncertain"),
        F.count_if(wrong & ((F.col("prob") <= 0.3) | (F.col("prob") >= 0.7))).alias("confident_wrong"),
        F.avg(F.when(~wrong, F.col("prob"))).alias("mean_prob_correct"),
        F.avg(F.when(wrong, F.col("prob"))).alias("mean_prob_error"),
    )


def label_changes(compared: DataFrame) -> DataFrame:
    """One row over compare_labels' rows: up, down, same, added, removed, change_rate of the matched."""
    matched = F.col("status").isin("same", "changed")
    return compared.agg(
        F.count_if((F.col("old") == 0) & (F.col("new") == 1)).alias("up"),
        F.count_if((F.col("old") == 1) & (F.col("new") == 0)).alias("down"),
        F.count_if(F.col("status") == "same").alias("same"),
        F.count_if(F.col("status") == "added").alias("added"),
        F.count_if(F.col("status") == "removed").alias("removed"),
        ratio0(F.count_if(F.col("status") == "changed"), F.count_if(matched)).alias("change_rate"),
    )


def threshold_sweep(preds: DataFrame, thresholds: Sequence[float], truth: Column, score: str = "prob") -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, specificity, f1, youden) at score >= threshold.

    A row is counted once, into the highest threshold it reaches; sums over the few
    thresholds do the rest, so that no row is copied for each of them.
    """
    ordered = sorted(thresholds)
    reached = reduce(lambda a, t: a + (F.col(score) >= t).cast("int"), ordered, F.lit(0))
    counts = preds.groupBy(reached.alias("reached")).agg(F.count_if(truth).alias("pos"), F.count_if(~truth).alias("neg"))
    grid = preds.sparkSession.createDataFrame([(0, None), *[(i + 1, float(t)) for i, t in enumerate(ordered)]], "reached int, threshold double")
    s = grid.join(counts, "reached", "left").na.fill(0, ["pos", "neg"])
    from_here, every = W.orderBy(F.desc("reached")).rowsBetween(W.unboundedPreceding, 0), W.partitionBy()
    s = s.select("threshold", *[F.sum(v).over(from_here).alias(n) for n, v in (("tp", "pos"), ("fp", "neg"))], *[F.sum(v).over(every).alias(f"all_{v}") for v in ("pos", "neg")])
    s = s.filter("threshold is not null").select("threshold", "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_neg") - F.col("fp")).alias("tn"))
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    recall, specificity = ratio0(tp, tp + fn), ratio0(tn, tn + fp)
    return s.select("*", ratio0(tp, tp + fp).alias("precision"), recall.alias("recall"), specificity.alias("specificity"), ratio0(2 * tp, 2 * tp + fp + fn).alias("f1"), (recall + specificity - 1).alias("youden"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """(strategy, threshold): best F1, best recall at precision .85, best precision at recall .85, best Youden J."""
    strategies = {
        "f1": F.col("f1"),
        "recall_at_precision": F.when(F.col("precision") >= 0.85, F.col("recall")),
        "precision_at_recall": F.when(F.col("recall") >= 0.85, F.col("precision")),
        "youden": F.col("youden"),
    }
    row = sweep.agg(*[F.max_by("threshold", F.when(v.isNotNull(), F.struct(v.alias("v"), (-F.col("threshold")).alias("t")))).alias(n) for n, v in strategies.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(n).alias("threshold")) for n in strategies])).alias("x")).select("x.*")


def split_report(trials: DataFrame, split: str = "split", subject: str = "subject", label: str = "label") -> DataFrame:
    """(split, n, subjects, rate, gap to the whole's rate, leaking subjects)."""
    many = trials.groupBy(subject).agg((F.count_distinct(split) > 1).alias("leaks"))
    per = trials.join(many, subject).groupBy(split).agg(F.count("*").alias("n"), F.count_distinct(subject).alias("subjects"), F.avg(label).alias("rate"), F.sum(label).alias("pos"), F.count_distinct(F.when(F.col("leaks"), F.col(subject))).alias("leaking"))
    every = W.partitionBy()
    return per.select(split, "n", "subjects", "rate", (F.col("rate") - F.sum("pos").over(every) / F.sum("n").over(every)).alias("gap"), "leaking")


def correlations(df: DataFrame, columns: Sequence[str], least: float = 0.0) -> DataFrame:
    """(a, b, r) of the pairs of columns whose correlation is `least` or more in size, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    listed = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)])
    return row.select(F.explode(listed).alias("x")).select("x.*").filter(F.abs("r") >= least)


def compare_runs(metrics: DataFrame, old: str, new: str) -> DataFrame:
    """(metric, old, new, delta) of metrics(run, metric, value)."""
    wide = metrics.groupBy("metric").agg(*[F.max(F.when(F.col("run") == r, F.col("value"))).alias(n) for r, n in ((old, "old"), (new, "new"))])
    return wide.withColumn("delta", F.col("new") - F.col("old"))


def best_runs(metrics: DataFrame) -> DataFrame:
    """(metric, best_run, best_value) of metrics(run, metric, value); ties go to the first name."""
    best = F.min_by(F.struct("run", "value"), F.struct((-F.col("value")).alias("v"), F.col("run")))
    return metrics.groupBy("metric").agg(best.alias("b")).select("metric", F.col("b.run").alias("best_run"), F.col("b.value").alias("best_value"))


def cohens_d(df: DataFrame, label: str, value: str) -> DataFrame:
    """One row: d = difference of class means over the pooled standard deviation."""
    a, b = F.when(F.col(label) == 1, F.col(value)), F.when(F.col(label) == 0, F.col(value))
    s = df.agg(*[f(x).alias(f"{n}{i}") for i, x in ((1, a), (0, b)) for n, f in (("m", F.avg), ("v", F.var_samp), ("n", F.count))])
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n0") - 1) * F.col("v0")) / (F.col("n1") + F.col("n0") - 2)
    return s.select(ratio(F.col("m1") - F.col("m0"), F.sqrt(pooled)).alias("d"), "n1", "n0")


def resolve_thresholds(df: DataFrame, value: str, percentiles: Sequence[float], baseline: Column, sigmas: Sequence[float]) -> DataFrame:
    """(name, threshold): exact percentiles of all values; mean + k population deviations of baseline ones."""
    base = F.when(baseline, F.col(value))
    named = {f"sigma:{k:g}": F.avg(base) + k * F.stddev_pop(base) for k in sigmas}
    row = df.agg(*[c.alias(f"{i}") for i, c in enumerate(named.values())], F.lit(0).alias("one"))
    out = row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"{i}").alias("threshold")) for i, n in enumerate(named)])).alias("x")).select("x.*")
    if not percentiles:
        return out
    name = F.element_at(F.create_map(*[F.lit(x) for q in percentiles for x in (q / 100, f"percentile:{q:g}")]), F.col("share"))
    return exact_percentiles(df, value, [q / 100 for q in percentiles]).select(name.alias("name"), F.col("percentile").alias("threshold")).unionByName(out)


def composite_scores(df: DataFrame, fraction: str, auc: str, latency: str, weights: tuple[float, float] = (3.0, 1.0), user: str | None = None) -> DataFrame:
    """data_score 0-5: mean of time fraction, area as a share of the largest, and earliness; blended 3:1 with a user's score."""
    largest = df.agg(F.max(auc).cast("double").alias("a"), F.max(latency).cast("double").alias("l")).first()
    top = lambda c: F.lit(largest["a" if c == auc else "l"]).cast("double")
    early = F.when(F.col(latency).isNull(), 0.0).otherwise(1 - ratio0(F.col(latency), top(latency)))
    score = F.round(5 * (F.col(fraction) + ratio0(F.col(auc), top(auc)) + early) / 3, 0)
    out = df.withColumn("data_score", score)
    return out.withColumn("final_score", (weights[0] * F.col(user) + weights[1] * F.col("data_score")) / sum(weights)) if user else out


def engineered_scalars(frames: DataFrame, keys: Sequence[str], value: str = "value", frame: str = "frame", fps: float = 40.0) -> DataFrame:
    """21 figures of each trial from flagged frames: areas, peaks, times to peak, extremes and their ratios."""
    v = F.col(value)
    on = {"before": F.when(F.col("is_before") == 1, v), "during": F.when(F.col("is_during") == 1, v), "after": F.when(F.col("is_after") == 1, v)}
    peak_at = lambda e: F.min_by(F.col(frame), F.when(on[e].isNotNull(), F.struct((-v).alias("v"), F.col(frame).alias("f"))))
    start = lambda e: F.min(F.when(on[e].isNotNull(), F.col(frame)))
    s = frames.groupBy(*keys).agg(
        *[F.coalesce(F.sum(on[e]) / fps, F.lit(0.0)).alias(f"auc_{e}") for e in on],
        *[((peak_at(e) - start(e)) / F.lit(fps)).alias(f"time_to_peak_{e}") for e in ("during", "after")],
        *[F.max(on[e]).alias(f"peak_{e}") for e in on],
        *[F.min(on[e]).alias(f"low_{e}") for e in on],
        F.max(v).alias("global_max"),
        F.min(v).alias("global_min"),
        F.percentile(v, 0.99).alias("trimmed_max"),
        F.percentile(v, 0.01).alias("trimmed_min"),
    )
    c = F.col
    return s.select(
        "*",
        ratio(c("auc_during"), c("auc_before")).alias("auc_ratio_during"),
        ratio(c("auc_after"), c("auc_before")).alias("auc_ratio_after"),
        ratio(c("peak_during"), c("peak_before")).alias("peak_ratio_during"),
        ratio(c("peak_after"), c("peak_before")).alias("peak_ratio_after"),
        ratio(c("global_max"), c("trimmed_max")).alias("max_ratio"),
        (c("global_max") - c("global_min")).alias("extent"),
    )
