"""Paired time-wise tests, permutations, equivalence, survival and mixed models."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .percentiles import percentile_columns
from .store import written
from .windows import benjamini_hochberg, kaplan_meier, median_survival, runs

# Coefficients of Lanczos's approximation (g = 7) and of the normal tail's polynomial.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
NORMAL = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
#: Intervals of Simpson's rule in the t tail.
SIMPSON = 200


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function for x > 0.5."""
    y = x - 1
    s = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        s = s + F.lit(c) / (y + i)
    t = y + 7.5
    return 0.5 * math.log(2 * math.pi) + (y + 0.5) * F.log(t) - t + F.log(s)


def normal_sf(z: Column) -> Column:
    """Upper tail of the normal distribution, to 1e-7."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    p = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * t * (NORMAL[0] + t * (NORMAL[1] + t * (NORMAL[2] + t * (NORMAL[3] + t * NORMAL[4]))))
    return F.when(z >= 0, p).otherwise(1 - p)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p of Student's t for any df >= 1: the integral of cos^(df - 1) by Simpson's rule."""
    theta = F.atan(F.abs(t) / F.sqrt(df))
    weights = F.array(*[F.lit(1.0 if i in (0, SIMPSON) else 4.0 if i % 2 else 2.0) for i in range(SIMPSON + 1)])
    terms = F.transform(weights, lambda w, i: w * F.pow(F.cos(theta * i / SIMPSON), df - 1))
    integral = F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) * theta / (3 * SIMPSON)
    inside = integral * 2 / math.sqrt(math.pi) * F.exp(lgamma((df + 1) / 2) - lgamma(F.greatest(df / 2, F.lit(0.5000001))))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - inside))


def t_sf(t: Column, df: Column) -> Column:
    return F.when(t >= 0, t_two_sided(t, df) / 2).otherwise(1 - t_two_sided(t, df) / 2)


def binomial_two_sided(k: Column, n: Column) -> Column:
    """Two-sided p of k of n at one half: twice the smaller tail, 1 at most."""
    low = F.least(k, n - k)
    start = F.struct((-n * math.log(2.0)).alias("log"), F.exp(-n * math.log(2.0)).alias("sum"))
    steps = F.when(low > 0, F.sequence(F.lit(1), low.cast("int"))).otherwise(F.array().cast("array<int>"))

    def step(acc: Column, i: Column) -> Column:
        log = acc["log"] + F.log((n - i + 1) / i)
        return F.struct(log.alias("log"), (acc["sum"] + F.exp(log)).alias("sum"))

    return F.when(n > 0, F.least(F.lit(1.0), 2 * F.aggregate(steps, start, step)["sum"]))


def paired_t(diffs: DataFrame, by: str = "frame", value: str = "diff") -> DataFrame:
    """(by, n, mean, t, p); null where there are fewer than two differences or no spread."""
    s = diffs.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    t = F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("mean") / (F.col("sd") / F.sqrt("n")))
    s = s.withColumn("t", t)
    return s.select(by, "n", "mean", "t", F.when(F.col("t").isNotNull(), t_two_sided(F.col("t"), F.col("n") - 1.0)).alias("p"))


def average_ranks(df: DataFrame, by: Sequence[str], value: Column, out: str = "rank") -> DataFrame:
    """Ranks from 1 within `by`, the mean of their ranks for equal values; rows meet by value first."""
    x = df.withColumn("__v", value)
    counts = x.groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    before = F.coalesce(F.sum("__c").over(W.partitionBy(*by).orderBy("__v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select(*by, "__v", "__c", (before + (F.col("__c") + 1) / 2).alias(out))
    return x.join(ranks, [*by, "__v"]).drop("__v").withColumnRenamed("__c", "ties")


def wilcoxon(diffs: DataFrame, by: str = "frame", value: str = "diff") -> DataFrame:
    """(by, n, zeros, w_plus, z, p): signed ranks, zeros ranked and left out of the sums (Pratt), continuity corrected.

    Differences that agree to 9 decimals are ties: sums in another order differ beyond.
    """
    diffs = diffs.withColumn(value, F.round(value, 9))
    r = average_ranks(diffs, [by], F.abs(value))
    v, k = F.col(value), F.col("rank")
    nz = v != 0
    s = r.groupBy(by).agg(
        F.count("*").alias("n"),
        F.count_if(~nz).alias("zeros"),
        F.coalesce(F.sum(F.when(v > 0, k)), F.lit(0.0)).alias("w_plus"),
        F.coalesce(F.sum(F.when(v < 0, k)), F.lit(0.0)).alias("w_minus"),
        F.sum(F.when(nz, k * k)).alias("sq"),
    )
    mean, sd = (F.col("w_plus") + F.col("w_minus")) / 2, F.sqrt(F.col("sq")) / 2
    d = F.col("w_plus") - mean
    z = F.when(sd > 0, (d - 0.5 * F.signum(d)) / sd)
    return s.withColumn("z", z).select(by, "n", "zeros", "w_plus", "z", F.when(F.col("z").isNotNull(), F.least(F.lit(1.0), 2 * normal_sf(F.abs("z")))).alias("p"))


def signed_rank_counts(n: int) -> list[int]:
    """How many of the 2^n sign choices give each sum of ranks 1..n."""
    counts = [1]
    for r in range(1, n + 1):
        with_r = [0] * r + counts
        counts = [a + b for a, b in zip(with_r, counts + [0] * r, strict=True)]
    return counts


def wilcoxon_exact(tests: DataFrame, most: int = 50) -> DataFrame:
    """wilcoxon's rows with p_exact where n <= most and nothing is zero or tied; the table is n's own."""
    table = tests.sparkSession.createDataFrame(signed_rank_tails(most), "n long, low int, p_exact double")
    low = F.least(F.col("w_plus"), F.col("n") * (F.col("n") + 1) / 2 - F.col("w_plus"))
    keyed = tests.withColumn("low", F.when((F.col("zeros") == 0) & (low == F.floor(low)), low.cast("int")))
    return keyed.join(F.broadcast(table), ["n", "low"], "left").drop("low")


def welch_t(df: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """(by, n_a, n_b, t, df, p) of groups A and B with unequal variances."""
    a, b = (F.when(F.col(group) == g, F.col(value)) for g in ("A", "B"))
    s = df.groupBy(*by).agg(*[f(x).alias(f"{n}_{g}") for g, x in (("a", a), ("b", b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    va, vb = F.col("v_a") / F.col("n_a"), F.col("v_b") / F.col("n_b")
    s = s.withColumns({"t": F.when(va + vb > 0, (F.col("m_a") - F.col("m_b")) / F.sqrt(va + vb)), "df": F.when(va + vb > 0, (va + vb) ** 2 / (va**2 / (F.col("n_a") - 1) + vb**2 / (F.col("n_b") - 1)))})
    return s.select(*by, "n_a", "n_b", "t", "df", F.when(F.col("t").isNotNull(), t_two_sided(F.col("t"), F.col("df"))).alias("p"))


def mann_whitney(df: DataFrame, by: Sequence[str], group: str, value: str) -> DataFrame:
    """(by, u, z, p) by normal approximation with ties and continuity."""
    r = average_ranks(df, by, F.col(value))
    s = r.groupBy(*by).agg(F.sum(F.when(F.col(group) == "A", F.col("rank"))).alias("ra"), F.count_if(F.col(group) == "A").alias("na"), F.count_if(F.col(group) == "B").alias("nb"), F.sum(F.col("ties") ** 2 - 1).alias("tied"))
    na, nb, n = F.col("na").cast("double"), F.col("nb").cast("double"), (F.col("na") + F.col("nb")).cast("double")
    u = F.col("ra") - na * (na + 1) / 2
    sd = F.sqrt(na * nb / 12 * (n + 1 - F.col("tied") / (n * (n - 1))))
    d = F.col("u") - na * nb / 2
    s = s.withColumn("u", u).withColumn("z", F.when(sd > 0, (F.abs(d) - 0.5) / sd))
    return s.select(*by, "u", "z", F.when(F.col("z").isNotNull(), F.least(F.lit(1.0), 2 * normal_sf(F.col("z")))).alias("p"))


def sign_test(diffs: DataFrame, by: str = "frame", value: str = "diff") -> DataFrame:
    """(by, up, down, p): differences above and below 0."""
    s = diffs.groupBy(by).agg(F.count_if(F.col(value) > 0).alias("up"), F.count_if(F.col(value) < 0).alias("down"))
    return s.withColumn("p", binomial_two_sided(F.col("up"), F.col("up") + F.col("down")))


def flipped(diffs: DataFrame, perms: int, seed: int, subject: str = "subject", value: str = "diff") -> DataFrame:
    """Each row for permutations 0 (as it is) to perms, its sign by hash of seed, permutation and subject."""
    first = F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("perm").cast("string"), F.col(subject).cast("string")).cast("binary")), 1, 1)
    sign = F.when((F.col("perm") == 0) | (first < "8"), 1.0).otherwise(-1.0)
    return diffs.withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(perms)))).withColumn(value, F.col(value) * sign)


def randomization_test(diffs: DataFrame, perms: int = 200, seed: int = 67, frame: str = "frame", value: str = "diff", statistic: str = "mean") -> DataFrame:
    """(frame, effect, p, q): share of sign-flipped means, or medians, as far from 0 as the observed, Benjamini-Hochberg.

    A median is found by ranks in cells of values, so that no task holds a list of a
    permutation's values. Its rounds read the differences again, which are written first:
    worked out anew they may differ in their last bits and fall out of the brackets.
    """
    if statistic == "median":
        diffs = written(diffs, "diffs")
    flips = flipped(diffs, perms, seed)
    if statistic == "median":
        means = written(percentile_columns(flips, value, {"m": 0.5}, ["perm", frame], keep=False), "medians")
    elif statistic == "mean":
        means = flips.groupBy("perm", frame).agg(F.avg(value).alias("m"))
    else:
        raise ValueError(f"no such statistic: {statistic}")
    seen = means.filter("perm = 0").select(frame, F.col("m").alias("effect"))
    far = means.filter("perm > 0").join(seen, frame).groupBy(frame).agg(F.first("effect").alias("effect"), F.count_if(F.abs("m") >= F.abs("effect") - 1e-12).alias("extreme"))
    return benjamini_hochberg(far.select(frame, "effect", ((1 + F.col("extreme")) / F.lit(1.0 + perms)).alias("p")), "p", frame)


def cluster_permutation(diffs: DataFrame, perms: int = 200, seed: int = 67, threshold: float = 2.0, frame: str = "frame", value: str = "diff") -> DataFrame:
    """(start, end, length, mass, p) of the observed runs of t beyond the threshold, by sign, against the permutations' largest mass."""
    s = flipped(diffs, perms, seed).groupBy("perm", frame).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd"))
    s = s.withColumn("t", F.when((F.col("n") > 1) & (F.col("sd") > 0), F.col("m") / (F.col("sd") / F.sqrt("n")))).filter(F.abs("t") > threshold).withColumn("side", F.signum("t"))
    island = F.col(frame) - F.row_number().over(W.partitionBy("perm", "side").orderBy(frame))
    found = s.withColumn("island", island).groupBy("perm", "side", "island").agg(F.min(frame).alias("start"), F.max(frame).alias("end"), F.count("*").alias("length"), F.sum("t").alias("mass"))
    top = found.filter("perm > 0").groupBy("perm").agg(F.max(F.abs("mass")).alias("top"))
    seen = found.filter("perm = 0").select("start", "end", "length", "mass")
    met = seen.join(top, F.col("top") >= F.abs("mass") - 1e-12, "left")  # a row for each of the few runs and permutations
    return met.groupBy("start", "end", "length", "mass").agg(((1 + F.count("top")) / F.lit(1.0 + perms)).alias("p"))


def signed_rank_tails(most: int = 50) -> list[tuple[int, int, float]]:
    """(n, smaller rank sum, exact two-sided p) of signed ranks without ties."""
    rows = []
    for n in range(1, most + 1):
        counts, tail = signed_rank_counts(n), 0
        for w, c in enumerate(counts[: len(counts) // 2 + 1]):
            tail += c
            rows.append((n, w, min(1.0, 2 * tail / 2**n)))
    return rows


def permuted_statistics(diffs: DataFrame, perms: int, seed: int, method: str, frame: str = "frame", value: str = "diff") -> DataFrame:
    """(perm, frame, statistic, p) of sign-flipped differences, permutation 0 as they are.

    t: Student's; without spread it is infinite, or 0 with p 1 where the mean is 0 too.
    wilcoxon: the smaller rank sum, zeros dropped, p exact for 50 differences at most
    without zeros or ties, else normal with tie and continuity correction; ranks are those
    of absolute differences, which flips leave alone. Fewer than two differences give none.
    """
    if method == "t":
        s = flipped(diffs, perms, seed).groupBy("perm", frame).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.stddev_samp(value).alias("sd")).filter("n > 1")
        flat = F.col("sd") <= 1e-12
        endless = F.signum("m") * F.lit(float("inf"))
        t = F.when(~flat, F.col("m") / (F.col("sd") / F.sqrt("n"))).when(F.abs("m") > 1e-12, endless).otherwise(0.0)
        p = F.when(~flat, t_two_sided(t, F.col("n") - 1.0)).when(F.abs("m") > 1e-12, 0.0).otherwise(1.0)
        return s.select("perm", frame, t.alias("statistic"), p.alias("p"))
    if method != "wilcoxon":
        raise ValueError(f"no such statistic: {method}")
    exact = diffs.filter(F.col(value).isNotNull()).withColumn(value, F.round(value, 9))
    sizes = exact.groupBy(frame).agg(F.count("*").alias("all")).filter("all > 1")
    ranked = written(average_ranks(exact.filter(F.col(value) != 0), [frame], F.abs(value)).join(sizes, frame), "ranked")
    up, k, n = F.col(value) > 0, F.col("rank"), F.col("n").cast("double")
    s = flipped(ranked, perms, seed).groupBy("perm", frame).agg(
        F.count("*").alias("n"), F.max("all").alias("all"), F.max("ties").alias("most_ties"), F.sum(F.col("ties") ** 2 - 1).alias("tied"),
        F.coalesce(F.sum(F.when(up, k)), F.lit(0.0)).alias("plus"), F.coalesce(F.sum(F.when(~up, k)), F.lit(0.0)).alias("minus"),
    )
    table = diffs.sparkSession.createDataFrame(signed_rank_tails(), "__n long, __low int, p_exact double")
    low = F.least("plus", "minus")
    mean, var = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48
    z = F.when(var > 0, (F.abs(low - mean) - 0.5) / F.sqrt(var))
    alone = (F.col("n") == F.col("all")) & (F.col("most_ties") == 1)
    s = s.withColumns({"statistic": low, "__at": F.when(alone, low.cast("int")), "approx": F.when(z.isNotNull(), F.least(F.lit(1.0), 2 * normal_sf(z)))})
    s = s.join(F.broadcast(table), (F.col("n") == F.col("__n")) & (F.col("__at") == F.col("__low")), "left")
    return s.select("perm", frame, "statistic", F.coalesce("p_exact", "approx").alias("p"))


def cluster_test(diffs: DataFrame, perms: int = 200, seed: int = 67, alpha: float = 0.05, method: str = "t", frame: str = "frame", value: str = "diff") -> tuple[DataFrame, DataFrame]:
    """(clusters, times) of runs of frames of one sign whose p is below alpha.

    clusters(cluster_id, start, end, length, sign, mass, p_cluster): numbered by start; mass
    is the sum of absolute statistics, p_cluster the share of permutations whose largest
    mass is as large, 0 for those without a run. times(frame, statistic, p, cluster_id,
    p_cluster) has every frame; cluster_id is 0 outside of clusters.
    """
    s = written(permuted_statistics(diffs, perms, seed, method, frame, value), "statistics")
    cut = s.filter((F.col("p") < alpha) & (F.col("statistic") != 0)).withColumn("sign", F.signum("statistic").cast("int"))
    island = F.col(frame) - F.row_number().over(W.partitionBy("perm", "sign").orderBy(frame))
    runs_ = cut.withColumn("island", island).groupBy("perm", "sign", "island").agg(F.min(frame).alias("start"), F.max(frame).alias("end"), F.count("*").alias("length"), F.sum(F.abs("statistic")).alias("mass"))
    runs_ = written(runs_, "runs")
    top = runs_.filter("perm > 0").groupBy("perm").agg(F.max("mass").alias("top"))
    seen = runs_.filter("perm = 0").drop("perm", "island")
    met = seen.join(top, F.col("top") >= F.col("mass") - 1e-9, "left")  # a row for each of the few runs and permutations
    found = met.groupBy("start", "end", "length", "sign", "mass").agg(((1 + F.count("top")) / F.lit(1.0 + perms)).alias("p_cluster"))
    found = written(found.withColumn("cluster_id", F.row_number().over(W.orderBy("start"))), "clusters")  # a row a run
    times = s.filter("perm = 0").select(frame, "statistic", "p")
    inside = times.join(F.broadcast(found), (F.col(frame) >= F.col("start")) & (F.col(frame) <= F.col("end")), "left")
    return found.select("cluster_id", "start", "end", "length", "sign", "mass", "p_cluster"), inside.select(frame, "statistic", "p", F.coalesce("cluster_id", F.lit(0)).alias("cluster_id"), "p_cluster")


def summary_rows(clusters: DataFrame | None = None, survival: DataFrame | None = None, hazards: DataFrame | None = None, spline: DataFrame | None = None, alpha: float = 0.05) -> DataFrame:
    """(section, item, figure, value): what a report says of clusters, survival and a spline, one figure a row.

    clusters is cluster_test's: how many there are and are significant, and each significant
    one's start, end, mass and p, by p, then start. survival is survival_sweep's and hazards
    hazard_sweep's, an item a threshold; of the spline the largest absolute difference, its
    frame, and the Wald test of the groups' shapes.
    """
    parts = []

    def rows(df: DataFrame, section: str, item: Column, figures: Sequence[str]) -> DataFrame:
        each = F.array(*[F.struct(F.lit(f).alias("figure"), F.col(f).cast("double").alias("value")) for f in figures])
        return df.select(F.lit(section).alias("section"), item.cast("string").alias("item"), F.explode(each).alias("x")).select("section", "item", "x.*")

    if clusters is not None:
        significant = clusters.filter(F.col("p_cluster") < alpha)
        counts = clusters.agg(F.count("*").alias("clusters"), F.count_if(F.col("p_cluster") < alpha).alias("significant"))
        place = F.row_number().over(W.orderBy("p_cluster", "start"))  # a row a cluster
        parts += [rows(counts, "clusters", F.lit("all"), ["clusters", "significant"]), rows(significant.withColumn("place", place), "clusters", F.col("place"), ["start", "end", "sign", "mass", "p_cluster"])]
    if survival is not None:
        parts.append(rows(survival, "survival", F.col("threshold"), ["chi2", "p", "median_a", "median_b"]))
    if hazards is not None:
        parts.append(rows(hazards.withColumn("best", F.col("best").cast("int")), "hazard", F.col("threshold"), ["hr", "ci_low", "ci_high", "p", "best"]))
    if spline is not None:
        peak = spline.orderBy(F.abs("difference").desc(), "frame").limit(1).select(F.abs("difference").alias("peak_difference"), F.col("frame").alias("peak_frame"), "wald", "wald_p")
        parts.append(rows(peak, "spline", F.lit("all"), ["peak_difference", "peak_frame", "wald", "wald_p"]))
    if not parts:
        raise ValueError("nothing to summarise")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def equivalence(diffs: DataFrame, by: str = "frame", value: str = "diff", margin: float | None = None, sd_share: float = 0.5) -> DataFrame:
    """(by, n, mean, margin, p_low, p_high, p): two one-sided t tests against +-margin, or a share of the deviation."""
    s = diffs.groupBy(by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd")).filter("n > 1 and sd > 0")
    s = s.withColumn("margin", F.lit(margin) if margin else sd_share * F.col("sd"))
    se, df = F.col("sd") / F.sqrt("n"), F.col("n") - 1.0
    low, high = t_sf((F.col("mean") + F.col("margin")) / se, df), t_sf((F.col("margin") - F.col("mean")) / se, df)
    return s.select(by, "n", "mean", "margin", low.alias("p_low"), high.alias("p_high")).withColumn("p", F.greatest("p_low", "p_high"))


def yuen(diffs: DataFrame, by: str = "frame", value: str = "diff", trim: float = 0.2) -> DataFrame:
    """(by, n, trimmed_mean, t, df, p): one-sample trimmed t with the winsorised variance."""
    w = W.partitionBy(by)
    x = diffs.filter(F.col(value).isNotNull()).withColumns({"__n": F.count("*").over(w), "__r": F.row_number().over(w.orderBy(value, "subject"))})
    g = F.floor(F.lit(trim) * F.col("__n"))
    x = x.withColumn("__g", g)
    kept = (F.col("__r") > F.col("__g")) & (F.col("__r") <= F.col("__n") - F.col("__g"))
    x = x.withColumns({"__lo": F.min(F.when(kept, F.col(value))).over(w), "__hi": F.max(F.when(kept, F.col(value))).over(w)})
    wins = F.least("__hi", F.greatest("__lo", F.col(value)))
    s = x.groupBy(by).agg(F.count("*").alias("n"), F.max("__g").alias("g"), F.avg(F.when(kept, F.col(value))).alias("trimmed_mean"), F.var_samp(wins).alias("v"))
    h = (F.col("n") - 2 * F.col("g")).cast("double")
    t = F.when((h > 1) & (F.col("v") > 0), F.col("trimmed_mean") / F.sqrt((F.col("n") - 1) * F.col("v") / (h * (h - 1))))
    s = s.withColumns({"t": t, "df": h - 1})
    return s.select(by, "n", "trimmed_mean", "t", "df", F.when(F.col("t").isNotNull(), t_two_sided(F.col("t"), F.col("df"))).alias("p"))


def _risk_sets(events: DataFrame, strata: Sequence[str]) -> DataFrame:
    """(strata, time, n, n1, d, d1): at risk and events, in all and in group A, at each event time."""
    a = (F.col("grp") == "A").cast("long")
    e = F.col("event").cast("long")
    t = events.groupBy(*strata, F.col("latency").alias("time")).agg(F.count("*").alias("c"), F.sum(a).alias("c1"), F.sum(e).alias("d"), F.sum(e * a).alias("d1"))
    ahead = W.partitionBy(*strata).orderBy("time").rowsBetween(0, W.unboundedFollowing)
    return t.select(*strata, "time", F.sum("c").over(ahead).alias("n"), F.sum("c1").over(ahead).alias("n1"), "d", "d1").filter("d > 0")


def log_rank(events: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, observed, expected, variance, chi2, p) of group A against the others; events(grp, latency, event)."""
    r = _risk_sets(events, by)
    n, n1, d = F.col("n"), F.col("n1"), F.col("d")
    v = F.when(n > 1, d * (n1 / n) * (1 - n1 / n) * (n - d) / (n - 1)).otherwise(0.0)
    s = r.groupBy(*by).agg(F.sum("d1").cast("double").alias("observed"), F.sum(d * n1 / n).alias("expected"), F.sum(v).alias("variance"))
    s = s.withColumn("chi2", F.when(F.col("variance") > 0, (F.col("observed") - F.col("expected")) ** 2 / F.col("variance")))
    return s.withColumn("p", 2 * normal_sf(F.sqrt("chi2")))


def cox_binary(events: DataFrame, strata: Sequence[str] = ("subject",), by: Sequence[str] = (), ties: str = "efron", steps: int = 100) -> DataFrame:
    """(by, beta, hr, ci_low, ci_high, p): stratified Cox model of group A, ties by Efron or Breslow.

    Rows meet as risk sets. Efron's are one set for each of the tied events, without the
    share of those before it. Newton's steps are aggregations of the sets, until none
    moves; no convergence after `steps` is an error. beta stays within 20 where the
    groups part entirely; without an event there is no row.
    """
    r = _risk_sets(events, [*by, *strata]).filter("d > 0")
    if ties == "efron":
        r = r.withColumn("gone", F.explode(F.sequence(F.lit(0), F.col("d").cast("int") - 1))).withColumn("gone", F.col("gone") / F.col("d"))
        a, rest, d, d1 = F.col("n1") - F.col("gone") * F.col("d1"), F.col("n") - F.col("n1") - F.col("gone") * (F.col("d") - F.col("d1")), F.lit(1.0), F.col("d1") / F.col("d")
    else:
        a, rest, d, d1 = F.col("n1").cast("double"), (F.col("n") - F.col("n1")).cast("double"), F.col("d").cast("double"), F.col("d1").cast("double")
    key = [*by, "__all"]
    sets = r.withColumn("__all", F.lit(0)).groupBy(*key, a.alias("a"), rest.alias("b")).agg(F.sum(d).alias("d"), F.sum(d1).alias("d1"))
    sets = written(sets, "risk-sets")
    fit = sets.select(*key).distinct().withColumn("beta", F.lit(0.0))
    for _ in range(steps):
        share = F.col("a") * F.exp("beta") / (F.col("a") * F.exp("beta") + F.col("b"))
        sums = sets.join(fit, key).groupBy(*key, "beta").agg(F.sum(F.col("d1") - F.col("d") * share).alias("score"), F.sum(F.col("d") * share * (1 - share)).alias("info"))
        step = F.coalesce(F.try_divide("score", "info"), F.lit(0.0))
        new = F.least(F.lit(20.0), F.greatest(F.lit(-20.0), F.col("beta") + F.least(F.lit(2.0), F.greatest(F.lit(-2.0), step))))
        moved = written(sums.select(*key, new.alias("beta"), F.abs(new - F.col("beta")).alias("moved"), F.try_divide(F.lit(1.0), F.sqrt("info")).alias("se")), "cox")
        fit = moved.select(*key, "beta")
        if (moved.agg(F.max("moved")).first()[0] or 0.0) < 1e-9:
            break
    else:
        raise RuntimeError(f"the Cox model still moves after {steps} steps")
    z, se = F.col("beta"), F.col("se")
    return moved.select(*by, "beta", F.exp(z).alias("hr"), F.exp(z - 1.96 * se).alias("ci_low"), F.exp(z + 1.96 * se).alias("ci_high"), (2 * normal_sf(F.abs(z / se))).alias("p"))


def latencies_at(frames: DataFrame, keys: Sequence[str], thresholds: Sequence[float], targets: Sequence[int] = (2, 4, 5)) -> DataFrame:
    """(threshold, keys, latency, event, grp) of every trial at several thresholds at once."""
    x = frames.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    hit = F.min(F.when(F.col("value") >= F.col("threshold"), F.col("frame")))
    lat = x.groupBy("threshold", *keys).agg(hit.alias("hit"), F.max("frame").alias("last"))
    return lat.select("threshold", *keys, F.coalesce("hit", "last").alias("latency"), F.coalesce(F.col("hit") < F.col("last"), F.lit(False)).alias("event"), F.when(F.col("trial").isin(*targets), "A").otherwise("B").alias("grp"))


def hazard_sweep(frames: DataFrame, keys: Sequence[str], thresholds: Sequence[float], strata: Sequence[str] = ("subject",)) -> DataFrame:
    """(threshold, beta, hr, ci_low, ci_high, p, best): the stratified Cox model at each threshold; best is the largest abs(ln HR), of equal ones the first."""
    fits = cox_binary(latencies_at(frames, keys, thresholds), strata, by=["threshold"])
    first = F.row_number().over(W.orderBy(F.abs("beta").desc_nulls_last(), "threshold"))  # a row a threshold
    return fits.withColumn("best", first == 1)


def survival_sweep(frames: DataFrame, keys: Sequence[str], thresholds: Sequence[float], targets: Sequence[int] = (2, 4, 5)) -> DataFrame:
    """(threshold, chi2, p, median_a, median_b) over several thresholds at once."""
    lat = latencies_at(frames, keys, thresholds, targets)
    m = median_survival(kaplan_meier(lat, ["threshold", "grp"]), ["threshold", "grp"])
    wide = m.groupBy("threshold").agg(*[F.max(F.when(F.col("grp") == g, F.col("median"))).alias(f"median_{g.lower()}") for g in ("A", "B")])
    return log_rank(lat, ["threshold"]).select("threshold", "chi2", "p").join(wide, "threshold")


def spline_basis(length: int, df: int) -> np.ndarray:
    """Cubic B-splines at 0 .. length - 1, a row a time and df columns; inner knots at even quantiles, none for the constant."""
    t = np.arange(length) / max(1, length - 1)
    knots = np.r_[np.zeros(4), np.linspace(0, 1, df - 1)[1:-1], np.ones(4)]
    last = np.searchsorted(knots, 1.0) - 1  # the interval that 1 itself belongs to
    at = np.minimum(np.searchsorted(knots, t, "right") - 1, last)
    b = (at[:, None] == np.arange(len(knots) - 1)).astype(float)
    over = lambda x, w: np.divide(x, w, out=np.zeros_like(x), where=w > 0)
    for k in (1, 2, 3):
        i = np.arange(len(knots) - 1 - k)
        up, down = t[:, None] - knots[i], knots[i + k + 1] - t[:, None]
        b = over(up, np.broadcast_to(knots[i + k] - knots[i], up.shape)) * b[:, :-1] + over(down, np.broadcast_to(knots[i + k + 1] - knots[i + 1], up.shape)) * b[:, 1:]
    return b[:, 1:]


def chi2_sf(x: float, df: int) -> float:
    """Upper tail of chi-squared of a whole number of degrees."""
    h = x / 2
    if df % 2:
        return math.erfc(math.sqrt(h)) + math.exp(-h) * sum(h ** (k - 0.5) / math.gamma(k + 0.5) for k in range(1, (df + 1) // 2))
    return math.exp(-h) * sum(h**k / math.factorial(k) for k in range(df // 2))


def mixed_spline(frames: DataFrame, length: int, subject: str = "subject", frame: str = "frame", value: str = "value", knots: int = 5) -> DataFrame:
    """(frame, difference, se, low, high, wald, wald_df, wald_p): A less B from a spline per group and an intercept per subject.

    Time has `knots` cubic B-splines, 3 or more, beside a constant, over [0, length); the
    Wald test is of their difference between the groups. Subjects' cross products are
    summed in Spark, by subject and then by the subjects' number of rows; only those few
    blocks, of parameters squared, come to the driver, which finds the variance ratio by
    restricted likelihood.
    """
    basis = np.c_[np.ones(length), spline_basis(length, knots)]
    half = basis.shape[1]
    p = 2 * half
    table = frames.sparkSession.createDataFrame([(t, *row) for t, row in enumerate(basis.tolist())], ", ".join([f"{frame} int", *(f"x{i} double" for i in range(half))]))
    a = (F.col("grp") == "A").cast("double")
    x = frames.select(subject, "grp", F.col(frame).cast("int").alias(frame), F.col(value).alias("y")).join(F.broadcast(table), frame)  # a row a frame
    x = x.select(subject, "y", *[f"x{i}" for i in range(half)], *[(F.col(f"x{i}") * a).alias(f"x{half + i}") for i in range(half)])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    per = x.groupBy(subject).agg(
        F.count("*").alias("n"), F.sum("y").alias("sy"), F.sum(F.col("y") * F.col("y")).alias("yy"),
        *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p)], *[F.sum(F.col(f"x{i}") * F.col("y")).alias(f"xy{i}") for i in range(p)], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"g{i}_{j}") for i, j in pairs],
    )
    rows = per.groupBy("n").agg(
        F.count("*").alias("m"), F.sum("yy").alias("yy"), F.sum(F.col("sy") ** 2).alias("ss"),
        *[F.sum(f"xy{i}").alias(f"xy{i}") for i in range(p)], *[F.sum(F.col(f"s{i}") * F.col("sy")).alias(f"sxy{i}") for i in range(p)],
        *[F.sum(f"g{i}_{j}").alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"h{i}_{j}") for i, j in pairs],
    ).collect()
    full = lambda r, k: np.array([[r[f"{k}{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], float)
    blocks = [(r["n"], r["m"], r["yy"], r["ss"], full(r, "g"), full(r, "h"), np.array([r[f"xy{i}"] for i in range(p)]), np.array([r[f"sxy{i}"] for i in range(p)])) for r in rows]

    def fit(ratio: float) -> tuple[float, np.ndarray, np.ndarray, float]:
        xx, xy, yy, logs, total = 1e-9 * np.eye(p), np.zeros(p), 0.0, 0.0, 0
        for n, m, y2, s2, g, h, gy, hy in blocks:
            c = ratio / (1 + n * ratio)
            xx, xy, yy = xx + g - c * h, xy + gy - c * hy, yy + y2 - c * s2
            logs += m * math.log(1 + n * ratio)
            total += m * n
        beta = np.linalg.solve(xx, xy)
        free = max(1, total - p)
        var = max(1e-12, yy - beta @ xy) / free
        return -0.5 * (free * math.log(var) + logs + np.linalg.slogdet(xx)[1]), beta, xx, var

    fields = f"{frame} int, difference double, se double, low double, high double, wald double, wald_df int, wald_p double"
    if not rows:
        return frames.sparkSession.createDataFrame([], fields)
    grid = np.r_[0, np.geomspace(1e-6, 1e3, 60)]
    for _ in range(6):  # around the best one, ever closer
        i = int(np.argmax([fit(r)[0] for r in grid]))
        grid = np.linspace(grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)], 21)
    _, beta, xx, var = max((fit(r) for r in grid), key=lambda z: z[0])
    cov = np.linalg.inv(xx) * var
    shape = slice(half + 1, p)
    wald = float(beta[shape] @ np.linalg.pinv(cov[shape, shape], hermitian=True) @ beta[shape])
    out = []
    for t, c in enumerate(np.c_[np.zeros((length, half)), basis]):
        d, se = float(c @ beta), float(np.sqrt(max(0.0, c @ cov @ c)))
        out.append((t, d, se, d - 1.96 * se, d + 1.96 * se, wald, knots, chi2_sf(wald, knots)))
    return frames.sparkSession.createDataFrame(out, fields)


def summarize_timewise(tests: DataFrame, name: str, alpha: float = 0.05, q: str = "q", effect: str = "effect", frame: str = "frame") -> DataFrame:
    """One row: test, onset, windows, significant frames, mean effect over them and its direction."""
    found = runs(tests.withColumn("__one", F.lit(1)), ["__one"], frame, F.col(q) < alpha)
    windows = found.agg(F.count("*").alias("windows"))
    s = tests.agg(F.min(F.when(F.col(q) < alpha, F.col(frame))).alias("onset"), F.count_if(F.col(q) < alpha).alias("significant"), F.avg(F.when(F.col(q) < alpha, F.col(effect))).alias("mean_effect"))
    way = F.when(F.col("mean_effect") > 0, "A>B").when(F.col("mean_effect") < 0, "A<B").otherwise("none")
    return s.join(windows, F.lit(True)).select(F.lit(name).alias("test"), "onset", "windows", "significant", "mean_effect", way.alias("direction"))
