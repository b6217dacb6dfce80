"""Statistics as column expressions and frame functions."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the two-sided 95 % point of the normal distribution.
Z = 1.959963984540054


def wilson(successes: Column, trials: Column) -> Column:
    """estimate, lower, upper and half width; NaN without trials."""
    n, k = trials.cast("double"), successes.cast("double")
    p = F.try_divide(k, n)
    down = 1 + F.try_divide(F.lit(Z * Z), n)
    mid = (p + F.try_divide(F.lit(Z * Z / 2), n)) / down
    half = F.lit(Z) * F.sqrt(F.try_divide(p * (1 - p), n) + F.try_divide(F.lit(Z * Z / 4), n * n)) / down
    nan = F.lit(float("nan"))
    edge = lambda x: F.when(x < 1e-12, 0.0).when(x > 1 - 1e-12, 1.0).otherwise(x)
    ok = lambda x: F.when(n > 0, x).otherwise(nan)
    return F.struct(ok(p).alias("estimate"), ok(edge(mid - half)).alias("lower"), ok(edge(mid + half)).alias("upper"), ok(half).alias("half_width"))


def half_width(p: float, n: int) -> float:
    d = 1 + Z * Z / n
    return Z * ((p * (1 - p) / n + Z * Z / (4 * n * n)) ** 0.5) / d


def proportional_allocation(strata: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """Largest remainders: floors of the quotas, then one each by (fraction descending, key) among strata with room."""
    w = Window.partitionBy()  # one row for each stratum
    t = strata.select(F.col(key), F.col(size).cast("long").alias("size")).withColumn("total", F.sum("size").over(w))
    quota = F.coalesce(F.try_divide(F.lit(float(n)) * F.col("size"), F.col("total").cast("double")), F.lit(0.0))
    t = t.withColumn("quota", quota).withColumn("base", F.least(F.floor("quota"), F.col("size")))
    t = t.withColumn("left", F.lit(n) - F.sum("base").over(w)).withColumn("room", F.col("size") > F.col("base"))
    t = t.withColumn("turn", F.row_number().over(w.orderBy(F.desc("room"), F.desc(F.col("quota") - F.floor("quota")), key)))
    got = F.when(F.lit(n) >= F.col("total"), F.col("size")).otherwise(F.col("base") + F.when(F.col("room") & (F.col("turn") <= F.col("left")), 1).otherwise(0))
    return t.select(key, "size", got.cast("long").alias("allocated"))


def sqrt_allocation(strata: DataFrame, key: str, size: str, n: int) -> DataFrame:
    """Shares as the square roots of sizes; a stratum smaller than its share is taken whole and falls short."""
    w = Window.partitionBy()  # one row for each stratum
    t = strata.select(F.col(key), F.col(size).cast("long").alias("size"))
    share = F.floor(F.lit(float(n)) * F.sqrt(F.col("size").cast("double")) / F.sum(F.sqrt(F.col("size").cast("double"))).over(w)).cast("long")
    return t.withColumn("share", share).select(key, "size", "share", F.least("share", "size").alias("allocated"), F.greatest(F.col("share") - F.col("size"), F.lit(0).cast("long")).alias("shortfall"))


def normalised_entropy(values: DataFrame, value: str) -> DataFrame:
    """One row: the entropy of shares over its largest; 1 for one group at most, 0 for a sum of 0."""
    s = values.agg(F.count("*").alias("g"), F.sum(value).alias("total"), F.collect_list(F.col(value).cast("double")).alias("v"))
    p = F.transform("v", lambda x: F.try_divide(x, F.col("total")))
    h = F.aggregate(F.filter(p, lambda x: x > 0), F.lit(0.0), lambda a, x: a - x * F.ln(x))
    return s.select(F.when(F.col("g") <= 1, 1.0).when(F.col("total") == 0, 0.0).otherwise(F.round(h / F.ln(F.col("g").cast("double")), 6)).alias("balance"))


def rates(scored: DataFrame, score: str, truth: str, threshold: float, by: str | None = None) -> DataFrame:
    """Sensitivity and specificity with intervals."""
    hit = F.col(score) >= threshold
    pos, neg = F.col(truth) == 1, F.col(truth) == 0
    t = (scored.groupBy(by) if by else scored.groupBy()).agg(F.count_if(pos).alias("positives"), F.count_if(pos & hit).alias("true_positives"), F.count_if(neg).alias("negatives"), F.count_if(neg & ~hit).alias("true_negatives"))
    return t.withColumn("sensitivity", wilson(F.col("true_positives"), F.col("positives"))).withColumn("specificity", wilson(F.col("true_negatives"), F.col("negatives")))


def threshold_sweep(scored: DataFrame, score: str, truth: str, thresholds: list[float]) -> DataFrame:
    """Sensitivity, specificity and Youden's index for each threshold; NaN where a class is missing."""
    nan = F.lit(float("nan"))
    aggs = []
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= t
        aggs += [F.avg(F.when(F.col(truth) == 1, hit.cast("double"))).alias(f"se{i}"), F.avg(F.when(F.col(truth) == 0, (~hit).cast("double"))).alias(f"sp{i}")]
    one = scored.agg(*aggs)  # one pass for all thresholds
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.coalesce(F.col(f"se{i}"), nan).alias("sensitivity"), F.coalesce(F.col(f"sp{i}"), nan).alias("specificity")) for i, t in enumerate(thresholds))))
    return one.select(rows.alias("r")).select("r.*").withColumn("youden", F.col("sensitivity") + F.col("specificity") - 1)


def holm(tests: DataFrame, family: str, name: str, p: str) -> DataFrame:
    """Step-down adjusted p-values within families."""
    w = Window.partitionBy(family)
    t = tests.withColumn("_m", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(p, name)))
    raw = F.col(p) * (F.col("_m") - F.col("_r") + 1)
    top = F.max(raw).over(w.orderBy("_r").rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("adjusted", F.least(F.lit(1.0), top)).drop("_m", "_r")


def ranking_quality(ranks: DataFrame, by: str, rank: str) -> DataFrame:
    """top-1, top-3 and mean reciprocal rank; a null rank is a miss."""
    r = F.col(rank)
    return ranks.groupBy(by).agg(F.avg(F.coalesce((r <= 1).cast("double"), F.lit(0.0))).alias("top1"), F.avg(F.coalesce((r <= 3).cast("double"), F.lit(0.0))).alias("top3"), F.avg(F.coalesce(F.try_divide(F.lit(1.0), r.cast("double")), F.lit(0.0))).alias("mrr"))


def _information(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(t, mi, ha, hb) of two groupings: rows, mutual information and entropies."""
    t = labels.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    t = t.withColumn("na", F.sum("n").over(Window.partitionBy(a))).withColumn("nb", F.sum("n").over(Window.partitionBy(b)))
    total = labels.agg(F.count("*").cast("double").alias("t"))
    t = t.crossJoin(F.broadcast(total))
    return t.agg(F.max("t").alias("t"), F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"), F.sum(-F.col("n") / F.col("t") * F.ln(F.col("na") / F.col("t"))).alias("ha"), F.sum(-F.col("n") / F.col("t") * F.ln(F.col("nb") / F.col("t"))).alias("hb"))


def nmi(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Normalised mutual information of two groupings (arithmetic mean of their entropies)."""
    return _information(labels, a, b).select(F.when(F.col("ha") + F.col("hb") == 0, 1.0).otherwise(2 * F.col("mi") / (F.col("ha") + F.col("hb"))).alias("nmi"))


def log_factorial(n: Column) -> Column:
    """ln(n!) of whole numbers by Stirling's series from n + 8 on, good to 1e-11."""
    z = n + F.lit(8.0)
    low = reduce(lambda x, k: x * (n + F.lit(float(k))), range(2, 8), n + F.lit(1.0))
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - 1 / (1680 * z * z * z * z * z * z * z)
    return (z - 0.5) * F.ln(z) - z + math.log(2 * math.pi) / 2 + series - F.ln(low)


def ami(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Mutual information of two groupings beyond what chance gives, over the mean entropy beyond it.

    Chance shares rows between groups hypergeometrically. Groups of one size expect the same, so only distinct
    sizes meet: fewer than sqrt(2 * rows) on a side.
    """
    sizes = lambda c, s, m: labels.groupBy(c).agg(F.count("*").alias(s)).groupBy(s).agg(F.count("*").alias(m))
    info = _information(labels, a, b)
    t = sizes(a, "x", "mx").crossJoin(sizes(b, "y", "my")).crossJoin(F.broadcast(info.select("t")))
    # By Hoeffding's bound, chance is under exp(-2 d * d / least(x, y)) at d from its mean: beyond ``far`` under exp(-800), which is 0 as a double.
    least, mean = F.least("x", "y"), F.col("x") * (F.col("y") / F.col("t"))
    far = F.ceil(F.sqrt(least * 400.0)) + 1
    low = F.greatest(F.lit(1), F.col("x") + F.col("y") - F.col("t").cast("long"), F.floor(mean) - far)
    high = F.least("x", "y", F.ceil(mean) + far)
    t = t.where(low <= high).repartition("x", "y").withColumn("n", F.explode(F.sequence(low, high)))
    x, y, n, rows = (F.col(c).cast("double") for c in ("x", "y", "n", "t"))
    g = log_factorial
    chance = F.exp(g(x) + g(y) + g(rows - x) + g(rows - y) - g(rows) - g(n) - g(x - n) - g(y - n) - g(rows - x - y + n))
    emi = t.agg(F.coalesce(F.sum(F.col("mx") * F.col("my") * n / rows * F.ln(rows * n / (x * y)) * chance), F.lit(0.0)).alias("emi"))
    most = (F.col("ha") + F.col("hb")) / 2 - F.col("emi")
    return info.crossJoin(emi).select(F.when((F.col("ha") + F.col("hb") == 0) | (F.abs(most) < 1e-12), 1.0).otherwise((F.col("mi") - F.col("emi")) / most).alias("ami"))


def fit_trajectories(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """y = a - (a - f) exp(-c x) for each key by least squares, with the x of 90 % of the way."""
    import numpy as np
    import pandas as pd

    def fit(key_, t: pd.DataFrame) -> pd.DataFrame:
        xs, ys = t[x].to_numpy(float), t[y].to_numpy(float)
        best = (np.inf, np.nan, np.nan, np.nan)
        for c in np.geomspace(0.01, 5, 200):  # for a given c the rest is linear
            e = np.exp(-c * xs)
            m = np.stack([1 - e, e], 1)
            (a, f), *_ = np.linalg.lstsq(m, ys, rcond=None)
            err = float(((m @ [a, f] - ys) ** 2).sum())
            if err < best[0] - 1e-15:
                best = (err, a, f, c)
        return pd.DataFrame([[key_[0], best[1], best[2], best[3], np.log(10) / best[3]]], columns=[key, "asymptote", "start", "rate", "x90"])

    kind = dict(rows.dtypes)[key]
    return rows.groupBy(key).applyInPandas(fit, f"`{key}` {kind}, asymptote double, start double, rate double, x90 double")


def checkpoint_rounds(last: int) -> list[int]:
    return sorted({0, *(round(i * last / 3) for i in (1, 2, 3))})


def gradient(rows: DataFrame, by: str, y: str, x: str) -> DataFrame:
    """Slope and intercept of a value on its position, for each group."""
    return rows.groupBy(by).agg(F.round(F.regr_slope(y, x), 12).alias("slope"), F.round(F.regr_intercept(y, x), 6).alias("intercept"), F.count("*").alias("n"))


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """Newman's modularity of communities (node, community) over undirected edges (s, o), each given once."""
    c = lambda side: communities.select(F.col("node").alias(side), F.col("community").alias(f"{side}_c"))
    t = edges.join(c("s"), "s").join(c("o"), "o")
    inside = t.agg(F.sum((F.col("s_c") == F.col("o_c")).cast("double")).alias("l"), F.count("*").cast("double").alias("m"))
    degree = t.select(F.col("s_c").alias("c")).union(t.select("o_c")).groupBy("c").agg(F.count("*").cast("double").alias("d"))
    squares = degree.agg(F.sum(F.col("d") * F.col("d")).alias("q"))
    return inside.crossJoin(squares).select((F.col("l") / F.col("m") - F.col("q") / (4 * F.col("m") * F.col("m"))).alias("modularity"))
