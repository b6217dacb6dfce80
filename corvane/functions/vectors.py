"""Vectors: dot products in the JVM, and matching of two sets of vectors block by block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Sequential sum of products in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, guard: float = 1e-10) -> Column:
    return dot(a, b) / ((F.sqrt(dot(a, a)) + guard) * (F.sqrt(dot(b, b)) + guard))


#: Rows of the smaller side that are broadcast at most; beyond, it is dealt by blocks.
SMALL = 20_000


def pairs(left: DataFrame, right: DataFrame, blocks: int = 0) -> DataFrame:
    """All pairs with a bounded right side: broadcast while small, else right blocks meet all rows of the left in turn."""
    few = right.limit(SMALL + 1).count() <= SMALL
    if few:
        return left.crossJoin(F.broadcast(right))
    n = blocks or 64
    return left.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(right.withColumn("_b", F.pmod(F.xxhash64(*right.columns), F.lit(n)).cast("int")), "_b").drop("_b")


def match_terms(terms: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Each term's nearest label: (term, v) against (label, w); ties go to the smallest label."""
    p = pairs(terms, labels).withColumn("sim", dot(F.col("v"), F.col("w")))
    best = p.groupBy("term").agg(F.max(F.struct("sim", (-F.col("label")).alias("tie"))).alias("b"))
    return best.select("term", (-F.col("b.tie")).alias("label"), F.round("b.sim", 6).alias("similarity"), (F.col("b.sim") >= threshold).alias("matched"))


def match_terms_blocked(terms: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """The same by matrix products over Arrow batches; the labels (at most ``SMALL``) are sent to the executors."""
    import numpy as np
    import pandas as pd

    got = labels.orderBy("label").limit(SMALL + 1).collect()
    if len(got) > SMALL:
        return match_terms(terms, labels, threshold)
    names, w = np.array([r["label"] for r in got]), np.array([r["w"] for r in got], float)

    def run(frames):
        for t in frames:
            s = np.stack(t["v"].to_numpy()).astype(float) @ w.T if len(t) else np.zeros((0, len(w)))
            k = s.argmax(1)
            best = s[np.arange(len(s)), k]
            yield pd.DataFrame({"term": t["term"], "label": names[k], "similarity": best.round(6), "matched": best >= threshold})

    return terms.mapInPandas(run, "term long, label long, similarity double, matched boolean")


def coverage(matched: DataFrame, by: str | None = None) -> DataFrame:
    """Share of matched terms, 0 without any."""
    t = (matched.groupBy(by) if by else matched.groupBy()).agg(F.count("*").alias("n_terms"), F.count_if("matched").alias("n_matched"), F.avg(F.col("matched").cast("double")).alias("_c"))
    return t.withColumn("coverage", F.round(F.coalesce("_c", F.lit(0.0)), 6)).drop("_c")


def class_scores(classes: DataFrame, chunk_terms: DataFrame, threshold: float) -> DataFrame:
    """Classes by the similarity of their nearest chunk term: (label, w) against (term, v), at the threshold or over it."""
    best = pairs(classes, chunk_terms).withColumn("sim", dot(F.col("v"), F.col("w"))).groupBy("label").agg(F.max("sim").alias("sim"))
    return best.where(F.col("sim") >= threshold).select("label", F.round("sim", 6).alias("score"))
