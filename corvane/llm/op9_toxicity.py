"""Toxicity scores: gradient-boosted trees over dense features, with isotonic calibration.

What is learned comes from at most ``SAMPLE`` labelled documents (in order of a hash of doc_id). They
are dealt in two halves by another hash. Each half gives a lexicon of words and word beginnings that
mark toxic documents; a document's features (lexicon densities, second-person proximity, capitals,
punctuation and obfuscation rates) are taken with the lexicon of the half it isn't in, and the trees
are trained on all of them. Two models, each trained on half of the rows, score the rest, and isotonic
regression on these scores calibrates the model trained on all. Every document is then scored where it
lies, with the lexicon of the whole sample; only the lexicon and the trees are sent out. Both follow
the sample and not the corpus. Nothing depends on how many labels there are or how long a text is.

Defined cases: a null or empty text is scored as a text without words; labels that are null or not
0/1, and labels of no document, are left out and take no place in the sample; of several labels of a
doc_id the largest counts, of several texts of a doc_id the one with the smallest hash trains; repeated
rows are scored each; without positive or without negative labels all scores are the share of positives
(0 without labels); rows with a null doc_id are not held out and never train; no rows give no rows; other
columns pass unchanged (``score`` names its column, and tells if it is taken).
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.scratch import Scratch, bound_batches, fresh

#: Labelled documents that the model is fitted on at most.
SAMPLE = 20_000
THRESHOLD = 0.7

# Second-person words of the corpus languages, and digits and signs that stand for letters.
YOU = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deinen ihr euch tú ti tuyo usted ustedes vosotros".split())
LEET = str.maketrans("013457@$!", "oieastasi")

WORD = re.compile(r"[^\W_]+(?:[0-9@$!*]+[^\W_]+)*")
BEYOND = re.compile(r"[^\x00-\x7F]")
PREFIXES = (4, 5, 6)
FEATURES = 15


def _units(text: str):
    """(word, whether it looked obfuscated) for every word, lower-cased."""
    for w in WORD.findall(text):
        low = w.lower()
        if low.isalpha():
            yield low, False
        elif low.isdigit():
            yield low, False
        else:
            yield low.translate(LEET).replace("*", ""), True


def _marks(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in PREFIXES if len(word) >= n]


def _document_marks(text: str) -> set[str]:
    return {m for w in {w for w, _ in _units(text)} for m in _marks(w)}


def features(text: str | None, lexicon: dict[str, float], known: dict[str, float] | None = None) -> list[float]:
    """The dense features of one whole text."""
    text = text or ""
    known = {} if known is None else known
    words = WORD.findall(text)
    hits, at, you, odd, odd_hits, upper, total, best = [], [], [], 0, 0, 0, 0.0, 0.0
    for i, w in enumerate(words):
        weight = known.get(w)
        if weight is None:
            low = w.lower()
            plain = low if low.isalpha() or low.isdigit() else low.translate(LEET).replace("*", "")
            weight = max((lexicon.get(m, 0.0) for m in _marks(plain)), default=0.0)
            weight = (weight, plain != low, len(w) > 1 and w.isupper(), low in YOU)
            if len(known) < 200_000:
                known[w] = weight
        if weight is NOTHING:
            continue
        value, strange, shout, second = weight
        if value:
            hits.append(w.lower())
            at.append(i)
            total += value
            best = max(best, value)
            odd_hits += strange
        odd += strange
        upper += shout
        if second:
            you.append(i)
    n, chars = max(len(words), 1), max(len(text), 1)
    near = 0
    if at and you:
        a, b = np.array(at), np.array(you)
        k = np.searchsorted(b, a)
        gap = np.minimum(np.abs(b[np.minimum(k, len(b) - 1)] - a), np.abs(b[np.maximum(k - 1, 0)] - a))
        near = int((gap <= 5).sum())
    marks = text.count("!"), text.count("?")
    capitals = sum(text.count(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ") + sum(map(str.isupper, () if text.isascii() else BEYOND.findall(text)))
    return [len(hits), len(set(hits)), 1000 * len(hits) / n, total, best, 1000 * total / n, near, 1000 * len(you) / n, capitals / chars, upper / n, 1000 * marks[0] / chars, 1000 * marks[1] / chars, odd / n, odd_hits, math.log1p(len(words))]


NOTHING = (0.0, False, False, False)


class Trees:
    """Boosted regression trees on the logistic loss, with up to 64 bins a feature."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, leaf: float = 1.0):
        self.rounds, self.depth, self.rate, self.leaf = rounds, depth, rate, leaf

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, 64)[1:-1])) for c in x.T]
        # A feature that is mostly zero needs edges among its other values too.
        self.edges = [np.unique(np.concatenate([e, np.quantile(c[c > 0], np.linspace(0, 1, 16)) - 1e-9]) if (c > 0).any() else e) for e, c in zip(self.edges, x.T, strict=True)]
        b = np.stack([np.searchsorted(e, c) for e, c in zip(self.edges, x.T, strict=True)], 1)
        width = int(b.max(initial=0)) + 2
        f, self.trees = np.full(len(y), self.base), []
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node, tree = np.zeros(len(y), int), {}
            for depth in range(self.depth):
                first = (1 << depth) - 1
                for k in range(first, 2 * first + 1):
                    rows = np.flatnonzero(node == k)
                    tree[k] = None
                    if len(rows) < 4:
                        continue
                    gs, hs = g[rows], h[rows]
                    whole, best = gs.sum() ** 2 / (hs.sum() + self.leaf), (1e-6, None)
                    for j in range(x.shape[1]):
                        gl, hl = np.cumsum(np.bincount(b[rows, j], gs, width))[:-1], np.cumsum(np.bincount(b[rows, j], hs, width))[:-1]
                        gain = gl**2 / (hl + self.leaf) + (gs.sum() - gl) ** 2 / (hs.sum() - hl + self.leaf) - whole
                        i = int(np.argmax(gain))
                        if gain[i] > best[0] + 1e-12:
                            best = (float(gain[i]), (j, i))
                    if best[1]:
                        tree[k] = best[1]
                        j, i = best[1]
                        node[rows] = 2 * k + 1 + (b[rows, j] > i)
            values = {int(k): self.rate * g[node == k].sum() / (h[node == k].sum() + self.leaf) for k in np.unique(node)}
            f += np.array([values[k] for k in node.tolist()])
            self.trees.append((tree, values))
        return self

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, c) for e, c in zip(self.edges, x.T, strict=True)], 1)
        out = np.full(len(x), self.base)
        for tree, values in self.trees:
            node = np.zeros(len(x), int)
            for depth in range(self.depth):
                first = (1 << depth) - 1
                for k in range(first, 2 * first + 1):
                    if tree.get(k):
                        rows = np.flatnonzero(node == k)
                        node[rows] = 2 * k + 1 + (b[rows, tree[k][0]] > tree[k][1])
            out += np.array([values.get(k, 0.0) for k in node.tolist()])
        return out


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (score, probability) of the best rising fit."""
    order = np.lexsort((-y, score))
    stack: list[list[float]] = []  # sum, weight, smallest and largest score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        stack.append([v, 1.0, s, s])
        while len(stack) > 1 and (stack[-2][0] * stack[-1][1] >= stack[-1][0] * stack[-2][1] or stack[-2][3] == stack[-1][2]):
            v2, w2, _, top = stack.pop()
            stack[-1][0] += v2
            stack[-1][1] += w2
            stack[-1][3] = top
    xs = [x for v, w, a, b in stack for x in ((a, b) if b > a else (a,))]
    ys = [v / w for v, w, a, b in stack for _ in range(2 if b > a else 1)]
    return np.array(xs), np.array(ys)


class Model:
    """What is sent to the executors: a lexicon, trees and calibration knots."""

    def __init__(self, lexicon: dict[str, float], x: np.ndarray, y: np.ndarray, share: float):
        self.lexicon, self.share, self.trees = lexicon, share, None
        if len(y) >= 8 and 0 < y.sum() < len(y):
            half = np.arange(len(y)) % 2 == 0
            oof = np.zeros(len(y))
            for train in (half, ~half):
                if 0 < y[train].sum() < train.sum():
                    oof[~train] = Trees().fit(x[train], y[train]).raw(x[~train])
                else:
                    oof[~train] = math.log((y.mean() + 1e-9) / (1 - y.mean() + 1e-9))
            self.knots = isotonic(oof, y)
            self.trees = Trees().fit(x, y)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None or not len(x):
            return np.full(len(x), self.share)
        return np.clip(np.interp(self.trees.raw(x), *self.knots), 0, 1)


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    good = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    good = good.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = good.join(texts.select("doc_id"), "doc_id", "left_semi")
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded: the parameter of the fit
    found = texts.join(F.broadcast(good), "doc_id")
    found = found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    return found.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(2)))


def _count_marks(batches):
    for batch in batches:
        n = Counter()
        for text, toxic in zip(*(batch.column(i).to_pylist() for i in range(2)), strict=True):
            n.update((m, toxic) for m in _document_marks(text or ""))
        if n:
            marks, toxic = zip(*n, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(marks, pa.string()), pa.array(toxic, pa.int32()), pa.array(list(n.values()), pa.int64())], names=["mark", "toxic", "n"])


def _lexicon(sample: DataFrame) -> dict[str, float]:
    """The marks of toxic documents and their log odds; as many as the sample's words give."""
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    p, n = sizes.get(1, 0), sizes.get(0, 0)
    if not p or not n:
        return {}
    counted = sample.select("text", "toxic").mapInArrow(_count_marks, "mark string, toxic int, n long").groupBy("mark").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("p"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("n"))
    least = max(2, round(0.006 * p))
    odds = F.log((F.col("p") + 0.5) / (p + 1.0)) - F.log((F.col("n") + 0.5) / (n + 1.0))
    top = counted.where(F.col("p") >= least).withColumn("odds", odds).where(F.col("odds") > 2.5)
    return {r["mark"]: r["odds"] for r in top.collect()}


def _featured(shared):
    def run(batches):
        known: dict = {}
        for batch in batches:
            rows = [features(t, shared.value, known) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1).cast(pa.int32()), batch.column(2).cast(pa.int64())], names=["x", "toxic", "doc_id"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    spark = docs.sparkSession
    s = Scratch(spark)
    rows = s.save(_labelled(docs, labels, sample), "labelled")
    got = []
    for half in (0, 1):
        shared = spark.sparkContext.broadcast(_lexicon(rows.where(F.col("half") != half)))
        train = rows.where(F.col("half") == half).select("text", "toxic", "doc_id").mapInArrow(_featured(shared), "x array<double>, toxic int, doc_id long")
        got += [(r["doc_id"], r["toxic"], list(r["x"])) for r in train.collect()]  # a row for each doc_id of the sample
    words = _lexicon(rows)
    s.drop("labelled")
    got.sort()
    x = np.array([g[2] for g in got]).reshape(-1, FEATURES)
    y = np.array([g[1] for g in got], float)
    return Model(words, x, y, float(y.mean()) if len(y) else 0.0)


def _scored(shared, schema: pa.Schema):
    def run(batches):
        model, known = shared.value, {}
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            x = np.array([features(t, model.lexicon, known) for t in texts]).reshape(-1, FEATURES)
            cols = [*batch.columns, pa.array(model.score(x), pa.float64())]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def score(docs: DataFrame, model: Model, name: str = "_score") -> DataFrame:
    """``docs`` with a last column ``name``, the calibrated probability that a document is toxic."""
    from pyspark.sql.pandas.types import to_arrow_schema

    if fresh(docs.columns, name) != name:
        raise ValueError(f"{name} is a column already")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    out = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bound_batches(docs.sparkSession)
    return docs.mapInArrow(_scored(shared, to_arrow_schema(out)), out)


def op9(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels, sample))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
