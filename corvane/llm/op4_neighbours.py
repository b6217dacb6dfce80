"""Approximate nearest neighbours by inner product, with an adaptive scan of dimensions.

Equal vectors are one entry, with the ids that a query can need (the smallest ``k`` + 1). Entries are
put in the lists of a coarse index (centroids of at most ``SAMPLE`` entries, in order of a hash; every
entry is indexed). Inner products become distances by one more coordinate, which brings all vectors
to the largest norm, and a random rotation spreads a distance evenly over the dimensions.

Lists are stored in blocks of at most ``ROWS`` entries, so a list that holds a third of all rows is
many blocks. A task holds a block in column blocks of ``STEP`` dimensions and scans it for the queries
that probe its list: after each column block a candidate whose partial distance is over what a
hypothesis test allows, given the k-th best distance so far, is abandoned. What is left is scored in
double precision on the original vectors. Each query's best ``k`` + 1 entries of all blocks are merged
by an aggregate that keeps a bounded number, never all candidates.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part,
as queries or candidates; so do rows with a null vec_id; vectors of other than the most common length
take no part either; a query with fewer candidates gets all of them; repeated rows with the same
vec_id count as one; other columns aren't used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.scratch import Scratch

K, EVERY = 20, 20
SAMPLE, ROWS, QUERIES, STEP = 10_000, 2_048, 8_192, 16
#: Significance of the test that abandons a candidate.
EPSILON = 2.1
#: Share of the sample's true neighbours that the probed lists are to hold.
RECALL = 0.96


def _clean(table: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    ok = F.size(v) > 0
    ok &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return table.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & ok)


class Coarse:
    """Rotation, augmentation and centroids."""

    def __init__(self, sample: np.ndarray, norm: float, lists: int, top: int = K + 1, recall: float = RECALL, seed: int = 13):
        rng = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        self.norm = norm
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        x = self.base(sample)
        c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
        for _ in range(8):
            near = self.nearest(x, c)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            n = np.bincount(near, minlength=len(c))
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        self.centroids, self.top, self.sample = c, top, x
        # Probes: as many lists as held enough of the sample's true neighbours of some of its own vectors.
        q = self.query(sample[:: max(1, len(x) // 400)])
        near = np.argsort(-(q @ x.T - (x * x).sum(1) / 2), axis=1)[:, :top]
        rank = np.argsort(np.argsort(-(q @ c.T - (c * c).sum(1) / 2), axis=1), axis=1)
        need = np.sort(np.take_along_axis(rank, self.nearest(x, c)[near], 1).ravel())
        self.count = int(need[min(len(need) - 1, int(recall * len(need)))]) + 1

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """A distance within which each query has entries enough: those of the sample."""
        n = 4 * self.top  # some may lie in lists that aren't probed
        if len(self.sample) < n:
            return np.full(len(q), np.inf)
        d = (self.sample**2).sum(1) - 2 * q @ self.sample.T
        return np.partition(d, n - 1, axis=1)[:, n - 1] + (q * q).sum(1)

    def base(self, v: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm**2 - (v * v).sum(1), 0))
        return np.concatenate([v, rest[:, None]], 1) @ self.rotation

    def query(self, v: np.ndarray) -> np.ndarray:
        """Queries scaled to the common norm, which leaves their order of candidates as it is."""
        v = v * (self.norm / np.sqrt((v * v).sum(1)))[:, None]
        return np.concatenate([v, np.zeros((len(v), 1))], 1) @ self.rotation

    @staticmethod
    def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        half = (c * c).sum(1) / 2
        return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, 1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        score = q @ self.centroids.T - (self.centroids**2).sum(1) / 2
        n = min(n, score.shape[1])
        return np.argpartition(-score, n - 1, axis=1)[:, :n]


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _assign(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            if len(batch):
                lists = index.nearest(index.base(_matrix(batch.column(1))), index.centroids)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(lists, pa.int32())], names=["entry", "v", "ids", "list"])

    return run


def _probe(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch.slice(a, 256)
                q = index.query(_matrix(some.column(1)))
                lists = index.probes(q, index.count)
                at = pa.array(np.repeat(np.arange(len(some)), lists.shape[1]))
                yield pa.RecordBatch.from_arrays([some.column(0).take(at), some.column(1).take(at), pa.array(index.bounds(q)).take(at), pa.array(lists.ravel(), pa.int32())], names=["entry", "v", "bound", "list"])

    return run


def scan(q: np.ndarray, x: np.ndarray, bound: np.ndarray, step: int = STEP, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """(query, candidate) pairs that the tests leave, by partial distances in column blocks.

    ``bound`` is a distance that each query's k-th best is known not to exceed.
    """
    d, at, part = x.shape[1], None, None
    for a in range(0, d, step):
        qs, xs = q[:, a : a + step], np.ascontiguousarray(x[:, a : a + step])
        seen = a + xs.shape[1]
        size, own = (xs * xs).sum(1), (qs * qs).sum(1)
        if at is None or len(at[0]) > 0.3 * len(q) * len(x):
            whole = size - 2 * qs @ xs.T + own[:, None]
            part = whole.ravel() if at is None else part + whole[at]
        else:
            part = part + size[at[1]] - 2 * np.einsum("ij,ij->i", qs[at[0]], xs[at[1]]) + own[at[0]]
        if at is None:
            at = np.divmod(np.arange(len(q) * len(x)), len(x))
        # The whole distance is estimated as d / seen of this; the test allows for its spread.
        slack = (1 + epsilon / np.sqrt(seen)) ** 2 if seen < d else 1 + 1e-9
        keep = part * (d / seen) <= bound[at[0]] * slack + 1e-12
        at, part = (at[0][keep], at[1][keep]), part[keep]
    return at


def _search(shared, top: int):
    kind = pa.list_(pa.struct([("score", pa.float64()), ("ids", pa.list_(pa.int64()))]))

    def run(left, right):
        """One block of a list and a block of the queries that probe the list."""
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], kind)], names=["query", "found"])
        index = shared.value
        v, ids = _matrix(left["v"]), left["ids"].to_pylist()
        first = np.array([i[0] for i in ids])
        x = index.base(v)
        entries, queries, bounds = right["entry"].to_pylist(), _matrix(right["v"]), np.asarray(right["bound"])
        names, out = [], []
        for a in range(0, len(queries), 256):
            qs = queries[a : a + 256]
            qi, xi = scan(index.query(qs), x, bounds[a : a + 256])
            score = np.einsum("ij,ij->i", v[xi], qs[qi])
            order = np.lexsort((first[xi], -score, qi))
            qi, xi, score = qi[order], xi[order], score[order]
            cut = np.searchsorted(qi, np.arange(len(qs) + 1))
            for k in range(len(qs)):
                some = range(cut[k], min(cut[k + 1], cut[k] + top))
                if some:
                    names.append(entries[a + k])
                    out.append([{"score": float(score[i]), "ids": ids[xi[i]]} for i in some])
        return pa.table([pa.array(names, pa.int64()), pa.array(out, kind)], names=["query", "found"])

    return run


def _merge(top: int):
    def run(batches):
        """Rows of a partition come sorted by query; each query's best are kept bounded."""
        held, name = [], None

        def flush():
            ids = [(-s, i) for s, group in held for i in group]
            ids.sort()
            return {"query": name, "best": [{"vec_id": i, "score": -s} for s, i in ids[: top]]}

        schema = pa.schema([("query", pa.int64()), ("best", pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())])))])
        out = []
        for batch in batches:
            for query, found in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if query != name:
                    if held:
                        out.append(flush())
                    held, name = [], query
                held += [(f["score"], f["ids"]) for f in found]
                if len(held) > 8 * top:
                    held.sort(key=lambda f: (-f[0], f[1][0]))
                    del held[top:]
            if len(out) > 500:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
        if held:
            out.append(flush())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return run


def neighbours(table: DataFrame, k: int = K, every: int = EVERY, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found of each query (rows whose vec_id is divisible by ``every``)."""
    spark: SparkSession = table.sparkSession
    s = Scratch(spark)
    empty = "query_id long, rank int, vec_id long, score double"
    rows = s.save(_clean(table), "rows")
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], empty)
    rows = rows.where(F.size("v") == common["d"])
    # Equal vectors: partial aggregates keep k + 1 ids for each task's part of a group before the shuffle.
    part = rows.withColumn("salt", F.spark_partition_id()).groupBy("v", "salt").agg(F.collect_set("vec_id").alias("ids")).withColumn("ids", F.slice(F.array_sort("ids"), 1, k + 1))
    entries = part.groupBy("v").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"))
    entries = s.save(entries.select(F.element_at("ids", 1).alias("entry"), "v", "ids"), "entries")
    stats = entries.agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("q")).first()
    some = np.array([r["v"] for r in entries.orderBy(F.xxhash64("entry"), "entry").select("v").limit(sample).collect()])
    lists = max(1, int(np.sqrt(stats["n"]) / 2))
    index = spark.sparkContext.broadcast(Coarse(some, float(np.sqrt(stats["q"])) * (1 + 1e-12), lists, k + 1, recall))
    listed = s.save(entries.mapInArrow(_assign(index), "entry long, v array<double>, ids array<long>, list int"), "listed")
    # A list is dealt in blocks by a hash of the entry.
    sizes = listed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(float(ROWS))).cast("int").alias("blocks"))
    sizes = F.broadcast(sizes)  # at most one row for each list: the square root of the entries
    listed = listed.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("entry"), F.col("blocks")).cast("int")).drop("blocks")
    asked = rows.where(F.col("vec_id") % every == 0).select("v").groupBy("v").agg(F.lit(1).alias("one")).join(entries.select("v", "entry"), "v").select("entry", "v")
    asked = s.save(asked, "asked")

    def search(probed: DataFrame, name: str) -> DataFrame:
        asking = F.broadcast(probed.groupBy("list").agg(F.ceil(F.count("*") / F.lit(float(QUERIES))).cast("int").alias("parts")))
        probed = probed.join(sizes, "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        probed = probed.join(asking, "list").withColumn("part", F.pmod(F.xxhash64("entry"), F.col("parts")).cast("int")).drop("parts")
        dealt = listed.join(asking, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        found = dealt.groupBy("list", "block", "part").cogroup(probed.groupBy("list", "block", "part")).applyInArrow(_search(index, k + 1), "query long, found array<struct<score:double,ids:array<long>>>")
        best = found.repartition("query").sortWithinPartitions("query").mapInArrow(_merge(k + 1), "query long, best array<struct<vec_id:long,score:double>>")
        return s.save(best, name)

    probed = s.save(asked.mapInArrow(_probe(index), "entry long, v array<double>, bound double, list int"), "probed")
    best = search(probed, "best")
    # Queries for which the probed lists gave too few search all lists without a bound.
    want = min(k + 1, int(stats["ids"]))
    short = asked.join(best.where(F.size("best") >= want).select(F.col("query").alias("entry")), "entry", "left_anti")
    short = s.save(short.select("entry", "v", F.lit(float("inf")).alias("bound"), F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list")), "short")
    if not short.isEmpty():
        best = best.where(F.size("best") >= want).union(search(short, "more"))
    # Every query of an entry has the entry's result without itself.
    ids = rows.where(F.col("vec_id") % every == 0).join(entries.select("v", "entry"), "v").select(F.col("vec_id").alias("query_id"), F.col("entry").alias("query")).distinct()
    got = ids.join(best, "query").select("query_id", F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k).alias("best"))
    out = got.select("query_id", F.posexplode("best").alias("at", "b")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
    return s.done(out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
