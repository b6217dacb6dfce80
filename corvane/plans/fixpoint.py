"""Fixpoints: rounds of distinct joins whose lineage is cut in the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 200
#: Edges that are merged in memory at once.
MERGED = 500_000


def _folder(df: DataFrame) -> str:
    """The folder the session names for checkpoints (one is made where none is named)."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="corvane-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint."""
    _folder(df)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """A frame written once in the checkpoint folder, compressed, for plans that read it more than once."""
    path, schema = f"{_folder(df)}/corvane-{uuid.uuid4().hex}", df.schema
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def closure(edges: DataFrame, reflexive: bool = False) -> DataFrame:
    """(s, o) reachable in one step or more over edges (s, o); ``reflexive`` adds every node to itself."""
    edges = cut(edges.select("s", "o").where("s is not null and o is not null").distinct())
    known, front = edges, edges
    for _ in range(ROUNDS):
        step = front.select("s", F.col("o").alias("m")).join(edges.select(F.col("s").alias("m"), "o"), "m").select("s", "o").distinct()
        front = cut(step.join(known, ["s", "o"], "left_anti"))
        if front.isEmpty():
            break
        known = cut(known.union(front))
    else:
        raise RuntimeError(f"no fixpoint in {ROUNDS} rounds")
    if reflexive:
        nodes = edges.select("s").union(edges.select("o")).distinct()
        known = known.union(nodes.select("s", F.col("s").alias("o"))).distinct()
    return known


def _merged(most: int):
    """Batches of (block, whole, s, o), sorted by whole and block, to (node, root, whole): least nodes of what each block connects.

    A block over ``most`` edges is merged in pieces; its pairs connect what its edges do.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        schema = pa.schema([("node", pa.string()), ("root", pa.string()), ("whole", pa.bool_())])

        def merge(t):
            both = pa.concat_arrays([t["s"].combine_chunks(), t["o"].combine_chunks()]).dictionary_encode()
            names = both.dictionary
            order = pc.sort_indices(names)
            rank = np.empty(len(names), np.int64)
            rank[order.to_numpy()] = np.arange(len(names))
            ids = rank[both.indices.to_numpy()]
            a, b = ids[: len(t)], ids[len(t) :]
            root = np.arange(len(names))
            while len(a):
                x, y = root[a], root[b]
                apart = x != y
                if not apart.any():
                    break
                a, b, x, y = a[apart], b[apart], x[apart], y[apart]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while (root[root] != root).any():
                    root = root[root]
            names = names.take(order).cast(pa.string())
            return pa.RecordBatch.from_arrays([names, names.take(pa.array(root)), pa.array(np.full(len(names), t["whole"][0].as_py()))], schema=schema)

        held, rows, last = [], 0, None

        def flush():
            t = pa.Table.from_batches(held)
            held.clear()
            return merge(t)

        # Blocks are independent of each other, so several small ones are merged at once; only pieces of split ones stay apart.
        for batch in batches:
            block, whole = batch["block"], batch["whole"]
            at = 0
            while at < len(batch):
                cut_at = len(batch)
                first = (block[at].as_py(), whole[at].as_py())
                if held and rows >= most and (first != last or not first[1]):
                    yield flush()
                    rows = 0
                elif held and first[1] != last[1]:
                    yield flush()
                    rows = 0
                if pc.min(whole.slice(at)).as_py() != pc.max(whole.slice(at)).as_py() or rows + len(batch) - at > most:
                    keys = np.asarray(block.slice(at).to_numpy(zero_copy_only=False))
                    kind = np.asarray(whole.slice(at).to_numpy(zero_copy_only=False))
                    new = np.flatnonzero((keys[1:] != keys[:-1]) | (kind[1:] != kind[:-1]))
                    cut_at = at + int(new[0]) + 1 if len(new) else len(batch)
                part = batch.slice(at, cut_at - at)
                held.append(part)
                rows += len(part)
                last = (block[cut_at - 1].as_py(), whole[cut_at - 1].as_py())
                at = cut_at
        if held:
            yield flush()

    return run


def components(edges: DataFrame, within: str | None = None, most: int = MERGED) -> DataFrame:
    """(node, root): the smallest node connected with each node of text edges (s, o).

    Nodes of edges with different values of ``within`` never meet. A value of up to ``most`` edges is merged by one task, the rows
    of larger ones are dealt out, merged in pieces, and the pieces in rounds.
    """
    if within is None:
        return _rounds(edges)
    large = edges.groupBy(F.xxhash64(within).alias("block")).agg(F.count("*").alias("n")).where(F.col("n") > most).withColumn("parts", F.ceil(F.col("n") / most))
    large = F.broadcast(stored(large))  # at most one for each ``most`` edges
    t = edges.where("s is not null and o is not null").select(F.xxhash64(within).alias("block"), "s", "o").join(large, "block", "left")
    t = t.select("block", F.col("parts").isNull().alias("whole"), F.coalesce(F.pmod(F.xxhash64("s", "o"), F.col("parts")), F.lit(0)).alias("part"), "s", "o")
    t = t.repartition("block", "part").sortWithinPartitions("whole", "block", "part").select("block", "whole", "s", "o")
    got = t.mapInArrow(_merged(most), "node string, root string, whole boolean")
    if large.isEmpty():
        return got.select("node", "root")
    got = stored(got)
    split = got.where("not whole")
    return got.where("whole").select("node", "root").union(_rounds(split.select(F.col("node").alias("s"), F.col("root").alias("o"))))


def _rounds(edges: DataFrame) -> DataFrame:
    both = cut(edges.select("s", "o").union(edges.select("o", "s")).distinct())
    label = cut(both.groupBy("s").agg(F.min("o").alias("m")).select(F.col("s").alias("node"), F.least("s", "m").alias("root")))
    for _ in range(ROUNDS):
        near = both.join(label.select(F.col("node").alias("o"), "root"), "o").groupBy("s").agg(F.min("root").alias("low"))
        new = label.join(near.select(F.col("s").alias("node"), "low"), "node").select("node", F.least("root", "low").alias("root"))
        # A root may have a smaller root itself: pointers are doubled.
        up = new.select(F.col("node").alias("root"), F.col("root").alias("top"))
        new = cut(new.join(up, "root").select("node", "top"))
        changed = new.join(label, "node").where("top <> root").isEmpty()
        label = new.select("node", F.col("top").alias("root"))
        if changed:
            return label
    raise RuntimeError(f"no fixpoint in {ROUNDS} rounds")
