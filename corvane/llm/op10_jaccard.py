"""N-gram Jaccard join as a join in the metric space of shingle sets.

Two documents link when the Jaccard similarity of their sets of distinct 5-word shingles is 0.8 or
more, that is when their Jaccard distance, a metric, is r = 0.2 or less. Documents with equal sets
are one node. The join works on what can link at all, and in this order:

1. Nodes. More than a fifth of a set's shingles in no other set rules all links out. A fixed half of
   the hash space is counted (by 32-bit keys within buckets, where a clash only keeps a node); the
   tasks send one entry for each key and block of documents, so common shingles don't pile up. Copies
   share nothing with each other, so a text with copies only is ruled out like one without any.
2. Regions. Sets that link share a shingle among their floor(n / 5) + 1 first in any fixed order. The
   order is by frequency, counted by 32-bit keys within buckets that shards of sets ask, so common
   passages come last however many sets there are. Nodes that share such a shingle and may have fitting
   lengths are in one region; so regions hold all links, and a region is the connected part of these.
3. Pivots. A region of more than ``LEAF`` shingles is split by all tasks: pivots are chosen far from
   each other, every set is measured against them, and sets within r of a pivot link with it. The
   others belong to the Voronoi cell of their nearest pivot and are replicated to the cells where the
   triangle inequality allows a link (distances to the two pivots that differ by 2 r at most); cells are
   regions of the next round. Where cells don't shrink, or repeat too many sets, the sets outside the
   region's largest component are compared with all blocks of it, in the windows that the distances to
   all pivots leave; some blocks of them at a time, so that the copies sent are bounded by the sets. Small
   regions are joined in the same way by one task each.

Copies are never expanded, and pairs within a component are not compared. Decisions are exact
(9 * shared >= 4 * (n1 + n2)) on 64-bit shingle hashes; equal sets are told by 128-bit digests. Two
shingles with one key count as one in the order, which may join regions; results stay the same.

Defined cases: null, empty or blank texts have an empty set and component_id = doc_id; texts of 1 to
4 words have one shingle; repeated rows link with each other; a null doc_id takes the component's
smallest doc_id, null if there is none; other columns aren't used (``one_of_each`` passes them
unchanged); no rows give no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.blocks import Rolling, blocks, mix, numbered, pack, ragged, sort_order
from corvane.llm.scratch import Scratch, fresh, groups, parts

WORDS = 5
MANY = 65_535
#: Shingles whose keys a task holds before it sends them.
WIDTH = 1 << 20
#: Sets that all cells of a region have together, for each set of the region, at most.
CELLS = 1.5
#: Shingles of a region that is joined by one task, and of a block of a larger one.
LEAF, BLOCK_OF = 1 << 19, 1 << 19
PIVOTS = 6
#: Rows that are broadcast at most.
BROADCAST = 500_000
#: Centres of stars that are broadcast at most; the others have few neighbours each.
CENTRES = 50_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_ROLL = Rolling(101)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a node's digest by which its shared shingles are counted.
SHORT = 5
_NAMELESS = np.uint64(1 << 8 * SHORT)


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block of documents, and the first word of each document."""
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begin, stop = ink.copy(), ink.copy()
    begin[1:] &= ~ink[:-1] | edge[1:-1]
    stop[:-1] &= ~ink[1:] | edge[1:-1]
    s = np.flatnonzero(begin)
    return s, np.flatnonzero(stop) + 1, np.searchsorted(s, at)


def sets_of(column: pa.Array):
    """The sorted shingle hashes of each document of a column."""
    for i, j, data, at in blocks(column):
        s, e, first = words_of(data, at)
        w = mix(_ROLL.of(_ROLL.prefix(_LOWER[data]), s, e) + (e - s).astype(np.uint64)) if len(s) else np.zeros(0, np.uint64)
        n = len(w) - WORDS + 1
        if n > 0:
            h = w[:n].copy()
            for k in range(1, WORDS):
                h *= _STEP
                h += w[k : n + k]
            h = mix(h)
        for d in range(j - i):
            a, b = int(first[d]), int(first[d + 1])
            if b - a >= WORDS:
                x = np.sort(h[a : b - WORDS + 1])
                yield x if len(x) < 2 else x[np.concatenate([[True], x[1:] != x[:-1]])]
            elif b > a:
                v = np.uint64(b - a)
                for y in w[a:b]:
                    v = mix(np.array([v]) * _STEP + y)[0]
                yield np.array([v], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


def digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(pack(x), digest_size=16).digest()


# 1. Nodes

_SENT = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("nodes", pa.binary()), ("times", pa.binary()), ("own", pa.binary())])
_COUNTS = pa.schema([("doc_id", pa.int64()), ("node", pa.binary()), ("n", pa.int32()), ("half", pa.int32()), ("shared", pa.int32())])
_SHARED = pa.schema([("piece", pa.int32()), ("nodes", pa.binary()), ("counts", pa.binary()), ("own", pa.binary())])


def _send(buckets: int):
    def run(batches):
        ids, ns, keys_of, hashes, refs, known = [], [], [], [], [], {}

        def flush():
            h, r = np.concatenate(hashes), np.repeat(np.arange(len(hashes)), [len(x) for x in hashes])
            key = (h >> np.uint64(40)) % np.uint64(buckets) << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
            order = sort_order(key)
            key, r = key[order], r[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            start = np.flatnonzero(new)
            count = np.diff(np.append(start, len(key)))
            shared = np.bincount(r[np.repeat(count > 1, count)], minlength=len(hashes))
            ref = np.where(count > 1, MANY, r[start]).astype(np.uint16)
            key = key[start]
            nodes = list(known)
            mine = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((ids, keys_of, ns, [len(hashes[known[k]]) if k else 0 for k in keys_of], [int(shared[known[k]]) if k else 0 for k in keys_of]), _COUNTS, strict=True)], schema=_COUNTS)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _COUNTS) as w:
                w.write_batch(mine)
            # By bucket and node, so that a node goes along once for its keys; keys of several nodes come last and have no name.
            b = (key >> np.uint64(32)).astype(np.int64)
            order = sort_order(b, ref)
            key, b, ref = key[order], b[order], ref[order]
            new = np.ones(len(key), bool)
            new[1:] = (b[1:] != b[:-1]) | (ref[1:] != ref[:-1])
            start = np.flatnonzero(new)
            times, name = np.diff(np.append(start, len(key))), ref[start]
            start, times, name = (x[name != MANY] for x in (start, times, name))
            cut, of = np.searchsorted(b, np.arange(buckets + 1)), np.searchsorted(b[start], np.arange(buckets + 1))
            home = int.from_bytes((nodes[0] if nodes else b"\0")[:4], "little") % buckets
            rows = []
            for k in np.unique(np.append(b, home)).tolist():
                some = slice(of[k], of[k + 1])
                rows.append({"bucket": k, "keys": pack(key[cut[k] : cut[k + 1]].astype(np.uint32)), "nodes": b"".join(nodes[v][:SHORT] for v in name[some].tolist()), "times": pack(times[some].astype(np.uint16)), "own": sink.getvalue().to_pybytes() if k == home else b""})
            ids.clear(), ns.clear(), keys_of.clear(), hashes.clear(), known.clear()
            return pa.RecordBatch.from_pylist(rows, schema=_SENT)

        size = 0
        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), sets_of(batch.column(1)), strict=True):
                k = digest(x) if len(x) else None
                if k is not None and k not in known:
                    known[k] = len(hashes)
                    hashes.append(x[(x >> np.uint64(39) & np.uint64(1)) == 0])
                    size += len(hashes[-1])
                ids.append(doc), ns.append(len(x)), keys_of.append(k)
                if size > 1_500_000 or len(ids) >= 60_000:
                    hashes.append(np.zeros(0, np.uint64))
                    yield flush()
                    size = 0
        if ids:
            hashes.append(np.zeros(0, np.uint64))
            yield flush()

    return run


def _count(pieces: int):
    """How many of a bucket's keys that other nodes have too each node has (by the first bytes of its digest), for ``pieces`` parts of the nodes.

    Copies in other tasks are the same node: they don't make a key shared, and a key counts once for them.
    """

    def run(table):
        keys, nodes, rows = [], [], []
        for row in table.to_pylist():
            if row["own"]:
                rows.append({"piece": -1, "own": row["own"]})
            keys.append(np.frombuffer(row["keys"], np.uint32))
            name = np.zeros((len(row["nodes"]) // SHORT, 8), np.uint8)
            name[:, :SHORT] = np.frombuffer(row["nodes"], np.uint8).reshape(-1, SHORT)
            x = np.full(len(keys[-1]), _NAMELESS)
            y = np.repeat(name.view(np.uint64)[:, 0], np.frombuffer(row["times"], np.uint16))
            x[: len(y)] = y
            nodes.append(x)
        key, node = np.concatenate(keys), np.concatenate(nodes)
        del keys, nodes
        if len(key):
            order = sort_order(key)
            key, node = key[order], node[order]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            several = np.minimum.reduceat(node, start) != np.maximum.reduceat(node, start)
            some = np.repeat(several, np.diff(np.append(start, len(key)))) & (node != _NAMELESS)
            key, node = key[some], node[some]
        first, ref = numbered(node)
        order = sort_order(ref, key)
        once = np.ones(len(key), bool)
        once[1:] = (ref[order][1:] != ref[order][:-1]) | (key[order][1:] != key[order][:-1])
        node, n = node[first], np.bincount(ref[order][once], minlength=len(first))
        part = (node % np.uint64(pieces)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        node, n, part = node[order], n[order].astype(np.uint32), part[order]
        names, first = np.unique(part, return_index=True)
        rows += [{"piece": k, "nodes": pack(x), "counts": pack(y)} for k, x, y in zip(names.tolist(), np.split(node, first[1:]), np.split(n, first[1:]), strict=True)] if len(part) else []
        return pa.Table.from_pylist(rows, schema=_SHARED)

    return run


def _sum(batches):
    nodes, counts = [], []
    for batch in batches:
        nodes += [np.frombuffer(x, np.uint64) for x in batch.column(0).to_pylist()]
        counts += [np.frombuffer(x, np.uint32) for x in batch.column(1).to_pylist()]
    if nodes:
        names, at = np.unique(np.concatenate(nodes), return_inverse=True)
        total = np.bincount(at, np.concatenate(counts)).astype(np.int64)
        raw = pack(names)
        yield pa.RecordBatch.from_arrays([pa.array([raw[i : i + SHORT] for i in range(0, len(raw), 8)], pa.binary()), pa.array(total)], names=["short", "others"])


def _own(batches):
    for batch in batches:
        for x in batch.column(0).to_pylist():
            yield from pa.ipc.open_stream(x)


# 2. Regions


_SETS = pa.schema([("node", pa.binary()), ("n", pa.int32()), ("items", pa.binary())])


def _sets(batches):
    """The sets of texts, each once for a task; with a second column only those of that digest."""
    seen: set[bytes] = set()
    for batch in batches:
        got = []
        wanted = batch.column(1).to_pylist() if batch.num_columns > 1 else [None] * len(batch)
        for k, x in zip(wanted, sets_of(batch.column(0)), strict=True):
            if len(x) and (d := digest(x)) not in seen and k in (None, d):
                seen.add(d)
                got.append((d, len(x), pack(x)))
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), _SETS, strict=True)], schema=_SETS)


_ASKED = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("homes", pa.binary()), ("counts", pa.binary())])
_TOLD = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])


def _keys(x: np.ndarray, buckets: int) -> np.ndarray:
    return (x >> np.uint64(40)) % np.uint64(buckets) << np.uint64(32) | x & np.uint64(0xFFFFFFFF)


def _ask(buckets: int, kind: type, width: int):
    """The keys of the sets of shards, by bucket, and how many sets of a task and a shard have each."""

    def run(batches):
        items, homes, held = [], [], 0

        def flush():
            key, home = _keys(np.concatenate(items), buckets), np.repeat(np.array(homes, kind), [len(x) for x in items])
            order = sort_order(key, home)
            key, home = key[order], home[order]
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (home[1:] != home[:-1])
            start = np.flatnonzero(new)
            count = np.minimum(np.diff(np.append(start, len(key))), MANY).astype(np.uint16)
            key, home = key[start], home[start]
            names, first = np.unique(key >> np.uint64(32), return_index=True)
            rows = [{"bucket": int(k), "keys": pack(x.astype(np.uint32)), "homes": pack(y), "counts": pack(z)} for k, x, y, z in zip(names, *(np.split(c, first[1:]) for c in (key, home, count)), strict=True)]
            items.clear(), homes.clear()
            return pa.RecordBatch.from_pylist(rows, schema=_ASKED)

        for batch in batches:
            for shard, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                items.append(np.frombuffer(x, np.uint64)), homes.append(shard)
                held += len(items[-1])
                if held > width:
                    yield flush()
                    held = 0
        if items:
            yield flush()

    return run


def _tell(kind: type):
    def run(key, table):
        """The keys of a bucket that several sets have, and how many, for each shard that has them."""
        keys, homes, counts = (np.frombuffer(b"".join(table[c].to_pylist()), k) for c, k in (("keys", np.uint32), ("homes", kind), ("counts", np.uint16)))
        order = sort_order(keys)
        keys, homes, counts = keys[order], homes[order], counts[order]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        total = np.repeat(np.add.reduceat(counts.astype(np.int64), start), np.diff(np.append(start, len(keys))))
        some = total > 1
        keys, homes, total = keys[some], homes[some], np.minimum(total[some], MANY).astype(np.uint16)
        order = sort_order(homes, keys)
        keys, homes, total = keys[order], homes[order], total[order]
        once = np.ones(len(keys), bool)
        once[1:] = (homes[1:] != homes[:-1]) | (keys[1:] != keys[:-1])
        keys, homes, total = keys[once], homes[once], total[once]
        names, first = np.unique(homes, return_index=True)
        rows = [{"shard": int(h), "bucket": key[0].as_py(), "keys": pack(x), "counts": pack(y)} for h, x, y in zip(names, np.split(keys, first[1:]), np.split(total, first[1:]), strict=True)] if len(keys) else []
        return pa.Table.from_pylist(rows, schema=_TOLD)

    return run


_PREFIX = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("n", pa.binary()), ("nodes", pa.binary()), ("edges", pa.binary())])


def _chain(key: np.ndarray, n: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Links of neighbours, in order of size, among the entries of a key, where sizes fit."""
    order = sort_order(key, n)
    k, m, v = key[order], n[order], node[order]
    fit = (k[1:] == k[:-1]) & (5 * m[:-1] >= 4 * m[1:]) & (v[1:] != v[:-1])
    return np.stack([v[:-1][fit], v[1:][fit]], 1)


def _forest(edges: np.ndarray, n: int) -> np.ndarray:
    """At most n - 1 edges (node, root) with the same components."""
    up = np.arange(n)

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in np.unique(edges, axis=0).tolist():
        x, y = find(a), find(b)
        if x != y:
            up[max(x, y)] = min(x, y)
    root = np.array([find(x) for x in range(n)], np.int64) if n else up
    some = np.flatnonzero(root != np.arange(n))
    return np.stack([some, root[some]], 1)


def _prefixes(buckets: int):
    def run(left, right):
        """The prefixes of a shard's sets, as far as other sets have their shingles."""
        told = sorted(zip(right["bucket"].to_pylist(), right["keys"].to_pylist(), right["counts"].to_pylist(), strict=True))
        known = np.concatenate([np.frombuffer(x, np.uint32).astype(np.uint64) | np.uint64(k << 32) for k, x, _ in told]) if told else np.zeros(0, np.uint64)
        times = np.frombuffer(b"".join(x for _, _, x in told), np.uint16)
        keys, sizes, nodes, seen = [], [], [], set()
        for node, n, items in zip(*(left[c].to_pylist() for c in ("node", "n", "items")), strict=True):
            if node in seen or not len(known):
                continue
            seen.add(node)
            x = np.frombuffer(items, np.uint64)
            key = _keys(x, buckets)
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            often = np.where(known[at] == key, times[at], 1)
            first = np.lexsort((x, often))[: n // 5 + 1]
            x = x[first[often[first] > 1]]
            if len(x):
                keys.append(x), sizes.append(n), nodes.append(node)
        if not keys:
            return _PREFIX.empty_table()
        key, n, v = np.concatenate(keys), np.repeat(np.array(sizes), [len(k) for k in keys]), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        edges = _forest(_chain(key, n, v), len(keys))
        # Of the entries of a key in a size class, all linked here, the smallest and the largest stand for all.
        size = (np.log(n) / np.log(1.25)).astype(np.int64)
        order = sort_order(key, size, n)
        key, n, v, size = key[order], n[order], v[order], size[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (size[1:] != size[:-1])
        end = np.append(new[1:], True)
        keep = new | end
        key, n, v = key[keep], n[keep], v[keep]
        b = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(b, kind="stable")
        names, first = np.unique(b[order], return_index=True)
        rows = [{"bucket": k, "keys": pack(key[at]), "n": pack(n[at].astype(np.int32)), "nodes": b"".join(nodes[x] for x in v[at].tolist()), "edges": b""} for k, at in zip(names.tolist(), np.split(order, first[1:]), strict=True)]
        if len(edges):
            rows.append({"bucket": int.from_bytes(nodes[0][:4], "little") % buckets, "keys": b"", "n": b"", "nodes": b"", "edges": b"".join(nodes[a] + nodes[b_] for a, b_ in edges.tolist())})
        return pa.Table.from_pylist(rows, schema=_PREFIX)

    return run


_EDGES = pa.schema([("u", pa.binary()), ("v", pa.binary())])


def _edges(table):
    keys, sizes, names = [], [], []
    out: set[tuple[bytes, bytes]] = set()
    for r in table.to_pylist():
        if r["edges"]:
            e = r["edges"]
            out.update((e[i : i + 16], e[i + 16 : i + 32]) for i in range(0, len(e), 32))
        if r["keys"]:
            keys.append(np.frombuffer(r["keys"], np.uint64)), sizes.append(np.frombuffer(r["n"], np.int32))
            names.append(r["nodes"])
    if keys:
        unique, v = _unique16(np.frombuffer(b"".join(names), "V16"))
        for a, b in _forest(_chain(np.concatenate(keys), np.concatenate(sizes).astype(np.int64), v), len(unique)).tolist():
            out.add((unique[a], unique[b]))
    u, v = zip(*sorted(out), strict=True) if out else ([], [])
    return pa.Table.from_arrays([pa.array(u, pa.binary()), pa.array(v, pa.binary())], schema=_EDGES)


def _unique16(table: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    seen: dict[bytes, int] = {}
    v = np.array([seen.setdefault(x, len(seen)) for x in map(bytes, table)], np.int64)
    return list(seen), v


def components(edges: DataFrame, s: Scratch, name: str = "cc") -> DataFrame:
    """(node, root): the smallest node of the connected part of each node of ``edges`` (u, v).

    Rounds of large and small stars; minima are summed in each task before the shuffle. A node with more
    than one in ``CENTRES`` of all ends has its minimum broadcast, so no star lands in one task.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e = s.save(e, f"{name}0")
    before, k, n = None, 0, e.count()

    def to_least(ends: DataFrame) -> DataFrame:
        """``ends`` with m, the least neighbour of u."""
        low = ends.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        crowded = 2 * n // CENTRES + 1_000
        hot = F.broadcast(low.where(F.col("d") > crowded).drop("d"))  # fewer than CENTRES rows
        cold = low.where(F.col("d") <= crowded).drop("d")
        return ends.join(hot, "u").unionByName(ends.join(hot, "u", "left_anti").join(cold, "u"))

    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = to_least(both).withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = to_least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        k += 1
        e = s.save(small, f"{name}{k}")
        s.drop(f"{name}{k - 1}")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, n = tuple(now), now[0]


# 3. Pivots


class Region:
    """Sets as rows of a sparse matrix; ``join`` gives the component of each."""

    def __init__(self, sets: list[np.ndarray], labels: list[bytes] | None = None, leaf: int = 16, pivots: int = PIVOTS):
        self.n = np.array([len(x) for x in sets], np.int64)
        self.ptr = np.concatenate([[0], np.cumsum(self.n)])
        _, self.ids = np.unique(np.concatenate(sets), return_inverse=True)
        self.up = np.arange(len(sets))
        self.flag = np.zeros(int(self.ids.max()) + 1, bool)
        self.leaf, self.pivots = leaf, pivots
        if labels:  # sets of one label are known to be connected
            first: dict[bytes, int] = {}
            self.up = np.array([first.setdefault(x, i) for i, x in enumerate(labels)], np.int64)

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return int(x)

    def roots(self, rows: np.ndarray) -> np.ndarray:
        r = self.up[rows]
        while (r != (s := self.up[r])).any():
            r = s
        self.up[rows] = r
        return r

    def shared(self, x: int, rows: np.ndarray) -> np.ndarray:
        own = self.ids[self.ptr[x] : self.ptr[x + 1]]
        self.flag[own] = True
        sizes = self.n[rows]
        hit = self.flag[self.ids[ragged(self.ptr[rows], sizes)]]
        self.flag[own] = False
        return np.add.reduceat(hit.astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))

    def link(self, x: int, rows: np.ndarray, shared: np.ndarray) -> None:
        for y in rows[9 * shared >= 4 * (self.n[x] + self.n[rows])].tolist():
            a, b = self.find(x), self.find(y)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def against(self, x: int, rows: np.ndarray) -> None:
        if len(rows):
            self.link(x, rows, self.shared(x, rows))

    def join(self) -> np.ndarray:
        todo = [np.arange(len(self.n))]
        while todo:
            rows = todo.pop()
            roots = self.roots(rows)
            if (roots == roots[0]).all():
                continue
            if len(rows) <= self.leaf:
                for i, x in enumerate(rows[:-1].tolist()):
                    rest = rows[i + 1 :]
                    self.against(x, rest[self.roots(rest) != self.find(x)])
                continue
            far, near = [], np.full(len(rows), 2.0)
            pick = 0
            for _ in range(self.pivots):
                x = int(rows[pick])
                s = self.shared(x, rows)
                self.link(x, rows, s)
                far.append(1 - s / (self.n[x] + self.n[rows] - s))
                near = np.minimum(near, far[-1])
                pick = int(np.argmax(near))
                if near[pick] == 0:
                    break
            d = np.stack(far)
            cell = np.argmin(d, axis=0)
            least = d[cell, np.arange(len(rows))]
            for k in range(len(d)):
                core = cell == k
                part = rows[core | (d[k] - least <= 0.4 + 1e-9)]
                if not core.any() or len(part) < 2:
                    continue
                if len(part) <= 0.7 * len(rows):
                    todo.append(part)
                else:
                    self.rest(rows, d)
                    break
        return self.roots(np.arange(len(self.n)))

    def rest(self, rows: np.ndarray, d: np.ndarray) -> None:
        """All links between components of ``rows``, by the windows of ``d``, the distances to pivots."""
        roots = self.roots(rows)
        names, count = np.unique(roots, return_counts=True)
        main = names[np.argmax(count)]
        for i in np.flatnonzero(roots != main).tolist():
            x = int(rows[i])
            fit = (np.abs(d - d[:, i : i + 1]) <= 0.2 + 1e-9).all(axis=0) & (5 * self.n[rows] >= 4 * self.n[x]) & (4 * self.n[rows] <= 5 * self.n[x])
            fit[i] = False
            some = rows[fit]
            self.against(x, some[self.roots(some) != self.find(x)] if len(some) else some)


    def against_all(self, some: np.ndarray, rows: np.ndarray, d: np.ndarray) -> list[tuple[int, int]]:
        """Links between ``some`` and ``rows`` of other components; ``d`` has the distances of all to the pivots."""
        out = []
        for x in some.tolist():
            fit = (np.abs(d[rows] - d[x]) <= 0.2 + 1e-6).all(axis=1) & (5 * self.n[rows] >= 4 * self.n[x]) & (4 * self.n[rows] <= 5 * self.n[x])
            near = rows[fit]
            near = near[self.roots(near) != self.find(x)] if len(near) else near
            if len(near):
                shared = self.shared(x, near)
                for y in near[9 * shared >= 4 * (self.n[x] + self.n[near])].tolist():
                    a, b = self.find(x), self.find(y)
                    if a != b:
                        self.up[max(a, b)] = min(a, b)
                        out.append((x, y))
        return out


_PARTS = pa.schema([("node", pa.binary()), ("part", pa.binary())])


def _join(table):
    """The first node of each node's connected part of a region."""
    got = sorted(zip(table["node"].to_pylist(), table["items"].to_pylist(), table["label"].to_pylist(), strict=True))
    top = Region([np.frombuffer(x, np.uint64) for _, x, _ in got], [x for _, _, x in got]).join().tolist() if len(got) > 1 else []
    return pa.Table.from_arrays([pa.array([got[i][0] for i in range(len(top))], pa.binary()), pa.array([got[t][0] for t in top], pa.binary())], schema=_PARTS)


_PICKED = pa.schema([("region", pa.binary()), ("cell", pa.int32()), ("pivot", pa.binary()), ("items", pa.binary())])


def _pick(key, table):
    """Pivots of a region, far from each other, of a sample of its sets."""
    got = sorted(zip(table["node"].to_pylist(), table["items"].to_pylist(), strict=True))
    r = Region([np.frombuffer(x, np.uint64) for _, x in got])
    rows, near, chosen, pick = np.arange(len(got)), np.full(len(got), 2.0), [], 0
    while len(chosen) < PIVOTS and near[pick] > 0:
        chosen.append(pick)
        shared = r.shared(pick, rows)
        near = np.minimum(near, 1 - shared / (r.n[pick] + r.n - shared))
        pick = int(np.argmax(near))
    return pa.Table.from_pylist([{"region": key[0].as_py(), "cell": k, "pivot": got[i][0], "items": got[i][1]} for k, i in enumerate(chosen)], schema=_PICKED)


_MEASURED = pa.schema([("region", pa.binary()), ("node", pa.binary()), ("label", pa.binary()), ("n", pa.int32()), ("d", pa.list_(pa.float64())), ("cells", pa.list_(pa.int32())), ("pivots", pa.list_(pa.binary()))])


def _measure(key, left, right):
    """For sets of a region: distances to its pivots, the cells in which they may have links, and the pivots they link with."""
    if not left.num_rows or not right.num_rows:
        return _MEASURED.empty_table()
    pivots = sorted(zip(right["cell"].to_pylist(), right["pivot"].to_pylist(), right["items"].to_pylist(), strict=True))
    r = Region([np.frombuffer(x, np.uint64) for x in [p[2] for p in pivots] + left["items"].to_pylist()])
    p, rows = len(pivots), np.arange(len(pivots), len(pivots) + left.num_rows)
    shared = np.stack([r.shared(k, rows) for k in range(p)], 1)
    total = r.n[rows][:, None] + r.n[:p]
    d = 1 - shared / (total - shared)
    least = d.min(axis=1)[:, None]
    links, cells = 9 * shared >= 4 * total, d - least <= 0.4 + 1e-9
    names = [x[1] for x in pivots]
    out = [left["region"].to_pylist(), left["node"].to_pylist(), left["label"].to_pylist(), r.n[rows].tolist(), d.tolist(), [np.flatnonzero(x).tolist() for x in cells], [[names[k] for k in np.flatnonzero(x)] for x in links]]
    return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, _MEASURED, strict=True)], schema=_MEASURED)


_CLASSES = pa.schema([("region", pa.binary()), ("pivot", pa.binary()), ("label", pa.binary())])


def _classes(key, table):
    """The classes of a region's pivots that some sets link with each other; ``pivots`` has the distinct combinations."""
    of: dict[bytes, set[bytes]] = {}
    for some in table["pivots"].to_pylist():
        whole = set(some).union(*(of[p] for p in some if p in of))
        for p in whole:
            of[p] = whole
    return pa.Table.from_pylist([{"region": key[0].as_py(), "pivot": p, "label": min(x)} for p, x in of.items()], schema=_CLASSES)


def _blocks(key, left, right):
    """Links of loose sets (right) with a block of their region (left)."""
    if not left.num_rows or not right.num_rows:
        return _EDGES.empty_table()
    both = pa.concat_tables([left.select(["node", "items", "label", "d"]), right.select(["node", "items", "label", "d"])])
    node = both["node"].to_pylist()
    r = Region([np.frombuffer(x, np.uint64) for x in both["items"].to_pylist()], both["label"].to_pylist())
    links = r.against_all(np.arange(left.num_rows, len(node)), np.arange(left.num_rows), np.array(both["d"].to_pylist()))
    return pa.Table.from_arrays([pa.array([node[x[i]] for x in links], pa.binary()) for i in (0, 1)], schema=_EDGES)


def _small(table: DataFrame, most: int = BROADCAST) -> DataFrame:
    return F.broadcast(table) if table.count() <= most else table


def _spread(name: str, n, salt: int):
    return F.pmod(F.xxhash64(name, F.lit(salt)), F.greatest(n, F.lit(1)).cast("long"))


def _all(n):
    return F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)).cast("long") - 1))


def split(work: DataFrame, sets: DataFrame, s: Scratch, leaf: int, block: int) -> DataFrame:
    """(node, root) of the sets of large regions: ``work`` has region, node, n, label (the same for sets known to be connected) and the region's ``size`` in shingles and ``rows``; ``sets`` has no others."""
    kind = "node binary, part binary"
    found, k = [], 0
    total = sets.agg(F.sum("n")).first()[0]
    while True:
        k += 1
        wide = work.join(sets.select("node", "items"), "node")
        # About 64 sets of a region by a hash that changes with the round; a region without any is measured in the next one.
        sample = wide.where(F.pmod(F.xxhash64("node", F.lit(k)), F.greatest(F.floor(F.col("rows") / 64), F.lit(1)).cast("long")) == 0)
        pivots = s.save(sample.groupBy("region").applyInArrow(_pick, "region binary, cell int, pivot binary, items binary"), f"pivots{k}")
        sized = pivots.join(_small(work.groupBy("region").agg(F.first("size").alias("size"))), "region")
        asked = sized.withColumn("salt", _all(F.ceil(F.col("size") / block))).drop("size")
        rows = wide.withColumn("salt", _spread("node", F.ceil(F.col("size") / block), 7)).select("region", "salt", "node", "label", "items")
        measured = rows.groupBy("region", "salt").cogroup(asked.groupBy("region", "salt")).applyInArrow(_measure, "region binary, node binary, label binary, n int, d array<double>, cells array<int>, pivots array<binary>")
        measured = s.save(measured, f"measured{k}")
        found.append(s.save(measured.select(F.col("node").alias("u"), F.explode("pivots").alias("v")).where("u <> v"), f"links{k}"))
        # Sets that link with pivots are in the class of these; the others keep the label they had.
        classes = measured.where(F.size("pivots") > 0).select("region", "pivots").distinct().groupBy("region").applyInArrow(_classes, "region binary, pivot binary, label binary")
        classes = s.save(classes, f"classes{k}")
        measured = measured.withColumn("pivot", F.get("pivots", F.lit(0))).withColumnRenamed("label", "before").join(_small(classes), ["region", "pivot"], "left")
        measured = s.save(measured.select("region", "node", "n", "d", "cells", F.coalesce("label", "before").alias("label")), f"labelled{k}")
        # Regions that are one component are done; the others go on in cells, if these shrink, or in blocks.
        of = measured.groupBy("region", "label").agg(F.count("*").alias("rows"), F.sum("n").alias("size"))
        of = of.groupBy("region").agg(F.sum("rows").alias("all"), F.sum("size").alias("size"), F.max_by("label", F.struct("rows", "label")).alias("main"), F.max_by("size", F.struct("rows", "label")).alias("held"), F.count("*").alias("labels")).where("labels > 1")
        cells = measured.select("region", F.explode("cells").alias("cell")).groupBy("region", "cell").count().groupBy("region").agg(F.max("count").alias("most"), F.sum("count").alias("held_in_cells"))
        state = s.save(of.join(cells, "region"), f"state{k}")
        shrinks = (F.col("most") <= 0.7 * F.col("all")) & (F.col("held_in_cells") <= CELLS * F.col("all"))
        stuck = _small(state.where(~shrinks).select("region", F.col("size").alias("of"), "main", (F.col("size") - F.col("held")).alias("loose")))
        mine = measured.join(stuck, "region").withColumn("b", F.ceil(F.col("of") / block)).withColumn("c", F.ceil(F.col("loose") / block)).join(sets.select("node", "items"), "node")
        mine = s.save(mine, f"stuck{k}")
        # Loose blocks go in turns, each of which sends about as many shingles again as there are, or those of one block a region.
        sent, turns = mine.select("region", "of", "c").distinct().agg(F.sum("of"), F.max("c")).first()
        step = max(1, total // sent) if sent else 1
        for turn, at in enumerate(range(0, turns or 0, step)):
            now = F.least(F.col("c"), F.lit(at + step))
            left = mine.where(F.col("c") > at).withColumn("i", _spread("node", F.col("b"), 1)).withColumn("j", F.explode(F.sequence(F.lit(at).cast("long"), now.cast("long") - 1))).select("region", "i", "j", "node", "items", "label", "d")
            right = s.read(f"stuck{k}").where("label <> main").withColumn("j", _spread("node", F.col("c"), 2)).where((F.col("j") >= at) & (F.col("j") < at + step))
            right = right.withColumn("i", _all(F.col("b"))).select("region", "i", "j", "node", "items", "label", "d")
            found.append(s.save(left.groupBy("region", "i", "j").cogroup(right.groupBy("region", "i", "j")).applyInArrow(_blocks, "u binary, v binary"), f"blocks{k}_{turn}"))
        going = _small(state.where(shrinks).select("region"))
        cells = measured.join(going, "region").select("region", "node", "n", "label", F.explode("cells").alias("cell"))
        cells = cells.select(F.unhex(F.md5(F.concat("region", F.encode(F.col("cell").cast("string"), "utf-8")))).alias("region"), "node", "n", "label")
        # A region whose sample was empty stays as it is.
        missed = work.join(_small(pivots.select("region").distinct()), "region", "left_anti").select("region", "node", "n", "label")
        cells = s.save(cells.union(missed), f"cells{k}")
        sizes = cells.groupBy("region").agg(F.sum("n").alias("size"), F.count("*").alias("rows"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").drop("x", "y")
        work = s.save(cells.join(_small(sizes), "region"), f"work{k}")
        ready = work.where(F.col("size") <= leaf).join(sets.select("node", "items"), "node")
        joined = ready.repartition(parts(groups(sets)), "region").groupBy("region").applyInArrow(_join, kind)
        found.append(s.save(joined.select(F.col("node").alias("u"), F.col("part").alias("v")), f"joined{k}"))
        work = work.where(F.col("size") > leaf)
        s.drop(f"pivots{k}", f"stuck{k}", f"classes{k}", f"measured{k}", f"labelled{k}", f"state{k}", f"cells{k}", f"work{k - 1}")
        if work.isEmpty():
            return components(_union(found), s, "split")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def linked(docs: DataFrame, s: Scratch, broadcast_rows: int = BROADCAST, leaf: int = LEAF, block: int = BLOCK_OF, width: int = WIDTH) -> DataFrame:
    """One row for each row of ``docs``: doc_id, node (the digest of its set, null if empty), n, part (the same for all linked ones)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = groups(docs)
    sent = src.mapInArrow(_send(buckets), "bucket int, keys binary, nodes binary, times binary, own binary")
    pieces = max(1, buckets // 4)
    counts = s.save(sent.repartition(parts(buckets), "bucket").groupBy("bucket").applyInArrow(_count(pieces), "piece int, nodes binary, counts binary, own binary"), "counts")
    rows = s.save(counts.where("piece < 0").select("own").mapInArrow(_own, "doc_id long, node binary, n int, half int, shared int"), "rows")
    others = counts.where("piece >= 0").repartition(parts(pieces), "piece").select("nodes", "counts").mapInArrow(_sum, "short binary, others long")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("half").alias("half"), F.max("shared").alias("shared"))
    nodes = nodes.withColumn("short", F.substring("node", 1, SHORT)).join(others, "short", "left").withColumn("shared", F.col("shared") + F.coalesce("others", F.lit(0))).drop("short", "others")
    nodes = s.save(nodes, "nodes")
    s.drop("counts")
    may = nodes.where("5 * (half - shared) <= n")
    wanted, nameless = may.where("doc_id is not null").select("doc_id", "node"), may.where("doc_id is null").select("node")
    few = may.count() <= broadcast_rows
    texts = src.join(F.broadcast(wanted) if few else wanted, "doc_id").select("text", "node")
    # Nodes without any doc_id have their texts found by digest.
    lost = src.where("doc_id is null").select("text").mapInArrow(_sets, "node binary, n int, items binary")
    lost = lost.join(F.broadcast(nameless) if few else nameless, "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("items").alias("items"))
    # Tasks that have equal rows may give a set more than once.
    sets = s.save(texts.mapInArrow(_sets, "node binary, n int, items binary").union(lost), "sets")
    buckets = groups(sets)
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    homed = sets.withColumn("shard", F.pmod(F.xxhash64("node"), F.lit(buckets)).cast("int"))
    asked = homed.select("shard", "items").mapInArrow(_ask(buckets, kind, width), "bucket int, keys binary, homes binary, counts binary")
    told = s.save(asked.repartition(parts(buckets), "bucket").groupBy("bucket").applyInArrow(_tell(kind), "shard int, bucket int, keys binary, counts binary"), "told")
    sent = homed.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_prefixes(buckets), "bucket int, keys binary, n binary, nodes binary, edges binary")
    edges = s.save(sent.repartition(parts(buckets), "bucket").groupBy("bucket").applyInArrow(_edges, "u binary, v binary"), "edges")
    s.drop("told")
    regions = components(edges, s)
    regions = regions.union(regions.select(F.col("root").alias("node"), "root").distinct()).withColumnRenamed("root", "region")
    regions = regions.join(nodes.select("node", "n"), "node")
    sizes = regions.groupBy("region").agg(F.sum("n").alias("size"), F.count("*").alias("rows"))
    regions = s.save(regions.join(sizes, "region"), "regions")
    ready = regions.where(F.col("size") <= leaf).select("node", "region", F.col("node").alias("label")).join(sets.select("node", "items"), "node")
    joined = ready.repartition(parts(buckets), "region").groupBy("region").applyInArrow(_join, "node binary, part binary")
    large = regions.where(F.col("size") > leaf).withColumn("label", F.col("node"))
    if not large.isEmpty():
        own = sets.join(_small(large.select("node")), "node", "left_semi").groupBy("node").agg(F.first("n").alias("n"), F.first("items").alias("items"))
        roots = split(large, s.save(own, "large"), s, leaf, block)
        s.drop("large")
        joined = joined.union(roots.select("node", F.col("root").alias("part"))).union(roots.select(F.col("root").alias("node"), F.col("root").alias("part")).distinct())
    joined = s.save(joined.groupBy("node").agg(F.min("part").alias("part")), "joined")
    named = rows.where("node is not null").join(joined, "node", "left").select("doc_id", "node", "n", F.coalesce("part", "node").alias("part"))
    return s.save(named.union(rows.where("node is null").select("doc_id", "node", "n", F.lit(None).cast("binary").alias("part"))), "linked")


def jaccard_components(docs: DataFrame, **limits) -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_shingles, component_id."""
    s = Scratch(docs.sparkSession)
    rows = linked(docs, s, **limits)
    full = rows.where("part is not null")
    least = full.groupBy("part").agg(F.min("doc_id").alias("component_id"))
    full = full.join(least, "part").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    none = rows.where("part is null").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return s.done(full.union(none))


def _with_node(schema: pa.Schema):
    def run(batches):
        for batch in batches:
            nodes = [digest(x) if len(x) else None for x in sets_of(batch.column(batch.schema.get_field_index("text")))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip([*batch.columns, pa.array(nodes, pa.binary())], schema, strict=True)], schema=schema)

    return run


def one_of_each(docs: DataFrame, **limits) -> DataFrame:
    """``docs`` with one row of each linked group: that of the smallest doc_id (a null one comes last).

    Rows go one by one: a doc_id that other texts have too keeps those that aren't linked with a kept row.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    s = Scratch(docs.sparkSession)
    rows = linked(docs, s, **limits)
    keep = rows.where("part is not null").groupBy("part").agg(F.count("*").alias("k"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("keep")).where("k > 1")
    gone = rows.join(keep, "part").where(~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("node") == F.col("keep.node")))).select("doc_id", "node").distinct()
    gone = s.save(gone, "gone")
    many = s.save(rows.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").select("doc_id"), "many")
    # A doc_id of one row goes by its number; rows that share one, or have none, go by their own sets.
    plain = docs.where("doc_id is not null").join(_small(gone.select("doc_id").where("doc_id is not null").union(many).distinct()), "doc_id", "left_anti")
    shared = docs.join(_small(many), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    node = fresh(docs.columns, "_node")
    out = type(docs.schema)([*docs.schema.fields]).add(node, "binary")
    shared = shared.mapInArrow(_with_node(to_arrow_schema(out)), out)
    once = shared.where(F.col(node).isNotNull()).dropDuplicates(["doc_id", node])
    d_, n_ = fresh([*docs.columns, node], "_d"), fresh([*docs.columns, node], "_n")
    other = gone.select(F.col("doc_id").alias(d_), F.col("node").alias(n_))
    once = once.join(_small(other), F.col("doc_id").eqNullSafe(F.col(d_)) & (F.col(node) == F.col(n_)), "left_anti")
    rest = once.unionByName(shared.where(F.col(node).isNull())).drop(node)
    out = s.save(plain.unionByName(rest).select(*[F.col(f"`{c}`") for c in docs.columns]), "kept")
    s.drop(*[n for n in s.paths if n != "kept"])
    s.keep("kept")
    return out


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
p AS (SELECT doc_id, len(words) AS n, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM w),
g AS (SELECT DISTINCT doc_id, shingle FROM (SELECT doc_id, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o) AS shingle, i, n
  FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE i = 1 OR i <= n - 4),
s AS (SELECT doc_id, shingle, count(*) OVER (PARTITION BY doc_id) AS n FROM g),
link AS (SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.other = e.u)
SELECT r.doc_id, (SELECT count(*) FROM g WHERE g.doc_id = r.doc_id) AS n_shingles, min(other) AS component_id FROM r GROUP BY r.doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
