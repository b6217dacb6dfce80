"""Benchmark decontamination by q-gram lemma filtering.

Texts and items are compared as normalised bytes: ASCII lower case, every run of bytes other than
letters, digits and non-ASCII bytes one space. An item of m bytes is found in a document where some
passage is within k = min(rate * m, what keeps the threshold at 1 or more) edits of the whole item.
By the q-gram lemma such a passage shares t = m - q + 1 - q * k q-grams with the item, all on
diagonals that differ by k at most. So the filter keeps, in this order,

1. stretches of text whose windows hold enough q-grams of any item,
2. (item, diagonal band) pairs with t or more of the text's q-grams on the item's diagonals; bands of
   2 w diagonals start every w > k diagonals, so some band holds all diagonals of any match. A q-gram
   that an item repeats is counted by runs of its places, so repetitive texts cost no product,
3. what alignment confirms: a bit-parallel scan of the text of neighbouring bands finds where the least
   distance d ends, and the alignment there, within d diagonals of it, gives the passage.

Each step only drops what can't match. An item of fewer than ``LEAST`` bytes has too few q-grams for
edits: it is found where the whole item stands between word edges, without edits. The items' index is
broadcast in chunks of ``CHUNK`` bytes of items at most, with one pass over the documents for each.

Defined cases: null or empty texts hold nothing; items that are null or have no letter or digit are no
evidence and are not searched; items with equal text are searched once and reported under the smallest
item_id; repeated rows are reported each; an empty benchmark leaves all documents clean, and no rows
give no rows; of places at the least distance the first that ends counts, and the shortest passage
there; other columns pass unchanged (``leaks`` names its column, and tells if it is taken).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.blocks import Rolling, blocks, mix, ragged
from corvane.llm.scratch import Scratch, fresh

Q, RATE, LEAST, CHUNK = 10, 0.08, 32, 1 << 20

_TABLE = np.full(256, 32, np.uint8)
_TABLE[48:58] = np.arange(48, 58)
_TABLE[97:123] = np.arange(97, 123)
_TABLE[65:91] = np.arange(97, 123)
_TABLE[128:] = np.arange(128, 256)


def normalise(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised bytes, and for each the place it came from."""
    x = _TABLE[data]
    gap = x == 32
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    at = np.flatnonzero(keep)
    return x[at], at


def _runs(places: np.ndarray, gap: int) -> list[tuple[int, int]]:
    """(first, last) of the runs of sorted places whose neighbours are ``gap`` apart at most."""
    cut = np.flatnonzero(np.diff(places) > gap)
    return list(zip(places[np.append(0, cut + 1)].tolist(), places[np.append(cut, len(places) - 1)].tolist(), strict=True))


class Index:
    """The q-grams of some items: sorted hashes, with the items and the runs of places that have them."""

    def __init__(self, items: list[tuple[int, bytes]], q: int = Q, rate: float = RATE):
        self.q, self.rolling = q, Rolling(23)
        self.short = Words([x for x in items if len(x[1]) < max(LEAST, q)])
        self.ids, self.texts, hashes, where = [], [], [], []
        for item, text in items:
            if len(text) < max(LEAST, q):
                continue
            m = len(text)
            self.ids.append(item)
            self.texts.append(np.frombuffer(text, np.uint8))
            s = np.arange(m - q + 1)
            h = self.rolling.of(self.rolling.prefix(self.texts[-1]), s, s + q)
            order = np.argsort(h, kind="stable")
            names, first = np.unique(h[order], return_index=True)
            w = min(int(rate * m), (m - q) // q) + 1
            for name, places in zip(names, np.split(order, first[1:]), strict=True):
                for lo, hi in _runs(places, w):
                    hashes.append(name)
                    where.append((len(self.ids) - 1, lo, hi))
        self.m = np.array([len(t) for t in self.texts], np.int64)
        self.k = np.minimum((rate * self.m).astype(np.int64), (self.m - q) // q)
        self.t = self.m - q + 1 - q * self.k
        if not self.ids:
            return
        h, w = np.array(hashes, np.uint64), np.array(where, np.int64)
        order = np.argsort(h, kind="stable")
        self.where = w[order]
        self.distinct, self.first, self.count = np.unique(h[order], return_index=True, return_counts=True)
        self.bits = np.zeros(1 << 18, np.uint8)
        low = mix(self.distinct) & np.uint64((1 << 21) - 1)
        np.bitwise_or.at(self.bits, (low >> np.uint64(3)).astype(np.int64), np.uint8(1) << (low & np.uint64(7)).astype(np.uint8))
        #: In a window of ``span`` q-grams any match has ``least`` q-grams of items.
        self.span = int((self.m + self.k).max()) - q + 1
        self.least = int(self.t.min())

    def hits(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in text that start an indexed q-gram, and which."""
        n = len(data) - self.q + 1
        if n <= 0 or not self.ids:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        s = np.arange(n)
        h = self.rolling.of(self.rolling.prefix(data), s, s + self.q)
        low = mix(h) & np.uint64((1 << 21) - 1)
        at = np.flatnonzero(self.bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1)
        h = h[at]
        k = np.minimum(np.searchsorted(self.distinct, h), len(self.distinct) - 1)
        good = self.distinct[k] == h
        return at[good], k[good]

    def bands(self, data: np.ndarray, most: int = 1 << 20) -> list[tuple[int, int, int]]:
        """(item number, start, end) of the text of neighbouring bands with enough of an item's q-grams."""
        at, k = self.hits(data)
        if not len(at) or len(at) < self.least:
            return []
        # Stretches: hits that lie in some window of ``span`` with ``least`` hits.
        j = np.searchsorted(at, at + self.span) - np.arange(len(at))
        dense = np.zeros(len(at) + 1, np.int64)
        starts = np.flatnonzero(j >= self.least)
        if not len(starts):
            return []
        np.add.at(dense, starts, 1)
        np.add.at(dense, starts + j[starts], -1)
        keep = np.cumsum(dense[:-1]) > 0
        at, k = at[keep], k[keep]
        # Diagonals are counted in cells of w; a band is two neighbouring cells.
        wide = len(data) + int(self.m.max()) + 4
        names, counts = [], []
        ends = np.cumsum(self.count[k])
        a = 0
        while a < len(at):  # slices of bounded size
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most // 16, "right")))
            size = self.count[k[a:b]]
            rows, place = ragged(self.first[k[a:b]], size), np.repeat(at[a:b], size)
            item, lo, hi = self.where[rows].T
            w = self.k[item] + 1
            low, high = (place - hi + self.m[item]) // w, (place - lo + self.m[item]) // w
            n = high - low + 1
            cells, count = np.unique(np.repeat(item, n) * wide + ragged(low, n), return_counts=True)
            names.append(cells), counts.append(count)
            a = b
        cells, inverse = np.unique(np.concatenate(names), return_inverse=True)
        count = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
        # A band begins at any cell that has hits, or just before one.
        begin = np.unique(np.concatenate([cells, cells - 1]))
        total = sum(np.where(cells[i := np.minimum(np.searchsorted(cells, begin + d), len(cells) - 1)] == begin + d, count[i], 0) for d in (0, 1))
        out: list[list[int]] = []
        for code in begin[total >= self.t[np.minimum((begin + 1) // wide, len(self.t) - 1)]].tolist():
            i = (code + 1) // wide
            k_, m = int(self.k[i]), int(self.m[i])
            low = (code - i * wide) * (k_ + 1) - m
            start, end = max(0, low - k_), min(len(data), low + 2 * (k_ + 1) + m + k_)
            if out and out[-1][0] == i and start <= out[-1][2]:
                out[-1][2] = max(end, out[-1][2])
            elif end > start:
                out.append([i, start, end])
        return [tuple(x) for x in out]

    def search(self, data: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, end) of the items found in one normalised text, the best place for each."""
        out: dict[int, tuple[int, int, int]] = {}
        for i, start, end in self.bands(data):
            k = out[i][0] - 1 if i in out else int(self.k[i])
            best = align(self.texts[i], data[start:end], k) if k >= 0 else None
            if best:
                out[i] = (best[0], start + best[1], start + best[2])
        return [(self.ids[i], *v) for i, v in sorted(out.items())] + self.short.search(data)


class Words:
    """Short items, found whole between word edges."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.of = {text: item for item, text in items}
        self.lengths = sorted({len(t) for t in self.of})

    def search(self, data: np.ndarray) -> list[tuple[int, int, int, int]]:
        if not self.of or not len(data):
            return []
        raw, out = data.tobytes(), {}
        gap = np.concatenate([[True], data == 32, [True]])
        starts = np.flatnonzero(gap[:-2] & ~gap[1:-1])
        for n in self.lengths:
            at = starts[starts + n <= len(data)]
            for s in at[gap[at + n + 1]].tolist():
                if (item := self.of.get(raw[s : s + n])) is not None and item not in out:
                    out[item] = (item, 0, s, s + n)
        return [out[i] for i in sorted(out)]


def scan(item: bytes, text: bytes, k: int) -> tuple[int, int] | None:
    """(distance, end) where the whole ``item`` first ends with the least distance in ``text``, if that is within k.

    A column of the edit matrix is two integers of a bit for each place of the item, so a character
    costs a few operations on integers.
    """
    m, full = len(item), (1 << len(item)) - 1
    peq = dict.fromkeys(range(256), 0)
    for i, c in enumerate(item):
        peq[c] |= 1 << i
    up, down, score, best, top = full, 0, m, None, 1 << (m - 1)
    for j, c in enumerate(text):
        same = peq[c]
        x = same | down
        d0 = (((x & up) + up) ^ up) | x
        hp, hn = down | ~(d0 | up) & full, up & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp, hn = hp << 1, hn << 1 & full  # a passage may begin anywhere
        up, down = (hn | ~(d0 | hp)) & full, hp & d0 & full
        if score <= k and (best is None or score < best[0]):
            best, k = (score, j + 1), score
            if not score:
                break
    return best


def align(item: np.ndarray, text: np.ndarray, k: int) -> tuple[int, int, int] | None:
    """(distance, start, end) of the passage of ``text`` nearest to the whole ``item``, if within k edits."""
    raw, want = text.tobytes(), item.tobytes()
    if (i := raw.find(want)) >= 0:
        return 0, i, i + len(want)
    found = scan(want, raw, k)
    if not found:
        return None
    d, end = found
    return d, end - banded(item[::-1], text[max(0, end - len(item) - d) : end][::-1], d), end


def banded(item: np.ndarray, text: np.ndarray, d: int) -> int:
    """The least n with ``text[:n]`` within ``d`` edits of ``item``: cells within d diagonals of the first only."""
    m, n, width = len(item), len(text), 2 * d + 1
    far = m + n + 1
    ramp = np.arange(width)
    padded = np.full(n + 2 * width + m, 300, np.int64)
    padded[width : width + n] = text
    row = np.where(ramp >= d, ramp - d, far)  # of no bytes of the item; a cell is at diagonal - d
    for i in range(m):
        step = row + (padded[width + i - d : width + i - d + width] != item[i])
        down = np.append(row[1:] + 1, far)
        new = np.minimum(step, down)
        place = i + 1 + ramp - d
        new = np.where((place < 0) | (place > n), far, np.where(place == 0, i + 1, new))
        row = np.minimum.accumulate(new - ramp) + ramp
    ends = m + np.flatnonzero(row <= d) - d
    return int(ends[(ends >= 0) & (ends <= n)][0])


_HITS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "distance", "start", "end")]))


def _searched(shared, schema: pa.Schema, more: bool):
    """Appends the hits of a chunk's items as last column, or adds them to those there (``more``)."""

    def run(batches):
        index = shared.value
        for batch in batches:
            found = []
            for i, j, data, at in blocks(batch.column(batch.schema.get_field_index("text"))):
                for d in range(j - i):
                    text, origin = normalise(data[at[d] : at[d + 1]])
                    found.append([{"item_id": k, "distance": dist, "start": int(origin[s]) if s < len(origin) else 0, "end": int(origin[e - 1]) + 1 if e else 0} for k, dist, s, e in index.search(text)])
            cols = batch.columns
            if more:
                found = [(a or []) + b for a, b in zip(cols.pop().to_pylist(), found, strict=True)]
            cols.append(pa.array(found, schema.field(len(schema) - 1).type))
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return run


def _chunks(benchmark: DataFrame, most: int):
    """Items in runs of ``most`` bytes or less; a single longer item is a run of its own."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    items = items.groupBy("text").agg(F.min("item_id").alias("item_id")).orderBy("item_id", "text")
    run, size, seen = [], 0, set()
    for r in items.toLocalIterator():
        text = normalise(np.frombuffer(r["text"].encode(), np.uint8))[0].tobytes().strip(b" ")
        if not text or text in seen:
            continue
        if run and size + len(text) > most:
            yield run
            run, size, seen = [], 0, set()
        seen.add(text)
        run.append((r["item_id"], text))
        size += len(text)
    if run:
        yield run


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, q: int = Q, chunk: int = CHUNK, name: str = "_leaks") -> DataFrame:
    """``docs`` with a last column ``name``: for every item found its id, edit distance and byte span in the text."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark: SparkSession = docs.sparkSession
    s = Scratch(spark)
    if fresh(docs.columns, name) != name:
        raise ValueError(f"{name} is a column already")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    out = T.StructType([*docs.schema.fields, T.StructField(name, _HITS)])
    arrow = to_arrow_schema(out)
    done = 0
    for run in _chunks(benchmark, chunk):
        if done:
            docs = s.save(docs, f"pass{done}")
            s.drop(f"pass{done - 1}")
        docs = docs.mapInArrow(_searched(spark.sparkContext.broadcast(Index(run, q, rate)), arrow, done > 0), out)
        done += 1
    if f"pass{done - 1}" in s.paths:
        s.keep(f"pass{done - 1}")
    return docs if done else docs.withColumn(name, F.array().cast(_HITS))


def op2(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: how many items it holds, the smallest of their ids, the least distance, and all ids and byte spans."""
    found = leaks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark)
    return found.select(
        "doc_id",
        (F.size("_leaks") > 0).alias("contaminated"),
        F.size("_leaks").cast("long").alias("n_items"),
        F.array_sort(F.transform("_leaks", lambda x: x["item_id"])).alias("item_ids"),
        F.array_min(F.transform("_leaks", lambda x: x["distance"])).alias("min_distance"),
        F.array_sort(F.transform("_leaks", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["item_id"].alias("item_id")))).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
