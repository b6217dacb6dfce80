"""Sequence packing as a cutting-stock problem, solved by column generation.

A document's ids, with the end id, are cut into full sequences and one remainder. Remainders are the
orders of a cutting-stock problem over their length histogram, which is all the driver gets (at most
``capacity`` numbers). Lengths are grouped in at most ``CLASSES`` classes of equal width, each taken
at its largest length, so a pattern always fits. The linear program over patterns starts from one
pattern for each class; an unbounded knapsack by dynamic programming prices new columns until none
improves. Whole copies of patterns are kept; the few remainders that rounding leaves (less than one
copy of each pattern) are packed first-fit decreasing.

Remainders are ranked within their class: a rank is the count of shorter ones, plus the class's
count in earlier tasks, plus the place in the task. A task's places are in the written table, so a
lost executor changes nothing. Ranks are dealt to the copies of patterns through a table of at most
a few thousand rank intervals, and the places in a sequence are running sums of real lengths.

Defined cases: null and empty texts are the end id alone; every row, repeated or not, is packed; a
document of a multiple of ``capacity`` ids has no remainder; no rows give no pieces; other columns
aren't used. All of a long text is packed.
"""

from __future__ import annotations

import json
import os
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.blocks import Rolling, blocks, mix, ragged
from corvane.llm.scratch import Scratch

CAPACITY, END_ID, CLASSES = 2048, 1, 256

# Byte classes of plain texts: blank, letter, digit, other; 9 marks bytes that plain texts don't have.
BLANK, LETTER, DIGIT, OTHER, FOREIGN = 0, 1, 2, 3, 9


def _byte_classes() -> np.ndarray:
    t = np.full(256, FOREIGN, np.uint8)
    t[0x21:0x7F] = OTHER
    t[[0x20, 9, 10, 11, 12, 13]] = BLANK
    t[0x30:0x3A] = DIGIT
    t[0x41:0x5B] = t[0x61:0x7B] = LETTER
    t[0xC3] = t[0x80:0xC0] = LETTER
    return t


class Ids:
    """Token ids of documents, as the library gives them for a vocabulary of lower-case words.

    Plain texts (ASCII and the letters U+00C0 to U+00FF without the signs among them) are cut in
    words on their bytes, and each new word is encoded once; all others go to the library whole.
    """

    def __init__(self, spec: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.most = Tokenizer.from_str(spec), most
        self.special = [t["content"].encode() for t in json.loads(spec)["added_tokens"]]
        vocab = json.loads(spec)["model"]["vocab"]
        self.last = np.zeros(max(vocab.values()) + 1 + len(self.special), bool)  # tokens that end a word
        self.last[[k for t, k in vocab.items() if t.endswith("</w>")]] = True
        self.classes, self.roll = _byte_classes(), Rolling(31)
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self._clear()

    def _clear(self):
        self.known: dict[int, int] = {}
        self.ids, self.start, self.size, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _learn(self, keys: list[int], words: list[str]) -> None:
        # Words are encoded as one text, and parted after the tokens that end a word.
        flat = np.array(self.model.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        sizes = np.diff(np.flatnonzero(self.last[flat]), prepend=-1)
        got = words
        if len(sizes) != len(words) or sizes.sum() != len(flat):
            got = [e.ids for e in self.model.encode_batch(words, add_special_tokens=False)]
            sizes = np.array([len(g) for g in got], np.int64)
            flat = np.concatenate([np.array(g, np.uint32) for g in got])
        n = len(self.known)
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while n + len(got) > len(self.start):
            self.start, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.start, self.size))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[n : n + len(got)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(got)] = sizes
        self.used += len(flat)
        self.known.update(zip(keys, range(n, n + len(got)), strict=True))

    def of(self, column: pa.Array):
        """An array of ids for each document of a column."""
        for i, j, data, at in blocks(column):
            kind = self.classes[data]
            odd = kind == FOREIGN
            # C3 leads a letter of U+00C0 .. U+00FF except two signs; any other lead byte is foreign.
            high = data >= 0x80
            lead = data == 0xC3
            follows = np.zeros(len(data), bool)
            follows[1:] = lead[:-1]
            odd |= high & ~lead & (~follows | (data == 0x97) | (data == 0xB7))
            strange = np.zeros(j - i, bool)
            if odd.any():
                strange[np.unique(np.searchsorted(at, np.flatnonzero(odd), "right") - 1)] = True
            raw = data.tobytes()
            for s in self.special:
                p = raw.find(s)
                while p >= 0:
                    strange[int(np.searchsorted(at, p, "right")) - 1] = True
                    p = raw.find(s, p + 1)
            flat, bound = self._plain(data, at, kind, follows)
            odd_at = np.flatnonzero(strange).tolist()
            slow = {}
            for a in range(0, len(odd_at), 64):
                some = odd_at[a : a + 64]
                slow.update(zip(some, (np.array(e.ids, np.uint32) for e in self.model.encode_batch([raw[at[d] : at[d + 1]].decode() for d in some], add_special_tokens=False)), strict=True))
            for d in range(j - i):
                yield slow[d] if d in slow else flat[bound[d] : bound[d + 1]]

    def _plain(self, data, at, kind, follows) -> tuple[np.ndarray, np.ndarray]:
        low = self.lower[data]
        low[follows & (data < 0x9F) & (data >= 0x80)] += 0x20
        edge = np.zeros(len(data) + 1, bool)
        edge[at] = True
        before = np.zeros(len(data), np.uint8)
        before[1:] = kind[:-1]
        before[at[:-1][at[:-1] < len(data)]] = BLANK
        begin = (kind != BLANK) & ((kind != before) | (kind == DIGIT))
        # Contractions: an apostrophe that begins a word takes one or two letters along.
        for p in np.flatnonzero(begin & (low == 0x27)).tolist():
            end = int(at[np.searchsorted(at, p, "right")])
            for tail in (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d"):
                q = p + 1 + len(tail)
                if q <= end and low[p + 1 : q].tobytes() == tail:
                    begin[p + 1] = False
                    if q < end and kind[q] == LETTER:
                        begin[q] = True
                    break
        s = np.flatnonzero(begin)
        stop = np.zeros(len(data) + 1, bool)
        stop[:-1] = begin | (kind == BLANK)
        stop |= edge
        stops = np.flatnonzero(stop)
        e = stops[np.searchsorted(stops, s, "right")] if len(s) else s
        h = mix(self.roll.of(self.roll.prefix(low), s, e) + (e - s).astype(np.uint64))
        unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self._clear()
        keys = unique.tolist()
        new = [k for k, x in enumerate(keys) if x not in self.known]
        if new:
            for a in range(0, len(new), 1000):
                some = new[a : a + 1000]
                self._learn([keys[k] for k in some], [low[s[f] : e[f]].tobytes().decode("utf-8", "replace") for f in first[some].tolist()])
        slot = np.array([self.known[x] for x in keys], np.int64)[inverse] if len(keys) else np.zeros(0, np.int64)
        sizes = self.size[slot]
        flat = self.ids[ragged(self.start[slot], sizes)]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return flat, total[np.searchsorted(s, at)]


def _cut(shared, capacity: int, end_id: int, keep: bool):
    def run(batches):
        task, seen, made = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64), None
        end = np.array([end_id], np.uint32)
        for batch in batches:
            made = made or Ids(shared.value)
            out = []
            for doc, ids in zip(batch.column(0).to_pylist(), made.of(batch.column(1)), strict=True):
                ids = np.concatenate([ids, end])
                for a in range(0, len(ids), capacity):
                    piece = ids[a : a + capacity].astype("<u4").tobytes()
                    n = len(piece) // 4
                    out.append((doc, a, n, zlib.crc32(piece), len(ids), task, int(seen[n]), *((piece,) if keep else ())))
                    seen[n] += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "place"] + ["ids"] * keep
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if n == "ids" else pa.int64()) for n, x in zip(names, zip(*out, strict=True), strict=True)], names=names)

    return run


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often the linear program uses them, for orders of given sizes."""
    m = len(sizes)
    start = capacity // sizes
    basis = np.diag(start.astype(float))
    inverse = np.diag(1.0 / start)
    x = demand / start
    for k in range(rounds):
        dual = inverse.sum(axis=0)
        pattern = knapsack(sizes, dual, capacity)
        if pattern @ dual <= 1 + 1e-7:
            break
        u = inverse @ pattern
        ratio = np.where(u > 1e-10, x / np.maximum(u, 1e-10), np.inf)
        r = int(np.argmin(ratio))
        if not np.isfinite(ratio[r]):
            break
        step = ratio[r]
        x = np.maximum(x - step * u, 0)
        x[r] = step
        row = inverse[r] / u[r]
        inverse -= np.outer(u, row)
        inverse[r] = row
        basis[:, r] = pattern
        if k % 500 == 499:  # rounding errors go
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand, 0)
    return basis.astype(np.int64), x


def knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int) -> np.ndarray:
    """The most valuable multiset of sizes within the capacity."""
    good = np.flatnonzero(value > 1e-12)
    order = good[np.argsort(sizes[good], kind="stable")]
    w, v = sizes[order], value[order]
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(w, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c], k = best[c - 1], fits[c]
        if k:
            got = best[c - w[:k]] + v[:k]
            i = int(np.argmax(got))
            if got[i] > best[c]:
                best[c], pick[c] = got[i], i
    out, c = np.zeros(len(sizes)), capacity
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out[order[pick[c]]] += 1
            c -= int(w[pick[c]])
    return out


class Plan:
    """Where each rank of each class goes: intervals of ranks with a first sequence and a number of copies."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES):
        lengths = np.array(sorted(n for n, k in histogram.items() if 0 < n < capacity and k), np.int64)
        counts = np.array([histogram[n] for n in lengths.tolist()], np.int64)
        self.width = -(-capacity // classes)
        self.capacity, self.sequences = capacity, 0
        of = -(-lengths // self.width)
        self.names, index = np.unique(of, return_inverse=True) if len(of) else (of, of)
        #: Rank of the first remainder of each length within its class.
        self.base = np.zeros(capacity + 1, np.int64)
        self.slot = np.zeros(capacity + 1, np.int64)
        demand = np.zeros(len(self.names), np.int64)
        for n, k, c in zip(lengths.tolist(), counts.tolist(), index.tolist(), strict=True):
            self.base[n], self.slot[n] = demand[c], c
            demand[c] += k
        self.cuts: list[list[tuple[int, int, int]]] = [[] for _ in self.names]  # (first rank, first sequence, copies)
        if not len(self.names):
            return
        used, room = np.zeros(len(self.names), np.int64), capacity // self.width
        patterns, times = column_generation(self.names, demand.astype(float), room)
        for p, n in zip(patterns.T, np.floor(times + 1e-6).astype(np.int64).tolist(), strict=True):
            n = min([n, *((demand - used)[p > 0] // p[p > 0]).tolist()])
            if n > 0:
                for c in np.flatnonzero(p).tolist():
                    self.cuts[c].append((int(used[c]), self.sequences, n))
                    used[c] += n * p[c]
                self.sequences += n
        self._rest(demand - used, used, lengths, index)
        #: Each interval ends where the next begins.
        self.first = [np.array([a for a, _, _ in c], np.int64) for c in self.cuts]
        self.to = [np.array([b for _, b, _ in c], np.int64) for c in self.cuts]
        self.copies = [np.array([n for _, _, n in c], np.int64) for c in self.cuts]

    def _rest(self, left: np.ndarray, used: np.ndarray, lengths: np.ndarray, index: np.ndarray) -> None:
        """What rounding left, first-fit decreasing by real lengths (the longest of a class have the last ranks)."""
        room: list[int] = []
        open_ = np.zeros(0, np.int64)
        ends = {c: [] for c in range(len(left))}
        for n, c in zip(lengths.tolist(), index.tolist(), strict=True):
            ends[c].append((int(self.base[n]), n))
        for c in range(len(left) - 1, -1, -1):
            starts, sizes = np.array([a for a, _ in ends[c]]), [n for _, n in ends[c]]
            for rank in range(int(used[c] + left[c]) - 1, int(used[c]) - 1, -1):
                n = sizes[int(np.searchsorted(starts, rank, "right")) - 1]
                fit = np.flatnonzero(open_ >= n)
                if len(fit):
                    k = int(fit[0])
                else:
                    k = len(open_)
                    open_ = np.append(open_, self.capacity)
                open_[k] -= n
                room.append(k)
                self.cuts[c].append((rank, self.sequences + k, 1))
        self.sequences += len(open_)
        for c in self.cuts:
            c.sort()

    def place(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Sequences of pieces, by length and rank among the pieces of that length."""
        out = self.sequences + rank  # full pieces
        part = length < self.capacity
        c, r = self.slot[length], self.base[length] + rank
        for k in np.unique(c[part]).tolist():
            at = np.flatnonzero(part & (c == k))
            i = np.searchsorted(self.first[k], r[at], "right") - 1
            out[at] = self.to[k][i] + (r[at] - self.first[k][i]) % self.copies[k][i]
        return out


def _placed(shared):
    def run(batches):
        for batch in batches:
            t = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            s = shared.value.place(t["length"].to_numpy(zero_copy_only=False), t["rank"].to_numpy(zero_copy_only=False))
            t.pop("rank")
            yield pa.RecordBatch.from_arrays([*t.values(), pa.array(s)], names=[*t, "sequence_id"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids (little-endian) if wanted."""
    spark: SparkSession = docs.sparkSession
    s = Scratch(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(Path(tokenizer).read_text())
    kept = ", ids binary" if keep_ids else ""
    cut = s.save(src.mapInArrow(_cut(shared, capacity, end_id, keep_ids), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, place long" + kept), "cut")
    # Pieces of each length in each task; places of a task follow those of earlier tasks.
    sizes = s.save(cut.groupBy("task", "length").agg(F.count("*").alias("n")), "sizes")
    histogram = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan(histogram, capacity))
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")
    ranked = cut.join(before, ["task", "length"]).withColumn("rank", F.col("before") + F.col("place")).drop("task", "place", "before")
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * keep_ids
    placed = ranked.select(*cols, "rank").mapInArrow(_placed(plan), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + kept + ", sequence_id long")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("offset", F.sum("length").over(order) - F.col("length"))
    return s.done(placed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
