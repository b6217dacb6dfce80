"""Near-duplicate passages by compact windows of min-hash signatures.

A text is its sequence of 5-word shingles. For one hash function, the Cartesian tree over the hashes
groups all subsequences by the place c of their minimum: those that begin in [l, c] and end in [c, r]
("compact window"). For passages of ``LEAST`` shingles the windows of a function cut the places where
a passage can begin into intervals. An interval join of the ``ROWS`` functions of a band gives the
intervals over which the whole signature is the same. Passages of two documents with Jaccard
similarity s share a band's signature with probability s ** ROWS, so one passage is a candidate with
probability 1 - (1 - s ** ROWS) ** BANDS; equal passages always are, whatever text is around them.

1. Tasks send each signature key once for each shard and each distinct interval ("strip": the shingles
   of all its passages). Keys of one document only are dropped; of those whose strips are all equal
   only the doc_ids are needed.
2. Shards (documents by a hash of doc_id) send their distinct strips of each shared signature.
3. For each signature the strips of all shards are verified: two are alike if any passage of one is
   0.8 similar to any of the other. Equal passages connect strips at once; each
   strip is then compared with all that aren't connected with it yet, so chains stay whole.
4. Shards apply the answers. An interval with an alike one in another document is repeated as a whole.
   A document's class is the smallest doc_id it is connected with.

Nothing is capped. Passages are verified by the 16-bit hashes of their shingles, so a pair just below
0.8 may rarely pass; none that is 0.8 or more is lost by that. Strips of one signature are told to be
all equal by 32-bit hashes.

Defined cases: null or empty texts and texts of fewer than ``LEAST`` shingles have no passages; rows
with a null doc_id take no part and are in no class but their own; rows that share a doc_id don't
count as repeats of each other; other columns aren't used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.blocks import Rolling, blocks, mix, pack, ragged, sort_order
from corvane.llm.op1_suffixes import _bucket, _home, _least, dealt, undealt
from corvane.llm.op10_jaccard import _LOWER, _ROLL, _STEP, WORDS, components, words_of
from corvane.llm.scratch import Scratch, groups, parts

LEAST, BANDS, ROWS = 46, 6, 2
MOST = 64  # starts of an interval
SOME = 250_000  # shingles that are verified at once
PAIRED = 32  # strips of a group whose pairs are counted at once
COMMON = 8  # shingles that two strips must have in common among their rarest to be compared
_WINDOW = Rolling(46)
SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def compact_windows(values: list[int], least: int) -> list[tuple[int, int, int]]:
    """(l, c, r) for every node of the Cartesian tree (leftmost minimum) over at least ``least`` values."""
    out, stack, n = [], [], len(values)
    left = [0] * n
    for i in range(n + 1):
        while stack and (i == n or values[stack[-1]] > values[i]):
            c = stack.pop()
            if i - left[c] >= least:
                out.append((left[c], c, i - 1))
        if i < n:
            left[i] = stack[-1] + 1 if stack else 0
            stack.append(i)
    return sorted(out)


def shingles_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of a block (at each word), their documents' first words, and the number of words."""
    s, e, first = words_of(data, at)
    w = mix(_ROLL.of(_ROLL.prefix(_LOWER[data]), s, e) + (e - s).astype(np.uint64)) if len(s) else np.zeros(0, np.uint64)
    n = max(len(w) - WORDS + 1, 0)
    h = w[:n].copy()
    for k in range(1, WORDS):
        h *= _STEP
        h += w[k : n + k]
    return mix(h) if n else h, first, np.diff(first)


def signatures(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first start, last start, document) of each interval of starts with one signature, for all bands."""
    n = len(h) - LEAST + 1
    if n <= 0:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z
    words = np.diff(first)
    doc = np.repeat(np.arange(len(words)), words)[:n]
    good = np.arange(n) + LEAST + WORDS - 1 <= first[doc + 1]
    place, out = np.arange(n), []
    for b in range(BANDS):
        new, lows = np.ones(n, bool), []
        new[1:] = (doc[1:] != doc[:-1]) | (good[1:] != good[:-1])
        for r in range(ROWS):
            # The minimum of a passage is the place whose compact window holds it; the intervals of starts
            # of the functions are joined where any of them changes. A function is the high half of a product.
            lows.append(_least((h * SEEDS[b * ROWS + r] >> np.uint64(32)).astype(np.uint32), LEAST))
            new[1:] |= lows[-1][1:] != lows[-1][:-1]
        # A shingle that recurs can be the minimum for longer than a passage; such intervals are cut, none is dropped.
        new |= (place - np.maximum.accumulate(np.where(new, place, 0))) % MOST == 0
        a = np.flatnonzero(new)
        z = np.append(a[1:], n) - 1
        keep = good[a]
        a, z, key = a[keep], z[keep], np.uint64(b)
        for low in lows:
            key = mix(key + low[a])
        out.append((key, a, z, doc[a]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_SENT = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("refs", pa.binary()), ("bodies", pa.binary())])
_SEVERAL, _DIFFER = np.uint32(1 << 31), np.uint64(1 << 63)


def _short(key: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(key, buckets) << np.uint64(32) | key & np.uint64(0xFFFFFFFF)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where the rows of sorted columns differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


def strip_hash(h: np.ndarray, a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """64-bit hashes of the shingles a .. z + LEAST - 1 that the passages of an interval have."""
    _WINDOW.grow(len(h) + 1)
    prefix = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _WINDOW.powers[: len(h)], out=prefix[1:])
    return mix(_WINDOW.of(prefix, a, z + LEAST) + (z - a).astype(np.uint64))


def _send(buckets: int, shards: int):
    def run(batches):
        keys, bodies, docs, homes, size = [], [], [], [], 0

        def flush():
            key, body, doc, home = np.concatenate(keys), np.concatenate(bodies), np.concatenate(docs), np.array(homes)
            key, home = _short(key, buckets), home[doc].astype(np.uint32)
            order = sort_order(key, body, home, doc)
            key, body, doc, home = key[order], body[order], doc[order], home[order]
            start = np.flatnonzero(_changes(key))
            end = np.append(start[1:], len(key))
            several = np.repeat(np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start), end - start)
            once = _changes(key, body, home)
            key, body, ref = key[once], body[once], home[once] | several[once] * _SEVERAL
            names, first = np.unique(key >> np.uint64(32), return_index=True)
            ends = np.append(first[1:], len(key))
            rows = [{"bucket": k, "keys": pack(key[a:z].astype(np.uint32)), "refs": pack(ref[a:z]), "bodies": pack(body[a:z])} for k, a, z in zip(names.tolist(), first.tolist(), ends.tolist(), strict=True)]
            keys.clear(), bodies.clear(), docs.clear(), homes.clear()
            for a in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[a : a + 256], schema=_SENT)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, at in blocks(batch.column(1)):
                h, first, _ = shingles_of(data, at)
                key, a, z, doc = signatures(h, first)
                keys.append(key), bodies.append(strip_hash(h, a, z).astype(np.uint32)), docs.append(doc + len(homes))
                homes += _home(ids[i:j], shards).tolist()
                size += len(key)
                if size > 1_000_000:
                    yield from flush()
                    size = 0
        if keys and sum(map(len, keys)):
            yield from flush()

    return run


_TOLD = pa.schema([("shard", pa.int32()), ("keys", pa.binary())])


def _tell(bucket, table):
    """The keys of several documents, for each shard that has them; marked where not all their intervals are equal."""
    key = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint32).astype(np.uint64) | np.uint64(bucket[0].as_py() << 32)
    ref, body = (np.frombuffer(b"".join(table[c].to_pylist()), np.uint32) for c in ("refs", "bodies"))
    order = sort_order(key)
    key, ref, body = key[order], ref[order], body[order]
    start = np.flatnonzero(_changes(key))
    n = np.diff(np.append(start, len(key)))
    shared = np.repeat((n > 1) | (np.maximum.reduceat(ref, start) >= _SEVERAL), n)
    differ = np.repeat(np.minimum.reduceat(body, start) != np.maximum.reduceat(body, start), n)
    key, ref = (key | differ * _DIFFER)[shared], (ref & ~_SEVERAL)[shared]
    order = sort_order(ref, key)
    key, ref = key[order], ref[order]
    once = _changes(key, ref)
    key, ref = key[once], ref[once]
    start = np.flatnonzero(_changes(ref))
    return pa.Table.from_pylist([{"shard": int(ref[a]), "keys": pack(k)} for a, k in zip(start, np.split(key, start[1:]), strict=True)] if len(ref) else [], schema=_TOLD)


class Shard:
    """The shared intervals of a shard's documents and the distinct ones ("strips") among those of a signature."""

    def __init__(self, table: pa.Table, told: list[bytes], buckets: int):
        shared = np.frombuffer(b"".join(told), np.uint64)
        shared = shared[sort_order(shared & ~_DIFFER)]
        differ, shared = shared >= _DIFFER, shared & ~_DIFFER
        self.doc = table["doc_id"].to_pylist()
        known = np.array([d is not None for d in self.doc], bool)
        ids = np.array([d or 0 for d in self.doc], np.int64)
        self.words = np.zeros(len(ids), np.int64)
        rows, items, base = [], [], 0
        if table.num_rows:
            for i, j, data, at in blocks(table["text"].combine_chunks()):
                h, first, self.words[i:j] = shingles_of(data, at)
                key, a, z, doc = signatures(h, first)
                short = _short(key, buckets)
                k = np.minimum(np.searchsorted(shared, short), max(len(shared) - 1, 0))
                keep = np.flatnonzero((shared[k] == short) & known[i + doc]) if len(shared) else np.zeros(0, np.int64)
                short, a, z, doc, k = short[keep], a[keep], z[keep], doc[keep], k[keep]
                rows.append((short, strip_hash(h, a, z), i + doc, a - first[doc], z - first[doc], a + base, differ[k]))
                items.append(h.astype(np.uint16))
                base += len(h)
        none = np.zeros(0, np.int64)
        key, body, row, a, z, at, differ = (np.concatenate(x) for x in zip(*rows, strict=True)) if rows else (none.astype(np.uint64), none.astype(np.uint64), none, none, none, none, none > 0)
        order = sort_order(key, body, ids[row] - ids.min(initial=0))
        self.key, self.row, self.first, self.last = key[order], row[order], a[order], z[order]
        self.ids = ids[self.row]
        new = _changes(self.key, body[order])
        self.strip = np.cumsum(new) - 1
        self.sent = np.flatnonzero(new)  # the interval of the smallest doc_id
        end = np.append(self.sent[1:], len(order))
        self.several = self.ids[self.sent] != self.ids[end - 1]
        # Where all intervals of a signature are equal their shingles aren't needed.
        self.size = np.where(differ[order], self.last - self.first + LEAST, 0)[self.sent]
        self.at, self.all = at[order][self.sent], items
        self.bucket = (self.key[self.sent] >> np.uint64(32)).astype(np.int64)

    def items(self) -> np.ndarray:
        return np.concatenate(self.all)[ragged(self.at, self.size)] if self.all else np.zeros(0, np.uint16)


_PASSAGES = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("keys", pa.binary()), ("docs", pa.binary()), ("several", pa.binary()), ("sizes", pa.binary()), ("items", pa.binary())])


def _outgoing(buckets: int):
    def run(key, left, right):
        s = Shard(undealt(left), right["keys"].to_pylist(), buckets)
        items, cut = s.items(), np.concatenate([[0], np.cumsum(s.size)])
        rows = []
        for b in np.unique(s.bucket).tolist():
            a, z = np.searchsorted(s.bucket, [b, b + 1])
            at = s.sent[a:z]
            rows.append({"bucket": b, "shard": int(key[0].as_py()), "keys": pack(s.key[at].astype(np.uint32)), "docs": pack(s.ids[at]), "several": pack(s.several[a:z].astype(np.uint8)), "sizes": pack(s.size[a:z].astype(np.uint8)), "items": pack(items[cut[a] : cut[z]])})
        return pa.Table.from_pylist(rows, schema=_PASSAGES)

    return run


def roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each node's connected part."""
    root = np.arange(n)
    while True:
        a, b = root[u], root[v]
        if (a == b).all():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != root[root]).any():
            root = root[root]


def passages_of(before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each passage of a strip: the places of its distinct shingles, and their number. ``before`` has the last place of the same shingle."""
    p, w = np.arange(len(before)), np.arange(len(before) - LEAST + 1)[:, None]
    f = ((p >= w) & (p < w + LEAST) & (before < w)).astype(np.float32)
    return f, f.sum(axis=1)


class Strips:
    """The strips of signatures (sorted by group, then document), and which of them are alike.

    Two strips are alike if any passage of one and any of the other have Jaccard similarity 0.8 or more.
    """

    def __init__(self, group: np.ndarray, doc: np.ndarray, several: np.ndarray, size: np.ndarray, items: np.ndarray):
        self.group, self.doc, self.several, self.size, self.items = group, doc, several, size, items
        self.start = np.cumsum(size) - size
        self.repeated = several.copy()
        self.u, self.v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def runs(self, key: np.ndarray, strip: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, starts of runs of equal keys, whether several documents have the run's key)."""
        order = sort_order(key)
        start = np.flatnonzero(_changes(key[order]))
        if not len(order):
            return order, start, np.zeros(0, bool)
        s = strip[order]
        return order, start, (np.minimum.reduceat(self.doc[s], start) != np.maximum.reduceat(self.doc[s], start)) | np.maximum.reduceat(self.several[s], start)

    def link(self, key: np.ndarray, strip: np.ndarray) -> None:
        """Connects the strips of each key that several documents have."""
        order, start, many = self.runs(key, strip)
        n = np.diff(np.append(start, len(order)))
        here, lead = order[np.repeat(many, n)], np.repeat(order[start[many]], n[many])
        self.repeated[strip[here]] = True
        self.u.append(strip[here]), self.v.append(strip[lead])

    def join(self) -> tuple[np.ndarray, np.ndarray]:
        """The first strip of each strip's class, and whether another document has a passage like one of it."""
        n = len(self.group)
        whole = np.flatnonzero(self.size == 0)
        self.link(self.group[whole], whole)
        strip = np.repeat(np.arange(n), np.maximum(self.size - LEAST + 1, 0))
        at = ragged(self.start, np.maximum(self.size - LEAST + 1, 0))
        h = strip_hash(mix(self.items.astype(np.uint64) + np.uint64(1)), at, at)
        self.link(mix(h ^ mix(self.group[strip].astype(np.uint64))), strip)
        root = roots(n, np.concatenate(self.u), np.concatenate(self.v))
        start = np.flatnonzero(_changes(self.group))
        if n:
            mixed = np.minimum.reduceat(root, start) != np.maximum.reduceat(root, start)
            left = np.flatnonzero(np.repeat(mixed, np.diff(np.append(start, n))))
            self.near(left[self.size[left] > 0], root)
        return roots(n, np.concatenate(self.u), np.concatenate(self.v)), self.repeated

    def near(self, left: np.ndarray, root: np.ndarray) -> None:
        """Connects the alike ones among ``left``, which equal passages don't connect."""
        if not len(left):
            return
        size = self.size[left]
        at = ragged(self.start[left], size)
        strip = np.repeat(np.arange(len(left)), size)
        items, pos = self.items[at].astype(np.uint64), ragged(np.zeros(len(left), np.int64), size)
        # Shingles of one document only are in no intersection; a passage with too many of them is like no other.
        order, start, many = self.runs(self.group[left][strip].astype(np.uint64) << np.uint64(16) | items, left[strip])
        own = np.empty(len(items), np.int64)
        own[order] = np.repeat(~many, np.diff(np.append(start, len(order))))
        order = sort_order(strip, items)
        again = np.flatnonzero((strip[order][1:] == strip[order][:-1]) & (items[order][1:] == items[order][:-1]))
        before = np.full(len(items), -1)
        before[order[again + 1]] = pos[order[again]]
        first = np.cumsum(size) - size
        # A shingle repeats another of a passage if the passage begins no later than the one before.
        twice = np.zeros(len(items) + 1, np.int64)
        close = np.flatnonzero((before >= 0) & (pos - before < LEAST))
        base = first[strip[close]]
        np.add.at(twice, base + np.maximum(pos[close] - LEAST + 1, 0), 1)
        np.add.at(twice, base + before[close] + 1, -1)
        count = size - LEAST + 1
        window, of = ragged(first, count), np.repeat(np.arange(len(left)), count)
        sets = LEAST - np.cumsum(twice)[window]
        own = np.concatenate([[0], np.cumsum(own)])
        shared = LEAST - (own[window + LEAST] - own[window])
        begin = np.flatnonzero(_changes(of))
        fewest = np.minimum.reduceat(sets, begin)
        groups = np.flatnonzero(_changes(self.group[left]))
        ends = np.append(groups[1:], len(left))
        least = np.repeat(np.minimum.reduceat(fewest, groups), ends - groups)
        may = np.maximum.reduceat(9 * shared >= 4 * (sets + least[of]), begin)
        most = np.repeat(ends - groups, ends - groups)
        single = np.maximum.reduceat(before, first) < 0  # strips without a shingle that recurs
        held = self.held(left, strip, items, pos)
        x, y, up = [], [], root
        for reach in (2, PAIRED):  # neighbours first, which connects most; then what is not connected yet
            i, j, doubt = self.aligned(left, fewest, most, up, sets, begin, single, reach, *held)
            x, y = np.append(x, i).astype(np.int64), np.append(y, j).astype(np.int64)
            up = roots(len(root), np.concatenate([left[i], np.arange(len(root))]), np.concatenate([left[j], up]))
            mixed = np.repeat(np.minimum.reduceat(up[left], groups) != np.maximum.reduceat(up[left], groups), ends - groups)
            held = tuple(c[mixed[held[1]]] for c in held)
        may &= most > PAIRED
        known: dict[int, tuple] = {}
        again = []

        def of(i):
            if i not in known:
                known[i] = passages_of(before[first[i] : first[i] + size[i]])
            return known[i]

        for i, j in zip(*doubt, strict=True):
            # Strips that pairs before have connected needn't be compared.
            if up[left[i]] != up[left[j]]:
                (f, n), (g, m) = of(i), of(j)
                both = f @ (items[first[i] : first[i] + size[i]][:, None] == items[first[j] : first[j] + size[j]]).astype(np.float32) @ g.T
                if (9 * both >= 4 * (n[:, None] + m)).any():
                    again.append((i, j))
                    up[up == max(up[left[i]], up[left[j]])] = min(up[left[i]], up[left[j]])
        if again:
            x, y = np.append(x, [i for i, _ in again]), np.append(y, [j for _, j in again])
        self.repeated[left[x]] = self.repeated[left[y]] = True
        self.u.append(left[x]), self.v.append(left[y])
        for a, z in zip(groups.tolist(), ends.tolist(), strict=True):
            some = a + np.flatnonzero(may[a:z])
            if len(some) > 1 and (up[left[some]] != up[left[some[0]]]).any():
                self.group_near(left[some], up[left[some]], fewest[some], [items[first[k] : first[k] + size[k]] for k in some.tolist()], [before[first[k] : first[k] + size[k]] for k in some.tolist()])

    def held(self, left: np.ndarray, strip: np.ndarray, items: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, strip, place) of each shingle of each strip, once, where a run is a shingle of a group."""
        group = np.cumsum(_changes(self.group[left]))[strip]
        order = sort_order(group, items, strip)
        group, items, strip, pos = group[order], items[order], strip[order], pos[order]
        run = np.cumsum(_changes(group, items))
        once = _changes(run, strip)
        return run[once], strip[once], pos[once]

    def aligned(self, left, fewest, count, root, sets, window, single, reach, run, strip, pos) -> tuple[np.ndarray, np.ndarray, tuple[list, list]]:
        """(pairs of strips that are alike, pairs that may be), of strips that aren't connected yet.

        Pairs with too few shingles in common are like no other. Of the rest those are found alike that have
        enough at one distance of their places. Groups of more than ``PAIRED`` strips are left for ``group_near``.
        A strip is paired with the ``reach`` next ones that have a shingle. ``window`` has the first passage of
        each strip, whose set sizes are ``sets``.
        """
        doc, several, size = self.doc[left], self.several[left], self.size[left]
        some = count[strip] <= PAIRED
        run, strip, pos = run[some], strip[some], pos[some]
        i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for d in range(1, reach + 1):
            k = np.flatnonzero(run[d:] == run[:-d]) if len(run) > d else i[0]
            if not len(k):
                break
            x, y = strip[k], strip[k + d]
            k = k[(root[left[x]] != root[left[y]]) & ((doc[x] != doc[y]) | several[x] | several[y])]
            i.append(k), j.append(k + d)
        i, j = np.concatenate(i), np.concatenate(j)
        if not len(i):
            return i, j, ([], [])
        a, b, shift = strip[i], strip[j], pos[j] - pos[i]
        order = sort_order(a, b, shift + 256, pos[i])
        a, b, shift, place = a[order], b[order], shift[order], pos[i][order]
        new = _changes(a, b)
        start = np.flatnonzero(new)
        shared = np.diff(np.append(start, len(a)))
        good = 9 * shared >= 4 * (fewest[a[start]] + fewest[b[start]])
        # Only a passage with enough shingles of the whole other strip can be like one of it.
        pair = np.cumsum(new) - 1
        for at in (place, place + shift):
            o = sort_order(pair, at)
            code = pair[o] << 9 | at[o]
            inside = np.searchsorted(code, code + LEAST) - np.arange(len(code))
            enough = 9 * np.maximum.reduceat(inside, start) >= 4 * (fewest[a[start]] + fewest[b[start]])
            good &= enough | ~single[a[start]] | ~single[b[start]]
        # The most common distance of each such pair, and the passages that begin at a shared shingle.
        rows = np.flatnonzero(_changes(a, b, shift))
        times = np.diff(np.append(rows, len(a)))
        top = np.maximum.reduceat(times << 32 | np.arange(len(rows)), np.searchsorted(rows, start)) & 0xFFFFFFFF
        first_a, first_b = a[start], b[start]
        top = top[good]
        e = ragged(rows[top], times[top])
        a, b, shift, place, pair = a[e], b[e], shift[e], place[e], pair[e]
        w = np.maximum(np.minimum(place, np.minimum(size[a], size[b] - shift) - LEAST), np.maximum(0, -shift))
        fits = (w <= size[a] - LEAST) & (w + shift <= size[b] - LEAST)
        a, b, shift, w, at = a[fits], b[fits], shift[fits], w[fits], pair[fits] << 9
        code = pair << 9 | place
        both = np.searchsorted(code, at + w + LEAST) - np.searchsorted(code, at + w)
        hit = pair[fits][9 * both >= 4 * (sets[window[a] + w] + sets[window[b] + w + shift])]
        alike = np.zeros(len(start), bool)
        alike[hit] = True
        x, y = first_a[alike], first_b[alike]
        doubt = np.flatnonzero(good & ~alike)
        return x, y, (first_a[doubt].tolist(), first_b[doubt].tolist())

    def group_near(self, strip: np.ndarray, root: np.ndarray, fewest: np.ndarray, items: list[np.ndarray], before: list[np.ndarray]) -> None:
        """Every strip is compared with all that may be like it and aren't connected with it yet, until no more are alike."""
        k, doc, several = len(strip), self.doc[strip], self.several[strip]
        width = max(map(len, items))
        padded = np.full((k, width), 65536, np.int32)
        for i, x in enumerate(items):
            padded[i, : len(x)] = x
        parts_: dict[int, list] = {}
        mark, new = np.zeros(65537, bool), np.ones(k, bool)
        # Alike strips have ``need`` shingles in common, so ``common`` of them are among the rarest of both, but for the last need - common.
        row, val = np.repeat(np.arange(k), [len(x) for x in items]), np.concatenate(items).astype(np.int64)
        order = sort_order(row, val)
        order = order[_changes(row[order], val[order])]
        row, val = row[order], val[order]
        size = np.bincount(row, minlength=k)
        need = -(-4 * (fewest + fewest.min()) // 9)
        common = max(1, min(COMMON, int(need.min())))
        order = sort_order(row, np.bincount(val)[val], val)
        order = order[np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size) < (size - need + common)[row]]
        row, val = row[order].astype(np.int32), np.unique(val[order], return_inverse=True)[1]
        own = np.split(val, np.flatnonzero(np.diff(row)) + 1)
        order = sort_order(val)
        posts = np.split(row[order], np.flatnonzero(np.diff(val[order])) + 1)
        order = sort_order(root)
        class_of = np.cumsum(_changes(root[order])) - 1
        members = np.split(order, np.flatnonzero(np.diff(class_of)) + 1)
        class_of = class_of[np.argsort(order)]

        def may_be_like(x):
            y = np.concatenate([posts[i] for i in own[x].tolist()])
            live = new[y]
            if 2 * np.count_nonzero(live) < len(y):  # connected ones are taken off the lists, each once
                for i in own[x].tolist():
                    posts[i] = posts[i][new[posts[i]]]
            y, n = np.unique(y[live], return_counts=True)
            y = y[n >= common]
            return y[(doc[y] != doc[x]) | several[y] | several[x]]

        def of(i):
            if i not in parts_:
                parts_[i] = passages_of(before[i])
            return parts_[i]

        for seed in range(k):
            if not new[seed]:
                continue
            queue = members[class_of[seed]].tolist()
            new[queue] = False
            while queue:
                x = queue.pop()
                rest = may_be_like(x)
                if not len(rest):
                    continue
                # Only a passage with enough shingles of the whole other strip can be like one of it.
                mark[items[x]] = True
                held = np.cumsum(mark[padded[rest]], axis=1, dtype=np.int16)
                mark[items[x]] = False
                most = held[:, LEAST - 1].copy()
                if width > LEAST:
                    np.maximum(most, (held[:, LEAST:] - held[:, :-LEAST]).max(axis=1), out=most)
                rest = rest[9 * most.astype(np.int64) >= 4 * (fewest[x] + fewest[rest])]
                f, n = of(x) if len(rest) else (None, None)
                for y in rest.tolist():
                    if not new[y]:
                        continue
                    g, m = of(y)
                    both = f @ (items[x][:, None] == items[y]).astype(np.float32) @ g.T
                    if (9 * both >= 4 * (n[:, None] + m)).any():
                        self.repeated[strip[[x, y]]] = True
                        self.u.append(strip[[x]]), self.v.append(strip[[y]])
                        more = members[class_of[y]]
                        new[more] = False
                        queue += more.tolist()


_FOUND = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("leads", pa.binary()), ("more", pa.binary())])


def _verify(bucket, table):
    """The smallest doc_id that each strip sent is connected with, and whether another document has a passage like one of it."""
    got = table.to_pylist()
    key = np.concatenate([np.frombuffer(r["keys"], np.uint32).astype(np.uint64) | np.uint64(r["bucket"] << 32) for r in got])
    doc = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in got])
    several = np.concatenate([np.frombuffer(r["several"], np.uint8) for r in got]) > 0
    size = np.concatenate([np.frombuffer(r["sizes"], np.uint8) for r in got]).astype(np.int64)
    items = np.concatenate([np.frombuffer(r["items"], np.uint16) for r in got])
    order = sort_order(key, doc - doc.min())
    new = _changes(key[order])
    group, begin, at = np.cumsum(new), np.append(np.flatnonzero(new), len(key)), np.cumsum(size) - size
    ends = np.concatenate([[0], np.cumsum(size[order])])[begin]
    lead, more = np.empty(len(key), np.int64), np.empty(len(key), np.uint8)
    i = 0
    while i < len(begin) - 1:  # whole groups of about SOME shingles
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SOME, "right")) - 1)
        some = order[begin[i] : begin[j]]
        row, repeated = Strips(group[begin[i] : begin[j]], doc[some], several[some], size[some], items[ragged(at[some], size[some])]).join()
        lead[some], more[some] = doc[some][row], repeated
        i = j
    cut = np.cumsum([0] + [len(r["keys"]) // 4 for r in got])
    return pa.Table.from_pylist([{"shard": r["shard"], "bucket": r["bucket"], "leads": pack(lead[a:z]), "more": pack(more[a:z])} for r, a, z in zip(got, cut[:-1], cut[1:], strict=True)], schema=_FOUND)


_OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_passages", pa.int64()), ("n_repeated_words", pa.int64()), ("spans", pa.string()), ("leads", pa.list_(pa.int64()))])


def _apply(buckets: int):
    def run(left, right):
        got = right.to_pylist()
        s = Shard(undealt(left), [r["keys"] for r in got if r["keys"] is not None], buckets)
        lead, more = s.ids[s.sent].copy(), s.several.copy()
        for r in got:
            if r["leads"] is not None:
                a, z = np.searchsorted(s.bucket, [r["bucket"], r["bucket"] + 1])
                lead[a:z], more[a:z] = np.frombuffer(r["leads"], np.int64), np.frombuffer(r["more"], np.uint8) > 0
        to, hit = lead[s.strip], more[s.strip]
        rows = []
        order = np.flatnonzero(hit)
        order = order[np.argsort(s.row[order], kind="stable")]
        cut = np.searchsorted(s.row[order], np.arange(len(s.doc) + 1))
        for d, name in enumerate(s.doc):
            at = order[cut[d] : cut[d + 1]]
            spans: list[list[int]] = []
            for a, z in sorted(zip(s.first[at].tolist(), (s.last[at] + LEAST + WORDS - 1).tolist(), strict=True)):
                if spans and a <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], z)
                else:
                    spans.append([a, z])
            rows.append((name, int(s.words[d]), len(spans), sum(z - a for a, z in spans), ",".join(f"{a}:{z}" for a, z in spans), np.unique(to[at]).tolist()))
        return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_OUT), _OUT, strict=True)], schema=_OUT)

    return run


def passages(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs``: its near-duplicate passages (word spans) and its class."""
    spark: SparkSession = docs.sparkSession
    s = Scratch(spark)
    buckets = shards = groups(docs, 4.0)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = src.where("doc_id is not null").mapInArrow(_send(buckets, shards), "bucket int, keys binary, refs binary, bodies binary")
    told = s.save(sent.repartition(parts(buckets), "bucket").groupBy("bucket").applyInArrow(_tell, "shard int, keys binary"), "told")
    del sent
    s.free()
    texts = dealt(src, shards)
    out = texts.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_outgoing(buckets), "bucket int, shard int, keys binary, docs binary, several binary, sizes binary, items binary")
    answers = s.save(out.repartition(parts(buckets), "bucket").groupBy("bucket").applyInArrow(_verify, "shard int, bucket int, leads binary, more binary"), "answers")
    del out
    s.free()
    none = F.lit(None).cast("binary")
    both = told.select("shard", F.lit(None).cast("int").alias("bucket"), "keys", none.alias("leads"), none.alias("more")).union(answers.select("shard", "bucket", none.alias("keys"), "leads", "more"))
    rows = s.save(texts.groupBy("shard").cogroup(both.groupBy("shard")).applyInArrow(_apply(buckets), "doc_id long, n_words long, n_passages long, n_repeated_words long, spans string, leads array<long>"), "rows")
    links = rows.select("doc_id", F.explode("leads").alias("lead")).where("doc_id <> lead")
    roots = components(links.select(F.col("doc_id").alias("u"), F.col("lead").alias("v")), s).select(F.col("node").alias("doc_id"), "root")
    named = rows.where("n_passages > 0").join(roots, "doc_id", "left").unionByName(rows.where("n_passages = 0").withColumn("root", F.lit(None).cast("long")))
    return s.done(named.select("doc_id", "n_words", (F.col("n_passages") > 0).alias("repeated"), "n_passages", "n_repeated_words", "spans", F.coalesce("root", "doc_id").alias("class_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
