"""Substring dedup by merging the shards' Burrows-Wheeler transforms.

A byte goes if some ``SPAN``-byte string over it also starts in a document with a smaller doc_id. Of
all ``SPAN``-byte suffix heads ("windows") only those matter that are in two documents, so:

1. Each window has an anchor, its least ``GRAM``-byte hash (leftmost of equal ones), which depends on
   the window's bytes alone. Tasks send each anchor key once for each shard; a key of one document only
   rules its windows out. What is left are runs of windows with a common anchor ("stretches", 50 to 76
   bytes). Stretches of an anchor that very many shards have are cut into single windows, each with a
   key of its own, so they go to as many buckets as there are different ones.
2. Every shard (documents by a hash of doc_id) sends its distinct stretches by anchor, each with the
   smallest doc_id that has it.
3. For each group of anchors every shard (beyond ``MERGED`` shards: every few shards together) has a
   transform: a stretch is read as text over words of ``WORD`` bytes, the shard's suffixes are sorted,
   and the transform is the word before each of them.
   (It is built from the stretches where they are merged, as they are smaller than it.) The transforms
   are merged by refining an interleave, which lists only the shard of each suffix. It starts in the
   order of the suffixes' first words, which the shards' word counts give. A round reads it from the
   start, takes the next word of the named shard's transform, and puts the shard in the next free slot of
   that word: the interleave of suffixes one word longer. No suffixes of different shards are ever
   compared or sorted again. Where neighbours differ in a round gives the words they have in common, and
   an interval with all words of a window in common is a repeated string; its smallest doc_id decides
   which of its windows go.
4. Shards apply the answers, one bit for each window, to their documents.

Copies cost one stretch for each shard, and a string of a third of all documents one for each shard.
Words are compared by 64-bit hashes in the rounds; what is then taken for equal, stretches and windows,
is confirmed on the bytes.

Defined cases: null and empty texts have no bytes and the digest of nothing; texts under ``SPAN``
bytes stay whole; rows with a null doc_id stay whole and remove nothing; rows that share a doc_id
don't remove from each other; no rows give no rows; other columns aren't used. Texts of any length are
read whole.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.blocks import Rolling, blocks, mix, numbered, pack, ragged, sort_order
from corvane.llm.scratch import Scratch, groups, parts

SPAN, GRAM = 50, 24
WIDTH = SPAN - GRAM + 1  # grams in a window
WORD = SPAN // 2
#: Shards and tasks that send an anchor, from which its stretches are cut into windows.
HOT = 4_000
#: Transforms that are merged at most; more shards share them, so that the work of a bucket doesn't grow with their number.
MERGED = 64
#: Bytes of text that a task holds before it deals them to the shards.
DEALT = 16 << 20
#: Bytes that are hashed at once where shards meet; the hash's powers stay in a worker for as long as it lives.
HASHED = (1 << 20) - 256
_SEVERAL, _HOT = np.uint32(1 << 31), np.uint64(1 << 63)
_ROLL = Rolling(211)
_LOW = np.uint64((1 << 24) - 1)


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, by doubling."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[: len(x) - (width - step)], x[width - step :]) if width > step else x


def stretches(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, anchor key, hash prefix sums, document) of each run of windows with one anchor."""
    prefix = _ROLL.prefix(data)
    n = len(data) - SPAN + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none.astype(np.uint64), prefix, none
    gram = (prefix[GRAM:] - prefix[:-GRAM]) * _ROLL.unpowers[: len(data) - GRAM + 1]
    place = np.empty(n, np.int64)
    for a in range(0, n, 1 << 23):  # places within a part fit the low bits
        b = min(n, a + (1 << 23))
        g = gram[a : b + WIDTH - 1]
        key = (g & ~_LOW) | np.arange(len(g), dtype=np.uint64)
        place[a:b] = (_least(key, WIDTH) & _LOW).astype(np.int64) + a
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[:n]
    good = np.arange(n) + SPAN <= at[doc + 1]
    new = np.ones(n, bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | ~good[:-1]
    first = np.flatnonzero(new & good)
    end = np.ones(n, bool)
    end[:-1] = new[1:] | ~good[1:]
    last = np.flatnonzero(end & good)
    return first, last, mix(gram[place[first]]), prefix, doc[first]


def _home(ids: np.ndarray, shards: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key >> np.uint64(40)) % np.uint64(buckets)


# 1. Anchor keys

_SENT = pa.schema([("bucket", pa.int32()), ("keys", pa.binary()), ("refs", pa.binary())])


def _short(key: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket(key, buckets) << np.uint64(32) | key & np.uint64(0xFFFFFFFF)


def _send(buckets: int, shards: int):
    def run(batches):
        keys, docs, homes, size = [], [], [], 0

        def flush():
            key, doc = _short(np.concatenate(keys), buckets), np.concatenate(docs)
            home = np.array(homes, np.uint32)[doc]
            order = sort_order(key, home)
            key, doc, home = key[order], doc[order], home[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            start = np.flatnonzero(new)
            several = np.repeat(np.minimum.reduceat(doc, start) != np.maximum.reduceat(doc, start), np.diff(np.append(start, len(key))))
            new[1:] |= home[1:] != home[:-1]
            key, ref = key[new], home[new] | several[new] * _SEVERAL
            names, first = np.unique(key >> np.uint64(32), return_index=True)
            rows = [{"bucket": k, "keys": pack(x.astype(np.uint32)), "refs": pack(y)} for k, x, y in zip(names.tolist(), np.split(key, first[1:]), np.split(ref, first[1:]), strict=True)]
            keys.clear(), docs.clear(), homes.clear()
            for a in range(0, len(rows), 256):
                yield pa.RecordBatch.from_pylist(rows[a : a + 256], schema=_SENT)

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, data, at in blocks(batch.column(1)):
                _, _, key, _, doc = stretches(data, at)
                keys.append(key), docs.append(doc + len(homes))
                homes += _home(ids[i:j], shards).tolist()
                size += len(key)
                if size > 1_000_000:
                    yield from flush()
                    size = 0
        if size:
            yield from flush()

    return run


_SHARED = pa.schema([("shard", pa.int32()), ("keys", pa.binary())])


def _shared(hot: int):
    def run(key, table):
        """The keys of several documents, for each shard that has them; marked where very many sent them."""
        keys = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint32).astype(np.uint64) | np.uint64(key[0].as_py() << 32)
        ref = np.frombuffer(b"".join(table["refs"].to_pylist()), np.uint32)
        order = sort_order(keys)
        keys, ref = keys[order], ref[order]
        start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        n = np.diff(np.append(start, len(keys)))
        shared = np.repeat((n > 1) | (np.maximum.reduceat(ref, start) >= _SEVERAL), n)
        keys, ref = (keys | np.repeat(n >= hot, n) * _HOT)[shared], (ref & ~_SEVERAL)[shared]
        order = sort_order(ref, keys & ~_HOT)
        keys, ref = keys[order], ref[order]
        once = np.ones(len(keys), bool)
        once[1:] = (keys[1:] != keys[:-1]) | (ref[1:] != ref[:-1])
        keys, ref = keys[once], ref[once]
        names, first = np.unique(ref, return_index=True)
        rows = [{"shard": s, "keys": pack(k)} for s, k in zip(names.tolist(), np.split(keys, first[1:]), strict=True)] if len(ref) else []
        return pa.Table.from_pylist(rows, schema=_SHARED)

    return run


# 2. Stretches of a shard


class Shard:
    """The shared stretches of a shard's documents and their distinct strings ("variants")."""

    def __init__(self, table: pa.Table, told: list[bytes], buckets: int):
        shared = np.frombuffer(b"".join(told), np.uint64)
        shared = shared[sort_order(shared & ~_HOT)]
        hot, shared = shared >= _HOT, shared & ~_HOT
        self.known = pc.is_valid(table["doc_id"]).to_numpy()
        self.ids = pc.fill_null(table["doc_id"], 0).to_numpy()
        self.parts, rows = [], []
        column = table["text"].combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) and column.num_chunks else column
        if table.num_rows:
            for i, j, data, at in blocks(column):
                first, last, key, prefix, doc = stretches(data, at)
                short = _short(key, buckets)
                k = np.minimum(np.searchsorted(shared, short), max(len(shared) - 1, 0))
                keep = (shared[k] == short) & self.known[i + doc] if len(shared) else np.zeros(len(short), bool)
                first, last, key, doc, k = first[keep], last[keep], key[keep], doc[keep], k[keep]
                if len(k) and hot[k].any():
                    n = np.where(hot[k], last - first + 1, 1)
                    at_, cut = np.repeat(np.arange(len(k)), n), np.repeat(hot[k], n)
                    begin = ragged(first, n)
                    first, last, key, doc = begin, np.where(cut, begin, last[at_]), key[at_], doc[at_]
                    key[cut] = mix(_ROLL.of(prefix, begin[cut], begin[cut] + SPAN))
                text = _ROLL.of(prefix, first, last + SPAN) if len(first) else np.zeros(0, np.uint64)
                text = mix(text + (last - first).astype(np.uint64))
                self.parts.append((i, data, at, first, last))
                rows.append((key, text, self.ids[i + doc]))
        key, text, ids = (np.concatenate([r[k] for r in rows]) if rows else np.zeros(0, np.uint64) for k in range(3))
        ids = ids.astype(np.int64)
        order = sort_order(key, text, ids - ids.min(initial=0))
        new = np.ones(len(order), bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (text[order][1:] != text[order][:-1])
        self.variant = np.empty(len(order), np.int64)
        self.variant[order] = np.cumsum(new) - 1
        self.sample = order[new]  # a stretch of each variant, of the smallest doc_id
        self.key, self.least, self.of = key[self.sample], ids[self.sample], ids
        bucket = _bucket(self.key, buckets).astype(np.int64)
        self.order = sort_order(bucket)  # variants by bucket, then key
        self.bucket = bucket[self.order]

    def strings(self) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and bytes of the variants, in the order in which they are sent."""
        if not len(self.sample):
            return np.zeros(0, np.int64), np.zeros(0, np.uint8)
        shift = np.cumsum([0] + [len(p[1]) for p in self.parts[:-1]])
        first, last = (np.concatenate([p[k] + x for p, x in zip(self.parts, shift, strict=True)])[self.sample[self.order]] for k in (3, 4))
        size = last - first + SPAN
        return size, np.concatenate([p[1] for p in self.parts])[ragged(first, size)]


_STRETCH = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("sizes", pa.binary()), ("least", pa.binary()), ("bytes", pa.binary())])


def _outgoing(buckets: int):
    def run(key, left, right):
        shard = Shard(left := undealt(left), right["keys"].to_pylist(), buckets)
        size, data = shard.strings()
        least, ends, rows = shard.least[shard.order], np.append(0, np.cumsum(size)), []
        names, first = np.unique(shard.bucket, return_index=True)
        for b, a, z in zip(names.tolist(), first.tolist(), np.append(first[1:], len(size)).tolist(), strict=True):
            rows.append({"bucket": b, "shard": int(key[0].as_py()), "sizes": pack(size[a:z].astype(np.uint8)), "least": pack(least[a:z]), "bytes": zlib.compress(pack(data[ends[a] : ends[z]]), 1)})
        return pa.Table.from_pylist(rows, schema=_STRETCH)

    return run


# 3. Merging


class Transform:
    """The transform of a shard's strings over numbered words.

    ``order`` lists the suffixes that begin with a whole word, sorted by their first two words (a missing
    one is least); ``first`` and ``before`` have their first words and the words before them (-1: none).
    """

    def __init__(self, word: np.ndarray, after: np.ndarray, before: np.ndarray):
        self.order = sort_order(word, after + 1)
        self.first, self.before, self.whole = word[self.order], before[self.order], after[self.order] >= 0
        self.order = self.order.astype(word.dtype)


def merge(transforms: list[Transform]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes of two words or more of all shards, in order of their first two.

    Gives the shard of each, its place among the shard's suffixes of two words, and how many words (2 at
    most) it has in common with the one before.
    """
    size = [len(t.first) for t in transforms]
    first, before = (np.concatenate([getattr(t, n) for t in transforms]) for n in ("first", "before"))
    # One word: the slots of a word are filled shard by shard, as many as the shard has.
    order = sort_order(first)
    z = np.repeat(np.arange(len(transforms), dtype=np.uint16 if len(size) < 1 << 16 else np.int64), size)[order]
    block = np.cumsum(np.append(False, np.diff(first[order]) != 0))[: len(z)]
    z, block, word = refine(z, block, before)
    common = np.zeros(len(z), np.int8)
    common[1:] = (word[1:] == word[:-1]) * (np.int8(1) + (block[1:] == block[:-1]))
    place = np.empty(len(z), np.int64)
    order = np.argsort(z, kind="stable")
    n = np.bincount(z, minlength=len(size))
    place[order] = np.arange(len(z)) - np.repeat(np.cumsum(n) - n, n)
    return z.astype(np.int64), place, common


def refine(z: np.ndarray, block: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: the interleave of the suffixes longer by the word before, their words, and the blocks of what follows these.

    ``z`` has the shard of each suffix, ``block`` numbers suffixes that are equal so far, and ``before``
    has the shards' transforms, one after the other. Suffixes without a word before them fall out.
    """
    at = np.empty(len(z), np.int64)
    at[np.argsort(z, kind="stable")] = np.arange(len(z))  # the next place of each shard's transform
    word = before[at]
    have = np.flatnonzero(word >= 0)
    order = have[sort_order(word[have])]
    return z[order], block[order], word[order]


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of strings that follow each other in ``data``."""
    out, i = np.empty(len(start), np.uint64), 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + HASHED - 256)))
        a, n = start[i:j] - start[i], size[i:j]
        out[i:j] = _ROLL.of(_ROLL.prefix(data[start[i] : start[j - 1] + size[j - 1]]), a, a + n)
        i = j
    return out


def _words(data: np.ndarray) -> np.ndarray:
    """The hash of the word at each place."""
    out = np.empty(max(0, len(data) - WORD + 1), np.uint64)
    for a in range(0, len(out), HASHED):
        prefix = _ROLL.prefix(data[a : a + HASHED + WORD - 1])
        n = len(prefix) - WORD
        out[a : a + n] = (prefix[WORD:] - prefix[:-WORD]) * _ROLL.unpowers[:n]
    return out


def _differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at ``a`` and at ``b`` differ."""
    out = np.zeros(len(a), bool)
    for i in range(0, len(a), 100_000):
        n = size[i : i + 100_000]
        odd = data[ragged(a[i : i + 100_000], n)] != data[ragged(b[i : i + 100_000], n)]
        out[i : i + 100_000] = np.maximum.reduceat(odd, np.cumsum(n) - n)
    return out


def first_documents(size: np.ndarray, shard: np.ndarray, least: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For strings (sorted by shard): the entry of each, and for each window of each entry the smallest doc_id that has it.

    An entry is a string that is in the transform of the first shard that has it; ``least`` has the
    smallest doc_id of each string. Gives entries, the entries' numbers of windows, and the doc_ids.
    """
    start = np.cumsum(size) - size
    lead, entry = numbered(mix(_hashes(data, start, size) + size.astype(np.uint64)))
    far = lead[entry]
    odd = np.flatnonzero(far != np.arange(len(far)))
    odd = odd[(size[odd] != size[far[odd]]) | _differ(data, start[odd], start[far[odd]], np.minimum(size[odd], size[far[odd]]))] if len(odd) else odd
    if len(odd):  # equal hashes of different strings: entries of their own
        entry[odd] = len(lead) + np.arange(len(odd))
        lead = np.append(lead, odd)
    order = sort_order(lead)  # entries by shard
    rank = np.empty(len(lead), np.int64)
    rank[order] = np.arange(len(lead))
    lead, entry = lead[order], rank[entry]
    order = sort_order(entry)
    low = np.minimum.reduceat(least[order], np.flatnonzero(np.append(True, np.diff(entry[order]) != 0)))
    # Words at every place of the entries, numbered in the order of their hashes.
    count = size[lead] - WORD + 1
    kind = np.int32 if len(data) < 1 << 31 else np.int64
    at = ragged(start[lead], count).astype(kind)
    owner = np.repeat(np.arange(len(lead), dtype=kind), count)
    word = numbered(_words(data)[at])[1].astype(kind)
    after, before = np.full(len(word), -1, kind), np.full(len(word), -1, kind)
    end = (start + size)[lead].astype(kind)
    two = np.flatnonzero(at <= end[owner] - 2 * WORD).astype(kind)  # suffixes of two words: the windows
    after[two], before[two + WORD] = word[two + WORD], word[two]
    cut = np.searchsorted(owner, np.flatnonzero(np.append(True, np.diff(shard[lead]) != 0)))
    ends = np.append(cut[1:], len(owner))
    transforms = [Transform(word[a:z], after[a:z], before[a:z]) for a, z in zip(cut.tolist(), ends.tolist(), strict=True)]
    del word, after, before
    z, place, common = merge(transforms)
    whole = [t.order[t.whole] + a for t, a in zip(transforms, cut.tolist(), strict=True)]
    base = np.cumsum([0] + [len(x) for x in whole])
    n_places = len(at)
    del transforms
    suffix = np.concatenate(whole)[base[z] + place]  # windows in order
    del z, place, whole
    new = common < 2
    head = suffix[np.flatnonzero(new)[np.cumsum(new) - 1]]
    check = np.flatnonzero(head != suffix)
    odd = check[_differ(data, at[head[check]], at[suffix[check]], np.full(len(check), SPAN))] if len(check) else check
    doc = low[owner[suffix]]
    best = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1] if len(doc) else doc
    if len(odd):  # equal hashes of different words: these blocks are told apart by their bytes
        blocks_ = np.cumsum(new)
        some = np.flatnonzero(np.isin(blocks_, blocks_[odd]))
        seen: dict[bytes, int] = {}
        names = [data[at[k] : at[k] + SPAN].tobytes() for k in suffix[some].tolist()]
        for x, d in zip(names, doc[some].tolist(), strict=True):
            seen[x] = min(seen.get(x, d), d)
        best[some] = [seen[x] for x in names]
    first = np.empty(n_places, np.int64)
    first[suffix] = best
    return entry, size[lead] - SPAN + 1, first[two]


_MASKS = pa.schema([("shard", pa.int32()), ("bucket", pa.int32()), ("masks", pa.binary())])


def _merge(key, table):
    some = sorted(table.to_pylist(), key=lambda r: r["shard"])
    size = np.concatenate([np.frombuffer(r["sizes"], np.uint8) for r in some]).astype(np.int64)
    least = np.concatenate([np.frombuffer(r["least"], np.int64) for r in some])
    shard = np.repeat(np.arange(len(some)) * min(len(some), MERGED) // len(some), [len(r["sizes"]) for r in some])
    data = np.frombuffer(b"".join(zlib.decompress(r["bytes"]) for r in some), np.uint8)
    entry, count, first = first_documents(size, shard, least, data)
    # A bit for each window of each sender's string: is it in a smaller document than the sender's least?
    n, place = count[entry], np.cumsum(count) - count
    sender = np.repeat(np.arange(len(entry)), n)
    gone = first[ragged(place[entry], n)] < least[sender]
    mask = np.bincount(sender, gone * (2.0 ** ragged(np.zeros(len(n), np.int64), n)), minlength=len(entry)).astype(np.uint32)
    cut = np.cumsum([0] + [len(r["sizes"]) for r in some])
    return pa.Table.from_pylist([{"shard": r["shard"], "bucket": r["bucket"], "masks": pack(mask[a:z])} for r, a, z in zip(some, cut[:-1], cut[1:], strict=True)], schema=_MASKS)


# 4. Applying


def _apply(buckets: int, keep: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep
    kinds = [pa.int64()] * 4 + [pa.string()] + [pa.binary()] * keep

    def run(left, right):
        told = [r for r in right.to_pylist() if r["keys"] is not None]
        shard = Shard(left := undealt(left), [r["keys"] for r in told], buckets)
        mask = np.zeros(len(shard.order), np.uint32)
        for r in right.to_pylist():
            if r["masks"] is not None:
                a, z = np.searchsorted(shard.bucket, [r["bucket"], r["bucket"] + 1])
                mask[shard.order[a:z]] = np.frombuffer(r["masks"], np.uint32)
        # The first document of a variant has the answer; all later ones have every window from it.
        bits = np.where(shard.of == shard.least[shard.variant], mask[shard.variant], np.uint32(0xFFFFFFFF)) if len(shard.variant) else mask[:0]
        rows, base = [], 0
        doc = left["doc_id"].to_pylist()
        for i, data, at, first, last in shard.parts:
            some = bits[base : base + len(first)]
            base += len(first)
            hit = np.flatnonzero(some)
            some, first, count = some[hit], first[hit], (last - first + 1)[hit]
            window = ragged(first, count)
            window = window[(np.repeat(some, count) >> (window - np.repeat(first, count)).astype(np.uint32) & np.uint32(1)) > 0]
            edge = np.bincount(window, minlength=len(data) + 1) - np.bincount(window + SPAN, minlength=len(data) + 1)
            cover = np.cumsum(edge[:-1]) > 0
            for d in range(len(at) - 1):
                c, text = cover[at[d] : at[d + 1]], data[at[d] : at[d + 1]]
                removed = int(c.sum())
                spans = int(c[0]) + int((c[1:] & ~c[:-1]).sum()) if removed else 0
                kept = text[~c].tobytes() if removed else text.tobytes()
                rows.append((doc[i + d], len(text), removed, spans, hashlib.sha256(kept).hexdigest(), *((kept,) if keep else ())))
        return pa.table([pa.array(x, k) for x, k in zip(zip(*rows, strict=True) if rows else [[]] * len(names), kinds, strict=True)], names=names)

    return run


def substring_dedup(docs: DataFrame, keep: bool = False, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, and the ``kept`` bytes if wanted."""
    spark: SparkSession = docs.sparkSession
    s = Scratch(spark)
    buckets = shards = groups(docs, 4.0)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sent = src.where("doc_id is not null").mapInArrow(_send(buckets, shards), "bucket int, keys binary, refs binary")
    told = s.save(sent.repartition(parts(buckets), "bucket").groupBy("bucket").applyInArrow(_shared(hot), "shard int, keys binary"), "told")
    rows = dealt(src, shards)
    out = rows.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(_outgoing(buckets), "bucket int, shard int, sizes binary, least binary, bytes binary")
    masks = s.save(out.repartition(parts(buckets), "bucket").groupBy("bucket").applyInArrow(_merge, "shard int, bucket int, masks binary"), "masks")
    answers = told.select("shard", F.lit(None).cast("int").alias("bucket"), "keys", F.lit(None).cast("binary").alias("masks")).union(masks.select("shard", "bucket", F.lit(None).cast("binary").alias("keys"), "masks"))
    kept = ", kept binary" if keep else ""
    return s.done(rows.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_apply(buckets, keep), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + kept))


_ROWS = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])


def dealt(src: DataFrame, shards: int) -> DataFrame:
    """(shard, body): rows of doc_id and text by shard, a compressed body for each shard of a batch."""

    def deal(held):
        table = pa.Table.from_batches(held).combine_chunks()
        ids = table.column(0)
        known = ids.is_valid().to_numpy()
        n = pc.fill_null(ids, 0).to_numpy()
        # Rows without an id are only looked at for themselves and may lie anywhere.
        home = np.where(known, _home(n, shards), np.arange(len(n)) % shards)
        order = np.argsort(home, kind="stable")
        names, start = np.unique(home[order], return_index=True)
        ends = np.append(start[1:], len(order))
        table = pa.Table.from_arrays([c.cast(f.type) for c, f in zip(table.columns, _ROWS, strict=True)], schema=_ROWS).take(pa.array(order)).combine_chunks()
        for k in range(0, len(names), 256):
            bodies = []
            for a, z in zip(start[k : k + 256].tolist(), ends[k : k + 256].tolist(), strict=True):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, _ROWS, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                    w.write_table(table.slice(a, z - a))
                bodies.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 256], pa.int32()), pa.array(bodies, pa.binary())], names=["shard", "body"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > DEALT:
                yield from deal(held)
                held, size = [], 0
        if held:
            yield from deal(held)

    return src.mapInArrow(run, "shard int, body binary")


def undealt(table: pa.Table) -> pa.Table:
    """The rows of a shard."""
    got = [pa.ipc.open_stream(x).read_all() for x in table["body"].to_pylist()]
    return pa.concat_tables(got).combine_chunks() if got else _ROWS.empty_table()


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT doc_id, q, substr(h, 2000 * q + 1, 2098) AS h FROM (SELECT doc_id, h, unnest(range(greatest(length(h) // 2 + 950, 0) // 1000)) AS q FROM d)),
w AS (SELECT doc_id, 1000 * q + i AS p, substr(h, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(length(h) // 2 - 49)) AS i FROM part)),
m AS (SELECT s, min(doc_id) AS lowest FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT w.doc_id, p FROM w JOIN m ON w.s = m.s WHERE lowest < w.doc_id),
run AS (SELECT doc_id, p, sum(CASE WHEN p <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY p) AS k
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM hit)),
span AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM run GROUP BY doc_id, k),
gap AS (SELECT doc_id, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS z FROM (SELECT * FROM span UNION ALL SELECT doc_id, length(h) // 2, NULL FROM d)),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS h FROM gap JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, (length(d.h) // 2)::BIGINT AS n_bytes, ((length(d.h) - length(kept.h)) // 2)::BIGINT AS n_removed,
  (SELECT count(*) FROM span WHERE span.doc_id = d.doc_id) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept ON d.doc_id = kept.doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
