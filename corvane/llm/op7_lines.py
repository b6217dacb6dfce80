"""Line dedup with two Bloom filters.

A once-seen filter gets the bits of every document's line keys, and where bits are set again, by another
document, the twice-seen filter gets them. A key of two documents has all its bits there, so nothing is
missed, and a false alarm only costs a row. Only keys that the twice-seen filter suspects are counted,
summed in each task before the shuffle, and confirmed by their 128-bit digest.

The filters grow with the input. Up to ``BITS`` bits tasks send set bits by block, and the twice-seen
filter is broadcast, as are up to ``KEYS`` confirmed keys. Beyond either bound nothing is broadcast: rows
are numbered into written shards, the filters are cut into key ranges, each shard asks the ranges of its
keys and is told its suspects, and later those of its keys that are confirmed. Results are the same.

Defined cases: a null or empty text is one empty line; an empty key is never dropped; a key counts
once for each row that holds it, repeated rows and repeated or null doc_ids included; other columns
pass unchanged (the two result columns are named by the caller, an error tells if they are taken); no
rows in, no rows out. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.blocks import pack
from corvane.llm.scratch import Scratch, fresh, groups, parts, size_hint

#: Bits of a filter that is broadcast at most: 64 MB.
BITS = 1 << 29
#: Bits of a key range's filter, for lines of 8 MB of documents.
RANGE = 1 << 21
#: Confirmed keys that are broadcast at most (16 bytes each); beyond, they are joined.
KEYS = 1 << 20
BLOCKS = 64
SPACE = b" \t\n\x0b\x0c\r"


def _keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    lines = text.split(b"\n")
    return lines, [x.strip(SPACE).lower() for x in lines]


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.large_binary()).to_pylist()]


def _digests(texts: list[bytes], known: dict) -> Iterator[set[bytes]]:
    for text in texts:
        found = set()
        for key in set(_keys(text)[1]):
            if key:
                if len(key) > 200:
                    found.add(_digest(key))
                else:
                    if (d := known.get(key)) is None:
                        d = known[key] = _digest(key)
                    found.add(d)
        if len(known) > 100_000:
            known.clear()
        yield found


def _bits(digests: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions of each 16-byte digest."""
    return (digests.view(np.uint64).reshape(-1, 2) % np.uint64(bits)).astype(np.uint32)


def _fill(bits: int):
    def run(batches):
        once, twice, known, held = Counter(), set(), {}, 0

        def rows():
            per = bits // BLOCKS
            one = np.unique(_bits(np.frombuffer(b"".join(once), np.uint8), bits)) if once else np.zeros(0, np.uint32)
            two = np.unique(_bits(np.frombuffer(b"".join(k for k, n in once.items() if n > 1), np.uint8), bits)) if any(n > 1 for n in once.values()) else np.zeros(0, np.uint32)
            for b in range(BLOCKS):
                x, y = (a[np.searchsorted(a, b * per) : np.searchsorted(a, (b + 1) * per)] for a in (one, two))
                if len(x):
                    yield {"block": b, "once": x.tobytes(), "twice": y.tobytes()}

        for batch in batches:
            for found in _digests(_texts(batch), known):
                once.update(found)
            if len(once) > 500_000:
                yield pa.RecordBatch.from_pylist(list(rows()), schema=schema)
                once.clear()
        if once:
            yield pa.RecordBatch.from_pylist(list(rows()), schema=schema)

    schema = pa.schema([("block", pa.int32()), ("once", pa.binary()), ("twice", pa.binary())])
    return run


def _merge(bits: int):
    schema = pa.schema([("block", pa.int32()), ("bits", pa.binary())])

    def run(batches):
        per, held = bits // BLOCKS, {}
        for batch in batches:
            for row in batch.to_pylist():
                once, twice = held.setdefault(row["block"], (np.zeros(per, bool), np.zeros(per, bool)))
                at = np.frombuffer(row["once"], np.uint32) - np.uint32(row["block"] * per)
                twice[at[once[at]]] = True
                twice[np.frombuffer(row["twice"], np.uint32) - np.uint32(row["block"] * per)] = True
                once[at] = True
        for b, (_, twice) in held.items():
            yield pa.RecordBatch.from_pylist([{"block": b, "bits": np.packbits(twice, bitorder="little").tobytes()}], schema=schema)

    return run


def _suspects(shared, bits: int):
    schema = pa.schema([("key", pa.binary()), ("n", pa.int64()), ("first", pa.int64())])

    def run(batches):
        seen, n, first, known = shared.value, Counter(), {}, {}

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64()), pa.array([first.get(k) for k in n], pa.int64())], schema=schema)

        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
            for doc, found in zip(ids, _digests(_texts(batch), known), strict=True):
                if found:
                    keys = list(found)
                    at = _bits(np.frombuffer(b"".join(keys), np.uint8), bits)
                    hit = (seen[at >> np.uint32(3)] >> (at & np.uint32(7)).astype(np.uint8) & 1).all(axis=1)
                    for i in np.flatnonzero(hit).tolist():
                        n[keys[i]] += 1
                        if doc is not None and doc < first.get(keys[i], 1 << 63):
                            first[keys[i]] = doc
            if len(n) > 200_000:
                yield rows()
                n.clear(), first.clear()
        if n:
            yield rows()

    return run


def _clean(ids: list, texts: list[bytes], hot: dict[bytes, int | None], known: dict[bytes, bytes]) -> list[pa.Array]:
    """Texts without the lines whose digest is in ``hot`` (but the first one in its document), and their numbers of lines."""
    out, n, dropped = [], [], []
    for doc, text in zip(ids, texts, strict=True):
        lines, keys = _keys(text)
        used, keep = set(), []
        for line, key in zip(lines, keys, strict=True):
            if key:
                if (d := known.get(key)) is None:
                    d = _digest(key)
                    if len(key) < 200:
                        known[key] = d
                if d in hot:
                    if hot[d] is None or hot[d] != doc or d in used:
                        continue
                    used.add(d)
            keep.append(line)
        out.append(b"\n".join(keep) if len(keep) < len(lines) else text)
        n.append(len(lines))
        dropped.append(len(lines) - len(keep))
        if len(known) > 100_000:
            known.clear()
    return [pa.array(out, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(dropped, pa.int64())]


def _with(columns: list, names: list[str], cleaned: list, schema: pa.Schema) -> list:
    columns[names.index("text")] = cleaned[0]
    return [c.cast(f.type) for c, f in zip([*columns, *cleaned[1:]], schema, strict=True)]


def _dropper(schema: pa.Schema, shared):
    def run(batches):
        known: dict[bytes, bytes] = {}
        for batch in batches:
            names = batch.schema.names
            cleaned = _clean(batch.column(names.index("doc_id")).to_pylist(), _texts(batch), shared.value, known)
            yield pa.RecordBatch.from_arrays(_with(batch.columns, names, cleaned, schema), schema=schema)

    return run


# Beyond what is broadcast: shards that ask key ranges


def _ranges(digests: bytes, ranges: int) -> tuple[np.ndarray, np.ndarray]:
    """The key range of each digest, and the half that its bits are taken from."""
    d = np.frombuffer(digests, np.uint64).reshape(-1, 2)
    return (d[:, 0] % np.uint64(ranges)).astype(np.int64), d[:, 1]


def _range_bits(half: np.ndarray) -> np.ndarray:
    return np.stack([half % np.uint64(RANGE), (half >> np.uint64(32)) % np.uint64(RANGE)], 1).astype(np.int64)


_ASKED = pa.schema([("range", pa.int64()), ("shard", pa.int64()), ("once", pa.binary()), ("twice", pa.binary())])


def _ask(ranges: int):
    """The distinct keys of each shard's documents in a task, by key range; those of two documents apart."""

    def run(batches):
        held, known, size = {}, {}, 0

        def rows():
            for shard, once in held.items():
                digests = list(once)
                at, half = _ranges(b"".join(digests), ranges)
                several = np.array([once[d] > 1 for d in digests])
                order = np.argsort(at, kind="stable")
                names, first = np.unique(at[order], return_index=True)
                for name, some in zip(names.tolist(), np.split(order, first[1:]), strict=True):
                    yield {"range": name, "shard": shard, "once": pack(half[some[~several[some]]]), "twice": pack(half[some[several[some]]])}

        def flush():
            out = list(rows())
            held.clear()
            for a in range(0, len(out), 512):
                yield pa.RecordBatch.from_pylist(out[a : a + 512], schema=_ASKED)

        for batch in batches:
            for shard, found in zip(batch.column(0).to_pylist(), _digests(_texts(batch), known), strict=True):
                if found:
                    held.setdefault(shard, Counter()).update(found)
                    size += len(found)
            if size > 500_000:
                yield from flush()
                size = 0
        yield from flush()

    return run


_TOLD = pa.schema([("shard", pa.int64()), ("range", pa.int64()), ("keys", pa.binary())])


def _answer(key, table):
    """Fills a key range's two filters with what all shards have sent, and tells each which of its keys are suspected."""
    once, twice = np.zeros(RANGE, bool), np.zeros(RANGE, bool)
    got = table.select(["shard", "once", "twice"]).to_pylist()
    for r in got:
        one, two = (_range_bits(np.frombuffer(r[c], np.uint64)) for c in ("once", "twice"))
        for at in (one, two):
            twice[at[once[at]]] = True
            once[at] = True
        twice[two] = True
    rows = []
    for r in got:
        half = np.frombuffer(r["once"] + r["twice"], np.uint64)
        half = half[twice[_range_bits(half)].all(axis=1)]
        if len(half):
            rows.append({"shard": r["shard"], "range": key[0].as_py(), "keys": pack(half)})
    return pa.Table.from_pylist(rows, schema=_TOLD)


_FOUND = pa.schema([("key", pa.binary()), ("shard", pa.int64()), ("n", pa.int64()), ("first", pa.int64())])


def _count(ranges: int):
    def run(key, left, right):
        """The suspected keys of a shard, with the number of its rows that hold them."""
        told = {(r, h) for r, k in zip(right["range"].to_pylist(), right["keys"].to_pylist(), strict=True) for h in np.frombuffer(k, np.uint64).tolist()}
        n, first = Counter(), {}
        for batch in left.to_batches():
            for doc, found in zip(batch.column(batch.schema.get_field_index("doc_id")).to_pylist(), _digests(_texts(batch), {}), strict=True):
                digests = list(found)
                at, half = _ranges(b"".join(digests), ranges)
                for d, r, h in zip(digests, at.tolist(), half.tolist(), strict=True):
                    if (r, h) in told:
                        n[d] += 1
                        if doc is not None and doc < first.get(d, 1 << 63):
                            first[d] = doc
        return pa.Table.from_arrays([pa.array(list(n), pa.binary()), pa.array([key[0].as_py()] * len(n), pa.int64()), pa.array(list(n.values()), pa.int64()), pa.array([first.get(k) for k in n], pa.int64())], schema=_FOUND)

    return run


def _drop_in_shard(schema: pa.Schema):
    def run(left, right):
        hot, known, out = dict(zip(right["key"].to_pylist(), right["first"].to_pylist(), strict=True)), {}, []
        for batch in left.to_batches():
            names = batch.schema.names
            cleaned = _clean(batch.column(names.index("doc_id")).to_pylist(), _texts(batch), hot, known)
            out.append(pa.RecordBatch.from_arrays(_with(batch.columns[:-1], names, cleaned, schema), schema=schema))
        return pa.Table.from_batches(out, schema=schema)

    return run


def _sharded(docs: DataFrame, out: T.StructType, schema: pa.Schema, min_docs: int, keep_first: bool, s: Scratch) -> DataFrame:
    shards = groups(docs)
    n, shard = parts(shards), fresh(docs.columns, "_shard")
    rows = s.save(docs.withColumn(shard, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards))), "numbered")
    asked = rows.select(shard, "text").mapInArrow(_ask(shards), "range long, shard long, once binary, twice binary")
    told = s.save(asked.repartition(n, "range").groupBy("range").applyInArrow(_answer, "shard long, range long, keys binary"), "told")
    found = rows.groupBy(shard).cogroup(told.groupBy("shard")).applyInArrow(_count(shards), "key binary, shard long, n long, first long")
    found = s.save(found, "found")
    hot = found.groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("least")).where(F.col("n") >= min_docs)
    hot = found.select("key", "shard").join(hot, "key").select("shard", "key", (F.col("least") if keep_first else F.lit(None).cast("long")).alias("first"))
    cleaned = s.save(rows.groupBy(shard).cogroup(hot.groupBy("shard")).applyInArrow(_drop_in_shard(schema), out), "cleaned")
    s.drop("numbered", "told", "found")
    s.keep("cleaned")
    return cleaned


def line_dedup(docs: DataFrame, min_docs: int = 10, keep_first: bool = False, max_bits: int = BITS, max_keys: int = KEYS, lines: str = "_lines", dropped: str = "_dropped") -> DataFrame:
    """``docs`` with the lines dropped whose key is in ``min_docs`` rows or more, and two last columns: their numbers of lines and of dropped ones.

    ``keep_first``: the first such line of the document with the smallest doc_id stays.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark: SparkSession = docs.sparkSession
    s = Scratch(spark)
    if fresh(docs.columns, lines) != lines or fresh(docs.columns, dropped) != dropped:
        raise ValueError(f"{lines} or {dropped} is a column already")
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    out = T.StructType([*docs.schema.fields, T.StructField(lines, T.LongType()), T.StructField(dropped, T.LongType())])
    schema = to_arrow_schema(out)
    bits, want = 1 << 20, size_hint(docs) // 4
    while bits < want:
        bits *= 2
    if bits > max_bits:
        return _sharded(docs, out, schema, min_docs, keep_first, s)
    src = docs.select("doc_id", "text")
    filled = src.select("text").mapInArrow(_fill(bits), "block int, once binary, twice binary")
    merged = filled.repartition(BLOCKS, "block").mapInArrow(_merge(bits), "block int, bits binary").collect()
    seen = np.zeros(bits // 8, np.uint8)
    for row in merged:  # BLOCKS rows, max_bits / 8 bytes in all
        at = row["block"] * (bits // BLOCKS // 8)
        seen[at : at + len(row["bits"])] |= np.frombuffer(row["bits"], np.uint8)
    filter_ = spark.sparkContext.broadcast(seen)
    hot = src.mapInArrow(_suspects(filter_, bits), "key binary, n long, first long").groupBy("key").agg(F.sum("n").alias("n"), F.min("first").alias("first")).where(F.col("n") >= min_docs)
    hot = s.save(hot.select("key", "first" if keep_first else F.lit(None).cast("long").alias("first")), "hot")
    if hot.count() > max_keys:
        s.drop("hot")
        return _sharded(docs, out, schema, min_docs, keep_first, s)
    shared = spark.sparkContext.broadcast({bytes(r["key"]): r["first"] for r in hot.collect()})
    s.drop("hot")
    return docs.mapInArrow(_dropper(schema, shared), out)


def op7(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs)
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Stated for this check: keys of 1 code point or more found in at least 10 documents.
SQL = """
WITH lines AS (
  SELECT doc_id, i, line, lower_ascii AS key FROM (
    SELECT doc_id, i, line, translate(trim(line, E' \\t\\n\\x0b\\x0c\\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_ascii
    FROM (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\\n') AS ls FROM documents)))),
hot AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT l.doc_id, count(*) AS n_lines, count(h.key) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN h.key IS NULL THEN l.line END, E'\\n' ORDER BY l.i), '')) AS kept_sha256
FROM lines l LEFT JOIN hot h ON l.key = h.key GROUP BY l.doc_id
"""
