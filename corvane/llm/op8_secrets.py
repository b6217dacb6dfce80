"""Secret scans with multipart credential linking.

Base findings are those of three patterns, leftmost and non-overlapping for each kind. They stand for
themselves; the method adds the weak parts that complete a credential. Weak candidates are identifiers
(temporary access ids, account and user names that are assigned), secrets (40-character key material)
and endpoints (URLs, hosts of services). They are reported only when an interval join finds
complementary parts within ``SCOPE`` code points in the same text: a secret near any identifier, an
identifier near a secret or an assigned one, an endpoint near an assigned secret or near both an
identifier and a secret. Complements are base findings and weak candidates alike; a weak one counts only
if it is reported itself, but for the pair of a weak identifier and a weak secret, which are near each other.
The join is a sweep over sorted spans with running maxima of ends, so its cost follows the number of
spans and not their pairs or lengths; patterns are linear in the text.

Scopes never cross documents, so documents are scanned where they lie, with no shuffle; a document is
scanned whole. Defined cases: null and empty texts have no spans; every row is reported, repeated or
not; positions are code points, ends exclusive; other columns aren't used; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.scratch import bound_batches

SCOPE = 200

# The patterns of the base findings, and the least lengths of what they find.
ASSIGN = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_VALUE, LEAST_ACCESS = 8, 16

KEY = re.compile(r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])")
IDENT = re.compile(r"""(?<![A-Z0-9])(?:ASIA|AIDA|AROA)[A-Z0-9]{16}(?![A-Z0-9])|(?:user(?:_?name)?|login|client_?id|account(?:_?id)?)["']?\x20{0,8}[:=]\x20{0,8}["']?[A-Za-z0-9_.@-]{3,}""")
URL = re.compile(r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/%+-]*)?")
NAME = re.compile(r"[A-Za-z0-9_.-]+")
SERVICE = re.compile(r"\.(?:amazonaws\.com|internal|corp|local)(?![A-Za-z0-9_-])")

KINDS = ("assign", "access", "hex", "key", "endpoint", "ident")
Span = tuple[int, int, int]  # start, place of the kind in KINDS, end


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_VALUE]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    out.sort()
    return out


def near(spans: list[Span], others: list[Span], scope: int = SCOPE) -> list[bool]:
    """For each span, whether one of ``others`` begins or ends within ``scope`` of it (an interval join by a sweep)."""
    others = sorted(others)
    starts = [s for s, _, _ in others]
    reach = list(accumulate((e for _, _, e in others), max))
    return [(i := bisect_right(starts, e + scope)) > 0 and reach[i - 1] >= s - scope for s, _, e in spans]


def _endpoints(text: str) -> list[Span]:
    out = [(m.start(), 4, m.end()) for m in URL.finditer(text)]
    taken = 0
    urls = iter([*out, (len(text) + 1, 4, len(text) + 1)])
    url = next(urls)
    for m in NAME.finditer(text) if any(x in text for x in (".amazonaws.com", ".internal", ".corp", ".local")) else ():
        while url[2] <= m.start():
            url = next(urls)
        if url[0] < m.end():
            continue  # a part of that URL
        for hit in SERVICE.finditer(m[0]):
            taken = hit.end()
        if taken:
            host = m[0][:taken].lstrip("._-")
            if len(host) > 0 and not host.startswith("."):
                out.append((m.start() + taken - len(host), 4, m.start() + taken))
            taken = 0
    return sorted(out)


def linked_spans(text: str, base: list[Span], scope: int = SCOPE) -> list[Span]:
    """Weak candidates that complete a credential with parts in their scope."""
    access = [x for x in base if x[1] == 1]
    assign = [x for x in base if x[1] == 0]
    keys = [(m.start(), 3, m.end()) for m in KEY.finditer(text)]
    if not (access or assign or keys):
        return []
    names = [(m.start(), 5, m.end()) for m in IDENT.finditer(text)]
    keys = [k for k, ok in zip(keys, near(keys, access + names, scope), strict=True) if ok]
    names = [x for x, ok in zip(names, near(names, keys + assign, scope), strict=True) if ok]
    ends = _endpoints(text)
    marks = zip(ends, near(ends, access + names, scope), near(ends, keys + assign, scope), near(ends, assign, scope), strict=True)
    return keys + names + [x for x, ident, secret, known in marks if ident and secret or known]


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


_NAMES = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
_EMPTY = hashlib.sha256(b"").hexdigest()


def _scan(scope: int):
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in _NAMES[1:4]), ("base_sha256", pa.string()), ("spans", pa.string())])

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base = base_spans(text) if text else []
                more = linked_spans(text, base, scope) if text else []
                n = [sum(k == i for _, k, _ in base) for i in range(3)]
                rows.append((doc, *n, hashlib.sha256(render(base).encode()).hexdigest() if base else _EMPTY, render(base + more)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Per row: counts of base findings, a digest of their spans, and all spans as kind:start:end."""
    bound_batches(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_scan(scope), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
