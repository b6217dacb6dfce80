"""Token counts by a compiled finite-state tokenizer.

A byte-level BPE vocabulary file is compiled into two deterministic transducers.

1. The pre-tokenizer, over character classes. A transition is annotated with what it emits: an arc end
   before the character it reads, or before the one before that (white space and ``'r``, ``'v``, ``'l``
   are decided a character late). The pieces between arc ends are word arcs.
2. The merges, over bytes. A transition is annotated with how many tokens more (or, where a byte lets
   earlier ones merge, fewer) the arc read so far has. A state holds what the future of an arc depends on:
   for every suffix that some token begins with, the token before it and the tokens since. A token may
   follow another if no merge across their border comes before the merges that made them, which decides
   the one last token of every prefix. Transitions are compiled when first taken, and kept.

A block of texts is one character stream, cut in lanes that are read side by side by the first
transducer. As a lane's start state isn't known, the first pass computes the lane's state map (end state
for each start state; lanes mostly forget their start state within a few characters). The maps are
composed by a parallel prefix scan, which gives each lane's true start state, and the second pass emits.
Nothing depends on where a document or lane is cut. Word arcs are read once for each distinct arc of a
block (told apart by 64-bit hashes there, and by their text from block to block).

Defined cases: null and empty texts have 0 tokens; texts of any length are read whole; special
strings inside texts are one token each and part the text, as the library's default has it; every
row counts for itself, repeated or not; no rows give no rows; other columns aren't used. Vocabularies
of other kinds, or whose merges can't be compiled, are refused.
"""

from __future__ import annotations

import json
import unicodedata
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.blocks import blocks, mix
from corvane.llm.scratch import bound_batches

LIMIT = 512

# Character classes: letters that contractions are made of are told apart.
L, ONE, R, V, LL, E, N, SP, W, A, O, END = range(12)
# States: after the start, in a run, after white space (one character or more), within a contraction, after one.
START, IN_L, IN_N, IN_O, SP1, SP2, W1, W2, APO, APO_R, APO_V, APO_L, DONE = range(13)
HERE, BEFORE = 1, 2


def transducer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, emission) by state and class."""
    go, emit = np.zeros((13, 12), np.uint8), np.zeros((13, 12), np.uint8)
    letters = (L, ONE, R, V, LL, E)
    run = {**dict.fromkeys(letters, IN_L), N: IN_N, O: IN_O, A: APO, SP: SP1, W: W1, END: START}
    for state in range(13):
        for c in range(12):
            to, out = run[c], HERE
            if state == IN_L and c in letters or state == IN_N and c == N:
                out = 0
            elif state == IN_O and c in (O, A):
                to, out = IN_O, 0
            elif state in (SP1, SP2, W1, W2):
                if c in (SP, W):
                    to, out = (SP2 if c == SP else W2), 0
                elif c != END:
                    if state in (SP1, SP2):
                        # The last blank goes with what follows.
                        to, out = (IN_O if c == A else run[c]), (BEFORE if state == SP2 else 0)
                    elif state == W2:
                        out = HERE | BEFORE
            elif state == APO:
                if c in (O, A):
                    to, out = IN_O, 0
                elif c == ONE:
                    to, out = DONE, 0
                elif c in (R, V, LL):
                    to, out = {R: APO_R, V: APO_V, LL: APO_L}[c], 0
            elif state in (APO_R, APO_V, APO_L):
                if c == (LL if state == APO_L else E):
                    to, out = DONE, 0
                else:
                    # It was no contraction: the apostrophe ended, and a run of letters began.
                    out = BEFORE | (0 if c in letters else HERE)
            go[state, c], emit[state, c] = to, out
    return go, emit


def classes() -> np.ndarray:
    """The class of every code point."""
    kinds = {"L": L, "N": N}
    t = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], O) for c in range(0x110000)), np.uint8, 0x110000)
    # The code points with the White_Space property, and the letters of contractions.
    t[[9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = W
    t[0x20], t[0x27] = SP, A
    for c, k in zip("stmdrvle", (ONE, ONE, ONE, ONE, R, V, LL, E), strict=True):
        t[ord(c)] = k
    return t


class Lanes:
    """Runs a transducer over a stream by state maps and a prefix scan."""

    def __init__(self, go: np.ndarray, emit: np.ndarray, width: int = 256):
        self.states, self.symbols = go.shape
        self.go, self.emit, self.width = go.ravel(), emit.ravel(), width

    def run(self, stream: np.ndarray, start: int = 0, pad: int = END) -> np.ndarray:
        """The emission at each place of the stream."""
        lanes = -(-len(stream) // self.width)
        x = np.full(lanes * self.width, pad, np.uint8)
        x[: len(stream)] = stream
        x = np.ascontiguousarray(x.reshape(lanes, self.width).T)
        maps = np.repeat(np.arange(self.states, dtype=np.uint8)[:, None], lanes, 1)
        for t in range(self.width):
            maps = self.go[maps.astype(np.int16) * self.symbols + x[t]]
            if t % 8 == 7 and len(maps) > 1 and (maps == maps[:1]).all():
                maps = maps[:1]  # no lane remembers its start
        if len(maps) == 1:
            maps = np.repeat(maps, self.states, 0)
        d = 1
        while d < lanes:  # after this, maps[:, k] is the map of lanes 0 .. k
            maps[:, d:] = np.take_along_axis(maps[:, d:], maps[:, :-d].astype(np.int64), 0)
            d *= 2
        state = np.full(lanes, start, np.uint8)
        state[1:] = maps[start, :-1]
        out = np.empty((self.width, lanes), np.uint8)
        for t in range(self.width):
            at = state.astype(np.int16) * self.symbols + x[t]
            out[t] = self.emit[at]
            state = self.go[at]
        return out.T.ravel()[: len(stream)]


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


NEVER = 1 << 30


class Merges:
    """The merges of a vocabulary as a transducer over bytes; ``count`` gives the tokens of a word arc."""

    def __init__(self, merges: list, most: int = 200_000):
        letters = byte_letters()
        names: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.parts: list[tuple[int, int] | None] = [None] * 256
        self.rank: dict[tuple[int, int], int] = {}
        made = [-1] * 256  # the rank of the merge that makes a token
        for rank, pair in enumerate(merges):
            left, right = (bytes(letters[c] for c in x) for x in (pair if isinstance(pair, list) else pair.split(" ")))
            if left not in names or right not in names:
                raise ValueError("a merge is of a token that no earlier merge makes")
            two = names[left], names[right]
            self.rank[two] = rank
            if left + right not in names:
                names[left + right] = len(self.parts)
                self.parts.append(two)
                made.append(rank)
        # The tokens along the border of a token, each with the rank of the merge that takes it in.
        self.last, self.first = [], []
        for t, two in enumerate(self.parts):
            self.last.append([(t, NEVER)] + ([(x, min(r, made[t])) for x, r in self.last[two[1]]] if two else []))
            self.first.append([(t, NEVER)] + ([(x, min(r, made[t])) for x, r in self.first[two[0]]] if two else []))
        # A trie of the tokens that their own merges make: a node is (children, token or None).
        self.root: list = [{}, None]
        for name, t in names.items():
            if t < 256 or not self.crossed(*self.parts[t], made[t]):
                node = self.root
                for b in name:
                    node = node[0].setdefault(b, [{}, None])
                node[1] = t
        self.most, self.pairs = most, {}
        self.clear()

    def crossed(self, left: int, right: int, before: int = NEVER) -> bool:
        """Whether a merge across the border of two tokens comes before those that made them, and before a rank."""
        rank = self.rank
        for a, until_a in self.last[left]:
            for b, until_b in self.first[right]:
                r = rank.get((a, b), NEVER)
                if r < before and r < until_a and r <= until_b:
                    return True
        return False

    def clear(self) -> None:
        start = ((self.root, -1, 0),)
        self.numbers = {self.key(start): 0}
        self.states, self.go = [start], [{}]

    @staticmethod
    def key(state) -> tuple:
        return tuple((id(node), last, n) for node, last, n in state)

    def step(self, state: int, byte: int) -> tuple[int, int]:
        """Compiles a transition: the next state, and the tokens that the arc has more."""
        alive, found = [], None
        for node, last, n in self.states[state]:
            child = node[0].get(byte)
            if child is not None:
                t = child[1]
                if t is not None and found is None:
                    if last < 0:
                        found = t, n
                    else:
                        ok = self.pairs.get((last, t))
                        if ok is None:
                            ok = self.pairs[last, t] = not self.crossed(last, t)
                        if ok:
                            found = t, n
                if child[0]:
                    alive.append((child, last, n))
        if found is None:
            raise ValueError("these merges have no single last token")
        token, n = found
        more = n + 1  # counts are kept relative to the place that has been reached
        to = tuple([(node, last, k - more) for node, last, k in alive] + [(self.root, token, 0)])
        key = self.key(to)
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(to)
            self.go.append({})
        self.go[state][byte] = number, more
        return number, more

    def count(self, word: bytes) -> int:
        if len(self.states) > self.most:
            self.clear()
        if len(self.pairs) > 4 * self.most:
            self.pairs.clear()
        go, state, total = self.go, 0, 0
        for k, b in enumerate(word):
            to = go[state].get(b)
            if to is None:
                to = self.step(state, b)
                if len(self.states) > 2 * self.most:  # a very long arc: go on from where it is
                    here = self.states[to[0]]
                    self.clear()
                    self.states.append(here), self.go.append({})
                    self.numbers[self.key(here)] = 1
                    to, go = (1, to[1]), self.go
            state, more = to
            total += more
        return total


class Arcs:
    """The tokens of word arcs; those that aren't known are read by the merges' transducer."""

    def __init__(self, read, most: int = 300_000):
        self.read, self.most, self.known = read, most, {}

    def values(self, h: np.ndarray, text_of) -> np.ndarray:
        _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        if len(self.known) > self.most:
            self.known.clear()
        known, read, out = self.known, self.read, []
        for i in first.tolist():
            word = text_of(i)
            n = known.get(word)
            if n is None:
                n = read(word.encode())
                if len(word) < 100:
                    known[word] = n
            out.append(n)
        return np.array(out, np.int64)[inverse]


class Compiled:
    """A byte-level BPE vocabulary file, compiled. ``count`` gives tokens for the documents of a column."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model, pre = spec["model"], spec["pre_tokenizer"] or {}
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        odd = any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if model["type"] != "BPE" or not plain or odd or spec["normalizer"] or any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("not a byte-level BPE vocabulary")
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.classes, self.lanes = classes(), Lanes(*transducer())
        self.arcs = Arcs(Merges(model["merges"]).count)
        rng = np.random.default_rng(5)
        self.value = rng.integers(0, 1 << 63, 0x10000, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = np.uint64(0x9E3779B97F4A7C15 | 5)
        self.unbase = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.power = np.ones(1, np.uint64)

    def count(self, column: pa.Array) -> np.ndarray:
        out = []
        for i, j, data, at in blocks(column):
            raw, cuts, skip, extra = data.tobytes(), [at], [], np.zeros(j - i, np.int64)
            for s in self.special:  # parts the text; the string itself is one token
                p = raw.find(s)
                while p >= 0:
                    d = int(np.searchsorted(at, p, "right")) - 1
                    if p + len(s) <= at[d + 1]:
                        extra[d] += 1
                        cuts.append(np.array([p, p + len(s)]))
                        skip.append(p)
                        p = raw.find(s, p + len(s))
                    else:
                        p = raw.find(s, p + 1)
            out.append(extra + self._block(raw, data, at, np.sort(np.concatenate(cuts)) if skip else at, skip))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _block(self, raw: bytes, data: np.ndarray, at: np.ndarray, cuts: np.ndarray, skip: list[int]) -> np.ndarray:
        text = raw.decode()
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        if len(code) == len(data):
            char_at, char_cuts, char_skip = at, cuts, np.array(skip, np.int64)
        else:
            chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            char_at, char_cuts, char_skip = chars[at], chars[cuts], chars[np.array(skip, np.int64)]
        # The stream has one END after each part.
        parts, ends = char_cuts[1:], np.arange(1, len(char_cuts))
        stream = np.full(len(code) + len(parts), END, np.uint8)
        place = np.arange(len(code)) + np.repeat(np.arange(len(parts)), np.diff(char_cuts))
        stream[place] = self.classes[code]
        emit = self.lanes.run(stream)
        cut = np.zeros(len(stream) + 1, bool)
        cut[:-1] = emit & HERE > 0
        cut[:-2] |= emit[1:] & BEFORE > 0
        cut[parts + ends - 1] = True  # the END itself
        s = np.flatnonzero(cut)
        e = np.append(s[1:], len(stream))
        keep = stream[s] != END
        s, e = s[keep], e[keep]
        # Back to places in the code points.
        shift = np.searchsorted(parts + ends - 1, s)
        s, e = s - shift, e - shift
        if skip:
            keep = ~np.isin(char_cuts[np.searchsorted(char_cuts, s, "right") - 1], char_skip)
            s, e = s[keep], e[keep]
        if len(self.power) <= len(code):
            n = 1 << int(len(code) + 1).bit_length()
            self.power, self.unpower = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (self.base, self.unbase))
        v = self.value[code & 0xFFFF] + (code >> 16).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)
        p = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(v * self.power[: len(code)], out=p[1:])
        h = mix((p[e] - p[s]) * self.unpower[s] + (e - s).astype(np.uint64))
        n = self.arcs.values(h, lambda k: text[s[k] : e[k]]) if len(s) else np.zeros(0, np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        return np.diff(total[np.searchsorted(s, char_at)])


class Shared:
    """What is sent out: the file. A worker compiles it once and keeps what it has compiled for its later tasks."""

    def __init__(self, spec: str):
        self.spec, self.made = spec, None

    def __getstate__(self):
        return {"spec": self.spec, "made": None}

    def compiled(self) -> Compiled:
        self.made = self.made or Compiled(self.spec)
        return self.made


def _counted(shared):
    def run(batches):
        for batch in batches:
            size = np.array(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), np.int64)
            n = shared.value.compiled().count(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size), pa.array(n), pa.array(n > LIMIT)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row; ``tokenizer`` is the path of a vocabulary file on the driver."""
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(Shared(Path(tokenizer).read_text()))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_counted(shared), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
