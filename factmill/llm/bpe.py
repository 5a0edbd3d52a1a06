"""Byte-level BPE as a lazily determinised finite-state transducer, and streaming decoding with a UTF-8 state machine.

What the merges make of a byte string is fixed by its neighbouring pairs: a row of tokens is the result exactly when each
pair of neighbours is what its own bytes merge to. So the last token of every prefix follows from earlier prefixes, and
a boundary is settled once every way to go on passes it. A transducer state holds the last settled token and the bytes
after it; an arc reads one byte, and emits the tokens that it settles. No token is longer than the longest vocabulary entry,
which bounds the lookahead. States and arcs are made when first needed, for every piece; when there are too many, those not used
since the last such time are forgotten.

Stretches of text between blanks are made distinct in each Arrow batch, so the transducer reads each of them once; ids and texts
are put together from them by Arrow. The decoder's state machine reads every byte but those of pieces that are ASCII as a whole,
which leave its first state as it is; what a row of ids gives is remembered along with the stretch.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

MAX_STATES, MAX_PIECES, MAX_PAIRS = 220_000, 300_000, 400_000
#: Longer stretches are not remembered.
LONG = 200
BYTES = [bytes((b,)) for b in range(256)]
#: White space beyond ASCII, as bytes.
WIDE_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


class Memo(dict):
    """make(key) for recent keys, in two generations, so that its size is bounded and frequent keys stay."""

    def __init__(self, make, most, keep=lambda key: True):
        super().__init__()
        self.make, self.most, self.keep, self.old = make, most, keep, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if not self.keep(key):
                return value
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Vocabulary:
    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.open = {t[:k] for t in self.ranks for k in range(1, len(t))}  # what a longer token begins with
        self.halves: dict = {}
        self.sorted = sorted(self.ranks)
        self.pairs = Memo(self._follow, MAX_PAIRS)
        self.longer = Memo(self._longer, MAX_PAIRS)

    def parts(self, data: bytes, below: int) -> list[bytes]:
        """Merge the pair of least rank, the leftmost first, until no pair has a rank under `below`."""
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [self.ranks.get(data[i : i + 2], below) for i in range(len(data) - 1)]
        while ranks and (least := min(ranks)) < below:
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = self.ranks.get(parts[i - 1] + parts[i], below)
            if i < len(ranks):
                ranks[i] = self.ranks.get(parts[i] + parts[i + 1], below)
        return parts

    def half(self, token: int):
        """The two tokens that merge last into this one; () for a byte, None for a token that merges never make."""
        if token not in self.halves:
            data = self.tokens[token]
            parts = [self.ranks.get(p) for p in self.parts(data, token)]
            self.halves[token] = () if len(data) == 1 else tuple(parts) if len(parts) == 2 else None
        return self.halves[token]

    def _longer(self, key: tuple[int, bytes]) -> bool:
        """Whether some token that is longer than these bytes and begins with them can follow the left one."""
        left, tail = key
        i = bisect_right(self.sorted, tail)
        while i < len(self.sorted) and self.sorted[i].startswith(tail):
            if self._follow((left << 32) + self.ranks[self.sorted[i]]):
                return True
            i += 1
        return False

    def _follow(self, key: int) -> bool:
        """Whether the tokens left and right (key: left << 32 | right; left is -1 at the start) stay as they are side by side.

        Their merges are undone from the last one back, those of the right token first where ranks tie, since of equal pairs the leftmost
        merges first. At each step, the pieces that face each other must not merge before what was undone. """
        left, right = key >> 32, key & 0xFFFFFFFF
        if self.half(right) is None:
            return False
        if left < 0:
            return True
        ranks, tokens, before = self.ranks, self.tokens, 1 << 40
        while True:
            if ranks.get(tokens[left] + tokens[right], before) < before:
                return False
            inner, outer = self.half(right), self.half(left)
            if outer and (left > right or not inner):
                left, before = outer[1], left
            elif inner:
                right, before = inner[0], right + 1
            else:
                return True


class State:
    """settled: the last settled token. rest: the bytes after it. paths: each end in rest where a token may end, from small to
    large, with the tokens from rest's start to there. older: the same state of the generation before."""

    __slots__ = ("arcs", "older", "paths", "rest", "settled")

    def __init__(self, settled: int, rest: bytes, paths: list, older=None):
        self.settled, self.rest, self.paths, self.arcs, self.older = settled, rest, paths, {}, older


class Transducer:
    def __init__(self, vocabulary: Vocabulary, most: int = MAX_STATES):
        self.v, self.most, self.made = vocabulary, most, 0
        self.start, self.states, self.before = State(-1, b"", [(0, ())]), {}, {}

    def state(self, settled: int, rest: bytes, paths: list) -> State:
        key = (settled, rest)
        if (found := self.states.get(key)) is None:
            if len(self.states) >= self.most:
                for s in self.states.values():
                    s.older = None
                self.start.older, self.before, self.states = None, self.states, {}
                self.start = State(-1, b"", [(0, ())], self.start)
            found = self.states[key] = State(settled, rest, paths, self.before.get(key))
        return found

    def arc(self, state: State, byte: int):
        """The arc of a state that has none for this byte yet."""
        if state.older is not None and (known := state.older.arcs.get(byte)) is not None:
            s = known[0]
            state.arcs[byte] = found = (self.state(s.settled, s.rest, s.paths), known[1])
            return found
        self.made += 1
        v, rest, settled = self.v, state.rest + BYTES[byte], state.settled
        ranks, wider, pairs, longer, end, mine, live = v.ranks, v.open, v.pairs, v.longer, len(rest), None, []
        for step in state.paths:
            begin, path = step
            tail, left = rest[begin:], path[-1] if path else settled
            if mine is None and (token := ranks.get(tail)) is not None and pairs[(left << 32) + token]:
                mine = (*path, token)
            if tail in wider and (end - begin < 2 or longer[left, tail]):  # a longer token may still begin here
                live.append(step)
        live.append((end, mine))
        out = live[0][1]
        if out:
            for _, path in live[1:]:
                shared = min(len(out), len(path))
                while out[:shared] != path[:shared]:
                    shared -= 1
                out = out[:shared]
                if not out:
                    break
        if out:
            cut, settled, shared = sum([len(v.tokens[t]) for t in out]), out[-1], len(out)
            rest, live = rest[cut:], [(i - cut, path[shared:]) for i, path in live]
        state.arcs[byte] = found = (self.state(settled, rest, live), out)
        return found

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.v.ranks.get(piece)) is not None:
            return [whole]
        state, ids = self.start, []
        for byte in piece:
            state, out = state.arcs.get(byte) or self.arc(state, byte)
            if out:
                ids += out
        return [*ids, *state.paths[-1][1]]


class StreamDecoder:
    """Tokens in, text out: bytes of a character that isn't complete wait for the next token. A byte that can't go on is
    replaced by U+FFFD, as is what waits at the end."""

    def __init__(self, tokens: dict):
        self.tokens, self.wait, self.need, self.low, self.high = tokens, bytearray(), 0, 0x80, 0xBF

    def step(self, byte: int) -> str:
        if self.need:
            if self.low <= byte <= self.high:
                self.wait.append(byte)
                self.need, self.low, self.high = self.need - 1, 0x80, 0xBF
                return self.flush() if not self.need else ""
            self.wait.clear()
            self.need, self.low, self.high = 0, 0x80, 0xBF
            return "�" + self.step(byte)
        if byte < 0x80:
            return chr(byte)
        if 0xC2 <= byte <= 0xF4:
            self.need = 1 + (byte >= 0xE0) + (byte >= 0xF0)
            self.low = {0xE0: 0xA0, 0xF0: 0x90}.get(byte, 0x80)
            self.high = {0xED: 0x9F, 0xF4: 0x8F}.get(byte, 0xBF)
            self.wait.append(byte)
            return ""
        return "�"

    def flush(self) -> str:
        out = self.wait.decode() if not self.need else "�" if self.wait else ""
        self.wait.clear()
        self.need = 0
        return out

    def feed(self, ids) -> str:
        data = b"".join([self.tokens[i] for i in ids])
        if not self.need and data.isascii():  # ASCII leaves the first state as it is
            return data.decode()
        return "".join(map(self.step, data))


#: Of a byte: 1 for an ASCII letter, 2 for what is neither letter, digit, blank nor control character in ASCII.
LETTER, MARK = 1, 2
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = MARK


def cuts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where stretches begin, and the end of the last text: at each text, before a blank and on both sides of a line end, these
    standing alone between other characters, and between an ASCII letter and a mark after it. A match of the pattern begins at each such
    place whatever is around."""
    white = (body == 32) | ((body >= 9) & (body <= 13))
    for m in WIDE_BLANK.finditer(body):
        white[m.start() : m.end()] = True
    beside = np.zeros(len(body), bool)
    beside[1:] = white[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(body)]
    beside[inner] = False
    after = np.zeros(len(body), bool)
    after[:-1] = white[1:]
    after[inner[inner > 0] - 1] = False
    alone = white & ~beside & ~after
    line = np.flatnonzero(alone & (body == 10))
    at = np.zeros(len(body) + 1, bool)
    at[:-1] = alone & (body == 32)
    at[line] = True
    at[line + 1] = True
    kind = KIND[body]
    at[1:-1] |= (kind[:-1] == LETTER) & (kind[1:] == MARK)
    at[offsets] = True
    return np.flatnonzero(at)


class Coder:
    def __init__(self, path: str, pattern: str):
        self.v = Vocabulary(path)
        self.machine = Transducer(self.v)
        # \s of the pattern is Unicode's White_Space
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.decoder = StreamDecoder(self.v.tokens)  # whole characters leave it in its first state
        self.stretch = Memo(self._stretch, MAX_PIECES, lambda data: len(data) <= LONG)

    def _stretch(self, data: bytes) -> bytes | tuple[bytes, bytes]:
        """The decimal ids of a stretch, each with a comma after it; and what they decode to, where that isn't the stretch."""
        if data.isalpha() or data[:1] == b" " and data[1:].isalpha():  # ASCII letters are one match
            ids = self.machine.encode(data)
        else:
            ids = []
            for piece in self.pattern.findall(data.decode()):
                ids += self.machine.encode(piece.encode())
        back = (self.decoder.feed(ids) + self.decoder.flush()).encode()
        coded = "".join([f"{i}," for i in ids]).encode()
        return coded if back == data else (coded, back)

    def batch(self, column: pa.Array):
        """(ids with commas, how many, decoded bytes) of each text."""
        body, offsets = utf8(column)
        if not len(body):
            yield from ((b"", 0, b""),) * (len(offsets) - 1)
            return
        at = cuts(body, offsets)
        places = [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(body))]
        all_ = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, places).dictionary_encode()
        back = all_.dictionary.to_pylist()
        ids = [self.stretch[s] for s in back]
        for k, value in enumerate(ids):
            if type(value) is tuple:
                ids[k], back[k] = value
        first = np.searchsorted(at, offsets).tolist()
        n = np.fromiter((i.count(b",") for i in ids), np.int64, len(ids))
        count = np.append(0, np.cumsum(n[all_.indices.to_numpy()]))
        joined, ends = _laid_out(ids, all_.indices)
        back, back_ends = _laid_out(back, all_.indices)
        for a, b in zip(first[:-1], first[1:]):
            yield joined[ends[a] : max(ends[b] - 1, ends[a])], int(count[b] - count[a]), back[back_ends[a] : back_ends[b]]


def _laid_out(values, indices) -> tuple[memoryview, np.ndarray]:
    """The values at the indices, one after the other, and where each begins."""
    out = pa.array(values, pa.large_binary()).take(indices)
    _, offsets, data = out.buffers()
    return memoryview(data), np.frombuffer(offsets, np.int64)[: len(out) + 1]


@lru_cache(2)
def coder(path: str, pattern: str) -> Coder:
    gc.disable()  # states and pieces make no cycles; looking for some among so many takes longer than the rest
    return Coder(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array<int>) of each text; null counts as empty, whose ids are an empty array."""

    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            ids = [list(map(int, bytes(i).split(b","))) if n else [] for i, n, _ in c.batch(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], [id_col, "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of each id array, by the streaming decoder; null counts as empty."""

    def run(batches):
        tokens = coder(path, "").v.tokens
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                decoder = StreamDecoder(tokens)
                texts.append(decoder.feed(ids or ()) + decoder.flush())
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256.

    Null counts as empty: no tokens, and both digests are those of no bytes. Rows that repeat are each returned; an empty
    table gives an empty result. Needs no shuffle: texts are coded where they are read.
    """

    def run(batches):
        c = coder(path, pattern)
        for batch in batches:
            n, ids, back = [], [], []
            for joined, count, decoded in c.batch(batch.column(1)):
                n.append(count)
                ids.append(hashlib.sha256(joined).hexdigest())
                back.append(hashlib.sha256(decoded).hexdigest())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            yield pa.record_batch(columns, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
