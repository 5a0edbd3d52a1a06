"""Packing of tokenised documents into windows by non-negative least squares over length combinations.

1. Texts are tokenised where they are read; a document keeps its token count and the CRC-32 of the pieces it may be cut
   into: its whole windows, the remainder, and the remainder cut by its binary digits. Tokens themselves never move.
2. The histogram of remainders (fewer than `window` numbers, whatever the corpus) goes to the driver. Pairs and triples of
   lengths that fill a window exactly are its columns; non-negative least squares finds how often to repeat each.
3. Counts are rounded down to what the histogram holds; what is left is cut into powers of two and packed greedily, largest
   first. Largest-first powers of two never cross a window's end, and the last window splits into powers of two, so that
   no sequence needs padding.
4. Documents find their place from their rank among documents of the same remainder. Ranks come from a window over
   (remainder, hash bucket) plus bucket offsets, so that a very common length is ranked by many tasks.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buckets_for, cut, utf8

WINDOW, END_ID = 2048, 1
#: Lengths from which triples are made: the most frequent ones.
TRIPLE_LENGTHS = 96
MAX_WORDS = 250_000


class WordTokenizer:
    """ids of a text as the tokenizer gives them, by parts that don't influence one another: white space, and the border
    between a Latin letter and an ASCII sign that isn't an apostrophe, always end a pre-token of this kind of tokenizer."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True
        vocabulary = self.t.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    @staticmethod
    def parted(body: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The texts in lower-case ASCII with a blank at each such border, and their offsets. A letter before a character beyond ASCII keeps its
        case: the tokenizer composes it with a combining mark before it lowers, and some letters compose in lower case only."""
        if not len(body):
            return b"", offsets
        low = body | (((body >= 65) & (body <= 90)).astype(np.uint8) << 5)
        sign = ((low >= 33) & (low <= 47) | (low >= 58) & (low <= 64) | (low >= 91) & (low <= 96) | (low >= 123) & (low <= 126)) & (low != 39)
        plain = (low >= 97) & (low <= 122)
        accent = np.zeros(len(low), bool)  # the second byte of U+00C0-U+00FF without the two signs among them
        accent[1:] = (low[:-1] == 0xC3) & (low[1:] != 0x97) & (low[1:] != 0xB7)
        first = plain.copy()
        first[:-1] |= accent[1:]
        letter = plain | accent
        border = np.flatnonzero(letter[:-1] & sign[1:] | sign[:-1] & first[1:]) + 1
        alone = np.append(body[1:] < 128, True)
        return np.insert(np.where(alone, low, body), border, 32).tobytes(), offsets + np.searchsorted(border, offsets)

    def learn(self, words) -> None:
        plain, other = [], []
        for w in words:
            text = w.decode()
            (plain if text.isalpha() and text.lower().isalpha() else other).append((w, text))
        todo = iter(plain)
        while some := list(islice(todo, 2000)):
            ids = np.array(self.t.encode(" ".join(t for _, t in some), add_special_tokens=False).ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                other += some
                continue
            at = [0, *ends.tolist()]
            data = ids.tobytes()
            self.known.update((w, data[4 * a : 4 * b]) for (w, _), a, b in zip(some, at, at[1:]))
        if other:
            for (w, _), e in zip(other, self.t.encode_batch_fast([t for _, t in other], add_special_tokens=False)):
                self.known[w] = np.array(e.ids, "<u4").tobytes()

    def batch(self, body: np.ndarray, offsets: np.ndarray):
        """The ids of each text as little-endian 32-bit numbers."""
        data, at = self.parted(body, offsets)
        texts = [data[a:b].split() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        if len(self.known) > MAX_WORDS:
            self.older, self.known = self.known, {}
        missing = set().union(*texts).difference(self.known) if texts else set()
        for w in [w for w in missing if w in self.older]:
            self.known[w] = self.older[w]
            missing.discard(w)
        self.learn(missing)
        get = self.known.__getitem__
        for words in texts:
            yield b"".join(map(get, words))


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def _cuts(path: str, window: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        words, wide = tokenizer(path), 4 * window
        for batch in batches:
            n, full, rest, digits = [], [], [], []
            for data in words.batch(*utf8(batch.column("text"))):
                data += end
                n.append(len(data) // 4)
                whole = len(data) // wide * wide
                full.append(np.array([zlib.crc32(data[a : a + wide]) for a in range(0, whole, wide)], "<u4").tobytes())
                left = data[whole:]
                rest.append(zlib.crc32(left))
                size, a, out = len(left) // 4, 0, []
                for k in range(size.bit_length() - 1, -1, -1):
                    if size >> k & 1:
                        out.append(zlib.crc32(left[a : a + (4 << k)]))
                        a += 4 << k
                digits.append(np.array(out, "<u4").tobytes())
            yield pa.record_batch(
                [batch.column("id"), batch.column("tag"), pa.array(n, pa.int64()), pa.array(full, pa.binary()), pa.array(rest, pa.int64()), pa.array(digits, pa.binary())],
                ["id", "tag", "n", "full", "rest", "digits"],
            )

    return run


def combinations(histogram: np.ndarray, window: int) -> list[tuple[int, ...]]:
    """Pairs of lengths that fill the window, and triples with two of the most frequent lengths; all lengths occur."""
    have = np.flatnonzero(histogram[1:] > 0) + 1
    out = {(a, window - a) for a in have.tolist() if a <= window - a < len(histogram) and histogram[window - a]}
    common = sorted(have.tolist(), key=lambda a: (-histogram[a], a))[:TRIPLE_LENGTHS]
    for i, a in enumerate(common):
        for b in common[i:]:
            c = window - a - b
            if c > 0 and histogram[c]:
                out.add(tuple(sorted((a, b, c))))
    return sorted(out)


def repeats(columns: list[tuple[int, ...]], histogram: np.ndarray, sweeps: int = 80) -> np.ndarray:
    """Non-negative least squares by coordinate descent, rounded down and held within the histogram."""
    times = [tuple((a, c.count(a)) for a in sorted(set(c))) for c in columns]
    x, left = [0.0] * len(columns), histogram.astype(float).tolist()
    scale = max(float(histogram.max()), 1.0) if len(histogram) else 1.0
    for _ in range(sweeps):
        moved = 0.0
        for j, parts in enumerate(times):
            step = sum(m * left[a] for a, m in parts) / sum(m * m for _, m in parts)
            step = max(step, -x[j])
            if step:
                x[j] += step
                moved = max(moved, abs(step))
                for a, m in parts:
                    left[a] -= m * step
        if moved < 1e-4 * scale:
            break
    have, out = histogram.tolist(), np.zeros(len(columns), np.int64)
    for k in (0, 1):  # what rounding leaves goes to the columns that still fit
        for j, parts in enumerate(times):
            most = min(have[a] // m for a, m in parts)
            take = min(int(x[j]), most) if k == 0 else most
            out[j] += take
            for a, m in parts:
                have[a] -= m * take
    return out


class Plan:
    """Where the document of a given rank among those with its remainder goes."""

    def __init__(self, histogram: np.ndarray, window: int):
        self.window = window
        columns = combinations(histogram, window)
        x = repeats(columns, histogram)
        slots: dict[int, list] = {}
        used, sequences = [0] * len(histogram), 0
        for c, n in zip(columns, x.tolist()):
            if n:
                offset = 0
                for a in c:
                    slots.setdefault(a, []).append((used[a], sequences, offset))
                    used[a] += n
                    offset += a
                sequences += n
        self.slots = {a: tuple(np.array(v, np.int64) for v in zip(*s)) for a, s in slots.items()}
        self.used = np.array(used, np.int64)
        left = histogram - self.used
        left[:1] = 0
        self.first_rest = sequences
        self.bits = max(window.bit_length() - 1, 1)
        self.base, address = np.zeros((self.bits, len(histogram)), np.int64), 0
        for k in range(self.bits - 1, -1, -1):
            of = np.where((np.arange(len(histogram)) >> k) & 1, left, 0)
            self.base[k] = address + ((np.cumsum(of) - of) << k)
            address += int(of.sum()) << k
        self.total = address
        self.first_full = sequences + address // window + self.bits + 1
        self.before = np.cumsum(histogram) - histogram
        self.documents = int(histogram.sum())

    def rest(self, length: int, k: int, nth: int) -> tuple[int, int]:
        """Sequence and offset of the piece of 2**k of the nth document left over with this length."""
        address = int(self.base[k][length]) + (nth << k)
        sequence, offset = self.first_rest + address // self.window, address % self.window
        if address // self.window < self.total // self.window:
            return sequence, offset
        last, begin = self.total % self.window, 0  # the last window: one sequence for each of its binary digits
        for digit in range(self.bits - 1, -1, -1):
            if last >> digit & 1:
                if offset < begin + (1 << digit):
                    break
                begin += 1 << digit
                sequence += 1
        return sequence, offset - begin


def _places(plan):
    def run(batches):
        p = plan.value
        for batch in batches:
            rows = []
            of = batch.select(["id", "n", "full", "rest", "digits", "rank"]).to_pydict()
            for doc, n, full, rest, digits, rank in zip(*of.values()):
                length, whole = n % p.window, n // p.window
                index = int(p.before[length]) + rank
                for k, crc in enumerate(np.frombuffer(full, "<u4").tolist()):
                    rows.append((doc, k * p.window, p.window, crc, n, p.first_full + k * p.documents + index, 0))
                if not length:
                    continue
                start = whole * p.window
                if rank < p.used[length]:
                    begins, sequences, offsets = p.slots[length]
                    j = int(np.searchsorted(begins, rank, "right")) - 1
                    rows.append((doc, start, length, rest, n, int(sequences[j] + rank - begins[j]), int(offsets[j])))
                    continue
                nth, digit = rank - int(p.used[length]), iter(np.frombuffer(digits, "<u4").tolist())
                for k in range(length.bit_length() - 1, -1, -1):
                    if length >> k & 1:
                        rows.append((doc, start, 1 << k, next(digit), n, *p.rest(length, k, nth)))
                        start += 1 << k
            columns = list(zip(*rows)) or [()] * 7
            yield pa.record_batch(
                [pa.array(columns[0], batch.schema.field("id").type), *(pa.array(c, pa.int64()) for c in columns[1:])],
                ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    return run


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    window is a power of two. Every document ends with end_id, so a null or empty text is one token. Rows that repeat are
    packed each; rows without an id too. An empty table gives an empty result; further columns are ignored.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    made = cut(
        df.select(
            F.col(id_col).alias("id"),
            F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tag"),
            F.col(text_col).alias("text"),
        ).mapInArrow(_cuts(path, window, end_id), f"id {kind}, tag long, n long, full binary, rest long, digits binary")
    ).withColumn("length", (F.col("n") % window).cast("int"))
    histogram, documents = np.zeros(window, np.int64), 0
    for r in made.groupBy("length").count().collect():  # at most `window` rows
        histogram[r.length] = r["count"]
        documents += r["count"]
    plan = spark.sparkContext.broadcast(Plan(histogram, window))
    made = made.withColumn("bucket", F.pmod(F.xxhash64("id", "tag"), F.lit(buckets_for(documents, 20_000))))
    offsets = (
        made.groupBy("length", "bucket")
        .agg(F.count("*").alias("size"))
        .withColumn("before", F.sum("size").over(Window.partitionBy("length").orderBy("bucket")) - F.col("size"))
        .drop("size")
    )
    ranked = (
        made.withColumn("nth", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("id", "tag")))
        .join(offsets, ["length", "bucket"])
        .withColumn("rank", F.col("before") + F.col("nth") - 1)
    )
    placed = ranked.select("id", "n", "full", "rest", "digits", "rank").mapInArrow(
        _places(plan), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return placed.withColumnRenamed("id", id_col)
