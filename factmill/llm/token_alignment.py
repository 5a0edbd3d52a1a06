"""Alignment of two tokenizers' tokens by interval coalescing, and how often the corpus links their ids.

Tokens of both tokenizers are intervals of bytes. Sorted together by start (lexsort), a running maximum of their ends
(maximum.accumulate) tells where no token reaches over: there a group begins. Inside, tokens that overlap are linked: at each
start, the tokens of A and B that lie there.

Neither tokenizer joins a byte that isn't white space with white space after it, but for few characters that the vocabulary names. So a text
is cut there into stretches, which are made distinct in each batch: a stretch is coded, checked and aligned once, and texts are put together from
what it gave. Only numbers leave the batch:

1. Each slice of a batch gives a row for each distinct id pair with the number of its texts that hold it, and a row for each text: its counts, the
   pairs it holds by their places in the slice's order, and how often. They are written as one table once. Rows are as small as texts, so what
   readers and writers hold at a time doesn't grow with the slices of a file.
2. Pairs are summed over slices. Every slice has a pair once, so no pair is hot; a pair's highest rival for the same A id comes from maxima.
3. Each slice asks for its own distinct pairs by an equi-join, gets the answers together with its texts, and sums them up for each text. What is
   moved is slices times their own distinct pairs, a few hundredths of the tokens; nothing is broadcast.
"""

from __future__ import annotations

import hashlib
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, sliced, utf8
from .word_ids import binaries

#: White space beyond ASCII, as bytes; a stretch doesn't begin after it.
WIDE_BLANK = re.compile(rb"\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2\x80[\x80-\x8f\xa8-\xaf]|\xe2\x81[\x9f-\xaf]|\xe3\x80\x80|\xef\xbb\xbf|[\x1c-\x1f]")
SLICE_BYTES = 4 << 20
AT_A_TIME = 5_000
#: An id pair as one number: A's id above so many bits of B's.
B_BITS = 20
#: Columns of the written table: a text's, then a pair's; a row has either.
TABLE = ["slice", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "held", "times", "pair", "texts"]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(printable))
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteLevel:
    """Tokenizer A: ids of stretches, and the bytes of each id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        self.t.encode_special_tokens = True
        alphabet, vocabulary = byte_alphabet(), self.t.get_vocab(with_added_tokens=False)
        self.data = [b""] * (max(self.t.get_vocab().values()) + 1)
        for entry, i in vocabulary.items():
            if all(c in alphabet for c in entry):
                self.data[i] = bytes(alphabet[c] for c in entry)

    def encode(self, stretches: list[str]) -> list[list[int]]:
        return [e.ids for e in self.t.encode_batch_fast(stretches, add_special_tokens=False)]


class Pieces:
    """Tokenizer B, which puts a space before what it is given. A stretch loses its own first space for it; others are coded behind a letter.
    joined: white space that some piece has behind another character."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.p = SentencePieceProcessor(model_file=path)
        self.data, self.joined = [], set()
        for i in range(self.p.get_piece_size()):
            piece = self.p.id_to_piece(i)
            self.joined.update(m.replace("▁", " ")[1] for m in re.findall("[^▁][▁ \t\n\v\f\r]", piece))
            byte = self.p.is_byte(i)
            self.data.append(bytes([int(piece[3:5], 16)]) if byte else b"" if self.p.is_control(i) else piece.replace("▁", " ").encode())
        self.head = self.p.encode("x")

    def encode(self, stretches: list[str]) -> list[list[int]]:
        plain = [s[0] == " " and not s.isspace() for s in stretches]
        ids = self.p.encode([s[1:] if p else "x" + s for s, p in zip(stretches, plain)], num_threads=1)
        return [i if p else i[len(self.head) :] for i, p in zip(ids, plain)]


class Pair:
    """Both tokenizers, and what is looked up by id: bytes, and how an id is written after each separator."""

    def __init__(self, path_a: str, path_b: str):
        self.first, self.second = ByteLevel(path_a), Pieces(path_b)
        self.data = [pa.array(t.data, pa.large_binary()) for t in (self.first, self.second)]
        self.sizes = [np.array([len(x) for x in t.data], np.int64) for t in (self.first, self.second)]
        n, m = map(len, self.sizes)
        self.spelled = pa.array([f"{c}{i}".encode() for c, k in ((";", n), (",", n), ("|", m), (",", m)) for i in range(k)], pa.large_binary())
        self.spelled_at = 0, n, 2 * n, 2 * n + m


@lru_cache(2)
def pair_of(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


def _coded(tokenizer, stretches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all stretches in order, and where each stretch begins (rows + 1). Few are with the tokenizer at a time, whose answers are large."""
    ids, sizes = [], []
    for at in range(0, len(stretches), AT_A_TIME):
        lists = tokenizer.encode([x.decode() for x in stretches.slice(at, AT_A_TIME).to_pylist()])
        sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        ids.append(np.fromiter(chain.from_iterable(lists), np.int32, int(sizes[-1].sum())))
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return join(ids, np.int32), np.concatenate([np.zeros(1, np.int64), np.cumsum(join(sizes, np.int64))])


def _laid(values: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The byte strings of these rows one after the other, and where each begins (rows + 1)."""
    return utf8(values.take(pa.array(rows)))


def _same(body: np.ndarray, at: np.ndarray, other: np.ndarray, other_at: np.ndarray) -> np.ndarray:
    """Which byte strings of one row equal those of the other."""
    same = np.diff(at) == np.diff(other_at)
    rows = np.flatnonzero(same)
    differ = np.concatenate([np.zeros(1, np.int64), np.cumsum(body[_picked(at, rows)] != other[_picked(other_at, rows)])])
    ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.diff(at)[rows])])
    same[rows] = np.diff(differ[ends]) == 0
    return same


def _picked(at: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The places of the items of the given rows, one row after the other."""
    size = at[rows + 1] - at[rows]
    return np.repeat(at[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())


def stretches(body: np.ndarray, offsets: np.ndarray, joined=()) -> tuple[pa.Array, np.ndarray]:
    """The stretches of all texts, each text with a space before it, and the first of each text (rows + 1). An empty text has none.
    None begins with white space that is joined to what stands before it."""
    size = np.diff(offsets)
    body = np.insert(body, offsets[:-1][size > 0], 32)
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(size + (size > 0))])
    blank = (body == 32) | ((body >= 9) & (body <= 13))
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins &= ~np.isin(body, np.array([ord(c) for c in joined], np.uint8))
    wide = np.array([m.end() for m in WIDE_BLANK.finditer(body.tobytes())], np.int64)
    begins[wide[wide < len(body)]] = False
    begins[offsets[:-1][size > 0]] = True
    starts = np.flatnonzero(begins)
    return binaries(body, np.diff(np.append(starts, len(body)))), np.searchsorted(starts, offsets)


def align(a_start, a_end, b_start, b_end) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first A, first B of each group; A, B of each link), for tokens of A and of B that tile the same bytes in order."""
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    side = np.repeat([0, 1], [len(a_start), len(b_start)])
    order = np.lexsort((side, start))
    start, end, side = start[order], end[order], side[order]
    reach = np.maximum.accumulate(end) if len(end) else end
    opens = np.ones(len(start), bool)
    opens[1:] = start[1:] >= reach[:-1]
    a, b = np.cumsum(side == 0), np.cumsum(side == 1)
    # a group begins with its first A; both tokenizers begin there, so its first B is the next one
    group = np.flatnonzero(opens & (side == 0))
    last = np.ones(len(start), bool)
    last[:-1] = start[1:] != start[:-1]
    return a[group] - 1, b[group], a[last] - 1, b[last] - 1


class Aligned:
    """What the distinct stretches of a slice give: ids, whether both tokenizers give their bytes back, groups, links, and how they are written."""

    def __init__(self, distinct: pa.Array, pair: Pair):
        body, body_at = utf8(distinct)
        ids, at, self.good = [], [], np.ones(len(distinct), bool)
        for k, t in enumerate((pair.first, pair.second)):
            found, begins = _coded(t, distinct)
            back, back_at = _laid(pair.data[k], found)
            self.good &= _same(back, back_at[begins], body, body_at)
            ids.append(found)
            at.append(begins)
        # stretches that don't come back have no tokens; bytes are counted through the others
        ids = [i[np.repeat(self.good, np.diff(x))] for i, x in zip(ids, at)]
        self.a_at, self.b_at = at = [np.concatenate([np.zeros(1, np.int64), np.cumsum(np.diff(x) * self.good)]) for x in at]
        ends = [np.cumsum(size[i]) for size, i in zip(pair.sizes, ids)]
        starts = [e - size[i] for e, size, i in zip(ends, pair.sizes, ids)]
        group_a, group_b, link_a, link_b = align(starts[0], ends[0], starts[1], ends[1])
        self.group_at, self.link_at = np.searchsorted(group_a, self.a_at), np.searchsorted(link_a, self.a_at)
        self.links = ids[0][link_a].astype(np.int64) << B_BITS | ids[1][link_b]
        # a group's tokens of A stand before its tokens of B
        place = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        for side, (mine, i) in enumerate(zip((group_a, group_b), ids)):
            opens = np.zeros(len(i), np.int64)
            opens[mine] = 1
            group = np.cumsum(opens) - 1
            before = group_b[group] if side == 0 else np.append(group_a[1:], len(ids[0]))[group]
            place[np.arange(len(i)) + before] = np.where(opens == 1, pair.spelled_at[2 * side], pair.spelled_at[2 * side + 1]) + i
        text, text_at = _laid(pair.spelled, place)
        self.written = binaries(text, np.diff(text_at[self.a_at + self.b_at]))


def _slices(path_a: str, path_b: str, slice_bytes: int):
    def run(batches):
        number, pair = TaskContext.get().partitionId() << 32, pair_of(path_a, path_b)
        for batch in batches:
            keys = batch.column(0)
            for first, part, at in sliced(*utf8(batch.column(1)), slice_bytes):
                docs = len(at) - 1
                whole, of = stretches(part, at, pair.second.joined)
                coded = whole.dictionary_encode()
                code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                got = Aligned(coded.dictionary, pair)
                doc = np.repeat(np.arange(docs), np.diff(of))
                good = np.ones(docs, bool)
                good[doc[~got.good[code]]] = False
                kept = good[doc]
                code, doc = code[kept], doc[kept]
                sizes = [np.bincount(doc, np.diff(x)[code], docs).astype(np.int64) for x in (got.a_at, got.b_at, got.group_at, got.link_at)]
                text, text_at = _laid(got.written, code)
                ends = text_at[np.searchsorted(doc, np.arange(docs + 1))].tolist()
                digests = [hashlib.sha256(text[i + 1 : j]).hexdigest() if j > i else "" for i, j in zip(ends[:-1], ends[1:])]
                del text
                # each text's distinct stretches, then its distinct pairs, with how often
                uses, times = np.unique(doc * max(len(got.written), 1) + code, return_counts=True)
                owner, used = uses // max(len(got.written), 1), uses % max(len(got.written), 1)
                pairs, number_of = np.unique(got.links, return_inverse=True)
                rank = number_of[_picked(got.link_at, used)]
                size = np.diff(got.link_at)[used]
                held, place = np.unique(np.repeat(owner, size) * max(len(pairs), 1) + rank, return_inverse=True)
                often = np.bincount(place, np.repeat(times, size), len(held)).astype(np.int64)
                owner, rank = held // max(len(pairs), 1), held % max(len(pairs), 1)
                at = pa.array(np.searchsorted(owner, np.arange(docs + 1)).astype(np.int32))
                lists = (pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (rank, often))
                own = [keys.slice(first, docs), *map(pa.array, sizes), pa.array(digests, pa.string()), *lists]
                asked = [pa.array(pairs), pa.array(np.bincount(rank, minlength=len(pairs)).astype(np.int32))]
                none = lambda columns, n: [pa.nulls(n, c.type) for c in columns]
                for n, columns in ((len(pairs), none(own, len(pairs)) + asked), (docs, own + none(asked, docs))):
                    if n:
                        yield pa.record_batch([pa.array(np.full(n, number)), *columns], TABLE)
                number += 1

    return run


def _answered(id_col: str):
    """The rows of a slice's texts, from what they hold and the answers to the slice's pairs."""
    names = [id_col, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        # all pairs of the slice are answered, so a pair's place is its place in order
        order = np.argsort(right.column("pair").to_numpy())
        count, best = (right.column(n).to_numpy()[order].astype(np.int64) for n in ("count", "best"))
        held, times = (left.column(n).combine_chunks() for n in ("held", "times"))
        at = np.concatenate([np.zeros(1, np.int64), np.cumsum(held.value_lengths().to_numpy())])
        held, times = (x.flatten().to_numpy().astype(np.int64) for x in (held, times))
        total = lambda x: np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(x)])[at])
        own = [left.column(n) for n in TABLE[1:6]]
        return pa.table([*own, pa.array(total(times * best[held])), pa.array(total(times * count[held])), left.column("groups")], names)

    return run


def token_alignment(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """One row per input row: id, n_a and n_b (tokens of the byte-level and of the piece tokenizer), n_groups, n_links, n_best (links whose
    pair is in as many texts as any of its A id), count_sum (over links, the texts that hold the pair), groups_sha256.

    Null and empty texts, and texts that either tokenizer doesn't give back byte by byte, have no tokens: zeros and an empty digest. Very long
    texts are a slice of their own, in memory in proportion to their length. Rows that repeat count and are returned each; an empty table
    gives an empty result; further columns are ignored. A lost executor's slices are read again from the written table.
    """
    spark, kind = df.sparkSession, df.schema[id_col].dataType.simpleString()
    schema = f"slice long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, held array<int>, times array<int>, pair long, texts int"
    folder = fresh_path(spark, "alignment")
    df.select(F.col(id_col), F.col(text_col)).mapInArrow(_slices(path_a, path_b, slice_bytes), schema).write.parquet(folder)
    asked = spark.read.schema(schema).parquet(folder).filter("pair IS NOT NULL").select("slice", "pair", "texts")
    counts = asked.groupBy("pair").agg(F.sum("texts").alias("count"))
    a_id = F.shiftright("pair", B_BITS)
    most = counts.groupBy(a_id.alias("a")).agg(F.max("count").alias("most"))
    judged = counts.join(most, a_id == F.col("a")).select("pair", "count", (F.col("count") == F.col("most")).alias("best"))
    answers = asked.select("slice", "pair").join(judged.hint("shuffle_hash"), "pair")
    out = f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    texts = spark.read.schema(schema).parquet(folder).filter("pair IS NULL").drop("pair", "texts")
    return texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_answered(id_col), out)
