"""Positions of documents that cross a shuffle by content hash, as compact blocks of numbers.

Both substring operators ask, for hashed pieces of text, which documents hold the same piece. A task packs the (hash, document,
position) of its batch into one block for each bucket of hashes. Of a piece that several documents of a batch hold, only the
smallest document's entry goes to the bucket, marked as repeated; the others are known to be repeated already and pass
through. So a piece that a third of all documents share costs one entry a batch, not one a document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix

#: Rows of a shuffle: a bucket, whether the payload passes through, the payload.
BLOCKS = "bucket long, direct boolean, payload binary"
#: Places found in documents, packed for a bucket of documents: a row for each document would be as many as documents times buckets.
#: A tag tells apart documents that share an id but not a text.
FOUND = "home long, payload binary"
KEY_BYTES = 12  # about what an entry costs, to size buckets


def keyed_documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key (the id, never null, so that both joins can share one shuffle of the texts), tag, doc_id, text (null: empty)."""
    text, doc = F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long")
    tag = F.xxhash64(text).bitwiseAND(F.lit(0xFFFF)).cast("int")
    return df.select(F.coalesce(doc, F.lit(-(1 << 63))).alias("key"), tag.alias("tag"), doc.alias("doc_id"), text.alias("text"))


@dataclass
class Entries:
    """Entries sorted by document, then position. doc indexes ids and tags."""

    ids: np.ndarray
    tags: np.ndarray
    doc: np.ndarray
    pos: np.ndarray
    keys: tuple = ()
    flag: np.ndarray | None = None

    def take(self, at: np.ndarray) -> Entries:
        flag = None if self.flag is None else self.flag[at]
        return Entries(self.ids, self.tags, self.doc[at], self.pos[at], tuple(k[at] for k in self.keys), flag)

    def pack(self) -> bytes:
        first = np.append(True, self.doc[1:] != self.doc[:-1]) if len(self.doc) else np.zeros(0, bool)
        own = self.doc[first]
        step = self.pos.astype(np.int64)
        step[1:] -= np.where(first[1:], 0, self.pos[:-1])
        flag = self.flag if self.flag is not None else np.zeros(len(self.doc), bool)
        ids = self.ids[own].astype("<i8")
        return b"".join(
            [np.array([len(own), len(self.doc), len(self.keys)], "<i8").tobytes(), np.diff(ids, prepend=np.int64(0)).astype("<i8").tobytes()]
            + [self.tags[own].astype("<u2").tobytes(), np.packbits(first).tobytes(), np.packbits(flag).tobytes()]
            + [(step >> k & 0xFFFF).astype("<u2").tobytes() for k in (0, 16, 32)]
            + [k.astype("<u8").tobytes() for k in self.keys]
        )

    @staticmethod
    def unpack(data: bytes) -> Entries:
        docs, n, keys = np.frombuffer(data, "<i8", 3).tolist()
        at = 24

        def read(kind, count):
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        ids, tags = np.cumsum(read("<i8", docs)), read("<u2", docs)
        first = np.unpackbits(read("u1", -(-n // 8)), count=n).astype(bool)
        flag = np.unpackbits(read("u1", -(-n // 8)), count=n).astype(bool)
        step = sum(read("<u2", n).astype(np.int64) << k for k in (0, 16, 32))
        doc = np.cumsum(first) - 1
        total = np.cumsum(step)
        pos = total - (total - step)[first][doc]
        return Entries(ids, tags, doc, pos, tuple(read("<u8", n) for _ in range(keys)), flag)

    @staticmethod
    def concat(parts: list[Entries]) -> Entries:
        base = np.cumsum([0] + [len(p.ids) for p in parts])
        cat = lambda name, kind: np.concatenate([getattr(p, name) for p in parts] or [np.zeros(0, kind)])
        return Entries(
            cat("ids", np.int64),
            cat("tags", np.uint16),
            np.concatenate([p.doc + b for p, b in zip(parts, base)] or [np.zeros(0, np.int64)]),
            cat("pos", np.int64),
            tuple(np.concatenate(k) for k in zip(*(p.keys for p in parts))),
            cat("flag", bool),
        )


def grouped(e: Entries):
    """Order that sorts entries by their keys, and for each entry (in that order): its group, whether its document is the group's
    smallest, and whether the group has several documents."""
    order = np.argsort(e.keys[0], kind="stable") if len(e.keys) == 1 else np.lexsort(e.keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in e.keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    begins = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    ids = e.ids[e.doc[order]]
    if not len(order):
        return order, group, np.zeros(0, bool), np.zeros(0, bool), begins
    least, most = np.minimum.reduceat(ids, begins), np.maximum.reduceat(ids, begins)
    return order, group, ids == least[group], (most > least)[group], begins


def ship(e: Entries, buckets: int):
    """Rows of BLOCKS for a batch's entries."""
    if not len(e.doc):
        return []
    order, _, smallest, several, _ = grouped(e)
    e.flag = np.zeros(len(e.doc), bool)
    e.flag[order] = several
    keep = np.zeros(len(e.doc), bool)
    keep[order] = smallest
    rows = []
    if not keep.all():
        rest = e.take(np.flatnonzero(~keep))
        rest.keys = ()
        rows.append((int(rest.ids[rest.doc[0]]) % buckets, True, rest.pack()))
    at = np.flatnonzero(keep)
    bucket = ((e.keys[0][at] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0))
    for a, b in zip(edges, np.append(edges[1:], len(order))):
        rows.append((int(bucket[order[a]]), False, e.take(at[order[a:b]]).pack()))
    return rows


def blocks_batch(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 3
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.bool_(), pa.binary()))], ["bucket", "direct", "payload"])


def found_batch(parts: list[Entries], buckets: int) -> pa.Table:
    """FOUND rows: what was found, packed for each bucket of documents."""
    parts = [p for p in parts if len(p.doc)]
    if not parts:
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary())], ["home", "payload"])
    for p in parts:
        p.keys = ()
    e = Entries.concat(parts)
    home = (mix(e.ids.astype(np.uint64) ^ mix(e.tags.astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)[e.doc]
    order = np.lexsort((e.pos, e.doc, home))
    edges = np.flatnonzero(np.append(True, np.diff(home[order]) != 0))
    rows = [e.take(order[x:y]).pack() for x, y in zip(edges, np.append(edges[1:], len(order)))]
    return pa.table([pa.array(home[order[edges]]), pa.array(rows, pa.binary())], ["home", "payload"])


def meet(blocks: DataFrame, choose, buckets: int) -> DataFrame:
    """FOUND rows of what choose(entries of a bucket) returns as indexes, and of what passes through."""

    def run(group: pa.Table) -> pa.Table:
        direct, mine = [], []
        for passes, payload in zip(group.column("direct").to_pylist(), group.column("payload")):
            (direct if passes else mine).append(Entries.unpack(payload.as_py()))
        e = Entries.concat(mine)
        return found_batch([*direct, e.take(np.sort(choose(e)))] if len(e.doc) else direct, buckets)

    return blocks.groupBy("bucket").applyInArrow(run, FOUND)


def by_document(found: DataFrame) -> DataFrame:
    """key, tag, places: one row for each document with a place."""

    def run(group: pa.Table) -> pa.Table:
        e = Entries.concat([Entries.unpack(x.as_py()) for x in group.column("payload")])
        ids, tags = e.ids[e.doc], e.tags[e.doc]
        order = np.lexsort((e.pos, tags, ids))
        ids, tags, pos = ids[order], tags[order], e.pos[order].astype("<i8")
        begins = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1])))
        places = [pos[x:y].tobytes() for x, y in zip(begins, np.append(begins[1:], len(pos)))]
        return pa.table([pa.array(ids[begins], pa.int64()), pa.array(tags[begins], pa.int32()), pa.array(places, pa.binary())], ["key", "tag", "places"])

    return found.groupBy("home").applyInArrow(run, "key long, tag int, places binary")


def repeated(e: Entries) -> np.ndarray:
    """Entries whose piece several documents hold."""
    order, group, _, several, begins = grouped(e)
    marked = np.logical_or.reduceat(e.flag[order], begins)[group]
    return order[several | marked]


def not_first(e: Entries) -> np.ndarray:
    """Entries whose piece a smaller document holds."""
    order, _, smallest, _, _ = grouped(e)
    return order[~smallest]


def places_of(column: pa.Array, row: int) -> np.ndarray:
    """Sorted positions of a row of by_document; none where it is null."""
    value = column[row].as_py()
    return np.unique(np.frombuffer(value, "<i8")) if value else np.zeros(0, np.int64)


def blend(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring pieces from their hashes."""
    x = a * np.uint64(0x9FB21C651E98DF25) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def run_hashes(unit: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of `length` units (hashes themselves), by doubling."""
    if len(unit) < length:
        return np.zeros(0, np.uint64)
    have, out, done, size = unit, None, 0, 1
    while True:
        if length & size:
            piece = have[done : done + len(unit) - length + 1]
            out = piece if out is None else blend(out, piece)
            done += size
        if done == length:
            return out if size > 1 or length > 1 else out.copy()
        have = blend(have[: len(have) - size], have[size:])
        size *= 2
