"""Suffix-array deduplication by merging shard Burrows-Wheeler transforms.

Byte strings of 50 that repeat between documents lie in segments: runs of window starts that share the least hash of a 24-byte
piece in the window. Equal windows have equal least hashes, so a segment whose hash no other document has holds nothing that
repeats, and the others meet by hash. Segments are made distinct before they move.

Hashes only route: segments count as equal by their bytes, and everything else that repeats is read from the transforms. What meets is
a collection of distinct segments. It is cut into shards; each shard's suffixes are sorted and give its
Burrows-Wheeler transform. The transforms are merged by refining one interleave: reading every shard's next symbols in the
present order and sorting stably by them orders the merged suffixes by that many more symbols, without comparing suffixes
again. A round takes two symbols at once. The round in which two neighbours part gives their common prefix; after 50 symbols
neighbours that never parted form the repeated intervals, each with its smallest document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, mix, sliced, text_bytes, utf8
from .positions import BLOCKS, FOUND, Entries, blocks_batch, by_document, found_batch, grouped, keyed_documents, meet, places_of, repeated, run_hashes, ship
from .substring_dedup import _identity

WINDOW, PIECE = 50, 24
#: A segment is cut after so many windows, so that periodic texts give no long ones.
MOST_WINDOWS = 64
BUCKET_BYTES = 6 << 20
SLICE_BYTES = 1 << 20
SHARD_BYTES, COLLECTION_BYTES = 1 << 17, 8 << 20
#: Ends a segment. No UTF-8 text has this byte.
END = 0xFF

BYTE_HASH = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def segments(body: np.ndarray, offsets: np.ndarray):
    """(text, first window start within it, windows, least hash) of all segments, in order."""
    none = np.zeros(0, np.int64)
    if len(body) < WINDOW:
        return none, none, none, np.zeros(0, np.uint64)
    least = run_hashes(BYTE_HASH[body], PIECE)
    span, size = WINDOW - PIECE + 1, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < span:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    whole = np.arange(len(least)) + WINDOW <= offsets[1:][text]
    new = np.append(True, (least[1:] != least[:-1]) | (text[1:] != text[:-1]) | (whole[1:] != whole[:-1]))
    begins = np.flatnonzero(new)
    sizes = np.diff(np.append(begins, len(least)))
    parts = -(-sizes // MOST_WINDOWS)
    if (parts > 1).any():
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        begins, sizes = np.repeat(begins, parts) + nth * MOST_WINDOWS, np.minimum(np.repeat(sizes, parts) - nth * MOST_WINDOWS, MOST_WINDOWS)
    keep = whole[begins]
    begins, sizes = begins[keep], sizes[keep]
    return text[begins], begins - offsets[:-1][text[begins]], sizes, least[begins]


def _candidates(buckets: int):
    def run(batches):
        for batch in batches:
            ids, tags, valid = _identity(batch)
            docs, places, keys = [], [], []
            for first, body, offsets in sliced(*utf8(batch.column("text")), SLICE_BYTES):
                text, at, _, least = segments(body, offsets)
                keep = valid[first + text]
                docs.append(first + text[keep])
                places.append(at[keep])
                keys.append(least[keep])
            if docs:
                yield blocks_batch(ship(Entries(ids, tags, np.concatenate(docs), np.concatenate(places), (mix(np.concatenate(keys)),)), buckets))

    return run


def _pair(places, windows):
    """Start and number of windows of a segment in one number."""
    return places * 128 + windows


def _segments(buckets: int):
    """Candidate segments with their bytes. A segment that several documents of the batch hold goes out once, for the smallest;
    in the others all its windows repeat."""
    import zstandard

    def run(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            ids, tags, _ = _identity(batch)
            docs, places, keys, content, data, number = [], [], [], [], [], {}
            for first, body, offsets in sliced(*utf8(batch.column("text")), SLICE_BYTES):
                text, at, size, least = segments(body, offsets)
                wanted = np.zeros(len(text), bool)
                begin = np.searchsorted(text, np.arange(len(offsets)))
                for k in range(len(offsets) - 1):
                    a, b = begin[k], begin[k + 1]
                    wanted[a:b] = np.isin(at[a:b], places_of(batch.column("places"), first + k), assume_unique=False)
                text, at, size, least = text[wanted], at[wanted], size[wanted], least[wanted]
                raw = body.tobytes()
                from_ = (offsets[:-1][text] + at).tolist()
                pieces = [raw[a : a + n] for a, n in zip(from_, (size + WINDOW - 1).tolist())]
                docs.append(first + text)
                places.append(_pair(at, size))
                keys.append(mix(least))
                content.append(_numbers(pieces, number))
                data += pieces
            if not docs:
                continue
            e = Entries(ids, tags, *map(np.concatenate, (docs, places)), tuple(map(np.concatenate, (keys, content))))
            if not len(e.doc):
                continue
            order, _, smallest, _, _ = grouped(e)
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
                mine = at[order[a:b]]
                part = e.take(mine)
                part.keys = ()  # the hash follows from the bytes
                head = part.pack()
                rows.append((int(bucket[order[a]]), False, len(head).to_bytes(8, "little") + head + packer.compress(b"".join([data[i] for i in mine.tolist()]))))
            yield blocks_batch(rows)

    return run


def suffix_array(text: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of END-closed strings by at least their first `depth` symbols; a suffix stops at its END, and
    ENDs rank by the string they close. Ranks of 8 symbols are doubled."""
    n = len(text)
    closing = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=-1))
    room = ends[closing] - np.arange(n)  # symbols before the suffix's END
    padded = np.append(text, np.zeros(8, np.uint8))
    word = np.ndarray((n,), ">u8", padded, strides=(1,)).astype(np.uint64)
    inside = np.minimum(room + 1, 8)  # END included, what follows isn't
    word &= ~np.uint64(0) << ((8 - inside) * 8).astype(np.uint64)

    def ranked(key):
        order = np.argsort(key)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.append(False, key[order[1:]] != key[order[:-1]]))
        return rank, order

    rank, order = ranked(word)
    rank, order = ranked((rank << 31) + np.where(room < 8, closing, 0))
    size = 8
    while size < depth and rank[order[-1]] < n - 1:
        ahead = np.zeros(n, np.int64)
        far = np.flatnonzero(room >= size)
        ahead[far] = rank[far + size] + 1
        rank, order = ranked((rank << 31) + ahead)
        size *= 2
    return order


class Shard:
    """Strings with their suffix order and Burrows-Wheeler transform: the `step` symbols before each suffix as one number, those
    before a string's start being its last ones. All that begin with END count as one symbol, as END ranks by string."""

    def __init__(self, strings: list[bytes], depth: int, step: int):
        self.text = np.frombuffer(b"".join(s + b"\xff" for s in strings), np.uint8)
        self.begins = np.cumsum([0] + [len(s) + 1 for s in strings])[:-1]
        self.ends = np.append(self.begins[1:], len(self.text)) - 1
        self.order = suffix_array(self.text, self.ends, depth)
        before = np.arange(-1, len(self.text) - 1)
        before[self.begins] = self.ends
        at = before[self.order]
        self.bwt = self.text[at].astype(np.uint16)
        if step == 2:
            first = self.text[before[at]].astype(np.uint16)
            self.bwt = np.where(first == END, END << 8, first << 8 | self.bwt).astype(np.uint16)


def merge(shards: list[Shard], depth: int, step: int):
    """Interleave of the shards' suffixes (shard of each merged place) and common prefix with the place before, in whole steps and
    up to depth."""
    count = len(shards)
    symbols = np.concatenate([s.bwt for s in shards])
    total = len(symbols)
    shard = np.repeat(np.arange(count, dtype=np.min_scalar_type(max(count - 1, 1))), [len(s.bwt) for s in shards])
    head = np.sort(symbols, kind="stable")  # the first symbols of the merged suffixes: the same in every round
    has_end = lambda x: ((x >> 8) == END) | ((x & 0xFF) == END) if step == 2 else x == END
    closed, mine = np.flatnonzero(has_end(head)), has_end(symbols)
    ends = shard[mine][np.lexsort((shard[mine], symbols[mine]))]  # suffixes that reach their END rank by string, so by shard
    other = np.append(True, head[1:] != head[:-1])
    other[closed] = True
    z, block, prefix, known = shard, np.zeros(total, np.int32), np.full(total, depth, np.int32), np.zeros(total, bool)
    read = np.empty(total, np.uint16)
    for k in range(0, depth, step):
        if count > 1:
            read[np.argsort(z, kind="stable")] = symbols  # each shard's symbols in its own order
        else:
            read = symbols
        order = np.argsort(read, kind="stable")
        z_next, from_block = z[order], block[order]
        z_next[closed] = ends
        apart = other.copy()
        apart[1:] |= from_block[1:] != from_block[:-1]
        fresh = apart & ~known
        prefix[fresh] = k
        known |= apart
        next_block = np.cumsum(apart, dtype=np.int32)
        settled = k > 0 and not fresh.any() and (z_next == z).all()
        z, block = z_next, next_block
        if settled:
            break
    return z, prefix


def repeated_intervals(strings: list[bytes], window: int = WINDOW, shard_bytes: int = SHARD_BYTES):
    """For each window of the strings: (string, place within it, interval), windows of one interval being equal."""
    shards, waiting, held, base, first, step = [], [], 0, [], 0, 2 - window % 2
    for i, s in enumerate(strings):
        waiting.append(s)
        held += len(s) + 1
        if held >= shard_bytes or i == len(strings) - 1:
            shards.append(Shard(waiting, window, step))
            base.append(first)
            first, waiting, held = i + 1, [], 0
    if not shards:
        return (np.zeros(0, np.int64),) * 3
    z, prefix = merge(shards, window, step)
    interval = np.cumsum(prefix < window)
    string, place, of = [], [], []
    for k, s in enumerate(shards):
        mine = interval[z == k]
        owner = np.repeat(np.arange(len(s.ends)), np.diff(s.ends, prepend=-1))[s.order]
        whole = s.order + window <= s.ends[owner]
        string.append(base[k] + owner[whole])
        place.append((s.order - s.begins[owner])[whole])
        of.append(mine[whole])
    return tuple(map(np.concatenate, (string, place, of)))


def _numbers(pieces: list[bytes], number: dict) -> np.ndarray:
    """A number for each piece, the same for equal bytes alone."""
    return np.fromiter((number.setdefault(p, len(number)) for p in pieces), np.uint64, len(pieces))


def _split_payload(data: bytes):
    """Entries with the hash that brought them together, and the bytes of each."""
    import zstandard

    size = int.from_bytes(data[:8], "little")
    e = Entries.unpack(data[8 : 8 + size])
    raw = zstandard.ZstdDecompressor().decompress(data[8 + size :]) if len(e.doc) else b""
    lengths = (e.pos & 127) + WINDOW - 1
    at = np.cumsum(lengths) - lengths
    pieces = [raw[a : a + n] for a, n in zip(at.tolist(), lengths.tolist())]
    runs = np.append(run_hashes(BYTE_HASH[np.frombuffer(raw, np.uint8)], PIECE), ~np.uint64(0))
    least = np.minimum.reduceat(runs, np.stack([at, at + WINDOW - PIECE + 1], 1).ravel())[::2]
    e.keys = (mix(least),)
    return e, pieces


def _decide(group: pa.Table, buckets: int, shard_bytes: int) -> pa.Table:
    """Segments of a bucket -> windows that a smaller document holds, as runs (start, windows)."""
    direct, parts, content = [], [], []
    for passes, payload in zip(group.column("direct").to_pylist(), group.column("payload")):
        if passes:
            direct.append(Entries.unpack(payload.as_py()))
        else:
            e, pieces = _split_payload(payload.as_py())
            parts.append(e)
            content += pieces
    if not parts:
        return found_batch(direct, buckets)
    e = Entries.concat(parts)
    e.keys = (e.keys[0], _numbers(content, {}))
    order, group_of, smallest, _, begins = grouped(e)
    out = e.take(np.sort(order[~smallest]))  # all windows of an equal segment of a smaller document
    direct.append(out)
    # distinct segments that share their hash with others: only their windows need the transforms
    key = e.keys[0][order[begins]]
    runs = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
    own = order[smallest]
    own_group = group_of[smallest]
    edges = np.searchsorted(own_group, np.arange(len(key) + 1))
    waiting, held = [], 0
    for a, b in zip(runs[:-1].tolist(), runs[1:].tolist()):
        if b - a > 1:
            waiting += range(a, b)
            held += sum(len(content[order[begins[g]]]) for g in range(a, b))
        if waiting and (held > COLLECTION_BYTES or b == len(key)):
            strings = [content[order[begins[g]]] for g in waiting]
            least = np.array([e.ids[e.doc[order[begins[g]]]] for g in waiting])
            least = np.array([e.ids[e.doc[own[edges[g]]]] for g in waiting]) if len(own) else least
            string, place, of = repeated_intervals(strings, WINDOW, shard_bytes)
            by = np.argsort(of, kind="stable")
            string, place, of = string[by], place[by], of[by]
            head = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            low = np.minimum.reduceat(least[string], head)[np.cumsum(np.append(True, of[1:] != of[:-1])) - 1]
            late = least[string] > low
            if late.any():
                s, p = string[late], place[late]
                by = np.lexsort((p, s))
                s, p = s[by], p[by]
                doc, pos = [], []
                for g, x in zip(np.split(s, np.flatnonzero(np.diff(s)) + 1), np.split(p, np.flatnonzero(np.diff(s)) + 1)):
                    for i in own[edges[waiting[g[0]]] : edges[waiting[g[0]] + 1]].tolist():
                        doc.append(np.full(len(x), e.doc[i]))
                        pos.append(_pair((e.pos[i] >> 7) + x, 1))
                doc, pos = np.concatenate(doc), np.concatenate(pos)
                by = np.lexsort((pos, doc))
                direct.append(Entries(e.ids, e.tags, doc[by], pos[by], (), np.zeros(len(by), bool)))
            waiting, held = [], 0
    return found_batch(direct, buckets)


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _removed(with_bytes: bool):
    def run(batches):
        for batch in batches:
            body, offsets = utf8(batch.column("text"))
            data, rows = body.tobytes(), []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                marks = places_of(batch.column("places"), k)
                start, end = marks >> 7, (marks >> 7) + (marks & 127) + WINDOW - 1
                if len(start):
                    by = np.argsort(start, kind="stable")
                    start, reach = start[by], np.maximum.accumulate(end[by])
                    new = np.append(True, start[1:] > reach[:-1])
                    start, end = start[new], reach[np.append(np.flatnonzero(new)[1:], len(reach)) - 1]
                left, at = [], a
                for x, y in zip(start.tolist(), end.tolist()):
                    left.append(data[at : a + x])
                    at = a + y
                left = b"".join([*left, data[at:b]])
                rows.append((b - a, b - a - len(left), len(start), hashlib.sha256(left).hexdigest(), left if with_bytes else None))
            columns = list(zip(*rows)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], KEPT.replace(",", "").split()[::2])

    return run


def drop_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_bytes: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes that stay, if with_bytes).

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller id; strings are judged on the
    input. Null counts as empty; texts under 50 bytes lose nothing. Rows without an id, and rows that share an id, don't take
    anything from one another. An empty table gives an empty result; further columns are ignored.
    """
    docs = keyed_documents(df, id_col, text_col)
    total = text_bytes(df, text_col)
    buckets = buckets_for(total, 8 * BUCKET_BYTES // 6)
    found = meet(docs.mapInArrow(_candidates(buckets), BLOCKS), repeated, buckets)
    placed = docs.repartition("key", "tag")
    hit = placed.join(by_document(found).hint("shuffle_hash"), ["key", "tag"])
    shard_bytes = SHARD_BYTES
    windows = hit.mapInArrow(_segments(buckets), BLOCKS).groupBy("bucket").applyInArrow(lambda group: _decide(group, buckets, shard_bytes), FOUND)
    marked = placed.join(by_document(windows).hint("shuffle_hash"), ["key", "tag"], "left")
    out = marked.mapInArrow(_removed(with_bytes), KEPT)
    return (out if with_bytes else out.drop("kept")).withColumnRenamed("doc_id", id_col)
