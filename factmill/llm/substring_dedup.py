"""Substring deduplication by difference-cover anchors.

Words are hashed where they are read. Only positions whose number modulo 31 is in a difference cover carry an anchor, the hash of
20 words: whatever two positions a window of 50 words starts at, one anchor lies at the same place in both, so every
repeated window shares an aligned anchor. Anchors that several documents hold are extended to all windows around them; those
windows, and no others, are hashed with 128 bits and compared by document.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, merged_spans, mix, sliced, text_bytes, utf8, word_bounds
from .positions import (
    BLOCKS,
    KEY_BYTES,
    Entries,
    blocks_batch,
    by_document,
    keyed_documents,
    meet,
    not_first,
    places_of,
    repeated,
    run_hashes,
    ship,
)

WINDOW, PERIOD = 50, 31
#: A perfect difference set modulo 31.
COVER = (0, 1, 3, 8, 12, 18)
ANCHOR = WINDOW - PERIOD + 1
BUCKET_BYTES = 6 << 20
#: Texts are hashed in slices of about so many bytes.
SLICE_BYTES = 4 << 20

MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(body: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0x51ED270B) -> np.ndarray:
    """A 64-bit hash of each word, eight bytes at a time; independent for other seeds."""
    padded = np.append(body, np.zeros(8, np.uint8))
    load = np.ndarray((len(body) + 1,), "<u8", padded, strides=(1,))
    size = ends - starts
    h, at, k = mix(size.astype(np.uint64) + np.uint64(seed)), np.arange(len(starts)), 0
    while len(at):
        left = np.minimum(size[at] - k, 8)
        h[at] = mix(h[at] ^ (load[starts[at] + k] & MASKS[left]))
        k += 8
        at = at[size[at] > k]
    return h


def windows_of(hashes: np.ndarray, of: np.ndarray, length: int):
    """(text, position within it, hash) of each run of `length` words inside one text."""
    runs = run_hashes(hashes, length)
    text = np.repeat(np.arange(len(of) - 1), np.diff(of))[: len(runs)]
    inside = np.arange(len(runs)) + length <= of[1:][text]
    at = np.flatnonzero(inside)
    return text[at], at - of[:-1][text[at]], runs[at]


def _identity(batch):
    ids = batch.column("doc_id")
    return ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column("tag").to_numpy(zero_copy_only=False), ids.is_valid().to_numpy(zero_copy_only=False)


def _anchors(buckets: int):
    cover = np.zeros(PERIOD, bool)
    cover[list(COVER)] = True

    def run(batches):
        for batch in batches:
            ids, tags, valid = _identity(batch)
            docs, places, keys = [], [], []
            for first, body, offsets in sliced(*utf8(batch.column("text")), SLICE_BYTES):
                starts, ends, of = word_bounds(body, offsets)
                text, pos, h = windows_of(word_hashes(body, starts, ends), of, ANCHOR)
                keep = cover[pos % PERIOD] & valid[first + text] & (np.diff(of)[text] >= WINDOW)
                docs.append(first + text[keep])
                places.append(pos[keep])
                keys.append(h[keep])
            if docs:
                yield blocks_batch(ship(Entries(ids, tags, np.concatenate(docs), np.concatenate(places), (np.concatenate(keys),)), buckets))

    return run


def _extended(buckets: int):
    """All windows that contain a repeated anchor."""

    def run(batches):
        for batch in batches:
            ids, tags, _ = _identity(batch)
            docs, places, one, two = [], [], [], []
            for first, body, offsets in sliced(*utf8(batch.column("text")), SLICE_BYTES):
                starts, ends, of = word_bounds(body, offsets)
                hashes = word_hashes(body, starts, ends)
                n = np.diff(of)
                near = np.zeros(len(starts) + 1, np.int64)
                for k in range(len(n)):
                    a = places_of(batch.column("places"), first + k)
                    a = a[a < n[k]]
                    np.add.at(near, of[k] + np.maximum(a - (PERIOD - 1), 0), 1)
                    np.add.at(near, of[k] + np.minimum(a, n[k] - 1) + 1, -1)
                near = np.cumsum(near) > 0
                text, pos, h = windows_of(hashes, of, WINDOW)
                keep = near[of[:-1][text] + pos]
                docs.append(first + text[keep])
                places.append(pos[keep])
                one.append(h[keep])
                two.append(windows_of(word_hashes(body, starts, ends, 0x2545F4914F6CDD1D), of, WINDOW)[2][keep])
            if docs:
                yield blocks_batch(ship(Entries(ids, tags, *map(np.concatenate, (docs, places)), tuple(map(np.concatenate, (one, two)))), buckets))

    return run


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def _removed(with_text: bool):
    def run(batches):
        for batch in batches:
            body, offsets = utf8(batch.column("text"))
            data, n, gone, digest, kept = body.tobytes(), [], [], [], []
            for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                words, out = data[a:b].split(), 0
                n.append(len(words))
                begins, ends = merged_spans(places_of(batch.column("places"), k), WINDOW)
                for x, y in zip(begins[::-1].tolist(), ends[::-1].tolist()):
                    out += len(words[x:y])
                    del words[x:y]
                gone.append(out)
                left = b" ".join(words)
                digest.append(hashlib.sha256(left).hexdigest())
                kept.append((left if out else data[a:b]).decode() if with_text else None)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string()), pa.array(kept, pa.string())],
                KEPT.replace(",", "").split()[::2],
            )

    return run


def drop_repeated_windows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, and kept (the text that stays, if with_text: the
    words joined by a blank where some were removed, else the text as it was).

    A word goes if a window of 50 words that covers it also starts in a document with a smaller id; windows are judged on
    the input. Null and empty texts have no words; texts under 50 words lose none. Rows without an id, and rows that
    share an id, don't take anything from one another. An empty table gives an empty result; further columns are ignored.
    """
    docs = keyed_documents(df, id_col, text_col)
    buckets = buckets_for(text_bytes(df, text_col) // 35 * KEY_BYTES, BUCKET_BYTES)
    anchors = meet(docs.mapInArrow(_anchors(buckets), BLOCKS), repeated, buckets)
    placed = docs.repartition("key", "tag")
    hit = placed.join(by_document(anchors).hint("shuffle_hash"), ["key", "tag"])
    windows = meet(hit.mapInArrow(_extended(buckets), BLOCKS), not_first, buckets)
    marked = placed.join(by_document(windows).hint("shuffle_hash"), ["key", "tag"], "left")
    out = marked.mapInArrow(_removed(with_text), KEPT)
    return (out if with_text else out.drop("kept")).withColumnRenamed("doc_id", id_col)
