"""Periodic runs by an online, sparse dynamic programme over diagonals.

The diagonal of a lag d holds the words that equal the word d places before them. A run of smallest period q is a stretch of q more
words than its diagonal has; four periods of it are 3q words of that diagonal one after the other. A word's earlier occurrences
name the diagonals that it lengthens. Most occurrences can never matter, so words are looked at together with the words after
them: lags fall into scales of (W, 3W + 3], each with windows of 3W + 3 words. Inside a run whose period lies in a scale,
the nearest earlier occurrence of each window is exactly one period back (a stretch of at least one smallest period recurs at
its multiples only), and the first window of the run has none there. So each word lengthens at most one diagonal a scale, its
match length grows by one from word to word, and it is emitted as soon as a word continues another diagonal or none, if it is
long enough. Lags of a smaller period's multiples are never the nearest ones, so what is emitted has its smallest period.

Windows that occur once in a text drop out of all longer scales, which leaves little to do after the first scales of prose; a text
that is one word over and over takes one diagonal. Windows are found by 64-bit hashes; what they emit is compared word by word.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, sliced, utf8
from .word_ids import numbers, recurring, words_of

#: A run has at least so many periods, and at least so many words. The windows of the first scale rest on both numbers.
PERIODS, LEAST = 4, 6
FIRST = LEAST - 1
SLICE_BYTES = 2 << 20
BASE = 0x9E3779B97F4A7C15

RUNS = "array<struct<start:long,length:long,period:long>>"
RUNS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Windows:
    """Hashes of all windows of one length, by prefix sums over the words' numbers."""

    def __init__(self, ids: np.ndarray):
        power = np.full(len(ids) + 1, BASE, np.uint64)
        back = np.full(len(ids) + 1, pow(BASE, -1, 1 << 64), np.uint64)
        power[0] = back[0] = 1
        self.back = np.cumprod(back)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)) * np.cumprod(power)[:-1], dtype=np.uint64)])

    def of(self, at: np.ndarray, length: int) -> np.ndarray:
        return mix((self.sums[at + length] - self.sums[at]) * self.back[at])


def _short_lags(ids: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, nearest lag) for lags up to FIRST, whose diagonals are compared outright. last: the last word of the window's text."""
    lag = np.zeros(len(ids), np.int64)
    for d in range(min(FIRST, len(ids) - 1), 0, -1):
        same = np.zeros(len(ids) + FIRST, bool)
        same[d : len(ids)] = (ids[d:] == ids[:-d]) & (last[d:] == last[:-d])
        window = same[: len(ids)].copy()
        for k in range(1, FIRST):
            window &= same[k : len(ids) + k]
        lag[window & (np.arange(len(ids)) + FIRST - 1 <= last)] = d
    at = np.flatnonzero(lag)
    return at, lag[at]


def _ended(at: np.ndarray, lag: np.ndarray, window: int, above: int):
    """Runs (start, length, period) of the diagonals that neighbouring windows with one lag lengthen."""
    fits = (lag > above) & (lag <= window)
    at, lag = at[fits], lag[fits]
    if not len(at):
        return np.zeros((0, 3), np.int64)
    ends = np.append((at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1]), True)
    stop = np.flatnonzero(ends)
    begin = np.append(0, stop[:-1] + 1)
    period = lag[begin]
    matches = at[stop] - at[begin] + window
    long = matches + period >= np.maximum(LEAST, PERIODS * period)
    return np.stack([at[begin] - period, matches + period, period], 1)[long]


def runs_of(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    """All runs of the texts whose words are numbered ids, as rows (start in ids, length, period), by start, then period."""
    size = np.diff(of)
    last = np.repeat(of[1:] - 1, size)
    found = [_ended(*_short_lags(ids, last), FIRST, 0)] if len(ids) else []
    above, window = FIRST, (PERIODS - 1) * (FIRST + 1)
    at, hashes = np.flatnonzero(np.repeat(size, size) >= PERIODS * (above + 1)), None
    while len(at := at[at + window - 1 <= last[at]]):
        hashes = hashes or Windows(ids)
        at, now, before = recurring(hashes.of(at, window), at, last)
        found.append(_ended(now, now - before, window, above))
        above, window = window, (PERIODS - 1) * (window + 1)
        at = at[np.diff(of)[np.searchsorted(of, at, "right") - 1] >= PERIODS * (above + 1)]
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    right = [np.array_equal(ids[s : s + n - q], ids[s + q : s + n]) for s, n, q in runs.tolist()]
    runs = runs[np.array(right, bool)]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _detect(arrange):
    def run(batches):
        for batch in batches:
            body, offsets = utf8(batch.column(1))
            keys = batch.column(0)
            for first, part, at in sliced(body, offsets, SLICE_BYTES):
                words, of = words_of(part, at)
                docs = len(at) - 1
                source = np.arange(len(words))
                if arrange is not None:
                    for k, key in enumerate(keys.slice(first, docs).to_pylist()):
                        moved = arrange(key, int(of[k + 1] - of[k]))
                        if moved is not None:
                            source[of[k] : of[k + 1]] = of[k] + moved
                runs = runs_of(numbers(words)[source], of)
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, runs[:, 0] + runs[:, 2], 1)
                np.add.at(gone, runs[:, 0] + runs[:, 1], -1)
                kept = np.cumsum(gone[:-1]) == 0
                left = np.concatenate([np.zeros(1, np.int64), np.cumsum(kept)])[of]
                texts = pc.binary_join(pa.LargeListArray.from_arrays(left, words.take(pa.array(source[kept]))), pa.scalar(b" ", pa.large_binary()))
                doc = np.searchsorted(of, runs[:, 0], "right") - 1
                columns = [pa.array(x) for x in (runs[:, 0] - of[doc], runs[:, 1], runs[:, 2])]
                of_doc = pa.array(np.searchsorted(doc, np.arange(docs + 1)), pa.int32())
                lists = pa.ListArray.from_arrays(of_doc, pa.StructArray.from_arrays(columns, fields=list(RUNS_ARROW.value_type)))
                yield pa.record_batch([keys.slice(first, docs), pa.array(np.diff(of)), lists, texts.cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrange: Callable | None = None) -> DataFrame:
    """One row per input row: id, n_words, runs (start, length, period; by start, then period), collapsed (the words that no run
    contains after its first period, joined by one space).

    A run is a maximal stretch of at least four times its smallest period and six words. Stretches that overlap are each a run.
    arrange(id, n), if given, returns the numbers of the words to put in the places of the n words, or None to leave a text as it is.
    Null and blank texts have no words, no runs and an empty text. Very long texts are read whole, in memory in proportion to their
    length; rows that repeat are each returned; an empty table gives an empty result; further columns are ignored. There is no shuffle.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_detect(arrange), f"id {kind}, n_words long, runs {RUNS}, collapsed string")
    return rows.withColumnRenamed("id", id_col) if id_col != "id" else rows
