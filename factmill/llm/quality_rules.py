"""Quality rules: plain limits, then robust multivariate outliers by minimum covariance determinants per language and source.

1. Words, symbols, lines and repeated windows of each text are counted where it is read. Texts that break a plain limit go.
2. The others' counts become a vector of four numbers, which are rounded to a grid. Equal grid vectors of one language and source are
   counted together before they are shuffled, so a source with a third of all rows is as small as any: the grid has 1.7
   million cells. Each language and source meets its cells in one task, which stands for all of its rows.
3. There, concentration steps take the three quarters of rows that lie nearest, from which centre and covariance are taken anew, until the
   determinant no longer falls; of three deterministic starts the least determinant wins. Rows near enough to it give the final estimate.
   Spreads have a floor, so that a statistic that hardly varies (no symbols anywhere) rejects nothing by itself.
4. Each text's own vector, not its cell, is held against its estimate by its Mahalanobis distance.

A language and source with fewer than LEAST_ROWS rows shares an estimate with the others of its language that are small, and those with
all small ones where that isn't enough either. If even those are fewer, only the plain limits hold.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, sliced, utf8
from .word_ids import binaries, covered, numbers, owners, recurring, words_of

SYMBOLS = b"#*$%&|<>"
#: The plain limits: least words, and most repeated words in a hundred.
LEAST_WORDS, MOST_REPEATED = 50, 50
WINDOW = 3
#: The vector: logarithm of the mean word length, logarithm of one and the symbols in a thousand word characters, shares of repeated
#: lines and words. For each, the spread that every estimate has at least, the grid's step, and the grid's number of steps.
FLOORS = np.array([0.05, 0.5, 0.15, 0.15])
STEPS = np.array([0.02, 0.2, 0.05, 0.05])
CELLS = (200, 36, 21, 11)
KEPT_SHARE, LEAST_ROWS, MOST_STEPS = 0.75, 50, 40
#: The share of rows beyond the cut if vectors were normal.
TAIL = 1e-6
SLICE_BYTES = 2 << 20
#: A model is joined in so many copies, over which the rows of its language and source are dealt.
COPIES = 16

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VECTOR = ("v0", "v1", "v2", "v3")


def counts(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: the five counts, and how many lines have a word."""
    docs = len(offsets) - 1
    total = lambda flags: np.diff(np.concatenate([np.zeros(1, np.int64), np.cumsum(flags, dtype=np.int64)])[offsets])
    solid = ~((body == 32) | ((body >= 9) & (body <= 13)))
    words, of = words_of(body, offsets)
    chars, symbols = total(solid & ((body & 0xC0) != 0x80)), total(np.isin(body, np.frombuffer(SYMBOLS, np.uint8)))

    feed = np.flatnonzero(body == 10)
    starts, ends = np.sort(np.concatenate([offsets[:-1], feed + 1])), np.sort(np.concatenate([feed, offsets[1:]]))
    seen = np.concatenate([np.zeros(1, np.int64), np.cumsum(solid, dtype=np.int64)])
    wordy = np.flatnonzero(seen[ends] > seen[starts])
    line_doc = np.repeat(np.arange(docs), total(body == 10) + 1)[wordy]
    lines = numbers(binaries(body[body != 10], ends - starts).take(pa.array(wordy)))
    again = recurring(lines, np.arange(len(lines)), line_doc)[1]

    ids, word_doc = numbers(words), owners(of)
    at = np.flatnonzero(word_doc[: max(len(ids) - WINDOW + 1, 0)] == word_doc[WINDOW - 1 :]) if len(ids) >= WINDOW else np.zeros(0, np.int64)
    pair = ids[at] << 32 | ids[at + 1]
    small = len(ids) and int(ids.max()).bit_length() * WINDOW < 64
    keys = (ids[at] << 42 | ids[at + 1] << 21 | ids[at + 2]) if small else np.unique(pair, return_inverse=True)[1] << 32 | ids[at + 2]
    repeated = covered(recurring(keys, at, word_doc)[0], WINDOW, len(ids))
    by_doc = lambda doc: np.bincount(doc, minlength=docs)
    return np.stack([np.diff(of), chars, symbols, by_doc(line_doc[again]), by_doc(word_doc[repeated]), by_doc(line_doc)], 1)


def vectors(c: np.ndarray) -> np.ndarray:
    """The four numbers of each row of counts; finite for empty texts too."""
    n, chars, symbols, again, repeated, lines = np.maximum(c.T, 0).astype(np.float64)
    word = np.maximum(n, 1)
    return np.stack([np.log(np.maximum(chars / word, 1)), np.log1p(1000 * symbols / np.maximum(chars, 1)), again / np.maximum(lines, 1), repeated / word], 1)


def _count(batches):
    for batch in batches:
        parts = [counts(b, o) for _, b, o in sliced(*utf8(batch.column("text")), SLICE_BYTES)]
        c = np.concatenate(parts) if parts else np.zeros((0, 6), np.int64)
        columns = [*(pa.array(x) for x in c.T[:5]), *(pa.array(x) for x in vectors(c).T)]
        yield pa.record_batch([batch.column("id"), batch.column("lang"), batch.column("source"), *columns], ["id", "lang", "source", *COUNTS, *VECTOR])


def _tail(x: float, half: int) -> float:
    """How much of a chi-square distribution of 2 * half degrees lies above x."""
    return math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(half))


def chi_square(tail: float, half: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if _tail(middle, half) > tail else (low, middle)
    return high


def _spread(x, w):
    centre = w @ x / w.sum()
    away = x - centre
    return centre, (away * w[:, None]).T @ away / w.sum()


def _distances(x, centre, spread):
    away = x - centre
    return np.einsum("ij,ij->i", away @ np.linalg.inv(spread), away)


def _median(values, w):
    order = np.argsort(values, kind="stable")
    return values[order][np.searchsorted(np.cumsum(w[order]), w.sum() / 2)]


def _consistent(share: float) -> float:
    """What makes the spread of the nearest `share` of normal rows that of all."""
    return share / (1 - _tail(chi_square(1 - share, 2), 3))


def robust(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centre and inverse covariance of cells x that stand for w rows each."""
    order = np.lexsort(x.T)
    x, w, floor = x[order], w[order].astype(np.float64), np.diag(FLOORS**2)
    middle = np.array([_median(c, w) for c in x.T])
    scale = np.sqrt(np.array([1.4826 * _median(np.abs(c - m), w) for c, m in zip(x.T, middle)]) ** 2 + FLOORS**2)
    z = (x - middle) / scale
    length = np.maximum(np.sqrt((z**2).sum(1)), 1e-12)
    starts = [np.diag(scale**2)] + [np.outer(scale, scale) * _spread(s, w)[1] + floor for s in (np.tanh(z), z / length[:, None])]
    most, best = KEPT_SHARE * w.sum(), None
    for spread in starts:
        centre, least = middle, math.inf
        for _ in range(MOST_STEPS):
            near = np.argsort(_distances(x, centre, spread), kind="stable")
            taken = np.clip(most - (np.cumsum(w[near]) - w[near]), 0, w[near])  # the last cell counts in part
            centre, spread = _spread(x[near], taken)
            spread = spread + floor
            now = float(np.linalg.slogdet(spread)[1])
            if now >= least - 1e-12:
                break
            least = now
        if best is None or now < best[0] - 1e-12:
            best = (now, centre, spread)
    _, centre, spread = best
    spread = (spread - floor) * _consistent(KEPT_SHARE) + floor
    near = _distances(x, centre, spread) <= chi_square(0.025, 2)
    centre, spread = _spread(x[near], w[near])
    return centre, np.linalg.inv(spread * _consistent(0.975) + floor)


def _estimate(table: pa.Table) -> pa.Table:
    x = np.stack([table.column(c).to_numpy() for c in VECTOR], 1) * STEPS
    centre, inverse = robust(x, table.column("n").to_numpy())
    flat = lambda a: pa.array([a.ravel().tolist()], pa.list_(pa.float64()))
    return pa.table([table.column("pool_lang").slice(0, 1), table.column("pool_source").slice(0, 1), flat(centre), flat(inverse)], ["pool_lang", "pool_source", "centre", "inverse"])


def _pools(cells: DataFrame) -> DataFrame:
    """For each language and source, whose estimate it takes: its own, that of its language's small ones, or that of all small ones."""
    sizes = cells.groupBy("lang", "source").agg(F.sum("n").alias("rows"))
    small = F.col("rows") < LEAST_ROWS
    shared = sizes.filter(small).groupBy("lang").agg(F.sum("rows").alias("lang_rows"))
    of_lang = small & (F.col("lang_rows") >= LEAST_ROWS)
    named = sizes.join(shared, "lang", "left")
    return named.select(
        "lang", "source", F.when(~small | of_lang, F.col("lang")).alias("pool_lang"), F.when(~small, F.col("source")).alias("pool_source")
    )


def estimates(stats: DataFrame) -> DataFrame:
    """lang, source, centre, inverse (row by row) from rows that passed the plain limits; none where rows are too few."""
    steps = [F.least(F.round(F.col(v) / float(s)), F.lit(float(k - 1))).cast("long").alias(v) for v, s, k in zip(VECTOR, STEPS, CELLS)]
    cells = cut(stats.filter(~F.col("base_failed")).select("lang", "source", *steps).groupBy("lang", "source", *VECTOR).agg(F.count("*").alias("n")))
    pools = cut(_pools(cells))
    pooled = cells.join(pools, ["lang", "source"]).groupBy("pool_lang", "pool_source", *VECTOR).agg(F.sum("n").alias("n"))
    enough = pooled.groupBy("pool_lang", "pool_source").agg(F.sum("n").alias("rows")).filter(F.col("rows") >= LEAST_ROWS)
    same = lambda a, b: a["pool_lang"].eqNullSafe(b["pool_lang"]) & a["pool_source"].eqNullSafe(b["pool_source"])
    usable = pooled.join(enough, same(pooled, enough), "left_semi")
    models = usable.groupBy("pool_lang", "pool_source").applyInArrow(_estimate, "pool_lang string, pool_source string, centre array<double>, inverse array<double>")
    return pools.join(models, same(pools, models)).select("lang", "source", "centre", "inverse")


def quality_rules(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL
) -> DataFrame:
    """One row per input row: id, n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that equal an earlier
    one), n_repeat_words (words in three-word windows found twice or more), base_failed, distance (squared Mahalanobis distance; null where
    base_failed or without an estimate), kept.

    Null and empty texts have no words and fail the plain limits. A null language or source counts as an empty one. Very long texts are read
    whole; rows that repeat are each counted and returned; equal rows get equal verdicts, whatever the partitions; an empty table gives an
    empty result; further columns, whatever their names, are ignored. The result doesn't depend on the order of rows.
    """
    kind = df.schema[id_col].dataType.simpleString()
    label = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = df.select(F.col(id_col).alias("id"), label(lang_col, "lang"), label(source_col, "source"), F.col(text_col).alias("text"))
    longs, doubles = ", ".join(f"{c} long" for c in COUNTS), ", ".join(f"{c} double" for c in VECTOR)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    stats = cut(rows.mapInArrow(_count, f"id {kind}, lang string, source string, {longs}, {doubles}").withColumn("base_failed", failed))
    copies = estimates(stats).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))))
    dealt = stats.withColumn("copy", F.pmod(F.xxhash64("id", *VECTOR), F.lit(COPIES)).cast("int"))
    away = [F.col(v) - F.col("centre")[k] for k, v in enumerate(VECTOR)]
    square = sum((F.col("inverse")[4 * i + j] * away[i] * away[j] for i in range(4) for j in range(4)), F.lit(0.0))
    return (
        dealt.join(copies, ["lang", "source", "copy"], "left")
        .withColumn("distance", F.when(~F.col("base_failed"), square))
        .select(F.col("id").alias(id_col), *COUNTS, "base_failed", "distance", (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= chi_square(tail, 2))).alias("kept"))
    )
