"""Quality classifier: random Fourier features over document statistics, ridge scores from partition-summed normal
equations, isotonic calibration.

Only the text is looked at. Statistics of all texts come from one pass over Arrow buffers with numpy; nothing but a row of
numbers per document is shuffled. The model is fitted on at most max_train labelled rows (those with the smallest
hash of their id; the bound is a parameter), and all documents are scored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, sliced, utf8, word_bounds

FEATURES = 256
MAX_TRAIN = 100_000
BINS = 512
#: Texts are measured in slices of about so many bytes, which bounds what the numbers for each byte take.
SLICE_BYTES = 1 << 20


def _classes() -> np.ndarray:
    """Byte -> class: 0 lower, 1 upper, 2 digit, 3 blank, 4 line end, 5 sentence mark, 6 other ASCII sign, 7 non-ASCII."""
    t = np.full(256, 6, np.uint8)
    t[128:] = 7
    t[97:123], t[65:91], t[48:58] = 0, 1, 2
    t[[32, 9, 11, 12]], t[[10, 13]] = 3, 4
    t[[ord(c) for c in ".,;:?'\"-()"]] = 5
    return t


CLASS = _classes()
STATISTICS = 22


def statistics(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of STATISTICS numbers for each text; an empty text has finite ones too."""
    docs = len(offsets) - 1
    out = np.zeros((docs, STATISTICS))
    if not docs:
        return out
    size = np.diff(offsets).astype(np.float64)
    kind = CLASS[body]
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets]).astype(np.float64)
    counts = np.stack([total(kind == k) for k in range(8)], 1)
    some = np.maximum(size, 1)[:, None]
    out[:, :8] = counts / some
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 7], 1)
    out[:, 8] = counts[:, 1] / letters
    starts, ends, of = word_bounds(body, offsets)
    n = np.diff(of).astype(np.float64)
    words = np.maximum(n, 1)
    per = lambda x: np.diff(np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])[of]) / words
    length = (ends - starts).astype(np.float64)
    out[:, 9] = np.minimum(per(length), 60) / 10
    out[:, 10] = np.minimum(np.sqrt(np.maximum(per(length**2) - per(length) ** 2, 0)), 60) / 10
    out[:, 11] = np.log1p(size) / 10
    out[:, 12] = np.log1p(n) / 10
    if len(starts):
        tail, head = kind[ends - 1], kind[starts]
        out[:, 13] = per(tail == 6)
        out[:, 14] = per(tail == 5)
        out[:, 15] = per(head == 1)
        out[:, 16] = per(head == 6)
        out[:, 17] = per(length == 1)
        # words by hash: how often one repeats the last, and how many are distinct
        power = np.empty(len(body) + 1, np.uint64)
        power[0] = 1
        power[1:] = np.uint64(0x9E3779B97F4A7C15)
        power = np.cumprod(power)
        inverse = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
        back = np.full(len(body) + 1, inverse, np.uint64)
        back[0] = 1
        back = np.cumprod(back)
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum((body.astype(np.uint64) + np.uint64(1)) * power[:-1], dtype=np.uint64)])
        hashes = mix((run[ends] - run[starts]) * back[starts])
        again = np.zeros(len(starts), bool)
        again[1:] = hashes[1:] == hashes[:-1]
        inner = of[:-1][of[:-1] < len(starts)]
        again[inner] = False
        out[:, 18] = per(again)
        owner = np.repeat(np.arange(docs, dtype=np.uint64), np.diff(of))
        keys = np.sort(mix(hashes ^ mix(owner + np.uint64(1))))
        fresh = np.ones(len(keys), bool)
        fresh[1:] = keys[1:] != keys[:-1]
        order = np.argsort(mix(hashes ^ mix(owner + np.uint64(1))), kind="stable")
        first = np.zeros(len(keys), bool)
        first[order[fresh]] = True
        out[:, 19] = per(first)
    lines = counts[:, 4] + 1
    out[:, 20] = np.log1p(size / lines) / 10
    out[:, 21] = counts[:, 6] / words
    out[:, 21] = np.minimum(out[:, 21], 10) / 2
    return out


def _measure(batches):
    for batch in batches:
        body, offsets = utf8(batch.column("text"))
        parts = [statistics(b, o) for _, b, o in sliced(body, offsets, SLICE_BYTES)]
        x = np.concatenate(parts) if parts else np.zeros((0, STATISTICS))
        flat = pa.array(x.ravel())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * STATISTICS, pa.int32()), flat)
        yield pa.record_batch([batch.column("id"), lists], ["id", "x"])


class Kernel:
    """Scale, random frequencies of the Gaussian kernel, ridge weights, and the isotonic steps."""

    def __init__(self, mean, deviation, width, seed):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, 1 / np.where(deviation > 1e-9, deviation, 1.0)
        self.w = rng.normal(size=(STATISTICS, FEATURES)) / width
        self.b = rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta, self.edges, self.levels = np.zeros(FEATURES + 1), np.zeros(0), np.zeros(0)

    def features(self, x):
        z = np.clip((x - self.mean) * self.scale, -8, 8)
        f = np.cos(z @ self.w + self.b) * np.sqrt(2 / FEATURES)
        return np.concatenate([f, np.ones((len(x), 1))], 1)

    def raw(self, x):
        return self.features(x) @ self.beta

    def score(self, x):
        s = self.raw(x)
        if not len(self.edges):
            return np.full(len(x), self.levels[0] if len(self.levels) else 0.5)
        return np.interp(s, self.edges, self.levels)


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def _normal(kernel):
    """Each partition's sums Z'Z and Z'y, one row."""

    def sums(batches):
        a, c, n = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for batch in batches:
            z = kernel.value.features(rows_of(batch.column("x")))
            y = batch.column("y").to_numpy(zero_copy_only=False)
            a += z.T @ z
            c += z.T @ y
            n += len(y)
        yield pa.record_batch([pa.array([a.tobytes()], pa.binary()), pa.array([c.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["a", "c", "n"])

    return sums


def _raw(kernel):
    def run(batches):
        for batch in batches:
            yield pa.record_batch([pa.array(kernel.value.raw(rows_of(batch.column("x")))), batch.column("y")], ["s", "y"])

    return run


def pool(n, ones):
    """Pool adjacent violators: a level for each bin, never falling."""
    stack: list[list[float]] = []
    for w, v in zip(n, ones):
        stack.append([w, v, 1])
        while len(stack) > 1 and stack[-2][1] * stack[-1][0] >= stack[-1][1] * stack[-2][0]:
            w2, v2, k2 = stack.pop()
            stack[-1] = [stack[-1][0] + w2, stack[-1][1] + v2, stack[-1][2] + k2]
    return np.concatenate([np.full(k, (v + 0.5) / (w + 1)) for w, v, k in stack])


def measured(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return cut(
        df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
            _measure, f"id {df.schema[id_col].dataType.simpleString()}, x array<double>"
        )
    )


def fit(stats: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, ridge: float = 1e-2, width: float = 4.0, seed: int = 7):
    """A Kernel from stats (id, x) and labels (id, y: 0 or 1; null labels are left out). At most max_train rows are
    learnt from, spread over 8 partitions whose sums are added up. Without rows of both kinds every score is the share of
    ones, or 0.5."""
    spark = stats.sparkSession
    known = labels.filter("y is not null").join(stats, "id").select(F.col("y").cast("double"), "x", F.xxhash64("id").alias("at"))
    n = known.count()
    if n > max_train:  # a share of the hashes slightly larger than wanted, of which the smallest are taken
        known = known.filter(F.col("at") < int((max_train * 1.05 / n - 0.5) * 2**64)) if max_train * 1.05 < n else known
        known = known.orderBy("at").limit(max_train)
    rows = cut(known.select("y", "x").repartition(8))
    spread = rows.select(F.posexplode("x")).groupBy("pos").agg(F.avg("col"), F.stddev_pop("col")).collect()
    share = rows.agg(F.avg("y"), F.count("*")).first()
    mean, deviation = np.zeros(STATISTICS), np.ones(STATISTICS)
    for k, m, d in spread:
        mean[k], deviation[k] = m, d
    kernel = Kernel(mean, deviation, width, seed)
    if not share[1] or share[0] in (0.0, 1.0):
        kernel.levels = np.array([0.5 if not share[1] else (share[0] * share[1] + 0.5) / (share[1] + 1)])
        return kernel
    sent = spark.sparkContext.broadcast(kernel)
    a, c = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1)
    for r in rows.mapInArrow(_normal(sent), "a binary, c binary, n long").collect():  # one row for each of 8 partitions
        a += np.frombuffer(bytes(r.a)).reshape(a.shape)
        c += np.frombuffer(bytes(r.c))
    penalty = ridge * np.eye(FEATURES + 1)
    penalty[-1, -1] = 1e-9
    kernel.beta = np.linalg.solve(a + penalty, c)
    sent = spark.sparkContext.broadcast(kernel)
    bins = (
        rows.mapInArrow(_raw(sent), "s double, y double")
        .groupBy(F.floor((F.least(F.greatest("s", F.lit(-0.5)), F.lit(1.5)) + 0.5) * (BINS / 2)).alias("bin"))
        .agg(F.avg("s").alias("s"), F.count("*").alias("n"), F.sum("y").alias("ones"))
        .orderBy("bin")
        .collect()  # at most BINS + 1 rows
    )
    kernel.edges = np.array([r.s for r in bins])
    kernel.levels = pool([r.n for r in bins], [r.ones for r in bins])
    return kernel


def scores(stats: DataFrame, kernel: Kernel) -> DataFrame:
    sent = stats.sparkSession.sparkContext.broadcast(kernel)

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column("id"), pa.array(sent.value.score(rows_of(batch.column("x"))))], ["id", "score"])

    return stats.mapInArrow(run, f"id {stats.schema['id'].dataType.simpleString()}, score double")


def held_out(column: str):
    """crc32 of the id as text, modulo 4, is 2; a null id is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == 2, F.lit(True))


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per input row: id, held_out, score (0 to 1), predicted (1 if score >= threshold, else 0).

    labels has (id, quality). Rows held out are never learnt from. Null texts count as empty; they, very long texts and
    repeated rows are each scored. Without usable labels the score is 0.5. Further columns are ignored.
    """
    stats = measured(df, id_col, text_col)
    known = labels.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col("quality").alias("y"))
    scored = scores(stats, fit(stats, known))
    return scored.select(
        F.col("id").alias(id_col),
        held_out("id").alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
