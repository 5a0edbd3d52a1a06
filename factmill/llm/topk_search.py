"""Exact top-k inner products by pivot-table elimination.

Inner products become Euclidean distances by adding one component to each candidate, sqrt(M^2 - |x|^2), and 0 to each query;
M is the largest norm. Distances from every vector to the pivots are tabled once. For a query and a candidate the largest
|d(q, p) - d(x, p)| over the pivots is a lower bound of their distance. Candidates are evaluated in the order of that bound,
until no bound left can beat the k-th best score found; what is skipped is proven not to be in the result.

Candidates are packed into groups, bounded by rows and by bytes, with their rows of the distance table; queries are packed into blocks,
with theirs, and sent to every group. The pivots are candidates themselves, so the k-th best score over them is a floor that
every group's elimination starts from. Each meeting yields at most k rows a query, which are merged. Nothing grows with the
product of rows but the work itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

PIVOTS, K = 48, 5
#: Candidates a group, at most, and its bytes; queries a block; their table of bounds is cut into slices of QUERY_SLICE queries.
GROUP_ROWS, GROUP_BYTES, BLOCK_ROWS, QUERY_SLICE = 16_384, 24 << 20, 1_024, 64


def usable(vector: str):
    """The vector isn't null, and no component is null or not finite."""
    v = F.col(vector)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return v.isNotNull() & F.coalesce(good, F.lit(False))


def _matrix(ids, vectors, width):
    """Integer vectors as a float64 matrix, padded with zeros to width."""
    out = np.zeros((len(ids), width))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    out[np.repeat(np.arange(len(ids)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _distances(x, extra, pivots):
    full = np.concatenate([x, extra[:, None]], 1)
    square = (full**2).sum(1)[:, None] + (pivots**2).sum(1)[None] - 2 * full @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def search(queries, query_rows, near, floors, table, rows, ids, far, largest, k):
    """For each query the k best candidates of a group (its own row left out) of at least its floor: rows, ids and scores, equal scores
    by the smaller id; and how many products were taken. near and far are rows of the table of pivot distances."""
    norms = (queries**2).sum(1)
    slack = 1e-6 * (largest + np.sqrt(norms.max(initial=0)) + 1)  # beyond rounding of the distances
    found, taken = [], 0
    for begin in range(0, len(queries), QUERY_SLICE):
        part = near[begin : begin + QUERY_SLICE]
        bound = np.zeros((len(part), len(table)))
        for p in range(near.shape[1]):
            np.maximum(bound, np.abs(part[:, p, None] - far[None, :, p]), out=bound)
        # a lower bound of the distance is an upper bound of the score
        bound = np.maximum(bound - slack, 0)
        upper = (norms[begin : begin + len(part), None] + largest**2 - bound**2) / 2 + 0.5
        for i in range(begin, begin + len(part)):
            mine, floor = upper[i - begin], floors[i]
            order = np.flatnonzero(mine >= floor)
            order = order[np.argsort(-mine[order], kind="stable")]
            at, size, score, row, name = 0, 4 * k, np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)
            while at < len(order) and mine[order[at]] >= floor:  # exact stopping: no bound left reaches the k-th score
                take = order[at : at + size]
                take = take[rows[take] != query_rows[i]]
                s, r, v = np.append(score, table[take] @ queries[i]), np.append(row, rows[take]), np.append(name, ids[take])
                top = np.lexsort((r, v, -s))[:k]
                score, row, name = s[top], r[top], v[top]
                if len(score) == k:
                    floor = max(floor, score[-1])
                at, size, taken = at + size, size * 2, taken + len(take)
            found.append((row, name, score))
    return found, taken


def top_k(df: DataFrame, queries, k: int = K, pivots: int = PIVOTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score: the k highest integer inner products of each query row over every other row.

    A component x counts as floor(256 * x) in double precision. queries is a Column that is true for query rows. Rows whose
    vector is null, or holds null or non-finite components, or whose id is null, take no part. Shorter vectors are padded
    with zeros; an empty vector scores 0 everywhere. Rows that share an id are rows of their own: each is a candidate, for the others too,
    and each that asks has its own k ranks. Fewer candidates than k give as many rows; an empty table none.
    """
    spark = df.sparkSession
    whole = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * 256).cast("double"))
    rows = cut(
        df.filter(usable(vector_col) & F.col(id_col).isNotNull()).select(
            F.col(id_col).cast("long").alias("id"), whole.alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row")
        )
    )
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    n, width, largest, asking = rows.agg(F.count("*"), F.max(F.size("v")), F.max(norm), F.count_if("asks")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema).withColumnRenamed("vec_id", id_col)
    largest = float(np.sqrt(largest))
    chosen = rows.orderBy(F.xxhash64("id", "row")).limit(pivots).toPandas()  # a fixed number of rows
    points = np.zeros((len(chosen), width + 1))
    for i, v in enumerate(chosen["v"]):
        points[i, : len(v)] = v
    points[:, -1] = np.sqrt(np.maximum(largest**2 - (points**2).sum(1), 0))
    shared = spark.sparkContext.broadcast(points)

    names = chosen["row"].to_numpy()

    def tabled(batches):
        """Distances of rows to the pivots, as candidates and as queries, and the k-th best score that a pivot gives."""
        for batch in batches:
            x = _matrix(batch.column("id"), batch.column("v"), width)
            far = _distances(x, np.sqrt(np.maximum(largest**2 - (x**2).sum(1), 0)), shared.value)
            near = _distances(x, np.zeros(len(x)), shared.value)
            score = x @ shared.value[:, :-1].T
            score[batch.column("row").to_numpy()[:, None] == names[None]] = -np.inf
            floor = np.sort(score, 1)[:, -k] if score.shape[1] >= k else np.full(len(x), -np.inf)
            lists = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (far, near)]
            yield pa.record_batch([*(batch.column(c) for c in ("id", "row", "v", "asks")), *lists, pa.array(floor)], ["id", "row", "v", "asks", "far", "near", "floor"])

    table = cut(rows.select("id", "row", "v", "asks").mapInArrow(tabled, "id long, row long, v array<double>, asks boolean, far binary, near binary, floor double"))
    size = max(1, min(GROUP_ROWS, GROUP_BYTES // (8 * (width + len(points) + 4))))
    groups = -(-n // size)
    held = table.groupBy(F.pmod(F.xxhash64("row"), F.lit(groups)).alias("group")).agg(F.collect_list(F.struct("id", "row", "v", "far")).alias("block"))
    asked_by = F.pmod(F.xxhash64("v", "row"), F.lit(-(-max(asking, 1) // BLOCK_ROWS)))
    asked = table.filter("asks").groupBy(asked_by.alias("asker")).agg(F.collect_list(F.struct("id", "row", "v", "near", "floor")).alias("asked"))
    asked = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<long>")))

    def meet(batches):
        for batch in batches:
            out = []
            for asked, block in zip(batch.column("asked"), batch.column("block")):
                a, b = asked.values, block.values
                q, t = (_matrix(x.field("id"), x.field("v"), width) for x in (a, b))
                qid, own = (a.field(c).to_numpy() for c in ("id", "row"))
                tables = _table(a.field("near"), len(points)), _table(b.field("far"), len(points))
                found, _ = search(q, own, tables[0], a.field("floor").to_numpy(), t, b.field("row").to_numpy(), b.field("id").to_numpy(), tables[1], largest, k)
                for mine, name, (r, v, s) in zip(own.tolist(), qid.tolist(), found):
                    out += [(mine, name, int(x), int(y), int(z)) for x, y, z in zip(r, v, s)]
            columns = list(zip(*out)) or [()] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["query_row", "query_id", "row", "vec_id", "score"])

    met = asked.join(held, "group").select("asked", "block").mapInArrow(meet, "query_row long, query_id long, row long, vec_id long, score long")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row"))
    ranked = met.withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def _table(column, pivots: int) -> np.ndarray:
    """Rows of the table of distances."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, pivots)
