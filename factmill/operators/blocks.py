"""Top-k search in blocks: an inverted index and vectors, with bounds that leave blocks and postings unread.

Rows are gathered into blocks where they are read, one a batch, without a shuffle. A block knows how much any of its rows can score:
the largest weight of each token, or the centre of its vectors and their greatest distance from it. Queries are packed by a
few thousand. Blocks and packs meet on a grid: a block goes to one row of it, a pack to one column, so neither a token nor a route is a key
by itself, and a large side is dealt over many tasks.

First each query gets the block with its greatest bound (bounds alone are read); what it finds there is its floor. Then the
other blocks are searched, but those whose bound is under the floor. Each block returns its k best of a query, so a shuffle
moves k rows for each query and searched block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factmill.functions.batches import bounded_batches

#: Characters of texts that are counted at once.
COUNTED = 1 << 20
#: Queries in a pack, and the sides of the grid on which blocks and packs meet.
PACK, ROWS, COLUMNS = 2000, 32, 32
#: Rounded scores may lie so much above what bounds say.
SLACK = 1e-6
NONE = np.zeros(0, np.int64)


def token_id(token: str) -> int:
    """The same id as functions.text.token_id."""
    return int(hashlib.sha256(token.encode()).hexdigest()[:8], 16) % 2147483000 + 1


def counted_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, token id, weight) of each token [a-z0-9]+ of each lower-case text, by text and id; a text without tokens has the id 1 with
    weight 1. Weights are round(1 + ln(1 + n), 6). Texts are counted by slices, as what is held meanwhile is many times their size."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    edges = np.append(np.flatnonzero(np.diff(sizes // COUNTED, prepend=0)), len(texts))
    out, a = [(NONE, NONE, np.zeros(0))], 0
    for b in edges.tolist():
        if b > a:
            row, token, weight = _counted(texts.slice(a, b - a).to_pylist())
            out.append((row + a, token, weight))
            a = b
    return tuple(map(np.concatenate, zip(*out)))


def _counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    data = [(t or "").lower().encode() for t in texts]
    body, ends = np.frombuffer(b"\n".join(data) + b"\n", np.uint8), np.cumsum([len(d) + 1 for d in data])
    solid = ((body >= 48) & (body <= 57)) | ((body >= 97) & (body <= 122))
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    offsets = np.concatenate([[0], np.cumsum(stops - starts)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(body[solid]))]).dictionary_encode()
    ids = np.array([token_id(t) for t in found.dictionary.to_pylist()], np.int64)
    keys = np.searchsorted(ends, starts, "right") << 32 | (ids[found.indices.to_numpy()] if len(ids) else NONE)
    keys, n = np.unique(keys, return_counts=True)
    bare = np.setdiff1d(np.arange(len(texts)), keys >> 32)
    keys = np.concatenate([keys, bare << 32 | 1])
    weights = np.concatenate([np.round(1 + np.log1p(n.astype(np.float64)), 6), np.ones(len(bare))])
    order = np.argsort(keys)
    return keys[order] >> 32, keys[order] & 0xFFFFFFFF, weights[order]


def token_weights(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, token_id, weight = round(1 + ln(1 + n), 6) of each token; a text without tokens has (1, 1.0). Counted where texts are read."""

    def run(batches):
        for batch in batches:
            row, token, weight = counted_tokens(batch.column(1))
            yield pa.record_batch([batch.column(0).take(pa.array(row)), pa.array(token), pa.array(weight)], [key, "token_id", "weight"])

    bounded_batches(df.sparkSession)
    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, token_id long, weight double")


def _lists(*columns):
    """One row that holds whole columns."""
    return [pa.array([c]) for c in columns]


def _rows(batches):
    """Rows as dicts, in which arrays of numbers stay numpy arrays, with the schema."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {}
            for name in batch.schema.names:
                value = batch.column(name)[i]
                flat = pa.types.is_list(value.type) and pa.types.is_primitive(value.type.value_type) and name != "items"
                row[name] = value.values.to_numpy() if flat else value.as_py()
            yield row, batch.schema


def _asked_kind(schema: pa.Schema, query: str) -> pa.DataType:
    return schema.field("asked").type.value_type.field(query).type


def _begins(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1])) if len(sorted_values) else NONE


def sparse_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row for each batch of texts: block, items, tokens (distinct), most (their largest weights), starts, rows and weights (postings)."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            row, token, weight = counted_tokens(batch.column(1))
            if not len(row):
                continue
            order = np.argsort(token, kind="stable")
            row, token, weight = row[order], token[order], weight[order]
            at = _begins(token)
            most = np.maximum.reduceat(weight, at)
            items = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
            yield pa.record_batch([pa.array([block]), items, *_lists(token[at], most, np.append(at, len(row)), row, weight)], ["block", "items", "tokens", "most", "starts", "rows", "weights"])
            block += 1

    return df.select(key, text).mapInArrow(run, f"block long, items array<{kind}>, tokens array<long>, most array<double>, starts array<long>, rows array<long>, weights array<double>")


def _packs_for(queries: DataFrame) -> int:
    return max(1, -(-queries.count() // PACK))


def _packed(queries: DataFrame, key: str, columns: list[str], by: list[str], packs: int) -> DataFrame:
    """Rows of about PACK queries each at most: pack, asked (array of structs), for each value of the columns `by`."""
    return queries.groupBy(*by, F.pmod(F.xxhash64(key), F.lit(packs)).alias("pack")).agg(F.collect_list(F.struct(key, *columns)).alias("asked"))


def _meet(blocks: DataFrame, packed: DataFrame, route: list[str], packs: int) -> DataFrame:
    """Every block with every pack of its route, on a grid of ROWS by at most COLUMNS."""
    columns, each = min(packs, COLUMNS), lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = blocks.withColumn("row", F.pmod(F.xxhash64("block"), F.lit(ROWS)).cast("int")).withColumn("column", each(columns))
    asked = packed.withColumn("column", F.pmod("pack", F.lit(columns)).cast("int")).withColumn("row", each(ROWS))
    return dealt.join(asked, [*route, "row", "column"])


def _searched(pairs: DataFrame, search: Callable, query_kind: str, item_kind: str, query: str, item: str) -> DataFrame:
    """Rows (query, item, score, read) that search(block row, asked rows) yields."""

    def run(batches):
        for row, schema in _rows(batches):
            out = list(search(row))
            kinds = [_asked_kind(schema, query), schema.field("items").type.value_type, pa.float64(), pa.int64()]
            if out:
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], [query, item, "score", "read"])

    return pairs.mapInArrow(run, f"{query} {query_kind}, {item} {item_kind}, score double, read long")


def _best(scored: DataFrame, query: str, item: str, k: int) -> DataFrame:
    w = Window.partitionBy(query).orderBy(F.desc("score"), item)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _top(scores: np.ndarray, items: list, k: int) -> list[tuple[float, object]]:
    """The k best by rounded score, then item; all that tie with the last are looked at."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
    else:
        near = np.arange(len(scores))
    return sorted(((-float(scores[i]), items[i]) for i in near))[:k]


def _sparse_scores(row: dict, tokens: np.ndarray, weights: np.ndarray, floor: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(rows of the block, their scores, postings read) of all rows that can be among the k best. Lists are taken by what they can add at most;
    when the rest can't lift a row that none of them named above the floor, only rows that are still in the race are looked up."""
    at = np.searchsorted(row["tokens"], tokens)
    at[at == len(row["tokens"])] = 0
    here = row["tokens"][at] == tokens
    at, weights = at[here], weights[here]
    can = weights * row["most"][at]
    order = np.argsort(-can)
    rest = np.append(np.cumsum(can[order][::-1])[::-1], 0.0)
    score, read = np.zeros(len(row["items"])), 0
    alive = None
    for n, j in enumerate(order):
        a, b = row["starts"][at[j]], row["starts"][at[j] + 1]
        docs, add = row["rows"][a:b], weights[j] * row["weights"][a:b]
        if alive is None:
            read += b - a
            score[docs] += add
            if n % 4 == 3 or rest[n + 1] < floor:
                if len(score) >= k:
                    floor = max(floor, np.partition(score, len(score) - k)[len(score) - k])
                if rest[n + 1] + SLACK < floor:
                    alive = np.flatnonzero(score + rest[n + 1] + SLACK >= floor)
        else:
            place = np.searchsorted(docs, alive)
            place[place == len(docs)] = 0
            hit = docs[place] == alive
            read += int(hit.sum())
            score[alive[hit]] += add[place[hit]]
            if n % 4 == 3:
                alive = alive[score[alive] + rest[n + 1] + SLACK >= floor]
    alive = np.flatnonzero(score) if alive is None else alive
    return alive, np.round(score[alive], 6), read


def _sparse_search(query: str, k: int):
    def search(row):
        for q in row["asked"]:
            found, scores, read = _sparse_scores(row, np.array(q["tokens"]), np.array(q["weights"]), q["floor"], k)
            best = _top(scores, [row["items"][i] for i in found], k)
            for n, (score, item) in enumerate(best):
                yield q[query], item, -score, read if n == 0 else 0

    return search


def _sparse_bound(row, q) -> float:
    tokens, weights = np.array(q["tokens"]), np.array(q["weights"])
    at = np.minimum(np.searchsorted(row["tokens"], tokens), len(row["tokens"]) - 1)
    return float((weights * np.where(row["tokens"][at] == tokens, row["most"][at], 0.0)).sum())


def _bounds(blocks, packed, route, packs, parts, bound: Callable, query: str, query_kind: str) -> DataFrame:
    """(query, block, bound) of each block for the queries of its route; of blocks, only the columns `parts` are read."""

    def run(batches):
        for row, schema in _rows(batches):
            out = [(q[query], row["block"], bound(row, q)) for q in row["asked"]]
            kinds = [_asked_kind(schema, query), pa.int64(), pa.float64()]
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(zip(*out), kinds)], [query, "block", "bound"])

    return _meet(blocks.select("block", *route, *parts), packed, route, packs).mapInArrow(run, f"{query} {query_kind}, block long, bound double")


def _in_blocks(blocks, queries, k, query, item, item_kind, columns, route, parts, bound, search, cut) -> DataFrame:
    """The k best of each query in every block of its route that counts: its most promising block first, then those that can reach its floor."""
    bounded_batches(blocks.sparkSession)
    kind, packs = queries.schema[query].dataType.simpleString(), _packs_for(queries)
    bounds = cut(_bounds(blocks, _packed(queries, query, columns, route, packs), route, packs, parts, bound, query, kind))
    first = bounds.groupBy(query).agg(F.max_by("block", F.struct("bound", "block")).alias("block"))
    asked = lambda pairs: _packed(pairs.join(queries, query), query, ["floor", *columns], ["block"], packs)
    run = lambda pairs: cut(_searched(blocks.join(asked(pairs), "block"), search, kind, item_kind, query, item))
    begun = run(first.withColumn("floor", F.lit(float("-inf"))))
    floors = begun.groupBy(query).agg(F.min("score").alias("least"), F.count("*").alias("n"))
    floors = floors.select(query, F.when(F.col("n") >= k, F.col("least")).otherwise(float("-inf")).alias("floor"))
    left = bounds.join(first.withColumnRenamed("block", "_first"), query).filter("block <> _first").join(floors, query, "left")
    left = left.withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))).filter(F.col("bound") + SLACK >= F.col("floor"))
    return begun.union(run(left.select(query, "block", "floor")))


def sparse_topk(queries: DataFrame, chunks: DataFrame, k: int, cut: Callable, query: str = "query_id", item: str = "chunk_id", text: str = "text") -> DataFrame:
    """query, item, score, rank: the k chunks of greatest dot product of token weights with each query, of those that share a token with it;
    ties to the smaller item. Both sides are texts. cut(df) cuts lineage (a checkpoint).

    Null and blank texts have the one token that stands for none, and so meet one another. Rows that repeat an item are each found."""
    return _best(sparse_search(queries, chunks, k, cut, query, item, text).drop("read"), query, item, k)


def sparse_search(queries: DataFrame, chunks: DataFrame, k: int, cut: Callable, query: str = "query_id", item: str = "chunk_id", text: str = "text") -> DataFrame:
    """What every searched block found (query, item, score), and how many postings it read for it (read, in its first row)."""
    asked = cut(token_weights(queries, query, text)).groupBy(query).agg(F.array_sort(F.collect_list(F.struct("token_id", "weight"))).alias("t"))
    asked = asked.select(query, F.col("t.token_id").alias("tokens"), F.col("t.weight").alias("weights"))
    blocks, kind = cut(sparse_blocks(chunks, item, text)), chunks.schema[item].dataType.simpleString()
    return _in_blocks(blocks, asked, k, query, item, kind, ["tokens", "weights"], [], ["tokens", "most"], _sparse_bound, _sparse_search(query, k), cut)


def dense_blocks(df: DataFrame, key: str, vector: str, route: str, size: int) -> DataFrame:
    """A row for each route of each batch of vectors: block, route, items, vectors (unit, row by row), centre, radius. Rows of a route are
    sorted by their likeness to the route's first vector in the batch, so that blocks of `size` rows are narrow."""
    kind, route_kind = df.schema[key].dataType.simpleString(), df.schema[route].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            of = {}
            for i, (r, v) in enumerate(zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())):
                if v is not None and r is not None:
                    of.setdefault(r, []).append((i, v))
            for r, rows in of.items():
                at, x = np.array([i for i, _ in rows]), unit(np.array([v for _, v in rows], np.float64))
                order = np.argsort(-(x @ x[0]), kind="stable")
                for a in range(0, len(order), size):
                    some = order[a : a + size]
                    centre = x[some].mean(0)
                    radius = float(np.sqrt(((x[some] - centre) ** 2).sum(1)).max())
                    items = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), batch.column(0).take(pa.array(at[some])))
                    yield pa.record_batch([pa.array([block]), pa.array([r], batch.schema.field(route).type), items, *_lists(x[some].ravel(), centre), pa.array([radius])], ["block", route, "items", "vectors", "centre", "radius"])
                    block += 1

    schema = f"block long, {route} {route_kind}, items array<{kind}>, vectors array<double>, centre array<double>, radius double"
    return df.select(key, vector, route).mapInArrow(run, schema)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x**2).sum(-1, keepdims=True))
    return np.where(norm > 0, x / np.where(norm > 0, norm, 1), x)


def _dense_bound(row, q) -> float:
    return float(unit(np.array(q["embedding"], np.float64)) @ row["centre"]) + row["radius"]


def _dense_search(query: str, k: int):
    def search(row):
        x = np.array(row["vectors"]).reshape(len(row["items"]), -1)
        scores = np.round(unit(np.array([q["embedding"] for q in row["asked"]], np.float64)) @ x.T, 6)
        for q, s in zip(row["asked"], scores):
            for n, (score, item) in enumerate(_top(s, row["items"], k)):
                yield q[query], item, -score, len(s) if n == 0 else 0

    return search


def dense_topk(queries: DataFrame, chunks: DataFrame, k: int, route: str, cut: Callable, query: str = "query_id", item: str = "chunk_id", size: int = 512) -> DataFrame:
    """query, item, score, rank: the k chunks of greatest cosine with each query among those of its route; ties to the smaller item. A vector
    of zeros has cosine 0 with all. Rows without a vector or a route take no part."""
    some = queries.filter(F.col("embedding").isNotNull() & F.col(route).isNotNull()).select(query, route, "embedding")
    blocks, kind = cut(dense_blocks(chunks, item, "embedding", route, size)), chunks.schema[item].dataType.simpleString()
    found = _in_blocks(blocks, some, k, query, item, kind, ["embedding"], [route], ["centre", "radius"], _dense_bound, _dense_search(query, k), cut)
    return _best(found.drop("read"), query, item, k)
