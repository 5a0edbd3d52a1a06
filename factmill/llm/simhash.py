"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints are made distinct, so copies collapse before anything is compared. A fingerprint goes to one group for each of some
bit masks, keyed by its masked bits: the index's upper nodes, spread over the cluster. Inside a group fingerprints are sorted
by Gray rank, so that neighbours share bits; a leaf holds a run of them and the bits they all share, a node above holds the bits
its children share, and children keep only what is not factored out. A search goes down with the differences summed so far
and drops a whole node once they pass the radius.

The pipeline's near-duplicates come from the same index over fingerprints of shingle sets, and each pair is compared. Pairs that the index
doesn't reach, as similar sets can differ in many bits, are found exactly: such sets meet at their rarest shingles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, cut, fresh_path, tidy, utf8
from .components import components

LEAF, FAN, SLICE = 16, 8, 512


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of `width` lower-cased words, joined by a space; fewer words: of the whole sequence."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.append(0, ends[:-1] + 1)
    n = max(len(words) - width + 1, 1)
    joined = b" ".join(words)
    last = ends[width - 1 :] if len(words) >= width else ends[-1:]
    return np.fromiter((xxh64_intdigest(joined[a:b], 42) for a, b in zip(begins[:n].tolist(), last.tolist())), np.uint64, n)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is 1 if it is 1 in more than half of the hashes; no hashes: 0."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return int(np.packbits(bits.sum(0, dtype=np.int64) * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """id, fp (the 64 bits as a long)."""

    def run(batches):
        for batch in batches:
            body, at = utf8(batch.column("text"))
            data = body.tobytes()
            fps = [fingerprint(shingle_hashes(data[a:b], width)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.record_batch([batch.column("id"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["id", "fp"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def gray_rank(fp):
    """Rank of a word in the reflected Gray code; sorts as unsigned after its top bit is flipped."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """fps: uint64, sorted by Gray rank. Levels from the root down; each node has its own mask (bits not factored out above),
    its pattern and where its children begin."""

    def __init__(self, fps: np.ndarray):
        self.fps = fps
        begins = np.arange(0, len(fps), LEAF)
        shared, pattern = self._shared(fps, np.full(len(fps), ~np.uint64(0)), begins)
        levels = [(shared, pattern, np.append(begins, len(fps)))]
        while len(levels[-1][0]) > 1:
            shared, pattern, _ = levels[-1]
            begins = np.arange(0, len(shared), FAN)
            up, head = self._shared(pattern, shared, begins)
            levels.append((up, head, np.append(begins, len(shared))))
        self.levels, above = [], None
        for shared, pattern, begins in reversed(levels):
            own = shared if above is None else shared & ~np.repeat(above[0], np.diff(above[1]))
            self.levels.append((own, pattern, begins))
            above = shared, begins
        self.rest = ~np.repeat(above[0], np.diff(above[1]))  # of each fingerprint: what its leaf doesn't share

    @staticmethod
    def _shared(pattern, mask, begins):
        same = np.bitwise_and.reduceat(pattern, begins) | np.bitwise_and.reduceat(~pattern, begins)
        return same & np.bitwise_and.reduceat(mask, begins), pattern[begins]

    def search(self, queries: np.ndarray, radius: int):
        """(query number, place, differences) of all pairs within the radius."""
        q = np.arange(len(queries))
        node, gone = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)
        for depth, (own, pattern, begins) in enumerate(self.levels):
            gone = gone + np.bitwise_count((queries[q] ^ pattern[node]) & own[node])
            keep = gone <= radius
            q, node, gone = q[keep], node[keep], gone[keep]
            size = begins[node + 1] - begins[node]
            first = np.repeat(begins[node] - (np.cumsum(size) - size), size)
            q, gone, node = np.repeat(q, size), np.repeat(gone, size), first + np.arange(int(size.sum()))
        gone = gone + np.bitwise_count((queries[q] ^ self.fps[node]) & self.rest[node])
        keep = gone <= radius
        return q[keep], node[keep], gone[keep]


def _join(labels, a, b):
    """Union of pairs in an array of labels (each at most its index)."""
    while True:
        la, lb = labels[a], labels[b]
        if (la == lb).all():
            return
        low = np.minimum(la, lb)
        np.minimum.at(labels, np.maximum(la, lb), low)
        while (labels[labels] != labels).any():
            labels[:] = labels[labels]


def group_links(fps: np.ndarray, radius: int, spanning: bool):
    """Links in a group sorted by Gray rank. spanning: one edge to the smallest member of each component, so no component is
    lost; else for each fingerprint an edge to its nearest predecessor within the radius."""
    index, labels, out = GrayIndex(fps), np.arange(len(fps)), []
    for begin in range(0, len(fps), SLICE):
        q, at, gone = index.search(fps[begin : begin + SLICE], radius)
        q = q + begin
        keep = at < q
        q, at, gone = q[keep], at[keep], gone[keep]
        if spanning:
            _join(labels, q, at)
        elif len(q):
            order = np.lexsort((at, gone, q))
            q, at = q[order], at[order]
            first = np.append(True, q[1:] != q[:-1])
            out.append((q[first], at[first]))
    if spanning:
        q = np.flatnonzero(labels != np.arange(len(fps)))
        return q, labels[q]
    return (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int))


def pigeonhole_masks(radius: int, blocks: int) -> list[int]:
    """Masks of blocks - radius of the blocks each: fingerprints within the radius agree on one of them at least."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << edge[i + 1]) - (1 << edge[i])) for i in range(blocks)]
    return [sum(part[i] for i in keep) for keep in combinations(range(blocks), blocks - radius)]


def links(distinct: DataFrame, radius: int, masks: list[int], spanning: bool) -> DataFrame:
    """distinct (fp) -> edges (u, v) of fingerprints within the radius that share a mask's bits."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select(
        "fp", F.explode(F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("bits")) for i, m in enumerate(signed)))).alias("k")
    ).select("k.mask", "k.bits", "fp", gray_rank(F.col("fp")).alias("gray"))

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in (*batches, None):
            if batch is not None:
                new = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "bits", "fp")]
                held = [np.concatenate([a, b]) for a, b in zip(held, new)]
                if not len(held[0]):
                    continue
                change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
                done = change[-1] if len(change) else 0  # the last group may go on in the next batch
            else:
                done = len(held[0])
                change = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
            edges = np.concatenate([[0], change[change < done], [done]])
            u, v = [], []
            for a, b in zip(edges[:-1], edges[1:]):
                if b - a > 1:
                    fps = held[2][a:b]
                    x, y = group_links(fps.view(np.uint64), radius, spanning)
                    u.append(fps[x])
                    v.append(fps[y])
            held = [x[done:] for x in held]
            none = [np.zeros(0, np.int64)]
            yield pa.record_batch([pa.array(np.concatenate(u or none)), pa.array(np.concatenate(v or none))], ["u", "v"])

    return (
        keyed.repartition("mask", "bits")
        .sortWithinPartitions("mask", "bits", "gray")
        .select("mask", "bits", "fp")
        .mapInArrow(run, "u long, v long")
        .distinct()
    )


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: id, fingerprint (16 hex digits), component_id (smallest id reachable over links of at most
    `radius` differing bits, its own included).

    Every fingerprint links to all others within the radius: no group is capped. A null text is the empty text, whose
    fingerprint is zero and links like any other. Rows that repeat are each returned; a null id is never a component's
    smallest unless it has no other. An empty table gives an empty result; further columns are ignored.
    """
    made = cut(fingerprints(df, id_col, text_col, width))
    smallest = cut(made.groupBy("fp").agg(F.min("id").alias("least")))
    stars = components(links(smallest.select("fp"), radius, pigeonhole_masks(radius, radius + 2), True))
    rooted = smallest.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return made.join(by_fp, "fp").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


NEAR_WIDTH, NEAR_SIMILARITY = 5, 0.8
#: Near-duplicates' sets share this part of the shingles at least among the first ones that are compared to begin with.
NEAR_FIRST = 0.2
#: Differing bits within which the index looks for near-duplicates first.
NEAR_RADIUS = 3
#: Rounds that compare each group's members with one of them before the pairs still apart are compared.
NEAR_ROUNDS = 2
#: Keys at which sets meet are worked on by a task for each so many, whatever the number of shuffle partitions.
KEYS = 50_000


def _least(n, similarity):
    """Shingles that a set of n has in common with any set of at least this similarity."""
    return np.maximum(np.ceil(similarity * np.asarray(n) - 1e-9), 1).astype(np.int64)


def _similar(similarity, names):
    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b")):
                x, y = a.values.to_numpy(), b.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                total = len(x) + len(y) - both
                keep.append(total == 0 or both >= similarity * total)
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([batch.column(c).filter(mask) for c in names], names)

    return run


def _each_set(batch, width):
    body, at = utf8(batch.column("text"))
    data = body.tobytes()
    return [np.unique(shingle_hashes(data[a:b], width)) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def _lists(sets):
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64), flat.view(np.int64)


def _first_shingles(width, similarity):
    """shingle, id, need: of n shingles, of which near-duplicates share m or more, the n - m + f smallest, f being NEAR_FIRST of n:
    near-duplicates share f of the smaller set's at least."""

    def run(batches):
        for batch in batches:
            sets = _each_set(batch, width)
            n = np.array([len(s) for s in sets], np.int64)
            least = _least(n, similarity)
            first = np.minimum(n - least + _least(n, NEAR_FIRST), n)
            need = _least(least, NEAR_FIRST)  # of the smallest set it can be similar to
            _, flat = _lists([s[:k] for s, k in zip(sets, first.tolist())])
            row = pa.array(np.repeat(np.arange(len(sets)), first))
            yield pa.record_batch([pa.array(flat), batch.column("id").take(row), pa.array(need).take(row)], ["shingle", "id", "need"])

    return run


def _met_again(batches):
    """Rows whose shingle, by which they are sorted, another row has too: id, need, n."""

    def runs(table):
        s = table.column("shingle").to_numpy()
        same = s[1:] == s[:-1]
        return np.append(False, same) | np.append(same, False)

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        if last is not None:
            rows = pa.concat_tables([last, rows])
        met = runs(rows)
        if last is not None:
            met[0] |= held
        last, held = rows.slice(rows.num_rows - 1), bool(met[-1])  # the next batch may have its shingle
        met[-1] = False
        found = rows.filter(pa.array(met)).group_by(["id", "need"]).aggregate([([], "count_all")]).rename_columns(["id", "need", "n"])
        yield from found.combine_chunks().to_batches()
    if last is not None and held:
        yield from last.select(["id", "need"]).append_column("n", pa.array([1], pa.int64())).to_batches()


def _shingle_sets(width):
    """id, set (a hash of the whole set), n, shingles."""
    from hashlib import md5

    def run(batches):
        for batch in batches:
            sets = _each_set(batch, width)
            at, flat = _lists(sets)
            name = np.frombuffer(b"".join(md5(s.tobytes()).digest()[:8] for s in sets), np.int64)
            yield pa.record_batch(
                [batch.column("id"), pa.array(name), pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat))],
                ["id", "set", "n", "shingles"],
            )

    return run


def _can(similarity, a, b):
    """Whether two sets that have a key in common can be similar: no shingle before the key is common to both at the first key they share,
    so that at most the lesser rest is."""
    most = F.least(F.col(f"{a}.rest"), F.col(f"{b}.rest"))
    return most * (1 + similarity) + 1e-6 >= similarity * (F.col(f"{a}.n") + F.col(f"{b}.n"))


def _keys(sets: DataFrame, similarity: float) -> DataFrame:
    """(key, x: set, n, rest, rare): of each set's shingles, the rarest first, as many as near-duplicates must share one of. rest counts
    those from the key on that other sets have too."""
    each = sets.select("set", "n", F.explode("shingles").alias("key"))
    often = each.groupBy("key").agg(F.count("*").alias("often")).filter("often > 1")
    held = each.join(often, "key").groupBy("set").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("often", "key"))).alias("held"))
    least = F.greatest(F.ceil(F.lit(similarity) * F.col("n") - 1e-9), F.lit(1))
    held = held.withColumn("m", F.size("held")).withColumn("take", (F.col("m") - least + 1).cast("int")).filter("take > 0")
    rare = F.expr("(n - m + aggregate(held, 0D, (s, h) -> s + 1D / h.often)) / n")
    return held.withColumn("rare", rare).select("set", "n", "m", "rare", F.posexplode(F.expr("slice(held, 1, take)")).alias("pos", "h")).select(
        F.col("h.key").alias("key"), F.struct("set", "n", (F.col("m") - F.col("pos")).alias("rest"), "rare").alias("x")
    )


def indexed_links(sets: DataFrame, similarity: float, radius: int = NEAR_RADIUS) -> DataFrame:
    """sets (set, n, shingles), each once -> pairs (u, v) of sets at least so similar that the Gray-order index finds within the radius:
    to the smallest set of a fingerprint, and across the fingerprints that it links."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(x.values.to_numpy().view(np.uint64)) for x in batch.column("shingles")]
            yield pa.record_batch([batch.column("set"), pa.array(np.array(fps, np.uint64).view(np.int64))], ["set", "fp"])

    made = cut(sets.select("set", "shingles").mapInArrow(run, "set long, fp long"))
    least = cut(made.groupBy("fp").agg(F.min("set").alias("least")))
    near = links(least.select("fp"), radius, pigeonhole_masks(radius, radius + 2), False)
    at = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"{c}_set"))
    across = near.join(at("u"), "u").join(at("v"), "v").select(F.col("u_set").alias("u"), F.col("v_set").alias("v"))
    within = made.join(least, "fp").filter("set > least").select(F.col("set").alias("u"), F.col("least").alias("v"))
    return _compared(sets, across.union(within), similarity)


def _compared(sets: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (u, v, and further longs that go with them) whose sets are so similar."""
    names = pairs.columns
    side = lambda k, v: sets.select(F.col("set").alias(k), F.col("shingles").alias(v))
    near = pairs.distinct().join(side("u", "a"), "u").join(side("v", "b"), "v").select(*names, "a", "b")
    return near.mapInArrow(_similar(similarity, names), ", ".join(f"{c} long" for c in names))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (set, root) once links (u, v) between roots, or sets that had no link yet, are added. Only the roots are linked anew."""
    more = cut(components(links))
    moved = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("to")), "root", "left").select("set", F.coalesce("to", "root").alias("root"))
    new = more.select(F.col("node").alias("set"), "root").join(roots.select("set"), "set", "left_anti")
    return cut(moved.union(new))


def set_links(sets: DataFrame, similarity: float) -> DataFrame:
    """sets (set, n, shingles), each once -> (set, root) for every set that is at least so similar to another, root being the smallest
    of those that such pairs join.

    First the fingerprints' index gives pairs, each compared (indexed_links). What it doesn't reach is found exactly: sets meet at keys
    (_keys), which loses no pair. A pair is compared unless compared pairs that are similar join its sets already. In each round every key's members are compared with the one of the commonest shingles; it is then done there. What is still apart is compared
    pair by pair, members of a key's largest joined part against the rest alone.
    """
    roots = cut(components(indexed_links(sets, similarity)).select(F.col("node").alias("set"), "root"))
    keys = cut(_keys(sets, similarity))
    few = buckets_for(keys.count(), KEYS)
    keys = keys.coalesce(few)

    def opened():
        """Keys whose members aren't all joined yet, with roots."""
        known = keys.withColumn("set", F.col("x.set")).join(roots, "set", "left").select("key", "x", F.coalesce("root", "set").alias("root")).coalesce(few)
        apart = known.groupBy("key").agg(F.min_by(F.struct("x", "root"), F.struct("x.rare", "x.set")).alias("p"), F.min("root").alias("a"), F.max("root").alias("z"))
        return known.join(apart.filter("a < z").select("key", F.col("p.x").alias("p"), F.col("p.root").alias("p_root")), "key").coalesce(few)

    for _ in range(NEAR_ROUNDS):
        tidy(sets.sparkSession)
        now = cut(opened())
        pairs = now.filter(F.col("root") != F.col("p_root")).filter(_can(similarity, "x", "p"))
        pairs = pairs.select(F.col("x.set").alias("u"), F.col("p.set").alias("v"), F.col("root").alias("u_root"), F.col("p_root").alias("v_root"))
        roots = _joined(roots, _compared(sets, pairs, similarity).select(F.col("u_root").alias("u"), F.col("v_root").alias("v")))
        keys = now.filter(F.col("x.set") != F.col("p.set")).select("key", "x")
    tidy(sets.sparkSession)
    now = cut(opened().select("key", "x", "root"))
    sizes = now.groupBy("key", "root").agg(F.count("*").alias("n"))
    most = sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("most"))
    a = now.join(most, "key").filter(F.col("root") != F.col("most"))
    b = now.select("key", F.col("x").alias("y"), F.col("root").alias("y_root"))
    once = (F.col("y_root") == F.col("most")) | (F.col("x.set") < F.col("y.set"))
    rest = a.join(b, "key").filter((F.col("root") != F.col("y_root")) & once & _can(similarity, "x", "y"))
    pairs = rest.select(F.col("x.set").alias("u"), F.col("y.set").alias("v"), F.col("root").alias("u_root"), F.col("y_root").alias("v_root"))
    return _joined(roots, _compared(sets, pairs, similarity).select(F.col("u_root").alias("u"), F.col("v_root").alias("v")))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = NEAR_WIDTH, similarity: float = NEAR_SIMILARITY) -> DataFrame:
    """(id, root) for rows that belong to a group of near-duplicates of two or more; root is the group's smallest id.

    Near-duplicates are texts whose sets of word shingles have a Jaccard similarity of at least `similarity`, and what they link. No
    such pair is left out: texts too few of whose first shingles occur again are set aside, as no other can be similar; sets of the
    others meet at their rarest shingles (set_links).
    Texts without words are never near-duplicates; rows without an id take no part.
    """
    some = df.filter(F.col(id_col).isNotNull() & F.col(text_col).rlike(r"[^\x20\x09-\x0D]"))
    kind = some.schema[id_col].dataType.simpleString()
    texts = some.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    first = texts.mapInArrow(_first_shingles(width, similarity), f"shingle long, id {kind}, need long")
    again = first.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_met_again, f"id {kind}, need long, n long")
    left = cut(again.groupBy("id", "need").agg(F.sum("n").alias("n")).filter("n >= need").select("id").distinct())
    made = cut(texts.join(left.hint("shuffle_hash"), "id", "left_semi").mapInArrow(_shingle_sets(width), f"id {kind}, set long, n long, shingles array<long>"))
    del first, again
    tidy(df.sparkSession)
    least = cut(made.groupBy("set").agg(F.min("id").alias("least")))
    # texts of one set: written, so that the planner knows how few they are before it moves the sets for them
    spark, path = df.sparkSession, fresh_path(df.sparkSession, "copies")
    made.select("id", "set").join(least, "set").filter("id > least").select("id", "least").write.parquet(path)
    copies = spark.read.parquet(path)
    joined = set_links(made.join(copies.select("id"), "id", "left_anti").select("set", "n", "shingles"), similarity)
    rooted = least.join(joined, "set").select("root", "least")
    heads = cut(rooted.join(rooted.groupBy("root").agg(F.min("least").alias("top")), "root").select("least", "top"))
    across = heads.select(F.col("least").alias("u"), F.col("top").alias("v"))
    within = copies.join(heads, "least", "left").select(F.col("id").alias("u"), F.coalesce("top", "least").alias("v"))
    # stars already, unless rows of different texts share an id
    return components(across.union(within)).withColumnRenamed("node", id_col)
