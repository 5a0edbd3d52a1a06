"""Language-model scoring by a weighted backoff automaton whose counts come from the whole training corpus.

States are contexts, arcs are smoothed n-grams, and each state has a failure arc to the state of its shorter context:

* the root holds every training word with an absolutely discounted unigram probability, P(w) = (c(w) - D) / N, and one outcome
  of D V / N for unknown words;
* every training word h is a state of its own, as is the start of a text. Its arcs are all words w that follow it in the training part,
  with P(w|h) = (c(h,w) + M P(w)) / (c(h) + M); its failure arc to the root weighs M / (c(h) + M), so that every state's
  probabilities sum to 1. An unknown word leads back to the root.

States and arcs are as many as the corpus has, so no task holds them and nothing is broadcast. Each batch of texts asks for the words and
bigrams it has, each once: a question goes to a bucket by its hash, with the batch's own count of it in training texts. The bucket adds
the counts of all batches up and answers every batch in the order it asked. Batches then walk their texts once from left to right. A word or
bigram that all texts have costs one question a batch, so no key is hot. Bigrams are told apart by 64-bit hashes, words by themselves.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import buckets_for, text_bytes, utf8, word_bounds
from .positions import blend

#: D and M above.
DISCOUNT, PRIOR = 0.5, 100.0
BUCKET_BYTES = 16 << 20
#: The end of a text, and what stands before its first word; no word is empty.
END = b""
#: Rows between batches and buckets. bucket is -1 where a batch's own texts pass through.
MAIL = "batch long, bucket long, p binary, q binary, r binary, s binary"


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words (A-Z lower-cased; END is the last), each text's words and END as numbers of them, and where texts begin."""
    body, offsets = utf8(column)
    body = np.frombuffer(body.tobytes().lower(), np.uint8)
    starts, ends, first = word_bounds(body, offsets)
    solid = body[~((body == 32) | ((body >= 9) & (body <= 13)))]
    at = np.append(0, np.cumsum(ends - starts))
    each = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(solid)]).dictionary_encode()
    words = pa.concat_arrays([each.dictionary, pa.array([END], pa.large_binary())])
    ids = np.insert(each.indices.to_numpy().astype(np.int64), first[1:], len(words) - 1)
    return words, ids, first + np.arange(len(first))


def squeezed(values: np.ndarray, sort: bool = False) -> bytes:
    """Compressed numbers, byte planes apart; of sorted ones the steps."""
    import zstandard

    if sort:
        values = np.diff(values, prepend=values.dtype.type(0))
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes())


def loosened(data: bytes, kind, sort: bool = False) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    values = np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if sort else values


def _counts(batches):
    for batch in batches:
        words, ids, _ = words_of(batch.column("text"))
        yield pa.record_batch([words.cast(pa.binary()), pa.array(np.bincount(ids, minlength=len(words)))], ["word", "n"])


def _pairs(ids: np.ndarray, hashes: np.ndarray):
    """The pair at each token (the word before it and itself), the distinct pairs, their hashes, and the order of the hashes."""
    pair = np.append(len(hashes) - 1, ids[:-1]) << 32 | ids if len(ids) else ids
    distinct = np.unique(pair)
    key = blend(hashes[distinct >> 32], hashes[distinct & 0xFFFFFFFF])
    return pair, distinct, key, np.argsort(key, kind="stable")


def _edges(key: np.ndarray, buckets: int):
    """(bucket, from, to) for sorted hashes: buckets are ranges of hashes."""
    bucket = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    begin = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(key) else np.zeros(0, np.int64)
    return {int(b): (x, y) for b, x, y in zip(bucket[begin], begin.tolist(), np.append(begin[1:], len(key)).tolist())}


def _ask(buckets: int):
    def run(batches):
        import zstandard
        from xxhash import xxh64_intdigest, xxh3_64_intdigest

        part, packer = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1)
        for nth, batch in enumerate(batches):
            if not batch.num_rows:
                continue
            words, ids, at = words_of(batch.column("text"))
            learnt = np.repeat(batch.column("train").to_numpy(zero_copy_only=False), np.diff(at))
            listed = words.to_pylist()
            hashes = np.fromiter(map(xxh64_intdigest, listed), np.uint64, len(listed))
            own = np.bincount(ids[learnt], minlength=len(words))
            pair, distinct, key, order = _pairs(ids, hashes)
            seen, times = np.unique(pair[learnt], return_counts=True)
            count = np.zeros(len(distinct), np.uint32)
            count[np.searchsorted(distinct, seen)] = times
            key, count = key[order], count[order]
            del pair, distinct, seen, times, order
            by_word = np.argsort(hashes, kind="stable")
            word_key, ordered = hashes[by_word], words.take(pa.array(by_word))
            own = own[by_word].astype(np.uint32)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([batch.schema.field("id"), batch.schema.field("train")])) as out:
                out.write_batch(batch.select(["id", "train"]))
            name = xxh3_64_intdigest(f"{part} {nth} {len(ids)}".encode() + key[:1000].tobytes()) >> 1
            rows = [(name % buckets, name, -1, squeezed(hashes), squeezed(np.diff(at).astype(np.uint32)), squeezed(ids.astype(np.uint32)), sink.getvalue().to_pybytes())]
            pairs_at, words_at = _edges(key, buckets), _edges(word_key, buckets)
            for b in sorted(pairs_at.keys() | words_at.keys()):
                x, y = pairs_at.get(b, (0, 0))
                v, w = words_at.get(b, (0, 0))
                text = b" ".join(ordered[v:w].to_pylist())
                rows.append((b, name, b, squeezed(key[x:y], True), squeezed(count[x:y]), packer.compress(text), squeezed(own[v:w])))
            columns = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], ["to", "batch", "bucket", "p", "q", "r", "s"])

    return run


def _answer(group: pa.Table) -> pa.Table:
    """All questions of a bucket -> the counts for each batch, in its own order; other rows pass through."""
    import zstandard

    home = group.column("bucket").to_numpy() < 0
    own = group.filter(pa.array(~home))
    unpack = zstandard.ZstdDecompressor()
    out = [group.filter(pa.array(home)).drop_columns(["to"])]
    if own.num_rows:
        keys = [loosened(x, np.uint64, True) for x in own.column("p").to_pylist()]
        count = np.concatenate([loosened(x, np.uint32) for x in own.column("q").to_pylist()]).astype(np.int64)
        own_count = [loosened(x, np.uint32) for x in own.column("s").to_pylist()]
        key, of = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(of, count, minlength=len(key)).astype(np.uint64)[of]
        words = [unpack.decompress(x).split(b" ") if len(n) else [] for x, n in zip(own.column("r").to_pylist(), own_count)]
        named = pa.concat_arrays([pa.array(w, pa.large_binary()) for w in words]).dictionary_encode()
        at = named.indices.to_numpy()
        word_total = np.bincount(at, np.concatenate(own_count), minlength=len(named.dictionary)).astype(np.uint64)[at]
        parts = lambda all_, lists: [squeezed(x) for x in np.split(all_, np.cumsum([len(x) for x in lists])[:-1])]
        none = pa.array([b""] * own.num_rows, pa.binary())
        out.append(
            pa.table(
                [own.column("batch"), own.column("bucket"), pa.array(parts(total, keys), pa.binary()), pa.array(parts(word_total, words), pa.binary()), none, none],
                ["batch", "bucket", "p", "q", "r", "s"],
            )
        )
    return pa.concat_tables([t.cast(out[0].schema) for t in out])


def log_weights(counts: np.ndarray, tokens: int, vocabulary: int):
    """Of words with these counts: log10 of the root's probability, and of their states' failure arcs."""
    n = max(tokens, 1)
    unknown = DISCOUNT * vocabulary / n if tokens else 1.0
    root = np.log10(np.where(counts > 0, (counts - DISCOUNT) / n, unknown))
    return root, np.where(counts > 0, np.log10(PRIOR / (counts + PRIOR)), 0.0)


def log_arc(count, root):
    """What an arc of a bigram with this count adds to its failure arc and the root's log-probability of its word."""
    return np.log10(1 + count / (PRIOR * 10.0**root))


def _walk(tokens: int, vocabulary: int):
    def run(group: pa.Table) -> pa.Table:
        mail = group.sort_by("bucket")
        home = mail.slice(0, 1).to_pylist()[0]
        hashes, ids = loosened(home["p"], np.uint64), loosened(home["r"], np.uint32).astype(np.int64)
        begin = np.append(0, np.cumsum(loosened(home["q"], np.uint32), dtype=np.int64))
        rows = pa.ipc.open_stream(home["s"]).read_all()
        pair, distinct, _, order = _pairs(ids, hashes)
        answers = mail.slice(1)
        arcs, counts = np.zeros(len(distinct)), np.zeros(len(hashes))
        arcs[order] = np.concatenate([loosened(x, np.uint64) for x in answers.column("p").to_pylist()])
        counts[np.argsort(hashes, kind="stable")] = np.concatenate([loosened(x, np.uint64) for x in answers.column("q").to_pylist()])
        root, fall = log_weights(counts, tokens, vocabulary)
        arc = log_arc(arcs, root[distinct & 0xFFFFFFFF])
        # from left to right: each word is reached by its arc or over the failure arc of the state before it
        steps = root[ids] + fall[pair >> 32] + arc[np.searchsorted(distinct, pair)]
        per_text = lambda x: np.add.reduceat(x, begin[:-1])
        return pa.table(
            [
                rows.column("id"),
                pa.array(~rows.column("train").to_numpy()),
                pa.array(np.diff(begin)),
                pa.array(per_text((counts[ids] > 0).astype(np.int64))),
                pa.array(np.full(rows.num_rows, tokens)),
                pa.array(per_text(np.log10(counts + 1)[ids] - np.log10(tokens + vocabulary + 1))),
                pa.array(per_text(steps)),
            ],
            ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return run


def lm_scores(df: DataFrame, training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    training is a Column that is true for rows to learn from (null: false); the others are held out. A null or empty text is scored as
    its end alone. Rows that repeat are each returned. With nothing to learn from, both scores are 0 for every token. An empty
    table gives an empty result; further columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(training, F.lit(False)).alias("train"), F.col(text_col).alias("text"))
    kind = df.schema[id_col].dataType.simpleString()
    words = rows.filter("train").mapInArrow(_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    tokens, vocabulary = (int(x or 0) for x in words.agg(F.sum("n"), F.count("*")).first())
    buckets = buckets_for(text_bytes(df, text_col), BUCKET_BYTES)
    asked = rows.mapInArrow(_ask(buckets), "to long, batch long, bucket long, p binary, q binary, r binary, s binary")
    answered = asked.groupBy("to").applyInArrow(_answer, MAIL)
    schema = f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answered.groupBy("batch").applyInArrow(_walk(tokens, vocabulary), schema).withColumnRenamed("id", id_col)


def training_rows(id_col: str = "doc_id"):
    """Rows to learn from: crc32 of the id as text, modulo 7, is not 2. A row without an id is learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 7 != 2, F.lit(True))
