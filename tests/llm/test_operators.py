"""Each operator against a plain version, over nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factmill.llm import bpe, exact_dedup, lm_scoring, packing, quality, simhash, substring_dedup, suffix_dedup, topk_search, warc
from factmill.llm.common import bounded_batches, fresh_path

from .corpus import SCHEMA, frame, rows_of, texts


@pytest.fixture(autouse=True)
def batches(spark):
    bounded_batches(spark)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def covered(units, length, first, doc):
    gone = bytearray(len(units))
    for p in range(len(units) - length + 1):
        if doc is not None and first[units[p : p + length] if isinstance(units, bytes) else tuple(units[p : p + length])] < doc:
            gone[p : p + length] = b"\1" * length
    return gone


def first_holders(rows, length, split):
    first: dict = {}
    for i, t in rows:
        if i is not None:
            units = split(t)
            for p in range(len(units) - length + 1):
                k = units[p : p + length] if isinstance(units, bytes) else tuple(units[p : p + length])
                first[k] = min(first.get(k, i), i)
    return first


@pytest.mark.parametrize("shard, bucket", [(suffix_dedup.SHARD_BYTES, suffix_dedup.BUCKET_BYTES), (2000, 6 << 20)])
def test_suffix_dedup(spark, monkeypatch, shard, bucket):
    """Long texts too; with small shards many transforms are merged in each collection."""
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", bucket)
    r = np.random.default_rng(5)
    big = "".join(r.choice(list("abcdefgh "), 1_000_000))
    rows = [*texts(), (700, big[:300_000]), (701, "x" + big[250_000:250_400] + "y" + big[100:160]), (702, big[299_000:301_000]), (703, "ab" * 3000)]
    split = lambda t: (t or "").encode()
    first, want = first_holders(rows, 50, split), []
    for i, t in rows:
        data = split(t)
        gone = covered(data, 50, first, i)
        left = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k in range(len(gone)) if gone[k] and not (k and gone[k - 1]))
        want.append((i, len(data), sum(gone), spans, sha(left)))
    got = suffix_dedup.drop_repeated_bytes(frame(spark, rows), with_bytes=True)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == order(want)
    assert all(sha(bytes(r.kept)) == r.kept_sha256 for r in got.collect())


def test_repeated_intervals_over_shards():
    import random

    r = random.Random(3)
    for _ in range(60):
        letters = r.choice([b"ab", b"abcdefgh"])
        base = bytes(r.choice(letters) for _ in range(150))
        strings = [base[(a := r.randrange(90)) : a + r.randrange(1, 60)] for _ in range(r.randrange(1, 10))]
        window = r.choice([3, 8, 17, 50])
        got, want = collections.defaultdict(set), collections.defaultdict(set)
        for s, p, k in zip(*suffix_dedup.repeated_intervals(strings, window, r.choice([20, 60, 1 << 17]))):
            got[int(k)].add((int(s), int(p)))
        for i, s in enumerate(strings):
            for p in range(len(s) - window + 1):
                want[s[p : p + window]].add((i, p))
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_substring_dedup(spark):
    rows, split = texts(), lambda t: (t or "").encode().split()
    first, want = first_holders(rows, 50, split), []
    for i, t in rows:
        words = split(t)
        gone = covered(words, 50, first, i)
        want.append((i, len(words), sum(gone), sha(b" ".join(w for w, g in zip(words, gone) if not g))))
    got = substring_dedup.drop_repeated_windows(frame(spark))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == order(want)


def test_difference_cover_meets_every_shift():
    residues = {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER}
    assert residues == set(range(substring_dedup.PERIOD))


def test_exact_dedup(spark):
    rows, groups, want = texts(), collections.defaultdict(list), []
    blank = str.maketrans("", "", " \t\n\x0b\x0c\r")
    for i, t in rows:
        groups[(t or "").translate(blank)].append((i, t or ""))
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        want += [(i, keep, len(members), i == keep, sha(norm.encode())) for i, _ in members]
    got = exact_dedup.exact_groups(frame(spark))
    assert rows_of(got, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == order(want)


def plain_fingerprint(text, width=3):
    import xxhash

    words = (text or "").encode().lower().split()
    pieces = [b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in pieces]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def roots(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_simhash_components(spark):
    rows = texts()
    fps = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    root = roots(distinct, [(a, b) for a in distinct for b in distinct if a < b and (a ^ b).bit_count() <= 2])
    least: dict = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[root[f]] = min(least.get(root[f], i), i)
    want = [(i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps)]
    got = simhash.simhash_components(frame(spark))
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == order(want)


def test_gray_index_finds_all_pairs():
    r = np.random.default_rng(1)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) for k in range(20)]))
    q, at, _ = simhash.GrayIndex(fps).search(fps, 3)
    want = {(i, j) for i in range(len(fps)) for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3).tolist()}
    assert set(zip(q.tolist(), at.tolist())) == want


def test_pigeonhole_masks_cover_the_radius():
    masks = simhash.pigeonhole_masks(2, 4)
    for a in range(64):
        for b in range(64):
            flipped = (1 << a) | (1 << b)
            assert any(not m & flipped for m in masks)


def test_near_duplicates(spark):
    rows = {i: t for i, t in texts() if i is not None and (t or "").split()}
    sets = {}
    for i, t in rows.items():
        w = t.encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = {k: v for k, v in roots(sets, near).items() if any(k in p for p in near)}
    got = simhash.near_duplicates(frame(spark, list(rows.items())))
    assert dict(rows_of(got, "doc_id", "root")) == root


def test_quality(spark):
    good, bad = "The house of the old man stood near the river and was quiet", "BUY!! NOW!! ### &&& $$$ CHEAP!! %%% ***"
    rows = [(i, (good if i % 3 else bad) + f" {i} " + ("and then it rained " if i % 3 else "!!! ") * (i % 9)) for i in range(400)] + [(900, None), (901, ""), (None, good)]
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(400)] + [(None, 1, 0), (399, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(frame(spark, rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got if r.doc_id is not None)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 400]
    assert np.mean([r.predicted == int(bool(r.doc_id % 3)) for r in held]) > 0.95
    none = quality.quality_scores(frame(spark, rows[:3]), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_isotonic_levels_never_fall():
    levels = quality.pool([5, 5, 5, 5], [1, 4, 2, 5])
    assert (np.diff(levels) >= 0).all() and len(levels) == 4


def test_packing(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    rows = [(i, x) for i, x in texts() if i not in (29, 30, None)]
    got = packing.pack(frame(spark, rows), path).toPandas()
    for i, x in rows:
        ids, mine = np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4"), got[got.doc_id == i].sort_values("start")
        assert mine.start.tolist() == [0, *mine.length.cumsum().tolist()[:-1]] and mine.length.sum() == len(ids) == mine.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length)] == mine.ids_crc32.tolist()
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]]
        n = int(s.length.sum())
        assert n == 2048 or n < 2048 and n & (n - 1) == 0
    assert len(packing.pack(frame(spark, [(1, "a"), (1, "a"), (None, None)]), path).collect()) == 3


def test_words_with_combining_marks():
    """The tokenizer composes letters and marks before it lowers them."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    r = np.random.default_rng(5)
    marks = ["\u0331", "\u0308", "\u030a", "\u030c", "\u0301", "\u0327", "\u0323", "\u0338"]
    signs = [*"HTWYJABCeszhtwyj", *marks, *marks, " ", "-", "'", "=", "<", "1", "É", "İ", "ß", "漢"]
    rows = ["H\u0331 T\u0308 W\u030a Y\u030a J\u030c", "Wādī H\u0331alfā", *("".join(r.choice(signs, r.integers(1, 14))) for _ in range(10_000))]
    data = [t.encode() for t in rows]
    got = packing.WordTokenizer(path).batch(np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64))
    for text, ids, want in zip(rows, got, plain.encode_batch(rows, add_special_tokens=False)):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, text


def test_packing_plan_uses_combinations():
    histogram = np.zeros(64, np.int64)
    histogram[[20, 44, 30, 17]] = [50, 50, 7, 14]
    plan = packing.Plan(histogram, 64)
    assert plan.used[20] == 50 and plan.used[44] == 50 and plan.used[30] == 7 and plan.used[17] == 14


def test_top_k(spark):
    r = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in r.normal(size=8).round(2)]) for i in range(300)]
    vectors += [(300 + k, vectors[k][1]) for k in range(60)] + [(500, None), (501, [1.0, None]), (502, [float("nan")] * 8), (550, [float("inf")] * 8), (600, []), (50, vectors[1][1]), (None, vectors[2][1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<double>, id string").repartition(4)
    ok = [(n, i, [math.floor(256 * x) for x in v]) for n, (i, v) in enumerate(vectors) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for n, i, v in ok:
        if i % 50 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), j) for m, j, w in ok if m != n)[:5]
            want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(scored)]
    got = topk_search.top_k(df, F.col("vec_id") % 50 == 0)
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == order(want)
    assert topk_search.top_k(df.limit(0), F.lit(True)).count() == 0


def test_warc(spark):
    big = "<p>été</p>" * 200
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://b/", "small"), (4, "http://c/", "small"), (5, "http://d/", None), (6, "http://e/", big + "x"), (None, "http://f/", big), (7, "http://g/", "\r\n\r\n" * 400), (7, "http://g/", "\r\n\r\n" * 400)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    folder = fresh_path(spark, "warc")
    index = warc.archive(df, folder)
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, o in rows if o == h and j is not None]
        revisit = i is not None and len(data) >= 1000 and max(same) > i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    got = warc.read_bundles(spark, folder, index)
    assert rows_of(got, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == order(want)
    entry = index.filter(F.col("record_id") == warc.record_urn(6)).first()
    head, payload = warc.fetch(folder, entry.bundle, entry.frame, entry.frame_offset)
    assert payload == (big + "x").encode() and head["WARC-Type"] == "response"
    empty = fresh_path(spark, "warc")
    assert warc.read_bundles(spark, empty, warc.archive(df.limit(0), empty)).count() == 0


def test_bundle_is_plain_zstandard(spark, tmp_path):
    import io

    import zstandard

    bundle = warc.Bundle(f"file://{tmp_path}", "x.zst", 1000, 3)
    places = [bundle.add(bytes([65 + k]) * 700) for k in range(5)]
    bundle.close()
    assert places == [(k, 0) for k in range(5)]
    with zstandard.ZstdDecompressor().stream_reader(io.BytesIO((tmp_path / "x.zst").read_bytes()), read_across_frames=True) as r:
        assert r.read() == b"".join(bytes([65 + k]) * 700 for k in range(5))


def test_bpe(spark):
    import tiktoken

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    odd = [(100, "a\0b  c\n\n d \n"), (101, "  \tx　y\x85z\x1c"), (102, "<|endoftext|> 's 'LL ١٢"), (103, "\nq\n"), (104, "é́🙂" * 30)]
    rows = texts() + odd
    want = []
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())))
    df = frame(spark, rows)
    got = bpe.round_trip(df, path, public_tokenizers.PATTERN)
    assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == order(want)
    back = bpe.decode(bpe.encode(df.filter("doc_id >= 100"), path, public_tokenizers.PATTERN), path)
    assert dict(rows_of(back, "doc_id", "text")) == dict(odd)


def test_stream_decoder_waits_for_whole_characters():
    d = bpe.StreamDecoder({0: "é".encode()[:1], 1: "é".encode()[1:], 2: b"a", 3: b"\xff"})
    assert [d.feed([0]), d.feed([1]), d.feed([0, 2]), d.feed([3]), d.feed([0]), d.flush()] == ["", "é", "�a", "�", "", "�"]


def test_lm_scores(spark):
    rows = texts()
    learns = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    split = lambda t: (t or "").encode().lower().split() + [b""]
    count = collections.Counter(w for i, t in rows if learns(i) for w in split(t))
    n, v = sum(count.values()), len(count)
    got = lm_scoring.lm_scores(frame(spark), lm_scoring.training_rows())
    by = collections.defaultdict(list)
    for i, t in rows:
        w = split(t)
        by[i].append((len(w), sum(count[x] > 0 for x in w), sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)))
    seen = collections.defaultdict(list)
    for r in got.collect():
        assert r.train_tokens == n and r.score <= 1e-9 and r.held_out == (r.doc_id is not None and not learns(r.doc_id))
        seen[r.doc_id].append((r.n_tokens, r.n_known, r.base_score))
    assert seen.keys() == by.keys()
    for i in by:
        for a, b in zip(sorted(by[i]), sorted(seen[i]), strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < 1e-6


@pytest.mark.parametrize(
    "apply",
    [
        suffix_dedup.drop_repeated_bytes,
        lambda d: quality.quality_scores(d, d.select("doc_id", F.lit(1).alias("quality"))),
        simhash.simhash_components,
        simhash.near_duplicates,
        lambda d: packing.pack(d, public_tokenizers.path("word_bpe_49k.json")),
        exact_dedup.exact_groups,
        substring_dedup.drop_repeated_windows,
        lambda d: bpe.round_trip(d, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN),
        lambda d: lm_scoring.lm_scores(d, lm_scoring.training_rows()),
    ],
)
def test_empty_tables(spark, apply):
    assert apply(spark.createDataFrame([], SCHEMA)).count() == 0
    assert isinstance(apply(spark.createDataFrame([], SCHEMA)).schema, T.StructType)
