"""Periodic runs, quality rules and token alignment against plain versions, over nulls, empty and long texts, ties, repeated rows, empty
tables and clashing columns; then their registered queries over the smallest tables."""

from __future__ import annotations

import bisect
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factmill.llm import periodic_runs, quality_rules, queries, token_alignment
from factmill.llm.common import bounded_batches

from .corpus import SCHEMA, frame, rows_of, texts

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(autouse=True)
def batches(spark):
    bounded_batches(spark)


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(w):
    """Every maximal stretch of every period, the smallest period of each, from the definition."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def plain_digest(doc_id, text):
    w, h = WORD.findall(text or ""), zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[a + (i - a) % p] if i >= a else x for i, x in enumerate(w)]
    runs = plain_runs(w)
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(runs), s, n, q, q and 1000 * n // q, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(plain_collapse(w, runs)))


DIGEST = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def periodic_texts():
    r, rows = random.Random(8), []
    for k in range(300):
        w = [r.choice("abcdé"[: r.choice([1, 2, 3, 5])]) * r.choice([1, 1, 2]) for _ in range(r.randrange(0, 120))]
        for _ in range(r.randrange(3)):
            if w:
                a, p = r.randrange(len(w)), r.randrange(1, 25)
                for i in range(a + p, min(len(w), a + r.randrange(1, 120))):
                    w[i] = w[i - p]
        rows.append((1000 + k, "".join(x + r.choice([" ", "\n", "\t ", "  "]) for x in w)))
    return rows


def test_periodic_runs(spark):
    rows = [*texts(), *periodic_texts(), (5000, "De " * 100_000), (5001, " ".join(f"w{i % 7000}" for i in range(30_000)))]
    got = periodic_runs.periodic_runs(frame(spark, rows))
    for r in got.collect():
        if r.doc_id == 5000:
            assert [tuple(x) for x in r.runs] == [(0, 100_000, 1)] and r.collapsed == "De"
        if r.doc_id == 5001:
            assert [tuple(x) for x in r.runs] == [(0, 30_000, 7000)] and r.n_words == 30_000
    short = [(i, t) for i, t in rows if i is None or i < 5000]
    want = [(i, len(w := WORD.findall(t or "")), str(runs := plain_runs(w)), plain_collapse(w, runs)) for i, t in short]
    assert order((r.doc_id, r.n_words, str([tuple(x) for x in r.runs]), r.collapsed) for r in got.filter("doc_id < 5000 or doc_id is null").collect()) == order(want)
    assert got.count() == len(rows) and periodic_runs.periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


def test_periodic_runs_query(spark):
    got = queries.op11_periodic_runs(spark, SF)
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(got, *DIGEST) == order(plain_digest(i, t) for i, t in rows)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows)


def plain_counts(text):
    text = text or ""
    w, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    times = collections.Counter(zip(w, w[1:], w[2:]))
    repeated = {i + k for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def base_failed(c):
    return c[0] < 50 or 100 * c[4] > 50 * c[0]


RULES = T.StructType([*SCHEMA.fields, *(T.StructField(c, T.StringType()) for c in ("lang", "source", "distance", "v0", "copy", "rows", "kept"))])


def labelled(spark, rows):
    """rows: id, text, language, source; further columns bear the names that the operator uses."""
    return spark.createDataFrame([(i, t, "id", "tag", 7, lang, source, *"abcde") for i, t, lang, source in rows], RULES).repartition(5)


def test_quality_rule_counts(spark):
    lines = ["a b c", "  ", "x", "x ", "a b c", "", "a\tb c\r", "a\tb c\r", "漢 # é"]
    r = random.Random(4)
    rows = [*texts(), *periodic_texts(), *((7000 + k, "\n".join(r.choice(lines) for _ in range(r.randrange(30)))) for k in range(100)), (8000, "a b\n" * 100_000)]
    got = quality_rules.quality_rules(labelled(spark, [(i, t, "en", "s") for i, t in rows]))
    want = [(i, *(c := plain_counts(t)), base_failed(c)) for i, t in rows]
    assert rows_of(got, "doc_id", *quality_rules.COUNTS, "base_failed") == order(want)
    assert got.filter("base_failed and (kept or distance is not null)").count() == 0
    assert quality_rules.quality_rules(labelled(spark, [])).count() == 0


def plain_estimate(x):
    """Minimum covariance determinant of rows, from the text book: steps from every start, all rows one by one."""
    floor = np.diag(quality_rules.FLOORS**2)
    middle = np.array([np.sort(c)[(len(x) + 1) // 2 - 1] for c in x.T])
    scale = np.sqrt(np.array([1.4826 * np.sort(np.abs(c - m))[(len(x) + 1) // 2 - 1] for c, m in zip(x.T, middle)]) ** 2 + quality_rules.FLOORS**2)
    z, h, best = (x - middle) / scale, int(0.75 * len(x)), None
    cov = lambda y: np.cov(y.T, bias=True)
    square = lambda m, s: np.array([(r - m) @ np.linalg.solve(s, r - m) for r in x])
    signs = z / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None]
    for spread in (np.diag(scale**2), *(np.diag(scale) @ cov(s) @ np.diag(scale) + floor for s in (np.tanh(z), signs))):
        centre = middle
        for _ in range(100):
            near = x[np.argsort(square(centre, spread), kind="stable")[:h]]
            centre, spread = near.mean(0), cov(near) + floor
        if best is None or np.linalg.det(spread) < np.linalg.det(best[1]) * (1 - 1e-9):
            best = centre, spread
    r = np.random.default_rng(0).chisquare(4, 4_000_000)
    consistent = lambda share: share / np.mean(np.random.default_rng(1).chisquare(6, 4_000_000) <= np.quantile(r, share))
    near = x[square(best[0], (best[1] - floor) * consistent(0.75) + floor) <= np.quantile(r, 0.975)]
    return near.mean(0), np.linalg.inv(cov(near) * consistent(0.975) + floor)


def test_estimate_equals_plain_one():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal([1.6, 0.2, 0.05, 0.05], [0.1, 0.3, 0.05, 0.05], (360, 4)), r.normal([2.2, 4, 0.4, 0.3], 0.1, (40, 4))])
    centre, inverse = quality_rules.robust(x, np.ones(len(x)))
    want, want_inverse = plain_estimate(x)
    assert np.allclose(centre, want, atol=1e-6) and np.allclose(inverse, want_inverse, rtol=0.01, atol=0.5)
    twice = quality_rules.robust(np.concatenate([x[:200], x]), np.concatenate([np.ones(200), np.repeat([1, 2], 200)]))
    assert np.allclose(twice[0], centre, atol=0.02)
    # cells that stand for several rows count as so many rows
    again = quality_rules.robust(np.repeat(x, 3, 0), np.ones(3 * len(x)))
    assert np.allclose(quality_rules.robust(x, np.full(len(x), 3))[1], again[1], rtol=1e-6, atol=1e-6)


def test_quality_rules_verdicts(spark):
    """Of each language and source, clean texts stay and others go; small sources share an estimate, and so do small languages."""
    r, rows = random.Random(2), []
    words = ["stone", "river", "of", "the", "a", "window", "light", "morning", "walked", "house", "and", "in", "under", "green"]
    clean = lambda: " ".join(r.choice(words) for _ in range(r.randrange(60, 400)))
    for lang, source, n in (("en", "hot", 300), ("en", "s1", 80), ("en", "s2", 20), ("en", "s3", 35), ("de", "s1", 30), ("fr", None, 30), (None, "s9", 70)):
        rows += [(len(rows) + k, clean(), lang, source) for k in range(n)]
    good = len(rows)
    for lang, source in (("en", "hot"), ("en", "s2"), ("de", "s1"), ("fr", None), (None, "s9")):
        rows.append((len(rows), " ".join(w + "%%%" for w in clean().split()), lang, source))
        rows.append((len(rows), " | ".join(clean().split()), lang, source))
        rows.append((len(rows), " ".join("".join(r.choice("bcdfgh") for _ in range(25)) for _ in range(90)), lang, source))
    rows += [(len(rows), clean(), "it", "alone"), (None, rows[0][1], "en", "hot"), (None, None, None, None)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(labelled(spark, rows)).collect() if r.doc_id is not None}
    assert [i for i in range(good) if not got[i].kept and not got[i].base_failed] == []
    assert [i for i in range(good, good + 15) if got[i].kept] == []
    assert got[good + 15].kept
    # too few rows for any estimate: the plain limits alone
    few = quality_rules.quality_rules(labelled(spark, rows[-20:])).collect()
    assert all(r.kept != r.base_failed and r.distance is None for r in few)


def test_quality_rules_query(spark):
    got = queries.op12_quality_rules(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(got, "doc_id", *quality_rules.COUNTS, "base_failed") == order((i, *(c := plain_counts(t)), base_failed(c)) for i, t in rows)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = got.join(labels, "doc_id").filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    assert dict(map(tuple, seen)).get(1) > 0.98


PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain_tokens(text):
    """(id, begin, end) of both tokenizers on the whole text; none where bytes don't come back."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = plain_tokens.a = getattr(plain_tokens, "a", None) or Tokenizer.from_file(PATHS[0])
    b = plain_tokens.b = getattr(plain_tokens, "b", None) or sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a.encode_special_tokens = True
    back = token_alignment.byte_alphabet()
    ours = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    theirs = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
    if any(b"".join(d for _, d in side) != (" " + text).encode() for side in (ours, theirs)):
        return [], []
    out = []
    for side in (ours, theirs):
        at, spans = 0, []
        for i, d in side:
            spans.append((i, at, at + len(d)))
            at += len(d)
        out.append(spans)
    return out


def plain_alignment(rows):
    docs = []
    for i, t in rows:
        a, b = plain_tokens(t) if t else ([], [])
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        parts = [(s, e) for s, e in zip([0, *ends[:-1]], ends)]
        inside = [collections.defaultdict(list), collections.defaultdict(list)]
        for side, held in zip((a, b), inside):
            for k, _, y in side:
                held[bisect.bisect_left(ends, y)].append(str(k))
        groups = ";".join(f"{','.join(inside[0][g])}|{','.join(inside[1][g])}" for g in range(len(parts)))
        links, first = [], 0
        for k, x, y in a:
            while first < len(b) and b[first][2] <= x:
                first += 1
            for j in range(first, len(b)):
                if b[j][1] >= y:
                    break
                links.append((k, b[j][0]))
        docs.append((i, len(a), len(b), len(parts), links, sha(groups) if a else ""))
    count = collections.Counter(p for d in docs for p in set(d[4]))
    most = collections.Counter()
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return order((i, na, nb, g, len(x), sum(count[p] == most[p[0]] for p in x), sum(count[p] for p in x), s) for i, na, nb, g, x, s in docs)


ALIGNED = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("size", [token_alignment.SLICE_BYTES, 3000])
def test_token_alignment(spark, size):
    r = random.Random(3)
    signs = ["a", ";", ";\r\n", "b", "the", "word", " ", "  ", "\n", "\t", "é", "漢", "\xa0", " ", "᠎", "\x85", "\x1c", "'s", "12", "##", "😀", "▁", "é", "<s>", "<|endoftext|>", "<0x0A>", "ﬁ", "\x00"]
    rows = texts()[:60] + [(i, t) for i, t in texts() if t is None or not t.strip()]
    rows += [(9000 + k, "".join(r.choice(signs) for _ in range(r.randrange(30)))) for k in range(400)] + [(9900, "x" * 20_000), (9901, "a▁b " * 9)]
    got = token_alignment.token_alignment(frame(spark, rows), *PATHS, slice_bytes=size)
    assert rows_of(got, *ALIGNED) == plain_alignment(rows)
    assert token_alignment.token_alignment(spark.createDataFrame([], SCHEMA), *PATHS).count() == 0


def test_token_alignment_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op13_token_alignment(spark, SF), *ALIGNED) == plain_alignment(rows)
