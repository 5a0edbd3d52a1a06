"""Near-duplicates against brute force, where fingerprints or one comparison a group would lose pairs."""

from __future__ import annotations

import random

import pytest

from factmill.llm import simhash

from .corpus import frame, rows_of
from .test_operators import roots


def brute(rows):
    sets = {}
    for i, t in rows.items():
        w = t.encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    return near, {k: v for k, v in roots(sets, near).items() if any(k in p for p in near)}


def words(r, n):
    return ["".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n)]


def test_unlike_texts_do_not_shield_near_copies(spark):
    r = random.Random(3)
    same = ["x"] * 400  # over half of the shingles: one fingerprint for all
    body = words(r, 100)
    rows = {1: same + words(r, 100), 2: same + body, 3: same + body[:-1] + ["other"], 4: words(r, 30)}
    template = words(r, 260)  # decoys of a similarity under 0.8 around pairs on one template
    for k in range(30):
        own = words(r, 40)
        rows[10 + 2 * k] = template + own
        if k % 3 == 0:
            rows[11 + 2 * k] = template + own[:-2] + words(r, 2)
    rows = {i: " ".join(w) for i, w in rows.items()}
    near, want = brute(rows)
    assert (2, 3) in near and (1, 2) not in near and len(near) == 11
    assert dict(rows_of(simhash.near_duplicates(frame(spark, list(rows.items()))), "doc_id", "root")) == want


@pytest.fixture(scope="module")
def planted():
    """Pairs of a similarity from 0.80 to 0.84: scattered edits, appended and prepended blocks, truncations."""
    r, rows = random.Random(4), {}
    for k in range(160):
        n = r.randrange(80, 300)
        a, extra = words(r, n), round(n * r.uniform(0.195, 0.245))
        if k % 4 == 0:
            b = list(a)
            for i in r.sample(range(n), max(1, round(n * 0.02))):
                b[i] = "edited"
        else:
            b = [a + words(r, extra), words(r, extra) + a, a[: round(n * 0.82)]][k % 4 - 1]
        rows[1000 - 2 * k], rows[1001 - 2 * k] = " ".join(a), " ".join(b)
    return rows


def test_every_pair_at_the_limit_is_found(spark, planted):
    near, want = brute(planted)
    assert len(near) > 120
    assert dict(rows_of(simhash.near_duplicates(frame(spark, list(planted.items()))), "doc_id", "root")) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_on_templates(spark, seed):
    """Copies of copies: links through others, groups that hold several components."""
    r, rows = random.Random(seed), {}
    template = words(r, 150)
    for c in range(8):
        base = template[: r.randrange(60, 150)] + words(r, r.randrange(10, 60))
        for k in range(12):
            w = list(base if r.random() < 0.5 else rows[len(rows) - 1] if k else base)
            for i in r.sample(range(len(w)), r.randrange(0, 4)):
                w[i] = "".join(r.choice("abc") for _ in range(5))
            rows[len(rows)] = w
    rows = {i: " ".join(w) for i, w in rows.items()}
    near, want = brute(rows)
    assert near and len(set(want.values())) > 3
    assert dict(rows_of(simhash.near_duplicates(frame(spark, list(rows.items()))), "doc_id", "root")) == want
