"""Scores of the backoff automaton against a plain backoff model over all bigrams."""

from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pytest

from factmill.llm import lm_scoring

from .corpus import frame, texts


def plain_model(rows):
    """log10 P(w|h) and the outcomes of a model counted row by row; rows with an id of the held-out remainder aren't learnt."""
    learns = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    one, two = collections.Counter(), collections.Counter()
    for i, t in rows:
        if learns(i):
            one.update(split(t))
            two.update(zip([b"", *split(t)], split(t)))
    n, d, m = sum(one.values()), lm_scoring.DISCOUNT, lm_scoring.PRIOR

    def log_p(h, w):
        root = (one[w] - d) / n if w in one else d * len(one) / n
        return math.log10((two[h, w] + m * root) / (one[h] + m) if h in one else root)

    return log_p, one


def split(t):
    return [*(t or "").encode().lower().split(), b""]


@pytest.mark.parametrize("bucket_bytes", [lm_scoring.BUCKET_BYTES, 200])
def test_scores_are_those_of_a_plain_backoff_model(spark, monkeypatch, bucket_bytes):
    monkeypatch.setattr(lm_scoring, "BUCKET_BYTES", bucket_bytes)
    rows = texts() + [(900, "never seen alpha words"), (901, "alpha of alpha of")]
    log_p, _ = plain_model(rows)
    want, got = collections.defaultdict(list), collections.defaultdict(list)
    for i, t in rows:
        want[i].append(sum(map(log_p, [b"", *split(t)], split(t))))
    for r in lm_scoring.lm_scores(frame(spark, rows), lm_scoring.training_rows()).collect():
        got[r.doc_id].append(r.score)
    assert got.keys() == want.keys()
    for i in want:
        assert sorted(got[i]) == pytest.approx(sorted(want[i]), abs=1e-6)


def test_states_sum_to_one():
    rows = [(k, t) for k, t in enumerate(["a b a b c", "b b a", "c a b a"], 100)]
    log_p, one = plain_model(rows)
    for h in [*one, b"other"]:
        assert sum(10 ** log_p(h, w) for w in [*one, b"unknown"]) == pytest.approx(1)


def test_weights_of_no_training():
    root, fall = lm_scoring.log_weights(np.zeros(3), 0, 0)
    assert (root == 0).all() and (fall == 0).all()


def test_numbers_come_back():
    for kind in (np.uint32, np.uint64):
        x = np.sort(np.random.default_rng(1).integers(0, np.iinfo(kind).max, 1000, kind))
        for values in (x, x[:0]):
            for steps in (False, True):
                assert (lm_scoring.loosened(lm_scoring.squeezed(values, steps), kind, steps) == values).all()
