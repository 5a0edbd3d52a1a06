"""The transducer codes every piece by arcs, forgets in generations, and its pair rule is what merging gives."""

from __future__ import annotations

import base64
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

from factmill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SYLLABLES = ["th", "nd", "é", "ing", "ção", "e", "re", " ", ".", "'s", "\n", "　", "  ", "12", "ß", "🙂", "x"]


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def made_up(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(SYLLABLES) for _ in range(r.randrange(30))) for _ in range(n)]


def test_pair_rule_is_merging():
    v, r = bpe.Vocabulary(PATH), random.Random(1)
    ids = list(v.tokens)
    for _ in range(20_000):
        a, b = r.choice(ids), r.choice(ids)
        x, y = v.tokens[a], v.tokens[b]
        assert v.pairs[(a << 32) + b] == (v.parts(x + y, 1 << 40) == [x, y])


def test_every_piece_goes_through_arcs(plain, monkeypatch):
    c = bpe.Coder(PATH, public_tokenizers.PATTERN)
    walked, pieces, encode = [], set(), c.machine.encode
    arcs_of = bpe.Transducer.arc
    monkeypatch.setattr(bpe.Transducer, "arc", lambda self, s, b: walked.append(b) or arcs_of(self, s, b))
    monkeypatch.setattr(c.machine, "encode", lambda piece: pieces.add(piece) or encode(piece))
    texts = made_up(2, 3000)
    for t, (ids, n, back) in zip(texts, c.batch(pa.array(texts)), strict=True):
        want = plain.encode_ordinary(t)
        assert (bytes(ids).decode(), n, bytes(back)) == (",".join(map(str, want)), len(want), t.encode())
    coded = [p for p in pieces if p not in c.v.ranks]
    assert len(coded) > 0.9 * len(pieces)
    before = len(walked)
    for p in coded:  # nothing but arcs is left to take
        encode(p)
    assert len(walked) == before and c.machine.made <= before


def test_few_states_are_kept(plain):
    machine = bpe.Transducer(bpe.Vocabulary(PATH), most=50)
    for t in made_up(3, 300):
        for piece in bpe.regex.findall(r"\p{L}+", t):
            assert machine.encode(piece.encode()) == plain.encode_ordinary(piece)
        assert len(machine.states) <= 50
