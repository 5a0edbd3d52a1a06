"""The first step of near-duplicates: the fingerprints' index."""

from __future__ import annotations

from factmill.llm import simhash

from .corpus import frame


def test_index_links_near_sets_and_compares_them(spark):
    words = [f"w{i * 7919 % 997}" for i in range(300)]
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, " ".join(f"x{i}" for i in range(300))), (4, "")]
    sets = frame(spark, rows).selectExpr("doc_id AS id", "text").mapInArrow(simhash._shingle_sets(5), "id long, set long, n long, shingles array<long>").select("set", "n", "shingles")
    assert simhash.indexed_links(sets.filter("n > 0"), 0.8).count() == 1
    assert simhash.indexed_links(sets.filter("n > 0"), 0.999).count() == 0
