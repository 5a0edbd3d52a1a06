"""The pipeline's stages on a small corpus: what must go goes, clean documents leave as they came."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factmill.llm import queries


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(7)
    syllables = ["ta", "mo", "ri", "len", "shu", "ka", "ver", "no", "pil", "dus"]
    vocabulary = ["".join(r.choice(syllables) for _ in range(r.randrange(1, 4))) for _ in range(3000)]
    make = lambda n: " ".join(r.choice(vocabulary) for _ in range(n)) + "."
    passage = make(80)
    rows = {i: make(r.randrange(60, 200)) for i in range(300)}
    junk = set(range(300, 400))
    rows |= {i: " ".join(w.upper() + "!!" + r.choice(["###", "&&&"]) for w in make(r.randrange(60, 200)).split()) for i in junk}
    exact = {400: 10, 401: 11}
    rows |= {400: rows[10].replace(" ", "\n"), 401: rows[11]}
    words = rows[12].split()
    words[5] = "zzz"
    near = {402: 12}
    rows[402] = " ".join(words)
    rows |= {403: make(70) + " " + passage, 404: make(70) + " " + passage + " " + make(30)}
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, "en", "src0", len(t)) for i, t in rows.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 0 if i in junk else 1, 0) for i in rows if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, junk, exact, near, passage


def test_stages(spark, corpus):
    folder, rows, junk, exact, near, passage = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r for r in docs.collect()}
    assert kept["quality"].keys() == rows.keys() - junk
    assert kept["exact"].keys() == kept["quality"].keys() - {401, 400}
    assert kept["near"].keys() == kept["exact"].keys() - near.keys()
    last = kept["substrings"]
    assert last.keys() == kept["near"].keys()
    assert passage in last[403].text and passage not in last[404].text and last[404].n_chars == len(last[404].text)
    assert all(last[i].text == rows[i] for i in last if i != 404)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id for r in pieces.collect()} == last.keys()


def test_stages_with_clashing_columns(spark, corpus):
    """Columns that bear the names that stages use come through every stage, and change nothing."""
    folder, rows, *_ = corpus
    names = ("kept", "n_words", "n_removed", "_row", "_kept", "_ROW_null", "root", "id", "set")
    docs = spark.read.parquet(f"{folder}/documents.parquet").filter("doc_id % 3 = 0 or doc_id > 395")
    more = docs.withColumns({c: F.concat(F.lit(f"{c} of "), "doc_id") for c in names})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, more = stage(spark, docs, folder), stage(spark, more, folder)
        assert more.columns == [*docs.columns, *names]
        assert {r.doc_id: r.text for r in more.collect()} == {r.doc_id: r.text for r in docs.collect()}
        assert all(r[c] == f"{c} of {r.doc_id}" for r in more.collect() for c in names)
    assert corpus_pipeline.STAGES[-1][1](spark, more, folder).count() > 0


def test_queries_are_registered():
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert len(corpus_pipeline.STAGES) == 5


def test_rows_that_share_an_id_are_told_apart(spark, corpus):
    folder, rows, *_, passage = corpus
    r = random.Random(9)
    make = lambda n: " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(n))
    p, other = make(90), make(70)
    near = " ".join([*p.split()[:-1], "zzz"])
    schema = "doc_id long, text string, lang string, source string, n_chars long"

    def frame(*pairs):
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in pairs], schema)

    def texts(name, df):
        return sorted(((x.doc_id, x.text) for x in dict(corpus_pipeline.STAGES)[name](spark, df, folder).collect()), key=str)

    same = frame((1, p), (2, p), (2, other), (None, other), (3, None), (3, None), (None, make(60)))
    got = texts("exact", same)
    assert (1, p) in got and (2, other) in got and (3, None) in got and len(got) == 4
    got = texts("near", frame((1, p), (2, near), (2, other), (None, near + " q"), (3, None)))
    assert got == sorted([(1, p), (2, other), (3, None)], key=str)
    got = texts("substrings", frame((1, p), (2, "head " + p), (2, other), (None, other), (3, None)))
    assert got == sorted([(1, p), (2, "head"), (2, other), (3, None)], key=str)
    assert len(texts("quality", same)) <= 7
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert texts(name, frame().limit(0)) == []
