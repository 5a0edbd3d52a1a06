"""Queries whose results differed from their SQL on larger tables."""

from __future__ import annotations

import duckdb
import pytest

from factmill.plans import registry

from .test_registry import plain


def equal(spark, folder, name: str, **tables):
    """The rows of a query over these tables, which equal those of its SQL."""
    duck = duckdb.connect()
    for table, df in tables.items():
        df.write.parquet(f"{folder}/{table}.parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    got, want = registry.QUERIES[name](spark, str(folder)), duck.execute(registry.ORACLE[name])
    columns, rows = [d[0] for d in want.description], got.collect()
    assert sorted(tuple(plain(r[c]) for c in columns) for r in rows) == sorted(tuple(map(plain, r)) for r in want.fetchall())
    return rows


def test_references_without_a_semicolon_are_text(spark, tmp_path):
    html = "<html><body><nav>A &amp; B</nav><article><h1>Tea&amp;&amp</h1><p>R&amp;D &lt;1&gt; &quo</p></article></body></html>"
    rows = equal(spark, tmp_path, "l1_page_sections", pages=spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert {r.label for r in rows if r.section_type == "article"} == {"Tea&&amp"}


def test_page_numbers_are_no_years(spark, tmp_path):
    pages = spark.createDataFrame([(i, "<html><body></body></html>") for i in range(1998, 2012)], "page_id long, html string")
    assert len(equal(spark, tmp_path, "l3_fee_tables", pages=pages)) == 14


def test_short_words_of_citations_are_no_venues(spark, tmp_path):
    texts = ["tact", "eacm these words", "ieee", "acme ieee jacm"]
    rows = [(42 * n + case, texts[n]) for n in range(len(texts)) for case in range(42)]
    found = equal(spark, tmp_path, "l8_citations", documents=spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.form for r in found if r.doc_id % 42 == 31} == {"before_comma"}


def test_years_of_the_last_century_are_read(spark, tmp_path):
    orders = spark.createDataFrame([(i, 365 * i) for i in range(10)], "o_orderkey long, days int").selectExpr("o_orderkey", "timestamp(date_add(date'1995-12-30', days)) AS o_orderdate")
    assert all(len(r.dates) == 2 for r in equal(spark, tmp_path, "l2_milestone_dates", orders=orders))


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["k2_chunk_split", "k1_chunks", "j10_generation_sections", "e11_token_weights", "g2_sparse_topk", "g3_hybrid_rrf"])
def test_batches_are_bounded(spark, name):
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")
    registry.QUERIES[name](spark, SF)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def planned(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_records_go_to_python_once(spark):
    plan = planned(registry.QUERIES["k2_chunk_split"](spark, SF))
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def test_routes_are_worked_out_once(spark):
    assert "size(" not in "".join(x for x in planned(registry.QUERIES["d18_expand_requests"](spark, SF)).split("\n") if "Filter" in x)


def test_scans_read_cut_rows(spark):
    """A scan's rows come from a checkpoint, not from the scans under it."""
    from pyspark.sql import functions as F

    from factmill.operators import listings

    df = spark.range(10).select(F.lit(1).alias("k"), "id")
    for n in ("a", "b", "c"):
        df = listings.scan(df, "k", "id", sums={n: F.lit(1)})
    assert planned(df).count("Window") == 2 and df.agg(F.max("c")).first()[0] == 10


def test_names_meet_once_each(spark, tmp_path):
    rows = [(i, ["large ring", "hot bolt large", "Large hot Ring", "nail", None][i % 5]) for i in range(50)]
    part = spark.createDataFrame(rows, "p_partkey long, p_name string")
    assert len(equal(spark, tmp_path, "d15_keyword_match", part=part)) > 0
    joins = [x for x in planned(registry.QUERIES["d15_keyword_match"](spark, str(tmp_path))).split("\n") if "Join" in x]
    assert len(joins) == 2  # words with words, then names with the rows that bear them
