"""Queries over the source registry, routes, reranking, text cleaning and index states."""

from __future__ import annotations

from pyspark.sql import functions as F

from factmill.functions import text as T
from factmill.functions import urls as U
from factmill.operators import cycle, filters, lifecycle, questions, search, sources

from . import adapters as A
from . import retrieval as R
from .adapters import RECORDS_SQL as REC
from .catalog import Catalog

query = Catalog()
QUERIES, ORACLE = query.queries, query.oracle

CLASSES = ("policy", "document_asset", "faculty", "program")
LIVE = f"{REC}, ch AS (SELECT record_version_id, record_type, ['policy', 'document_asset', 'faculty', 'program'][doc_id % 4 + 1] AS source_class, CASE WHEN doc_id % 11 <> 0 THEN 'g' || doc_id % 3 END AS generation_id, freshness FROM rec)"


def _chunks(spark, sf_dir):
    i = F.col("doc_id")
    return A.records(spark, sf_dir).select(
        "record_version_id", "record_type", F.element_at(F.array(*map(F.lit, CLASSES)), (i % 4 + 1).cast("int")).alias("source_class"),
        F.when(i % 11 != 0, F.concat(F.lit("g"), i % 3)).alias("generation_id"), "freshness",
    )


@query("b6_in_generation", f"WITH {LIVE} SELECT record_version_id FROM ch WHERE coalesce(generation_id, '') = ''")
def in_generation(spark, sf_dir):
    return search.in_generation(_chunks(spark, sf_dir), F.lit(None).cast("string")).select("record_version_id")


@query(
    "b7_route_filter",
    f"""
WITH {LIVE}, rt AS (SELECT DISTINCT turn % 5 AS query_id, 'r' || turn % 3 AS route, [NULL, 'policy', 'faculty'][turn % 3 + 1] AS class, CASE WHEN turn % 5 = 1 THEN 'program' END AS kind FROM conversations)
SELECT query_id, route, count(*) AS chunks, min(record_version_id) AS first FROM rt JOIN ch ON generation_id = 'g1' AND freshness = 'current'
  AND (class IS NULL OR source_class = class OR (class = 'policy' AND source_class = 'document_asset')) AND (kind IS NULL OR record_type = kind) GROUP BY ALL""",
)
def route_filter(spark, sf_dir):
    t = F.col("turn")
    classes = F.array(F.lit(None).cast("string"), F.lit("policy"), F.lit("faculty"))
    routes = A.table(spark, sf_dir, "conversations").select(
        (t % 5).alias("query_id"), F.concat(F.lit("r"), t % 3).alias("route"), F.element_at(classes, (t % 3 + 1).cast("int")).alias("source_class"), F.when(t % 5 == 1, "program").alias("record_type")
    )
    met = search.route_filter(_chunks(spark, sf_dir), routes.distinct(), F.lit("g1"))
    return met.groupBy("query_id", "route").agg(F.count("*").alias("chunks"), F.min("record_version_id").alias("first"))


@query("b5_record_type_match", f"WITH {LIVE} SELECT record_version_id, record_type = 'program' OR source_class = 'policy' AS matches FROM ch")
def record_type_match(spark, sf_dir):
    hint = F.when(F.col("source_class") != "policy", "program")
    return _chunks(spark, sf_dir).select("record_version_id", filters.record_type_matches(F.col("record_type"), hint).alias("matches"))


@query(
    "i5_reconcile",
    """
WITH k AS (SELECT doc_id, ['policy', 'faculty', 'fee', 'library', NULL, 'scholarship', 'news_event'][doc_id % 7 + 1] AS kc, ['program_fee_schedule', 'policy_rule', 'admissions_cycle', NULL, 'scholarship'][doc_id % 5 + 1] AS kt, source AS sc, lang AS st FROM documents)
SELECT doc_id, CASE WHEN strong THEN kc ELSE sc END AS source_class, CASE WHEN strong THEN kt ELSE st END AS record_type
FROM (SELECT *, coalesce(kc, '') IN ('policy', 'fee', 'scholarship', 'admissions') OR coalesce(kt, '') IN ('program_fee_schedule', 'scholarship', 'admissions_cycle') AS strong FROM k)""",
)
def reconcile(spark, sf_dir):
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))
    kind = lambda c, t: F.struct(c.alias("source_class"), t.alias("record_type"))
    word = kind(pick("policy", "faculty", "fee", "library", None, "scholarship", "news_event"), pick("program_fee_schedule", "policy_rule", "admissions_cycle", None, "scholarship"))
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", questions.reconcile(word, kind(F.col("source"), F.col("lang"))).alias("c")).select("doc_id", "c.source_class", "c.record_type")


@query(
    "g6_rerank",
    f"""
WITH {R.EV}, s AS (SELECT *, CASE WHEN doc_id % 2 = 0 THEN doc_id % 17 / 17.0 ELSE 0.0 END AS s FROM ev)
SELECT query_id, chunk_id, round(s, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, chunk_id) AS place FROM s""",
)
def rerank(spark, sf_dir):
    e = R._evidence(spark, sf_dir)
    scores = e.filter("doc_id % 2 = 0").select("query_id", "chunk_id", (F.col("doc_id") % 17 / 17.0).alias("score"))
    return search.rerank(e, scores).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "place")


@query(
    "c3_aliases",
    """
WITH l AS (SELECT page_id, 'https://X.edu' || CASE page_id % 5 WHEN 0 THEN '/Old/Fees?q=1' WHEN 1 THEN '/fees' WHEN 2 THEN '' WHEN 3 THEN '/home' ELSE '/other?x=2' END AS url FROM pages)
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'https://x.edu/fees' WHEN 2 THEN 'https://x.edu/home' ELSE url END AS resolved_url,
  CASE page_id % 5 WHEN 1 THEN ['https://x.edu/costs', 'https://x.edu/old/fees'] WHEN 3 THEN ['https://x.edu/'] ELSE [] END AS legacy_urls FROM l""",
)
def aliases(spark, sf_dir):
    table = spark.createDataFrame([("/old/fees", "/fees"), ("/costs", "/fees"), ("/", "/home")], "path string, canonical_path string")
    paths = F.array(*map(F.lit, ("/Old/Fees?q=1", "/fees", "", "/home", "/other?x=2")))
    p = A.table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("https://X.edu"), F.element_at(paths, (F.col("page_id") % 5 + 1).cast("int"))).alias("url"))
    return U.legacy_aliases(U.resolve_alias(p, table), table).select("page_id", "resolved_url", "legacy_urls")


@query(
    "c13_source_entries",
    """
WITH l AS (SELECT page_id, ['/merit/1', '/files/a.pdf', '/library', '/admissions/bs'][page_id % 4 + 1] AS p FROM pages)
SELECT page_id, 'https://x.edu' || p AS canonical_url, 'https://x.edu' || p || '/' AS source_key, ['merit_list', 'document_asset', 'library', 'program'][page_id % 4 + 1] AS source_class,
  CASE WHEN page_id % 4 IN (0, 3) THEN 'admissions' END AS family, [1, 3, 4, NULL][page_id % 4 + 1] AS authority_tier, CASE page_id % 4 WHEN 1 THEN 'document' ELSE 'page' END AS parser_target,
  page_id % 4 = 0 AS is_high_risk, CASE WHEN page_id % 9 = 0 THEN 'blocked' ELSE 'allowed' END AS legal_status FROM l""",
)
def source_entries(spark, sf_dir):
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("page_id") % len(names) + 1).cast("int"))
    p = A.table(spark, sf_dir, "pages").select(
        "page_id", F.concat(F.lit("HTTPS://x.edu"), pick("/merit/1", "/files/a.pdf", "/library", "/admissions/bs"), F.lit("?q")).alias("url"),
        pick("dedicated_child", "official_document", "overview", "other").alias("page_kind"), pick("page_body", "table", "table", "text").alias("content_kind"),
    )
    return sources.source_entries(p, blocked=F.col("page_id") % 9 == 0).drop("url", "page_kind", "content_kind")


@query(
    "c12_document_assets",
    """
SELECT 'document_asset:' || substr(sha256(url), 1, 16) AS record_id, url AS dedupe_key, CASE WHEN page_id % 2 = 0 THEN 's' || page_id ELSE 'document-root' END AS source_section_id,
  CASE WHEN page_id % 2 = 0 THEN 'Part 1' ELSE 'Document Root' END AS source_locator, ['pdf', 'word_document', 'spreadsheet', 'unknown'][page_id % 4 + 1] AS document_kind FROM pages""",
)
def document_assets(spark, sf_dir):
    i = F.col("page_id")
    part = F.struct(F.concat(F.lit("s"), i).alias("section_id"), F.lit("Part 1").alias("locator"))
    names = F.array(*map(F.lit, ("a.PDF", "b.docx", "c.xls", "d.txt")))
    d = A.table(spark, sf_dir, "pages").select(
        F.col("url").alias("document_url"), F.lit("https://x.edu/").alias("parent_page_url"), F.element_at(names, (i % 4 + 1).cast("int")).alias("filename"),
        F.when(i % 2 == 0, F.array(part)).otherwise(F.array().cast("array<struct<section_id:string,locator:string>>")).alias("sections"),
    )
    return sources.document_assets(d).select("record_id", "dedupe_key", "source_section_id", "source_locator", "document_kind")


@query(
    "c15_names",
    """
SELECT page_id, 'facts-' || substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 238) || '-' || substr(sha256(url), 1, 10) AS collection,
  strftime(TIMESTAMP '2024-01-01' + to_minutes(page_id), 'reindex-%Y%m%d-%H%M%S') AS label FROM pages""",
)
def names(spark, sf_dir):
    at = F.timestamp_add("MINUTE", F.col("page_id").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz"))
    return A.table(spark, sf_dir, "pages").select("page_id", sources.collection_name(F.col("url"), "facts").alias("collection"), sources.generation_label(at).alias("label"))


@query("d5_source_ids", f"WITH {REC} SELECT record_version_id, CASE WHEN source <> 'src3' THEN 'id-' || source_url END AS source_id FROM rec")
def source_ids(spark, sf_dir):
    r = A.records(spark, sf_dir)
    known = r.filter("source <> 'src3'").select("source_url", F.concat(F.lit("id-"), "source_url").alias("source_id")).distinct()
    return sources.resolve_source_ids(r, known).select("record_version_id", "source_id")


@query("h7_union_evidence", f"WITH {REC} SELECT record_version_id, record_type, tier FROM rec UNION ALL SELECT 'conv' || conv_id || ':' || turn, 'evidence', NULL FROM conversations")
def union_evidence(spark, sf_dir):
    facts = A.records(spark, sf_dir).select("record_version_id", "record_type", "tier")
    said = A.table(spark, sf_dir, "conversations").select(F.concat(F.lit("conv"), "conv_id", F.lit(":"), "turn").alias("record_version_id"))
    return sources.union_evidence(facts, said)


@query("j12_reset_serving", f"WITH {REC} SELECT record_version_id, CASE WHEN doc_id % 3 = 0 THEN 'eligible' ELSE serving END AS new_serving FROM rec")
def reset_serving(spark, sf_dir):
    r = A.records(spark, sf_dir)
    indexed = lifecycle.mark_indexed(r, r.filter("doc_id % 3 = 0")).withColumn("serving", F.col("new_serving"))
    return lifecycle.reset_serving(indexed).select("record_version_id", "new_serving")


@query(
    "c40_cleaners",
    """
SELECT doc_id, sha256('# Head' || chr(10) || regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+$', '')) AS body, 'The text' AS section FROM documents""",
)
def cleaners(spark, sf_dir):
    page = F.concat(F.lit("[Skip to content](#x)\nmenu\n# Head\n"), "text", F.lit("\n\n\n\nPrevious Next\n[Go to Top](#)\n##### Students\nfoot"))
    section = F.lit("Head By [admin](https://x.edu/author/admin/)|2026-03-26T08:05:31+00:00\n[![](a.jpg)](https://v) \n![b](b.png)\n\nThe text")
    return A.table(spark, sf_dir, "documents").select("doc_id", F.sha2(T.strip_boilerplate(page), 256).alias("body"), T.strip_wp_artifacts(section).alias("section"))


@query(
    "c25_hashes",
    """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'raw' ELSE sha256(source) END AS effective, CASE WHEN doc_id % 4 = 0 THEN 'given' ELSE sha256(text) END AS content,
  sha256('{"a": "' || lang || '", "b": {"x": 1, "y": [1, 2]}}') AS payload, length(text) AS n FROM documents""",
)
def hashes(spark, sf_dir):
    """Effective and content hashes, that of a payload's JSON, and texts without NUL."""
    i = F.col("doc_id")
    json = F.concat(F.lit('{"b":{"y":[1,2],"x":1},"a":"'), "lang", F.lit('"}'))
    return A.table(spark, sf_dir, "documents").select(
        "doc_id", T.effective_hash(F.when(i % 3 != 0, F.col("source")), F.lit("raw")).alias("effective"), T.content_hash(F.when(i % 4 == 0, "given"), F.col("text")).alias("content"),
        T.payload_hash(json).alias("payload"), F.char_length(T.strip_nul(F.concat("text", F.lit("\0")))).cast("long").alias("n"),
    )


@query(
    "k3_contextualize",
    """
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'cached ' || doc_id || chr(10) || chr(10) || text WHEN doc_id % 3 = 1 THEN 'of ' || length(text) || chr(10) || chr(10) || text ELSE text END AS text, text AS original_text FROM documents""",
)
def contextualize(spark, sf_dir):
    """A third of contexts are cached, a third are made, a third can't be made."""
    i = F.col("doc_id")
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.when(i % 3 == 2, "\0").otherwise(""), "text").alias("text"), i.cast("string").alias("cache_key"))
    cache = d.filter("doc_id % 3 = 0").select("cache_key", F.concat(F.lit("cached "), "cache_key").alias("context"))

    def made(texts):
        if any(t.startswith("\0") for t in texts):
            raise ValueError("no context")
        return [f"of {len(t)}" for t in texts]

    out = sources.contextualize(d, cache, made)
    return out.select("doc_id", T.strip_nul(F.col("text")).alias("text"), T.strip_nul(F.col("original_text")).alias("original_text"))


@query("j14_update_cycle")
def update_cycle(spark, sf_dir):
    """A cycle over all records, a tenth of them incoming: the state that each version ends in (tests hold the steps, and this as a whole)."""
    r = A.records(spark, sf_dir).withColumn("source_id", F.concat(F.lit("s"), F.col("doc_id") % 200))
    s, new = A.sources(spark, sf_dir), F.col("doc_id") % 10 == 1
    pages = r.select("source_url", F.col("source").alias("parent")).distinct()
    done = cycle.update_cycle(
        r.filter(~new), s, r.filter(new), s.filter("source_class = 'policy'"), A.visits(spark, sf_dir), pages, pages.select("parent"), r.filter("doc_id % 31 <> 5").select("source_url"),
        F.lit("2024-07-01").cast("date"), F.lit("2024-02-15").cast("timestamp_ntz"),
    )
    return done.records.select("record_version_id", "freshness", "serving", "verification", "authoritative")
