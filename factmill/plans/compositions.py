"""Queries over compositions: selection, generations, recomputation, answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from factmill.functions import rendering
from factmill.functions import text as T
from factmill.operators import answers, filters, lifecycle, questions, search, sources, versions

from . import adapters as A
from . import retrieval as R
from .adapters import RECORDS_SQL as REC
from .adapters import SOURCES_SQL as SRC
from .catalog import Catalog
from .records import DECIDE, TOP

query = Catalog()
QUERIES, ORACLE = query.queries, query.oracle


# Sources with all that a choice of the next visits needs, and a watch list.
DUE_SQL = f"""{SRC}, s AS (
  SELECT source_url, is_active, legal_status, n, CASE WHEN n % 8 = 0 THEN 'research_subdomain' ELSE source_class END AS kind, n % 16 = 0 AS open,
    CASE WHEN n % 5 <> 0 THEN n % 9 * 24 END AS hours, n % 3 = 1 AS by_hand, CASE WHEN n % 4 = 1 AND n % 3 = 2 THEN 24 ELSE 168 END AS pause, CASE WHEN n % 12 IN (1, 5) THEN 100 - n END AS listed
  FROM (SELECT *, CAST(regexp_extract(source_url, '[0-9]+') AS INTEGER) AS n FROM src)),
due AS (SELECT source_url, CASE kind WHEN 'admissions_cycle' THEN 0 WHEN 'research_subdomain' THEN 1 ELSE 2 END AS rank, CASE WHEN kind = 'admissions_cycle' THEN listed END AS place, NOT by_hand AND (hours IS NULL OR hours >= pause) AS due
  FROM s WHERE is_active AND coalesce(legal_status, 'allowed') <> 'blocked' AND (kind <> 'research_subdomain' OR open))"""


def _due(spark, sf_dir, **more):
    n, now = F.regexp_extract("source_url", "[0-9]+", 0).cast("int"), F.lit("2024-07-01").cast("timestamp_ntz")
    s = A.sources(spark, sf_dir).withColumns(
        {
            "source_class": F.when(n % 8 == 0, "research_subdomain").otherwise(F.col("source_class")),
            "crawl_status": F.when(n % 16 == 0, "unverified").otherwise("blocked"),
            "refresh_policy": F.when(n % 3 == 0, "weekly").when(n % 3 == 1, "manual_only").otherwise("daily_during_season_weekly_otherwise"),
            "last_crawled_at": F.when(n % 5 != 0, F.timestamp_add("DAY", -(n % 9), now)),
        }
    )
    watch = s.filter((n % 12).isin(1, 5)).select("source_url", (100 - n).alias("place"))
    return lifecycle.select_due_sources(s, now, watch=watch, **more).select("source_url", "rank", "place")


@query("g4_select_due", f"WITH {DUE_SQL} SELECT source_url, rank, place FROM due WHERE due ORDER BY rank, place NULLS LAST, source_url LIMIT 10")
def select_due(spark, sf_dir):
    """The next ten visits: a report."""
    return _due(spark, sf_dir, limit=10)


@query("g4_select_forced", f"WITH {DUE_SQL} SELECT source_url, rank, place FROM due")
def select_forced(spark, sf_dir):
    return _due(spark, sf_dir, force=True)


@query(
    "b11_crawlable",
    f"""
WITH {SRC}, s AS (SELECT *, CASE WHEN length(source_url) % 2 = 0 THEN 'research_subdomain' ELSE source_class END AS kind, ['unverified', 'verified_live', 'blocked', NULL][length(source_url) % 4 + 1] AS crawl_status FROM src)
SELECT source_url, is_active AND coalesce(legal_status, 'allowed') NOT IN ('blocked', 'restricted') AND (kind <> 'research_subdomain' OR coalesce(crawl_status IN ('unverified', 'verified_live'), false)) AS crawlable,
  NOT (coalesce(legal_status, 'allowed') = 'allowed' AND is_active) AS restricted FROM s""",
)
def crawlable(spark, sf_dir):
    """Which sources may be visited; and which may not be used automatically, if only active ones could be."""
    n = F.length("source_url")
    status = F.when(n % 4 == 0, "unverified").when(n % 4 == 1, "verified_live").when(n % 4 == 2, "blocked")
    s = A.sources(spark, sf_dir).withColumns({"source_class": F.when(n % 2 == 0, "research_subdomain").otherwise(F.col("source_class")), "crawl_status": status})
    restricted = filters.source_restricted(F.coalesce("legal_status", F.lit("allowed")), F.col("is_active"))
    return s.select("source_url", filters.is_crawlable().alias("crawlable"), restricted.alias("restricted"))


@query(
    "g10_generations",
    """
SELECT label, CAST(row_number() OVER (ORDER BY status <> 'active', created_at DESC, label) AS INTEGER) AS place FROM
  (SELECT 'g' || o_custkey AS label, max(o_orderdate) AS created_at, CASE WHEN o_custkey % 50 = 7 THEN 'active' ELSE 'retired' END AS status FROM orders GROUP BY o_custkey) QUALIFY place <= 20""",
)
def generations(spark, sf_dir):
    """The first twenty generations of the list: a report."""
    from pyspark.sql import Window

    o = A.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("created_at"))
    g = o.select(F.concat(F.lit("g"), "o_custkey").alias("label"), "created_at", F.when(F.col("o_custkey") % 50 == 7, "active").otherwise("retired").alias("status"))
    first = sources.list_generations(g).limit(20)
    order = Window.orderBy(F.when(F.col("status") == "active", 0).otherwise(1), F.desc("created_at"), "label")
    return first.select("label", F.row_number().over(order).alias("place"))


@query("f5_latest_snapshot", "SELECT o_custkey AS source_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS snapshot_id FROM orders GROUP BY 1")
def latest_snapshot(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    return lifecycle.latest_snapshot(o.select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("snapshot_id"), F.col("o_orderdate").alias("fetched_at")))


@query(
    "d7_review_queue",
    f"""
WITH {REC}, base AS (SELECT * FROM rec), {DECIDE} SELECT 'e' || record_version_id AS event_id, record_version_id, CASE decision WHEN 'conflict' THEN 'same_tier_conflict' ELSE 'ambiguous_date' END AS reason, fetched_at AS created_at,
  record_id, record_type, source_url, freshness, verification, serving FROM decided WHERE decision IN ('conflict', 'ambiguous') AND doc_id % 3 <> 0""",
)
def review_queue(spark, sf_dir):
    """Every third event is settled, and there are events of other kinds."""
    r = A.records(spark, sf_dir)
    decided = versions.decide(r, F.lit("2024-07-01").cast("date")).filter("review is not null").select("record_version_id", F.col("review").alias("reason"))
    done = F.when(F.substring("record_version_id", 2, 20).cast("long") % 3 == 0, "approved").otherwise("pending")
    events = decided.join(r.select("record_version_id", F.col("fetched_at").alias("created_at")), "record_version_id").withColumns(
        {"event_id": F.concat(F.lit("e"), "record_version_id"), "event_type": F.lit("manual_review_required"), "status": done}
    )
    return lifecycle.review_queue(events.union(events.withColumn("event_type", F.lit("verified"))), r)


@query(
    "j12_mark_indexed",
    f"WITH {REC} SELECT record_version_id, CASE WHEN doc_id % 3 = 0 THEN 'indexed_active' ELSE serving END AS new_serving FROM rec",
)
def mark_indexed(spark, sf_dir):
    r = A.records(spark, sf_dir)
    return lifecycle.mark_indexed(r, r.filter("doc_id % 3 = 0")).select("record_version_id", "new_serving")


@query(
    "j2_decide_two_pass",
    f"""
WITH {REC}, base AS (SELECT * FROM rec WHERE record_type <> 'faculty_profile'), {DECIDE},
best AS (SELECT record_id, arg_max(decision, (decision = 'winner', decision IN ('winner', 'expired', 'older'), decision = 'winner', fetched_at, record_version_id)) AS d FROM decided GROUP BY record_id)
SELECT record_version_id, decision FROM decided UNION ALL
SELECT r.record_version_id, CASE WHEN d IS NULL THEN 'parent_unresolved' WHEN d <> 'winner' THEN 'parent_not_authoritative' ELSE 'winner' END FROM rec r LEFT JOIN best ON best.record_id = 'r' || ((r.doc_id + 1) % 400) WHERE r.record_type = 'faculty_profile'""",
)
def decide_two_pass(spark, sf_dir):
    r = A.records(spark, sf_dir)
    kid = F.col("record_type") == "faculty_profile"
    rows = r.withColumn("parent_record_id", F.when(kid, F.concat(F.lit("r"), (F.col("doc_id") + 1) % 400))).withColumn("parent_url", F.lit(None).cast("string"))
    return versions.decide_two_pass(rows.withColumn("record_type", F.when(kid, "faculty_award").otherwise(F.col("record_type"))), F.lit("2024-07-01").cast("date"))


@query(
    "j7_recompute",
    f"""
WITH RECURSIVE {REC}, e AS (SELECT record_version_id AS v, record_id AS k FROM rec UNION ALL SELECT record_version_id, dedupe_key FROM rec),
seen(v) AS (SELECT record_version_id FROM rec WHERE scope = 'src1:en' UNION SELECT b.v FROM seen JOIN e a ON a.v = seen.v JOIN e b ON b.k = a.k),
base AS (SELECT * FROM rec WHERE record_version_id IN (SELECT v FROM seen) AND verification <> 'rejected'), {DECIDE}
SELECT record_version_id, decision FROM decided UNION ALL SELECT record_version_id, 'rejected' FROM rec WHERE verification = 'rejected' AND record_version_id IN (SELECT v FROM seen)""",
)
def recompute(spark, sf_dir):
    lifecycle.ensure_checkpoints(spark)
    return lifecycle.recompute(A.records(spark, sf_dir), ["record_id", "dedupe_key"], F.col("scope") == "src1:en", F.lit("2024-07-01").cast("date"))


@query(
    "j10_generation",
    f"WITH {REC}, {TOP} SELECT first AS record_version_id, length('Source: ' || record_type || '_Source Locator: ' || source_url || '_Cycle: ' || cycle_label || '__' || trim(text, ' ' || chr(10) || chr(9))) > 2000 AS split FROM top JOIN rec ON record_version_id = first WHERE low = high",
)
def generation(spark, sf_dir):
    r = A.records(spark, sf_dir)
    return lifecycle.build_generation(r).groupBy("record_version_id").agg((F.max("chunk_index") > 0).alias("split"))


@query(
    "j10_generation_sections",
    f"""
WITH {R.RENDERED}, {TOP}, h AS (SELECT *, prefix || chr(10) || 'Source Locator: ' || source_url || chr(10) || 'Cycle: ' || cycle_label AS head FROM c),
a AS (SELECT record_version_id, record_type, list_transform(list_filter(sections, lambda s: s.text <> ''), lambda s: head || CASE WHEN s.label <> '' THEN chr(10) || 'Section: ' || s.label ELSE '' END || g || s.text) AS chunks FROM h)
SELECT record_version_id, record_type, chunks FROM a JOIN top ON record_version_id = first WHERE low = high AND len(list_filter(chunks, lambda x: length(x) > 2000)) = 0""",
)
def generation_sections(spark, sf_dir):
    """Chunks of the primaries by the sections of their payloads; of those whose sections all fit, as SQL can't split the others (see k2_chunk_split)."""
    r = R._payloads(spark, sf_dir)
    made = lifecycle.build_generation(r)
    grouped = made.groupBy("record_version_id", "record_type").agg(F.max("chunk_count").alias("n"), F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_text"))).alias("c"))
    sections = F.size(rendering.render_sections(F.col("record_type"), F.col("payload"), F.col("lists"))).alias("sections")
    return grouped.join(r.select("record_version_id", sections), "record_version_id").filter("n <= sections").select("record_version_id", "record_type", F.col("c.chunk_text").alias("chunks"))


@query(
    "g9_final_select",
    f"""
WITH {R.EV}, k AS (SELECT * REPLACE (sha256(source || doc_id % 3) AS dedupe_key, CAST(CASE WHEN contains(source_url, 'policy') THEN greatest(tier - 1, 1) ELSE tier END AS INTEGER) AS tier) FROM ev),
f AS (SELECT *, CASE tier WHEN 1 THEN 1.0 WHEN 2 THEN 0.99 WHEN 3 THEN 0.97 WHEN 4 THEN 0.95 ELSE 0.92 END AS f FROM k),
s AS (SELECT * EXCLUDE (f) REPLACE (round(score * f, 6) AS score) FROM f WHERE round(score * f, 6) >= 0.1),
m AS (SELECT *, min(tier) OVER (PARTITION BY query_id, dedupe_key) AS least FROM s),
p AS (SELECT query_id, dedupe_key, min(effective_hash) <> max(effective_hash) AS torn, arg_min(record_version_id, (-score, record_version_id)) AS best FROM m WHERE tier = least GROUP BY ALL),
h AS (SELECT m.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_version_id, chunk_id) AS pp FROM m JOIN p USING (query_id, dedupe_key) WHERE tier = least AND (torn OR record_version_id = best)),
d AS (SELECT *, dense_rank() OVER (PARTITION BY query_id, coalesce(nullif(source_url, ''), record_version_id) ORDER BY pp) AS dd FROM h),
v AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dd > 1, pp) <= 8),
n AS (SELECT *, coalesce(record_type = type_hint, false) AS hinted FROM v),
r AS (SELECT *, hinted AND row_number() OVER (PARTITION BY query_id, hinted ORDER BY score DESC, record_version_id, chunk_id) <= 2 AS r FROM n)
SELECT query_id, record_version_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_version_id) AS place
FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r DESC, score DESC, record_version_id) <= 8)""",
)
def final_select(spark, sf_dir):
    e = R._evidence(spark, sf_dir).withColumns({"dedupe_key": F.sha2(F.concat("source", F.col("doc_id") % 3), 256), "source_hint": F.lit("policy")})
    return search.final_select(e, 8).select("query_id", "record_version_id", "place")


@query(
    "d16_hydrate",
    f"""
WITH {REC}, {SRC} SELECT record_version_id, CASE WHEN doc_id % 3 = 0 THEN 'orig' WHEN doc_id % 3 = 1 THEN lang ELSE source END AS content
FROM rec LEFT JOIN src USING (source_url) WHERE coalesce(legal_status, 'allowed') NOT IN ('blocked', 'restricted') AND doc_id % 2 = 0""",
)
def hydrate(spark, sf_dir):
    r = A.records(spark, sf_dir)
    i = F.col("doc_id") % 3
    points = r.filter("doc_id % 2 = 0").select("record_version_id", F.when(i == 0, "orig").otherwise("").alias("original_text"), F.when(i == 1, F.col("lang")).alias("chunk_text"))
    return search.hydrate(points, r.withColumn("rendered", F.col("source")), A.sources(spark, sf_dir)).select("record_version_id", "content")


@query(
    "d18_expand_requests",
    f"""
WITH {R.ROUTES_SQL} SELECT doc_id AS query_id, len(routes) * 2 AS requests FROM routes WHERE len(routes) > 0""",
)
def expand_requests(spark, sf_dir):
    p = questions.prepare(R._questions(spark, sf_dir)).select(F.col("doc_id").alias("query_id"), "routes", F.array("text", F.upper("text")).alias("variants"))
    return search.expand_requests(p).groupBy("query_id").agg(F.count("*").alias("requests"))


@query(
    "i10_relaxed",
    f"""
WITH {R.EV}, a AS (SELECT DISTINCT query_id FROM ev WHERE record_type = type_hint AND score >= 0.6)
SELECT query_id, record_version_id, false AS relaxed FROM ev WHERE record_type = type_hint AND query_id IN (SELECT query_id FROM a)
UNION ALL SELECT query_id, record_version_id, true FROM ev WHERE query_id NOT IN (SELECT query_id FROM a)""",
)
def relaxed(spark, sf_dir):
    e = R._evidence(spark, sf_dir)
    return search.with_relaxed(e.filter("record_type = type_hint"), e, 0.6).select("query_id", "record_version_id", "relaxed")


@query(
    "e7_mixed_levels",
    """
WITH f AS (SELECT doc_id % 40 AS query_id, ['BS', 'MS', 'PHD'][doc_id % 3 + 1] AS p, source AS b FROM documents WHERE doc_id % 4 <> 0),
g AS (SELECT query_id, b, list_distinct(list(p)) AS ps FROM f GROUP BY ALL HAVING count(DISTINCT p) > 1) SELECT query_id, list_sort(list_distinct(flatten(list(ps)))) AS levels FROM g GROUP BY query_id""",
)
def mixed_levels(spark, sf_dir):
    i = F.col("doc_id")
    p = F.element_at(F.array(*map(F.lit, ("bs-", "ms_", "phd-", ""))), F.when(i % 4 == 0, 4).otherwise((i % 3 + 1).cast("int")))
    return answers.mixed_levels(A.table(spark, sf_dir, "documents").select((i % 40).alias("query_id"), F.concat(p, "source").alias("slug")))


@query(
    "e14_audit_rendering",
    "SELECT doc_id, list_filter([CASE WHEN NOT contains(lower(text), lower(lang)) THEN 'lang' END, CASE WHEN NOT contains(lower(text), lower(source)) THEN 'source' END], lambda x: x IS NOT NULL) AS missing FROM documents WHERE NOT contains(lower(text), lower(lang)) OR NOT contains(lower(text), lower(source))",
)
def audit_rendering(spark, sf_dir):
    return answers.audit_rendering(A.table(spark, sf_dir, "documents"), ["lang", "source"], "text").select("doc_id", "missing")


@query("e17_embedding_summary", "SELECT count(*) FILTER (WHERE length(text) % 5 <> 0) AS embedded, count(*) FILTER (WHERE length(text) % 5 = 0) AS failed FROM documents")
def embedding_summary(spark, sf_dir):
    def lengths(texts):
        if any(len(t) % 5 == 0 for t in texts):
            raise ValueError("bad text")
        return [[float(len(t))] for t in texts]

    return search.embedding_summary(search.embed(A.table(spark, sf_dir, "documents"), "doc_id", "text", lengths))


@query(
    "k10_finalize_answers",
    "SELECT doc_id AS query_id, CASE WHEN doc_id % 4 = 0 THEN 'no_evidence' WHEN doc_id % 3 = 0 THEN 'invalid_citation' WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'ungrounded' ELSE 'answered' END AS status FROM documents",
)
def finalize_answers(spark, sf_dir):
    d, i = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id")), F.col("query_id")
    gates = d.withColumn("status", F.when(i % 4 == 0, "no_evidence").otherwise("answerable"))
    cited = d.withColumn("status", F.when(i % 3 == 0, "unknown").otherwise("valid"))
    grounded = d.withColumn("passed", i % 5 != 0).withColumn("mode", F.when(i % 2 == 0, "full").otherwise("skip"))
    return answers.finalize_answers(gates, cited, grounded)


@query(
    "c24_semantic_identity",
    f"""
WITH {REC} SELECT record_version_id, CASE doc_id % 10
    WHEN 0 THEN source || '-aid-2' WHEN 1 THEN 'no name here' WHEN 2 THEN lower(lang) || ':fall dates:2024-01-05|2024-02-01' WHEN 3 THEN lower(lang) || ':fall dates:january - may'
    WHEN 4 THEN source || ':local:' || '::| a | b |' WHEN 5 THEN 'cited - ' || lower(source) WHEN 6 THEN 'https://lab.x.edu/a/' WHEN 7 THEN 'the ' || source || ' lab' WHEN 8 THEN 'prize of ' || lower(lang) ELSE lower(lang) END AS identity,
  [NULL, 'admissions_cycle', 'program_curriculum', NULL, 'program', 'document_landing', 'research_entity', 'policy_rule', 'scholarship', 'program_fee_schedule', 'faculty_profile', 'faculty_publication', 'document_asset', 'program'][doc_id % 14 + 1] AS inferred FROM rec""",
)
def semantic_identity(spark, sf_dir):
    """One of ten payloads, and of fourteen sets of keys, by the document's number."""
    r, l, o = A.records(spark, sf_dir), F.lit, F.col("source")
    of = lambda **kw: F.create_map(*(x for k, v in kw.items() for x in (l(k), v if not isinstance(v, str) else l(v))))
    made = [
        ("scholarship", of(scholarship_name=F.concat(o, l(" Aid – 2 ! ")), content="other")), ("scholarship", of(scholarship_name="  ", content="No  name * here.")),
        ("admissions_cycle", of(calendar_scope=F.col("lang"), milestone_name="Fall Dates", date_text="unused")), ("admissions_cycle", of(calendar_scope=F.col("lang"), milestone_name="Fall Dates", date_text="January — May.")),
        ("program_fee_schedule", of(program_name=o, audience="Local", fee_table_markdown="| a | b |")), ("faculty_publication", of(value_text=F.concat(l("Cited – "), o))),
        ("research_entity", of(canonical_center_url="HTTPS://Lab.X.edu/a?q=1", name="unused")), ("research_entity", of(name=F.concat(l("The "), o, l(" Lab")))),
        ("faculty_award", of(value_text=F.concat(l("Prize of "), F.col("lang")))), ("policy_rule", of(rule_text="unused")),
    ]
    pick = lambda items, n: F.element_at(F.array(*items), (F.col("doc_id") % n + 1).cast("int"))
    dates = F.when(F.col("doc_id") % 10 == 2, F.array(l("2024-01-05"), l(" "), l(" 2024-02-01"))).otherwise(F.array().cast("array<string>"))
    sets = (
        ("program_name",), ("date_text", "milestone_name"), ("curriculum_table_text", "rule_text"), ("milestone_name",), ("program_name", "degree_level"), ("linked_document_urls", "rule_text"),
        ("main_site_url",), ("rule_title", "scholarship_name"), ("benefit_text",), ("fee_table_markdown",), ("biography_text",), ("raw_citation", "filename"), ("filename",), ("overview_text", "program_name"),
    )
    keys = pick([of(**{k: F.lit(None).cast("string") for k in ks}) for ks in sets], 14)
    identity = T.semantic_identity(pick([l(k) for k, _ in made], 10), pick([m for _, m in made], 10), F.col("lang"), dates)
    return r.select("record_version_id", identity.alias("identity"), T.infer_record_type(keys).alias("inferred"))
