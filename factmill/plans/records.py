"""Queries over record versions: identity, validation, currentness, duplicates, lifecycle."""

from __future__ import annotations

from pyspark.sql import functions as F

from factmill.functions import text as T
from factmill.functions import urls as U
from factmill.operators import dedupe, filters, lifecycle, versions

from . import adapters as A
from .adapters import RECORDS_SQL as REC
from .adapters import SOURCES_SQL as SRC
from .adapters import VISITS_SQL as VIS
from .catalog import Catalog

query = Catalog()
QUERIES, ORACLE = query.queries, query.oracle

PATH = "regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"


@query(
    "c1_url_identity",
    f"""
SELECT page_id, s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END AS canonical_url,
  regexp_replace(s || '://' || h || CASE WHEN p = '' THEN '/' ELSE p END, '/+$', '') || '/' AS url_identity,
  len(list_filter(string_split(lower(p), '/'), lambda x: x <> '')) + CASE WHEN regexp_matches(lower(p), 'norms|policy|criteria|eligibility|schedule') THEN 2 ELSE 0 END AS specificity,
  list_filter(string_split(p, '/'), lambda x: x <> '')[-1] AS page_slug
FROM (SELECT page_id, lower(regexp_extract(url, '^([^:/?#]+)://', 1)) AS s, lower(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1)) AS h, {PATH} AS p FROM pages)""",
)
def url_identity(spark, sf_dir):
    u = F.col("url")
    return A.table(spark, sf_dir, "pages").select(
        "page_id", U.canonicalize_url(u).alias("canonical_url"), U.url_identity(u).alias("url_identity"),
        U.source_specificity(u).alias("specificity"), U.page_slug(u).alias("page_slug"),
    )


#: Paths with the class that the rule gives each, written by hand.
PATH_CLASSES = (
    ("/", "general"), ("", "general"), ("/admissions/", "admissions_cycle"), ("/admissions/bs-cs", "program"), ("/Admissions/BS-CS", "program"), ("/admissions/apply-now", "admissions_cycle"),
    ("/x/admissions/bs", "admissions_cycle"), ("/admissions/fee-refund", "program_fee_schedule"), ("/admissions/eligibility", "admissions_cycle"), ("/fee-structure", "program_fee_schedule"),
    ("/coffee", "general"), ("/fees", "general"), ("/my_fee_page", "general"), ("/tuition/2024", "program_fee_schedule"), ("/merit/list", "merit_list"), ("/emeritus", "merit_list"),
    ("/scholarships", "scholarship"), ("/financial-aid/x", "scholarship"), ("/faculty/dr-kafeel", "faculty"), ("/research/", "research_main"), ("/research/labs", "research_main"),
    ("/library/research/a", "library"), ("/research", "general"), ("/newsroom", "news_event"), ("/events/1", "news_event"), ("/policy/attendance", "policy"), ("/regulations", "policy"),
    ("/student-services", "student_service"), ("/placement", "student_service"), ("/library", "library"), ("/about-us", "university_info"), ("/academic-calendar", "university_info"),
    ("/vision", "university_info"), ("/files/rules.PDF", "document_asset"), ("/files/a.docx", "document_asset"), ("/files/a.txt", "general"), ("/.pdf", "general"), ("/admissions/plan.xlsx", "document_asset"),
)
CLASS_ROWS = ", ".join(f"({i}, '{p}', '{c}')" for i, (p, c) in enumerate(PATH_CLASSES))


@query(
    "c4_source_policy",
    f"""
WITH c(i, path, source_class) AS (VALUES {CLASS_ROWS})
SELECT doc_id, source_class, source_class IN ('admissions_cycle', 'program_fee_schedule', 'merit_list') AS is_high_risk, suffix,
  CASE suffix WHEN '.pdf' THEN 'application/pdf' WHEN '.docx' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document'
    WHEN '.xlsx' THEN 'application/vnd.openxmlformats-officedocument.spreadsheetml.sheet' ELSE 'application/octet-stream' END AS media_type,
  CASE WHEN source_class IN ('admissions_cycle', 'program', 'program_fee_schedule', 'merit_list') THEN 'admissions' END AS family,
  CASE WHEN source_class = 'document_asset' THEN 'document' ELSE 'page' END AS parser_target
FROM (SELECT doc_id, source_class, coalesce(nullif(regexp_extract(lower(path), '[.](pdf|docx?|xlsx?|csv|pptx?)$', 0), ''), '.bin') AS suffix
  FROM documents JOIN c ON i = doc_id % {len(PATH_CLASSES)})""",
)
def source_policy(spark, sf_dir):
    paths = F.array(*(F.lit(p) for p, _ in PATH_CLASSES))
    link = F.concat(F.lit("https://x.edu"), F.element_at(paths, (F.col("doc_id") % len(PATH_CLASSES) + 1).cast("int")), F.when(F.col("doc_id") % 5 == 0, "?q=fee").otherwise(""))
    d = A.table(spark, sf_dir, "documents").withColumn("url", link)
    return d.select("doc_id", U.source_policy(F.col("url")).alias("p"), U.document_suffix(F.col("url")).alias("suffix"), U.media_type(F.col("url")).alias("media_type")).select(
        "doc_id", "p.source_class", "p.is_high_risk", "suffix", "media_type", U.source_family(F.col("p.source_class")).alias("family"),
        U.parser_target(F.col("p.source_class"), F.col("p.canonical_url")).alias("parser_target"),
    )


@query(
    "c7_authority_tier",
    """
SELECT doc_id, CASE WHEN p = 'dedicated_child' AND c = 'page_body' THEN 1
  WHEN p IN ('dedicated_child', 'dedicated_section') AND c IN ('structured_section', 'table') THEN 2
  WHEN p = 'official_document' THEN 3 WHEN p = 'overview' THEN 4 WHEN p = 'navigation' THEN 5 END AS tier
FROM (SELECT doc_id, ['dedicated_child', 'dedicated_section', 'official_document', 'overview', 'navigation', 'other'][doc_id % 6 + 1] AS p,
  ['page_body', 'structured_section', 'table', 'text'][doc_id % 4 + 1] AS c FROM documents)""",
)
def authority_tier(spark, sf_dir):
    pick = lambda n, names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % n + 1).cast("int"))
    page = pick(6, ("dedicated_child", "dedicated_section", "official_document", "overview", "navigation", "other"))
    return A.table(spark, sf_dir, "documents").select(
        "doc_id", U.authority_tier(page, pick(4, ("page_body", "structured_section", "table", "text"))).alias("tier")
    )


SLUG = "regexp_replace(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    "c9_slugs",
    f"""
SELECT doc_id, CASE WHEN length(s) <= 60 THEN s ELSE substr(s, 1, 47) || '-' || substr(sha256(s), 1, 12) END AS clamped,
  substr(s, 1, 50) || '-' || substr(sha256(t), 1, 10) AS stable FROM (SELECT doc_id, t, {SLUG.format("t")} AS s FROM (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents))""",
)
def slugs(spark, sf_dir):
    t = F.split_part("text", F.lit("\n"), F.lit(1))
    return A.table(spark, sf_dir, "documents").select("doc_id", U.clamp_slug(t).alias("clamped"), U.stable_slug(t).alias("stable"))


@query(
    "c20_value_hash",
    """
SELECT doc_id, v AS value_hash, substr(sha256('r' || (doc_id % 400) || '|' || v), 1, 32) AS record_version_id, sha256(n) AS semantic_hash,
  sha256('d' || doc_id || '|' || v || '|m1') AS cache_key
FROM (SELECT doc_id, sha256(regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g')) AS v,
  lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(translate(text, '–—―−', '----'), '[ \\t\\n\\x0B\\f\\r]*\\*[ \\t\\n\\x0B\\f\\r]*', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r.,;:!?]+$', ''), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'), '^ | $', '', 'g')) AS n FROM documents)""",
)
def value_hash(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").withColumn("v", T.value_hash(F.col("text"), F.lit("")))
    return d.select(
        "doc_id", F.col("v").alias("value_hash"), T.record_version_id(F.concat(F.lit("r"), F.col("doc_id") % 400), F.col("v")).alias("record_version_id"),
        F.sha2(T.semantic_normalize(F.col("text")), 256).alias("semantic_hash"), T.cache_key(F.concat(F.lit("d"), "doc_id"), F.col("v"), F.lit("m1")).alias("cache_key"),
    )


@query(
    "c28_query_dedupe",
    """
SELECT near AS query_key, count(*) AS queries, count(DISTINCT lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')))) AS exact_keys
FROM (SELECT text, array_to_string(list_sort(list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')), ' ') AS near
  FROM conversations WHERE role = 'user') GROUP BY near""",
)
def query_dedupe(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").filter("role = 'user'")
    return c.groupBy(T.query_key_near(F.col("text")).alias("query_key")).agg(
        F.count("*").alias("queries"), F.count_distinct(T.query_key(F.col("text"))).alias("exact_keys")
    )


@query(
    "b1_validate_records",
    """
SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN 1 ELSE 0 END + CASE WHEN doc_id % 15 = 4 THEN 1 ELSE 0 END AS faults,
  CASE WHEN doc_id % 10 = 3 OR doc_id % 15 = 4 THEN 'invalid' ELSE 'valid' END AS outcome FROM documents""",
)
def validate_records(spark, sf_dir):
    i = F.col("doc_id")
    tier = F.when(i % 15 == 4, "true").otherwise("2")
    fields = [f'"{k}": "x"' for k in filters.REQUIRED[:-1] if k != "dedupe_key"]
    json = F.concat(F.lit("{" + ", ".join(fields) + ", "), F.when(i % 10 == 3, "").otherwise('"dedupe_key": null, '), F.lit('"source_authority_tier": '), tier, F.lit("}"))
    payload = F.variant_get(F.parse_json(json), "$", "map<string,variant>")
    valid, invalid = filters.validate_records(A.table(spark, sf_dir, "documents").select("doc_id", payload.alias("payload")))
    return valid.select("doc_id", F.lit(0).alias("faults"), F.lit("valid").alias("outcome")).union(
        invalid.select("doc_id", F.size("missing").alias("faults"), F.lit("invalid").alias("outcome"))
    )


@query(
    "b20_constraints",
    f"""
WITH {REC}, v AS (SELECT
  sum(CASE WHEN NOT (verification IN ('pending', 'verified', 'rejected')) THEN 1 ELSE 0 END) AS verification_enum,
  sum(CASE WHEN NOT (freshness IN ('current', 'contradictory', 'unknown', 'removed', 'restricted', 'stale')) THEN 1 ELSE 0 END) AS freshness_enum,
  sum(CASE WHEN NOT (serving IN ('ineligible', 'eligible', 'pending_index')) THEN 1 ELSE 0 END) AS serving_enum,
  sum(CASE WHEN NOT (tier BETWEEN 1 AND 5) THEN 1 ELSE 0 END) AS tier_range,
  sum(CASE WHEN NOT (year_confidence IN ('high', 'low', 'unknown')) THEN 1 ELSE 0 END) AS year_confidence_enum,
  sum(CASE WHEN NOT (NOT authoritative OR verification = 'verified') THEN 1 ELSE 0 END) AS authoritative_needs_verified,
  sum(CASE WHEN NOT (NOT authoritative OR freshness = 'current') THEN 1 ELSE 0 END) AS authoritative_needs_current,
  sum(CASE WHEN NOT (effective_from <= effective_to) THEN 1 ELSE 0 END) AS interval_order FROM rec)
SELECT rule, violations FROM (UNPIVOT v ON COLUMNS(*) INTO NAME rule VALUE violations)""",
)
def constraints(spark, sf_dir):
    return filters.constraint_report(A.records(spark, sf_dir))


@query(
    "b2_queryable_records",
    f"""
WITH {REC}, {SRC}
SELECT record_version_id, coalesce(source_class, 'general') AS source_class, serving = 'eligible' AS can_serve
FROM rec LEFT JOIN src USING (source_url)
WHERE verification = 'verified' AND freshness = 'current' AND authoritative AND serving IN ('eligible', 'pending_index', 'indexed_active')
  AND coalesce(legal_status, 'allowed') NOT IN ('blocked', 'restricted') AND source_class IN ('policy', 'document_asset')""",
)
def queryable_records(spark, sf_dir):
    r = lifecycle.with_source(A.records(spark, sf_dir), A.sources(spark, sf_dir))
    kept = r.filter(filters.is_queryable() & filters.source_allowed(F.col("legal_status")) & filters.source_class_matches(F.col("source_class"), F.lit("policy")))
    return kept.select("record_version_id", "source_class", filters.can_serve().alias("can_serve"))


DUE = """
SELECT source_id, max(ts) AS last, max(CASE WHEN ok THEN ts END) AS last_ok FROM vis GROUP BY source_id"""
KIND = "CASE CAST(substr(source_id, 2) AS BIGINT) % 4 WHEN 0 THEN 'merit_list' WHEN 1 THEN 'policy' WHEN 2 THEN 'news_event' ELSE 'other' END"
POLICY = "CASE CAST(substr(source_id, 2) AS BIGINT) % 5 WHEN 0 THEN 'manual_only' WHEN 1 THEN 'weekly' WHEN 2 THEN 'every_6_hours_while_active_daily_otherwise' WHEN 3 THEN 'daily_during_season_weekly_otherwise' ELSE 'monthly' END"


@query(
    "b12_due_and_grace",
    f"""
WITH {VIS}, s AS ({DUE}), k AS (SELECT *, {KIND} AS kind, {POLICY} AS policy FROM s),
h AS (SELECT *, CASE policy WHEN 'manual_only' THEN NULL WHEN 'weekly' THEN 168
    WHEN 'every_6_hours_while_active_daily_otherwise' THEN CASE WHEN kind = 'merit_list' THEN 6 ELSE 24 END
    WHEN 'daily_during_season_weekly_otherwise' THEN CASE WHEN kind = 'merit_list' THEN 24 ELSE 168 END ELSE 0 END AS hours,
  CASE kind WHEN 'merit_list' THEN 12 WHEN 'policy' THEN 336 WHEN 'news_event' THEN 48 END AS grace FROM k)
SELECT source_id, hours IS NOT NULL AND date_diff('microsecond', last, TIMESTAMP '2024-05-01') / 3.6e9 >= hours AS due,
  coalesce(date_diff('microsecond', last_ok, TIMESTAMP '2024-02-05') / 3.6e9 <= coalesce(grace, nullif(2 * hours, 0), 336), false) AS in_grace FROM h""",
)
def due_and_grace(spark, sf_dir):
    s = A.visits(spark, sf_dir).groupBy("source_id").agg(F.max("ts").alias("last"), F.max(F.when(F.col("ok"), F.col("ts"))).alias("last_ok"))
    k = s.withColumn("kind", F.expr(KIND)).withColumn("policy", F.expr(POLICY))
    at = lambda day: F.lit(day).cast("timestamp_ntz")
    return k.select(
        "source_id", filters.is_refresh_due(F.col("policy"), F.col("kind"), F.col("last"), at("2024-05-01")).alias("due"),
        filters.within_grace(F.col("kind"), F.col("policy"), F.col("last_ok"), at("2024-02-05")).alias("in_grace"),
    )


@query(
    "b16_expired_uncertain",
    f"""
WITH {REC} SELECT record_version_id, coalesce(effective_to < DATE '2024-07-01', false) AS expired,
  CASE WHEN freshness <> 'current' THEN 'not_current' WHEN record_type = 'merit_list' AND year_confidence IN ('low', 'unknown') THEN 'ambiguous_year' END AS reason FROM rec""",
)
def expired_uncertain(spark, sf_dir):
    r = filters.drop_uncertain(A.records(spark, sf_dir))
    return r.select("record_version_id", filters.is_expired(F.col("effective_to"), F.lit("2024-07-01").cast("date")).alias("expired"), "reason")


@query(
    "b17_rewrite_gate",
    """
SELECT conv_id, turn, CASE WHEN trim(r) <> '' AND NOT contains(trim(r), chr(10)) AND length(trim(r)) / greatest(length(text), 1) BETWEEN 0.3 AND 3.0 THEN trim(r) ELSE text END AS query,
  regexp_matches(lower(text), '\\b(rate|percentage|ratio|number of|average|median|total number)\\b') AS numeric
FROM (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN split_part(text, '.', 1) WHEN 1 THEN text || text || text || text ELSE '' END AS r FROM conversations)""",
)
def rewrite_gate(spark, sf_dir):
    t = F.col("text")
    r = F.when(F.col("turn") % 3 == 0, F.split_part(t, F.lit("."), F.lit(1))).when(F.col("turn") % 3 == 1, F.concat(t, t, t, t)).otherwise("")
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", filters.rewrite_gate(t, r).alias("query"), filters.expects_numeric(t).alias("numeric"))


@query(
    "b19_locator_match",
    """
WITH k AS (SELECT page_id, lower(regexp_extract(url, '^([^:/?#]+)://', 1)) || '://' || lower(regexp_extract(url, '^[^:/?#]+://([^/?#:]*)', 1)) || regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') || '/' AS k FROM pages),
g AS (SELECT k, count(*) AS n, min(page_id) AS link_id FROM k GROUP BY k)
SELECT k.page_id AS request_id, CASE WHEN n = 1 THEN link_id END AS link_id FROM k JOIN g USING (k)""",
)
def locator_match(spark, sf_dir):
    p = A.table(spark, sf_dir, "pages")
    return filters.resolve_locator_match(p.select(F.col("page_id").alias("request_id"), "url"), p.select(F.col("page_id").alias("link_id"), "url"), U.url_identity).drop("url")


@query(
    "d1_combine_scopes",
    f"""
WITH {REC}, inc AS (SELECT * FROM rec WHERE doc_id % 10 = 1), old AS (SELECT * FROM rec WHERE doc_id % 10 <> 2)
SELECT scope, count(*) AS rows, count(*) FILTER (WHERE doc_id % 10 = 1) AS incoming FROM old WHERE scope IN (SELECT scope FROM inc) GROUP BY scope""",
)
def combine_scopes(spark, sf_dir):
    r = A.records(spark, sf_dir)
    both = versions.combine_scopes(r.filter("doc_id % 10 <> 2"), r.filter("doc_id % 10 = 1"))
    return both.groupBy("scope").agg(F.count("*").alias("rows"), F.sum("side").alias("incoming"))


@query(
    "d2_same_tier_conflict",
    f"""
WITH {REC}, k AS (SELECT * REPLACE (CASE record_type WHEN 'policy_rule' THEN 'admissions_cycle' ELSE record_type END AS record_type, source_url || CASE WHEN doc_id % 15 = 0 THEN '/policy/a' ELSE '' END AS source_url),
    CASE WHEN record_type IN ('merit_list', 'policy_rule') AND doc_id % 9 <> 2 THEN cycle_label END AS cycle, len(list_filter(string_split(lang || CASE WHEN doc_id % 15 = 0 THEN '/policy/a' ELSE '' END, '/'), lambda x: x <> '')) + CASE WHEN doc_id % 15 = 0 THEN 2 ELSE 0 END AS spec FROM rec),
w AS (SELECT *, (spec, coalesce(effective_from, DATE '0001-01-01'), fetched_at) AS rank FROM k WHERE record_type <> 'faculty_profile'),
p AS (SELECT a.record_version_id, max(b.rank) AS other FROM w a JOIN w b ON a.scope = b.scope AND a.tier = b.tier AND a.record_type = b.record_type AND a.effective_hash <> b.effective_hash
  AND (a.cycle IS NULL OR b.cycle IS NULL OR a.cycle = b.cycle) GROUP BY 1)
SELECT scope, tier, record_type, cycle, effective_hash, list_sort(list(record_version_id)) AS ids FROM w JOIN p USING (record_version_id) WHERE record_type <> 'admissions_cycle' OR rank <= other GROUP BY ALL""",
)
def same_tier_conflict(spark, sf_dir):
    """Policies count as milestones here, a ninth of rows have no cycle, a fifteenth a more specific URL."""
    r, i = A.records(spark, sf_dir), F.col("doc_id")
    kind = F.when(F.col("record_type") == "policy_rule", "admissions_cycle").otherwise(F.col("record_type"))
    url = F.concat("source_url", F.when(i % 15 == 0, "/policy/a").otherwise(""))
    return versions.same_tier_conflicts(r.withColumns({"record_type": kind, "cycle_label": F.when(i % 9 != 2, F.col("cycle_label")), "source_url": url}))


LATEST = "ORDER BY effective_from DESC NULLS LAST, fetched_at DESC, tier, record_version_id DESC"


@query(
    "f1_latest_version",
    f"""
WITH {REC} SELECT record_version_id, row_number() OVER w = 1 AS is_latest,
  CASE WHEN row_number() OVER w = 1 THEN 'latest' WHEN effective_hash = first_value(effective_hash) OVER w THEN 'newer_duplicate' ELSE 'newer_exists' END AS reason
FROM rec WINDOW w AS (PARTITION BY scope, record_type {LATEST})""",
)
def latest_version(spark, sf_dir):
    return versions.latest_version(A.records(spark, sf_dir)).select("record_version_id", "is_latest", "reason")


@query(
    "f1_latest_per_customer",
    """
SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def latest_per_customer(spark, sf_dir):
    o = A.table(spark, sf_dir, "orders")
    return o.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o")).select("o_custkey", "o.*")


@query(
    "f2_latest_cycle",
    f"""
WITH {REC}, c AS (SELECT *, year_confidence IN ('low', 'unknown') AS ambiguous FROM rec WHERE record_type = 'merit_list')
SELECT record_version_id, CASE WHEN ambiguous THEN 'pending' WHEN row_number() OVER (PARTITION BY scope, record_type, ambiguous
  ORDER BY effective_from DESC NULLS LAST, fetched_at DESC, tier, record_id DESC, record_version_id DESC) = 1 THEN 'current' ELSE 'stale' END AS outcome FROM c""",
)
def latest_cycle(spark, sf_dir):
    return versions.latest_cycle(A.records(spark, sf_dir)).select("record_version_id", "outcome")


PARENT = "(authoritative, verification = 'verified', freshness = 'current', verification = 'verified' AND freshness = 'current' AND authoritative AND serving = 'eligible', fetched_at, record_version_id)"


@query(
    "d3_parent_state",
    f"""
WITH {REC}, ranked AS (SELECT *, coalesce(authoritative, false) AS auth FROM rec),
one AS (SELECT record_id, source_url, record_version_id AS pv, authoritative AS pa, verification = 'verified' AS pver, freshness = 'current' AS pc, fetched_at,
  authoritative AND verification = 'verified' AND freshness = 'current' AND serving = 'eligible' AS ps FROM rec),
i AS (SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY pa DESC NULLS LAST, pver DESC, pc DESC, ps DESC NULLS LAST, fetched_at DESC, pv DESC) AS n FROM one),
u AS (SELECT *, row_number() OVER (PARTITION BY source_url ORDER BY pa DESC NULLS LAST, pver DESC, pc DESC, ps DESC NULLS LAST, fetched_at DESC, pv DESC) AS n FROM one),
kids AS (SELECT record_version_id, CASE WHEN doc_id % 3 = 0 THEN 'r' || (doc_id % 900) END AS pid, CASE WHEN doc_id % 3 <> 2 THEN source_url END AS purl FROM rec WHERE record_type = 'faculty_profile')
SELECT k.record_version_id, CASE WHEN pid IS NOT NULL THEN i.pv ELSE u.pv END AS parent_version_id, CASE WHEN pid IS NOT NULL THEN i.pa ELSE u.pa END AS parent_authoritative,
  CASE WHEN pid IS NOT NULL THEN i.pc ELSE u.pc END AS parent_current, CASE WHEN pid IS NOT NULL THEN i.pv ELSE u.pv END IS NOT NULL AS parent_resolved
FROM kids k LEFT JOIN i ON k.pid = i.record_id AND i.n = 1 LEFT JOIN u ON k.purl = u.source_url AND u.n = 1""",
)
def parent_state(spark, sf_dir):
    r = A.records(spark, sf_dir)
    i = F.col("doc_id")
    kids = r.filter("record_type = 'faculty_profile'").select(
        "record_version_id", F.when(i % 3 == 0, F.concat(F.lit("r"), i % 900)).alias("parent_record_id"), F.when(i % 3 != 2, F.col("source_url")).alias("parent_url")
    )
    return versions.parent_state(kids, r).select("record_version_id", "parent_version_id", "parent_authoritative", "parent_current", "parent_resolved")


@query(
    "d21_corroborated",
    f"""
WITH {REC} SELECT record_version_id FROM rec a WHERE EXISTS (SELECT 1 FROM rec b WHERE b.effective_hash = a.effective_hash AND b.record_version_id <> a.record_version_id
  AND (b.year_confidence = 'high' OR b.source_url <> a.source_url OR EXISTS (SELECT 1 FROM rec c WHERE c.effective_hash = a.effective_hash AND c.source_url <> a.source_url)))""",
)
def corroborated(spark, sf_dir):
    return versions.corroborated(A.records(spark, sf_dir)).select("record_version_id")


@query(
    "f4_superseded",
    f"""
WITH {REC}, n AS (SELECT scope, record_version_id AS superseded_by FROM rec WHERE authoritative AND doc_id // 100 % 2 = 1
  QUALIFY row_number() OVER (PARTITION BY scope ORDER BY effective_from DESC NULLS LAST, tier, record_version_id DESC) = 1)
SELECT record_version_id, superseded_by, CASE WHEN serving IN ('indexed_active', 'pending_index') THEN 'pending_deindex' ELSE 'ineligible' END AS new_serving
FROM rec JOIN n USING (scope) WHERE authoritative AND doc_id // 100 % 2 = 0 AND record_version_id <> superseded_by""",
)
def superseded(spark, sf_dir):
    r = A.records(spark, sf_dir)
    return versions.link_superseded(r.filter("doc_id div 100 % 2 = 0"), r.filter("doc_id div 100 % 2 = 1"))


DECIDE = f"""
k AS (SELECT *, CASE WHEN record_type = 'merit_list' THEN cycle_label ELSE '' END AS cycle, year_confidence IN ('low', 'unknown') AS ambiguous FROM base),
w AS (SELECT *, record_type <> 'faculty_profile' AND min(effective_hash) OVER c <> max(effective_hash) OVER c AS torn,
  row_number() OVER (PARTITION BY scope, record_type {LATEST}) AS newest,
  row_number() OVER (PARTITION BY scope, record_type, ambiguous ORDER BY effective_from DESC NULLS LAST, fetched_at DESC, tier, record_id DESC, record_version_id DESC) AS cyc
  FROM k WINDOW c AS (PARTITION BY scope, tier, record_type, cycle)),
decided AS (SELECT *, CASE WHEN coalesce(effective_to < DATE '2024-07-01', false) THEN 'expired'
  WHEN torn AND record_type NOT IN ('faculty_profile', 'policy_rule') THEN 'conflict'
  WHEN record_type = 'merit_list' AND ambiguous THEN 'ambiguous' WHEN record_type = 'merit_list' AND cyc > 1 THEN 'older'
  WHEN record_type <> 'merit_list' AND newest > 1 THEN 'older' ELSE 'winner' END AS decision FROM w)"""


@query(
    "j1_decide",
    f"""
WITH {REC}, base AS (SELECT * FROM rec), {DECIDE}
SELECT record_version_id, decision, CASE decision WHEN 'conflict' THEN 'pending' WHEN 'ambiguous' THEN 'pending' ELSE 'verified' END AS new_verification,
  CASE decision WHEN 'expired' THEN 'stale' WHEN 'older' THEN 'stale' WHEN 'conflict' THEN 'contradictory' WHEN 'ambiguous' THEN 'unknown' ELSE 'current' END AS new_freshness,
  CASE decision WHEN 'winner' THEN 'eligible' ELSE 'ineligible' END AS new_serving FROM decided""",
)
def decide(spark, sf_dir):
    return versions.decide(A.records(spark, sf_dir), F.lit("2024-07-01").cast("date")).select(
        "record_version_id", "decision", "new_verification", "new_freshness", "new_serving"
    )


@query(
    "j3_upsert_records",
    f"""
WITH {REC}, base AS (SELECT *, CASE WHEN doc_id % 10 = 1 THEN 1 ELSE 0 END AS side FROM rec WHERE scope IN (SELECT scope FROM rec WHERE doc_id % 10 = 1 AND lang <> 'de')), {DECIDE},
closed AS (SELECT DISTINCT scope FROM decided WHERE side = 1 AND decision IN ('conflict', 'ambiguous'))
SELECT record_version_id, decision, CASE WHEN scope IN (SELECT scope FROM closed) THEN CASE WHEN serving IN ('pending_index', 'indexed_active') THEN 'pending_deindex' ELSE 'ineligible' END
  WHEN decision = 'winner' THEN 'eligible' ELSE 'ineligible' END AS new_serving FROM decided
UNION ALL SELECT record_version_id, NULL, serving FROM rec WHERE scope NOT IN (SELECT scope FROM base)""",
)
def upsert_records(spark, sf_dir):
    r = A.records(spark, sf_dir)
    return versions.upsert_records(r.filter("NOT (doc_id % 10 = 1 AND lang <> 'de')"), r.filter("doc_id % 10 = 1 AND lang <> 'de'"), F.lit("2024-07-01").cast("date")).select(
        "record_version_id", "decision", "new_serving"
    )


SERV = "verification = 'verified' AND freshness = 'current' AND authoritative AND serving = 'eligible'"
TOP = f"""
v AS (SELECT * FROM rec WHERE {SERV}),
t AS (SELECT *, min(tier) OVER (PARTITION BY dedupe_key) AS least FROM v),
top AS (SELECT dedupe_key, min(effective_hash) AS low, max(effective_hash) AS high, min(record_version_id) AS first FROM t WHERE tier = least GROUP BY dedupe_key)"""


@query("e1_primaries", f"WITH {REC}, {TOP} SELECT dedupe_key, first AS record_version_id FROM top WHERE low = high")
def primaries(spark, sf_dir):
    return dedupe.resolve_duplicates(A.records(spark, sf_dir))[0]


@query(
    "e1_links",
    f"WITH {REC}, {TOP} SELECT first AS primary, record_version_id AS supporting FROM v JOIN top ON v.dedupe_key = top.dedupe_key AND v.effective_hash = low WHERE low = high AND record_version_id <> first",
)
def links(spark, sf_dir):
    return dedupe.resolve_duplicates(A.records(spark, sf_dir))[1]


@query(
    "e1_conflicts",
    f"""
WITH {REC.replace("sha256(text) AS dedupe_key", "sha256(source || (d.doc_id % 50)) AS dedupe_key")}, {TOP}
SELECT dedupe_key, list_sort(list(record_version_id)) AS conflict_ids FROM t JOIN top USING (dedupe_key) WHERE tier = least AND low <> high GROUP BY dedupe_key""",
)
def conflicts(spark, sf_dir):
    r = A.records(spark, sf_dir).withColumn("dedupe_key", F.sha2(F.concat("source", F.col("doc_id") % 50), 256))
    return dedupe.resolve_duplicates(r)[2]


@query(
    "e2_authority",
    f"""
WITH {REC}, g AS (SELECT * FROM rec WHERE verification = 'verified' AND freshness = 'current'), m AS (SELECT *, min(tier) OVER (PARTITION BY scope) AS least FROM g),
top AS (SELECT scope, min(effective_hash) AS low, max(effective_hash) AS high, min((record_version_id, dedupe_key)) AS f, count(DISTINCT record_version_id) AS n FROM m WHERE tier = least GROUP BY scope)
SELECT s.scope, CASE WHEN low IS NULL THEN 'insufficient' WHEN low <> high THEN 'contradictory' ELSE 'resolved' END AS status,
  CASE WHEN low = high THEN f[1] END AS primary_id, CASE WHEN low <> high THEN n END AS contenders,
  CASE WHEN low = high THEN (SELECT count(*) FROM g WHERE g.scope = s.scope AND g.dedupe_key = f[2]) - 1 END AS supporting
FROM (SELECT DISTINCT scope FROM rec) s LEFT JOIN top USING (scope)""",
)
def authority(spark, sf_dir):
    return dedupe.resolve_authority(A.records(spark, sf_dir))


@query(
    "e4_contradictory_scopes",
    f"WITH {REC}, p AS (SELECT scope, tier, count(DISTINCT effective_hash) AS hashes FROM rec GROUP BY ALL) SELECT scope, arg_min(hashes, tier) AS hashes, min(tier) AS tier FROM p GROUP BY scope HAVING arg_min(hashes, tier) > 1",
)
def contradictory_scopes(spark, sf_dir):
    return dedupe.contradictory_scopes(A.records(spark, sf_dir))


@query(
    "e5_duplicate_keys",
    f"WITH {REC} SELECT dedupe_key, count(DISTINCT record_version_id) AS versions FROM rec WHERE authoritative GROUP BY dedupe_key HAVING count(DISTINCT record_version_id) > 1",
)
def duplicate_keys(spark, sf_dir):
    return dedupe.duplicate_violations(A.records(spark, sf_dir))


@query(
    "j4_supporting_links",
    f"""
WITH {REC}, {TOP}, torn AS (SELECT record_version_id FROM t JOIN top USING (dedupe_key) WHERE tier = least AND low <> high)
SELECT record_version_id, CASE WHEN record_version_id IN (SELECT record_version_id FROM torn) THEN 'contradictory' ELSE freshness END AS new_freshness FROM rec""",
)
def supporting_links(spark, sf_dir):
    return lifecycle.persist_links(A.records(spark, sf_dir))[0].select("record_version_id", "new_freshness")


@query(
    "j9_apply_visits",
    f"""
WITH {VIS} SELECT source_id, max(ts) FILTER (WHERE ok) AS last_success_at, max(ts) AS last_seen_at, count(*) FILTER (WHERE NOT ok) AS failures,
  CASE WHEN arg_max(ok, (ts, event_id)) THEN 'verified_live' ELSE 'failed:error' END AS crawl_status FROM vis GROUP BY source_id""",
)
def apply_visits(spark, sf_dir):
    return lifecycle.apply_visits(A.visits(spark, sf_dir))


@query(
    "j5_expire_failed",
    f"""
WITH {REC}, {VIS}, s AS (SELECT source_id, max(ts) FILTER (WHERE ok) AS ok_at, arg_max(ok, (ts, event_id)) AS last_ok FROM vis GROUP BY source_id),
bad AS (SELECT source_id FROM s WHERE NOT last_ok AND coalesce(date_diff('microsecond', ok_at, TIMESTAMP '2024-02-15') / 3.6e9 > 336, true))
SELECT record_version_id, 'unknown' AS new_freshness, CASE WHEN serving IN ('indexed_active', 'pending_index') THEN 'pending_deindex' ELSE 'ineligible' END AS new_serving
FROM rec WHERE freshness = 'current' AND 's' || (doc_id % 200) IN (SELECT source_id FROM bad)""",
)
def expire_failed(spark, sf_dir):
    r = A.records(spark, sf_dir).withColumn("source_id", F.concat(F.lit("s"), F.col("doc_id") % 200))
    states = lifecycle.apply_visits(A.visits(spark, sf_dir))
    return lifecycle.expire_failed_sources(states, r, F.lit("2024-02-15").cast("timestamp_ntz"))


@query(
    "d6_removed_records",
    f"""
WITH {REC}, gone AS (SELECT DISTINCT source_url FROM rec WHERE doc_id % 2 = 0 AND source IN (SELECT source FROM rec WHERE doc_id % 13 = 1) AND source_url NOT IN (SELECT source_url FROM rec WHERE doc_id % 31 = 5))
SELECT record_version_id, 'removed' AS new_freshness FROM rec WHERE source_url IN (SELECT source_url FROM gone) AND freshness IN ('current', 'unknown') AND record_type IN ('faculty_profile', 'merit_list')""",
)
def removed_records(spark, sf_dir):
    r = A.records(spark, sf_dir)
    known = r.filter("doc_id % 2 = 0").select("source_url", F.col("source").alias("parent")).distinct()
    gone = lifecycle.disappeared_children(known, r.filter("doc_id % 13 = 1").select(F.col("source").alias("parent")), r.filter("doc_id % 31 = 5").select("source_url"))
    return lifecycle.remove_disappeared(r, gone)


@query(
    "e9_audit",
    f"""
WITH {REC}, {SRC}, j AS (SELECT *, {SERV} AS ok FROM rec LEFT JOIN src USING (source_url))
SELECT count(*) FILTER (WHERE serving = 'pending_index') AS active, count(*) FILTER (WHERE ok) AS eligible,
  count(*) FILTER (WHERE ok AND legal_status = 'blocked') AS blocked, count(*) FILTER (WHERE ok AND NOT is_active) AS inactive,
  (SELECT count(*) FROM (SELECT scope FROM (SELECT scope, tier, count(DISTINCT effective_hash) AS h FROM rec GROUP BY ALL) GROUP BY scope HAVING arg_min(h, tier) > 1)) AS contradictory,
  (SELECT count(*) FROM (SELECT dedupe_key FROM rec WHERE authoritative GROUP BY 1 HAVING count(DISTINCT record_version_id) > 1)) AS duplicates FROM j""",
)
def audit(spark, sf_dir):
    return lifecycle.run_audit(A.records(spark, sf_dir), A.sources(spark, sf_dir), "pending_index")


@query(
    "h2_generation_diff",
    f"""
WITH {REC}, a AS (SELECT record_version_id FROM rec WHERE doc_id % 3 <> 0), b AS (SELECT record_version_id FROM rec WHERE doc_id % 4 <> 0)
SELECT record_version_id, 'deindex' AS operation FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT record_version_id, 'index' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
)
def generation_diff(spark, sf_dir):
    r = A.records(spark, sf_dir).select("record_version_id", "doc_id")
    return lifecycle.generation_diff(r.filter("doc_id % 3 <> 0").drop("doc_id"), r.filter("doc_id % 4 <> 0").drop("doc_id"))


@query(
    "j8_upsert_sources",
    f"""
WITH {SRC}, n AS (SELECT * REPLACE (CASE WHEN source_class = 'policy' THEN NULL ELSE 'restricted' END AS legal_status) FROM src WHERE source_class IN ('policy', 'faculty'))
SELECT coalesce(n.source_url, o.source_url) AS source_url, coalesce(n.legal_status, o.legal_status) AS legal_status, coalesce(n.source_class, o.source_class) AS source_class,
  coalesce(n.is_active, o.is_active) AS is_active FROM (SELECT * FROM src WHERE source_class <> 'faculty') o FULL JOIN n USING (source_url)""",
)
def upsert_sources(spark, sf_dir):
    s = A.sources(spark, sf_dir)
    new = s.filter(F.col("source_class").isin("policy", "faculty")).withColumn("legal_status", F.when(F.col("source_class") != "policy", "restricted"))
    return lifecycle.upsert_sources(s.filter("source_class <> 'faculty'"), new, "source_url")


# Sources of some classes that move: to one new URL, or to the first URL of their host.
MOVED_SQL = f"""{SRC}, m AS (SELECT *, CAST(regexp_extract(source_url, '[0-9]+') AS INTEGER) AS n, ascii(right(source_url, 1)) AS k, regexp_replace(source_url, '[a-z]+$', 'en') AS parent,
  CASE source_class WHEN 'policy' THEN 'https://merged.example.edu/admissions/x' WHEN 'document_asset' THEN min(source_url) OVER (PARTITION BY regexp_extract(source_url, '[0-9]+')) ELSE source_url END AS u FROM src),
s AS (SELECT * REPLACE (coalesce(p.u, parent) AS parent), m.u <> m.source_url AS moved, CASE WHEN n % 3 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(n * 7 % 100 + k AS INTEGER)) END AS seen,
  CASE WHEN k % 2 = 0 THEN '' ELSE 'L' || m.source_url END AS label FROM m LEFT JOIN (SELECT source_url AS old, u FROM m) p ON p.old = m.parent)"""


def _moved(spark, sf_dir):
    """Sources with times, links and parents, and moves of some."""
    n, k = F.regexp_extract("source_url", "[0-9]+", 0).cast("int"), F.ascii(F.right("source_url", F.lit(1)))
    s = A.sources(spark, sf_dir).withColumns(
        {
            "last_seen_at": F.when(n % 3 != 0, F.timestamp_add("DAY", n * 7 % 100 + k, F.lit("2024-01-01").cast("timestamp_ntz"))),
            "link_text": F.when(k % 2 == 0, "").otherwise(F.concat(F.lit("L"), "source_url")),
            "parent_source_url": F.regexp_replace("source_url", "[a-z]+$", "en"),
        }
    )
    hosts = s.filter("source_class = 'document_asset'").groupBy(n.alias("n")).agg(F.min("source_url").alias("new_url"))
    near = s.filter("source_class = 'document_asset'").select(F.col("source_url").alias("old_url"), n.alias("n")).join(hosts, "n").select("old_url", "new_url")
    far = s.filter("source_class = 'policy'").select(F.col("source_url").alias("old_url"), F.lit("https://merged.example.edu/admissions/x").alias("new_url"))
    gone = s.select(F.concat("source_url", F.lit("/gone")).alias("old_url"), F.lit("https://x.example.edu/").alias("new_url"))
    return s, near.union(far).union(gone)


@query(
    "d19_rebind_urls",
    f"""
WITH {MOVED_SQL} SELECT u AS source_url, bool_or(is_active) AS is_active, first(legal_status ORDER BY moved, source_url) AS legal_status, max(seen) AS last_seen_at,
  coalesce(first(label ORDER BY moved, source_url) FILTER (label <> ''), '') AS link_text, first(parent ORDER BY moved, source_url) AS parent_source_url,
  CASE WHEN NOT bool_or(moved) THEN first(source_class) WHEN u LIKE '%/admissions/x' THEN 'program' ELSE 'general' END AS source_class FROM s GROUP BY u""",
)
def rebind_urls(spark, sf_dir):
    """Moves to a new URL, into a row that is there, of unknown URLs, and to the same URL."""
    return lifecycle.rebind_urls(*_moved(spark, sf_dir))


@query("d19_rebind_records", f"WITH {REC}, {MOVED_SQL} SELECT record_version_id, u AS source_url FROM rec JOIN m USING (source_url)")
def rebind_records(spark, sf_dir):
    return lifecycle.rebind_records(A.records(spark, sf_dir), _moved(spark, sf_dir)[1]).select("record_version_id", "source_url")


@query(
    "d17_closure",
    f"""
WITH RECURSIVE {REC}, e AS (SELECT record_version_id AS v, record_id AS k FROM rec UNION ALL SELECT record_version_id, dedupe_key FROM rec),
seen(v) AS (SELECT 'd1' UNION SELECT b.v FROM seen JOIN e a ON a.v = seen.v JOIN e b ON b.k = a.k) SELECT v AS record_version_id FROM seen""",
)
def closure(spark, sf_dir):
    lifecycle.ensure_checkpoints(spark)
    r = A.records(spark, sf_dir)
    return lifecycle.affected_closure(r, ["record_id", "dedupe_key"], F.col("record_version_id") == "d1").select("record_version_id")
