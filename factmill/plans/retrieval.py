"""Queries over chunks, vectors and tables of questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from factmill.functions import rendering
from factmill.operators import answering, answers, chunks, dedupe, filters, lifecycle, questions, search

from . import adapters as A
from .adapters import RECORDS_SQL as REC
from .catalog import Catalog

query = Catalog()
QUERIES, ORACLE = query.queries, query.oracle

TOKENS = """
{name}_t AS (SELECT {key}, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM {source}),
{name}_c AS (SELECT {key}, CAST('0x' || substr(sha256(token), 1, 8) AS BIGINT) % 2147483000 + 1 AS token_id, count(*) AS n FROM {name}_t GROUP BY ALL),
{name} AS (SELECT {key}, token_id, round(1 + ln(1 + n), 6) AS weight FROM {name}_c
  UNION ALL SELECT {key}, 1, 1.0 FROM {source} WHERE len(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) = 0)"""
DOC_TOKENS = TOKENS.format(name="dt", key="doc_id", source="documents")
BENCH_TOKENS = TOKENS.format(name="bt", key="item_id", source="benchmark")
SPARSE = """
sp AS (SELECT item_id, doc_id, round(sum(bt.weight * dt.weight), 6) AS score FROM bt JOIN dt USING (token_id) GROUP BY ALL),
sr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sp QUALIFY rank <= 20)"""


def _sparse(spark, sf_dir, k=20):
    return search.sparse_topk(A.table(spark, sf_dir, "benchmark"), A.table(spark, sf_dir, "documents"), k, lifecycle.cut, "item_id", "doc_id")


@query("e11_token_weights", f"WITH {DOC_TOKENS} SELECT doc_id, token_id, weight FROM dt")
def token_weights(spark, sf_dir):
    return search.token_weights(A.table(spark, sf_dir, "documents"), "doc_id", "text")


@query("g2_sparse_topk", f"WITH {DOC_TOKENS}, {BENCH_TOKENS}, {SPARSE} SELECT item_id, doc_id, score, rank FROM sr")
def sparse_topk(spark, sf_dir):
    return _sparse(spark, sf_dir)


@query(
    "g5_token_overlap",
    f"""
WITH {DOC_TOKENS}, {BENCH_TOKENS}, {SPARSE},
o AS (SELECT item_id, doc_id, CASE WHEN item_id % 10 = 0 THEN [] ELSE list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) END AS q, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS t, item_id % 10 <> 0 AND contains(lower(d.text), lower(b.text)) AS whole
  FROM sr JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id))
SELECT item_id, doc_id, round(len(list_intersect(q, t)) / greatest(len(q), 1) + CASE WHEN whole THEN 0.25 ELSE 0.0 END, 6) AS score FROM o""",
)
def token_overlap(spark, sf_dir):
    b = A.table(spark, sf_dir, "benchmark").select("item_id", F.when(F.col("item_id") % 10 == 0, " ").otherwise(F.col("text")).alias("q"))
    hits = _sparse(spark, sf_dir).select("item_id", "doc_id").join(b, "item_id").join(A.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return hits.select("item_id", "doc_id", search.overlap_score(F.col("q"), F.col("text")).alias("score"))


@query(
    "g1_dense_topk",
    """
WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN embeddings c USING (label) WHERE q.vec_id % 25 = 0)
SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 10""",
)
def dense_topk(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings")
    return search.dense_topk(e.filter("vec_id % 25 = 0").withColumnRenamed("vec_id", "query_id"), e.withColumnRenamed("vec_id", "chunk_id"), 10, "label", lifecycle.cut)


@query(
    "g3_hybrid_rrf",
    f"""
WITH {DOC_TOKENS}, {BENCH_TOKENS}, {SPARSE},
ds AS (SELECT q.vec_id AS item_id, c.vec_id AS doc_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q JOIN embeddings c USING (label) WHERE q.vec_id IN (SELECT item_id FROM benchmark)),
dr AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ds QUALIFY rank <= 20),
l AS (SELECT item_id, doc_id, rank FROM sr UNION ALL SELECT item_id, doc_id, rank FROM dr),
f AS (SELECT item_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS score FROM l GROUP BY ALL)
SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""",
)
def hybrid_rrf(spark, sf_dir):
    """Questions and documents by their words and, where they have a vector of their number, by it: two legs, fused."""
    e = A.table(spark, sf_dir, "embeddings")
    asked = e.join(A.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi").withColumnRenamed("vec_id", "item_id")
    dense = search.dense_topk(asked, e.withColumnRenamed("vec_id", "doc_id"), 20, "label", lifecycle.cut, "item_id", "doc_id")
    return search.hybrid_topk(_sparse(spark, sf_dir), dense, 10, "item_id", "doc_id")


def _evidence(spark, sf_dir):
    """Evidence of queries, whose number grows with the table: 25 records are scored for each. Some records have no URL, some tiers are out of range."""
    i = F.col("doc_id")
    tier = F.when(i % 31 == 0, 0).when(i % 31 == 1, 6).otherwise(F.col("tier"))
    return A.records(spark, sf_dir).withColumns(
        {
            "query_id": F.floor(i / 25), "score": F.round((i * 7919 % 1000) / 1000.0, 6), "chunk_id": F.concat("record_version_id", F.lit(":0")), "tier": tier,
            "type_hint": F.when(F.floor(i / 25) % 2 == 0, "program"), "source_url": F.when(i % 6 == 1, None).when(i % 6 == 2, "").otherwise(F.col("source_url")),
            "source_class": F.when(i % 50 == 7, "policy").otherwise("faculty"), "locator": F.when(i % 8 != 3, F.concat(F.lit("p:"), i)),
        }
    )


def _sql_text(v):
    return "'" + v.replace("'", "''") + "'"


EV = f"""{REC}, ev AS (SELECT * REPLACE (CASE WHEN doc_id % 6 = 1 THEN NULL WHEN doc_id % 6 = 2 THEN '' ELSE source_url END AS source_url, CASE doc_id % 31 WHEN 0 THEN 0 WHEN 1 THEN 6 ELSE tier END AS tier),
  doc_id // 25 AS query_id, round((doc_id * 7919 % 1000) / 1000.0, 6) AS score, record_version_id || ':0' AS chunk_id, CASE WHEN doc_id // 25 % 2 = 0 THEN 'program' END AS type_hint,
  CASE WHEN doc_id % 50 = 7 THEN 'policy' ELSE 'faculty' END AS source_class, CASE WHEN doc_id % 8 <> 3 THEN 'p:' || doc_id END AS locator FROM rec)"""


@query(
    "e3_primary_hits",
    f"""
WITH {EV}, k AS (SELECT * REPLACE (sha256(source) AS dedupe_key) FROM ev), m AS (SELECT *, min(tier) OVER (PARTITION BY query_id, dedupe_key) AS least FROM k),
p AS (SELECT query_id, dedupe_key, min(effective_hash) <> max(effective_hash) AS torn, arg_min(record_version_id, (-score, record_version_id)) AS best FROM m WHERE tier = least GROUP BY ALL)
SELECT query_id, record_version_id, score FROM m JOIN p USING (query_id, dedupe_key) WHERE tier = least AND (torn OR record_version_id = best)""",
)
def primary_hits(spark, sf_dir):
    e = _evidence(spark, sf_dir).withColumn("dedupe_key", F.sha2("source", 256))
    return dedupe.select_primary_hits(e).select("query_id", "record_version_id", "score")


@query(
    "f7_source_diversity",
    f"""
WITH {EV}, p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_version_id, chunk_id) AS p FROM ev),
d AS (SELECT *, dense_rank() OVER (PARTITION BY query_id, coalesce(nullif(source_url, ''), record_version_id) ORDER BY p) AS d FROM p)
SELECT query_id, record_version_id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS place FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d > 1, p) <= 12)""",
)
def source_diversity(spark, sf_dir):
    return search.source_diversity(_evidence(spark, sf_dir), 1, 12).select("query_id", "record_version_id", "place")


@query(
    "f8_reserve_types",
    f"""
WITH {EV}, h AS (SELECT *, coalesce(record_type = type_hint, false) AS hinted FROM ev),
n AS (SELECT *, hinted AND row_number() OVER (PARTITION BY query_id, hinted ORDER BY score DESC, record_version_id, chunk_id) <= 2 AS r FROM h)
SELECT query_id, record_version_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_version_id) AS place
FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY r DESC, score DESC, record_version_id) <= 8)""",
)
def reserve_types(spark, sf_dir):
    return search.reserve_types(_evidence(spark, sf_dir), 8).select("query_id", "record_version_id", "place")


@query(
    "g7_authority_decay",
    f"""
WITH {EV}, a AS (SELECT *, CAST(CASE WHEN contains(source_url, 'src1') OR contains(source_url, 'src2') THEN greatest(tier - 1, 1) ELSE tier END AS INTEGER) AS t FROM ev)
SELECT query_id, record_version_id, t AS tier, round(score * f, 6) AS score FROM (SELECT *, CASE t WHEN 1 THEN 1.0 WHEN 2 THEN 0.99 WHEN 3 THEN 0.97 WHEN 4 THEN 0.95 ELSE 0.92 END AS f FROM a) WHERE score * f >= 0.1""",
)
def authority_decay(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    url = F.replace(F.replace("source_url", F.lit("src1"), F.lit("Policies")), F.lit("src2"), F.lit("REGULATION"))
    t = e.withColumn("tier", search.adjust_tier(F.col("tier"), url, F.lit("policy")))
    out = t.withColumn("score", search.authority_decay(F.col("score"), F.col("tier")))
    return search.min_score(out, 0.1).select("query_id", "record_version_id", "tier", F.round("score", 6).alias("score"))


@query(
    "e6_contradiction",
    f"""
WITH {EV}, p AS (SELECT query_id, scope, sha256(lang) AS k, tier, count(DISTINCT effective_hash) AS n FROM ev GROUP BY ALL), t AS (SELECT query_id, arg_min(n, tier) AS n FROM p GROUP BY query_id, scope, k)
SELECT query_id, bool_or(n > 1) AS contradictory FROM t GROUP BY query_id""",
)
def contradiction(spark, sf_dir):
    return dedupe.has_contradiction(_evidence(spark, sf_dir).withColumn("dedupe_key", F.sha2("lang", 256)))


@query(
    "h3_merge_routes",
    f"""
WITH {EV}, p AS (SELECT query_id, 'd' || (doc_id % 97) AS chunk_id, CAST(tier AS INTEGER) AS route, doc_id AS rank, score FROM ev),
f AS (SELECT query_id, chunk_id, arg_min(route, (route, rank)) AS route, arg_min(score, (route, rank)) AS score, arg_min(rank, (route, rank)) AS rank FROM p GROUP BY ALL)
SELECT query_id, chunk_id, route, score, row_number() OVER (PARTITION BY query_id ORDER BY route, rank, chunk_id) AS place FROM f""",
)
def merge_routes(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    return search.merge_routes(e.select("query_id", F.concat(F.lit("d"), F.col("doc_id") % 97).alias("chunk_id"), F.col("tier").alias("route"), F.col("doc_id").alias("rank"), "score"))


@query(
    "d14_neighbours",
    """
SELECT conv_id, turn, concat_ws(chr(10) || chr(10), CASE WHEN turn - lag(turn) OVER w = 1 THEN lag(text) OVER w END, text, CASE WHEN lead(turn) OVER w - turn = 1 THEN lead(text) OVER w END) AS context_window
FROM (SELECT conv_id, turn, any_value(text ORDER BY role) AS text FROM conversations GROUP BY ALL) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
)
def neighbours(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min_by("text", "role").alias("text"))
    return search.adjacent_chunks(c, "conv_id", "turn").select("conv_id", "turn", "context_window")


@query(
    "f14_limit_per_type",
    f"WITH {REC} SELECT record_type, record_version_id FROM rec QUALIFY row_number() OVER (PARTITION BY record_type ORDER BY doc_id) <= 7",
)
def limit_per_type(spark, sf_dir):
    return search.limit_per_type(A.records(spark, sf_dir), 7, "doc_id").select("record_type", "record_version_id")


@query(
    "i6_semantic_class",
    """
WITH s AS (SELECT q.vec_id AS query_id, c.label, max(round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6)) AS score
  FROM embeddings q, embeddings c WHERE c.vec_id < 44 AND q.vec_id >= 44 GROUP BY ALL)
SELECT query_id, CASE WHEN max(score) >= 0.3 THEN arg_max(label, (score, -label)) ELSE -1 END AS label, max(score) AS score,
  list_sort(list_filter(coalesce(list(label) FILTER (WHERE score >= 0.3), []), lambda x: x <> arg_max(label, (score, -label)))) AS secondary FROM s GROUP BY query_id""",
)
def semantic_class(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings").withColumn("r", F.lit(1))
    exemplars = e.filter("vec_id < 44").select(F.col("vec_id").alias("chunk_id"), "embedding", "r", "label")
    hits = search.dense_topk(e.filter("vec_id >= 44").withColumnRenamed("vec_id", "query_id"), exemplars, 44, "r", lifecycle.cut)
    return search.class_scores(hits.join(exemplars.select("chunk_id", "label"), "chunk_id"), 0.3)


#: Questions with what they must give, written by hand: class, source class, record type, further (source class, record type) pairs in order.
FEES, ADM = (None, "program_fee_schedule"), ("admissions_cycle", "admissions_cycle")
CYCLE, ENTITY, OUT, POLICY, FACULTY, NEWS = "fee_or_admissions_cycle", "entity_lookup", "out_of_scope", "policy_or_threshold", "faculty_expertise_or_publication", "news_or_event"
ASKED = (
    ("What is the fee for BS Computer Science", CYCLE, *FEES, []),
    ("who can apply for the merit scholarship", CYCLE, "scholarship", "scholarship", [ADM, ("merit_list", "merit_list"), (None, None)]),
    ("weather in the city today", OUT, None, None, []),
    ("  RAIN   forecast ", OUT, None, None, []),
    ("stock policy of the library department", POLICY, "policy", None, []),
    ("share price of the university", ENTITY, None, None, []),
    ("Latest news and events", NEWS, "news_event", "news_event", []),
    ("publications of dr khan", FACULTY, "faculty", "faculty_publication", [("faculty", None)]),
    ("dr. khan publications", FACULTY, "faculty", "faculty_publication", [("faculty", None)]),
    ("faculty research interests", FACULTY, "faculty", None, []),
    ("attendance policy rules", POLICY, "policy", None, []),
    ("minimum cgpa requirement", POLICY, "policy", None, []),
    ("admission deadline for fall", CYCLE, *ADM, []),
    ("Who Can Apply", CYCLE, None, None, [ADM]),
    ("is a transfer student eligible", CYCLE, None, None, []),
    ("hostel location on campus", ENTITY, None, None, []),
    ("merit list for MBA", CYCLE, "merit_list", "merit_list", []),
    ("financial  aid\tfor students", CYCLE, "scholarship", "scholarship", []),
    ("how do I graduate", ENTITY, None, None, []),
    ("tuition charges and grading rules", POLICY, "policy", None, [FEES]),
    ("seminar fee and scholarship for admissions", NEWS, "news_event", "news_event", [FEES, ("scholarship", "scholarship"), ADM]),
    ("Admissions merit list policy", POLICY, "policy", None, [ADM, ("merit_list", "merit_list")]),
    ("eligible faculty for the workshop", NEWS, "news_event", "news_event", [("faculty", None), (None, None)]),
    ("football match", OUT, None, None, []),
    ("where is the office", ENTITY, None, None, []),
    ("coffee fee at the fees desk", CYCLE, *FEES, []),
    ("undergraduate graduate school", ENTITY, None, None, []),
)
TEXTS = tuple(a[0] for a in ASKED)
#: Hints that users give, and the class that each stands for.
GIVEN = ((" Policy_Rule ", "policy"), ("Nonsense_Class", None), ("FACULTY\n", "faculty"), ("research_entity", "research_main"), ("", None))


def _quoted(v):
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(_quoted, v)) + "]"
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _pairs(pairs):
    return [f"{s or ''}|{t or ''}" for s, t in pairs]


Q_SQL = (
    "asked(no, text, class, source_hint, type_hint, secondary) AS (VALUES "
    + ", ".join(f"({k}, {_quoted(t)}, {_quoted(c)}, CAST({_quoted(s)} AS VARCHAR), CAST({_quoted(r)} AS VARCHAR), CAST({_quoted(_pairs(p))} AS VARCHAR[]))" for k, (t, c, s, r, p) in enumerate(ASKED))
    + "), given(no, hint, known) AS (VALUES " + ", ".join(f"({k}, {_quoted(h)}, CAST({_quoted(c)} AS VARCHAR))" for k, (h, c) in enumerate(GIVEN))
    + f"""), q AS (SELECT doc_id, a.text || ' ' || lower(source) AS text, class, source_hint AS words_hint, type_hint, secondary, CASE WHEN doc_id % 3 = 0 THEN hint END AS hint,
  CASE WHEN class <> 'out_of_scope' THEN coalesce(source_hint, CASE WHEN doc_id % 3 = 0 THEN known END) END AS source_hint
  FROM documents d JOIN asked a ON d.doc_id % {len(ASKED)} = a.no JOIN given g ON d.doc_id // 3 % {len(GIVEN)} = g.no)"""
)


def _questions(spark, sf_dir):
    i = F.col("doc_id")
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    text = F.concat(pick(TEXTS, i), F.lit(" "), F.lower("source")).alias("text")
    return A.table(spark, sf_dir, "documents").select("doc_id", text, F.when(i % 3 == 0, pick([h for h, _ in GIVEN], F.floor(i / 3))).alias("hint"))


def _pair_text(p):
    return F.concat(F.coalesce(p["source_class"], F.lit("")), F.lit("|"), F.coalesce(p["record_type"], F.lit("")))


@query("i1_classify_queries", f"WITH {Q_SQL} SELECT doc_id, class, type_hint, source_hint, secondary, class = 'out_of_scope' AS abstain FROM q")
def classify_queries(spark, sf_dir):
    p = questions.prepare(_questions(spark, sf_dir))
    return p.select("doc_id", "class", "type_hint", "source_hint", F.transform("secondary", _pair_text).alias("secondary"), "abstain")


@query(
    "i2_type_of_class",
    f"""
WITH {Q_SQL} SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE a.no {" ".join(f"WHEN {k} THEN '{v}'" for k, v in ((0, "program_fee_schedule"), (1, "scholarship"), (12, "admissions_cycle"), (16, "merit_list"), (17, "scholarship"), (19, "program_fee_schedule"), (20, "program_fee_schedule"), (21, "merit_list"), (25, "program_fee_schedule")))} END
  ELSE CASE WHEN a.no IN (7, 8) THEN 'faculty_publication' END END AS type_hint FROM q JOIN asked a ON q.doc_id % {len(ASKED)} = a.no""",
)
def type_of_class(spark, sf_dir):
    """The type that the words ask for when another classifier said fees and admissions, or faculty."""
    given = F.when(F.col("doc_id") % 2 == 0, CYCLE).otherwise(FACULTY)
    return _questions(spark, sf_dir).select("doc_id", questions.record_type_hint(F.col("text"), given).alias("type_hint"))


ROUTES_SQL = f"""{Q_SQL}, r0 AS (SELECT doc_id, class, list_concat(
    CASE WHEN hint IS NOT NULL THEN [CASE WHEN source_hint IS NOT NULL AND type_hint IS NOT NULL THEN 'strict_source_and_type|' || source_hint || '|' || type_hint
      WHEN source_hint IS NOT NULL THEN 'strict_source|' || source_hint || '|' WHEN type_hint IS NOT NULL THEN 'strict_record_type||' || type_hint END]
    ELSE [CASE WHEN source_hint IS NOT NULL THEN 'source_hint|' || source_hint || '|' END, 'global||', CASE WHEN type_hint IS NOT NULL THEN 'record_type||' || type_hint END] END,
    list_transform(secondary[1:2], lambda x: 'secondary_intent|' || x)) AS r FROM q),
r1 AS (SELECT doc_id, class, list_filter(r, lambda x: x IS NOT NULL) AS r, list_transform(list_filter(r, lambda x: x IS NOT NULL), lambda x: regexp_replace(x, '^[a-z_]+[|]', '')) AS k FROM r0),
r2 AS (SELECT doc_id, class, list_filter(r, lambda x, i: list_position(k, k[i]) = i) AS r FROM r1),
routes AS (SELECT doc_id, CASE WHEN class = 'out_of_scope' THEN [] WHEN len(r) = 0 THEN ['global||'] ELSE r END AS routes FROM r2)"""


@query("i8_route_plan", f"WITH {ROUTES_SQL} SELECT doc_id, routes FROM routes")
def route_plan(spark, sf_dir):
    p = questions.prepare(_questions(spark, sf_dir))
    return p.select("doc_id", F.transform("routes", lambda r: F.concat(r["route"], F.lit("|"), _pair_text(r))).alias("routes"))


@query(
    "i9_prepare_queries",
    f"""
WITH {Q_SQL}, s AS (SELECT *, coalesce(words_hint IN ('policy', 'scholarship'), false) OR coalesce(type_hint IN ('program_fee_schedule', 'scholarship', 'admissions_cycle'), false) AS strong FROM q)
SELECT doc_id, CASE WHEN strong THEN class ELSE 'news_or_event' END AS class, CASE WHEN strong THEN source_hint ELSE 'news_event' END AS source_hint,
  CASE WHEN doc_id % 5 = 0 THEN 'about ' || text ELSE text END AS retrieval_text FROM s""",
)
def prepare_queries(spark, sf_dir):
    """Another classifier says news of everything; strong words overrule it. Every fifth question is rewritten; rewritings of two lines are refused."""
    news = F.struct(F.lit(NEWS).alias("query_class"), F.lit("news_event").alias("source_class"), F.lit("news_event").alias("record_type"))
    rewrite = lambda t: F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("about "), t)).otherwise(F.concat(t, F.lit("\nmore")))
    p = questions.prepare(_questions(spark, sf_dir), semantic=news, rewrite=rewrite)
    return p.select("doc_id", "class", "source_hint", "retrieval_text")


def _variant(term, other):
    found = f"(^|[^a-z0-9]){term}([^a-z0-9]|$)"
    other_found = f"(^|[^a-z0-9]){other}([^a-z0-9]|$)"
    return f"CASE WHEN regexp_matches(low, '{found}') AND NOT regexp_matches(low, '{other_found}') THEN regexp_replace(low, '{found}', '\\1{other}\\2') END"


VARIANTS = "[" + ", ".join(_variant(t, o) for t, others in questions.synonym_terms() for o in others) + "]"


@query(
    "i7_expand_synonyms",
    f"""
WITH {Q_SQL}, v AS (SELECT doc_id, text, list_filter({VARIANTS}, lambda x: x IS NOT NULL AND x <> low) AS v FROM (SELECT doc_id, text, lower(text) AS low FROM q)),
u AS (SELECT doc_id, text, list_filter(v, lambda x, i: list_position(v, x) = i) AS v FROM v)
SELECT doc_id, list_concat([text], v[1:2]) AS variants FROM u""",
)
def expand_synonyms(spark, sf_dir):
    return _questions(spark, sf_dir).select("doc_id", questions.expand_synonyms(F.col("text")).alias("variants"))


@query(
    "k7_answer_gates",
    f"""
WITH {EV}, r AS (SELECT *, CASE WHEN freshness <> 'current' THEN 1 WHEN record_type = 'merit_list' AND year_confidence IN ('low', 'unknown') THEN 1 ELSE 0 END AS bad FROM ev WHERE query_id % 9 <> 4 AND doc_id % 3 = 0),
f AS (SELECT query_id, count(*) AS rows, count(*) FILTER (WHERE bad = 0) AS clean, bool_or(bad = 0 AND regexp_matches(text, '[0-9]')) AS number FROM r GROUP BY query_id),
t AS (SELECT query_id, bool_or(n > 1) AS torn FROM (SELECT query_id, arg_min(n, tier) AS n FROM (SELECT query_id, scope, dedupe_key, tier, count(DISTINCT effective_hash) AS n FROM r WHERE bad = 0 GROUP BY ALL) GROUP BY query_id, scope, dedupe_key) GROUP BY query_id)
SELECT q.query_id, CASE WHEN rows IS NULL THEN 'no_evidence' WHEN clean = 0 THEN 'uncertain' WHEN q.query_id % 2 = 0 AND NOT coalesce(number, false) THEN 'no_number' WHEN coalesce(torn, false) THEN 'contradictory' ELSE 'answerable' END AS status, coalesce(clean, 0) AS clean
FROM (SELECT DISTINCT query_id FROM ev) q LEFT JOIN f USING (query_id) LEFT JOIN t USING (query_id)""",
)
def answer_gates(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    q = e.select("query_id").distinct().withColumn("query_text", F.when(F.col("query_id") % 2 == 0, "average rate").otherwise("hello"))
    return answers.answer_gates(q, e.filter("query_id % 9 <> 4 and doc_id % 3 = 0"))


#: Evidence in which queries end in different ways: URLs and locators are there but for every fourth query, keys repeat in every fifth.
_ASKED_SQL = f"""{EV}, a AS (SELECT * REPLACE (CASE WHEN query_id % 4 = 0 THEN source_url ELSE coalesce(nullif(source_url, ''), 'u') END AS source_url, CASE WHEN query_id % 4 = 1 THEN locator ELSE coalesce(locator, 'p') END AS locator,
  CASE WHEN query_id % 5 = 0 THEN dedupe_key ELSE record_version_id END AS dedupe_key) FROM ev)"""


def _asked(spark, sf_dir):
    q, some = F.col("query_id"), F.coalesce(F.nullif("source_url", F.lit("")), F.lit("u"))
    return _evidence(spark, sf_dir).withColumns(
        {
            "source_url": F.when(q % 4 == 0, F.col("source_url")).otherwise(some), "locator": F.when(q % 4 == 1, F.col("locator")).otherwise(F.coalesce("locator", F.lit("p"))),
            "dedupe_key": F.when(q % 5 == 0, F.col("dedupe_key")).otherwise(F.col("record_version_id")),
        }
    )


@query(
    "k11_answer_batch",
    f"""
WITH {_ASKED_SQL}, r AS (SELECT *, CASE WHEN freshness <> 'current' THEN 'not_current' WHEN record_type = 'merit_list' AND year_confidence IN ('low', 'unknown') THEN 'ambiguous_year' END AS reason FROM a),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_version_id) AS n FROM r WHERE reason IS NULL),
t AS (SELECT query_id, bool_or(n > 1) AS torn FROM (SELECT query_id, arg_min(n, tier) AS n FROM (SELECT query_id, scope, dedupe_key, tier, count(DISTINCT effective_hash) AS n FROM k GROUP BY ALL) GROUP BY query_id, scope, dedupe_key) GROUP BY query_id),
f AS (SELECT query_id, bool_or(regexp_matches(text, '[0-9]')) AS number, bool_and(coalesce(source_url, '') <> '') AS url, bool_and(coalesce(locator, '') <> '') AS locator,
  string_agg(coalesce(text, '') || ' [' || n || ']', chr(10) ORDER BY n) AS answer, string_agg('[' || n || ']' || chr(10) || coalesce(text, '') || chr(10), chr(10) ORDER BY n) AS blocks, count(*) AS rows FROM k GROUP BY query_id),
w AS (SELECT query_id, coalesce(list_sort(list_distinct(list(reason) FILTER (WHERE reason IS NOT NULL))), []) AS warnings FROM r GROUP BY query_id),
s AS (SELECT w.query_id, warnings, answer, blocks, rows, CASE WHEN rows IS NULL THEN 'uncertain' WHEN w.query_id % 2 = 0 AND NOT number THEN 'no_number' WHEN NOT url THEN 'uncited' WHEN coalesce(torn, false) THEN 'contradictory' WHEN NOT locator THEN 'uncited' ELSE 'answered' END AS status
  FROM w LEFT JOIN f USING (query_id) LEFT JOIN t USING (query_id))
SELECT query_id, status, warnings, CASE WHEN status = 'answered' THEN answer END AS answer, CASE WHEN status = 'answered' THEN rows END AS citations,
  CASE WHEN status = 'answered' THEN sha256({_sql_text(answering.INSTRUCTIONS)} || chr(10) || chr(10) || 'Query: ' || CASE WHEN query_id % 2 = 0 THEN 'average rate' ELSE 'hello' END || chr(10) || chr(10) || 'Evidence Blocks:' || chr(10) || blocks || chr(10) || 'JSON response schema:' || chr(10) || {_sql_text(answering.SCHEMA)}) END AS prompt FROM s""",
)
def answer_batch(spark, sf_dir):
    e = _asked(spark, sf_dir)
    q = e.select("query_id").distinct().withColumn("query_text", F.when(F.col("query_id") % 2 == 0, "average rate").otherwise("hello"))
    out = answering.answer_batch(q, e, [F.desc("score"), F.asc("record_version_id")])
    return out.select("query_id", "status", "warnings", "answer", F.when(F.col("status") == "answered", F.size("citations")).cast("long").alias("citations"), F.when(F.col("status") == "answered", F.sha2("prompt", 256)).alias("prompt"))


@query(
    "k8_answer_extractive",
    f"""
WITH {EV} SELECT query_id, string_agg(text || ' [' || n || ']', chr(10) ORDER BY n) AS answer, max(n) AS citations
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_version_id) AS n FROM ev) GROUP BY query_id""",
)
def answer_extractive(spark, sf_dir):
    return answers.answer_extractive(_evidence(spark, sf_dir), [F.desc("score"), F.asc("record_version_id")])


@query(
    "f13_number_citations",
    f"""
WITH {EV} SELECT query_id, record_version_id, n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_version_id) AS n FROM ev) WHERE coalesce(source_url, '') <> '' AND coalesce(locator, '') <> ''""",
)
def number_citations(spark, sf_dir):
    return answers.number_citations(_evidence(spark, sf_dir), [F.desc("score"), F.asc("record_version_id")]).select("query_id", "record_version_id", "n")


@query("b18_citations_complete", f"WITH {EV} SELECT query_id, bool_and(coalesce(source_url, '') <> '' AND coalesce(locator, '') <> '') AS complete FROM ev WHERE doc_id % 7 IN (3, 5, 6) GROUP BY query_id")
def citations_complete(spark, sf_dir):
    return filters.citations_complete(_evidence(spark, sf_dir).filter("doc_id % 7 in (3, 5, 6)"))


@query(
    "k9_citations",
    f"""
WITH {EV}, c AS (SELECT query_id, list_distinct(list(source) FILTER (WHERE doc_id % 4 = 0)) AS cited, list_distinct(list(source) FILTER (WHERE doc_id % 3 = 0)) AS known FROM ev GROUP BY query_id)
SELECT query_id, CASE WHEN len(coalesce(cited, [])) = 0 THEN 'missing' WHEN len(list_filter(cited, lambda x: NOT list_contains(known, x))) > 0 THEN 'unknown' ELSE 'valid' END AS status,
  coalesce(list_sort(list_filter(cited, lambda x: NOT list_contains(known, x))), []) AS unknown FROM c""",
)
def citations(spark, sf_dir):
    pick = lambda n: F.collect_set(F.when(F.col("doc_id") % n == 0, F.col("source")))
    return answers.validate_citations(_evidence(spark, sf_dir).groupBy("query_id").agg(pick(4).alias("cited"), pick(3).alias("known")))


@query(
    "e15_grounding",
    f"""
WITH {EV}, m AS (SELECT query_id, CASE WHEN bool_or(source_class = 'policy') OR min(score) < 0.05 THEN 'full' ELSE 'skip' END AS mode FROM ev GROUP BY 1)
SELECT query_id, round(coalesce(avg(CASE WHEN quality THEN 1 ELSE 0 END), 1.0), 6) AS score, round(coalesce(avg(CASE WHEN quality THEN 1 ELSE 0 END), 1.0), 6) >= 0.5 AS passed, any_value(mode) AS mode
FROM (SELECT query_id, verification = 'verified' AND doc_id % 5 <> 0 AS quality FROM ev) JOIN m USING (query_id) GROUP BY query_id""",
)
def grounding(spark, sf_dir):
    e = _evidence(spark, sf_dir)
    s = answers.grounding_score(e.select("query_id", (F.col("verification") == "verified").alias("supported"), (F.col("doc_id") % 5 != 0).alias("has_evidence")))
    return s.join(answers.grounding_mode(e.withColumn("record_type", F.lit("program")), 0.05), "query_id")


#: A payload for each type, whose main text is the document's, and the same as SQL: text, prefix, labelled sections.
PAYLOADS = {
    "policy_rule": {"policy_area": "lang", "rule_title": "record_id", "rule_text": "text"},
    "program": {"program_name": "record_id", "degree_level": "lang", "overview_text": "text", "eligibility_summary": "source"},
    "merit_list": {"title": "source", "program_name": "record_id", "cycle_label": "lang", "content": "text"},
    "faculty_profile": {"name": "record_id", "designation_text": "source", "biography_text": "text", "email": "lang"},
    "university_info": {"title": "record_id", "faq_question": "source", "content": "text"},
}
RENDERED = f"""{REC}, w AS (SELECT *, chr(10) || chr(10) AS g, regexp_replace(text, '^[ \\t\\n\\x0B\\f\\r]+|[ \\t\\n\\x0B\\f\\r]+$', '', 'g') AS t FROM rec),
p AS (SELECT *, CASE record_type
    WHEN 'policy_rule' THEN lang || ' — ' || record_id || g || t
    WHEN 'program' THEN record_id || ' — ' || lang || g || t || g || source || g || 'Test Options: SAT; own test'
    WHEN 'merit_list' THEN source || g || record_id || g || lang || g || t
    WHEN 'faculty_profile' THEN record_id || ' — ' || source || g || 'Research Interests: SAT; own test' || g || t || g || lang
    ELSE record_id || g || source || g || t END AS rendered,
  CASE record_type WHEN 'policy_rule' THEN 'Policy: ' || lang || ' — ' || record_id WHEN 'program' THEN 'Program: ' || record_id || ' — ' || lang
    WHEN 'merit_list' THEN 'Merit List: ' || record_id || ' — ' || lang WHEN 'faculty_profile' THEN 'Faculty: ' || record_id || ' — ' || source ELSE 'Info: ' || record_id END AS prefix FROM w),
c AS (SELECT *, CASE record_type
    WHEN 'program' THEN [{{'label': 'Overview', 'text': record_id || ' — ' || lang || g || t}}, {{'label': 'Eligibility', 'text': source || g || 'Test Options: SAT; own test'}}]
    WHEN 'faculty_profile' THEN [{{'label': 'Profile', 'text': record_id || ' — ' || source || g || lang}}, {{'label': 'Biography', 'text': t}}, {{'label': 'Research', 'text': 'Research Interests: SAT; own test'}}]
    WHEN 'university_info' THEN [{{'label': '', 'text': record_id || g || source}}, {{'label': 'Details', 'text': t}}]
    ELSE [{{'label': '', 'text': rendered}}] END AS sections FROM p)"""


def _payloads(spark, sf_dir):
    """Records with payload and lists."""
    r, out = A.records(spark, sf_dir), None
    for kind, keys in PAYLOADS.items():
        made = F.create_map(*(x for k, c in keys.items() for x in (F.lit(k), F.col(c).cast("string"))))
        out = F.when(F.col("record_type") == kind, made) if out is None else out.when(F.col("record_type") == kind, made)
    tests = F.array(F.lit("SAT"), F.lit(" "), F.lit("own test"))
    return r.withColumns({"payload": out, "lists": F.create_map(F.lit("test_options"), tests, F.lit("research_interests"), tests)})


@query("c31_render_text", f"WITH {RENDERED} SELECT record_version_id, rendered, prefix FROM c")
def render_text(spark, sf_dir):
    kind, p, lists = F.col("record_type"), F.col("payload"), F.col("lists")
    return _payloads(spark, sf_dir).select("record_version_id", rendering.render_search_text(kind, p, lists).alias("rendered"), rendering.render_prefix(kind, p).alias("prefix"))


@query("c32_render_sections", f"WITH {RENDERED} SELECT record_version_id, list_transform(list_filter(sections, lambda s: s.text <> ''), lambda s: s.label || '|' || s.text) AS sections FROM c")
def render_sections(spark, sf_dir):
    made = rendering.render_sections(F.col("record_type"), F.col("payload"), F.col("lists"))
    return _payloads(spark, sf_dir).select("record_version_id", F.transform(made, lambda s: F.concat_ws("|", s["label"], s["text"])).alias("sections"))


@query(
    "k1_chunks",
    f"""
WITH {RENDERED}, h AS (SELECT *, prefix || chr(10) || 'Source Locator: ' || source_url || chr(10) || 'Cycle: ' || cycle_label AS head FROM c),
a AS (SELECT record_version_id, list_transform(list_filter(sections, lambda s: s.text <> ''), lambda s: head || CASE WHEN s.label <> '' THEN chr(10) || 'Section: ' || s.label ELSE '' END || g || s.text) AS chunks FROM h)
SELECT record_version_id, CASE WHEN len(list_filter(chunks, lambda x: length(x) > 2000)) = 0 THEN chunks END AS chunks, len(list_filter(chunks, lambda x: length(x) > 2000)) > 0 AS split FROM a""",
)
def chunks_of_records(spark, sf_dir):
    """Chunks of every record; of those whose sections all fit, the texts (SQL can't split the others, see k2_chunk_split)."""
    made = chunks.chunk_lists(_payloads(spark, sf_dir), payload=F.col("payload"), lists=F.col("lists"))
    return made.select("record_version_id", F.when(~F.col("split"), F.col("chunks")).alias("chunks"), "split")


@query("k2_chunk_split")
def chunk_split(spark, sf_dir):
    return chunks.build_chunks(_payloads(spark, sf_dir), payload=F.col("payload"), lists=F.col("lists"))


@query(
    "question_answering",
    f"""
WITH {REC}, {DOC_TOKENS}, {BENCH_TOKENS}, {SPARSE},
w AS (SELECT item_id, doc_id, CASE WHEN item_id % 10 = 0 THEN [] ELSE list_distinct(regexp_extract_all(lower(b.text), '[a-z0-9]+')) END AS q, regexp_extract_all(lower(d.text), '[a-z0-9]+') AS t, item_id % 10 <> 0 AND contains(lower(d.text), lower(b.text)) AS whole
  FROM sr JOIN benchmark b USING (item_id) JOIN documents d USING (doc_id)),
o AS (SELECT item_id AS query_id, doc_id, round(len(list_intersect(q, t)) / greatest(len(q), 1) + CASE WHEN whole THEN 0.25 ELSE 0.0 END, 6) AS score FROM w),
e AS (SELECT o.query_id, o.score, rec.* FROM o JOIN rec USING (doc_id) WHERE freshness = 'current'),
m AS (SELECT *, min(tier) OVER (PARTITION BY query_id, dedupe_key) AS least FROM e),
best AS (SELECT query_id, dedupe_key, min(effective_hash) <> max(effective_hash) AS torn, arg_min(record_version_id, (-score, record_version_id)) AS first FROM m WHERE tier = least GROUP BY ALL),
h AS (SELECT m.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, record_version_id) AS p FROM m JOIN best USING (query_id, dedupe_key) WHERE tier = least AND (torn OR record_version_id = first)),
r AS (SELECT *, dense_rank() OVER (PARTITION BY query_id, source_url ORDER BY p) AS d FROM h),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d > 1, p) <= 5)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY p) AS place, record_version_id, source_url, score FROM k""",
)
def question_answering(spark, sf_dir):
    """Current, non-duplicate records, best for each benchmark text: sparse top-k, overlap rerank, primaries, diversity."""
    hits = token_overlap(spark, sf_dir).withColumnRenamed("item_id", "query_id")
    e = hits.join(A.records(spark, sf_dir).filter("freshness = 'current'"), "doc_id").withColumn("chunk_id", F.concat("record_version_id", F.lit(":0")))
    return search.source_diversity(dedupe.select_primary_hits(e), 1, 5).select("query_id", "place", "record_version_id", "source_url", "score")
