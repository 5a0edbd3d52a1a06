"""Branches that the driver's tables don't reach."""

from __future__ import annotations

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from factmill.functions import text as T
from factmill.functions import urls as U
from factmill.functions import rendering
from factmill.operators import answers, chunks, dedupe, extract, filters, joins, lifecycle, questions, search, versions
from factmill.sources import generations, records


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())] if values else [(1,)], list(values) or ["x"]).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "url, want",
    [
        ("https://x.edu/files/Rules.PDF", "document_asset"), ("https://x.edu/fee-structure", "program_fee_schedule"), ("https://x.edu/coffee", "general"),
        ("https://x.edu/admissions/bs-cs", "program"), ("https://x.edu/admissions/eligibility", "admissions_cycle"), ("https://x.edu/policy/a?fee=1", "policy"), ("https://x.edu", "general"),
    ],
)
def test_classify_source(spark, url, want):
    assert one(spark, U.classify_source(F.col("u")), u=url) == want


def test_url_forms(spark):
    assert one(spark, U.canonicalize_url(F.col("u")), u="HTTPS://X.Edu:443/A/?q#f") == "https://x.edu/A/"
    assert one(spark, U.url_identity(F.col("u")), u="http://x.edu/a//") == "http://x.edu/a/"
    assert len(one(spark, U.clamp_slug(F.col("u")), u="word " * 40)) == 60


def test_semantic_normalize(spark):
    assert one(spark, T.semantic_normalize(F.col("t")), t="  A – B * c ...!\n") == "a - b c"


def rec(i, **more):
    base = dict(
        record_version_id=f"v{i}", record_id=f"r{i}", record_type="program", source_url=f"u{i}", tier=1, scope="s", dedupe_key="k", effective_hash=f"h{i}", cycle_label="c",
        year_confidence="high", fetched_at=datetime.datetime(2024, 1, 1 + i), effective_from=None, effective_to=None, verification="verified", freshness="current",
        serving="eligible", authoritative=True,
    )
    return {**base, **more}


SCHEMA = "record_version_id string, record_id string, record_type string, source_url string, tier int, scope string, dedupe_key string, effective_hash string, cycle_label string, year_confidence string, fetched_at timestamp, effective_from date, effective_to date, verification string, freshness string, serving string, authoritative boolean"


def frame(spark, *rows):
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], SCHEMA)


def as_of():
    return F.lit("2024-07-01").cast("date")


@pytest.mark.parametrize(
    "rows, want",
    [
        ([rec(1)], {"v1": "winner"}),
        ([rec(1, effective_to=datetime.date(2024, 1, 1))], {"v1": "expired"}),
        ([rec(1), rec(2)], {"v1": "conflict", "v2": "conflict"}),
        ([rec(1), rec(2, tier=2)], {"v1": "older", "v2": "winner"}),
        ([rec(1, effective_hash="h"), rec(2, effective_hash="h")], {"v1": "older", "v2": "winner"}),
        ([rec(1, record_type="policy_rule"), rec(2, record_type="policy_rule")], {"v1": "older", "v2": "winner"}),
        ([rec(1, record_type="merit_list", year_confidence="low")], {"v1": "ambiguous"}),
        ([rec(1, record_type="merit_list", cycle_label="a"), rec(2, record_type="merit_list", cycle_label="b")], {"v1": "older", "v2": "winner"}),
        ([rec(1, effective_from=datetime.date(2024, 5, 1), tier=3), rec(2)], {"v1": "winner", "v2": "older"}),
    ],
)
def test_decide(spark, rows, want):
    assert {r.record_version_id: r.decision for r in versions.decide(frame(spark, *rows), as_of()).collect()} == want


def test_decide_is_restricted_first(spark):
    assert versions.decide(frame(spark, rec(1)), as_of(), F.lit(True)).first().new_verification == "rejected"


def test_upsert_fails_closed(spark):
    out = versions.upsert_records(frame(spark, rec(1, serving="indexed_active", record_type="policy_rule")), frame(spark, rec(2), rec(3)), as_of())
    assert {r.record_version_id: r.new_serving for r in out.collect()} == {"v1": "pending_deindex", "v2": "ineligible", "v3": "ineligible"}


def test_upsert_prefers_the_incoming_side(spark):
    out = versions.combine_scopes(frame(spark, rec(1, tier=3)), frame(spark, rec(1, tier=1)))
    assert [(r.tier, r.side) for r in out.collect()] == [(1, 1)]


def test_duplicates(spark):
    rows = frame(spark, rec(1, effective_hash="a", tier=2), rec(2, effective_hash="a"), rec(3, effective_hash="a"), rec(4, dedupe_key="q"), rec(5, dedupe_key="q"), rec(6, dedupe_key="z", serving="ineligible"))
    primaries, links, conflicts = dedupe.resolve_duplicates(rows)
    assert [tuple(r) for r in primaries.collect()] == [("k", "v2")]
    assert sorted(tuple(r) for r in links.collect()) == [("v2", "v1"), ("v2", "v3")]
    assert [tuple(r) for r in conflicts.collect()] == [("q", ["v4", "v5"])]


def test_order_of_rows_does_not_matter(spark):
    rows = [rec(i, tier=1 + i % 3, scope=f"s{i % 4}", effective_hash=f"h{i % 5}", dedupe_key=f"k{i % 6}") for i in range(28)]
    take = lambda f: sorted(map(str, f.collect()))
    a, b = frame(spark, *rows), frame(spark, *rows[::-1]).repartition(7)
    assert take(versions.decide(a, as_of())) == take(versions.decide(b, as_of()).select(versions.decide(a, as_of()).columns))
    for x, y in zip(dedupe.resolve_duplicates(a), dedupe.resolve_duplicates(b)):
        assert take(x) == take(y)


def test_parent_by_id_then_url(spark):
    kids = spark.createDataFrame([("a", "r1", "u2"), ("b", "gone", "u2"), ("c", None, "u2"), ("d", None, None)], "record_version_id string, parent_record_id string, parent_url string")
    out = versions.parent_state(kids, frame(spark, rec(1), rec(2)))
    assert {r.record_version_id: r.parent_version_id for r in out.collect()} == {"a": "v1", "b": None, "c": "v2", "d": None}


def test_fuzzy_stages(spark):
    table = spark.createDataFrame([("Computer Science", "CS"), ("Business & Law", "BL"), ("Electrical Engineering", "EE"), ("MS Public Policy & Society", "PP")], "key string, target string")
    names = spark.createDataFrame([(n,) for n in ("Computer Science", " computer science ", "BUSINESS AND LAW", "Computer Science Lahore", "Electricel Enginering", "CS", "Botany things", "ms computer science", "MS PUBLIC POLICY", "Xomputer Science")], "name string")
    got = {r.name: (r.target, r.stage) for r in joins.fuzzy_lookup(names, table).collect()}
    assert got == {
        "Computer Science": ("CS", "equal"), " computer science ": ("CS", "normal"), "BUSINESS AND LAW": ("BL", "normal"),
        "Computer Science Lahore": ("CS", "prefix"), "Electricel Enginering": ("EE", "similar"), "ms computer science": ("CS", "degree"),
        "MS PUBLIC POLICY": ("PP", "prefix"), "Xomputer Science": ("CS", "similar"),
    }


def test_split_text_keeps_every_word_and_the_limit(spark):
    text = "\n\n".join(" ".join(f"word{i}-{k}." for i in range(60)) for k in range(12)) + "x" * 5000
    parts = chunks.split_one(text)
    assert all(len(p) <= 2000 for p in parts) and all(f"word{i}-{k}." in " ".join(parts) for i in range(60) for k in range(12))
    assert one(spark, chunks.split_text(F.col("t")), t="short") == ["short"]


@pytest.mark.parametrize(
    "text, most, want",
    [
        ("a b", 10, ["a b"]),
        (" one two. three four. five ", 12, ["one two.", "three four.", "five"]),
        ("aaaa\n\nbbbb\n\ncc", 8, ["aaaa", "bbbb\n\ncc"]),
        ("aaaa bbbb\ncccc dddd", 9, ["aaaa bbbb", "cccc dddd"]),
        ("abcdefghij", 4, ["abcd", "efgh", "ij"]),
        ("why? no! yes it is so", 6, ["why?", "no!", "yes", "it is", "so"]),
    ],
)
def test_split_text_by_separators(spark, text, most, want):
    assert chunks.split_one(text, most, 0) == want


def test_split_parts_overlap_where_there_is_room():
    assert chunks.split_one("aaaaaaa\n\nbb", 10) == ["aaaaaaa", "aaaaaa\n\nbb"]
    assert chunks.split_one("abcdefghijkl mn", 12, 3) == ["abcdefghijkl", "jkl\n\nmn"]


def test_split_parts_fit_with_their_head(spark):
    rows = [("v1", "policy_rule", "u", "c", "word " * 900), ("v2", "policy_rule", "u", "c", " "), ("v3", "policy_rule", None, "", "short")]
    df = spark.createDataFrame(rows, "record_version_id string, record_type string, source_url string, cycle_label string, text string")
    out = sorted(map(tuple, chunks.build_chunks(df).collect()))
    head = "Source: policy_rule\nSource Locator: u\nCycle: c"
    assert all(len(t) <= 2000 and (v != "v1" or t.startswith(head + "\n\n")) for v, *_, t in out) and len(out) == 5
    assert out[-2][4] == head and out[-1][4] == "Source: policy_rule\n\nshort"


def test_renderers(spark):
    payload = F.from_json(F.col("p"), "map<string,string>")
    text = lambda kind: rendering.render_search_text(F.lit(kind), payload)
    assert one(spark, text("policy_rule"), p='{"rule_title": " A ", "policy_area": "", "rule_text": "B"}') == "A\n\nB"
    assert one(spark, text("admissions_cycle"), p='{"content": "C"}') == "C" and one(spark, text("other"), p='{"name": "N", "faculty_label": "F"}') == "N — F"
    assert one(spark, text("org_unit"), p='{"name": "N", "section_variant": "directory", "content": "C"}') == "N — [directory]\n\nC"
    assert one(spark, text("research_entity"), p='{"subdomain_url": "https://a.b/c"}') == "https://a.b/c\n\na.b"
    label = rendering.render_sections(F.lit("org_unit"), payload)["label"]
    assert one(spark, label, p='{"name": "N", "section_variant": "directory"}') == ["Directory"] and one(spark, label, p='{"content": "C"}') == ["About"]
    assert one(spark, rendering.render_prefix(F.lit("org_unit"), payload), p='{"name": "N", "section_variant": "map"}') == "Unit: N (map)"
    assert one(spark, rendering.render_prefix(F.lit("merit_list"), payload), p="{}") == "Source: merit_list"
    assert one(spark, rendering.list_inline("L", F.from_json(F.col("p"), "array<string>")), p='["a", " ", "b"]') == "L: a; b"
    assert one(spark, rendering.list_lines("L", F.from_json(F.col("p"), "array<string>")), p="[]") is None


@pytest.mark.parametrize(
    "text, want",
    [
        ("weather today", ("out_of_scope", None, None)), ("weather at the university", ("entity_lookup", None, None)), ("stock policy", ("policy_or_threshold", "policy", None)),
        ("Fee for BS", ("fee_or_admissions_cycle", None, "program_fee_schedule")), ("coffee place", ("entity_lookup", None, None)), (None, ("entity_lookup", None, None)),
        ("latest news of faculty", ("news_or_event", "news_event", "news_event")), ("who can\n apply", ("fee_or_admissions_cycle", None, None)),
        ("Publications of X", ("faculty_expertise_or_publication", "faculty", "faculty_publication")), ("merit scholarship", ("fee_or_admissions_cycle", "scholarship", "scholarship")),
    ],
)
def test_classify_queries(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert tuple(df.select(questions.classify(F.col("t")).alias("c")).first().c) == want


def test_hints(spark):
    hint = lambda t: one(spark, questions.normalize_hint(F.col("t")), t=t)
    assert [hint(t) for t in ("Policy_Rule", " faculty\x07 ", "nonsense", " ", "research_entity")] == ["policy", "faculty", None, None, "research_main"]
    further = lambda t: [tuple(p) for p in one(spark, questions.secondary_hints(F.col("t"), questions.classify(F.col("t"))), t=t)]
    assert further("scholarship, fee, merit and faculty admissions") == [(None, "program_fee_schedule"), ("scholarship", "scholarship"), ("admissions_cycle", "admissions_cycle"), ("merit_list", "merit_list")]
    assert further("eligible for a fee") == [(None, None)] and further("hello") == []


def test_synonyms(spark):
    assert one(spark, questions.expand_synonyms(F.col("t")), t="Fee deadline") == ["Fee deadline", "tuition deadline", "charges deadline"]
    assert one(spark, questions.expand_synonyms(F.col("t")), t="hello") == ["hello"]


def test_diversity_and_decay(spark):
    e = spark.createDataFrame([(1, "a", "a0", "u", 0.9), (1, "a", "a1", "u", 0.8), (1, "b", "b0", "u", 0.7), (1, "c", "c0", "w", 0.1)], "query_id int, record_version_id string, chunk_id string, source_url string, score double")
    assert [r.chunk_id for r in search.source_diversity(e, 1, 3).orderBy("place").collect()] == ["a0", "a1", "c0"]
    assert search.source_diversity(e, 1, 0).count() == 0 and search.source_diversity(e, 0, 2).count() == 2
    assert one(spark, search.authority_decay(F.col("s"), F.col("t")), s=1.0, t=5) == 0.92


def test_rrf_ignores_list_order(spark):
    rows = [(1, "a", 1), (1, "b", 2), (1, "b", 1), (1, "c", 2)]
    take = lambda r: sorted(map(tuple, search.rrf(spark.createDataFrame(r, "query_id int, chunk_id string, rank int")).collect()))
    assert take(rows) == take(rows[::-1]) and dict(r[1:] for r in take(rows))["b"] == round(1 / 61 + 1 / 62, 9)


def test_gates_in_order(spark):
    q = spark.createDataFrame([(k, "average rate" if k == 3 else "x") for k in range(1, 7)], "query_id int, query_text string")
    e = spark.createDataFrame(
        [(2, "stale", "program", "high", "t", "u", "s", "k", 1, "h"), (3, "current", "program", "high", "none", "u", "s", "k", 1, "h"), (4, "current", "program", "high", "t", None, "s", "k", 1, "h"),
         (5, "current", "program", "high", "t", "u", "s", "k", 1, "h1"), (5, "current", "program", "high", "t", "u", "s", "k", 1, "h2"), (6, "current", "program", "high", "t", "u", "s", "k", 1, "h")],
        "query_id int, freshness string, record_type string, year_confidence string, text string, source_url string, scope string, dedupe_key string, tier int, effective_hash string",
    )
    got = {r.query_id: r.status for r in answers.answer_gates(q, e).collect()}
    assert got == {1: "no_evidence", 2: "uncertain", 3: "no_number", 4: "uncited", 5: "contradictory", 6: "answerable"}


def test_grounding_without_claims(spark):
    c = spark.createDataFrame([(1, True, True), (1, True, False), (2, None, None)], "query_id int, supported boolean, has_evidence boolean")
    assert {r.query_id: (r.score, r.passed) for r in answers.grounding_score(c).collect()} == {1: (0.5, True), 2: (1.0, True)}


def test_nested_documents(spark):
    docs = spark.createDataFrame(
        [(1, [(1, [("a",), ("b",)]), (1, []), (2, [("c",)])])], "doc long, sections array<struct<page_number int, table_cells array<struct<text string>>>>"
    )
    got = [(r.locator, r.cell.text if r.cell else None) for r in extract.flatten_parsed_documents(docs, "doc").orderBy("section_order", "cell_no").collect()]
    assert got == [("page:1#1", "a"), ("page:1#1", "b"), ("page:1#2", None), ("page:2#1", "c")]


def test_refresh_and_grace(spark):
    now = F.lit("2024-05-02").cast("timestamp")
    due = lambda policy, last: one(spark, filters.is_refresh_due(F.lit(policy), F.lit("merit_list"), F.lit(last).cast("timestamp"), now))
    assert [due("manual_only", None), due("weekly", None), due("weekly", "2024-05-01"), due("every_6_hours_while_active_daily_otherwise", "2024-05-01 12:00:00"), due("monthly", "2024-05-02")] == [False, True, False, True, True]
    assert one(spark, filters.within_grace(F.lit("merit_list"), F.lit("weekly"), F.lit(None).cast("timestamp"), now)) is False


def test_read_records(spark, tmp_path):
    (tmp_path / "lines.json").write_text('// note\n{"record_id": "a"}\n\n{"record_id": "b", "source_authority_tier": true}\n')
    (tmp_path / "loose.json").write_text('/* c */ [{"record_id": "c"}] {"record_id": "d // no"}\n{broken\n{"record_id": "e"}')
    rows, bad = records.read_records(spark, str(tmp_path))
    assert sorted(r.i for r in rows.select(F.variant_get("record", "$.record_id", "string").alias("i")).collect()) == ["a", "b", "c", "d // no", "e"]
    assert bad.count() == 1
    valid, invalid = filters.validate_records(rows)
    assert valid.count() == 0 and any("source_authority_tier is not an integer" in r.missing for r in invalid.collect())


def test_read_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps({"sources": [{"source_url": "u", "source_class": "policy"}, {"source_url": "w", "is_active": False}]}))
    got = {r.source_url: r for r in records.read_sources(spark, str(tmp_path / "s.json")).collect()}
    assert got["u"].legal_status == "allowed" and got["u"].canonical_url == "u" and got["u"].is_active and not got["w"].is_active


def test_generations(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.createDataFrame([("c1", "program", "v1"), ("c2", "policy_rule", "v2")], "chunk_id string, record_type string, record_version_id string")
    generations.write_generation(rows, "g1", root)
    generations.activate(spark, root, "g1", "2024-01-01")
    with pytest.raises(Exception, match="exist"):
        generations.write_generation(rows, "g1", root)
    generations.write_generation(rows.limit(1), "g2", root)
    assert generations.read_generation(spark, root).count() == 2
    generations.activate(spark, root, "g2", "2024-01-02")
    assert generations.active_label(spark, root) == "g2"
    states = generations.generation_states(spark, root, spark.createDataFrame([("g1",), ("g2",), ("g3",)], "label string"))
    assert {r.label: r.status for r in states.collect()} == {"g1": "retired", "g2": "active", "g3": "staged"}
    assert generations.delete_points(rows).count() == 2 and generations.delete_points(rows, equal={"record_type": "program"}).count() == 1
    assert generations.delete_points(rows, ids=rows.limit(1)).count() == 1


def test_two_activations_and_a_crash(spark, tmp_path):
    """Of two writers that saw one manifest, one fails and changes nothing; files without an entry are never read, and are swept as failed."""
    root = str(tmp_path)
    rows = spark.createDataFrame([("c1", "program")], "chunk_id string, record_type string")
    vectors = spark.createDataFrame([("c1", [1.0, 2.0])], "chunk_id string, embedding array<double>")
    for label in ("g1", "g2"):
        generations.write_generation(rows, label, root, vectors)
    seen = generations.last_entry(spark, root)
    generations.activate(spark, root, "g1", "2024-01-01", after=seen)
    with pytest.raises(generations.Conflict):
        generations.activate(spark, root, "g2", "2024-01-01", after=seen)
    assert generations.active_label(spark, root) == "g1" and generations.read_generation(spark, root).first().embedding == [1.0, 2.0]
    rows.write.partitionBy("record_type").parquet(f"{root}/g3")  # crashed between files and entry
    with pytest.raises(ValueError, match="unknown"):
        generations.activate(spark, root, "g3", "2024-01-02")
    assert generations.sweep(spark, root) == ["g2", "g3"]
    assert {r.label: r.status for r in generations.states(spark, root).collect()} == {"g1": "active", "g2": "failed", "g3": "failed"}
    with pytest.raises(ValueError, match="failed"):
        generations.activate(spark, root, "g2", "2024-01-03")


def test_stream_upsert_in_any_order(spark, tmp_path):
    """Bad rows go to quarantine; batches in any order, with repeats, end as one decision over all rows; a batch that runs twice changes nothing."""
    from factmill.streaming import upsert

    rows = [rec(i, scope=f"s{i % 3}", effective_hash=f"h{i % 5}", record_type="policy_rule" if i % 2 else "merit_list", tier=1 + i % 2) for i in range(1, 25)]
    bad = [rec(28, tier=9), rec(29, scope=None)]
    as_of = F.lit("2024-07-01").cast("date")
    want = {r.record_version_id: r.decision for r in versions.decide(frame(spark, *rows), as_of).collect()}
    for n, parts in enumerate(((rows[12:], rows[:12], rows[6:18] + bad), (rows[::2] + bad, rows[1::2]), (rows + bad,))):
        root = f"{tmp_path}/{n}"
        for k, part in enumerate(parts):
            frame(spark, *part).coalesce(1).write.parquet(f"{root}/in/part{k}")
        stream = spark.readStream.schema(frame(spark, *rows).schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
        upsert.stream_upsert(stream, f"{root}/out", f"{root}/state", as_of, 4).trigger(availableNow=True).start().awaitTermination()
        store = upsert.read_store(spark, f"{root}/out")
        assert {r.record_version_id: r.decision for r in store.collect()} == want and store.count() == len(rows)
        assert sorted(tuple(r.defects) for r in spark.read.parquet(f"{root}/out/quarantine").collect()) == [("scope is missing",), ("tier is out of range",)]
        assert {r.record_version_id for r in upsert.servable(store).collect()} <= {i for i, d in want.items() if d == "winner"}


def test_silent_source_expires(spark, tmp_path):
    """A source whose visits stop expires by its timer, though it has no event then; others stay healthy or failing."""
    from factmill.streaming import health

    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    parts = [[("silent", at(0), True, 24), ("busy", at(0), True, 24), ("never", at(1), False, 24)], [("busy", at(20), True, 24), ("busy", at(21), False, 24)], [("busy", at(40), True, 24), ("fails", at(39), True, 24), ("fails", at(40), False, 24)]]
    for k, part in enumerate(parts):
        spark.createDataFrame(part, "source_id string, ts timestamp, ok boolean, grace_hours int").coalesce(1).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema("source_id string, ts timestamp, ok boolean, grace_hours int").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    keep = lambda batch, n: batch.write.mode("overwrite").parquet(f"{tmp_path}/out/batch={n}")
    health.stream_grace(stream, "2 hours").writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    last = spark.read.parquet(f"{tmp_path}/out").groupBy("source_id").agg(F.max_by(F.struct("status", "failures"), "batch").alias("s")).select("source_id", "s.*")
    assert {tuple(r) for r in last.collect()} == {("silent", "expired", 0), ("busy", "healthy", 1), ("never", "expired", 1), ("fails", "failing", 1)}


def test_upsert_sources_keeps_old_values(spark):
    old = spark.createDataFrame([("u", "allowed"), ("w", "blocked")], "source_url string, legal_status string")
    new = spark.createDataFrame([("u", None), ("x", "allowed")], "source_url string, legal_status string")
    got = {r.source_url: r.legal_status for r in lifecycle.upsert_sources(old, new, "source_url").collect()}
    assert got == {"u": "allowed", "w": "blocked", "x": "allowed"}


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    from factmill.streaming import health

    rows = [rec(i, scope=f"s{i % 3}", effective_hash=f"h{i}") for i in range(1, 13)]
    want = sorted(r.record_version_id for r in versions.latest_version(frame(spark, *rows)).filter("is_latest").collect())
    for k, part in enumerate((rows[6:], rows[:6], rows[3:9])):
        frame(spark, *part).write.parquet(f"{tmp_path}/in/part{k}")
    stream = spark.readStream.schema(frame(spark, rec(1)).schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    health.stream_ingest(stream, f"{tmp_path}/out", f"{tmp_path}/state", "1000 days").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.record_version_id for r in health.current_versions(spark, f"{tmp_path}/out").collect()) == want
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows)


def test_update_cycle(spark):
    """New rows beat old ones, other scopes stay, unseen pages and failing sources lose their records, copies in conflict are marked."""
    from factmill.operators import cycle

    own = lambda i, **more: rec(i, dedupe_key=f"k{i}", **more)
    ids = F.concat(F.lit("s"), F.substring("record_version_id", 2, 9))
    made = lambda *rows: frame(spark, *rows).withColumns({"source_id": ids, "text": F.lit("t")})
    old = made(own(1, scope="a", tier=2), own(2, scope="b", source_url="gone", record_type="merit_list"), own(3, scope="c"), own(4, scope="d"))
    new = made(own(5, scope="a"))
    sources = spark.createDataFrame([("u", "allowed", "policy", True)], "source_url string, legal_status string, source_class string, is_active boolean")
    visits = spark.createDataFrame([("s3", datetime.datetime(2024, 1, 1), False, 1), ("s4", datetime.datetime(2024, 1, 1), True, 2)], "source_id string, ts timestamp, ok boolean, event_id long")
    pages = spark.createDataFrame([("gone", "p"), ("there", "p")], "source_url string, parent string")
    done = cycle.update_cycle(old, sources, new, sources.limit(0), visits, pages, pages.select("parent"), pages.filter("source_url = 'there'"), F.lit(None).cast("date"), F.lit(datetime.datetime(2024, 1, 2)).cast("timestamp_ntz"))
    state = {r.record_version_id: r for r in done.records.collect()}
    assert set(state) == {"v1", "v2", "v3", "v4", "v5"}
    assert state["v3"].freshness == "unknown" and not state["v3"].authoritative
    assert state["v2"].freshness == "removed" and state["v2"].serving == "ineligible"
    assert (state["v4"].freshness, state["v4"].serving) == ("current", "eligible")
    assert state["v5"].authoritative and state["v5"].serving == "eligible" and state["v1"].freshness == "stale"
    assert {r.record_version_id for r in done.chunks.collect()} == {"v4", "v5"}
    assert done.audit.first().eligible == 2


def test_recover(spark):
    states = spark.createDataFrame([("a", "active"), ("b", "staged"), ("c", "retired")], "label string, status string")
    assert {r.label: r.status for r in generations.recover(states).collect()} == {"a": "active", "b": "failed", "c": "retired"}


def test_blocked_search_equals_plain_one(spark):
    """Sparse: every score of every pair, ties, repeated and blank texts, queries that nothing matches; few postings are read. Dense: routes."""
    import collections
    import math
    import random

    from factmill.operators import blocks

    r = random.Random(4)
    common, rare = [f"w{i}" for i in range(8)], [f"r{i}" for i in range(300)]
    texts = [(i, " ".join(r.choice(common) if r.random() < 0.8 else r.choice(rare) for _ in range(r.randrange(1, 60)))) for i in range(3000)] + [(5000, None), (5001, " "), (5002, "W1 w1"), (5002, "W1 w1")]
    asked = [(i, " ".join(r.sample(rare, 3) + r.sample(common, 3))) for i in range(30)] + [(90, ""), (91, "zzz nothing"), (92, "w1"), (93, texts[7][1])]
    weights = lambda t: {w: round(1 + math.log1p(n), 6) for w, n in collections.Counter(__import__("re").findall("[a-z0-9]+", (t or "").lower())).items()} or {"": 1.0}
    have, want = [(i, weights(t)) for i, t in texts], []
    for q, t in asked:
        mine = weights(t)
        scored = sorted((-round(sum(x * w[k] for k, x in mine.items() if k in w), 6), i) for i, w in have if not mine.keys().isdisjoint(w))[:10]
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(scored)]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string").repartition(12)
    queries = spark.createDataFrame(asked, "query_id long, text string")
    got = blocks.sparse_topk(queries, chunks, 10, lifecycle.cut)
    near = lambda rows: sorted((q, n, i, round(s, 5)) for q, i, s, n in rows)
    assert near(tuple(x) for x in got.select("query_id", "chunk_id", "score", "rank").collect()) == near(want)
    read = lambda q, c: blocks.sparse_search(q, c, 10, lifecycle.cut).agg(F.sum("read")).first()[0]
    every = lambda q, ws: sum(sum(k in w for k in weights(t)) for t in q for w in ws)
    assert read(queries, chunks) <= every([t for _, t in asked], [w for _, w in have])
    # texts on one subject stand together: other blocks can't reach the floor, and common words of the block are looked up for few rows
    subject = [(6000 + i, "topic " * 80 + " ".join(r.choices(common, k=5))) for i in range(20)]
    focused = spark.createDataFrame([(1, "topic " * 200 + " ".join(common))], "query_id long, text string")
    few = read(focused, chunks.union(spark.createDataFrame(subject, "chunk_id long, text string").coalesce(1)))
    assert few < 0.05 * every(["topic " * 200 + " ".join(common)], [w for _, w in have])

    e = [(i, i % 3 if i % 11 else None, None if i % 13 == 0 else [r.gauss(i % 3, 1) for _ in range(8)]) for i in range(900)] + [(2000, 1, [0.0] * 8)]
    rows = spark.createDataFrame(e, "chunk_id long, label int, embedding array<double>").repartition(7)
    unit = lambda v: [x / math.sqrt(sum(y * y for y in v)) for x in v] if any(v) else v
    have, want = [(i, r, unit(v)) for i, r, v in e if r is not None and v is not None], []
    for q, route, v in have[::40]:
        want += [(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted((-round(sum(a * b for a, b in zip(v, x)), 6), i) for i, kind, x in have if kind == route)[:5])]
    got = blocks.dense_topk(rows.withColumnRenamed("chunk_id", "query_id").join(spark.createDataFrame([(x[0],) for x in have[::40]], "query_id long"), "query_id"), rows, 5, "label", lifecycle.cut, size=40)
    assert near(tuple(x) for x in got.select("query_id", "chunk_id", "score", "rank").collect()) == near(want)
    assert blocks.sparse_topk(queries.limit(0), chunks, 10, lifecycle.cut).count() == 0 and blocks.sparse_topk(queries, chunks.limit(0), 10, lifecycle.cut).count() == 0


class _Dom:
    """A plain document tree, for comparison."""

    def __init__(self, html):
        from html.parser import HTMLParser

        outer, self.nodes = self, []
        self.root = dict(tag="", kids=[], up=None, attrs={})

        class Parser(HTMLParser):
            at = self.root

            def handle_starttag(self, tag, attrs):
                from factmill.operators.pages import BOUNDS, IMPLIED, VOID

                for name in IMPLIED.get(tag, ()):
                    x = self.at
                    while x["up"] and x["tag"] != name and x["tag"] not in BOUNDS:
                        x = x["up"]
                    if x["tag"] == name:
                        self.at = x["up"]
                node = dict(tag=tag, kids=[], up=self.at, attrs={k: v or "" for k, v in attrs})
                self.at["kids"].append(node)
                outer.nodes.append(node)
                if tag not in VOID:
                    self.at = node

            def handle_endtag(self, tag):
                x = self.at
                while x["up"] and x["tag"] != tag:
                    x = x["up"]
                if x["up"]:
                    self.at = x["up"]

            def handle_data(self, data):
                self.at["kids"].append(data)

        p = Parser()
        p.feed(html)
        p.close()

    def all(self, node, *tags):
        for k in node["kids"]:
            if isinstance(k, dict):
                if k["tag"] in tags:
                    yield k
                yield from self.all(k, *tags)

    def text(self, node):
        out = []
        for k in node["kids"]:
            if isinstance(k, dict):
                out += [] if k["tag"] in ("script", "style") else self.text(k)
            else:
                out += [" ".join(x.split()) for x in k.strip().splitlines() if x.strip()]
        return out

    def path(self, node):
        if node["attrs"].get("id"):
            return "#" + node["attrs"]["id"]
        steps = []
        while node["up"] and node["tag"] != "html":
            same = [k for k in node["up"]["kids"] if isinstance(k, dict) and k["tag"] == node["tag"]]
            steps.append(f"{node['tag']}:nth-of-type({next(i for i, k in enumerate(same) if k is node) + 1})")
            node = node["up"]
        return " > ".join(steps[::-1])

    def label(self, node):
        for kinds in (["caption"], ["h1", "h2", "h3", "h4", "h5", "h6"]) if node["tag"] == "table" else (["h1", "h2", "h3", "h4", "h5", "h6"],):
            first = next(self.all(node, *kinds), None)
            if first and self.text(first):
                return " ".join(self.text(first))
        if node["tag"] == "nav":
            return "Navigation"
        return node["attrs"].get("aria-label") or (node["attrs"]["id"].title() if node["attrs"].get("id") else node["tag"].title())

    def sections(self):
        out = []
        for nth, node in enumerate(self.all(self.root, "nav", "section", "article", "table"), 1):
            if not self.text(node):
                continue
            near, x = None, node["up"]
            while node["tag"] == "table" and x["up"] and near is None:
                if x["tag"] in ("section", "article") or (x["tag"] not in ("html", "body") and (x["attrs"].get("id") or x["attrs"].get("aria-label"))):
                    near = x
                x = x["up"]
            out.append((node["tag"], self.label(node), self.path(node), near and self.path(near), near and self.label(near), "\n".join(self.text(node))))
        return out or ([("body", "Document Body", "body", None, None, "\n".join(self.text(self.root)))] if self.text(self.root) else [])


def test_sections_equal_a_plain_tree(spark):
    """Random pages: nested tables and sections, ids, captions, headings, tags that are left open or closed in the wrong order."""
    import random

    from factmill.operators import pages

    r = random.Random(6)
    tags = ["section", "article", "nav", "div", "table", "tr", "td", "p", "b", "h2", "ul", "li", "caption", "script"]

    def page():
        out, opened = [], []
        for _ in range(r.randrange(0, 40)):
            x = r.random()
            if x < 0.45:
                t = r.choice(tags)
                opened.append(t)
                out.append(f"<{t}" + (f' id="i{r.randrange(5)}"' if r.random() < 0.1 else "") + (' aria-label="Aria"' if r.random() < 0.1 else "") + ">" + ("</script>" if t == "script" else ""))
            elif x < 0.7 and opened:
                t = opened.pop() if r.random() < 0.8 else r.choice(tags)
                out.append(f"</{t}>")
            else:
                out.append(r.choice(["one", " two  words\nmore", "&amp;", " ", "<br>", "<!-- no -->"]))
        return "".join(out) if r.random() < 0.3 else f"<html><body>{''.join(out)}</body></html>"

    made = [page() for _ in range(400)] + ["", "<table>", "x" * 50_000, "<section>" * 200 + "deep"]
    rows = spark.createDataFrame([*enumerate(made), (len(made), None)], "page_id long, html string").repartition(4)
    got = {}
    for x in pages.sections(pages.elements(rows)).orderBy("page_id", "section_order").collect():
        got.setdefault(x.page_id, []).append((x.section_type, x.label, x.source_locator, x.parent_locator, x.parent_label, x.content))
    for i, html in enumerate(made):
        assert got.get(i, []) == _Dom(html).sections(), html[:500]
    assert len(made) not in got


def test_builder_rows_and_fee_tables(spark):
    from factmill.operators import pages

    html = (
        '<body><main><div class="x fusion-fullwidth"><div class="fusion-title">Costs</div><p>a</p><h3>Plan</h3><table><tr><td>Tuition</td><td>9</td></tr></table><h3>Plan</h3><table><tr><td>b</td></tr></table></div>'
        '<div class="fusion-fullwidth"><h2>Costs</h2>b<table><caption>Cap</caption><tr><td>c</td></tr></table></div><div class="fusion-fullwidth"> </div></main><section>no</section></body>'
    )
    got = [tuple(x) for x in pages.sections(pages.elements(spark.createDataFrame([(1, html)], "page_id long, html string"))).orderBy("section_order").select("section_type", "section_id", "label", "source_locator", "parent_locator").collect()]
    assert got == [
        ("fusion_row", "costs", "Costs", "main://costs", None), ("table", "costs-table-plan", "Plan", "main://costs/table:plan", "main://costs"),
        ("table", "costs-table-plan-2", "Plan", "main://costs/table:plan-2", "main://costs"), ("fusion_row", "costs-2", "Costs", "main://costs-2", None),
        ("table", "costs-2-table-cap", "Cap", "main://costs-2/table:cap", "main://costs-2"),
    ]
    money = lambda t: one(spark, pages.currency(F.col("t")), t=t)
    assert [money(t) for t in ("", "5000", "$5", "USD 5 and Rs. 10", "$ 5, 150,000 and 20,000", "$5 $6 and 150,000")] == ["PKR", "PKR", "USD", "USD", "PKR", "USD"]
    assert [one(spark, pages.repair(F.col("t")), t=t) for t in ("173,00", " 1,50 ", "1,5", "12,345,00", "a 1,50")] == ["173,000", "1,500", "1,5", "12,345,00", "a 1,50"]
    assert one(spark, pages.paragraph_rows(F.col("t")), t=" a \n\n b") == [{"line": "a"}, {"line": "b"}]


def test_decision_rules_are_data(spark):
    """A type with rules and states of its own, added to the registry; other types decide as before."""
    embargo = versions.Rule("embargoed", lambda c: c.as_of < F.col("effective_from"))
    states = versions.STATES | {"embargoed": versions.State("pending", "unknown", False, "embargo")}
    rules = versions.RULES | {"notice": (versions.EXPIRED, embargo, versions.OLDER_VERSION)}
    rows = [rec(1, record_type="notice", effective_from=datetime.date(2024, 8, 1), scope="a"), rec(2, record_type="notice", scope="b"), rec(3, record_type="notice", scope="b", effective_hash="h2"), rec(4, scope="c")]
    got = {r.record_version_id: (r.decision, r.new_verification, r.new_serving, r.review) for r in versions.decide(frame(spark, *rows), as_of(), rules=rules, states=states).collect()}
    assert got == {"v1": ("embargoed", "pending", "ineligible", "embargo"), "v2": ("older", "verified", "ineligible", None), "v3": ("winner", "verified", "eligible", None), "v4": ("winner", "verified", "eligible", None)}
    assert {r.decision for r in versions.decide(frame(spark, *rows[1:3]), as_of()).collect()} == {"older", "winner"}


def plain_listings(listings):
    """The rules line by line: (people's departments, programs' departments, programs' faculties)."""
    import re

    from factmill.operators import listings as L

    person = lambda x: 5 <= len(x) <= 80 and x not in L.NOISE and re.match(L.PERSON, x) and x not in L.TITLES and not x.startswith(L.TITLE_PREFIXES)
    tidy = lambda t: [re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", x).strip() for x in (t or "").split("\n") if x.strip()]
    name, program = lambda x: re.sub(r"^#{1,6}\s+", "", x), lambda x: re.sub(r"\s*:.*$", "", re.sub(r"\s*\(.*?\)\s*$", "", x.strip()))
    words = lambda x: {w.lower() for w in re.findall("[A-Za-z]+", x) if len(w) > 1}
    people, departments, heads = {}, {}, {}
    for label, text in listings:
        own = own_p = None
        misses = misses_p = 0
        for x in tidy(text):
            if re.match(L.DEPARTMENT, x):
                own = own_p = name(x)
                misses = misses_p = 0
                heads.setdefault(label, []).append(own)
                continue
            if own:
                if person(x):
                    people[x], misses = own, 0
                elif 5 <= len(x) <= 80 and x not in L.NOISE and not (re.match(L.PERSON, x) and x not in L.TITLES) and re.match(L.PROGRAM, x):
                    misses = 0
                else:
                    misses += 1
                own = None if misses >= 3 else own
            if own_p:
                found = [p for p in map(program, re.split("[/,;]", x)) if re.match(L.PROGRAM, p)]
                for p in found:
                    departments[p.upper()] = (own_p, label)
                misses_p += not found
                own_p = None if misses_p >= 2 else own_p
    for label, names in heads.items():
        for p, (d, f) in list(departments.items()):
            if f == label and len(names) > 1:
                scored = [(len((words(p) - set(L.DEGREES)) & words(re.sub(r"(?i)^(?:Department of|School of)\s+", "", n))), -i, n) for i, n in enumerate(names)]
                if max(scored)[0] >= 2:
                    departments[p] = (max(scored)[2], f)
    faculties = {p: f for p, (_, f) in departments.items()}
    for label, text in listings:
        rows = tidy(text)
        past, found, misses = not any(re.match(L.DATED, x) for x in rows), False, 0
        for x in rows:
            if re.match(L.DATED, x):
                past = True
            elif past and 3 <= len(x) <= 80:
                if re.match(L.DEPARTMENT, x):
                    misses = 0
                elif re.match(L.FACULTY, x):
                    if found:
                        break
                elif re.match(L.PROGRAM, program(x)):
                    faculties.setdefault(program(x).upper(), label)
                    found, misses = True, 0
                elif found:
                    misses += 1
                    if misses >= 2:
                        break
    return people, departments, {**L.FACULTY_OF, **faculties}


def test_listings_equal_a_plain_loop(spark, monkeypatch):
    """Random listings in ranges of three lines, and one in which every department matters."""
    import random

    from factmill.operators import listings as L

    monkeypatch.setattr(L, "RANGE", 3)
    r = random.Random(9)
    pool = [
        "Department of Computer Science", "## School of Data Science", "Department of Physics", "Ali Khan", "Dr. Sara Malik", "[Omar Aziz](https://x.y/z)", "Associate Professor", "Lecturer Ali Khan", "BS COMPUTER SCIENCE",
        "BS Data Science (Morning)", "MS Physics / PHD Physics", "MS Applied Computer Science: new", "Next", "some text that says nothing", "x" * 90, "2024-01-01T00:00", "Faculty of Science", "", "ab", "Executive MBA Program", "Mary Ann O'Neil",
    ]
    made = [(f"f{i % 7}", "\n".join(r.choice(pool) for _ in range(r.randrange(0, 40)))) for i in range(60)] + [("f0", None)]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(made)], "place int, label string, text string").repartition(3)
    for part in (made, made[:9], made[9:10]):
        some = rows.filter(F.col("place").isin(*[i for i, x in enumerate(made) if x in part and (part is made or made.index(x) == i)]))
        kept = [made[x.place] for x in some.select("place").orderBy("place").collect()]
        people, departments, faculties = plain_listings(kept)
        assert {tuple(x) for x in L.people_departments(some).collect()} == set(people.items())
        assert {tuple(x) for x in L.program_departments(some).collect()} == {(p, *v) for p, v in departments.items()}
        assert {tuple(x) for x in L.program_faculties(some).collect()} == set(faculties.items())
    assert ("Omar Aziz",) not in {(x.person,) for x in L.people_faculties(rows).collect()} and L.people_faculties(rows).filter("person = 'Ali Khan'").count() == 1


def test_citations_of_unusual_texts(spark):
    """Null, empty, very long and hostile texts; forms are a table."""
    from factmill.operators import citations

    long = "Ana Khan, Bo Li, Study of " + "data " * 200_000 + ", Data Review, 2020"
    texts = [None, "", " \n ", long, "(" * 20_000, "‘" * 20_000 + " 2020", ", " * 20_000, "A.\u2028, B. Li\nStudy of x\nPress\n2020"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.c for r in df.select("i", citations.parse_citation(F.col("t")).alias("c")).collect()}
    assert got[0] is None and got[1].form == got[2].form == "plain" and got[1].citation_text == ""
    assert (got[3].form, got[3].authors, got[3].venue, got[3].year) == ("authors_first", ["Ana Khan", "Bo Li"], "Data Review", 2020)
    assert len(got[3].title) == len("Study of " + "data " * 200_000) - 1
    assert got[4].form == "plain" and got[5].year == 2020 and got[6].form == "plain"
    assert (got[7].form, got[7].authors, got[7].venue) == ("lines", ["A", "B. Li"], "Press")

    def thesis(c):
        return F.when(c["text"].startswith("Thesis: "), F.struct(F.array().cast("array<string>").alias("authors"), F.substring_index(c["text"], ": ", -1).alias("title"), F.lit(None).cast("string").alias("venue"), F.lit(None).cast("int").alias("year")))

    one = spark.createDataFrame([("Thesis: On data",)], "t string").select(citations.parse_citation(F.col("t"), (("thesis", thesis), *citations.FORMS)).alias("c")).first().c
    assert (one.form, one.title, one.citation_text) == ("thesis", "On data", ". On data")


def test_similar_names_equal_brute_force(spark):
    """Random names of few letters, so that many are near the bound; a common start; letters outside the basic plane."""
    import difflib
    import random

    r = random.Random(5)
    word = lambda a, b, letters="ABC ": "".join(r.choice(letters) for _ in range(r.randint(a, b)))

    def edited(w):
        w = list(w)
        for _ in range(r.randint(0, max(1, len(w) // 4))):
            i = r.randrange(len(w) + 1)
            w[i : i + r.randint(0, 1)] = [r.choice("ABCD")] if r.random() < 0.6 else []
        return "".join(w)

    keys = [word(4, 28) for _ in range(250)] + ["DEPARTMENT OF " + word(3, 9, "ABCDEFGH") for _ in range(100)] + ["😀ÄB" + word(5, 9) for _ in range(20)]
    names = {n for k in keys for n in (edited(k), edited(k)) if len(n) >= 6}
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {(n, k) for n in names for k in set(keys) if 2 * min(len(n), len(k)) >= 0.85 * (len(n) + len(k)) and ratio(n, k) >= 0.85}
    left = spark.createDataFrame([(n, n) for n in names], "name string, u string")
    table = spark.createDataFrame([(k, k) for k in set(keys)], "k string, target string")
    got = {(x.name, x.k) for x in joins.similar_pairs(left, table).collect()}
    assert got == want and len(want) > 500


def test_common_letters_find_no_names(spark):
    """A start that all keys share isn't asked for where the rest has pairs enough."""
    import random

    r = random.Random(3)
    keys = ["DEPT. " + "".join(r.choice("FGHIJKLMNOQRSUVWXYZ") for _ in range(20)) for _ in range(300)]
    left = spark.createDataFrame([(k, k) for k in keys], "name string, u string")
    asked = {x.gram for x in joins.probes(left, left.select(F.col("u").alias("k"), F.col("u").alias("target"))).select("gram").distinct().collect()}
    assert asked and not asked & {"DE", "PT", ". "}


def test_answer_batch_with_hooks(spark):
    """A model that cites an unknown number, one that says what isn't there, one that returns nothing, and a verifier of one's own."""
    from factmill.operators import answering

    q = spark.createDataFrame([(k, "x") for k in range(1, 8)], "query_id int, query_text string")
    row = lambda k, text, kind="program", fresh="current", url="u", locator="l": (k, fresh, kind, "high", text, url, locator, "s", f"{k}{text}", 1, "h", f"v{k}{text}", "general", 0.9)
    e = spark.createDataFrame(
        [row(1, "fees are 5"), row(1, "old", fresh="stale"), row(2, "a"), row(3, "b c d e", "scholarship"), row(4, "f"), row(5, "g", locator=None), row(7, "b c d e")],
        "query_id int, freshness string, record_type string, year_confidence string, text string, source_url string, locator string, scope string, dedupe_key string, tier int, effective_hash string, record_version_id string, source_class string, score double",
    )

    def model(prompts, numbered):
        said = {1: ("fees are 5 [1]", [("fees are 5", ["[1]"])]), 2: ("z", [("z", ["[9]"])]), 3: ("z y x [1]", [("z y x", ["[1]"])]), 7: ("z y x [1]", [("z y x", ["[1]"])])}
        table = spark.createDataFrame([(k, *v) for k, v in said.items()], f"query_id int, answer string, claims {answering.CLAIMS}")
        return prompts.select("query_id").join(table, "query_id")

    take = lambda *hooks: {r.query_id: r for r in answering.answer_batch(q, e, [F.asc("record_version_id")], *hooks).collect()}
    got = take(model)
    assert {k: r.status for k, r in got.items()} == {1: "answered", 2: "invalid_citation", 3: "ungrounded", 4: "no_draft", 5: "uncited", 6: "no_evidence", 7: "answered"}
    assert got[1].warnings == ["not_current"] and [c.n for c in got[1].citations] == [1] and got[3].answer is None
    assert "[1]\nfees are 5\n" in got[1].prompt and "Query: x" in got[1].prompt and got[5].prompt is None
    kind = take(model, lambda claims: claims.select("query_id", "claim_no", F.lit(True).alias("supported")))
    assert kind[3].status == "answered" and kind[3].grounding == 1.0
    assert take()[2].answer == "a [1]"


def test_inline_noise_and_navigation(spark):
    one = lambda f, s: spark.createDataFrame([(s,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert one(T.strip_inline_noise, "#### [Question 1: text](https://x.edu/a)\n**Answer** : _so_ a_b_c") == "Question 1: text\nAnswer : so a_b_c"
    assert one(T.strip_inline_noise, "## **Two** words\n[in a](http://x) line") == "Two words\nin a line"
    assert one(T.strip_inline_noise, None) is None and one(T.strip_inline_markup, " **a b** and _c_ snake_case_x ") == "a b and c snake_case_x"
    assert one(T.strip_nav_list_items, "* [Home](/)\nkept\n  - [Two](/b)\n3. [C](c) more\n1. [D](d)\n-[E](e)") == "kept\n3. [C](c) more\n-[E](e)"
    assert one(T.strip_nav_list_items, "") == "" and one(T.strip_nav_list_items, None) is None


def test_payloads_of_unusual_inputs(spark):
    """Null, blank and very long inputs of milestones, scholarships and profiles."""
    from factmill.operators import payloads

    rows = [(None, None, None, None), (" ", {}, [], []), ("&" * 3000, {"name": None}, [None, "7."], [None, " "]), ("x × " * 20000, {"Name": "", "Other": "12)"}, ["detail"], ["x"])]
    df = spark.createDataFrame(rows, "t string, m map<string,string>, a array<string>, h array<string>")
    day = F.lit("2024-07-01").cast("date")
    dates = df.select(payloads.milestone_dates(F.col("t"), day).alias("d")).collect()
    assert {(tuple(r.d.dates), r.d.confidence, r.d.resolution) for r in dates} == {((), "unknown", "unknown")}
    found = [r.p for r in df.select(payloads.scholarship_payload(F.col("m"), F.col("t"), F.col("a")).alias("p")).collect()]
    assert [p.name for p in found] == [None, None, "&" * 3000, ("x × " * 20000).strip()]
    assert {(p.benefit, p.eligibility, p.duration, p.type) for p in found} == {(None,) * 4}
    people = [r.p for r in df.select(payloads.profile_payload(F.col("h"), F.col("t")).alias("p")).collect()]
    assert [(p.designation, p.biography_text) for p in people] == [(None, None), (None, None), (None, "&" * 3000), ("x", None)]
    assert one(spark, payloads.biography_text(F.col("t")), t="ox x\u00d7 box x") == "ox x\u00d7 box x" and one(spark, payloads.biography_text(F.col("t")), t="box x \u00d7\nGallery") == "box"
    assert one(spark, payloads.scholarship_key(F.col("t")), t="Need \u2013 based  Aid. *") == one(spark, payloads.scholarship_key(F.col("t")), t="need - based aid")


def test_years_of_milestones_equal_a_plain_search(spark):
    """Every day of a leap year with each weekday, against a loop over the three years."""
    import calendar

    from factmill.operators import payloads

    as_of = datetime.date(2024, 7, 1)
    days = [(m, d, w) for m in range(1, 13) for d in range(1, 32, 3) for w in range(7)] + [(2, 29, w) for w in range(7)]

    def best(m, d, w):
        options = []
        for place, y in enumerate((2024, 2025, 2023)):
            if d <= calendar.monthrange(y, m)[1]:
                day = datetime.date(y, m, d)
                options.append((2 * (day >= as_of - datetime.timedelta(180)) + (day.weekday() == w), -place, day))
        return max(options)[2] if options else None

    df = spark.createDataFrame([(i, f"{calendar.day_name[w]}, {calendar.month_abbr[m]} {d}") for i, (m, d, w) in enumerate(days)], "i int, t string")
    got = {r.i: r.dates for r in payloads.normalize_milestones(df, F.col("t"), F.lit(as_of)).collect()}
    assert got == {i: [x] if (x := best(*day)) else [] for i, day in enumerate(days)}


def test_markdown_equals_plain_loops(spark):
    """Sections with what stands under them, on random headings; a table of many rows; texts that are null, empty, or hold marks."""
    import random

    from factmill.operators import markdown

    r = random.Random(5)
    trees = [[(r.randint(1, 6), f"b{i}" if r.random() < 0.7 else "") for i in range(r.randint(1, 30))] for _ in range(60)]
    texts = [(i, "\n".join(f"{'#' * level} h\n{body}" for level, body in t)) for i, t in enumerate(trees)]
    df = spark.createDataFrame(texts + [(90, None), (91, ""), (92, "\x01a\x02b\x03")], "doc_id int, text string")
    got = {(x.doc_id, x.section): x.content for x in markdown.with_children(markdown.section_rows(df, "doc_id"), "doc_id").collect()}

    def content(t, i):
        end = next((j for j in range(i + 1, len(t)) if t[j][0] <= t[i][0]), len(t))
        return "\n\n".join(b for _, b in t[i:end] if b)

    assert got == {(k, i): content(t, i) for k, t in enumerate(trees) for i in range(len(t))} | {(92, 0): "ab"}
    long = spark.createDataFrame([(1, "| A | B |\n" + "| 1 | 2 |\n" * 20000 + "| open" + " x" * 20000), (2, None), (3, "|"), (4, "|\n|")], "doc_id int, text string")
    assert {(x.doc_id, x.n) for x in markdown.table_rows(long, "doc_id").groupBy("doc_id").agg(F.count("*").alias("n")).collect()} == {(1, 20000)}


def test_moved_sources_and_due_ones(spark):
    """Merges keep the row that was there; the order of visits follows the watch list among risky classes only; null moves do nothing."""
    at = lambda d: datetime.datetime(2024, 1, d)
    s = spark.createDataFrame(
        [("u/a", True, at(3), "", "u/p", "k1"), ("u/b", False, at(9), "link b", None, "k2"), ("u/c", False, None, "link c", "u/a", "k3"), ("u/p", True, None, None, None, "k4")],
        "source_url string, is_active boolean, last_seen_at timestamp, link_text string, parent_source_url string, note string",
    )
    moved = spark.createDataFrame([("u/c", "u/a"), ("u/b", "u/a"), ("u/p", "u/q"), ("u/a", None), ("u/x", "u/y"), (None, "u/z")], "old_url string, new_url string")
    got = {r.source_url: r for r in lifecycle.rebind_urls(s, moved).collect()}
    assert got.keys() == {"u/a", "u/q"}
    a = got["u/a"]
    assert (a.is_active, a.last_seen_at, a.link_text, a.parent_source_url, a.note) == (True, at(9), "link b", "u/q", "k1") and got["u/q"].note == "k4"
    due = spark.createDataFrame(
        [(f"u{i}", c, p, t, True, "allowed", "unverified") for i, (c, p, t) in enumerate([("policy", "weekly", None), ("merit_list", "weekly", None), ("merit_list", "weekly", at(1)), ("merit_list", "manual_only", None), ("research_subdomain", "weekly", None), ("merit_list", "weekly", at(29))])],
        "source_url string, source_class string, refresh_policy string, last_crawled_at timestamp, is_active boolean, legal_status string, crawl_status string",
    )
    watch = spark.createDataFrame([("u2", 1), ("u2", 5), ("u0", 0), ("u5", 0)], "source_url string, place int")
    now = F.lit(at(30))
    order = lambda **more: [r.source_url for r in lifecycle.select_due_sources(due, now, **more).collect()]
    assert order() == ["u1", "u2", "u4", "u0"] and order(watch=watch) == ["u2", "u1", "u4", "u0"] and order(watch=watch, limit=1) == ["u2"]
    assert order(force=True, watch=watch) == ["u5", "u2", "u1", "u3", "u4", "u0"]


def test_payload_json_of_nothing(spark):
    from factmill.operators import payloads

    df = spark.sql(
        "SELECT * FROM VALUES (NULL), (named_struct('a', CAST(NULL AS STRING), '_b', 1, 'c', array(1.5BD, NULL), 'd', map(3, DATE '2024-01-02'), 'e', TIMESTAMP_NTZ '2024-01-02 03:04:05')) AS t(p)"
    )
    assert [r.json for r in payloads.serialize_payload(df, "p").collect()] == ["{}", '{"a":null,"c":["1.5",null],"d":{"3":"2024-01-02"},"e":"2024-01-02 03:04:05"}']


def test_snapshots_and_extractions(spark, tmp_path):
    from factmill.sources import snapshots

    (tmp_path / "raw" / "deep").mkdir(parents=True)
    (tmp_path / "raw" / "deep" / "a.HTML").write_bytes(b"<p>")
    (tmp_path / "raw" / "b").write_bytes(b"x")
    (tmp_path / "raw" / "none.md").write_bytes(b"")
    got = {r.path.rsplit("/", 1)[1]: (r.content_type, r.length, r.content_hash[:6]) for r in snapshots.read_snapshots(spark, str(tmp_path / "raw")).collect()}
    assert got == {"a.HTML": ("text/html", 3, hashlib.sha256(b"<p>").hexdigest()[:6]), "b": ("application/octet-stream", 1, hashlib.sha256(b"x").hexdigest()[:6])}
    key = lambda u, t: one(spark, snapshots.storage_key(F.col("u"), F.lit("0123456789abcdef"), F.col("t")), u=u, t=t)
    assert key("HTTP://X.edu:80/a/b.html?q", "text/html") == "x.edu/a/b.html-0123456789ab.html" and key("x", "Image/PDF") == "unknown-host/index-0123456789ab.pdf"
    rows = spark.createDataFrame([("https://x.edu/a/b", "policy", i, None) for i in range(50)] + [("https://x.edu", "general", 50, "v")], "source_url string, source_class string, i int, v string")
    snapshots.write_extraction(rows, str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert {(r.source_class, r.slug, r["count"]) for r in back.groupBy("source_class", "slug").count().collect()} == {("policy", "a_b", 50), ("general", "index", 1)}
    assert back.filter("source_url is null").isEmpty() and '"v":null' in next((tmp_path / "out" / "source_class=policy" / "slug=a_b").glob("*.json")).read_text()
