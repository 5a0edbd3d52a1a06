"""From a table of questions and their evidence to answers: gates, prompts, drafts, citations, grounding, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import answers, filters

INSTRUCTIONS = (
    "Answer the query from the evidence blocks alone, in clear Markdown, the direct answer first.\nCite each claim with the numbers of its blocks. Don't copy blocks or their metadata.\n"
    "Abstain where the evidence is missing or may be out of date. If blocks differ, follow the smaller authority tier, then the more specific source, and say that they differ.\n"
    "If fees of several degree levels are given, ask for the level."
)
SCHEMA = '{"status": "answered|abstained", "answer_text": "string", "claims": [{"text": "string", "citation_ids": ["[1]"]}], "warnings": ["string"]}'
CLAIMS = "array<struct<text string, citation_ids array<string>>>"


def build_prompts(queries: DataFrame, numbered: DataFrame, instructions: str = INSTRUCTIONS) -> DataFrame:
    """query_id, prompt: instructions, query, evidence blocks by number (with their `context`, if the column is there), answer schema. A query without
    evidence gets the block [none]."""
    text = F.coalesce("text", F.lit(""))
    context = F.nullif(F.trim(F.col("context")), text) if "context" in numbered.columns else F.lit(None).cast("string")
    block = F.concat_ws("\n", F.concat(F.lit("["), F.col("n"), F.lit("]")), F.nullif(context, F.lit("")), text, F.lit(""))
    blocks = numbered.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))).alias("bs"))
    body = F.coalesce(F.array_join(F.transform("bs", lambda x: x["b"]), "\n"), F.lit("[none]"))
    prompt = F.concat_ws("\n", F.lit(instructions), F.lit(""), F.concat(F.lit("Query: "), F.coalesce("query_text", F.lit(""))), F.lit(""), F.lit("Evidence Blocks:"), body, F.lit("JSON response schema:"), F.lit(SCHEMA))
    return queries.select("query_id", "query_text").join(blocks, "query_id", "left").select("query_id", prompt.alias("prompt"))


def extractive_model(prompts: DataFrame, numbered: DataFrame) -> DataFrame:
    """The default answer model: each evidence row is a claim that cites itself."""
    n = F.concat(F.lit("["), F.col("n"), F.lit("]"))
    rows = numbered.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", F.col("text").alias("text"), n.alias("id")))).alias("rows"))
    claims = F.transform("rows", lambda r: F.struct(r["text"].alias("text"), F.array(r["id"]).alias("citation_ids")))
    answer = F.array_join(F.transform("rows", lambda r: F.concat_ws(" ", r["text"], r["id"])), "\n")
    return prompts.select("query_id").join(rows, "query_id").select("query_id", answer.alias("answer"), claims.cast(CLAIMS).alias("claims"))


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def word_verifier(claims: DataFrame, least: float = 0.5) -> DataFrame:
    """The default verifier: a claim is supported if its evidence holds `least` of its distinct words; one without words is."""
    share = F.size(F.array_intersect(_words(F.col("claim")), _words(F.col("evidence")))) / F.nullif(F.size(_words(F.col("claim"))), F.lit(0))
    return claims.select("query_id", "claim_no", (F.coalesce(share, F.lit(1.0)) >= least).alias("supported"))


def _checked(drafts: DataFrame, numbered: DataFrame) -> DataFrame:
    """A row for each claim: query_id, claim_no, claim, evidence (cited texts, by number), cited, known (counts of distinct ids)."""
    claims = drafts.select("query_id", F.posexplode_outer("claims").alias("claim_no", "c")).filter("claim_no is not null")
    ids = claims.select("query_id", "claim_no", F.col("c.text").alias("claim"), F.explode_outer(F.array_distinct("c.citation_ids")).alias("id"))
    known = numbered.select("query_id", F.concat(F.lit("["), F.col("n"), F.lit("]")).alias("id"), "n", F.coalesce("text", F.lit("")).alias("text"))
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.struct("n", "text")))), lambda x: x["text"]), "\n")
    met = ids.join(known, ["query_id", "id"], "left").groupBy("query_id", "claim_no")
    return met.agg(F.first("claim").alias("claim"), texts.alias("evidence"), F.count("id").alias("cited"), F.count("n").alias("known"))


def answer_batch(
    queries: DataFrame, evidence: DataFrame, order: list[Column], model=extractive_model, verifier=word_verifier, least: float = 0.5, instructions: str = INSTRUCTIONS
) -> DataFrame:
    """queries (query_id, query_text) answered from evidence: query_id, status, mode, grounding, answer, claims, citations, warnings, prompt.

    Uncertain rows are dropped and named in warnings; gates decide which queries may be answered, and all rows must have a URL and a locator. The rest is
    numbered by `order`. `model` takes (query_id, prompt) and the numbered evidence and returns (query_id, answer, claims); `verifier` takes claims with the text
    that they cite and returns (query_id, claim_no, supported). Both are DataFrame functions, so that they may call a model by batches of rows.
    Status is a gate's name, `no_draft` where the model returned none, `invalid_citation` (a claim cites nothing or an unknown number), `ungrounded` or
    `answered`; answer, claims and citations are null unless answered. Evidence is what retrieval selected, a few rows a query."""
    clean = filters.drop_uncertain(evidence)
    kept = clean.filter("reason is null")
    complete = filters.citations_complete(kept)
    gates = answers.answer_gates(queries, evidence).join(complete, "query_id", "left")
    gates = gates.select("query_id", F.when((F.col("status") == "answerable") & ~F.coalesce("complete", F.lit(False)), "uncited").otherwise(F.col("status")).alias("status"))
    ready = gates.filter("status = 'answerable'").select("query_id")
    numbered = answers.number_citations(kept, order).join(ready, "query_id", "left_semi")
    prompts = build_prompts(queries.join(ready, "query_id", "left_semi"), numbered, instructions)
    drafts = model(prompts, numbered).select("query_id", "answer", F.col("claims").cast(CLAIMS).alias("claims"))
    claims = _checked(drafts, numbered)
    judged = claims.join(verifier(claims.select("query_id", "claim_no", "claim", "evidence")), ["query_id", "claim_no"], "left")
    ok = (F.coalesce("supported", F.lit(False)) & (F.col("known") > 0)).cast("int")
    cites = judged.groupBy("query_id").agg(F.bool_and((F.col("cited") > 0) & (F.col("cited") == F.col("known"))).alias("valid"), F.round(F.avg(ok), 6).alias("grounding"))
    sources = numbered.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "record_version_id", "source_url", "locator"))).alias("citations"))
    warned = clean.groupBy("query_id").agg(F.array_sort(F.collect_set("reason")).alias("warnings"))
    out = gates
    for more in (answers.grounding_mode(kept), drafts, cites, sources, warned, prompts):
        out = out.join(more, "query_id", "left")
    grounding = F.when(F.col("answer").isNotNull(), F.coalesce("grounding", F.lit(1.0)))
    status = (
        F.when(F.col("status") != "answerable", F.col("status")).when(F.col("answer").isNull(), "no_draft").when(~F.coalesce("valid", F.lit(False)), "invalid_citation")
        .when((F.col("mode") == "full") & (F.col("grounding") < least), "ungrounded").otherwise("answered")
    )
    final = out.withColumns({"grounding": grounding, "status": status, "warnings": F.coalesce("warnings", F.array().cast("array<string>"))})
    given = lambda c: F.when(F.col("status") == "answered", F.col(c)).alias(c)
    return final.select("query_id", "status", "mode", "grounding", given("answer"), given("claims"), given("citations"), "warnings", "prompt")
