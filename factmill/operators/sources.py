"""Registry of sources and document assets: rows from URLs, ids by URL, names of collections and generations."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factmill.functions import urls as U

LONGEST_NAME = 255


def source_entries(df: DataFrame, url: str = "url", page_kind: str = "page_kind", content_kind: str = "content_kind", blocked: Column | None = None) -> DataFrame:
    """A registry row for each URL: policy, class, family, tier (null: to be quarantined), parser target, and legal status, which is blocked
    where crawling is."""
    policy = U.source_policy(F.col(url), blocked)
    rows = df.withColumn("_p", policy)
    kind = F.col("_p.source_class")
    return rows.select(
        *df.columns, F.col("_p.canonical_url").alias("canonical_url"), U.url_identity(F.col(url)).alias("source_key"), kind.alias("source_class"), U.source_family(kind).alias("family"),
        U.authority_tier(F.col(page_kind), F.col(content_kind)).alias("authority_tier"), U.parser_target(kind, F.col(url)).alias("parser_target"),
        F.col("_p.is_high_risk").alias("is_high_risk"), F.when(F.col("_p.access") == "blocked", "blocked").otherwise("allowed").alias("legal_status"),
    )


def document_assets(documents: DataFrame) -> DataFrame:
    """documents (document_url, parent_page_url, filename, sections array<struct<section_id, locator>>) -> records of document assets; a
    document without sections is one root section."""
    first = F.get("sections", F.lit(0))
    media = U.media_type(F.concat(F.lit("file:///"), "filename"))
    return documents.select(
        F.concat(F.lit("document_asset:"), F.left(F.sha2("document_url", 256), F.lit(16))).alias("record_id"), F.lit("document_asset").alias("record_type"), "document_url", "parent_page_url",
        F.coalesce(first["section_id"], F.lit("document-root")).alias("source_section_id"), F.coalesce(first["locator"], F.lit("Document Root")).alias("source_locator"), "filename",
        media.alias("media_type"), U.document_kind(media).alias("document_kind"), F.col("document_url").alias("dedupe_key"),
    )


def resolve_source_ids(df: DataFrame, sources: DataFrame, url: str = "source_url") -> DataFrame:
    """Adds source_id of each URL, null where none is known; of several the smallest."""
    ids = sources.groupBy(url).agg(F.min("source_id").alias("source_id"))
    return df.join(ids, url, "left")


def union_evidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts and evidence records as one table; evidence has the type evidence and null for what only facts have."""
    return facts.unionByName(evidence.withColumn("record_type", F.lit("evidence")), allowMissingColumns=True)


def collection_name(label: Column, prefix: str) -> Column:
    """prefix-slug-hash, at most 255 characters."""
    room = LONGEST_NAME - len(prefix) - 12
    return F.concat(F.lit(f"{prefix}-"), U.stable_slug(label, room))


def generation_label(at: Column) -> Column:
    return F.date_format(at, "'reindex-'yyyyMMdd-HHmmss")


def list_generations(df: DataFrame) -> DataFrame:
    """Generations in order: the active one, then the newest."""
    return df.orderBy(F.when(F.col("status") == "active", 0).otherwise(1), F.desc("created_at"), "label")


def contextualize(chunks: DataFrame, cache: DataFrame, function, key: str = "cache_key") -> DataFrame:
    """Chunks with their context in front and original_text kept: from the cache, else function(list of texts) -> list of contexts over Arrow
    batches. A batch that fails is tried text by text; a text that fails, or has no context, stays as it is."""
    known = chunks.join(cache.select(key, "context").dropDuplicates([key]), key, "left")

    @F.pandas_udf("string")
    def context(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return next(iter(function([t])))
            except Exception:
                return None

        wanted = texts.notna()
        try:
            made = list(function(texts[wanted].tolist()))
        except Exception:
            made = [one(t) for t in texts[wanted]]
        out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
        out[wanted] = made
        return out

    fresh = context(F.when(F.col("context").isNull(), F.col("text")))
    with_context = known.withColumn("_c", F.coalesce("context", fresh))
    text = F.when(F.coalesce("_c", F.lit("")) != "", F.concat(F.col("_c"), F.lit("\n\n"), F.col("text"))).otherwise(F.col("text"))
    return with_context.withColumns({"original_text": F.col("text"), "text": text}).drop("_c", "context")
