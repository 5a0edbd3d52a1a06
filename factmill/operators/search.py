"""Retrieval for whole tables of queries: sparse and dense top-k, fusion, reranking, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill.functions.text import strip, token_list

from .blocks import _best, dense_topk, sparse_topk, token_weights  # noqa: F401

# Fixed values.
RRF_K, DECAY = 60, (1.0, 0.99, 0.97, 0.95, 0.92)


def rrf(ranked: DataFrame, query: str = "query_id", item: str = "chunk_id", k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of lists (query, item, rank from 1)."""
    return ranked.groupBy(query, item).agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("score"))


def overlap_score(query: Column, text: Column) -> Column:
    """Share of the query's distinct tokens in the text, plus 0.25 if the text holds the whole query, which a blank one never is."""
    q = F.array_distinct(token_list(query))
    share = F.size(F.array_intersect(q, token_list(text))) / F.greatest(F.size(q), F.lit(1))
    return F.round(share + F.when((strip(query) != "") & F.contains(F.lower(text), F.lower(query)), 0.25).otherwise(0.0), 6)


def adjust_tier(tier: Column, url: Column, hint: Column) -> Column:
    """A tier for this query: URLs that are about the hinted class rise; never above the first."""
    aid, rule = url.rlike("(?i)financial-assistance|scholarship"), url.rlike("(?i)policy|policies|regulation|regulations")
    out = F.when((hint == "scholarship") & aid, F.greatest(tier - 2, F.lit(1))).when((hint == "policy") & rule, F.greatest(tier - 1, F.lit(1)))
    return out.otherwise(tier)


def authority_decay(score: Column, tier: Column) -> Column:
    """A tier that is out of range decays like the last one."""
    return score * F.coalesce(F.get(F.array(*map(F.lit, DECAY)), tier.cast("int") - 1), F.lit(DECAY[-1]))


def min_score(df: DataFrame, least: float) -> DataFrame:
    return df if least <= 0 else df.filter(F.col("score") >= least)


def source_diversity(evidence: DataFrame, most: int, target: int) -> DataFrame:
    """`target` rows by score: of each URL the first `most` distinct records with all their rows, then what overflows where those are
    too few. A record without a URL is a source of its own."""
    if target <= 0:
        return evidence.limit(0)
    order = [F.desc("score"), F.asc("record_version_id"), F.asc("chunk_id")]
    placed = evidence.withColumn("_p", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    if most > 0:
        placed = placed.withColumn("_u", F.coalesce(F.nullif("source_url", F.lit("")), "record_version_id"))
        first = F.min("_p").over(Window.partitionBy("query_id", "_u", "record_version_id"))
        placed = placed.withColumn("_f", first).withColumn("_d", F.dense_rank().over(Window.partitionBy("query_id", "_u").orderBy("_f")))
        placed = placed.withColumn("_over", (F.col("_d") > most).cast("int")).drop("_u", "_f", "_d")
    else:
        placed = placed.withColumn("_over", F.lit(0))
    chosen = Window.partitionBy("query_id").orderBy("_over", "_p")
    kept = placed.withColumn("_n", F.row_number().over(chosen)).filter(F.col("_n") <= target)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_p"))).drop("_p", "_over", "_n")


def reserve_types(evidence: DataFrame, limit: int, slots: int = 2) -> DataFrame:
    """`limit` rows by score, of which up to `slots` are kept for the best of the query's hinted type; other rows of those records are
    left out."""
    order = [F.desc("score"), F.asc("record_version_id"), F.asc("chunk_id")]
    hinted = F.coalesce(F.col("record_type") == F.col("type_hint"), F.lit(False))
    placed = evidence.withColumn("_h", F.row_number().over(Window.partitionBy("query_id", hinted).orderBy(*order)))
    placed = placed.withColumn("_r", (hinted & (F.col("_h") <= slots)).cast("int"))
    taken = placed.filter("_r = 1").select("query_id", "record_version_id").distinct()
    rest = placed.filter("_r = 0").join(taken, ["query_id", "record_version_id"], "left_anti")
    chosen = Window.partitionBy("query_id").orderBy(F.desc("_r"), *order)
    kept = placed.filter("_r = 1").unionByName(rest).withColumn("_n", F.row_number().over(chosen)).filter(F.col("_n") <= limit)
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).drop("_h", "_r", "_n")


def adjacent_chunks(chunks: DataFrame, key: str = "record_version_id", index: str = "chunk_index", text: str = "text") -> DataFrame:
    """Adds context_window: the chunk with its neighbours, in order, joined by a blank line."""
    w = Window.partitionBy(key).orderBy(index)
    near = lambda f: F.when(F.abs(f(index).over(w) - F.col(index)) == 1, f(text).over(w))
    return chunks.withColumn("context_window", F.concat_ws("\n\n", near(F.lag), text, near(F.lead)))


def merge_routes(points: DataFrame) -> DataFrame:
    """Distinct points of a query: the first route wins, then the rank within it."""
    first = points.groupBy("query_id", "chunk_id").agg(F.min(F.struct("route", "rank", "score")).alias("f"))
    w = Window.partitionBy("query_id").orderBy("f.route", "f.rank", "chunk_id")
    return first.select("query_id", "chunk_id", "f.route", "f.score", F.row_number().over(w).alias("place"))


def limit_per_type(df: DataFrame, n: int, order: str, kind: str = "record_type") -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(kind).orderBy(order))).filter(F.col("_n") <= n).drop("_n")


def class_scores(hits: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Best class of each query by its greatest similarity; under the threshold the fallback; other classes above it are secondary."""
    per = hits.groupBy("query_id", "label").agg(F.max("score").alias("score"))
    top = per.groupBy("query_id").agg(
        F.max(F.struct("score", (-F.col("label")).alias("m"))).alias("t"),
        F.array_sort(F.collect_list(F.when(F.col("score") >= threshold, F.col("label")))).alias("near"),
    )
    best = -F.col("t.m")
    return top.select(
        "query_id", F.when(F.col("t.score") >= threshold, best).otherwise(-1).alias("label"), F.col("t.score").alias("score"),
        F.array_except("near", F.array(best)).alias("secondary"),
    )


def expand_requests(queries: DataFrame) -> DataFrame:
    """One row for each route and variant of a query. Outer, as for an inner explode the planner filters by the arrays' sizes before, for which
    it works out all routes again, every hint anew at each place that names it."""
    routes = queries.select("query_id", "variants", F.posexplode_outer("routes").alias("route_no", "route")).filter("route_no IS NOT NULL")
    return routes.select("query_id", "route_no", "route", F.posexplode_outer("variants").alias("variant_no", "variant")).filter("variant_no IS NOT NULL")


def hydrate(points: DataFrame, records: DataFrame, sources: DataFrame) -> DataFrame:
    """Points with their record's facts, late: only what was found is joined; sources that may not be used drop out, and the
    content is the original text, else the chunk's, else the rendering."""
    from .filters import source_allowed

    rows = points.join(records, "record_version_id").join(sources.select("source_url", "legal_status"), "source_url", "left").filter(source_allowed(F.col("legal_status")))
    empty = lambda c: F.nullif(F.col(c), F.lit(""))
    return rows.withColumn("content", F.coalesce(empty("original_text"), empty("chunk_text"), empty("rendered"))).drop("legal_status")


def final_select(evidence: DataFrame, limit: int, least: float = 0.1) -> DataFrame:
    """Tier overrides, decay, minimum, primaries, diversity, type reservation, in this order."""
    from .dedupe import select_primary_hits

    e = evidence.withColumn("tier", adjust_tier(F.col("tier"), F.col("source_url"), F.col("source_hint")))
    e = min_score(e.withColumn("score", F.round(authority_decay(F.col("score"), F.col("tier")), 6)), least)
    return reserve_types(source_diversity(select_primary_hits(e), 1, max(limit, 3)).drop("place"), limit)


def with_relaxed(hinted: DataFrame, free: DataFrame, least: float) -> DataFrame:
    """Hits under the hint; for queries with none of at least `least`, the hits without it."""
    answered = hinted.filter(F.col("score") >= least).select("query_id").distinct()
    kept = hinted.join(answered, "query_id", "left_semi").withColumn("relaxed", F.lit(False))
    return kept.unionByName(free.join(answered, "query_id", "left_anti").withColumn("relaxed", F.lit(True)))


def in_generation(df: DataFrame, active: Column, column: str = "generation_id") -> DataFrame:
    """Rows of the active generation; a missing id is the empty one."""
    return df.filter(F.coalesce(F.col(column), F.lit("")) == F.coalesce(active, F.lit("")))


def route_filter(chunks: DataFrame, routes: DataFrame, active: Column) -> DataFrame:
    """Chunks that each route (query_id, route, source_class, record_type) may search: of the active generation, current, of a class
    that the hint covers, of the hinted type. A hint that is null asks for nothing. Routes of equal hints meet the chunks once."""
    live = in_generation(chunks, active).filter("freshness = 'current'")
    hints = routes.select(F.col("source_class").alias("_class"), F.col("record_type").alias("_type")).distinct()
    kinds = live.select("source_class", "record_type").distinct()  # as many rows as classes and types
    allowed = kinds.join(hints, _covers() & (F.col("_type").isNull() | (F.col("_type") == F.col("record_type"))))
    asked = routes.select("query_id", "route", F.col("source_class").alias("_class"), F.col("record_type").alias("_type"))
    same = lambda c: asked[c].eqNullSafe(allowed[c])
    wanted = asked.join(allowed, same("_class") & same("_type")).select("query_id", "route", "source_class", "record_type")
    return live.join(wanted, ["source_class", "record_type"])


def _covers() -> Column:
    """Whether the hint _class covers source_class: its own, and documents for policies."""
    from .filters import source_class_matches

    return F.col("_class").isNull() | source_class_matches(F.col("source_class"), F.col("_class"))


def rerank(evidence: DataFrame, scores: DataFrame) -> DataFrame:
    """Evidence by the scores (query_id, chunk_id, score) of any reranker; what it didn't score has 0."""
    given = scores.groupBy("query_id", "chunk_id").agg(F.max("score").alias("_score"))
    out = evidence.join(given, ["query_id", "chunk_id"], "left").withColumn("score", F.coalesce("_score", F.lit(0.0))).drop("_score")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return out.withColumn("place", F.row_number().over(w))


def hybrid_topk(sparse: DataFrame, dense: DataFrame, k: int, query: str = "query_id", item: str = "chunk_id") -> DataFrame:
    """Fusion of a sparse and a dense ranking (query, item, rank), the k best of each query."""
    fused = rrf(sparse.select(query, item, "rank").unionByName(dense.select(query, item, "rank")), query, item)
    return _best(fused, query, item, k)


def embed(chunks: DataFrame, key: str, text: str, function) -> DataFrame:
    """key, embedding, error: function(list of texts) -> list of vectors over Arrow batches; when a batch fails its rows are tried one by
    one, and a row that fails has its error instead of a vector."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            texts = pdf[text].tolist()
            try:
                vectors, errors = list(function(texts)), [None] * len(texts)
            except Exception:
                vectors, errors = [], []
                for t in texts:
                    try:
                        vectors.append(next(iter(function([t]))))
                        errors.append(None)
                    except Exception as e:
                        vectors.append(None)
                        errors.append(str(e))
            yield pd.DataFrame({key: pdf[key], "embedding": vectors, "error": errors})

    return chunks.select(key, text).mapInPandas(run, f"{key} {chunks.schema[key].dataType.simpleString()}, embedding array<double>, error string")


def embedding_summary(embedded: DataFrame) -> DataFrame:
    return embedded.agg(F.count_if(F.col("error").isNull()).alias("embedded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
