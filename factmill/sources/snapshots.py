"""Raw pages: names that follow from their address and content, and a reader of folders of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factmill.functions.urls import host, path

#: Longest slug; a longer one is cut and closed with 12 digits of the path's hash.
MOST = 200


def _place(url: Column) -> Column:
    """The path without slashes at its ends, `index` if nothing is left."""
    return F.coalesce(F.nullif(F.regexp_replace(path(F.coalesce(url, F.lit(""))), "^/+|/+$", ""), F.lit("")), F.lit("index"))


def content_extension(content_type: Column) -> Column:
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(F.contains(kind, F.lit("html")), ".html").when(F.contains(kind, F.lit("markdown")), ".md").when(F.contains(kind, F.lit("pdf")), ".pdf").otherwise(".bin")


def storage_key(url: Column, content_hash: Column, content_type: Column) -> Column:
    """host/folders/name-hash.ext, with 12 digits of the content's hash; empty and `.` steps of the path are left out. The same content at the same
    address always has the same key, so a repeated write changes nothing."""
    steps = F.filter(F.split(_place(url), "/"), lambda s: (s != "") & (s != "."))
    name = F.concat(F.coalesce(F.try_element_at(steps, F.lit(-1)), F.lit("")), F.lit("-"), F.substring(content_hash, 1, 12), content_extension(content_type))
    folders = F.slice(steps, 1, F.greatest(F.size(steps) - 1, F.lit(0)))
    site = F.coalesce(F.nullif(host(F.coalesce(url, F.lit(""))), F.lit("")), F.lit("unknown-host"))
    return F.array_join(F.concat(F.array(site), folders, F.array(name)), "/")


def extraction_slug(url: Column) -> Column:
    """The path with _ for slashes, at most 200 characters."""
    place = _place(url)
    slug = F.replace(place, F.lit("/"), F.lit("_"))
    cut = F.concat(F.substring(slug, 1, MOST - 13), F.lit("_"), F.substring(F.sha2(place, 256), 1, 12))
    return F.when(F.length(slug) > MOST, cut).otherwise(slug)


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """path, content_type, content, content_hash and length of the files of a folder, whatever their depth. The type follows from the extension; contents
    are read only where they are asked for; empty files give no row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    end = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kind = F.when(end.isin("html", "htm"), "text/html").when(end == "md", "text/markdown").when(end == "pdf", "application/pdf").otherwise("application/octet-stream")
    return files.select("path", kind.alias("content_type"), "content", F.sha2("content", 256).alias("content_hash"), "length")


def write_extraction(rows: DataFrame, folder: str) -> None:
    """JSON lines in folders of source class and slug, nulls kept. Rows (source_url, source_class, any others) of small sources are brought together and those of
    a large source stay split, so that there are neither many small files nor one task for a source."""
    named = rows.withColumn("slug", extraction_slug(F.col("source_url"))).hint("rebalance", F.col("source_class"), F.col("slug"))
    named.write.mode("errorifexists").option("ignoreNullFields", False).partitionBy("source_class", "slug").json(folder)
