"""Readers of source registries and fact records."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of a source entry with their defaults.
SOURCE_DEFAULTS = {"crawl_method": "html_static", "legal_status": "allowed", "refresh_policy": "manual_only", "parser_target": "html"}


def values_of(text: str) -> tuple[list[str], list[tuple[int, str]]]:
    """JSON objects of a text as strings, and (offset, problem) of what can't be read.

    If every line is an object (blank lines and // lines aside) lines are taken; else comments are removed, values may follow one another
    without separators, arrays are flattened, and reading goes on at the next line that begins with a brace."""
    rows = [x for x in (line.strip() for line in text.split("\n")) if x and not x.startswith("//")]
    try:
        parsed = [json.loads(x) for x in rows]
        if parsed and all(isinstance(x, dict) for x in parsed):
            return [json.dumps(x, sort_keys=True) for x in parsed], []
    except ValueError:
        pass
    strings = r'"(?:\\.|[^"\\])*"'
    bare = re.sub(rf"({strings})|/\*.*?\*/|//[^\n]*", lambda m: m[1] or "", text, flags=re.S)
    read, at, out, bad = json.JSONDecoder(), 0, [], []
    while (m := re.compile(r"[^\s,]").search(bare, at)) is not None:
        at = m.start()
        try:
            value, at = read.raw_decode(bare, at)
        except ValueError as e:
            bad.append((at, str(e)))
            nxt = re.compile(r"\n\s*\{").search(bare, at + 1)
            if nxt is None:
                break
            at = nxt.start()
            continue
        out += [json.dumps(x, sort_keys=True) for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)]
    return out, bad


def read_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Records (file, row, payload as VARIANT, fields as map<string,variant>) and problems (file, offset, problem) of JSON files of
    any of the accepted forms. Each file is one unit of work; large corpora come as many files."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def parse(batches):
        for pdf in batches:
            rows = []
            for file, text in zip(pdf["file"], pdf["value"]):
                good, bad = values_of(text)
                rows += [(file, k, v, None, None) for k, v in enumerate(good)] + [(file, None, None, at, why) for at, why in bad]
            yield pd.DataFrame(rows, columns=["file", "row", "json", "offset", "problem"]).astype({"row": "Int64", "offset": "Int64"})

    parsed = files.mapInPandas(parse, "file string, row long, json string, offset long, problem string")
    payload = F.parse_json("json")
    records = parsed.filter("json is not null").select("file", "row", payload.alias("record"), F.variant_get(payload, "$", "map<string,variant>").alias("payload"))
    return records, parsed.filter("problem is not null").select("file", "offset", "problem")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The fast path for JSON lines: Spark's own reader, rows that don't parse apart."""
    rows = spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("_corrupt is null").drop("_corrupt"), rows.filter("_corrupt is not null").select("_corrupt")


def read_sources(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of source entries, or an object that holds one under `sources`, with defaults filled in."""
    raw = spark.read.option("multiLine", True).json(path)
    if "sources" in raw.columns:
        raw = raw.select(F.explode("sources").alias("s")).select("s.*")
    have = lambda c, kind="string": F.col(c).cast(kind) if c in raw.columns else F.lit(None).cast(kind)
    return raw.select(
        "source_url", F.coalesce(have("canonical_url"), "source_url").alias("canonical_url"), have("source_class").alias("source_class"),
        *(F.coalesce(have(c), F.lit(v)).alias(c) for c, v in SOURCE_DEFAULTS.items()),
        F.coalesce(have("default_authority_tier", "int"), F.lit(1)).alias("default_authority_tier"), F.coalesce(have("is_active", "boolean"), F.lit(True)).alias("is_active"),
        *(have(c).alias(c) for c in ("crawl_status", "parent_source_url", "link_text")),
    )
