"""Extraction jobs over tables of texts: Markdown sections, pipe tables, listings, parsed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill.functions.text import strip


def dedupe_labels(df: DataFrame, page: str, label: str, order: str) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(page, label).orderBy(order))
    return df.withColumn("unique_label", F.concat(label, F.when(nth > 1, F.concat(F.lit("-"), nth)).otherwise("")))


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def split_md_sections(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, section, level, heading, body: lines under their latest heading; lines before the first heading are section 0."""
    rows = lines(df, key, text)
    mark = F.length(F.regexp_extract("line", r"^(#{1,6}) +\S", 1))
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    numbered = rows.withColumn("level", mark).withColumn("section", F.sum((F.col("level") > 0).cast("int")).over(w))
    grouped = numbered.groupBy(key, "section").agg(
        F.max("level").alias("level"),
        F.max(F.when(F.col("level") > 0, F.regexp_replace("line", r"^#{1,6} +", ""))).alias("heading"),
        F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("line_no", "line")))).alias("rows"),
    )
    return grouped.select(key, "section", "level", "heading", strip(F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("body"))


def parse_pipe_tables(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, table_no, row_no, cells: runs of two or more pipe lines; rule lines are left out, the first row holds the headers."""
    rows = lines(df, key, text).withColumn("is_row", F.col("line").rlike(r"^\s*\|.*\|\s*$"))
    w = Window.partitionBy(key).orderBy("line_no")
    start = F.col("is_row") & ~F.coalesce(F.lag("is_row").over(w), F.lit(False))
    runs = rows.withColumn("table_no", F.sum(start.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("is_row")
    sized = runs.withColumn("run", F.count("*").over(Window.partitionBy(key, "table_no"))).filter("run >= 2").filter(~F.col("line").rlike(r"^[\s|:-]+$"))
    inner = F.regexp_replace("line", r"^\s*\||\|\s*$", "")
    cells = F.transform(F.split(inner, r"\|"), strip)
    row_no = F.row_number().over(Window.partitionBy(key, "table_no").orderBy("line_no")) - 1
    return sized.select(key, "table_no", row_no.alias("row_no"), cells.alias("cells"))


def heading_fill(rows: DataFrame, key: str, heading: Column, order: str = "line_no") -> DataFrame:
    """Adds the latest heading of each line; heading lines themselves are left out."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_h", heading).withColumn("heading", F.last("_h", ignorenulls=True).over(w)).filter("_h is null").drop("_h")


def people_by_heading(rows: DataFrame, key: str, heading: Column, person: Column, run: int = 3) -> DataFrame:
    """Lines that name a person under the latest heading; `run` other lines in a row end a listing until the next heading."""
    filled = heading_fill(rows, key, heading).withColumn("_p", person)
    block = Window.partitionBy(key, "heading").orderBy("line_no")
    misses = filled.withColumn("_g", F.sum(F.col("_p").cast("int")).over(block))
    counted = misses.withColumn("_m", F.sum((~F.col("_p")).cast("int")).over(Window.partitionBy(key, "heading", "_g").orderBy("line_no")))
    ended = counted.withColumn("_e", F.max((F.col("_m") >= run).cast("int")).over(block))
    return ended.filter("_p and _e = 0 and heading is not null").drop("_p", "_g", "_m", "_e")


def flatten_parsed_documents(docs: DataFrame, key: str, sections: str = "sections") -> DataFrame:
    """One row for each table cell of each section of a parsed document, with a locator per page."""
    s = docs.select(key, F.posexplode(sections).alias("section_order", "s"))
    nth = F.row_number().over(Window.partitionBy(key, "s.page_number").orderBy("section_order"))
    located = s.withColumn("locator", F.concat(F.lit("page:"), F.col("s.page_number"), F.lit("#"), nth))
    return located.select(key, "section_order", "locator", F.posexplode_outer("s.table_cells").alias("cell_no", "cell"))
