"""Who and what a listing page names under which heading: people, programs and their departments and faculties.

A listing is lines in order. A heading opens a run; lines that are hits keep it open; a few other lines in a row end it until the next heading.
So each line needs what came before it: how many misses since the last hit, and whether a run has ended since the last heading. Both
come from running sums and running last values, which are associative: they are taken within ranges of lines, then over the ranges' totals, and
joined back (scan). A listing of any length is so split over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill.functions.text import strip

from .lifecycle import cut

#: Lines of a range.
RANGE = 4096
# Lines that say nothing, titles that aren't names, what names, departments and programs look like, faculties of unlisted programs.
NOISE = ("￫", "￩", "x", "×", "Previous", "Next", "")
TITLES = (
    "Assistant Professor", "Associate Professor", "Professor", "Teaching Fellow", "Tenured Associate Professor", "Tenured Professor", "Adjunct Faculty", "IPFP Fellow",
    "Vice Chancellor", "Lecturer", "Senior Lecturer",
)
TITLE_PREFIXES = ("Professor ", "Assistant Professor ", "Associate Professor ", "Tenured ", "Teaching ", "Adjunct ", "Lecturer ")
SKIPPED_PREFIXES = ("BS ", "MS ", "PHD ", "EXECUTIVE ", "Department of", "Faculty of", "School of")
PERSON = r"^(?:(?:Tenured\s+)?Prof\.?\s+)?(?:Dr\.?\s+)?[A-Z][a-z]+(?:\s+[A-Za-z][A-Za-z.'\-]*)+$"
DEPARTMENT = r"^(?:#{1,6}\s+)?(?:Department of|School of)\s+.+$"
PROGRAM = r"(?i)^(?:BS|MS|PHD|EXECUTIVE)\s+[A-Za-z][A-Za-z &]+$"
DATED, FACULTY = r"^\d{4}-\d{2}-\d{2}T", r"(?i)^Faculty of\s"
DEGREES = ("bs", "ms", "phd", "executive", "mba")
FACULTY_OF = {"MS CYBER SECURITY": "Faculty of Science"}


def lines(listings: DataFrame) -> DataFrame:
    """place, label, no, line: the lines that aren't blank, links replaced by their texts. listings: place (their order), label, text."""
    bare = strip(F.regexp_replace("raw", r"\[([^\]]+)\]\([^)]*\)", "$1"))
    rows = listings.select("place", "label", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "raw"))
    return rows.filter(strip(F.col("raw")) != "").select("place", "label", "no", bare.alias("line"))


def scan(df: DataFrame, key: str, order: str, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums and running last values (of those that aren't null), each up to its own row, of each key's rows in order. The lineage
    is cut, as rows are read twice, and scans stand on scans."""
    sums, lasts = sums or {}, lasts or {}
    rows = cut(df.withColumns({"_range": F.floor(F.col(order) / RANGE), **{f"_{n}": c.cast("long") for n, c in sums.items()}, **{f"_{n}": c for n, c in lasts.items()}}))
    within = Window.partitionBy(key, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    newest = lambda n: F.max_by(f"_{n}", F.when(F.col(f"_{n}").isNotNull(), F.col(order))).alias(f"_t{n}")
    totals = rows.groupBy(key, "_range").agg(*(F.sum(f"_{n}").alias(f"_t{n}") for n in sums), *(newest(n) for n in lasts))
    carried = {f"_c{n}": F.coalesce(F.sum(f"_t{n}").over(before), F.lit(0)) for n in sums} | {f"_c{n}": F.last(f"_t{n}", ignorenulls=True).over(before) for n in lasts}
    totals = totals.withColumns(carried).select(key, "_range", *carried)
    out = {n: F.sum(f"_{n}").over(within) for n in sums} | {n: F.last(f"_{n}", ignorenulls=True).over(within) for n in lasts}
    joined = rows.withColumns(out).join(totals, [key, "_range"])
    joined = joined.withColumns({n: F.col(n) + F.col(f"_c{n}") for n in sums} | {n: F.coalesce(n, f"_c{n}") for n in lasts})
    return joined.select(*df.columns, *sums, *lasts)


def _misses(rows: DataFrame, reset: Column, miss: Column) -> DataFrame:
    """Adds misses: how many such lines there are since the last one that resets."""
    counted = scan(rows.withColumns({"_reset": reset, "_miss": miss}), "place", "no", sums={"_missed": F.col("_miss").cast("int")})
    based = scan(counted, "place", "no", lasts={"_base": F.when(F.col("_reset"), F.col("_missed"))})
    return based.withColumn("misses", F.col("_missed") - F.coalesce("_base", F.lit(0))).drop("_reset", "_missed", "_base")


def under_headings(rows: DataFrame, heading: Column, hit: Column, most: int, in_a_row: bool = True) -> DataFrame:
    """Adds heading (the latest, null where there is none or its run has ended) and hit. `most` other lines end a run; with in_a_row, each hit
    forgives those before it."""
    marked = rows.withColumns({"_heading": heading, "hit": hit})
    resets = F.col("_heading") | F.col("hit") if in_a_row else F.col("_heading")
    missed = _misses(marked, resets, ~F.col("_heading") & ~F.col("hit"))
    name = F.regexp_replace("line", r"^#{1,6}\s+", "")
    known = scan(missed, "place", "no", lasts={"_end": F.when(F.col("_miss") & (F.col("misses") >= most), F.col("no")), "_at": F.when(F.col("_heading"), F.struct("no", name.alias("name")))})
    open_ = F.coalesce(F.col("_end") < F.col("_at.no"), F.lit(True))
    return known.withColumn("heading", F.when(open_ & ~F.col("_heading"), F.col("_at.name"))).drop("_miss", "misses", "_end", "_at")


def _is_title(line: Column) -> Column:
    out = line.isin(*TITLES)
    for p in TITLE_PREFIXES:
        out = out | line.startswith(p)
    return out


def _is_person(line: Column) -> Column:
    return F.length(line).between(5, 80) & ~line.isin(*NOISE) & line.rlike(PERSON) & ~_is_title(line)


def _last_claim(rows: DataFrame, name: str, *values: str) -> DataFrame:
    """Of each name what the last line of the last listing says."""
    return rows.groupBy(name).agg(F.max_by(F.struct(*values), F.struct("place", "no", *(["part"] if "part" in rows.columns else []))).alias("v")).select(name, *(F.col(f"v.{v}").alias(v) for v in values))


def people_faculties(listings: DataFrame) -> DataFrame:
    """person, label: everybody whom a listing names, with the label of the last listing that does."""
    plain = strip(F.col("line"))
    raw = listings.select("place", "label", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("line", plain)
    skipped = F.lit(False)
    for p in SKIPPED_PREFIXES:
        skipped = skipped | F.col("line").startswith(p)
    return _last_claim(raw.filter(~skipped & _is_person(F.col("line"))).withColumnRenamed("line", "person"), "person", "label")


def people_departments(listings: DataFrame) -> DataFrame:
    """person, department: the last heading under which somebody stands; programs keep a department's run open, three other lines end it."""
    line, heading = F.col("line"), F.col("line").rlike(DEPARTMENT)
    person = ~heading & _is_person(line)
    program = ~heading & F.length(line).between(5, 80) & ~line.isin(*NOISE) & ~(line.rlike(PERSON) & ~line.isin(*TITLES)) & line.rlike(PROGRAM)
    named = under_headings(lines(listings).withColumn("person", person), heading, person | program, 3).filter("person and heading is not null")
    return _last_claim(named.select("place", "no", F.col("line").alias("person"), F.col("heading").alias("department")), "person", "department")


def _program(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(strip(text), r"\s*\(.*?\)\s*$", ""), r"\s*:.*$", "")


def _words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0)), F.lower), lambda w: F.length(w) > 1))


def program_departments(listings: DataFrame) -> DataFrame:
    """program, department, label: the last heading over a program; the second line without one ends a heading's run. Where a faculty has several
    headings, a department that shares two words or more with a program, and more than any before it, takes the program over."""
    parts = F.filter(F.transform(F.split("line", "[/,;]"), _program), lambda p: p.rlike(PROGRAM))
    rows, heading = lines(listings).withColumn("parts", parts), F.col("line").rlike(DEPARTMENT)
    seen = under_headings(rows, heading, ~heading & (F.size("parts") > 0), 2, in_a_row=False)
    named = seen.filter("heading is not null and hit").select("place", "no", "label", F.col("heading").alias("department"), F.posexplode("parts").alias("part", "program"))
    placed = _last_claim(named.withColumn("program", F.upper("program")), "program", "department", "label")
    heads = rows.filter(heading).select("label", F.struct("place", "no").alias("at"), F.regexp_replace("line", r"^#{1,6}\s+", "").alias("other"))
    many = heads.groupBy("label").count().filter("count > 1").select("label")
    heads = heads.groupBy("label", "other").agg(F.min("at").alias("at")).withColumn("theirs", _words(F.regexp_replace("other", r"(?i)^(?:Department of|School of)\s+", "")))
    order = F.row_number().over(Window.partitionBy("label").orderBy("at"))
    mine = F.array_except(_words(F.col("program")), F.array(*map(F.lit, DEGREES)))
    scored = placed.join(many, "label").join(heads.withColumn("order", order), "label").withColumn("score", F.size(F.array_intersect(mine, "theirs"))).filter("score >= 2")
    best = scored.groupBy("program").agg(F.max_by("other", F.struct("score", (-F.col("order")).alias("o"))).alias("better"))
    return placed.join(best, "program", "left").select("program", F.coalesce("better", "department").alias("department"), "label")


def program_faculties(listings: DataFrame, overrides: dict[str, str] = FACULTY_OF) -> DataFrame:
    """program, label: the faculty of its department; else of the first listing whose content zone names it; else an override.

    A zone begins after the first dated line (at once, where there is none) and ends, after the first program, at a faculty's own line or the
    second line in a row without a program. Lines under 3 or over 80 characters are passed over."""
    known = program_departments(listings).select("program", "label")
    rows = lines(listings).withColumn("dated", F.col("line").rlike(DATED))
    start = rows.groupBy("place").agg(F.min(F.when(F.col("dated"), F.col("no"))).alias("start"))
    rows = rows.join(start, "place").filter(~F.col("dated") & F.coalesce(F.col("no") > F.col("start"), F.lit(True)) & F.length("line").between(3, 80))
    named = _program(F.col("line"))
    rows = rows.withColumns({"dept": F.col("line").rlike(DEPARTMENT), "faculty": F.col("line").rlike(FACULTY), "program": F.when(named.rlike(PROGRAM), F.upper(named))})
    rows = rows.withColumns({"program": F.when(~F.col("dept") & ~F.col("faculty"), F.col("program")), "other": ~F.col("dept") & ~F.col("faculty")})
    counted = scan(rows, "place", "no", sums={"found": F.col("program").isNotNull().cast("int")})
    missed = _misses(counted, F.col("dept") | F.col("program").isNotNull(), F.col("other") & F.col("program").isNull())
    ends = (F.col("found") > 0) & (F.col("faculty") | (F.col("_miss") & (F.col("misses") >= 2)))
    end = missed.groupBy("place").agg(F.min(F.when(ends, F.col("no"))).alias("end"))
    inside = missed.join(end, "place").filter(F.col("program").isNotNull() & F.coalesce(F.col("no") < F.col("end"), F.lit(True)))
    first = inside.groupBy("program").agg(F.min_by("label", F.struct("place", "no")).alias("label")).join(known, "program", "left_anti")
    both = known.unionByName(first)
    more = listings.sparkSession.createDataFrame(list(overrides.items()) or [("", "")], "program string, label string").filter("program <> ''")
    return both.unionByName(more.join(both, "program", "left_anti"))
