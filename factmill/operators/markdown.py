"""Sections and pipe tables of Markdown texts as arrays built in place: no shuffle until sections gather what stands under them.

Null and empty texts give no rows. The control characters 1 to 3 mark cuts, so those of the text itself are dropped. A text's sections
and tables are as large together as the text; every pattern takes a line at a time, however long tables are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factmill.functions.rendering import let

BLANK = r"[^\S\n]*"
RULE = r"(?U)^\|[\s:|-]+\|$"


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _plain(text: Column) -> Column:
    """Without the marks of bold print."""
    return _trim(F.regexp_replace(text, r"\*\*([^*]+)\*\*", "$1"))


def sections(text: Column) -> Column:
    """Array of level, heading, body; what stands before the first heading has level 0 and no heading, and isn't there if blank.
    A heading that begins with a link is that link's text."""
    marked = F.regexp_replace(F.translate(text, "\x01\x02\x03", ""), r"(?mdU)^(#{1,6})\s+(.+)$", "\x01$1\x02$2\x03")

    def one(piece):
        part = lambda i: F.regexp_extract(piece, r"(?s)^(#+)\x02([^\x03]*)\x03(.*)$", i)
        linked = F.regexp_extract(_trim(part(2)), r"^\[([^\]]+)\]\([^)]*\)", 1)
        head = F.contains(piece, F.lit("\x03"))
        return F.struct(
            F.when(head, F.length(part(1))).otherwise(0).alias("level"), F.when(head, _plain(F.when(linked != "", linked).otherwise(_trim(part(2))))).otherwise("").alias("heading"),
            _trim(F.when(head, part(3)).otherwise(piece)).alias("body"),
        )

    return F.filter(F.transform(F.split(marked, "\x01"), one), lambda s: (s["level"] > 0) | (s["body"] != ""))


def section_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, section (from 0), level, heading, body."""
    return df.select(key, F.posexplode(sections(F.col(text))).alias("section", "s")).select(key, "section", "s.*")


def heading_has(heading: Column, *words: str) -> Column:
    """Whether a heading holds any of the words, in any letter case."""
    low, out = F.lower(heading), F.lit(False)
    for w in words:
        out = out | F.contains(low, F.lit(w.lower()))
    return out


def with_children(rows: DataFrame, key: str) -> DataFrame:
    """section_rows with content: the body and the bodies of deeper sections up to the next that is as high, blank ones left out.

    A section stands under at most five others (one of each higher level), found by running last values; each gives its body to
    these, so a text isn't compared with itself section by section."""
    before = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    over = [F.last(F.when(F.col("level").between(1, n), F.struct("section", "level")), ignorenulls=True).over(before) for n in range(1, 6)]
    found = rows.withColumn("_over", F.array(*over))
    own = F.array(F.struct(F.col("section").alias("to"), F.lit(True).alias("own")))
    above = F.transform("_over", lambda o, i: F.when((o["level"] == i + 1) & (o["level"] < F.col("level")), F.struct(o["section"].alias("to"), F.lit(False).alias("own"))))
    given = found.withColumn("_to", F.explode(F.concat(own, F.filter(above, lambda a: a.isNotNull()))))
    mine = F.col("_to.own")
    bodies = F.array_sort(F.collect_list(F.when(F.col("body") != "", F.struct("section", "body"))))
    grouped = given.groupBy(key, F.col("_to.to").alias("_section")).agg(
        *(F.max(F.when(mine, F.col(c))).alias(c) for c in ("level", "heading", "body")), F.array_join(F.transform(bodies, lambda b: b["body"]), "\n\n").alias("content")
    )
    return grouped.withColumnRenamed("_section", "section")


def join_broken_rows(text: Column, most: int = 5) -> Column:
    """Table rows that go on over up to `most` further lines, until one that closes with a bar without beginning with one, on one line."""
    opening, middle = rf"{BLANK}\|[^\n]*[^|\s]{BLANK}", rf"\n(?:[^\n]*[^|\s])?{BLANK}"
    closing = rf"\n{BLANK}[^|\s][^\n]*\|{BLANK}$"
    marked = F.regexp_replace(text, rf"(?mdU)^({opening}(?:{middle}){{0,{most - 1}}}{closing})", "\x01\x02$1\x01")
    one = lambda p: F.when(F.startswith(p, F.lit("\x02")), F.regexp_replace(F.substring(p, 2, 2**31 - 1), rf"(?U){BLANK}\n{BLANK}", " ")).otherwise(p)
    return F.array_join(F.transform(F.split(marked, "\x01"), one), "")


def pipe_tables(text: Column) -> Column:
    """Array of headers and rows (arrays of cells, one for each header) of the runs of two or more lines between bars.

    The first line holds the headers, empty ones left out; where it is a rule, or all are empty, headers are col_0, col_1, ... as far as
    the widest row goes. Short rows are filled with empty cells, further cells are left out, rules are no rows."""
    joined = join_broken_rows(F.translate(text, "\x01\x02\x03", ""))
    others = F.regexp_replace(joined, rf"(?mdU)^(?!{BLANK}\|(?:[^\n]*\|)?{BLANK}$)[^\n]*$", "\x03")
    runs = F.transform(F.split(others, "\x03"), lambda b: F.filter(F.transform(F.split(b, "\n"), _trim), lambda x: x != ""))

    def table(lines):
        cells = lambda x: let(F.split(x, r"\|", -1), lambda a: F.transform(F.slice(a, 2, F.greatest(F.size(a) - 2, F.lit(0))), _plain))
        rows = F.transform(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: ~x.rlike(RULE)), cells)
        ruled = F.get(lines, F.lit(0)).rlike(RULE)
        names = F.when(ruled, F.array().cast("array<string>")).otherwise(F.filter(cells(F.get(lines, F.lit(0))), lambda x: x != ""))

        def filled(named):
            widest = F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
            made = F.when(widest > 0, F.transform(F.sequence(F.lit(1), F.greatest(widest, F.lit(1))), lambda i: F.concat(F.lit("col_"), (i - 1).cast("string"))))
            return let(
                F.when(F.size(named) > 0, named).otherwise(made),
                lambda h: F.struct(h.alias("headers"), F.transform(rows, lambda r: F.transform(h, lambda _, i: F.coalesce(F.get(r, i), F.lit("")))).alias("rows")),
            )

        return let(names, filled)

    return F.filter(F.transform(F.filter(runs, lambda x: F.size(x) >= 2), table), lambda t: t["headers"].isNotNull())


def table_rows(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, table_no and row_no (from 0), row: header to cell; of equal headers the last counts. Texts without a bar aren't looked at."""
    tables = df.filter(F.contains(text, F.lit("|"))).select(key, F.posexplode(pipe_tables(F.col(text))).alias("table_no", "t"))

    def mapped(pairs):
        last = lambda h: F.try_element_at(F.filter(pairs, lambda p: p["h"] == h), F.lit(-1))["c"]
        return let(F.array_distinct(F.transform(pairs, lambda p: p["h"])), lambda hs: F.map_from_arrays(hs, F.transform(hs, last)))

    rows = tables.select(key, "table_no", "t.headers", F.posexplode("t.rows").alias("row_no", "cells"))
    pairs = F.zip_with("headers", "cells", lambda h, c: F.struct(h.alias("h"), c.alias("c")))
    return rows.select(key, "table_no", "row_no", let(pairs, mapped).alias("row"))
