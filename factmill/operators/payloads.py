"""Payloads of milestones, scholarships and profiles from what pages say, and payloads as plain JSON; all as Column expressions.

Null texts, maps and arrays count as empty. Blanks are those of Unicode. Values that go through several steps are bound once (`let`),
so that no step is evaluated again for each use.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factmill.functions.rendering import let
from factmill.functions.urls import slugify

# Fixed values.
WEEKDAYS = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
YEARS = r"20\d{2}"
CALENDAR = "undergraduate_or_general_admissions"
BENEFIT = r"tuition fee waiver|fee waiver|waiver|discount|stipend of|\d+%\s*(?:tuition|fee|scholarship|waiver|discount)|rs\.?\s*[\d,]+"
BENEFIT_WORDS = "stipend|waiver|discount|fee"
DURATION = r"for\s+(?:one|two|three|four|five|six|\d+)\s+years?|for\s+(?:first|following)\s+semester|for\s+standard\s+duration\s+of\s+the\s+program|for\s+(?:the\s+)?program\s+duration"
ELIGIBILITY = r"top\s+\d+\s+of\s+the\s+admitted|cgpa\s+(?:of\s+)?\d|full[- ]time\s+student|government\s+servants?|armed\s+forces|open\s+to\s+faculty|all\s+enrolled|for\s+each\s+discipline"
NAME_COLUMNS, BENEFIT_COLUMNS, DETAIL_COLUMNS = ("scholarship", "scholarship name", "name"), ("support", "benefit", "benefits"), ("details", "detail")
ELIGIBILITY_COLUMNS, DURATION_COLUMNS = ("eligibility", "criteria", "condition"), ("duration", "tenure")
NAMELESS_COLUMNS = ("sr.", "sr", "s.#", "s#", "#", "type", "eligibility", "support", "benefit")
NAMELESS_VALUES = ("merit", "stipend", "support", "benefit", "details", "detail")
QUALIFICATION = r"ph\.?d|dphil|m\.?s\.?|m\.?sc|mba|b\.?s\.?|b\.?sc|m\.?phil|masters?|post\s*doc"
ROLES = ("chairperson", "chair", "dean", "director", "head", "vice chancellor", "chancellor")
FACULTIES = {
    "faculty of sciences": "Faculty of Science",
    "faculty of science": "Faculty of Science",
    "faculty of engineering": "Faculty of Engineering",
    "faculty of business and management sciences": "Faculty of Business & Management Sciences",
    "faculty of business & management sciences": "Faculty of Business & Management Sciences",
    "faculty of business management sciences": "Faculty of Business & Management Sciences",
    "faculty of humanities and social sciences": "Faculty of Humanities & Social Sciences",
    "faculty of humanities & social sciences": "Faculty of Humanities & Social Sciences",
    "faculty of electrical engineering": "Faculty of Engineering",
}
DEPARTMENTS = {
    "department of computer and software engineering": "Department of Computer & Software Engineering",
    "department of electrical engineering": "Department of Electrical Engineering",
    "department of computer science": "Department of Computer Science",
    "department of artificial intelligence": "Department of Artificial Intelligence",
    "department of economics": "Department of Economics",
    "department of governance and global studies": "Department of Governance & Global Studies",
    "school of business & management": "School of Business & Management",
    "school of business and management": "School of Business & Management",
}
# End of the fixed values.

#: What dates look like, in lower case, with their year|month|day; of the second list, those without a year.
DATED = (
    (r"(\d{4})-(\d{1,2})-(\d{1,2})", "$1|$2|$3"),
    (r"(\d{1,2})([/-])(\d{1,2})\2(\d{4})", "$4|$3|$1"),
    (r"([a-z]+) (\d{1,2}),? (\d{4})", "$3|$1|$2"),
    (r"(\d{1,2}) ([a-z]+) (\d{4})", "$3|$2|$1"),
)
UNDATED = ((r"([a-z]+) (\d{1,2})", "|$1|$2"), (r"(\d{1,2}) ([a-z]+)", "|$2|$1"))


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _some(text: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(text, F.lit(""))


def _texts(values) -> Column:
    return F.array(*map(F.lit, values))


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


# Milestones


def milestone_name(label: Column) -> Column:
    bare = F.regexp_replace(F.coalesce(label, F.lit("")), "^[ :-]+|[ :-]+$", "")
    return _trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def milestone_scope(label: Column, calendar: str = CALENDAR) -> Column:
    return F.concat(F.lit("admissions_cycle:"), slugify(F.lit(calendar)), F.lit(":"), slugify(milestone_name(label)))


def _day(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if the month hasn't that many days; no parser runs."""
    first = F.make_date(year, month, F.lit(1))
    return F.when(day.between(1, F.dayofmonth(F.last_day(first))), F.make_date(year, month, day))


def milestone_dates(text: Column, as_of: Column, years: str = YEARS) -> Column:
    """Struct of dates (those that could be read, in their order), confidence and resolution of a text whose parts stand around '&'.

    A part with a year that the pattern `years` fits, one of this century unless given, is `high`; one without, but with a weekday before it, takes of this year, the next and the last one
    (in this order where they tie) the date that is best: weekday right and not over 180 days ago, then not over 180 days ago, then weekday
    right; `medium` if the weekday is right, else `low`. Any other part is `unknown`. The weakest part counts; an empty text is unknown."""
    months = {form: i for i, name in enumerate(MONTHS, 1) for form in (name, name[:3])}
    some = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "&"), _trim), lambda p: p != "")

    def reading(part):
        bare = F.regexp_replace(part, rf"(?iU)^(?:{WEEKDAYS}),?\s+", "")
        bare = F.regexp_replace(F.regexp_replace(bare, r"(?i)(\d{1,2})(?:st|nd|rd|th)\b", "$1"), r"(?U)\s+", " ")
        return F.struct(F.lower(F.regexp_extract(part, rf"(?iU)^({WEEKDAYS}),?\s+", 1)).alias("weekday"), F.replace(F.lower(_trim(bare)), F.lit("|"), F.lit("?")).alias("t"))

    def fields(r):
        form = lambda table: reduce(lambda t, rule: F.regexp_replace(t, f"^{rule[0]}$", rule[1]), table, r["t"])
        marked = F.when(r["t"].rlike(rf"\b{years}\b"), form(DATED)).when(r["weekday"] != "", form(UNDATED)).otherwise("")
        return F.struct(r["weekday"].alias("weekday"), F.split(marked, r"\|").alias("f"))

    def numbers(r):
        at = lambda i: F.when(F.size(r["f"]) == 3, F.get(r["f"], F.lit(i)))
        month = F.coalesce(_lookup(months, at(1)), at(1).try_cast("int"))
        return F.struct(
            r["weekday"].alias("weekday"), at(0).try_cast("int").alias("y"), F.when(month.between(1, 12), month).alias("m"), at(2).try_cast("int").alias("d")
        )

    def dated(r):
        def option(place, step):
            date = _day(F.year(as_of) + step, r["m"], r["d"])
            fits, near = F.lower(F.date_format(date, "EEEE")) == r["weekday"], date >= F.date_sub(as_of, 180)
            rank = F.when(date.isNotNull(), F.when(near, 2).otherwise(0) + F.when(fits, 1).otherwise(0))
            return F.struct(rank.alias("rank"), F.lit(-place).alias("place"), date.alias("date"), F.when(fits, 2).otherwise(1).alias("level"))

        options = F.filter(F.array(*(option(i, s) for i, s in enumerate((0, 1, -1)))), lambda o: o["rank"].isNotNull())
        stated = _day(r["y"], r["m"], r["d"])
        guess = let(F.array_max(options), lambda o: F.struct(o["date"].alias("date"), F.coalesce(o["level"], F.lit(0)).alias("level")))
        return F.when(r["y"].isNull(), guess).otherwise(F.struct(stated.alias("date"), F.when(stated.isNotNull(), 3).otherwise(0).alias("level")))

    def summary(parts):
        level = F.coalesce(F.array_min(F.transform(parts, lambda p: p["level"])), F.lit(0))
        inferred = F.exists(parts, lambda p: p["level"].isin(1, 2))
        return F.struct(
            F.filter(F.transform(parts, lambda p: p["date"]), lambda d: d.isNotNull()).alias("dates"),
            F.get(_texts(("unknown", "low", "medium", "high")), level).alias("confidence"),
            F.when(inferred, "weekday_inferred").when(level == 3, "explicit").otherwise("unknown").alias("resolution"),
        )

    return let(F.transform(F.transform(F.transform(F.transform(some, reading), fields), numbers), dated), summary)


def normalize_milestones(df: DataFrame, text: Column, as_of: Column, years: str = YEARS) -> DataFrame:
    """Adds dates, confidence and resolution (see milestone_dates)."""
    return df.withColumn("_m", milestone_dates(text, as_of, years)).select("*", "_m.*").drop("_m")


# Scholarships


def _picked(entries: Column, names) -> Column:
    """The value of the first of the names, in any letter case, that has one; of columns that differ by case alone, the last."""
    value = lambda n: F.try_element_at(F.filter(entries, lambda e: F.lower(e["key"]) == n), F.lit(-1))["value"]
    return F.coalesce(*(_some(value(n)) for n in names))


def _nameless(value: Column) -> Column:
    """Nothing, a number in a list, or a word that stands over columns."""
    return let(F.lower(_trim(value)), lambda v: (v == "") | v.rlike(r"(?U)^\d+[.)]?$") | v.isin(*NAMELESS_VALUES))


def scholarship_parts(raw: Column) -> Column:
    """Struct of benefit, eligibility and duration of a text that dashes cut; its first part is a name. A part before `slabs:` is
    eligibility and what follows benefit; one that speaks of benefits and eligibility is cut where the latter begins; what speaks
    of neither, nor of a duration, is eligibility. Benefits and eligibilities are joined, of durations the last counts."""
    edge = lambda t: F.regexp_replace(F.regexp_replace(_trim(t), "^-+", ""), "^[ ;,]+|[ ;,]+$", "")

    def kinds(s):
        slabs = s.rlike("(?i)slabs:")
        useful, mixed = s.rlike(rf"(?iU){BENEFIT}|{BENEFIT_WORDS}"), s.rlike(f"(?iU){ELIGIBILITY}")
        at_slabs = lambda i: _trim(F.regexp_extract(s, r"(?is)^(.*?)slabs:(.*)$", i))
        head, tail = (F.regexp_extract(s, rf"(?isU)^(.*?)((?:{ELIGIBILITY}).*)$", i) for i in (1, 2))
        lasting = s.rlike(f"(?iU){DURATION}")
        return F.struct(
            _some(F.when(slabs, at_slabs(2)).when(useful & mixed, edge(head)).when(useful, s)).alias("benefit"),
            _some(F.when(slabs, at_slabs(1)).when(useful & mixed, F.when(head == "", s).otherwise(edge(tail))).when(~useful & ~lasting, s)).alias("eligibility"),
            F.when(~slabs & ~useful & lasting, s).alias("duration"),
        )

    def cut(text):
        return let(F.split(text, r"(?U)(?:^|\s)-(?=\s*[A-Z\d])", -1), lambda a: F.when(F.size(a) < 2, F.split(text, r"(?U)\s+-", -1)).otherwise(a))

    def parts(a):
        bare = F.transform(F.slice(a, 2, F.size(a)), lambda s: F.regexp_replace(_trim(s), r"(?U)^-+\s*", ""))
        return F.transform(F.filter(bare, lambda s: s != ""), kinds)

    of = lambda p, k: F.filter(F.transform(p, lambda s: s[k]), lambda x: x.isNotNull())
    joined = lambda p, k: _some(F.array_join(of(p, k), "; ")).alias(k)
    return let(
        let(let(F.coalesce(raw, F.lit("")), cut), parts),
        lambda p: F.struct(joined(p, "benefit"), joined(p, "eligibility"), F.try_element_at(of(p, "duration"), F.lit(-1)).alias("duration")),
    )


def scholarship_payload(columns: Column, raw: Column, row_values: Column) -> Column:
    """Struct of name, benefit, eligibility, duration and type of a row: its named columns (a map), its whole text, its cells.

    Named columns come first; only if they give neither benefit, eligibility nor duration, these come from the text. Details alone
    are cut into the three as well. The name is that of a name column, else the first column or cell that could be one, else
    (if the text was read) the start of the text without its number."""
    entries = F.map_entries(F.coalesce(columns, F.create_map().cast("map<string,string>")))
    raw = F.coalesce(raw, F.lit(""))
    before_dash = _trim(F.regexp_replace(_trim(F.regexp_replace(raw, r"(?Us)\s+-(?=[A-Z\d]).*\z", "")), r"(?U)^\d+\.\s*", ""))

    def named(e):
        columns = F.filter(e, lambda x: ~F.lower(x["key"]).isin(*NAMELESS_COLUMNS))
        candidates = F.concat(F.transform(columns, lambda x: x["value"]), F.coalesce(row_values, F.array().cast("array<string>")))
        found = F.get(F.filter(candidates, lambda v: ~F.coalesce(_nameless(v), F.lit(True))), F.lit(0))
        pick = lambda *names: _picked(e, names)
        return F.struct(
            F.coalesce(pick(*NAME_COLUMNS), found).alias("name"), pick(*BENEFIT_COLUMNS, *DETAIL_COLUMNS).alias("benefit"), pick(*BENEFIT_COLUMNS).alias("stated"),
            pick(*ELIGIBILITY_COLUMNS).alias("eligibility"), pick(*DURATION_COLUMNS).alias("duration"), pick("type").alias("type"),
        )

    def read(n):
        bare = n["benefit"].isNull() & n["eligibility"].isNull() & n["duration"].isNull()
        return let(
            F.when(bare, scholarship_parts(raw)),
            lambda p: F.struct(
                F.coalesce(n["name"], F.when(bare, _some(before_dash))).alias("name"), n["stated"].alias("stated"), n["type"].alias("type"),
                *(F.coalesce(n[k], p[k]).alias(k) for k in ("benefit", "eligibility", "duration")),
            ),
        )

    def detailed(n):
        loose = n["eligibility"].isNull() & n["duration"].isNull() & n["benefit"].isNotNull() & n["stated"].isNull()
        return let(
            F.when(loose, scholarship_parts(n["benefit"])),
            lambda p: F.struct(n["name"].alias("name"), *(F.coalesce(p[k], n[k]).alias(k) for k in ("benefit", "eligibility", "duration")), n["type"].alias("type")),
        )

    return let(let(let(entries, named), read), detailed)


def scholarship_key(name: Column) -> Column:
    """The same for names that differ in dashes, closing signs and blanks."""
    bare = F.regexp_replace(F.regexp_replace(name, "[–—―−]", "-"), r"(?U)[\s*.,;:!?]+$", "")
    return slugify(_trim(F.regexp_replace(bare, r"(?U)\s+", " ")))


# Profiles


def faculty_label(*texts: Column) -> Column:
    """`Faculty of ...` of the first text that has one, by its usual name."""
    found = F.coalesce(*(_some(F.regexp_extract(t, r"(?iU)Faculty\s+of\s+[\w&\s]+", 0)) for t in texts))
    return let(_trim(found), lambda f: F.coalesce(_lookup(FACULTIES, F.lower(f)), f))


def department_label(text: Column) -> Column:
    found = _some(F.regexp_extract(text, r"(?iU)(?:Department of|School of)\s+[\w& ]+", 0))
    return let(_trim(found), lambda d: F.coalesce(_lookup(DEPARTMENTS, F.lower(d)), d))


def header_lines(lines: Column) -> Column:
    """Struct of designation_text, qualification_text and role_text: the first line with a degree, and the first two of the others."""
    filled = F.filter(F.transform(F.coalesce(lines, F.array().cast("array<string>")), _trim), lambda s: s != "")

    def split(a):
        degree = F.array_position(F.transform(a, lambda s: s.rlike(f"(?iU){QUALIFICATION}")), True).cast("int")
        rest = let(degree, lambda d: F.filter(a, lambda s, i: i + 1 != d))
        return F.struct(
            F.get(rest, F.lit(0)).alias("designation_text"), F.when(degree > 0, F.get(a, degree - 1)).alias("qualification_text"), F.get(rest, F.lit(1)).alias("role_text")
        )

    return let(filled, split)


def designation_parts(text: Column) -> Column:
    """Struct of designation, role and department_label: `X and <role> ...` before the first comma, or a role that opens what
    follows it. A vice chancellor has neither role nor department."""
    roles = "|".join(ROLES)
    both = rf"(?iU)^(.+?)\s+and\s+((?:{roles})(?:\s+.+)?)"

    def read(t):
        title, after = _trim(F.regexp_extract(t, r"(?s)^([^,]*)", 1)), _trim(F.regexp_extract(t, r"(?s)^[^,]*,(.*)$", 1))
        opening, rest = (F.regexp_extract(after, rf"(?is)^({roles})(.*)$", i) for i in (1, 2))
        paired = title.rlike(both)
        designation = F.when(paired, _trim(F.regexp_extract(title, both, 1))).otherwise(title)
        role = F.when(paired, _trim(F.regexp_extract(title, both, 2))).otherwise(F.initcap(opening))
        department = F.coalesce(F.when(~paired & (opening != ""), department_label(rest)), department_label(t))
        alone = F.lower(designation) == "vice chancellor"
        return F.struct(_some(designation).alias("designation"), F.when(~alone, _some(role)).alias("role"), F.when(~alone, department).alias("department_label"))

    return let(_trim(F.coalesce(text, F.lit(""))), read)


def biography_text(raw: Column) -> Column:
    """The lines of a biography without the controls of galleries around them; null if nothing is left. NUL isn't kept."""
    marks = r"\s×￩￫"
    lines = F.transform(F.split(raw, r"\r\n|[\n\x0b\f\r\x1c-\x1e\u0085  ]"), _trim)
    kept = F.filter(lines, lambda s: (s != "") & ~s.rlike(r"(?iU)^(?:previous|next|image\s+\d+\s+of\s+\d+|gallery)$"))
    text = F.regexp_replace(F.array_join(kept, " "), r"(?U)\s+", " ")
    text = F.regexp_replace(text, r"(?iU)\b(?:previous\s+next|next\s+previous)\b", "")
    text = F.regexp_replace(text, r"(?U)[￩￫]+\s*(?:x\s*)?×?", "")
    # A closing row of marks and single x that ends with a mark goes. Each x is NUL meanwhile, so that a row is one class of characters.
    text = F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("")), r"(?U)\bx\b", "\0")
    text = F.regexp_replace(text, rf"(?U)(?<![{marks}\x00])[{marks}\x00]*[{marks}]\z", "")
    text = F.regexp_replace(F.replace(text, F.lit("\0"), F.lit("x")), r"(?U)\s+", " ")
    return _some(F.regexp_replace(text, "^[ ,;:-]+|[ ,;:-]+$", ""))


def profile_payload(header: Column, biography: Column) -> Column:
    """Struct of all the above for the lines under a person's name and the biography."""

    def read(h):
        d = designation_parts(h["designation_text"])
        return let(
            d,
            lambda p: F.struct(
                *(h[k].alias(k) for k in ("designation_text", "qualification_text", "role_text")), *(p[k].alias(k) for k in ("designation", "role", "department_label")),
                faculty_label(h["designation_text"], h["role_text"], biography).alias("faculty_label"), biography_text(biography).alias("biography_text"),
            ),
        )

    return let(header_lines(header), read)


# Payloads as JSON


def _plain(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        shown = [f for f in kind.fields if not f.name.startswith("_")]
        built = F.struct(*(_plain(value[f.name], f.dataType).alias(f.name) for f in shown)) if shown else F.create_map().cast("map<string,string>")
        return F.when(value.isNotNull(), built)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _plain(x, kind.elementType))
    if isinstance(kind, T.MapType):
        keyed = F.transform_keys(value, lambda k, v: k.cast("string"))
        return F.transform_values(keyed, lambda k, v: _plain(v, kind.valueType))
    simple = (T.StringType, T.BooleanType, T.IntegralType, T.FloatType, T.DoubleType)
    return value if isinstance(kind, simple) else value.cast("string")


def serialize_payload(df: DataFrame, column: str, name: str = "json") -> DataFrame:
    """Adds a nested column as JSON, built from its schema: fields that begin with _ are left out at every level, nulls stay, keys become
    strings, and so do dates, times and decimals. A null payload is {}. The column is a struct or a map."""
    made = F.to_json(_plain(F.col(column), df.schema[column].dataType), {"ignoreNullFields": "false"})
    return df.withColumn(name, F.coalesce(made, F.lit("{}")))
