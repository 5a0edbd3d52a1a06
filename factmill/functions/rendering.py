"""Payloads as text: whole, in labelled sections, and as a one-line identity; all Column expressions.

A payload is a map<string,string>; its lists are a map<string,array<string>> beside it. A value of blanks counts as missing, and
missing parts leave no trace. Types are rows of the tables below, which a user may extend.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH, GAP = " — ", "\n\n"


def inline(*keys: str) -> tuple:
    return ("inline", *keys)


def listed(label: str, key: str) -> tuple:
    return ("listed", label, key)


def lines(label: str, key: str) -> tuple:
    return ("lines", label, key)


# What each type's text has, in order. A plain string is the value of that key.
CHILD = ("parent_name", "title", "organization", "role", "content", "value_text")
PAGE = ("title", "faq_question", "faq_answer", "content", "body_text")
TEXTS = {
    "admissions_cycle": (("word", "Admissions Milestone"), inline("milestone_name", "date_text", "calendar_scope"), listed("Normalized Dates", "normalized_dates"), "source_last_modified_text"),
    "program": (
        inline("program_name", "degree_level"), "overview_text", "eligibility_summary", listed("Test Options", "test_options"), "faculty_label", "department_label", "credit_hours",
        "program_structure_text", listed("Curriculum Documents", "curriculum_document_urls"),
    ),
    "program_curriculum": (("curriculum", "program_name", "degree_level"), "section_label", "curriculum_table_text"),
    "program_fee_schedule": (
        inline("program_name", "table_kind", "audience", "currency", "cycle_label"), "total_degree_fee", "repeat_fee_per_credit_hour", "annual_cost_per_student", "raw_table_text",
        "fee_table_markdown", lines("Rows", "rows"), lines("Warnings", "parse_warnings"),
    ),
    "faculty_profile": (
        inline("name", "designation_text", "department_label", "faculty_label"), "qualification_text", "role_text", listed("Research Interests", "research_interests"), "biography_text", "email",
    ),
    "faculty_publication": (inline("parent_name", "publication_type", "year"), "title", listed("Authors", "authors"), "venue", "raw_citation", "value_text"),
    "faculty_award": CHILD,
    "faculty_affiliation": CHILD,
    "document_landing": (
        "title", "summary_text", listed("Document Labels", "linked_document_labels"), listed("Document URLs", "linked_document_urls"), listed("Sections", "section_labels"),
    ),
    "document_asset": ("document_title", "filename", "document_kind", "media_type", "document_url", "parent_page_url"),
    "research_entity": ("name", "subdomain_url", ("host", "subdomain_url"), "main_site_url", "crawl_status"),
    "merit_list": ("title", "program_name", "merit_stage", "cycle_label", "detail_url", "content"),
    "policy_rule": (inline("policy_area", "rule_title"), "rule_text"),
    "scholarship": (inline("scholarship_name", "category_label"), "content", "benefit_text", "eligibility_text", "duration_text", listed("Columns", "columns")),
    "university_info": PAGE,
    "student_service": PAGE,
    "news_event": PAGE,
    "org_unit": (("unit", "name", "unit_type"), "content", listed("Staff Contacts", "staff_contacts")),
}
FALLBACK = (
    "content", "raw_row_text", "raw_citation", "raw_table_text", "fee_table_markdown", "overview_text", "value_text", "biography_text", "rule_text", "benefit_text",
    "summary_text", "body_text", "eligibility_text", "qualification_text", "milestone_text",
)
FALLBACK_LINE = inline("name", "designation_text", "department_label", "faculty_label")
PAGE_SECTIONS = (("", ("title", "faq_question")), ("Details", ("faq_answer", "content")))
SECTIONS = {
    "program": (
        ("Overview", (inline("program_name", "degree_level"), "overview_text", "faculty_label", "department_label", "credit_hours")),
        ("Eligibility", ("eligibility_summary", listed("Test Options", "test_options"))), ("Structure", ("program_structure_text",)),
        ("Curriculum", (listed("Curriculum Documents", "curriculum_document_urls"),)),
    ),
    "program_curriculum": (("Curriculum", (inline("program_name", "degree_level"), "section_label", "curriculum_table_text")),),
    "faculty_profile": (
        ("Profile", (inline("name", "designation_text", "department_label", "faculty_label"), "qualification_text", "role_text", "email")), ("Biography", ("biography_text",)),
        ("Research", (listed("Research Interests", "research_interests"),)),
    ),
    "org_unit": (("About", (inline("name", "unit_type"), "content")), ("Staff", (listed("Staff Contacts", "staff_contacts"),))),
    "university_info": PAGE_SECTIONS,
    "student_service": PAGE_SECTIONS,
    "news_event": PAGE_SECTIONS,
}
IDENTITIES = {
    "program": ("Program", "program_name", "degree_level", "faculty_label"),
    "program_curriculum": ("Curriculum", "program_name", "degree_level", "section_label"),
    "faculty_profile": ("Faculty", "name", "designation_text", "department_label"),
    "faculty_publication": ("Publication", "parent_name", "publication_type", "year"),
    "faculty_award": ("Award", "parent_name", "title"),
    "faculty_affiliation": ("Affiliation", "parent_name", "organization"),
    "admissions_cycle": ("Admissions", "milestone_name", "calendar_scope"),
    "program_fee_schedule": ("Fee Schedule", "program_name", "table_kind", "cycle_label", "total_degree_fee", "repeat_fee_per_credit_hour"),
    "policy_rule": ("Policy", "policy_area", "rule_title"),
    "scholarship": ("Scholarship", "scholarship_name", "category_label"),
    "org_unit": ("Unit", "name", "unit_type"),
    "merit_list": ("Merit List", "program_name", "merit_stage", "cycle_label"),
    "university_info": ("Info", "title"),
    "student_service": ("Service", "title"),
    "news_event": ("News", "title"),
}


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def scalar(value: Column) -> Column:
    """Stripped text; empty counts as missing."""
    return _missing(F.regexp_replace(value.cast("string"), r"^\s+|\s+\z", ""))


def flatten_items(values: Column) -> Column:
    """The items of a list that aren't missing; an array of structs gives one line for each, its values joined."""
    return F.filter(F.transform(values, scalar), lambda x: x.isNotNull())


def list_inline(label: str, values: Column) -> Column:
    return let(flatten_items(values), lambda items: F.when(F.size(items) > 0, F.concat(F.lit(f"{label}: "), F.array_join(items, "; "))))


def list_lines(label: str, values: Column) -> Column:
    return let(flatten_items(values), lambda items: F.when(F.size(items) > 0, F.concat(F.lit(f"{label}:\n- "), F.array_join(items, "\n- "))))


def _missing(text: Column) -> Column:
    return let(text, lambda t: F.when(t != "", t))


def _clean(values: Column) -> Column:
    """A payload's values stripped, without those that are missing."""
    return F.map_filter(F.transform_values(values, lambda _, v: F.regexp_replace(v, r"^\s+|\s+\z", "")), lambda _, v: F.coalesce(v, F.lit("")) != "")


class Payload:
    """Values of a cleaned payload and its lists."""

    def __init__(self, values: Column, lists: Column | None = None):
        self.values, self.lists = values, lists

    def __getitem__(self, key: str) -> Column:
        return F.element_at(self.values, key)

    def line(self, keys) -> Column:
        return _missing(F.concat_ws(DASH, *(self[k] for k in keys)))

    def part(self, part) -> Column:
        if isinstance(part, str):
            return self[part]
        form, *args = part
        if form == "inline":
            return self.line(args)
        if form == "word":
            return F.lit(args[0])
        if form == "curriculum":
            return F.concat_ws(DASH, self.line(args), F.lit("Curriculum"))
        if form == "host":
            return _missing(F.regexp_extract(self[args[0]], r"^[^:/?#]+://([^/?#]*)", 1))
        if form == "unit":  # a variant other than the overview is named
            variant = self["section_variant"]
            return _missing(F.concat_ws(DASH, self.line(args), F.when(variant != "overview", F.concat(F.lit("["), variant, F.lit("]")))))
        if self.lists is None:
            return F.lit(None).cast("string")
        return {"listed": list_inline, "lines": list_lines}[form](args[0], F.element_at(self.lists, args[1]))

    def text(self, parts) -> Column:
        return _missing(F.concat_ws(GAP, *map(self.part, parts)))

    def fallback(self) -> Column:
        return F.coalesce(*(self[k] for k in FALLBACK), self.line(FALLBACK_LINE[1:]), F.lit(""))


def _text(kind: Column, p: Payload) -> Column:
    made = F.lit(None).cast("string")
    for name, parts in TEXTS.items():
        text = p.text(parts)
        made = F.when(kind == name, F.nullif(text, F.lit("Admissions Milestone")) if name == "admissions_cycle" else text).otherwise(made)
    return F.coalesce(made, p.fallback())


def render_search_text(kind: Column, values: Column, lists: Column | None = None) -> Column:
    """The text of a payload: its type's parts with a blank line between; without any, the first main text it has."""
    return let(_clean(values), lambda m: _text(kind, Payload(m, lists)))


def render_sections(kind: Column, values: Column, lists: Column | None = None) -> Column:
    """array<struct<label, text>>: the labelled sections of types that have some, else the whole text without a label."""
    section = lambda label, text: F.struct(label.alias("label"), F.coalesce(text, F.lit("")).alias("text"))

    def body(m):
        p = Payload(m, lists)
        about = F.when(p["section_variant"] == "directory", "Directory").otherwise("About")
        made = F.array(section(F.lit(""), F.lit("")))
        for name, sections in SECTIONS.items():
            own = F.array(*(section(about if word == "About" else F.lit(word), p.text(parts)) for word, parts in sections))
            made = F.when(kind == name, own).otherwise(made)
        whole = F.array(section(F.lit(""), F.when(kind.isin(*SECTIONS), p.fallback()).otherwise(_text(kind, p))))
        filled = F.transform(F.array(made, whole), lambda a: F.filter(a, lambda s: s["text"] != ""))
        return F.coalesce(F.get(F.filter(filled, lambda a: F.size(a) > 0), F.lit(0)), F.filter(made, lambda s: s["text"] != ""))

    return let(_clean(values), body)


def render_prefix(kind: Column, values: Column) -> Column:
    """What a chunk of the record begins with: the type's word and the values that name it, else the type as the source."""

    def body(m):
        p, out = Payload(m), F.lit(None).cast("string")
        for name, (word, *keys) in IDENTITIES.items():
            line = F.concat(F.lit(f"{word}: "), p.line(keys))
            if name == "org_unit":
                variant = p["section_variant"]
                line = F.concat(line, F.coalesce(F.when(variant != "overview", F.concat(F.lit(" ("), variant, F.lit(")"))), F.lit("")))
            out = F.when(kind == name, line).otherwise(out)
        return F.coalesce(out, F.concat(F.lit("Source: "), kind))

    return let(_clean(values), body)
