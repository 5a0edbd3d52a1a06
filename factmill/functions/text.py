"""Hashes, keys and text cleaning as Column expressions."""

from __future__ import annotations

import hashlib
import json as codec

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \t\n\x0B\f\r]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+$", "")


def value_hash(rendered: Column, fallback: Column, stored: Column | None = None) -> Column:
    """SHA-256 of the stripped rendering; without one the stored hash as it is, else that of the fallback text."""
    text = F.nullif(strip(rendered), F.lit(""))
    return F.coalesce(F.sha2(text, 256), *([stored] if stored is not None else []), F.sha2(strip(F.coalesce(fallback, F.lit(""))), 256))


def record_version_id(record_id: Column, hashed: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", record_id, hashed), 256), 1, 32)


def semantic_normalize(text: Column) -> Column:
    """Dashes to '-', stars to blanks, trailing marks off, blanks to one, lower case."""
    t = F.translate(text, "–—―−", "----")
    t = F.regexp_replace(t, rf"{BLANK}*\*{BLANK}*", " ")
    t = F.regexp_replace(t, rf"(?:{BLANK}|[.,;:!?])+$", "")
    t = F.regexp_replace(t, rf"{BLANK}+", " ")
    return F.lower(strip(t))


def effective_hash(identity: Column, raw: Column) -> Column:
    return F.when(F.coalesce(identity, F.lit("")) != "", F.sha2(identity, 256)).otherwise(raw)


def content_hash(given: Column, content: Column) -> Column:
    return F.coalesce(given, F.sha2(content, 256))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def query_key(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text, rf"{BLANK}+", " ")))


def query_key_near(text: Column) -> Column:
    """Lower case without punctuation, words sorted: queries that differ in order share the key."""
    words = F.split(strip(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " ")), " ")
    return F.array_join(F.array_sort(F.filter(words, lambda w: w != "")), " ")


def strip_nul(text: Column) -> Column:
    return F.translate(text, "\0", "")


def strip_md_images(text: Column) -> Column:
    return F.regexp_replace(text, r"!\[[^\]]*\]\([^)]*\)", "")


def strip_md_links(text: Column) -> Column:
    return F.regexp_replace(text, r"\[([^\]]*)\]\([^)]*\)", "$1")


def strip_md_heading(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^#{1,6}[ \t]*", "")


def strip_inline_markup(text: Column) -> Column:
    """Bold and italic marks off, blanks at both ends off; an underscore inside a word stays."""
    return strip(F.regexp_replace(F.regexp_replace(text, r"\*\*([^*]+)\*\*", "$1"), r"(?U)(?<!\w)_([^_]+)_(?!\w)", "$1"))


def strip_inline_noise(text: Column) -> Column:
    """Text to search for patterns: heading marks, bold and italic marks, targets of links and the bracket before a line's link are taken off, in this order."""
    plain = F.regexp_replace(strip_inline_markup(F.regexp_replace(text, r"(?m)^#{1,6}\s+", "")), r"\]\(https?://[^)]*\)", "")
    return F.regexp_replace(plain, r"(?m)^\[", "")


def strip_nav_list_items(text: Column) -> Column:
    """List items that hold a link and nothing else are left out."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda x: ~strip(x).rlike(r"^(?:\*|-|\d+\.)\s+\[.+\]\(.+\)$")), "\n")


def extract_links(text: Column) -> Column:
    """Array of (text, url) of Markdown links, targets as they stand; images are left out. A line break before the closing bracket is closed up."""
    joined = F.regexp_replace(text, r"(?U)\[([^\]]*?)\s*\n\s*\]", "[$1]")
    part = lambda i: F.regexp_extract_all(joined, F.lit(r"(!?)\[([^\]]+)\]\(([^)]+)\)"), F.lit(i))
    found = F.arrays_zip(part(1).alias("image"), part(2).alias("text"), part(3).alias("url"))
    trim = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    return F.transform(F.filter(found, lambda x: x["image"] == ""), lambda x: F.struct(trim(x["text"]).alias("text"), x["url"].alias("url")))


def extract_emails(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), F.lit(0))


# Lines that are no content, and what closes a page.
NOISE_LINES = (
    r"(?mi)^(?:[\uffe9\uffeb\u00d7x\s]*$|Previous\s+Next\s*$|\[Page load link\].*$|\[Go to Top\].*$|\[\s*Go to Top\s*\].*$|!\[\]\([^)]*Logo[^)]*\).*$|\[Skip to content\].*$)"
)
FOOTER = r"(?ms)^#{5}\s+Students\s*$.*"
BYLINE = r"\A[^\n]*(?:By\s+)?\[[^\]]+\]\(https?://[^)]+/author/[^)]+\)[|]?\d{4}-\d{2}-\d{2}T[\d:+]+\s*\n?"
BANNER = r"\s*\[?!\[[^\]]*\]\([^)]+\)\]?(?:\([^)]+\))?\s*\n?"


def strip_boilerplate(text: Column) -> Column:
    """Cut what precedes the first top heading and what follows the footer heading, drop noise lines; of three line ends or more two stay."""
    t = F.when(text.rlike(r"(?m)^#\s+.+$"), F.regexp_replace(text, r"(?sm)\A.*?(?=^#\s+[^\n]+$)", "")).otherwise(text)
    t = F.regexp_replace(F.regexp_replace(t, FOOTER, ""), NOISE_LINES, "")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def strip_wp_artifacts(body: Column) -> Column:
    """Cut an author's byline off the beginning of a section, then all banner images there."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(body, BYLINE, ""), rf"\A(?:{BANNER})+", ""), r"\A\s+", "")


def token_list(text: Column) -> Column:
    """Lower-case words of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def token_id(token: Column) -> Column:
    """A stable id from the first four bytes of the token's SHA-256."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("long") % 2147483000 + 1


def semantic_identity(kind: Column, payload: Column, rendered: Column, dates: Column | None = None) -> Column:
    """What makes two records of a type the same fact: a key of its payload (map<string,string>), else the normalised rendering.

    A scholarship is its name as a slug, without one its content; a milestone its scope, name and dates (array<string>; without
    any the date text); a fee its labels and table; a research entity its URL, without one its name."""
    from .urls import slugify, url_identity

    raw = lambda k: F.coalesce(F.element_at(payload, k), F.lit(""))
    first = lambda *names: F.coalesce(*(F.nullif(raw(n), F.lit("")) for n in names), F.lit(""))
    joined = lambda *parts: semantic_normalize(F.concat_ws(":", *parts))
    name, url = strip(raw("scholarship_name")), strip(first("subdomain_url", "canonical_center_url"))
    days = F.filter(F.transform(dates, strip), lambda d: d != "") if dates is not None else F.array().cast("array<string>")
    when = F.when(F.size(days) > 0, F.array_join(days, "|")).otherwise(raw("date_text"))
    return (
        F.when((kind == "scholarship") & (name != ""), slugify(F.translate(name, "–—―−", "----")))
        .when(kind == "scholarship", semantic_normalize(raw("content")))
        .when(kind == "admissions_cycle", joined(raw("calendar_scope"), raw("milestone_name"), when))
        .when(kind == "program_fee_schedule", joined(raw("program_name"), raw("audience"), raw("table_kind"), raw("cycle_label"), first("raw_table_text", "fee_table_markdown")))
        .when(kind == "faculty_publication", semantic_normalize(first("raw_citation", "value_text")))
        .when((kind == "research_entity") & (url != ""), url_identity(url))
        .when(kind == "research_entity", semantic_normalize(raw("name")))
        .when(kind.isin("faculty_award", "faculty_affiliation"), semantic_normalize(raw("value_text")))
        .otherwise(semantic_normalize(rendered))
    )


#: What tells a payload's type, in order: of each group of keys one must be there.
TYPE_RULES = (
    ("admissions_cycle", (("milestone_name",), ("date_text",))),
    ("program_curriculum", (("curriculum_table_text",),)),
    ("program", (("program_name",), ("overview_text", "degree_level"))),
    ("document_landing", (("linked_document_labels", "linked_document_urls"),)),
    ("research_entity", (("subdomain_url", "main_site_url"),)),
    ("policy_rule", (("rule_text", "rule_title"),)),
    ("scholarship", (("scholarship_name", "benefit_text"),)),
    ("program_fee_schedule", (("raw_table_text", "fee_table_markdown"),)),
    ("faculty_profile", (("designation_text", "biography_text"),)),
    ("faculty_publication", (("raw_citation",),)),
    ("document_asset", (("document_url", "filename"),)),
)


def infer_record_type(payload: Column) -> Column:
    """First rule that the keys of the payload (a map) meet, whatever their values; null if none does."""
    keys, out = F.map_keys(payload), F.lit(None).cast("string")
    for kind, groups in TYPE_RULES[::-1]:
        met = None
        for group in groups:
            some = F.arrays_overlap(keys, F.array(*map(F.lit, group)))
            met = some if met is None else met & some
        out = F.when(met, kind).otherwise(out)
    return out


def payload_hash(json: Column) -> Column:
    """SHA-256 of a payload's JSON with sorted keys, at every level, and blanks after commas and colons; null is the empty object."""
    @F.pandas_udf("string")
    def hashed(texts: pd.Series) -> pd.Series:
        form = lambda t: codec.dumps(codec.loads(t or "{}"), sort_keys=True)
        return texts.map(lambda t: hashlib.sha256(form(t).encode()).hexdigest())

    return hashed(json)
