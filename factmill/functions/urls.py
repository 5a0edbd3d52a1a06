"""URL identity and classification as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Document suffixes, class rules in order, class families.
DOCUMENT_SUFFIXES = "pdf|docx?|xlsx?|csv|pptx?"
PROGRAM_EXCEPTIONS = "eligibility|apply|criteria|calendar|schedule|faqs|application-process|fee-refund"
CLASS_RULES = (
    (rf"[^/]\.({DOCUMENT_SUFFIXES})/*$", "document_asset"),
    (r"(^|[^a-z0-9_])(fee|tuition)([^a-z0-9_]|$)", "program_fee_schedule"),
    (r"merit", "merit_list"),
    (r"scholarship|financial-assistance|financial-aid", "scholarship"),
    (r"^/admissions/.", "program"),
    (r"admission", "admissions_cycle"),
    (r"faculty", "faculty"),
    (r"^/research/", "research_main"),
    (r"news|event", "news_event"),
    (r"policy|regulation", "policy"),
    (r"student-service|placement", "student_service"),
    (r"library", "library"),
    (r"about|information|academic-calendar|vision", "university_info"),
)
FAMILIES = {"admissions_cycle": "admissions", "program": "admissions", "program_fee_schedule": "admissions", "merit_list": "admissions"}
HIGH_RISK = ("admissions_cycle", "program_fee_schedule", "merit_list")
SPECIFIC_WORDS = ("norms", "policy", "criteria", "eligibility", "schedule")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[^:/?#]+://([^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)


def canonicalize_url(url: Column) -> Column:
    """Lower-case scheme and host, path or '/', without port, query and fragment."""
    scheme = F.lower(F.regexp_extract(url, r"^([^:/?#]+)://", 1))
    p = path(url)
    return F.concat(scheme, F.lit("://"), host(url), F.when(p == "", "/").otherwise(p))


def url_identity(url: Column) -> Column:
    """The canonical form with exactly one trailing slash."""
    return F.concat(F.regexp_replace(canonicalize_url(url), "/+$", ""), F.lit("/"))


def classify_source(url: Column) -> Column:
    """First matching rule over the lower-cased path; a page under /admissions/ is a program unless it is about applying. Fees are whole
    words; admissions and research must begin the path."""
    p = F.lower(path(url))
    out = None
    for pattern, name in CLASS_RULES:
        hit = p.rlike(pattern)
        if name == "program":
            hit = hit & ~p.rlike(PROGRAM_EXCEPTIONS)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def source_policy(url: Column, blocked: Column | None = None) -> Column:
    kind = classify_source(url)
    access = F.when(F.coalesce(blocked, F.lit(False)), "blocked").otherwise("allowed") if blocked is not None else F.lit("allowed")
    return F.struct(
        canonicalize_url(url).alias("canonical_url"), kind.alias("source_class"), access.alias("access"), kind.isin(*HIGH_RISK).alias("is_high_risk")
    )


def source_family(source_class: Column) -> Column:
    """The family in which classes are reconciled; null for a class of none."""
    out = F.lit(None).cast("string")
    for name, family in FAMILIES.items():
        out = F.when(source_class == name, family).otherwise(out)
    return out


def resolve_alias(df: DataFrame, aliases: DataFrame, url: str = "url") -> DataFrame:
    """Adds resolved_url: where the lower-cased path is an alias (aliases: path, canonical_path), the canonical path on the same
    host without query; other URLs as they are. The table is small or not; the planner decides how it is joined."""
    key = F.lower(F.when(path(F.col(url)) == "", "/").otherwise(path(F.col(url))))
    base = F.concat(F.lower(F.regexp_extract(url, r"^([^:/?#]+)://", 1)), F.lit("://"), host(F.col(url)))
    known = aliases.select(F.col("path").alias("_path"), F.col("canonical_path").alias("_canonical"))
    out = df.withColumn("_path", key).join(known, "_path", "left")
    return out.withColumn("resolved_url", F.when(F.col("_canonical").isNotNull(), F.concat(base, "_canonical")).otherwise(F.col(url))).drop("_path", "_canonical")


def legacy_aliases(df: DataFrame, aliases: DataFrame, url: str = "url") -> DataFrame:
    """Adds legacy_urls: the URLs of all paths that the URL's path is the canonical form of, sorted."""
    base = F.concat(F.lower(F.regexp_extract(url, r"^([^:/?#]+)://", 1)), F.lit("://"), host(F.col(url)))
    key = F.lower(F.when(path(F.col(url)) == "", "/").otherwise(path(F.col(url))))
    back = aliases.groupBy(F.col("canonical_path").alias("_path")).agg(F.array_sort(F.collect_set("path")).alias("_old"))
    out = df.withColumns({"_path": key, "_base": base}).join(back, "_path", "left")
    made = F.transform(F.coalesce("_old", F.array().cast("array<string>")), lambda p: F.concat(F.col("_base"), p))
    return out.withColumn("legacy_urls", made).drop("_path", "_base", "_old")


def parser_target(source_class: Column, url: Column) -> Column:
    """document for a document asset whose URL has a document's suffix, else page."""
    suffix = F.lower(path(url)).rlike(rf"[^/]\.({DOCUMENT_SUFFIXES})$")
    return F.when((source_class == "document_asset") & suffix, "document").otherwise("page")


def authority_tier(page_kind: Column, content_kind: Column) -> Column:
    """Tier by kind of page and content; an unsupported pair gives null, to be quarantined."""
    return (
        F.when((page_kind == "dedicated_child") & (content_kind == "page_body"), 1)
        .when(page_kind.isin("dedicated_child", "dedicated_section") & content_kind.isin("structured_section", "table"), 2)
        .when(page_kind == "official_document", 3)
        .when(page_kind == "overview", 4)
        .when(page_kind == "navigation", 5)
    )


def source_specificity(url: Column) -> Column:
    """Number of path segments, plus 2 if the path names a rule-like page."""
    p = F.lower(path(url))
    depth = F.size(F.filter(F.split(p, "/"), lambda x: x != ""))
    return depth + F.when(p.rlike("|".join(SPECIFIC_WORDS)), 2).otherwise(0)


def slugify(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def clamp_slug(text: Column, most: int = 60) -> Column:
    """A slug of at most `most` characters; a longer one is cut and closed with 12 digits of its hash."""
    s = slugify(text)
    cut = F.concat(F.substring(s, 1, most - 13), F.lit("-"), F.substring(F.sha2(s, 256), 1, 12))
    return F.when(F.length(s) <= most, s).otherwise(cut)


def stable_slug(text: Column, most: int = 50) -> Column:
    """A slug that always ends with 10 digits of the text's hash."""
    return F.concat(F.substring(slugify(text), 1, most), F.lit("-"), F.substring(F.sha2(text, 256), 1, 10))


def page_slug(url: Column) -> Column:
    return F.element_at(F.filter(F.split(path(url), "/"), lambda x: x != ""), -1)


def document_suffix(url: Column) -> Column:
    s = F.regexp_extract(F.lower(path(url)), rf"\.({DOCUMENT_SUFFIXES})$", 0)
    return F.when(s == "", ".bin").otherwise(s)


def media_type(url: Column) -> Column:
    """MIME type by suffix."""
    office = "application/vnd.openxmlformats-officedocument."
    kinds = {
        ".pdf": "application/pdf", ".csv": "text/csv", ".doc": "application/msword", ".xls": "application/vnd.ms-excel", ".ppt": "application/vnd.ms-powerpoint",
        ".docx": f"{office}wordprocessingml.document", ".xlsx": f"{office}spreadsheetml.sheet", ".pptx": f"{office}presentationml.presentation",
    }
    s, out = document_suffix(url), F.lit(None).cast("string")
    for suffix, kind in kinds.items():
        out = F.when(s == suffix, kind).otherwise(out)
    return F.coalesce(out, F.lit("application/octet-stream"))


def document_kind(media: Column) -> Column:
    """Kind of a document by its MIME type; any image is an image, what isn't known is unknown."""
    word, sheet, slides = media.rlike("msword|wordprocessingml"), media.rlike("ms-excel|spreadsheetml"), media.rlike("ms-powerpoint|presentationml")
    return (
        F.when(media == "application/pdf", "pdf").when(word, "word_document").when(sheet, "spreadsheet").when(slides, "presentation")
        .when(F.startswith(media, F.lit("image/")), "image").otherwise("unknown")
    )
