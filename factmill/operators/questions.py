"""Query preparation: classes, hints, synonyms, routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Term lists, the class and the hints that they give, the order of further intents, names of classes.
OUT_OF_SCOPE = (
    "weather", "temperature", "forecast", "rain", "humidity", "stock", "share price", "bitcoin", "crypto", "recipe", "restaurant", "movie", "football", "cricket",
    "nba", "nfl",
)
TERMS = {
    "news": ("news", "event", "events", "seminar", "workshop", "conference", "convocation"),
    "faculty": ("faculty", "professor", "dr ", "dr.", "publication", "publications", "research interest", "research interests", "expertise", "works on"),
    "policy": ("policy", "policies", "attendance", "probation", "threshold", "cgpa", "grade", "grading", "rule", "rules", "regulation", "regulations", "requirement"),
    "fee": ("fee", "fees", "tuition"),
    "scholarship": ("scholarship", "scholarships", "financial aid", "financial assistance"),
    "merit": ("merit", "merit list", "merit lists"),
    "eligibility": ("eligibility", "eligible", "eligibility criteria", "who can apply"),
    "admissions": ("admission", "admissions", "apply", "application", "deadline", "intake"),
}
#: Intent -> query class, source class and record type; the first intent that matches is a query's own.
INTENTS = {
    "news": ("news_or_event", "news_event", "news_event"),
    "faculty": ("faculty_expertise_or_publication", "faculty", None),
    "policy": ("policy_or_threshold", "policy", None),
    "fee": ("fee_or_admissions_cycle", None, "program_fee_schedule"),
    "scholarship": ("fee_or_admissions_cycle", "scholarship", "scholarship"),
    "merit": ("fee_or_admissions_cycle", "merit_list", "merit_list"),
    "eligibility": ("fee_or_admissions_cycle", None, None),
    "admissions": ("fee_or_admissions_cycle", "admissions_cycle", "admissions_cycle"),
}
#: Further intents in the order in which they get a route.
SECONDARY = ("fee", "scholarship", "admissions", "merit", "faculty", "policy", "news", "eligibility")
PUBLICATIONS = ("publication", "publications")
IN_SCOPE = ("university", "department", "program", "office", "student service", "hostel", "placement", "campus")
ALIASES = {"faculty_profile": "faculty", "faculty_publication": "faculty", "policy_rule": "policy", "research_entity": "research_main"}
HINTS = (
    "faculty", "policy", "news_event", "scholarship", "merit_list", "admissions_cycle", "research_main", "general", "program", "program_fee_schedule", "library",
    "university_info", "student_service", "org_unit", "document_asset",
)
SYNONYMS = (
    ("fee", "tuition", "charges", "cost"),
    ("admission", "enrollment", "entry", "intake"),
    ("faculty", "professor", "teacher", "instructor"),
    ("complete", "completion", "graduate", "graduation", "degree completion"),
    ("grading", "grade", "cgpa", "gpa"),
    ("attendance", "class attendance", "attendance policy"),
    ("required", "requirement", "minimum", "needed"),
    ("program", "programme", "degree", "course of study"),
    ("scholarship", "financial aid", "merit scholarship", "need-based aid"),
    ("deadline", "last date", "due date", "closing date"),
    ("requirement", "eligibility", "criteria", "prerequisite"),
    ("semester", "term", "session"),
    ("campus", "university", "institute"),
    ("department", "school", "division"),
)
#: A keyword hint of these classes or types is not overruled by similarity.
STRONG_CLASSES = ("policy", "fee", "scholarship", "admissions")
STRONG_TYPES = ("program_fee_schedule", "scholarship", "admissions_cycle")


def words_pattern(terms) -> str:
    """One alternation of whole terms; works without lookaround. A term that ends with a blank or a point has its own end."""
    plain = [t for t in terms if t[-1].isalnum()]
    ended = [t.replace(".", "[.]") for t in terms if not t[-1].isalnum()]
    return "(^|[^a-z0-9])((" + "|".join(plain or ["$^"]) + ")([^a-z0-9]|$)" + "".join(f"|{t}" for t in ended) + ")"


def normalized(text: Column) -> Column:
    """Lower case, outer blanks off, every run of white space one blank."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s\x1c-\x1f]+", " "))


def has_terms(text: Column, terms) -> Column:
    return normalized(text).rlike(words_pattern(terms))


def _hints(source: str | None, kind: str | None) -> Column:
    return F.struct(F.lit(source).cast("string").alias("source_class"), F.lit(kind).cast("string").alias("record_type"))


def classify(text: Column) -> Column:
    """Struct of query_class, source_class and record_type: out_of_scope unless an in-scope term occurs too; else the first intent that
    matches; else entity_lookup. Faculty questions about publications ask for that type."""
    low = normalized(text)
    has = lambda terms: low.rlike(words_pattern(terms))
    made = lambda name, source, kind: F.struct(F.lit(name).alias("query_class"), F.lit(source).cast("string").alias("source_class"), kind.cast("string").alias("record_type"))
    out = F.when(has(OUT_OF_SCOPE) & ~has([t for terms in TERMS.values() for t in terms] + list(IN_SCOPE)), made("out_of_scope", None, F.lit(None)))
    for intent, (name, source, kind) in INTENTS.items():
        out = out.when(has(TERMS[intent]), made(name, source, F.when(has(PUBLICATIONS), "faculty_publication") if intent == "faculty" else F.lit(kind)))
    return out.otherwise(made("entity_lookup", None, F.lit(None)))


def secondary_hints(text: Column, primary: Column) -> Column:
    """Pairs (source_class, record_type) of all intents that match, in their order, but the primary's own pair."""
    low = normalized(text)
    pairs = F.array_compact(F.array(*(F.when(low.rlike(words_pattern(TERMS[i])), _hints(*INTENTS[i][1:])) for i in SECONDARY)))
    return F.filter(pairs, lambda p: ~(p["source_class"].eqNullSafe(primary["source_class"]) & p["record_type"].eqNullSafe(primary["record_type"])))


def record_type_hint(text: Column, query_class: Column) -> Column:
    """The type that the words ask for within a class that another classifier gave: of fees and admissions the first intent among fee,
    scholarship, merit, eligibility (none) and admissions; of faculty, publications."""
    low = normalized(text)
    kind = F.lit(None).cast("string")
    for intent in ("admissions", "eligibility", "merit", "scholarship", "fee"):
        kind = F.when(low.rlike(words_pattern(TERMS[intent])), F.lit(INTENTS[intent][2])).otherwise(kind)
    return F.when(query_class == "fee_or_admissions_cycle", kind).when(
        (query_class == "faculty_expertise_or_publication") & low.rlike(words_pattern(PUBLICATIONS)), "faculty_publication"
    )


def normalize_hint(hint: Column) -> Column:
    """A known class name, aliases resolved; null for anything else."""
    h = F.lower(F.regexp_replace(F.regexp_replace(hint, r"[\x00-\x1F]", ""), r"(?U)^\s+|\s+$", ""))
    for old, new in ALIASES.items():
        h = F.when(h == old, new).otherwise(h)
    return F.when(h.isin(*HINTS), h)


def effective_hint(classified: Column, given: Column) -> Column:
    """The classified hint wins over the user's."""
    return F.coalesce(normalize_hint(classified), normalize_hint(given))


def synonym_terms() -> list[tuple[str, list[str]]]:
    """Each term with the other terms of its first group, in order."""
    seen: dict[str, list[str]] = {}
    for group in SYNONYMS:
        for t in group:
            seen.setdefault(t, [x for x in group if x != t])
    return list(seen.items())


def expand_synonyms(text: Column, most: int = 3) -> Column:
    """The query and up to most - 1 variants: for each term in it, in order, each synonym not in it put in the place of the term's first
    occurrence as whole words."""
    low, variants = F.lower(text), []
    for term, others in synonym_terms():
        here = low.rlike(words_pattern([term]))
        for other in others:
            swapped = F.regexp_replace(low, rf"(?s)^(.*?)(?<![a-z0-9]){term}(?![a-z0-9])", f"$1{other}")
            variants.append(F.when(here & ~low.rlike(words_pattern([other])), swapped))
    distinct = F.array_distinct(F.array_compact(F.array(*variants)))
    rest = F.filter(distinct, lambda v: v != low)
    return F.slice(F.concat(F.array(text), rest), 1, most)


def reconcile(keyword: Column, semantic: Column) -> Column:
    """Of two classifications (structs with source_class and record_type) the keyword one if its hint is strong, else the semantic one."""
    strong = keyword["source_class"].isin(*STRONG_CLASSES) | keyword["record_type"].isin(*STRONG_TYPES)
    return F.when(F.coalesce(strong, F.lit(False)), keyword).otherwise(semantic)


def plan_routes(source_hint: Column, type_hint: Column, given: Column, secondary: Column) -> Column:
    """Where the user gave a hint (given), one strict route by what is known of class and type; else class, everything, type. Then up to
    two secondary pairs. Of equal (class, type) the first route stays. A question without any route searches everything."""
    null = F.lit(None).cast("string")
    route = lambda name, c, t: F.struct(F.lit(name).alias("route"), c.alias("source_class"), t.alias("record_type"))
    both = source_hint.isNotNull() & type_hint.isNotNull()
    strict = F.array(
        F.when(both, route("strict_source_and_type", source_hint, type_hint)).when(source_hint.isNotNull(), route("strict_source", source_hint, null))
        .when(type_hint.isNotNull(), route("strict_record_type", null, type_hint))
    )
    free = F.array(F.when(source_hint.isNotNull(), route("source_hint", source_hint, null)), route("global", null, null), F.when(type_hint.isNotNull(), route("record_type", null, type_hint)))
    more = F.transform(F.slice(secondary, 1, 2), lambda p: route("secondary_intent", p["source_class"], p["record_type"]))
    every = F.concat(F.array_compact(F.when(given.isNotNull(), strict).otherwise(free)), more)
    key = lambda r: F.concat(F.coalesce(r["source_class"], F.lit("")), F.lit("|"), F.coalesce(r["record_type"], F.lit("")))
    keys = F.transform(every, key)
    first = F.filter(every, lambda r, i: F.array_position(keys, key(r)) == i + 1)
    return F.when(F.size(first) == 0, F.array(route("global", null, null))).otherwise(first)


def prepare(df: DataFrame, text: str = "text", given: str = "hint", semantic: Column | None = None, rewrite=None) -> DataFrame:
    """Adds class, source_hint, type_hint, secondary, abstain, retrieval_text and routes (none where a question is out of scope).

    semantic, if given, is another classifier's struct (query_class, source_class, record_type), which the words' own hints overrule where
    they are strong. rewrite, if given, is a function from Column to Column whose rewritten question is searched for where the gate lets it."""
    from .filters import rewrite_gate

    t = F.col(text)
    kept = df.withColumn("_own", classify(t))
    kept = kept.withColumn("_c", F.col("_own") if semantic is None else reconcile(F.col("_own"), semantic))
    out_of_scope = F.col("_c.query_class") == "out_of_scope"
    out = kept.withColumns(
        {
            "class": F.col("_c.query_class"), "abstain": out_of_scope, "type_hint": F.col("_c.record_type"),
            "source_hint": F.when(~out_of_scope, effective_hint(F.col("_c.source_class"), F.col(given))),
            "secondary": F.when(out_of_scope, F.array().cast("array<struct<source_class:string,record_type:string>>")).otherwise(secondary_hints(t, F.col("_c"))),
            "retrieval_text": t if rewrite is None else rewrite_gate(t, rewrite(t)),
        }
    ).drop("_own", "_c")
    planned = plan_routes(F.col("source_hint"), F.col("type_hint"), F.col(given), F.col("secondary"))
    return out.withColumn("routes", F.when(~F.col("abstain"), planned).otherwise(F.array().cast("array<struct<route:string,source_class:string,record_type:string>>")))
