"""Citations: an ordered table of forms, each a guard with its parts, compiled into one expression. The first form that applies gives the
parts; later ones aren't evaluated. A form is added to the table, not to the code around it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
VENUES = ("journal", "conference", "proceedings", "transactions", "letters", "symposium", "workshop", "review", "magazine")
SOCIETIES = ("IEEE", "ACM")
STATES = ("accepted", "published", "submitted", "appeared", "presented", "in press", "to appear")
PUBLISHERS = ("press", "springer", "elsevier", "wiley", "taylor", "oxford", "cambridge")
METRICS = ("snip", "sjr", "impact factor", "percentile in scopus", "ajg", "jcr")
HEADINGS = ("selected publications", "journal papers", "conference papers")
# End of fixed values.

WORD = r"[A-Z][A-Za-z.'-]*"
PERSON = rf"{WORD}(?: +{WORD}){{1,3}}"
YEAR = r"\b(20[0-9]{2})\b"
LAST_YEAR, FIRST_YEAR = rf"(?U)^(.*){YEAR}(.*)$", rf"(?U)^(.*?){YEAR}(.*)$"
LONE_YEAR = r"^(20[0-9]{2}) ?[.,;]?$"
VOLUME = r"(?i)^(?:(?:vol|no)\.? *)?[0-9]+(?:\.[0-9]+)?$"
#: Words that tell a venue, inside longer words too; societies by their capitals alone, as words of their own.
VENUE = rf"(?:(?i:{'|'.join(VENUES)})|\b(?:{'|'.join(SOCIETIES)})\b)"
LINE_END = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85  ]"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _nobody() -> Column:
    return F.array().cast("array<string>")


def _trim(c: Column, marks: str = " ") -> Column:
    return F.btrim(c, F.lit(marks))


def _rtrim(c: Column, marks: str) -> Column:
    return F.rtrim(c, F.lit(marks))


def _given(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _spaced(c: Column) -> Column:
    return _trim(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+(?=[,.])", ""), r"(?U)\s+", " "))


def _pieces(c: Column, marks: str = " ") -> Column:
    return F.filter(F.transform(F.split(c, ","), lambda x: _trim(x, marks)), lambda x: x != "")


def _unnumbered(c: Column) -> Column:
    return F.regexp_replace(c, r"^(?:\[\d+\]|\d+[.)]\s)\s*", "")


def _person(c: Column) -> Column:
    return c.rlike(rf"^{PERSON}$")


def _volume(c: Column) -> Column:
    return F.coalesce(c.rlike(VOLUME), F.lit(False))


def _meta(c: Column) -> Column:
    return c.rlike(VENUE) | F.lower(c).rlike("|".join((*PUBLISHERS, *STATES, r"vol\.", "^vol ", r"pp\."))) | _volume(c)


def _leading(parts: Column, ok) -> Column:
    """How many parts at the start are ok."""
    return _let(F.array_position(F.transform(parts, lambda x: ~ok(x)), True), lambda p: F.when(p == 0, F.size(parts)).otherwise(p - 1).cast("int"))


def _last(parts: Column, hit) -> Column:
    """Number, from 1, of the last part for which hit(part, index) holds; 0: none."""
    return F.coalesce(F.array_max(F.transform(parts, lambda x, i: F.when(hit(x, i), i + 1).otherwise(0))), F.lit(0))


def _head(parts: Column, n: Column) -> Column:
    return F.slice(parts, 1, F.greatest(n, F.lit(0)))


def _tail(parts: Column, n: Column) -> Column:
    return F.slice(parts, F.greatest(n, F.lit(0)) + 1, F.greatest(F.size(parts) - n, F.lit(0)))


def _groups(c: Column, pattern: str, *names: str) -> Column:
    """Struct of a pattern's groups by name; null where it doesn't match."""
    return F.when(c.rlike(pattern), F.struct(*(F.regexp_extract(c, pattern, i + 1).alias(n) for i, n in enumerate(names))))


def _at_last_year(c: Column, body) -> Column:
    """body(text before the last year, the year), null without a year."""
    return _let(_groups(c, LAST_YEAR, "before", "year", "after"), lambda m: F.when(m.isNotNull(), body(m["before"], m["year"].cast("int"))))


def _cited(authors: Column, title: Column, venue: Column, year: Column) -> Column:
    text = lambda c, n: c.cast("string").alias(n)
    return F.struct(F.coalesce(authors, _nobody()).alias("authors"), text(title, "title"), text(venue, "venue"), year.cast("int").alias("year"))


def _none() -> Column:
    return F.lit(None).cast("string")


def _people(c: Column) -> Column:
    return _pieces(F.regexp_replace(_rtrim(_spaced(c), "."), r"(?i) +and +", ", "))


def _title_and_venue(parts: Column) -> Column:
    """Struct of title and venue: the venue is the last part, with those before it that name a venue, publisher or volume, or that stand before a
    volume. Null where nothing is left for the title."""
    cut = _last(parts, lambda x, i: (i < F.size(parts) - 1) & ~_meta(x) & ~_volume(F.get(parts, i + 1)))
    both = lambda n: F.struct(_given(_trim(F.array_join(_head(parts, n), ", "), " ,.;")).alias("title"), _given(_trim(F.array_join(_tail(parts, n), ", "), " ,.;")).alias("venue"))
    return _let(_let(cut, lambda n: F.when(n > 0, both(n))), lambda r: F.when(r["title"].isNotNull() & r["venue"].isNotNull(), r))


def _without_and(c: Column) -> Column:
    return _trim(F.regexp_replace(c, r"(?i)^and ", ""))


def _people_then_venue(c: Column) -> Column:
    """Struct of authors and venue from 'Name, Name, venue': people end where a part is no name or speaks of a venue or state."""
    names = lambda x: ~x.rlike(VENUE) & ~F.lower(x).rlike("|".join(STATES)) & _person(_without_and(x))
    state = r"(?i)^(?:accepted|published|submitted|appeared|presented)\s+(?:for\s+publication\s+)?in\s+"
    venue = lambda p, n: _given(_trim(F.regexp_replace(_trim(F.array_join(_tail(p, n), ", "), " ,.;"), state, "")))
    return _let(_pieces(c), lambda p: _let(_leading(p, names), lambda n: F.struct(F.transform(_head(p, n), _without_and).alias("authors"), venue(p, n).alias("venue"))))


def _unquoted(c: Column) -> Column:
    return F.regexp_replace(c, "['‘’“”]([^'‘’“”]{1,80})['‘’“”]", "$1")


def _without_metrics(c: Column) -> Column:
    pattern = rf"(?i)\s*\((?=[^)]*\b(?:{'|'.join(METRICS)})\b)[^)]*\)\s*$"
    return _rtrim(_trim(F.regexp_replace(c, pattern, "")), ".,;")


def lines(c: Column) -> Column:
    """Authors, title, venue and a year alone, each on its own line; a line that begins with a mark continues the one before."""
    one = F.array_join(F.filter(F.transform(F.split(c["raw"], LINE_END), _spaced), lambda x: x != ""), "\n")
    joined = F.regexp_replace(one, r"(?<!(?:^|\n)20[0-9]{2} ?[.,;]?)\n(?=[,;:])", " ")

    def body(ls):
        y = F.array_position(F.transform(ls, lambda x: x.rlike(LONE_YEAR)), True).cast("int")

        def parts(n):
            title, venue = (_rtrim(F.get(ls, n - k), ".,;") for k in (3, 2))
            year = F.regexp_extract(F.get(ls, n - 1), LONE_YEAR, 1)
            found = (n >= 4) & (title != "") & (venue != "") & ~_person(title) & ~_person(venue)
            return F.when(found, _cited(_people(F.array_join(_head(ls, n - 3), " ")), title, venue, year))

        return _let(y, parts)

    return _let(F.transform(F.split(joined, "\n"), _spaced), body)


def quoted(opening: str, closing: str, least: int = 1):
    """A title of `least` characters or more in quotes, unless what stands before is neither a name nor without small letters. The first opening mark decides: where
    it has no closing one, no later mark has."""
    pattern = rf"^([^{opening}]*+)[{opening}](.+?)[{closing}](.*)$"

    def after_names(before):
        last = _trim(F.substring_index(_trim(_unnumbered(_rtrim(before, " ,;")), " ,;"), ",", -1))
        name = lambda x: F.regexp_replace(x, r"(?i)^and\s+", "")
        fits = rf"^{PERSON}(?: +(?i:and) +{PERSON})*$"
        return _let(last, lambda x: ~x.rlike(r"\p{IsLowercase}") | name(x).rlike(fits) | x.rlike(r"\(\d{4}\)$|^\(.*\)$|(?i)\bet\s+al\b"))

    def form(c):
        def body(m):
            names = _people(_trim(_unnumbered(_trim(m["before"], " ,;")), " ,;"))
            rest = _trim(m["after"], " ,.;")
            dated = _groups(rest, LAST_YEAR, "before", "year", "after")
            year = F.coalesce(F.nullif(F.regexp_extract(rest, LAST_YEAR, 2), F.lit("")), _given(F.regexp_extract(m["before"], LAST_YEAR, 2)))

            def parts(v):
                plain = _given(_trim(F.coalesce(v["dated"]["before"], v["rest"]), " ,.;"))
                more = _people_then_venue(F.coalesce(_rtrim(v["dated"]["before"], " ,.;"), v["rest"]))
                title = _rtrim(_trim(m["title"]), ",")
                return F.when(F.size(v["names"]) > 0, _cited(v["names"], title, plain, v["year"])).otherwise(
                    _let(more, lambda t: _cited(t["authors"], title, F.coalesce(t["venue"], plain), v["year"]))
                )

            return _let(F.struct(names.alias("names"), rest.alias("rest"), dated.alias("dated"), year.alias("year")), parts)

        found = lambda m: m.isNotNull() & (F.length(m["title"]) >= least) & after_names(m["before"])
        return _let(_groups(c["text"], pattern, "before", "title", "after"), lambda m: F.when(found(m), body(m)))

    return form


def apa(c: Column) -> Column:
    """Authors (year). Title. Venue"""
    pattern = r"^(.*?)[,\s]\s*\((\d{4})\)[.,]\s*(.*)$"

    def body(m):
        def parts(s):
            title = _rtrim(_trim(F.get(s, 0)), ".")
            return F.when(F.length(title) >= 10, _cited(_pieces(_rtrim(_trim(m["before"]), ",")), title, _given(_rtrim(_trim(F.get(s, 1)), ".")), m["year"]))

        return F.when(m.isNotNull(), _let(F.split(_trim(m["after"]), r"\.\s+(?=[A-Z])", 2), parts))

    return _let(_groups(c["text"], pattern, "before", "year", "after"), body)


def authors_first(c: Column) -> Column:
    """Name, Name, title, venue, year: two names or more, then two parts or more"""

    def split(p, n, year):
        both = _let(_title_and_venue(_tail(p, n)), lambda r: F.when(r.isNotNull(), _cited(_head(p, n), _unquoted(r["title"]), r["venue"], year)))
        return F.when((n >= 2) & (F.size(p) - n >= 2), both)

    parts = lambda before: _pieces(_without_metrics(_rtrim(before, " ,(")), " ,.;")
    return _at_last_year(c["bare"], lambda before, year: _let(parts(before), lambda p: _let(_leading(p, _person), lambda n: split(p, n, year))))


def sentences(c: Column) -> Column:
    """Authors. Title. Venue, year. or Authors. Title. Venue. year"""
    plain = lambda x: _rtrim(_trim(x), ".")

    def body(s):
        n = F.size(s)

        def parts(m):
            venue = _rtrim(_trim(m["before"]), " ,")
            title = plain(F.when((venue == "") & (n >= 4), F.get(s, n - 3)).otherwise(F.get(s, n - 2)))
            venue = F.when(venue != "", venue).when(n >= 4, _given(plain(F.get(s, n - 2))))

            def whole(t):
                at = F.array_position(F.transform(s, plain), t).cast("int")
                return F.when(F.length(t) >= 10, _cited(_pieces(plain(F.array_join(_head(s, at - 1), ". "))), t, venue, m["year"]))

            return F.when(m.isNotNull(), _let(title, whole))

        return F.when(n >= 3, _let(_groups(plain(F.get(s, n - 1)), FIRST_YEAR, "before", "year", "after"), parts))

    return _let(F.split(c["bare"], r"\s*\.\s+"), body)


def title_venue(c: Column) -> Column:
    """Title, venue (year) names"""

    def body(m):
        def parts(p):
            names = _people_then_venue(_trim(m["after"], " ,.;"))["authors"]
            fits = p.isNotNull() & (F.length(p["title"]) >= 5) & (_trim(p["title"]) != "") & (_trim(p["venue"]) != "")
            return F.when(fits, _cited(names, _trim(p["title"]), _trim(p["venue"]), m["year"]))

        return F.when(m.isNotNull(), _let(_groups(_rtrim(m["before"], " ,"), r"^(.*),([^,]*)$", "title", "venue"), parts))

    return _let(_groups(c["bare"], r"^(.*?)\((\d{4})\)\s*(.*)$", "before", "year", "after"), body)


def collapsed(c: Column) -> Column:
    """Title Name, Name, venue, year: the venue begins at its last telling word, names stand before it, the first perhaps right after the title"""

    def body(m, year):
        def parts(p):
            cut = _last(p, lambda x, i: (i == 0) | ~_person(x))

            def names(n):
                words, size = F.split(F.get(p, n - 1), " +"), F.size(F.split(F.get(p, n), " +"))

                def first(w):
                    left = F.size(w["words"]) - w["size"]
                    name = F.array_join(_tail(w["words"], left), " ")
                    joined = lambda last: _given(_trim(F.array_join(F.concat(_head(p, n - 1), F.array(last)), ", "), " ,;"))
                    rest = _trim(F.array_join(_head(w["words"], left), " "), " ,;")
                    hides = F.coalesce((F.size(p) > n) & (left >= 2) & _person(name), F.lit(False))
                    return F.when(hides, F.struct(joined(rest).alias("title"), F.concat(F.array(name), _tail(p, n)).alias("authors"))).otherwise(
                        F.struct(joined(F.get(p, n - 1)).alias("title"), _tail(p, n).alias("authors"))
                    )

                return F.when(n > 0, _let(F.struct(words.alias("words"), size.alias("size")), first))

            return _let(_let(cut, names), lambda r: F.when(r["title"].isNotNull(), _cited(r["authors"], r["title"], _trim(m["venue"], " ,"), year)))

        return F.when(m.isNotNull(), _let(_pieces(_rtrim(m["title"], " ,")), parts))

    pattern = rf"^(.+)({VENUE}.*)$"
    return _at_last_year(c["bare"], lambda before, year: _let(_groups(_rtrim(before, " ,("), pattern, "title", "venue"), lambda m: body(m, year)))


def title_first(c: Column) -> Column:
    """Title, venue, year, without a sentence's end or a name at the start"""

    def body(prefix, year):
        fits = lambda p: ~prefix.rlike(r"\.\s+[A-Z]") & (F.size(p) >= 2) & ~_person(F.get(p, 0))
        both = lambda p: _let(_title_and_venue(p), lambda r: F.when(r.isNotNull(), _cited(_nobody(), _unquoted(r["title"]), r["venue"], year)))
        return _let(_pieces(prefix, " ,.;"), lambda p: F.when(fits(p), both(p)))

    return _at_last_year(c["bare"], lambda before, year: _let(_without_metrics(_rtrim(before, " ,(")), lambda x: body(x, year)))


def before_comma(c: Column) -> Column:
    """What stands before the last comma ahead of the year, from a bracketed year on if it has one"""

    def body(head, year):
        title = _trim(F.regexp_replace(_trim(head, " ,;"), r"^.*?\(\d{4}\)[,.]?\s*", ""), " ,;")
        return _let(title, lambda t: F.when(F.length(t) > 15, _cited(_nobody(), t, _none(), year)))

    return _at_last_year(c["bare"], lambda before, year: _let(F.regexp_extract(_rtrim(before, " ,("), r"^(.*),", 1), lambda h: body(h, year)))


def before_in(c: Column) -> Column:
    """Title in venue year, without a comma"""
    fits = lambda x, m: m.isNotNull() & ~x.contains(",") & (F.length(x) > 20) & (F.length(m["title"]) > 10)
    body = lambda x, m, year: F.when(fits(x, m), _cited(_nobody(), _trim(m["title"]), _trim(m["venue"]), year))
    return _at_last_year(
        c["bare"], lambda before, year: _let(_rtrim(before, " ,("), lambda x: _let(_groups(x, r"^(.*) in (.*)$", "title", "venue"), lambda m: body(x, m, year)))
    )


def year_only(c: Column) -> Column:
    return _at_last_year(c["bare"], lambda before, year: _cited(_nobody(), _none(), _none(), year))


def plain(c: Column) -> Column:
    return _cited(_nobody(), _none(), _none(), F.lit(None))


#: Forms by name, in the order in which they are tried.
FORMS = (
    ("lines", lines),
    ("double", quoted('"“', '"”')),
    ("single", quoted("'‘", "'’")),
    ("cross", quoted("'\"‘“", "'\"’”", 16)),
    ("apa", apa),
    ("authors_first", authors_first),
    ("sentences", sentences),
    ("title_venue", title_venue),
    ("collapsed", collapsed),
    ("title_first", title_first),
    ("before_comma", before_comma),
    ("before_in", before_in),
    ("year", year_only),
    ("plain", plain),
)


def parse_citation(text: Column, forms=FORMS) -> Column:
    """Struct of form, raw_citation (one line, without a list's heading), authors, title, venue, year and citation_text (authors, year, title and venue
    joined; it begins with its point where no author was found).

    A form is a function of a struct of raw, text (raw_citation) and bare (that without its number), which returns a struct of authors, title, venue
    and year, or null where it doesn't apply. Years but those in brackets are from 2000 on. A null text gives null; an empty one the form `plain`. Texts are read whole."""
    head = rf"(?i)^(?:{'|'.join(HEADINGS)})"
    headless = lambda t: F.when(t.rlike(head), _trim(F.regexp_replace(t, head, ""), " :-")).otherwise(t)
    author = lambda a: _rtrim(_trim(F.regexp_replace(a, r"\s*\(\d{4}\)\s*\.?\s*$", "")), ".,;")

    def named(name, form, c):
        return _let(form(c), lambda v: F.when(v.isNotNull(), F.struct(F.lit(name).alias("form"), *(v[k].alias(k) for k in ("authors", "title", "venue", "year")))))

    def finish(c, v):
        authors = F.filter(F.transform(v["authors"], author), lambda a: a != "")
        line = lambda a: F.concat_ws(". ", F.array_join(a, ", "), F.concat(F.lit("("), v["year"], F.lit(")")), _given(v["title"]), _given(v["venue"]))
        whole = lambda a: F.struct(v["form"].alias("form"), c["text"].alias("raw_citation"), a.alias("authors"), v["title"].alias("title"), v["venue"].alias("venue"), v["year"].alias("year"), line(a).alias("citation_text"))
        return _let(authors, whole)

    def body(t):
        c = F.struct(text.alias("raw"), t.alias("text"), _trim(_unnumbered(t)).alias("bare"))
        return _let(c, lambda s: _let(F.coalesce(*(named(n, f, s) for n, f in forms)), lambda v: finish(s, v)))

    return F.when(text.isNotNull(), _let(headless(_spaced(text)), body))
