"""Text and name functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def canonical(text: Column) -> Column:
    """Lower-case ASCII letters, digits and single spaces."""
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def person_name(name: Column) -> Column:
    """A directory name in plain order: "Last, First" turned, title, suffix and middle initials gone."""
    s = F.trim(name)
    s = F.trim(F.regexp_replace(s, r"^([^,]+),\s*([^,].*)$", "$2 $1"))
    s = F.regexp_replace(s, r"(?i)^(?:mrs|mr|ms|dr|prof)\.?\s+", "")
    s = F.regexp_replace(s, r"(?i)\s+(?:jr\.?|sr\.?|iii|ii|iv)$", "")
    s = F.regexp_replace(s, r"(?<=\w\w)\s+[A-Z]\.?\s+(?=\w\w)", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def comparison_name(name: Column) -> Column:
    """For agreement between analyzers: lower case, no title, single spaces."""
    s = F.regexp_replace(F.lower(name), r"^(?:mrs|mr|ms|dr|prof)\.?\s+", "")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def is_partial_name(a: Column, b: Column, least: int = 4) -> Column:
    """One is a single word of at least that length, and a word of the other, longer name."""
    x, y = F.split(F.lower(person_name(a)), " "), F.split(F.lower(person_name(b)), " ")
    part = lambda one, many: (F.size(one) == 1) & (F.size(many) > 1) & (F.length(one[0]) >= least) & F.array_contains(many, one[0])
    return part(x, y) | part(y, x)


def is_fuzzy_name(a: Column, b: Column, least: int = 4, ratio: float = 0.2) -> Column:
    """Edit distance within a fifth of the shorter name."""
    short = F.least(F.length(a), F.length(b))
    return (short >= least) & (F.levenshtein(F.lower(a), F.lower(b)) <= F.floor(short * F.lit(ratio)))


def name_score(name: Column) -> Column:
    """How fit a name is to stand for an entity."""
    points = lambda test, n: F.when(test, n).otherwise(0)
    return (
        points(name.contains(" "), 1000)
        + points(name.rlike(r"\p{Lu}"), 500)
        + points(name.rlike(r"^\p{Lu}"), 100)
        - points((name == F.upper(name)) & name.rlike(r"\p{L}"), 200)
        - points(name.contains("@"), 2000)
        - points(name.rlike(r"\p{Nd}"), 50)
        + F.length(name)
    )


def keywords(text: Column, least: int = 3) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= least))


def keyword_hits(words: Column, text: Column) -> Column:
    """How many of the words occur in the text, as substrings."""
    return F.size(F.filter(words, lambda w: F.lower(text).contains(w)))


def relationship_type(predicate: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(predicate)), r"\s+", "_")


def predicate_of(name: Column) -> Column:
    """A natural predicate for a relationship or property name."""
    spaced = F.lower(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"))
    return F.when(name.contains("_"), F.translate(F.lower(name), "_", " ")).otherwise(F.concat(F.lit("has "), spaced))


def atom(value: Column) -> Column:
    return F.concat(F.lit("'"), F.regexp_replace(F.lower(value), "[^a-z0-9_]", "_"), F.lit("'"))


KNOWN_PREDICATES = ("expert_in", "knows", "works_at", "lives_in", "owns", "friend_of", "colleague_of", "reports_to", "manages", "member_of", "created", "uses")


def fact_predicate(kind: Column) -> Column:
    """The fact predicate of an edge type, in any case style; unknown ones in snake case."""
    snake = F.lower(F.regexp_replace(kind, r"([a-z])([A-Z])", "$1_$2"))
    known = F.lower(kind)
    return F.when(known.isin(*KNOWN_PREDICATES), known).otherwise(snake)


def preview(text: Column, size: int = 100) -> Column:
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit("..."))).otherwise(text)


def simple_label(label: Column) -> Column:
    return F.substring_index(label, ".", -1)


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def age_in(text: Column) -> Column:
    """The number of years in phrases such as "5 years old" or "age 5"."""
    years = F.regexp_extract(F.lower(text), r"(\d+)[ -]*years?[ -]*old", 1)
    named = F.regexp_extract(F.lower(text), r"\bage[d:]?\s+(\d+)", 1)
    return F.coalesce(F.when(years != "", years), F.when(named != "", named)).try_cast("int")
