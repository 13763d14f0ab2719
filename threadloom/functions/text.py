"""Column expressions over names, answers and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Words between white space; none for a null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def token_set(text: Column) -> Column:
    return F.sort_array(F.array_distinct(tokens(F.lower(text))))


def jaccard(a: Column, b: Column) -> Column:
    """Token-set similarity; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.greatest(F.size(F.array_union(a, b)), F.lit(1)))


def name_similarity(a: Column, b: Column) -> Column:
    """1 for equal names, 0.8 for containment, else overlap lifted by 0.2; case doesn't count."""
    a, b = F.lower(a), F.lower(b)
    j = jaccard(token_set(a), token_set(b))
    return F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), 0.8).when(j > 0, F.least(F.lit(1.0), j + 0.2)).otherwise(0.0)


def keywords(text: Column) -> Column:
    """Lower-cased word tokens of more than two letters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w+"), F.lit(0)), lambda x: F.length(x) > 2)


def key_list(text: Column) -> Column:
    """A comma-separated list, trimmed and lowered, without empty items."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")


def preview(text: Column, length: int = 100) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("..."))).otherwise(text)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def answer_normal(text: Column) -> Column:
    """Letters, digits and single spaces only, lowered."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")))


def is_numeric_answer(text: Column) -> Column:
    t = F.trim(text)
    return F.expr("false") | t.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$") | t.rlike(r"^\d+(\.\d+)?\s*\w*$")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\d+(?:\.\d+)?"), F.lit(0))


def answer_match(expected: Column, output: Column) -> Column:
    """Containment; else, for numeric answers, the first number; else normalised containment or a short word subset."""
    e, o = F.lower(F.trim(expected)), F.lower(F.trim(output))
    en, on = answer_normal(expected), answer_normal(output)
    words = F.split(en, " ")
    few = (F.size(words) <= 3) & (F.size(F.array_except(words, F.split(on, " "))) == 0)
    numeric = F.array_contains(numbers(o), F.regexp_extract(e, r"\d+(?:\.\d+)?", 0)) & (F.size(numbers(e)) > 0)
    return F.when(F.contains(o, e), True).when(is_numeric_answer(e), numeric).otherwise(F.contains(on, en) | few)


def contains_match(expected: Column, output: Column) -> Column:
    return F.contains(F.lower(F.trim(output)), F.lower(F.trim(expected)))


def origin_list(origin: Column) -> Column:
    """Session ids of a scalar, of a list written with commas or semicolons, or of a JSON array."""
    items = F.when(F.trim(origin).startswith("["), F.from_json(origin, "array<string>"))
    items = F.coalesce(items, F.split(F.coalesce(origin, F.lit("")), "[,;]"))
    return F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def evidence_sessions(evidence: Column, two_letters: bool = False) -> Column:
    """Session ids of evidence marks such as D10:3, distinct in order. two_letters: as far as two letters only."""
    marks = F.filter(evidence, lambda x: F.length(x) >= 2)
    return F.array_distinct(F.transform(marks, (lambda x: F.substring(x, 1, 2)) if two_letters else (lambda x: F.split(x, ":")[0])))


def token_estimate(text: Column) -> Column:
    """A quarter of the letters, one at least."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def json_in(text: Column) -> Column:
    """The JSON in a model's reply: a fenced block, else from the first to the last bracket, else brace."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    listed, braced = F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(*[F.expr("null") if x is None else F.when(F.trim(x) != "", F.trim(x)) for x in (fenced, listed, braced)])
