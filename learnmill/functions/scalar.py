"""Scalar functions as column expressions: all of them stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(c: str) -> Column:
    """Microseconds since 1970 of a timestamp column, by its wall clock."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast({c} as timestamp_ntz))")


def word_count(text: Column | str) -> Column:
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(F.trim(col(text)), r"\s+"), lambda w: w != "")), F.lit(0))


def slug(name: Column | str) -> Column:
    """Lower case, trimmed, line ends and spaces as underscores: one rule for nodes and edges."""
    return F.replace(F.replace(F.lower(F.trim(col(name))), F.lit("\n"), F.lit(" ")), F.lit(" "), F.lit("_"))


def concept_id(book: Column | str, name: Column | str) -> Column:
    return F.concat_ws("_", col(book), slug(name))


def safe_title(title: Column | str, size: int = 50) -> Column:
    """A title for file names: letters, digits, underscores, spaces and hyphens only, each stretch of
    white space as one underscore, cut."""
    kept = F.regexp_replace(col(title), r"(?U)[^\w\s-]", "")
    return F.substring(F.regexp_replace(kept, r"(?U)\s+", "_"), 1, size)


def truncate(text: Column | str, size: int, ellipsis: str = "...") -> Column:
    text = col(text)
    return F.when(F.length(text) > size, F.concat(F.substring(text, 1, size), F.lit(ellipsis))).otherwise(text)


def chapter_number(ident: Column | str) -> Column:
    """The number behind ``chapter`` in an id; 0 if there is none."""
    found = F.regexp_extract(F.lower(col(ident)), r"chapter(\d+)", 1)
    return F.when(found == "", F.lit(0)).otherwise(found.cast("int"))


#: Parts of a book id and the subject they stand for, the first that fits.
BOOK_SUBJECTS = (("government", "government"), ("biology", "biology"), (("math", "algebra"), "mathematics"))


def first_match(text: Column, rules, default: Column | None = None) -> Column:
    """The value of the first rule (parts, value) of which any part occurs in ``text``."""
    out = None
    for parts, value in rules:
        parts = (parts,) if isinstance(parts, str) else parts
        hit = F.lit(False)
        for p in parts:
            hit = hit | text.contains(p)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out if default is None else out.otherwise(default)


def book_subject(book: Column | str) -> Column:
    return first_match(F.lower(col(book)), BOOK_SUBJECTS, F.lit("general"))


def minutes_between(start: str, end: Column) -> Column:
    return (end - micros(start)) / F.lit(6e7)


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def same_answer(a: Column | str, b: Column | str) -> Column:
    return F.lower(F.trim(col(a))) == F.lower(F.trim(col(b)))


def dot(a: Column | str, b: Column | str) -> Column:
    """Dot product in double."""
    parts = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity; 0 where either vector is zero, null where either is null."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).when(n.isNotNull(), F.lit(0.0))


def vector_text(a: Column | str) -> Column:
    return F.to_json(col(a))


def text_vector(t: Column | str) -> Column:
    return F.from_json(col(t), "array<float>")
