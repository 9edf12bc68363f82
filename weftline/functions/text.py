"""Scalar functions over strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.constants import STOPWORDS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compact_text(text: Column | str) -> Column:
    """Lower-case letters and digits alone."""
    return F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "")


def spaced_text(text: Column | str) -> Column:
    """Lower-case words of letters and digits, one blank between them."""
    return F.trim(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", " "))


def identifier_tokens(text: Column | str) -> Column:
    """Distinct lower-case parts of identifiers: whole runs of letters and digits first, then their humps and numbers."""
    runs = F.filter(F.split(col(text), "[^A-Za-z0-9]+"), lambda p: p != "")
    humps = lambda p: F.regexp_extract_all(p, F.lit(r"[A-Z]+(?=[A-Z][a-z]|\d|\b)|[A-Z]?[a-z]+|\d+"), F.lit(0))
    each = F.transform(runs, lambda p: F.concat(F.array(F.lower(p)), F.transform(humps(p), F.lower)))
    return F.array_distinct(F.flatten(each))


def strict_tokens(text: Column | str) -> Column:
    """Distinct lower-case runs of letters and digits of more than two characters, or `di`, without stop words."""
    runs = F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(runs, _telling))


def query_tokens(text: Column | str) -> Column:
    """strict_tokens and the parts of identifiers, under the same rule."""
    runs = F.regexp_extract_all(F.lower(col(text)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(F.concat(runs, identifier_tokens(text)), _telling))


def _telling(token: Column) -> Column:
    return ((F.length(token) > 2) | (token == "di")) & ~token.isin(*STOPWORDS)


def has_keyword(text: Column | str, tokens: Column | str, keyword: str) -> Column:
    """A phrase within the spaced text, or a word among the tokens."""
    return spaced_text(text).contains(keyword) if " " in keyword else F.array_contains(col(tokens), keyword)


def module_of_path(path: Column | str) -> Column:
    """The dotted module of a Python file: without the suffix and a last __init__."""
    dotted = F.translate(F.regexp_replace(col(path), r"\.py$", ""), "/", ".")
    return F.when(dotted == "__init__", "").otherwise(F.regexp_replace(dotted, r"\.__init__$", ""))


def snake(text: Column | str) -> Column:
    return F.translate(F.lower(col(text)), " -", "__")


def slug(text: Column | str) -> Column:
    """Lower case, other characters than letters and digits as single underscores, none at the ends; `item` for nothing."""
    s = F.regexp_replace(F.regexp_replace(F.lower(col(text)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", "item").otherwise(s)


def fold_path(path: Column | str) -> Column:
    """A path without `.` and with `..` folded into the part before it."""
    parts = F.filter(F.split(col(path), "/"), lambda p: (p != "") & (p != "."))
    empty = F.array().cast("array<string>")
    up = lambda a, p: F.when((p == "..") & (F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(F.array_append(a, p))
    return F.array_join(F.aggregate(parts, empty, lambda a, p: F.when(F.size(a) == 0, F.array(p)).otherwise(up(a, p))), "/")


def universal_lines(text: Column | str) -> Column:
    """Lines at any of the line ends that Python's splitlines knows; none after a last one."""
    ends = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"
    parts = F.split(col(text), ends, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
