"""Small string helpers shared by the other function modules."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradeframe.constants import WHITESPACE


def strip(c: Column) -> Column:
    """Remove white space (every Unicode kind) at both ends; ``trim`` removes blanks only."""
    return F.btrim(c, F.lit(WHITESPACE))


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def matched(c: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null when there is none."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def last_matched(c: Column, pattern: str, group: int = 1) -> Column:
    """Last match of a group, null when there is none."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), F.lit(-1))


def remove(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, pattern, "")


def render(template: str, **values: Column) -> Column:
    """A template with named places filled by columns; a null counts as empty text."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts)


def ellipsize(c: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, the last three being dots."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 3), F.lit("..."))).otherwise(c)


def ellipsize_words(c: Column, limit: int = 120) -> Column:
    """Cut to ``limit`` characters, drop the last partial word, add dots."""
    head = F.substring(c, 1, limit)
    cut = F.when(head.contains(" "), F.regexp_replace(head, r"(?s) [^ ]*\z", "")).otherwise(head)
    return F.when(F.length(c) > limit, F.concat(cut, F.lit("..."))).otherwise(c)


def normalize_text(c: Column) -> Column:
    """Lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def slug(c: Column) -> Column:
    """Lower case, runs of other characters joined by a hyphen."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def short_name(c: Column) -> Column:
    """Model id without its owner: the part after the first slash."""
    return F.regexp_replace(c, "^[^/]*/", "")
