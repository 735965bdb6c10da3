"""DOI extraction and comparison keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import strip

#: The form of a DOI in running text, and what is trimmed off its end.
_DOI = r'10\.[0-9]{4,9}/[^\s"<>{}|\\^`]+'
_TAIL = ".,;:)]}\"'"


def extract_dois(text: Column) -> Column:
    """DOIs of free text in order, first of each (letter case aside)."""
    raw = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_DOI), F.lit(0))
    return distinct_dois(F.transform(raw, lambda d: F.rtrim(d, F.lit(_TAIL))))


def distinct_dois(dois: Column) -> Column:
    """Keeps the first of values equal but for letter case."""
    keys = F.transform(dois, F.lower)
    return F.filter(dois, lambda d, i: F.array_position(keys, F.lower(d)) == i + 1)


def doi_key(doi: Column) -> Column:
    return F.lower(strip(doi))


def matches_doi(own: Column, other: Column) -> Column:
    """Equality but for letter case and surrounding space; false where the own DOI is empty."""
    own = F.coalesce(own, F.lit(""))
    return (own != "") & (doi_key(own) == doi_key(F.coalesce(other, F.lit(""))))


def strip_doi_prefix(doi: Column) -> Column:
    return F.replace(F.replace(F.coalesce(doi, F.lit("")), F.lit("https://doi.org/"), F.lit("")), F.lit("http://doi.org/"), F.lit(""))
