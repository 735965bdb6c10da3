"""ISSN parsing: format only, ASCII digits, no check digit."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the format of an ISSN.
_ISSN = r"^([0-9]{4})-?([0-9]{3}[0-9Xx])$"


def normalize_issn(value: Column) -> Column:
    """``NNNN-NNNC``, or empty where ``value`` is no ISSN."""
    bare = F.regexp_replace(F.coalesce(value, F.lit("")), r"^\s+|\s+$", "")
    return F.when(bare.rlike(_ISSN), F.upper(F.regexp_replace(bare, _ISSN, "$1-$2"))).otherwise(F.lit(""))


def _valid(tokens: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(tokens, normalize_issn), lambda x: x != ""))


def split_issns(text: Column) -> Column:
    """Normalised ISSNs of free text, first occurrences in order."""
    return _valid(F.split(F.coalesce(text, F.lit("")), r"[,;|/\s]+"))


def split_issn_list(values: Column) -> Column:
    """The same for an array of free texts."""
    texts = F.coalesce(values, F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(texts, split_issns)))


def plain_issns(values: str | Iterable[str] | None) -> list[str]:
    """``split_issns`` for driver-side values."""
    if values is None:
        return []
    texts = [values] if isinstance(values, str) else [str(v) for v in values]
    found = (re.fullmatch(_ISSN, t) for text in texts for t in re.split(r"[,;|/\s]+", text))
    return list(dict.fromkeys(f"{m[1]}-{m[2].upper()}" for m in found if m))
