"""Text normalisation and slugs as Column expressions."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Texts that are composed at once.
_TEXTS = 100


def _compose(values: pa.Array) -> pa.Array:
    import unicodedata

    import pyarrow as pa

    # a few strings at a time, as a batch may hold thousands of long texts
    parts = []
    for lo in range(0, len(values), _TEXTS):
        texts = values.slice(lo, _TEXTS).to_pylist()
        parts.append(pa.array([None if x is None else unicodedata.normalize("NFKC", x) for x in texts], pa.string()))
    return pa.concat_arrays(parts) if parts else values.slice(0, 0).cast(pa.string())


def nfkc(text: Column) -> Column:
    """Compatibility composition. Spark has no built-in for it, so texts beyond ASCII,
    and only those, are sent to an Arrow UDF."""
    beyond = text.rlike(r"[^\x00-\x7F]")
    return F.coalesce(F.arrow_udf(_compose, "string")(F.when(beyond, text)), text)


def normalize_text(text: Column, compose: bool = True) -> Column:
    """Lower-case words of ``a-z0-9`` separated by single spaces; null becomes empty.

    Everything else, letters with accents included, separates words.
    """
    plain = F.coalesce(text, F.lit(""))
    return F.trim(F.regexp_replace(F.lower(nfkc(plain) if compose else plain), "[^a-z0-9]+", " "))


def normalize_plain(text: str) -> str:
    """``normalize_text`` for one driver-side string."""
    return re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKC", text or "").lower()).strip()


def truncate_ellipsis(text: Column, limit: int) -> Column:
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def slugify(text: Column, limit: int = 40, compose: bool = True) -> Column:
    """File-name slug: words joined by dashes, cut at the last dash before ``limit``; ``search`` if nothing is left."""
    plain = F.coalesce(text, F.lit(""))
    dashed = F.trim(F.regexp_replace(F.lower(nfkc(plain) if compose else plain), "[^a-z0-9]+", " "))
    dashed = F.replace(dashed, F.lit(" "), F.lit("-"))
    head = F.substring(dashed, 1, limit)
    whole_words = F.when(F.instr(head, "-") > 0, F.regexp_replace(head, "-[^-]*$", "")).otherwise(head)
    slug = F.when(F.length(dashed) > limit, F.regexp_replace(whole_words, "^-+|-+$", "")).otherwise(dashed)
    return F.when(slug == "", F.lit("search")).otherwise(slug)


def shingles(text: Column, size: int = 3) -> Column:
    """Distinct character shingles; empty for shorter texts.

    In texts of single-byte characters, which normalised ones are, a shingle is
    cut out by its place; elsewhere characters have to be counted up to it.
    """
    starts = F.sequence(F.lit(1), F.length(text) - (size - 1))
    raw = text.cast("binary")
    cut = F.when(F.octet_length(text) == F.length(text), F.transform(starts, lambda i: F.substring(raw, i, F.lit(size)).cast("string"))).otherwise(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))
    return F.when(F.length(text) >= size, F.array_distinct(cut)).otherwise(F.array().cast("array<string>"))


def parse_csv(text: Column) -> Column:
    """Trimmed, non-empty, comma-separated tokens."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), strip), lambda x: x != "")


def strip(text: Column) -> Column:
    """Removes white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")
