"""The paper and journal row types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: name, type, value where missing
PAPER_FIELDS = (
    ("doi", "string", ""),
    ("title", "string", ""),
    ("authors", "array<string>", None),
    ("journal", "string", ""),
    ("publisher", "string", ""),
    ("year", "int", None),
    ("pub_date", "string", ""),
    ("month", "string", ""),
    ("volume", "string", ""),
    ("issue", "string", ""),
    ("first_page", "string", ""),
    ("last_page", "string", ""),
    ("issn_electronic", "string", ""),
    ("issn_print", "string", ""),
    ("issn_l", "string", ""),
    ("issns", "array<string>", None),
    ("abstract", "string", ""),
    ("language", "string", "en"),
    ("cited_by_count", "bigint", 0),
    ("is_open_access", "boolean", False),
    ("open_access_url", "string", ""),
    ("open_access_status", "string", ""),
    ("quartile", "string", ""),
    ("scopus_indexed", "boolean", False),
    ("scopus_eid", "string", ""),
    ("subjects", "array<string>", None),
    ("keywords", "array<string>", None),
    ("source", "string", ""),
    ("url", "string", ""),
)

PAPER_DDL = ", ".join(f"{n} {t}" for n, t, _ in PAPER_FIELDS)

JOURNAL_FIELDS = "title string, issns array<string>, quartile string, open_access string, subject_areas array<string>, sub_categories array<string>"


def canonical(papers: DataFrame) -> DataFrame:
    """All paper columns with their defaults, and ``_pos`` (the place in the list).

    Unknown columns are dropped, missing ones filled; empty text stands for missing.
    """
    out = [F.col("_pos").cast("bigint").alias("_pos")]
    for name, kind, default in PAPER_FIELDS:
        if name not in papers.columns:
            value = F.array() if kind.startswith("array") else F.lit(default)
        elif kind.startswith("array"):
            value = F.coalesce(F.col(name).cast(kind), F.array().cast(kind))
        else:
            value = F.coalesce(F.col(name).cast(kind), F.lit(default)) if default is not None else F.col(name)
        out.append(value.cast(kind).alias(name))
    return papers.select(*out)
