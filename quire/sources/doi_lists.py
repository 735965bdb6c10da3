"""DOI lists from running text, one-per-line files, BibTeX and comma-separated arguments."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.doi import distinct_dois, extract_dois
from quire.functions.text import parse_csv, strip


def read_doi_text(text: Column, suffix: str = ".txt") -> Column:
    """DOIs of a text. In plain lists without a recognisable DOI, each line that is no comment counts as one."""
    if suffix == ".md":
        raise ValueError("Markdown is not a list of DOIs; use plain text or BibTeX")
    found = extract_dois(text)
    if suffix not in (".txt", ".csv", ".tsv", ""):
        return found
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n"), strip), lambda x: (x != "") & ~x.startswith("#"))
    return F.when(F.size(found) > 0, found).otherwise(lines)


def dois_argument(value: Column) -> Column:
    return parse_csv(value)


def bib_entries(text: str) -> list[dict[str, str]]:
    """Fields (lower-case names) of the entries of a BibTeX text.

    Values are braced, quoted or bare. Raises ValueError where an entry never ends.
    """
    out = []
    at = 0
    while (m := re.compile(r"@\s*(\w+)\s*[{(]").search(text, at)) is not None:
        at = m.end()
        if m[1].lower() in ("comment", "preamble", "string"):
            continue
        fields: dict[str, str] = {}
        depth_end = _closing(text, m.end() - 1)
        body = text[m.end() : depth_end]
        k = body.find(",") + 1 or len(body)
        while (f := re.compile(r"\s*,?\s*([\w\-:.]+)\s*=\s*").match(body, k)) is not None:
            value, k = _value(body, f.end())
            fields.setdefault(f[1].lower(), "")
            fields[f[1].lower()] = fields[f[1].lower()] or value.strip()
        out.append(fields)
        at = depth_end + 1
    return out


def _closing(text: str, at: int) -> int:
    """Where the bracket that opens at ``at`` closes."""
    opened, closed = text[at], "}" if text[at] == "{" else ")"
    depth = 0
    for i in range(at, len(text)):
        if text[i] == "\\":
            continue
        if text[i] == opened:
            depth += 1
        elif text[i] == closed:
            depth -= 1
            if depth == 0:
                return i
    raise ValueError("an entry never ends")


def _value(body: str, at: int) -> tuple[str, int]:
    if at < len(body) and body[at] == "{":
        end = _closing(body, at)
        return body[at + 1 : end], end + 1
    if at < len(body) and body[at] == '"':
        end = body.find('"', at + 1)
        if end < 0:
            raise ValueError("a value never ends")
        return body[at + 1 : end], end + 1
    m = re.compile(r"[^,\s]*").match(body, at)
    return m[0], m.end()


def bib_dois(text: str) -> list[str] | None:
    """The DOIs of a BibTeX text in order, first of each (letter case aside); None if it cannot be parsed."""
    try:
        found = [e["doi"] for e in bib_entries(text) if e.get("doi")]
    except ValueError:
        return None
    first: dict[str, str] = {}
    for doi in found:
        first.setdefault(doi.lower(), doi)
    return list(first.values())


def read_bib_dois(texts: DataFrame, column: str = "text") -> DataFrame:
    """``texts`` with ``dois``: parsed entry by entry, or by the form of a DOI where parsing fails."""
    import pandas as pd

    def parse(values: pd.Series) -> pd.Series:
        return values.map(lambda t: bib_dois(t or ""))

    parse.__annotations__ = {"values": pd.Series, "return": pd.Series}
    parsed = F.pandas_udf(parse, "array<string>")(F.col(column))
    return texts.withColumn("_parsed", parsed).withColumn("dois", F.coalesce(distinct_dois(F.col("_parsed")), extract_dois(F.col(column)))).drop("_parsed")
