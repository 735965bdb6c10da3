"""Computed columns of a paper: functions of one row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.doi import doi_key
from quire.functions.text import strip


def _bare(text: Column) -> Column:
    """Without commas and full stops at the end."""
    return F.rtrim(text, F.lit(",."))


def last_name(author: Column) -> Column:
    """Family name of ``First Last``, ``Last, First`` or ``Last F.``."""
    name = _bare(strip(F.coalesce(author, F.lit(""))))
    words = F.filter(F.split(name, r"\s+"), lambda w: w != "")
    end = _bare(F.get(words, F.size(words) - 1))
    spaced = F.when((F.length(end) == 1) & (F.size(words) > 1), _bare(F.get(words, F.size(words) - 2))).otherwise(end)
    return F.when(F.contains(name, F.lit(",")), _bare(strip(F.substring_index(name, ",", 1)))).otherwise(F.coalesce(spaced, F.lit("")))


def pages(first: Column, last: Column) -> Column:
    """``first--last`` where both are given and differ, else ``first``."""
    return F.when((first != "") & (last != "") & (first != last), F.concat(first, F.lit("--"), last)).otherwise(first)


def short_authors(authors: Column) -> Column:
    one, two = last_name(F.get(authors, F.lit(0))), last_name(F.get(authors, F.lit(1)))
    return F.when(F.size(authors) == 0, F.lit("Unknown")).when(F.size(authors) == 1, one).when(F.size(authors) == 2, F.concat(one, F.lit(" and "), two)).otherwise(F.concat(one, F.lit(" et al.")))


def citation_key(authors: Column, year: Column, pub_date: Column, doi: Column, index: Column) -> Column:
    """``<family name><year>_<first 5 of the DOI's MD5, or idx and the row's place>``."""
    letters = F.lower(F.regexp_replace(last_name(F.get(authors, F.lit(0))), "[^a-zA-Z]", ""))
    name = F.when(letters == "", F.lit("unknown")).otherwise(letters)
    known = F.when(F.coalesce(year, F.lit(0)) != 0, year.cast("string"))
    when = F.coalesce(known, F.when(pub_date != "", F.substring(pub_date, 1, 4)), F.lit("nodate"))
    key = doi_key(F.coalesce(doi, F.lit("")))
    mark = F.when(key != "", F.substring(F.md5(key), 1, 5)).otherwise(F.concat(F.lit("idx"), index.cast("string")))
    return F.concat(name, when, F.lit("_"), mark)


def is_valid_quartile(quartile: Column) -> Column:
    return F.upper(F.coalesce(quartile, F.lit(""))).isin("Q1", "Q2", "Q3", "Q4", "-")
