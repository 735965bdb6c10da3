"""Papers, groups and journals from JSON documents of several shapes.

Whole documents are parsed as VARIANT, so that keys which differ only in case
and values that are now a string, now an array, do no harm.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.issn import split_issns
from quire.functions.text import strip
from quire.schema import PAPER_DDL, canonical


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "json")


def read_papers_json(documents: DataFrame, column: str = "json") -> DataFrame:
    """Papers of a document: a list, or its ``results``, or its ``kept``, or all its list values; with ``_pos``."""
    paper = "array<variant>"
    doc = documents.select(column, F.parse_json(column).alias("v"))
    as_list = F.try_variant_get("v", "$", paper)
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    # a VARIANT keeps its keys sorted; the lists follow in the order of the text
    every = F.flatten(F.filter(F.transform(F.json_object_keys(column), lambda k: F.try_variant_get(F.element_at(fields, k), "$", paper)), lambda x: x.isNotNull()))
    items = doc.select(F.posexplode(F.coalesce(as_list, F.try_variant_get("v", "$.results", paper), F.try_variant_get("v", "$.kept", paper), every)).alias("_pos", "p"))
    return canonical(items.select("_pos", F.from_json(F.to_json("p"), PAPER_DDL).alias("p")).select("_pos", "p.*"))


def read_group_json(documents: DataFrame, column: str = "json") -> DataFrame:
    """Papers of a ``{group: [paper, ...]}`` document with ``group``, ``group_pos`` and ``_pos`` inside the group."""
    keys = F.json_object_keys(column)
    groups = documents.select(column, F.posexplode(keys).alias("group_pos", "group")).select("group", "group_pos", F.from_json(column, "map<string,string>")[F.col("group")].alias("g"))
    rows = groups.select("group", "group_pos", F.posexplode(F.from_json("g", f"array<struct<{_as_struct()}>>")).alias("_pos", "p"))
    return rows.select("group", "group_pos", F.col("_pos").cast("bigint").alias("_pos"), "p.*")


def _as_struct() -> str:
    return ",".join(f.replace(" ", ":", 1) for f in PAPER_DDL.split(", "))


def _text(v: Column, key: str) -> Column:
    """The value of a key as text; null where missing or empty."""
    return F.nullif(F.try_variant_get(v, f"$['{key}']", "string"), F.lit(""))


def _texts(v: Column, key: str) -> Column:
    """The value of a key as an array of trimmed texts, whether it is a text or a list; null where missing or empty."""
    listed = F.try_variant_get(v, f"$['{key}']", "array<string>")
    one = F.when(F.schema_of_variant(F.try_variant_get(v, f"$['{key}']", "variant")).startswith("ARRAY"), F.lit(None).cast("string")).otherwise(_text(v, key))
    many = F.filter(F.transform(listed, strip), lambda x: x != "")
    return F.coalesce(F.when(F.size(listed) > 0, many), F.when(one.isNotNull(), F.array(strip(one))))


def parse_journal(v: Column, area: Column) -> Column:
    """A journal (struct) from one VARIANT of any layout; ``area`` is the subject area where it names none."""
    keys = ("issn_electronic", "issn_print", "issn_l", "issn", "Issn")
    listed = [F.coalesce(F.array_join(F.try_variant_get(v, f"$.{k}", "array<string>"), ","), F.try_variant_get(v, f"$.{k}", "string")) for k in keys]
    nothing = F.array().cast("array<string>")
    default = F.when(F.coalesce(area, F.lit("")) != "", F.array(strip(area))).otherwise(nothing)
    return F.struct(
        strip(F.coalesce(_text(v, "journal"), _text(v, "title"), _text(v, "Title"), F.lit(""))).alias("title"),
        F.array_distinct(F.flatten(F.array(*map(split_issns, listed)))).alias("issns"),
        F.upper(strip(F.coalesce(_text(v, "quartile"), _text(v, "Quartile"), _text(v, "best_quartile"), F.lit("")))).alias("quartile"),
        strip(F.coalesce(_text(v, "open_access"), _text(v, "Open_Access"), F.lit(""))).alias("open_access"),
        F.coalesce(_texts(v, "subject_area"), _texts(v, "Subject Area"), default).alias("subject_areas"),
        F.coalesce(_texts(v, "sub_category"), nothing).alias("sub_categories"),
    )


def parse_journals(documents: DataFrame, column: str = "json") -> DataFrame:
    """Journals of a document: a list of objects, or lists by subject area; with ``_pos`` from 0."""
    doc = documents.select(column, F.parse_json(column).alias("v"))
    listed = F.transform(F.try_variant_get("v", "$", "array<variant>"), lambda j: F.struct(F.lit("").alias("area"), j.alias("j")))
    fields = F.try_variant_get("v", "$", "map<string,variant>")
    areas = F.transform(F.json_object_keys(column), lambda k: F.transform(F.try_variant_get(F.element_at(fields, k), "$", "array<variant>"), lambda j: F.struct(k.alias("area"), j.alias("j"))))
    by_area = F.flatten(F.filter(areas, lambda x: x.isNotNull()))
    rows = doc.select(F.posexplode(F.filter(F.coalesce(listed, by_area), lambda x: F.schema_of_variant(x["j"]).startswith("OBJECT"))).alias("_pos", "x"))
    return rows.select(F.col("_pos").cast("bigint").alias("_pos"), parse_journal(F.col("x.j"), F.col("x.area")).alias("j")).select("_pos", "j.*")


_loaded: dict[tuple, DataFrame] = {}


def read_journals(spark: SparkSession, path: str) -> DataFrame:
    """Journals of a JSON file, kept by (path, time, size) where it is a local file; one file at a time.

    Raises FileNotFoundError for a missing local file and ValueError for text that is no JSON.
    """
    local = Path(path.removeprefix("file://"))
    remote = "://" in path and not path.startswith("file://")
    if not remote and not local.is_file():
        raise FileNotFoundError(f"no journal file at {path}")
    key = (spark.sparkContext.applicationId, path) + (() if remote else (local.stat().st_mtime_ns, local.stat().st_size))
    if key not in _loaded:
        whole = _whole(spark, path)
        if whole.where(F.try_parse_json("json").isNull()).limit(1).count():
            raise ValueError(f"{path} is not valid JSON")
        for old in _loaded.values():
            old.unpersist()
        _loaded.clear()
        _loaded[key] = parse_journals(whole).cache()
    return _loaded[key]


def default_journal_path(folders: list[str]) -> str | None:
    """The first journal file in the given folders, newest name last."""
    for folder in folders:
        for name in ("scimagojr.json", "scimagojr_2025.json"):
            if (path := Path(folder) / name).is_file():
                return str(path)
    return None


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    return read_papers_json(_whole(spark, path))
