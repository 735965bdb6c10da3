"""Paper, journal and work views over the driver's tables.

The title of a paper is the whole text of its document.
``PAPERS`` and ``JOURNALS`` are SQL that Spark and DuckDB read alike; lists are
``; ``-separated texts there and arrays in the Spark views.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.issn import split_issns
from quire.schema import canonical


#: Labels, two numbers a row, are broadcast up to this many; a join by shuffle moves the whole text of every document.
LABELS = 2_000_000


def text(x: str) -> str:
    return f"CAST({x} AS VARCHAR(20))"


def issn(k: str) -> str:
    """An ISSN made from a number below 9000."""
    return f"(lpad({text(f'1000 + ({k})')}, 4, '0') || '-' || lpad({text(f'({k}) * 7 % 1000')}, 3, '0') || CASE WHEN ({k}) % 11 = 0 THEN 'X' ELSE {text(f'({k}) % 10')} END)"


_DOI = f"'10.' || {text('1000 + d.doc_id % 9')} || CASE WHEN d.doc_id % 5 = 0 THEN '/D' ELSE '/d' END || {text('d.doc_id % 900')}"
_ID = "d.doc_id"

PAPERS = f"""SELECT {_ID} AS _pos,
CASE WHEN {_ID} % 11 = 0 THEN '' ELSE {_DOI} END AS doi,
coalesce(d.text, '') AS title,
CASE {_ID} % 4 WHEN 0 THEN '' WHEN 1 THEN 'Brown, Carl' WHEN 2 THEN 'Dee Evans; Adams J.' ELSE 'Li; Brown, Carl; Dee Evans' END AS authors,
coalesce(d.source, '') AS journal,
CASE WHEN {_ID} % 7 = 0 THEN 'Press & Sons #1' ELSE '' END AS publisher,
CASE WHEN {_ID} % 37 = 0 THEN NULL ELSE CAST(2010 + {_ID} % 16 AS INTEGER) END AS year,
CASE WHEN {_ID} % 37 = 0 THEN '' ELSE {text(f'2010 + {_ID} % 16')} || '-' || lpad({text(f'1 + {_ID} % 12')}, 2, '0') || '-15' END AS pub_date,
CASE WHEN {_ID} % 2 = 0 THEN {text(f'{_ID} % 20')} ELSE '' END AS volume,
CASE WHEN {_ID} % 3 = 0 THEN {text(f'{_ID} % 6')} ELSE '' END AS issue,
CASE WHEN {_ID} % 10 = 0 THEN '' ELSE {text(f'{_ID} % 300')} END AS first_page,
CASE WHEN {_ID} % 13 = 0 THEN '' ELSE {text(f'{_ID} % 300 + {_ID} % 3')} END AS last_page,
CASE WHEN {_ID} % 4 = 0 THEN '' ELSE {issn(f'{_ID} % 260')} END AS issn_electronic,
CASE WHEN {_ID} % 3 = 0 THEN replace({issn(f'({_ID} + 50) % 260')}, '-', '') ELSE '' END AS issn_print,
CASE WHEN {_ID} % 5 = 1 THEN {issn(f'({_ID} * 3) % 260')} ELSE '' END AS issn_l,
CASE WHEN {_ID} % 6 = 1 THEN 'bad; ' || {issn(f'({_ID} * 5) % 260')} ELSE '' END AS issns,
coalesce(d.text, '') AS abstract,
CASE WHEN {_ID} % 13 = 0 THEN '' WHEN {_ID} % 17 = 0 THEN upper(d.lang) ELSE coalesce(d.lang, '') END AS language,
coalesce(d.n_chars, 0) % 100 AS cited_by_count,
{_ID} % 3 = 0 AS is_open_access,
CASE WHEN {_ID} % 6 = 0 THEN 'https://oa.example.org/' || {text(_ID)} ELSE '' END AS open_access_url,
CASE {_ID} % 9 WHEN 0 THEN 'Q1' WHEN 1 THEN ' q2' WHEN 2 THEN 'Q3' WHEN 3 THEN 'Q4' WHEN 4 THEN '-' WHEN 5 THEN 'Q9' WHEN 6 THEN 'q1' ELSE '' END AS quartile,
coalesce(l.quality, 0) = 1 AS scopus_indexed,
CASE WHEN {_ID} % 2 = 0 THEN 'deep learning; ' || coalesce(d.lang, '') ELSE '' END AS keywords,
'table' AS source,
'https://example.org/w/' || {text(_ID)} AS url
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""

JOURNALS = f"""SELECT s.s_suppkey AS _pos, s.s_name AS title,
{issn('s.s_suppkey % 150')} AS issn_electronic, {issn('(s.s_suppkey * 2) % 150')} AS issn_print,
CASE s.s_nationkey % 6 WHEN 0 THEN 'Q1' WHEN 1 THEN 'Q2' WHEN 2 THEN 'Q3' WHEN 3 THEN 'Q4' WHEN 4 THEN '-' ELSE '' END AS quartile,
CASE WHEN s.s_suppkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS open_access,
r.r_name AS area1, n.n_name AS area2
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """SQL over the driver's tables, without registering names in the session."""
    tables = sorted(set(re.findall(r"(?:FROM|JOIN) (\w+)", sql)))
    bound = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    if "labels" in bound and bound["labels"].count() <= LABELS:
        bound["labels"] = F.broadcast(bound["labels"])
    plain = sql.replace("{", "{{").replace("}", "}}")
    return spark.sql(re.sub(r"(FROM|JOIN) (\w+)", r"\1 {\2}", plain), **bound)


def _list(name: str):
    return F.filter(F.split(F.col(name), "; "), lambda x: x != "").alias(name)


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, PAPERS)
    lists = ("authors", "issns", "keywords")
    return canonical(rows.select(*[_list(c) if c in lists else F.col(c) for c in rows.columns]))


def journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, JOURNALS)
    return rows.select(
        F.col("_pos").cast("bigint").alias("_pos"),
        "title",
        split_issns(F.concat_ws(",", "issn_electronic", "issn_print")).alias("issns"),
        "quartile",
        "open_access",
        F.array("area1", "area2").alias("subject_areas"),
        F.array().cast("array<string>").alias("sub_categories"),
    )


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers in groups by ``source``; groups in order of their first paper."""
    rows = papers(spark, sf_dir)
    first = rows.groupBy(F.col("journal").alias("group")).agg(F.min("_pos").alias("group_pos"))
    return rows.withColumn("group", F.col("journal")).join(first, "group")


def inverted_index(text: Column) -> Column:
    """The words of a text between blanks, each with its positions, within the row: words are sorted and cut where the word changes."""
    word = lambda s, i: F.get(s, i)["w"]
    placed = F.sort_array(F.transform(F.split(text, " "), lambda w, i: F.struct(w.alias("w"), i.alias("i"))))

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (word(s, i) != word(s, i - 1)))
        return F.struct(s.alias("s"), starts.alias("at"), F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(s))).alias("to"))

    def entries(r: Column) -> Column:
        cut = lambda i, j: F.struct(word(r["s"], i).alias("w"), F.transform(F.sequence(i, j - 1), lambda k: F.get(r["s"], k)["i"]).alias("ats"))
        return F.map_from_entries(F.zip_with(r["at"], r["to"], cut))

    # the sorted words and their cuts are worked out once: they are values of lambda variables
    return F.get(F.transform(F.transform(F.array(placed), runs), entries), F.lit(0))


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers as works of the public JSON form."""
    rows = papers(spark, sf_dir)
    named = lambda c: F.struct(c.alias("display_name"))
    some = F.col("_pos") % 8
    return rows.select(
        "_pos",
        F.col("url").alias("id"),
        F.when(F.col("doi") != "", F.concat(F.lit("https://doi.org/"), "doi")).alias("doi"),
        "title",
        F.when(F.col("pub_date") != "", F.col("pub_date")).alias("publication_date"),
        F.transform("authors", lambda a: F.struct(named(a).alias("author"))).alias("authorships"),
        F.struct(
            F.struct(F.col("journal").alias("display_name"), F.concat("issns", F.array("issn_electronic", "issn_print")).alias("issn"), F.col("issn_l").alias("issn_l")).alias("source"),
            F.struct("volume", "issue", "first_page", "last_page").alias("biblio"),
        ).alias("primary_location"),
        inverted_index(F.col("abstract")).alias("abstract_inverted_index"),
        F.when(F.col("language") != "", F.col("language")).alias("language"),
        "cited_by_count",
        F.struct(F.col("is_open_access").alias("is_oa"), F.col("open_access_url").alias("oa_url"), F.when(F.col("is_open_access"), "gold").alias("oa_status")).alias("open_access"),
        F.array().cast("array<struct<display_name:string>>").alias("concepts"),
        F.transform(F.sequence(F.lit(0), some.cast("int")), lambda i: named(F.when(i % 3 == 1, F.lit("")).otherwise(F.concat(F.lit("topic "), i.cast("string"))))).alias("topics"),
        F.transform(F.sequence(F.lit(0), (some + 5).cast("int")), lambda i: named(F.when(i % 4 == 2, F.lit(None).cast("string")).otherwise(F.concat(F.lit("word "), i.cast("string"))))).alias("keywords"),
    )
