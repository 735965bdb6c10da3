"""Streaming extras: the rules and DOI dedup over a stream of papers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.doi import doi_key
from quire.operators.rules import FilterEngine


def filter_stream(papers: DataFrame, engine: FilterEngine) -> DataFrame:
    """Stateless: rules are plain predicates."""
    return papers.where(engine.column())


def first_dois(papers: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """The first arrival of each DOI within the watermark; papers without a DOI pass.

    State is one key a DOI, dropped once the watermark has passed it.
    """
    keyed = papers.withColumn("_key", F.when(F.coalesce("doi", F.lit("")) != "", doi_key(F.col("doi"))).otherwise(F.concat(F.lit("no doi "), F.col("_pos").cast("string"))))
    return keyed.withWatermark(time, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def arrivals(papers: DataFrame, time: str, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Papers and indexed papers by window of arrival."""
    return papers.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("papers"), F.count_if("scopus_indexed").alias("scopus_indexed"))
