"""Groups, limits, counts and set operators over papers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.doi import doi_key
from quire.tables import materialise


def limit(papers: DataFrame, n: int) -> DataFrame:
    """The first ``n`` by position (0: all): a top-k, no full sort."""
    return papers.orderBy("_pos").limit(n) if n else papers


def removed_preview(removed: DataFrame, n: int = 10) -> DataFrame:
    return limit(removed, n)


def union_removed(by_rules: DataFrame, by_dedup: DataFrame) -> DataFrame:
    """Rule-removed papers, then duplicates; ``_by`` says which."""
    return by_rules.withColumn("_by", F.lit("rules")).unionByName(by_dedup.withColumn("_by", F.lit("dedup")))


def flatten_groups(papers: DataFrame) -> DataFrame:
    """Papers of groups as one list, in order of the groups; ``_pos`` is the place in it (from 0).

    Places come from the groups' sizes and, inside a group, from counts per range.
    """
    placed = materialise(papers.repartitionByRange("group_pos", "_pos").sortWithinPartitions("group_pos", "_pos").withColumn("_part", F.spark_partition_id()), "groups")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    bases = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy("group_pos", "_pos"))
    return placed.withColumn("_at", within).join(F.broadcast(bases), "_part").withColumn("_pos", (F.col("_base") + F.col("_at") - 1).cast("bigint")).drop("_part", "_base", "_at")


def group_total(papers: DataFrame) -> DataFrame:
    return papers.groupBy("group").agg(F.count("*").alias("n"))


def groups_to_json(papers: DataFrame, columns: list[str]) -> DataFrame:
    """One JSON array a group, in order; a group is one value of the result."""
    row = F.struct("_pos", F.struct(*columns).alias("p"))
    packed = papers.groupBy("group", "group_pos").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return packed.select("group", "group_pos", F.to_json(F.transform("rows", lambda r: r["p"]), {"ignoreNullFields": "false"}).alias("papers"))


def filter_counts(marked: DataFrame) -> DataFrame:
    """Counts of a filter run over ``_keep`` (rules) and ``_dup`` (duplicates among the kept)."""
    kept = F.col("_keep") & ~F.coalesce("_dup", F.lit(False))
    return marked.agg(
        F.count("*").alias("input_count"),
        F.count_if(kept).alias("kept"),
        F.count_if(~kept).alias("removed"),
        F.count_if(F.col("_keep") & F.coalesce("_dup", F.lit(False))).alias("dedup_removed"),
        F.count_if(kept & F.col("scopus_indexed")).alias("kept_indexed"),
    )


def export_counts(papers: DataFrame, text: DataFrame) -> DataFrame:
    """papers, scopus_indexed and the bytes of the exported text (line ends included)."""
    size = text.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0)).alias("bytes"))
    counts = papers.agg(F.count("*").alias("papers"), F.count_if("scopus_indexed").alias("scopus_indexed"))
    rows = counts.unionByName(size, allowMissingColumns=True)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("papers", "scopus_indexed", "bytes")])


def doi_enrich(dois: DataFrame, papers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, errors) for requested DOIs: the first work of each, or an error row ``not_found``."""
    from quire.sources.works import lookup_doi

    looked = lookup_doi(dois, papers)
    found = looked.where("work IS NOT NULL")
    errors = looked.where("work IS NULL").drop("work").withColumn("error", F.lit("not_found"))
    return found, errors


def validate_counts(dois: DataFrame, found: DataFrame) -> DataFrame:
    rows = dois.agg(F.count("*").alias("input_count")).unionByName(found.agg(F.count("*").alias("found"), F.count_if(F.col("work.scopus_indexed")).alias("scopus_count")), allowMissingColumns=True)
    return rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("input_count", "found", "scopus_count")])


def dedup_dois(values: DataFrame, column: str = "doi") -> DataFrame:
    """The first of DOIs equal but for letter case, in order of ``_pos``."""
    row = F.struct(*values.columns)
    return values.groupBy(F.lower(column).alias("_k")).agg(F.min_by(row, "_pos").alias("r")).select("r.*")


def intersect_dois(papers: DataFrame, others: DataFrame) -> DataFrame:
    """Papers whose DOI also occurs in ``others``."""
    keys = others.where("doi <> ''").select(doi_key(F.col("doi")).alias("_k")).distinct()
    return papers.where("doi <> ''").join(keys, doi_key(papers["doi"]) == F.col("_k"), "left_semi")


def except_dois(papers: DataFrame, others: DataFrame) -> DataFrame:
    """Papers without a DOI or whose DOI does not occur in ``others``."""
    keys = others.where("doi <> ''").select(doi_key(F.col("doi")).alias("_k")).distinct()
    return papers.join(keys, (papers["doi"] != "") & (doi_key(papers["doi"]) == F.col("_k")), "left_anti")


def results_table(papers: DataFrame) -> DataFrame:
    """The columns of the result table: number, year, flag, title, first author, cites."""
    from quire.functions.paper import short_authors
    from quire.sinks.formats import number_rows

    flag = F.concat(F.when(F.col("scopus_indexed"), "Y").otherwise("N"), F.when(F.col("scopus_indexed") & (F.col("quartile") != ""), F.concat(F.lit(" "), F.col("quartile"))).otherwise(F.lit("")))
    year = F.when(F.coalesce("year", F.lit(0)) != 0, F.col("year").cast("string")).otherwise(F.lit("?"))
    title = F.when(F.col("title") != "", F.col("title")).otherwise(F.lit("(no title)"))
    return number_rows(papers).select(F.col("_n").alias("n"), year.alias("year"), flag.alias("scopus"), F.substring(title, 1, 120).alias("title"), F.substring(short_authors(F.col("authors")), 1, 20).alias("first_author"), F.col("cited_by_count").alias("cites"))
