"""The journal dimension: ISSN index, lookups, annotation and ISSN subsets."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.issn import normalize_issn, plain_issns
from quire.functions.paper import is_valid_quartile
from quire.tables import counted, number_rows

#: A server-side filter takes at most this many values.
MAX_OR_VALUES = 100


def issn_index(journals: DataFrame) -> DataFrame:
    """One row per ISSN with the journal that lists it first: issn, _pos, title, quartile, open_access, areas."""
    listed = journals.select("*", F.posexplode("issns").alias("_at", "issn"))
    row = F.struct("_pos", "_at", "title", "quartile", "open_access", "subject_areas", "sub_categories")
    best = listed.groupBy("issn").agg(F.min_by(row, F.struct("_pos", "_at")).alias("j"))
    return best.select("issn", "j._pos", "j.title", "j.quartile", "j.open_access", "j.subject_areas", "j.sub_categories")


def lookup_issn(issns: DataFrame, index: DataFrame, column: str = "issn") -> DataFrame:
    """The rows of ``issns`` whose ISSN (any spelling) has a journal, with the journal."""
    asked = issns.withColumn("_issn", normalize_issn(F.col(column)))
    return asked.join(index.withColumnRenamed("issn", "_own"), F.col("_issn") == F.col("_own")).drop("_own", "_issn")


def issn_report(requests: DataFrame, index: DataFrame, column: str = "issn") -> DataFrame:
    """Every requested ISSN with found, scopus_indexed and the journal's fields (null where not found)."""
    asked = requests.select(F.col(column).alias("requested"), normalize_issn(F.col(column)).alias("issn"))
    hits = index.select(F.col("issn").alias("_own"), "title", "quartile", "open_access", "subject_areas")
    joined = asked.join(hits, F.col("issn") == F.col("_own"), "left")
    found = F.col("_own").isNotNull()
    return joined.select("requested", "issn", found.alias("found"), found.alias("scopus_indexed"), "title", "quartile", "open_access", "subject_areas")


def paper_issns() -> Column:
    """All ISSNs of a paper in the order they are tried."""
    listed = F.coalesce(F.col("issns"), F.array().cast("array<string>"))
    every = F.concat(listed, F.array("issn_l", "issn_electronic", "issn_print"))
    return F.array_distinct(F.filter(F.transform(every, normalize_issn), lambda x: x != ""))


def annotate(papers: DataFrame, index: DataFrame) -> DataFrame:
    """Sets ``scopus_indexed`` and ``quartile``.

    A paper with a valid quartile is indexed without a lookup. Otherwise the
    first of its ISSNs that the index knows decides: indexed, with the
    journal's quartile where it has one. Papers without a hit are not indexed.

    Only papers that need a lookup are exploded; the index is broadcast if it
    is small, and their hits come back by ``_pos``, which must be unique.
    """
    known = is_valid_quartile(F.col("quartile"))
    tries = papers.where(~known).select("_pos", F.posexplode(paper_issns()).alias("_at", "_issn"))
    journal = counted(index.select(F.col("issn").alias("_issn"), F.col("quartile").alias("_q")), "index")
    hits = tries.join(journal, "_issn").groupBy("_pos").agg(F.min_by("_q", "_at").alias("_q"))
    joined = papers.join(hits.select(F.col("_pos").alias("_own"), F.coalesce("_q", F.lit("")).alias("_q")), F.col("_pos") == F.col("_own"), "left")
    hit = F.col("_own").isNotNull()
    return (
        joined.withColumn("scopus_indexed", known | hit)
        .withColumn("quartile", F.when(~known & hit & (F.col("_q") != ""), F.col("_q")).otherwise(F.col("quartile")))
        .drop("_own", "_q")
    )


def annotate_if_needed(papers: DataFrame, index: DataFrame, force: bool, scopus_only: bool) -> DataFrame:
    """Annotates when asked to, or when only indexed papers are wanted and none is marked."""
    if force or scopus_only and papers.where("scopus_indexed").isEmpty():
        return annotate(papers, index)
    return papers


def annotate_stats(papers: DataFrame) -> DataFrame:
    ranked = F.upper(F.coalesce("quartile", F.lit(""))).isin("Q1", "Q2", "Q3", "Q4")
    return papers.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("scopus_indexed")).alias("scopus"),
        F.count_if(~F.col("scopus_indexed")).alias("non_scopus"),
        F.count_if(F.col("scopus_indexed") & ranked).alias("with_quartile"),
    )


def subject_match(areas: Column, exact: list[str], partial: list[str]) -> Column:
    """Any area equal to an exact term or containing a partial one (lower case)."""
    def hit(area: Column) -> Column:
        tests = [F.lower(area).isin(*exact)] if exact else []
        tests += [F.contains(F.lower(area), F.lit(t)) for t in partial]
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    return F.exists(F.coalesce(areas, F.array().cast("array<string>")), hit)


def quartile_match(quartile: Column, wanted: set[str], include_unranked: bool) -> Column:
    """Unknown quartiles pass only without a filter; unranked ones also need ``include_unranked``."""
    if wanted:
        ranked = quartile.isin(*sorted(wanted - {"-"})) if wanted - {"-"} else F.lit(False)
        return F.when(quartile == "", F.lit(False)).when(quartile == "-", F.lit(include_unranked and "-" in wanted)).otherwise(ranked)
    return F.when(quartile == "-", F.lit(include_unranked)).otherwise(F.lit(True))


@dataclass
class IssnFilter:
    """A subset of journals by subject and quartile, and the ISSNs in it."""

    subject_areas: set[str] = field(default_factory=set)
    quartiles: set[str] = field(default_factory=set)
    include_unranked: bool = True

    def terms(self, journals: DataFrame) -> tuple[list[str], list[str]]:
        """Terms that are areas, matched whole, and the others, matched as parts of areas."""
        terms = sorted({s.strip().lower() for s in self.subject_areas if s.strip()})
        if not terms:
            return [], []
        areas = journals.select(F.explode("subject_areas").alias("a")).select(F.lower("a").alias("a"))
        known = {r["a"] for r in areas.where(F.col("a").isin(*terms)).distinct().collect()}
        return [t for t in terms if t in known], [t for t in terms if t not in known]

    def _marked(self, journals: DataFrame) -> DataFrame:
        exact, partial = self.terms(journals)
        subject = subject_match(F.col("subject_areas"), exact, partial) if exact or partial else F.lit(True)
        wanted = {q.strip().upper() for q in self.quartiles if q.strip()}
        return journals.withColumn("_subject", subject).withColumn("_both", F.col("_subject") & quartile_match(F.coalesce("quartile", F.lit("")), wanted, self.include_unranked))

    def build(self, journals: DataFrame) -> DataFrame:
        """The ISSNs in the journals' order, first occurrences: issn, _pos (from 0)."""
        listed = self._marked(journals).where("_both").select(F.col("_pos").alias("_j"), F.posexplode("issns").alias("_at", "issn"))
        first = listed.groupBy("issn").agg(F.min(F.struct("_j", "_at")).alias("_first"))
        return number_rows(first.select("issn", F.col("_first").alias("_pos"))).select("issn", (F.col("_n") - 1).cast("bigint").alias("_pos"))

    def stats(self, journals: DataFrame) -> DataFrame:
        """One row: the funnel from all journals to distinct ISSNs, and the terms that are no area."""
        _, partial = self.terms(journals)
        n = F.size("issns")
        marked = self._marked(journals)
        funnel = marked.agg(
            F.count("*").alias("total_journals"),
            F.count_if("_subject").alias("after_subject_filter"),
            F.count_if("_both").alias("after_quartile_filter"),
            F.count_if(F.col("_both") & (n > 0)).alias("with_issn"),
        )
        unique = marked.where("_both").select(F.explode("issns").alias("i")).agg(F.count_distinct("i").alias("unique_issns"))
        rows = funnel.withColumn("unique_issns", F.lit(0)).unionByName(unique, allowMissingColumns=True)
        return rows.agg(*[F.sum(c).alias(c) for c in rows.columns]).withColumn("unmatched_subject_areas", F.lit(",".join(partial)))

    def describe(self, journals: DataFrame) -> dict:
        """What the filter says and yields; the names of keys and statistics are fixed values."""
        stats = self.stats(journals).first().asDict()
        stats["unmatched_subject_areas"] = [t for t in stats["unmatched_subject_areas"].split(",") if t]
        return {
            "subject_areas": sorted(self.subject_areas) or "(all)",
            "quartiles": sorted(self.quartiles) or "(all)",
            "include_unranked": self.include_unranked,
            "issn_count": stats["unique_issns"],
            "stats": stats,
        }


def batches(issns: DataFrame, size: int = MAX_OR_VALUES) -> DataFrame:
    """batch, issns: chunks of at most ``size`` in order."""
    chunk = F.floor(F.col("_pos") / size).cast("bigint").alias("batch")
    packed = issns.groupBy(chunk).agg(F.sort_array(F.collect_list(F.struct("_pos", "issn"))).alias("p"))
    return packed.select("batch", F.transform("p", lambda x: x["issn"]).alias("issns"))


def parse_quartiles(value: str | None) -> set[str]:
    """``all`` or nothing valid means no restriction."""
    parts = {q.strip().upper() for q in (value or "").split(",") if q.strip()}
    return set() if "ALL" in parts else parts & {"Q1", "Q2", "Q3", "Q4", "-"}


def parse_csv_set(value: str | None) -> set[str]:
    return {s.strip() for s in (value or "").split(",") if s.strip()}


def filter_from_defaults(use_issn_filter: bool, subject_areas: str = "", quartiles: str = "", include_unranked: bool = True) -> IssnFilter | None:
    """The filter that settings ask for, or None where it is off."""
    return IssnFilter(parse_csv_set(subject_areas), parse_quartiles(quartiles), include_unranked) if use_issn_filter else None


def list_subject_areas(journals: DataFrame) -> DataFrame:
    return journals.select(F.explode("subject_areas").alias("subject_area")).distinct().orderBy("subject_area")


def list_quartiles(journals: DataFrame) -> DataFrame:
    return journals.select("quartile").where("quartile <> ''").distinct().orderBy("quartile")


def join_mode(n_issns: int) -> str:
    """How a scan is restricted: not at all, by a pushed list, or by a local semi-join."""
    return "none" if n_issns == 0 else "server" if n_issns <= MAX_OR_VALUES else "scan"


def restrict_by_list(works: DataFrame, issns: list[str]) -> DataFrame:
    """Works whose journal has one of at most ``MAX_OR_VALUES`` ISSNs (pushed down as a list)."""
    wanted = plain_issns(issns)
    if len(wanted) > MAX_OR_VALUES:
        raise ValueError(f"at most {MAX_OR_VALUES} ISSNs go into one list, not {len(wanted)}")
    return works.where(F.arrays_overlap("issns", F.array(*map(F.lit, wanted)))) if wanted else works


def restrict_by_table(works: DataFrame, issns: DataFrame) -> DataFrame:
    """Works whose journal has an ISSN of the table: explode, semi-join, back by ``_pos``."""
    wanted = counted(issns.select(F.col("issn").alias("_issn")).distinct(), "issns")
    hits = works.select("_pos", F.explode("issns").alias("_issn")).join(wanted, "_issn", "left_semi").select("_pos").distinct()
    return works.join(hits, "_pos", "left_semi")
