"""The four pipelines as DataFrame plans: search, filter, validate, export."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import dataclass, replace
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import collections as C
from quire.operators import dedup, journals
from quire.operators.rules import FilterEngine
from quire.sinks.formats import get_exporter
from quire.sinks.source import stream_parts, write_single, write_text
from quire.sources.works import Scan, scan_works, take_observed
from quire.tables import BROADCAST_ROWS, Scratch, materialise, new_path


#: ISSNs that are shipped to a live source as a set (a few megabytes); more are joined.
MOST_SHIPPED = 100_000


class NoResult(Exception):
    """Nothing matched (exit code 2 of a command)."""


@dataclass
class SearchResult:
    papers: DataFrame
    stats: DataFrame
    mode: str


def search(papers: DataFrame | Callable[[Scan, int], DataFrame], scan: Scan, journal_rows: DataFrame | None = None, issn_filter: journals.IssnFilter | None = None, issns: list[str] | None = None, limit: int = 0, max_scan: int = 2000, annotate: bool = True) -> SearchResult:
    """Scan, restrict to journals, annotate, limit.

    Explicit ISSNs win over the filter. Up to 100 ISSNs are a pushed list, more
    a local semi-join over at most ``max_scan`` scanned works. ``papers`` is a
    table of works, or a function of the scan and a bound on its rows (0: none),
    as for a live source, whose rows are taken as the source returns them; one
    with a method ``accepted`` (``remote.LiveWorks``) is given the ISSNs of a
    local semi-join and stops asking with the last work that counts.
    """
    read = papers if callable(papers) else lambda asked, _: scan_works(papers, asked)
    accept: Column | None = None
    mode, cap = "none", 0
    if issns:
        mode = journals.join_mode(len(issns))
        wanted = (SparkSession.active() if callable(papers) else papers.sparkSession).createDataFrame([(i, n) for n, i in enumerate(issns)], "issn string, _pos bigint")
    elif issn_filter is not None:
        wanted = materialise(issn_filter.build(journal_rows), "issns")
        n = wanted.count()
        if n == 0:
            raise NoResult("no journal matches the filter")
        mode = journals.join_mode(n)
        issns = [r["issn"] for r in wanted.orderBy("_pos").collect()] if mode == "server" else None
    if mode == "server":
        scanned = read(replace(scan, issns=tuple(issns)), limit)
    elif mode == "scan" and hasattr(papers, "accepted") and (small := wanted.limit(MOST_SHIPPED + 1).collect()) and len(small) <= MOST_SHIPPED:
        # the source itself ends the scan with the last work that counts
        cap = max_scan
        scanned = papers.accepted(replace(scan, has_issn=True), frozenset(r["issn"] for r in small), limit, cap)
        accept = F.col("_accepted")
    elif mode == "scan":
        cap = max_scan
        ahead = read(replace(scan, has_issn=True), cap)
        scanned = materialise(ahead.orderBy("_pos").limit(cap) if cap else ahead, "scanned")
        hits = journals.restrict_by_table(scanned, wanted).select(F.col("_pos").alias("_hit"))
        scanned = scanned.join(hits, F.col("_pos") == F.col("_hit"), "left")
        accept = F.col("_hit").isNotNull()
    else:
        scanned = read(scan, limit)
    # the counters come out of the pass that writes the result
    found, stats = take_observed(scanned, accept, limit, cap)
    found = found.drop("_hit", "_accepted")
    if annotate and journal_rows is not None:
        found = journals.annotate(found, journals.issn_index(journal_rows))
    return SearchResult(found, stats, mode)


@dataclass
class FilterResult:
    kept: DataFrame
    removed: DataFrame
    counts: DataFrame


def filter_papers(papers: DataFrame, engine: FilterEngine, index: DataFrame | None = None, annotate: bool = False, scopus_only: bool = False, deduplicate: bool = True, threshold: float = dedup.THRESHOLD, compose: bool = True, columns: tuple[str, ...] | None = None) -> FilterResult:
    """Annotate where needed, apply the rules in one pass, then remove duplicates among the kept.

    The papers are written once, with the verdict of the rules. Whether they are
    duplicates is joined to them by place where they are read: the fewer of kept
    and removed ones travel. Raises NoResult if nothing is kept.

    ``columns`` are those that kept and removed papers shall have beside ``_pos``
    (None: all). Of the others, only those that the next steps read are written,
    titles and DOIs of the papers that the rules keep.
    """
    if index is not None:
        papers = journals.annotate_if_needed(papers, index, annotate, scopus_only)
    marked, more = engine.mark(papers), []
    if columns is not None:
        compared = [c for c in ("doi", "title") if deduplicate and c not in columns]
        counted = [c for c in ("scopus_indexed",) if c not in columns]
        marked = marked.select("_pos", *(c for c in columns if c != "_pos"), *(F.when(F.col("_keep"), F.col(c)).alias(c) for c in compared), *counted, "_keep")
        more = compared + counted
    marked = materialise(marked, "marked")
    by_rules = marked.where("NOT _keep").drop("_keep", *more)
    if deduplicate:
        flags = dedup.duplicate_flags(marked.where("_keep"), ("_pos",), threshold, compose)
        unique, dups = flags.agg(F.count_if(~F.col("_dup")), F.count_if("_dup")).first()
        few = flags.where("_dup" if dups <= unique else "NOT _dup").select(F.col("_at._pos").alias("_few"))
        listed = F.col("_few").isNotNull()
        marked = marked.join(F.broadcast(few) if min(dups, unique) <= BROADCAST_ROWS else few, F.col("_pos") == F.col("_few"), "left")
        marked = marked.withColumn("_dup", F.col("_keep") & (listed if dups <= unique else ~listed)).drop("_few")
    else:
        marked = marked.withColumn("_dup", F.lit(False))
        unique = 0 if marked.where("_keep").isEmpty() else 1
    if not unique:
        raise NoResult("no paper passes the rules")
    kept = marked.where("_keep AND NOT _dup").drop("_keep", "_dup", *more)
    removed = C.union_removed(by_rules, marked.where("_dup").drop("_keep", "_dup", *more))
    return FilterResult(kept, removed, C.filter_counts(marked))


@dataclass
class ValidateResult:
    found: DataFrame
    errors: DataFrame
    counts: DataFrame


def validate(dois: DataFrame, papers: DataFrame, index: DataFrame | None = None) -> ValidateResult:
    """Look every DOI up, annotate what is found, list what is not."""
    works = journals.annotate(papers, index) if index is not None else papers
    found, errors = C.doi_enrich(dois, works)
    return ValidateResult(found, errors, C.validate_counts(dois, found))


def export(papers: DataFrame, format_name: str, path: str | Path, index: DataFrame | None = None, scopus_only: bool = False) -> dict:
    """Annotate, filter, write one file; returns the counts."""
    exporter = get_exporter(format_name)
    if index is not None:
        papers = journals.annotate(papers, index)
    if scopus_only:
        papers = papers.where("scopus_indexed")
    if papers.isEmpty():
        raise NoResult("nothing to export")
    target = exporter.export_to_file(papers, path)
    counts = papers.agg(F.count("*").alias("papers"), F.count_if("scopus_indexed").alias("scopus_indexed")).first().asDict()
    return counts | {"bytes": target.stat().st_size, "path": str(target)}


def _document(results: DataFrame, member: str, document: dict) -> tuple[DataFrame, str, str]:
    """Rows (_pos, text), and what stands before and after them in the JSON document."""
    fields = [c for c in results.columns if c != "_pos"]
    rows = results.select("_pos", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("text"))
    members = "".join(f"{json.dumps(k)}: {json.dumps(v, ensure_ascii=False, default=str)},\n" for k, v in document.items())
    return rows, "{\n" + members + json.dumps(member) + ": [\n", "\n]\n}\n"


def save_json(results: DataFrame, path: str | Path, member: str = "results", **document) -> Path:
    """A JSON document with ``document``'s members, then the rows in order of ``_pos``; tasks write the rows."""
    rows, head, tail = _document(results, member, document)
    return write_single(rows, Path(path), new_path(results.sparkSession, "parts"), separator=",\n", head=head, tail=tail)


def output_json(results: DataFrame, member: str = "results", **document) -> None:
    """The same document on standard output: tasks write the rows into the shared folder, from where the driver copies their text block by block."""
    rows, head, tail = _document(results, member, document)
    with Scratch() as scratch:
        parts = new_path(results.sparkSession, "parts")
        write_text(rows, parts, separator=",\n")
        sys.stdout.write(head)
        stream_parts(parts, sys.stdout, ",\n")
        sys.stdout.write(tail)
    scratch.drop(results.sparkSession)
