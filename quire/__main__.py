"""``python -m quire search|filter|validate|export|issn|config|cache``: the pipelines over files, or over the live service where no ``--works`` are given.

Exit codes: 0 done, 1 wrong input, 2 nothing found, 3 credentials refused, 4 too
many requests, 5 unreadable settings or journal data, 6 the service failed.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.control import names, settings
from quire.control.pool import MailtoPool
from quire.control.requests import RateLimited, SourceError, Unauthorised
from quire.functions.issn import plain_issns
from quire.functions.text import strip
from quire.operators import journals, rules
from quire.plans import pipelines
from quire.sources import doi_lists, documents, remote, works

OK, WRONG, NOTHING, UNREADABLE = 0, 1, 2, 5


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="quire")
    commands = parser.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        c = commands.add_parser(name)
        for flag in ("--journals", "--output", "--output-dir"):
            c.add_argument(flag)
        c.add_argument("--auto-name", action=argparse.BooleanOptionalAction, default=None)
        c.add_argument("--json", action="store_true")
        return c

    def source(c: argparse.ArgumentParser) -> None:
        c.add_argument("--works", help="folder or file of saved result pages; without it the service is asked")
        c.add_argument("--service", default=remote.BASE_URL)
        c.add_argument("--mailto", help="contact addresses, parted by commas")
        c.add_argument("--cache", help="folder for answers of the service")
        c.add_argument("--cache-ttl", type=float, default=remote.FRESH_SECONDS)

    c = command("search")
    c.add_argument("query")
    source(c)
    for flag in ("--year-from", "--year-to", "--limit", "--max-scan"):
        c.add_argument(flag, type=int)
    for flag in ("--issn", "--subject-areas", "--quartile"):
        c.add_argument(flag)
    c.add_argument("--issn-filter", action=argparse.BooleanOptionalAction, default=None)
    c.add_argument("--annotate", action=argparse.BooleanOptionalAction, default=True)

    c = command("filter")
    c.add_argument("input")
    for flag in ("--min-year", "--max-year", "--min-citations"):
        c.add_argument(flag, type=int)
    for flag in ("--quartile", "--exclude-keywords", "--include-keywords", "--language", "--exclude-dois", "--include-dois"):
        c.add_argument(flag)
    for flag in ("--scopus-only", "--open-access-only", "--annotate", "--dry-run"):
        c.add_argument(flag, action="store_true")
    c.add_argument("--include-unranked", action=argparse.BooleanOptionalAction, default=True)
    c.add_argument("--dedup", action=argparse.BooleanOptionalAction, default=True)
    c.add_argument("--threshold", type=float, default=0.92)

    c = command("validate")
    c.add_argument("--input")
    c.add_argument("--dois")
    source(c)

    c = command("export")
    c.add_argument("input")
    c.add_argument("--format", default="bibtex")
    c.add_argument("--scopus-only", action="store_true")
    c.add_argument("--annotate", action="store_true")

    c = command("issn")
    c.add_argument("issns", nargs="+")

    c = command("config")
    c.add_argument("--user")
    c.add_argument("--project")

    c = command("cache")
    c.add_argument("action", choices=("stats", "clear"))
    c.add_argument("--cache", required=True)
    return parser


def _place(path: str) -> str:
    """A url as it is, a local path made absolute (the JVM has a working folder of its own)."""
    if "://" in path:
        return path
    if not Path(path).exists():
        raise FileNotFoundError(f"no file at {path}")
    return str(Path(path).resolve())


def _client(args) -> remote.WorksClient:
    """The service under the given addresses, else those of the settings in the environment."""
    held = settings.resolve(environment=settings.read_environment())
    listed = (args.mailto or f"{held.mailto_pool},{held.mailto}").split(",")
    return remote.WorksClient(args.service, MailtoPool(listed, held.auto_rotate), remote.FileCache(str(Path(args.cache).resolve()), args.cache_ttl) if args.cache else None)


def _index(spark: SparkSession, args) -> DataFrame | None:
    return journals.issn_index(documents.read_journals(spark, _place(args.journals))) if args.journals else None


def _path(args, kind: str, **about) -> Path:
    return names.output_path(args.output, args.output_dir, "", names.auto_naming(args.auto_name), kind, **about)


def _done(args, counts: dict, path: Path | None = None) -> int:
    shown = counts | ({"saved_to": str(path)} if path else {})
    print(json.dumps(shown, ensure_ascii=False, default=str) if args.json else "  ".join(f"{k}: {v}" for k, v in shown.items()))
    return OK


def _search(spark: SparkSession, args) -> int:
    listed = None
    if args.issn:
        listed = plain_issns(args.issn)
        if not listed or any(t.strip() and not plain_issns(t) for t in args.issn.split(",")):
            print(f"not a list of ISSNs: {args.issn}", file=sys.stderr)
            return WRONG
    wanted = args.issn_filter if args.issn_filter is not None else bool(args.subject_areas or args.quartile)
    subset = None if listed or not args.journals else journals.filter_from_defaults(wanted, args.subject_areas or "", args.quartile or "")
    rows = documents.read_journals(spark, _place(args.journals)) if args.journals else None
    papers = works.normalize_work(works.read_works(spark, _place(args.works))) if args.works else remote.LiveWorks(spark, _client(args))
    found = pipelines.search(papers, works.Scan(args.query, args.year_from, args.year_to), rows, subset, listed, args.limit or 0, args.max_scan or 2000, args.annotate)
    if found.papers.isEmpty():
        return NOTHING
    path = pipelines.save_json(found.papers, _path(args, "search", query=args.query), query=args.query, errors=[])
    return _done(args, {"query": args.query, "count": found.papers.count(), "mode": found.mode} | found.stats.first().asDict(), path)


def _filter(spark: SparkSession, args) -> int:
    engine = rules.build_engine(
        min_year=args.min_year, max_year=args.max_year, min_citations=args.min_citations, scopus_only=args.scopus_only, quartile=args.quartile, include_unranked=args.include_unranked, exclude_keywords=args.exclude_keywords,
        include_keywords=args.include_keywords, open_access_only=args.open_access_only, language=args.language, exclude_dois=rules.split_csv(args.exclude_dois), include_dois=rules.split_csv(args.include_dois),
    )
    result = pipelines.filter_papers(documents.read_papers(spark, _place(args.input)), engine, _index(spark, args), args.annotate, args.scopus_only, args.dedup, args.threshold)
    path = None
    if not args.dry_run:
        removed = [json.loads(r["j"]) for r in result.removed.orderBy("_by", "_pos").limit(10).select(F.to_json(F.struct("doi", "title", "_by")).alias("j")).collect()]
        path = pipelines.save_json(result.kept, _path(args, "filter", input_path=Path(args.input)), "kept", input_file=args.input, removed_preview=removed, rules=engine.describe())
    return _done(args, result.counts.first().asDict(), path)


def _asked(spark: SparkSession, args) -> DataFrame:
    """The requested DOIs as a table (doi), in order of ``n``."""
    if args.dois:
        lists = spark.createDataFrame([(args.dois,)], "t string").select(doi_lists.dois_argument(F.col("t")).alias("d"))
    else:
        text = spark.read.text(_place(args.input), wholetext=True).withColumnRenamed("value", "text")
        suffix = Path(args.input).suffix.lower()
        lists = doi_lists.read_bib_dois(text).select(F.col("dois").alias("d")) if suffix == ".bib" else text.select(doi_lists.read_doi_text(F.col("text"), suffix).alias("d"))
    return lists.select(F.posexplode("d").alias("n", "doi")).select("n", strip(F.col("doi")).alias("doi"))


def _validate(spark: SparkSession, args) -> int:
    if not args.input and not args.dois:
        return WRONG
    asked = _asked(spark, args)
    if asked.isEmpty():
        return NOTHING
    papers = works.normalize_work(works.read_works(spark, _place(args.works))) if args.works else remote.works_by_doi(asked, _client(args))
    result = pipelines.validate(asked, papers, _index(spark, args))
    errors = [r.asDict() for r in result.errors.orderBy("n").select("doi", "error").toLocalIterator()]
    fields = [F.col(f"work.{c}").alias(c) for c in result.found.schema["work"].dataType.names if c != "_pos"]
    path = pipelines.save_json(result.found.select(F.col("n").alias("_pos"), *fields), _path(args, "validate"), errors=errors)
    return _done(args, result.counts.first().asDict(), path)


def _export(spark: SparkSession, args) -> int:
    path = _path(args, "export", input_path=Path(args.input), format=args.format)
    return _done(args, pipelines.export(documents.read_papers(spark, _place(args.input)), args.format, path, _index(spark, args) if args.annotate else None, args.scopus_only))


def _issn(spark: SparkSession, args) -> int:
    if any(not plain_issns(i) for i in args.issns) or not args.journals:
        return WRONG
    asked = spark.createDataFrame([(i,) for i in args.issns], "issn string")
    rows = [r.asDict() for r in journals.issn_report(asked, _index(spark, args)).collect()]
    _done(args, {"requested": len(rows), "found": sum(r["found"] for r in rows), "results": rows})
    return OK if any(r["found"] for r in rows) else NOTHING


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = _arguments().parse_args(argv)
    except SystemExit as e:
        return WRONG if e.code else OK
    if args.command == "config":
        got = settings.resolve(settings.read_toml(args.user) if args.user else {}, settings.read_yaml(args.project) if args.project else {}, settings.read_environment())
        return _done(args, dict(settings.rows(got)))
    if args.command == "cache":
        cache = remote.FileCache(args.cache)
        return _done(args, cache.stats() if args.action == "stats" else {"removed": cache.clear()})
    run = {"search": _search, "filter": _filter, "validate": _validate, "export": _export, "issn": _issn}[args.command]
    try:
        return run(spark or SparkSession.builder.getOrCreate(), args)
    except pipelines.NoResult as e:
        print(e, file=sys.stderr)
        return NOTHING
    except PySparkException as e:
        # an error of the service reaches the driver as text of the failed task
        kind = next((k for k in (Unauthorised, RateLimited, SourceError) if f"{k.__name__}: " in str(e)), None)
        if kind is None:
            raise
        print(f"the service failed: {kind.__name__}", file=sys.stderr)
        return kind.exit_code
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return UNREADABLE if getattr(args, "journals", None) else WRONG


if __name__ == "__main__":
    sys.exit(main())
