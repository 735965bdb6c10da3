"""Works: normalisation of the public works JSON, the offline scan, point lookup and a live source.

The offline twin reads saved pages; its predicates are plain filters, which
Catalyst pushes into Parquet. The live source is a Python data source over a
page fetcher that the caller provides.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, InputPartition, LessThanOrEqual, SimpleDataSourceStreamReader

from quire.functions.doi import doi_key, strip_doi_prefix
from quire.functions.issn import plain_issns, split_issn_list, split_issns
from quire.functions.text import strip
from quire.schema import canonical
from quire.tables import counted, materialise

#: The fields of a work that are read.
WORK_FIELDS = ("id", "doi", "title", "publication_date", "authorships", "primary_location", "abstract_inverted_index", "language", "cited_by_count", "open_access", "concepts", "topics", "keywords")

WORK_DDL = """id string, doi string, title string, publication_date string,
authorships array<struct<author:struct<display_name:string>>>,
primary_location struct<source:struct<display_name:string,issn:array<string>,issn_l:string>,biblio:struct<volume:string,issue:string,first_page:string,last_page:string>>,
abstract_inverted_index map<string,array<int>>, language string, cited_by_count bigint,
open_access struct<is_oa:boolean,oa_url:string,oa_status:string>,
concepts array<struct<display_name:string>>, topics array<struct<display_name:string>>, keywords array<struct<display_name:string>>"""

#: Rows a page may hold.
PAGE_ROWS = 200


def reconstruct_abstract(inverted: Column) -> Column:
    """Words by position from a map of word to positions; ties in word order."""
    entry = lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("w")))
    # sort_array compares natively, array_sort by a function of its own
    words = F.sort_array(F.flatten(F.transform(F.map_entries(inverted), entry)))
    return F.coalesce(F.array_join(F.transform(words, lambda x: x["w"]), " "), F.lit(""))


def _filled(names: Column) -> Column:
    return F.coalesce(F.filter(names, lambda x: F.coalesce(x, F.lit("")) != ""), F.array().cast("array<string>"))


def authors_from_json(authorships: Column) -> Column:
    """Non-empty names in order."""
    return _filled(F.transform(authorships, lambda a: a["author"]["display_name"]))


def first_names(items: Column, n: int) -> Column:
    """The non-empty display names among the first ``n`` items."""
    return _filled(F.transform(F.slice(items, F.lit(1), F.lit(n)), lambda x: x["display_name"]))


def issns_from_json(source: Column) -> Column:
    """All ISSNs of a journal, the linking one last unless listed."""
    return F.array_distinct(F.concat(split_issn_list(source["issn"]), split_issns(source["issn_l"])))


def year_from_date(date: Column) -> Column:
    return F.substring(date, 1, 4).try_cast("int")


def normalize_work(works: DataFrame) -> DataFrame:
    """Works (``WORK_DDL`` and ``_pos``) to paper columns."""
    text = lambda c: F.coalesce(c, F.lit(""))
    loc, oa = F.col("primary_location"), F.col("open_access")
    issns = issns_from_json(loc["source"])
    linking = split_issns(loc["source"]["issn_l"])
    named = works.select(
        "_pos",
        strip_doi_prefix(F.col("doi")).alias("doi"),
        text(F.col("title")).alias("title"),
        authors_from_json(F.col("authorships")).alias("authors"),
        text(loc["source"]["display_name"]).alias("journal"),
        year_from_date(F.col("publication_date")).alias("year"),
        text(F.col("publication_date")).alias("pub_date"),
        *[text(loc["biblio"][f]).alias(f) for f in ("volume", "issue", "first_page", "last_page")],
        text(F.get(issns, F.lit(0))).alias("issn_electronic"),
        text(F.get(issns, F.lit(1))).alias("issn_print"),
        text(F.get(linking, F.lit(0))).alias("issn_l"),
        issns.alias("issns"),
        reconstruct_abstract(F.col("abstract_inverted_index")).alias("abstract"),
        F.when(text(F.col("language")) == "", F.lit("en")).otherwise(F.col("language")).alias("language"),
        F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"),
        F.coalesce(oa["is_oa"], F.lit(False)).alias("is_open_access"),
        text(oa["oa_url"]).alias("open_access_url"),
        text(oa["oa_status"]).alias("open_access_status"),
        first_names(F.col("topics"), 5).alias("subjects"),
        first_names(F.col("keywords"), 10).alias("keywords"),
        F.lit("openalex").alias("source"),
        text(F.col("id")).alias("url"),
    )
    return canonical(named)


@dataclass(frozen=True)
class Scan:
    """What a scan asks of the server."""

    query: str = ""
    year_from: int | None = None
    year_to: int | None = None
    language: str = "en"
    issns: tuple[str, ...] = ()
    has_issn: bool = False
    search_field: str = "abstract.search"

    def filters(self) -> list[str]:
        """The server's filter terms; commas inside values are dropped, as they part terms."""
        clean = lambda v: str(v).replace(",", " ")
        out = []
        if self.year_from or self.year_to:
            out += [f"from_publication_date:{self.year_from or 1900}-01-01", f"to_publication_date:{self.year_to or 9999}-12-31"]
        if self.language:
            out.append(f"language:{clean(self.language)}")
        out += ["has_doi:true", "has_abstract:true"]
        if self.issns:
            out.append("primary_location.source.issn:" + "|".join(map(clean, self.issns)))
        elif self.has_issn:
            out.append("primary_location.source.has_issn:true")
        if self.search_field and self.query:
            out.append(f"{self.search_field}:{clean(self.query)}")
        return out

    def search(self) -> str:
        """The full-text search of a query that names no field."""
        return "" if self.search_field else self.query

    def column(self) -> Column:
        """The same predicates over paper columns; a query asks for all its words in the abstract, without a field in title and abstract together."""
        words = self.query.lower().split()
        keep = F.col("doi") != ""
        if self.year_from or self.year_to:
            keep &= F.col("pub_date").between(f"{self.year_from or 1900:04d}-01-01", f"{self.year_to or 9999:04d}-12-31")
        if self.language:
            keep &= F.col("language") == self.language
        if self.issns:
            keep &= F.arrays_overlap("issns", F.array(*map(F.lit, self.issns)))
        elif self.has_issn:
            keep &= F.size("issns") > 0
        searched = F.lower("abstract") if self.search_field else F.lower(F.concat_ws(" ", "title", "abstract"))
        if not (words and self.search_field):
            keep &= F.col("abstract") != ""
        if words:
            # a lambda's value: an abstract that is put together from its words is so once, not once a word
            keep &= F.exists(F.array(searched), lambda t: reduce(Column.__and__, [F.contains(t, F.lit(w)) for w in words], t != ""))
        return F.coalesce(keep, F.lit(False))


def scan_works(papers: DataFrame, scan: Scan) -> DataFrame:
    """The works the server would return, in order of ``_pos`` once sorted."""
    return papers.where(scan.column())


def take_accepted(scanned: DataFrame, accept: Column | None = None, limit: int = 0, max_scan: int = 0) -> DataFrame:
    """The first ``limit`` accepted rows among the first ``max_scan`` scanned ones (0: no bound).

    A cap on scanned rows is a top-k by position, taken before acceptance.
    """
    rows = scanned.orderBy("_pos").limit(max_scan) if max_scan else scanned
    if accept is not None:
        rows = rows.where(accept)
    return rows.orderBy("_pos").limit(limit) if limit else rows


def _scanned(scanned: DataFrame, accept: Column | None, limit: int, max_scan: int) -> DataFrame:
    """The rows that a scan reads until it ends, with ``_ok`` for the accepted ones.

    A cap on rows, or a limit of a scan that accepts all, is a top-k by position
    (at most so many rows in one place); within it, running counts tell where
    the limit is reached. Without a cap, the limit-th accepted row tells the place.
    """
    marked = scanned.withColumn("_ok", F.lit(True) if accept is None else accept)
    most = min(filter(None, (max_scan, limit if accept is None else 0)), default=0)
    if most:
        top = marked.orderBy("_pos").limit(most)
        if not limit or accept is None:
            return top
        before = F.sum(F.col("_ok").cast("long")).over(Window.orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1))
        return top.withColumn("_before", F.coalesce(before, F.lit(0))).where(F.col("_before") < limit).drop("_before")
    if not limit:
        return marked
    place = marked.where("_ok").select("_pos").orderBy("_pos").limit(limit).agg(F.count("*").alias("n"), F.max("_pos").alias("p")).select(F.when(F.col("n") >= limit, F.col("p")))
    return marked.where(F.col("_pos") <= F.coalesce(place.scalar(), F.lit((1 << 63) - 1)))


def _capped(scanned: int | Column, matched: int | Column, limit: int, max_scan: int):
    """Whether ``max_scan`` ended the scan: as many rows were scanned, and the limit was not reached by then."""
    full = scanned >= max_scan if max_scan else F.lit(False) if isinstance(scanned, Column) else False
    return full & (matched < limit) if limit else full


def search_stats(scanned: DataFrame, accept: Column | None = None, limit: int = 0, max_scan: int = 0) -> DataFrame:
    """One row: scanned, matched, scan_capped; one query."""
    counts = _scanned(scanned, accept, limit, max_scan).agg(F.count("*").alias("scanned"), F.count_if("_ok").alias("matched"))
    return counts.withColumn("scan_capped", _capped(F.col("scanned"), F.col("matched"), limit, max_scan))


def take_observed(scanned: DataFrame, accept: Column | None = None, limit: int = 0, max_scan: int = 0) -> tuple[DataFrame, DataFrame]:
    """The rows of ``take_accepted``, written out, and the row of ``search_stats``: both from one pass."""
    seen = Observation()
    read = _scanned(scanned, accept, limit, max_scan).observe(seen, F.count(F.lit(1)).alias("scanned"), F.count_if(F.col("_ok")).alias("matched"))
    found = materialise(read.where("_ok").drop("_ok"), "found")
    n, k = seen.get["scanned"], seen.get["matched"]
    return found, scanned.sparkSession.createDataFrame([(n, k, bool(_capped(n, k, limit, max_scan)))], "scanned bigint, matched bigint, scan_capped boolean")


def lookup_doi(dois: DataFrame, papers: DataFrame, column: str = "doi") -> DataFrame:
    """Each requested DOI with the first work of that DOI (null columns where there is none, or no DOI is asked).

    Keys and places are matched first; only works that somebody asks for move,
    once. ``papers`` must name each work by its ``_pos``.
    """
    asked = dois.select("*", F.lower(strip(F.coalesce(F.col(column), F.lit("")))).alias("_asked"))
    wanted = asked.where(F.col("_asked").startswith("10.")).select(F.col("_asked").alias("_key")).distinct()
    known = papers.where(F.col("doi") != "").select(doi_key(F.col("doi")).alias("_key"), "_pos").join(wanted, "_key", "left_semi")
    first = counted(known.groupBy("_key").agg(F.min("_pos").alias("_first")), "first")
    placed = asked.join(first, F.col("_asked") == F.col("_key"), "left").drop("_asked", "_key")
    works = papers.select(F.struct(*papers.columns).alias("work")).join(first.select(F.col("_first").alias("_held")), F.col("work._pos") == F.col("_held"), "left_semi")
    return placed.join(works, F.col("_first") == F.col("work._pos"), "left").drop("_first")


def _saved_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of saved pages, written out: _file, _block, _doc (order in the block), results (null where the line is no page), _broken (a line that is no JSON)."""
    lines = spark.read.schema(f"results array<struct<{_struct_ddl()}>>, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    at = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_doc")]
    return materialise(lines.select(*at, "results", "_broken"), "lines")


def read_works(spark: SparkSession, path: str) -> DataFrame:
    """Saved result pages with ``results``: JSON documents one a line, or one a file however it is broken into lines.

    A file with a line that is a page is read by line, and lines that are none
    are left out (``broken_lines`` has them); only a file in which no line is a
    page is read as a whole. ``_pos`` numbers the works by file name, place in
    the file and place in the page.
    """
    by_line = _saved_lines(spark, path)
    lined = by_line.where("results IS NOT NULL")
    pages = lined.drop("_broken")
    others = by_line.select("_file").distinct().join(lined.select("_file").distinct(), "_file", "left_anti")
    if not others.isEmpty():
        no = F.lit(0).cast("long")
        whole = spark.read.schema(f"results array<struct<{_struct_ddl()}>>").option("multiLine", True).json(path).select(F.col("_metadata.file_path").alias("_file"), no.alias("_block"), no.alias("_doc"), "results")
        pages = pages.unionByName(whole.join(others, "_file", "left_semi"))
    sizes = materialise(pages.select("_file", "_block", "_doc", F.greatest(F.size("results"), F.lit(0)).alias("n")), "sizes")
    before = Window.unboundedPreceding, -1
    # one row a block of input
    blocks = sizes.groupBy("_file", "_block").agg(F.sum("n").alias("n")).select("_file", "_block", F.coalesce(F.sum("n").over(Window.orderBy("_file", "_block").rowsBetween(*before)), F.lit(0)).alias("_base"))
    within = sizes.select("_file", "_block", "_doc", F.coalesce(F.sum("n").over(Window.partitionBy("_file", "_block").orderBy("_doc").rowsBetween(*before)), F.lit(0)).alias("_skip"))
    starts = within.join(blocks, ["_file", "_block"]).select("_file", "_block", "_doc", (F.col("_base") + F.col("_skip")).alias("_start"))
    rows = pages.join(starts, ["_file", "_block", "_doc"]).select("_start", F.posexplode("results").alias("_at", "w"))
    return rows.select((F.col("_start") + F.col("_at")).cast("bigint").alias("_pos"), "w.*")


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): the lines of saved pages that are no JSON; all lines of a file that is no JSON as a whole either."""
    by_line = _saved_lines(spark, path)
    lined = by_line.where("results IS NOT NULL").select("_file").distinct()
    whole = spark.read.schema("_whole string, results string").option("columnNameOfCorruptRecord", "_whole").option("multiLine", True).json(path)
    files = materialise(whole.select(F.col("_metadata.file_path").alias("_file"), "_whole", "results"), "files")
    sound = files.where("_whole IS NULL").select("_file").distinct().join(lined, "_file", "left_anti")
    return by_line.where("_broken IS NOT NULL").join(sound, "_file", "left_anti").select(F.col("_file").alias("file"), F.col("_broken").alias("line"))


def _struct_ddl() -> str:
    from pyspark.sql.types import StructType

    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in StructType.fromDDL(WORK_DDL).fields)


@dataclass(frozen=True)
class Fetcher:
    """What a live scan asks: ``fetch(filters, cursor, per_page)`` returns (works as JSON strings, next cursor or None).

    ``count(filters)`` says how many works there are, which lets a scan be cut
    into slices; both take ``search`` by name where a query names no field.
    ``accept`` holds the ISSNs of journals whose works count as accepted.
    """

    fetch: Callable[..., tuple[list[str], str | None]]
    count: Callable[..., int] | None = None
    accept: frozenset[str] | None = None


class WorksDataSource(DataSource):
    """``spark.read.format("works")`` and ``readStream``: live scan through a registered page fetcher.

    ``register_fetcher(name, ...)`` makes a ``Fetcher`` available under
    ``option("fetcher", name)``. Paging by cursor is sequential; with a count
    and ``option("slice_rows", n)`` the scan is cut by date into slices of about
    n works, one partition and cursor each. ``max_scan`` bounds the scanned and
    ``limit`` the accepted works of a scan of one cursor, which asks for no page
    beyond. ``install(spark)`` registers the format and turns on the pushing of
    filters to Python sources.
    """

    fetchers: dict[str, Fetcher] = {}

    @classmethod
    def name(cls) -> str:
        return "works"

    @classmethod
    def install(cls, spark: SparkSession) -> None:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
        spark.dataSource.register(cls)

    @classmethod
    def register_fetcher(cls, name: str, fetch: Callable, count: Callable | None = None, accept: frozenset[str] | None = None) -> None:
        cls.fetchers[name] = Fetcher(fetch, count, accept)

    def schema(self) -> str:
        return "_pos bigint, publication_date string, language string, accepted boolean, work string"

    def reader(self, schema) -> DataSourceReader:
        return WorksReader(self.options, type(self).fetchers[self.options["fetcher"]])

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return WorksStreamReader(self.options, type(self).fetchers[self.options["fetcher"]])


def _scan_of(options) -> Scan:
    years = {k: int(options[k]) for k in ("year_from", "year_to") if options.get(k)}
    return Scan(query=options.get("query", ""), language=options.get("language", "en"), issns=tuple(filter(None, options.get("issns", "").split(","))), has_issn=options.get("has_issn", "") == "true", search_field=options.get("search_field", Scan.search_field), **years)


def work_issns(work: dict) -> set[str]:
    """The ISSNs of a work's journal."""
    source = (work.get("primary_location") or {}).get("source") or {}
    return set(plain_issns(",".join(filter(None, [*(source.get("issn") or []), source.get("issn_l")]))))


#: Dates between which a scan without years is cut; what lies outside is one slice at either end.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1), datetime.date(2100, 1, 1)


def date_slices(count: Callable[[list[str]], int], first: datetime.date | None, last: datetime.date | None, most: int) -> list[list[str]]:
    """Filter terms of slices that together hold every dated work once, of at most ``most`` works each.

    Ranges of days are halved while they hold more; a day that still does is
    halved by citations (works of one day and number of citations stay together).
    """
    low, high = first or FIRST_DAY, last or LAST_DAY
    days = lambda a, b: [f"from_publication_date:{a}", f"to_publication_date:{b}"]
    before, after = [f"to_publication_date:{low - datetime.timedelta(1)}"], [f"from_publication_date:{high + datetime.timedelta(1)}"]
    out = [before] if first is None and count(before) else []
    todo: list[tuple] = [(low, high)]
    while todo:
        a, b = todo.pop()
        n = count(days(a, b))
        if n > most and a < b:
            middle = a + (b - a) // 2
            todo += [(middle + datetime.timedelta(1), b), (a, middle)]
        elif n > most:
            out += _cited_slices(count, days(a, b), most)
        elif n:
            out.append(days(a, b))
    return out + ([after] if last is None and count(after) else [])


def _cited_slices(count: Callable[[list[str]], int], own: list[str], most: int) -> list[list[str]]:
    out: list[list[str]] = []
    todo: list[tuple[int, int | None]] = [(0, None)]
    while todo:
        low, end = todo.pop()
        terms = own + ([f"cited_by_count:>{low - 1}"] if low else []) + ([f"cited_by_count:<{end}"] if end else [])
        n = count(terms)
        if n > most and end is None:
            todo += [(2 * low + 1, None), (low, 2 * low + 1)]
        elif n > most and end - low > 1:
            todo += [((low + end) // 2, end), (low, (low + end) // 2)]
        elif n:
            out.append(terms)
    return out


class Slice(InputPartition):
    """A stretch of a scan with a cursor of its own; ``at`` is the ``_pos`` of its first work."""

    def __init__(self, number: int, terms: tuple[str, ...]):
        super().__init__(number)
        self.terms, self.at = terms, number << 40


def _terms(scan: Scan, more: Iterable[str]) -> list[str]:
    """The scan's filter terms, but for those that ``more`` states anew."""
    anew = {m.partition(":")[0] for m in more}
    return [f for f in scan.filters() if f.partition(":")[0] not in anew] + list(more)


def _searched(scan: Scan) -> dict[str, str]:
    return {"search": scan.search()} if scan.search() else {}


class WorksReader(DataSourceReader):
    def __init__(self, options, fetcher: Fetcher):
        self.scan, self.fetcher, self.pushed = _scan_of(options), fetcher if hasattr(fetcher, "fetch") else Fetcher(fetcher), []
        self.max_scan, self.limit, self.slice_rows = (int(options.get(k) or 0) for k in ("max_scan", "limit", "slice_rows"))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Language and date bounds go to the server; the rest stays with Spark."""
        for f in filters:
            match f:
                case EqualTo(("language",), value):
                    self.pushed.append(f"language:{value}")
                case GreaterThanOrEqual(("publication_date",), value):
                    self.pushed.append(f"from_publication_date:{value}")
                case LessThanOrEqual(("publication_date",), value):
                    self.pushed.append(f"to_publication_date:{value}")
                case _:
                    yield f

    def partitions(self):
        if not self.slice_rows or self.fetcher.count is None or self.max_scan or self.limit:
            return [Slice(0, tuple(self.pushed))]
        bound = lambda name: next((datetime.date.fromisoformat(t.partition(":")[2]) for t in reversed(_terms(self.scan, self.pushed)) if t.startswith(name)), None)
        other = tuple(p for p in self.pushed if "publication_date" not in p)
        count = lambda terms: self.fetcher.count(_terms(self._undated(), [*other, *terms]), **_searched(self.scan))
        slices = date_slices(count, bound("from_"), bound("to_"), self.slice_rows)
        return [Slice(n, (*other, *terms)) for n, terms in enumerate(slices)]

    def _undated(self) -> Scan:
        return replace(self.scan, year_from=None, year_to=None) if self.slice_rows else self.scan

    def read(self, partition):
        partition = partition or Slice(0, tuple(self.pushed))
        scan = self._undated() if partition.at or "publication_date" in "".join(partition.terms) else self.scan
        terms, cursor, scanned, matched = _terms(scan, partition.terms), "*", 0, 0
        while cursor:
            works, cursor = self.fetcher.fetch(terms, cursor, PAGE_ROWS, **_searched(scan))
            if not works:
                return
            for w in works:
                data = json.loads(w)
                accepted = self.fetcher.accept is None or not self.fetcher.accept.isdisjoint(work_issns(data))
                yield partition.at + scanned, data.get("publication_date"), data.get("language"), accepted, w
                scanned, matched = scanned + 1, matched + accepted
                if (self.limit and matched >= self.limit) or (self.max_scan and scanned >= self.max_scan):
                    return


class WorksStreamReader(SimpleDataSourceStreamReader):
    """A stream of works: the offset is the cursor, and the number of works before it.

    Pages land in ``option("landing", folder)`` before their works are handed on,
    a file a page under the hash of scan and cursor, so a batch that is run again
    after a restart reads what it read before and no page is asked for twice.
    ``pages`` pages (1) are read a batch. ``folder`` is a path or url that
    pyarrow's file systems reach. After the last page the stream rests.
    """

    def __init__(self, options, fetcher: Fetcher):
        self.scan, self.fetcher, self.pages = _scan_of(options), fetcher, int(options.get("pages") or 1)
        self.landing = options["landing"].rstrip("/")

    def initialOffset(self) -> dict:
        return {"cursor": "*", "at": 0}

    def _page(self, cursor: str) -> tuple[list[str], str | None]:
        from pyarrow import fs

        where, folder = fs.FileSystem.from_uri(self.landing) if "://" in self.landing else (fs.LocalFileSystem(), self.landing)
        name = hashlib.sha256(json.dumps([self.scan.filters(), self.scan.search(), cursor]).encode()).hexdigest()
        path = f"{folder}/{name}.json"
        if where.get_file_info(path).type == fs.FileType.File:
            with where.open_input_stream(path) as held:
                kept = json.loads(held.read())
            return kept["works"], kept["next"]
        works, after = self.fetcher.fetch(self.scan.filters(), cursor, PAGE_ROWS, **_searched(self.scan))
        where.create_dir(folder, recursive=True)
        part = f"{path}.{uuid.uuid4().hex}.part"
        with where.open_output_stream(part) as out:
            out.write(json.dumps({"works": works, "next": after if works else None}).encode())
        where.move(part, path)
        return works, after if works else None

    def _rows(self, works: list[str], at: int):
        for n, w in enumerate(works):
            data = json.loads(w)
            accepted = self.fetcher.accept is None or not self.fetcher.accept.isdisjoint(work_issns(data))
            yield at + n, data.get("publication_date"), data.get("language"), accepted, w

    def read(self, start: dict):
        rows, now = [], start
        for _ in range(self.pages):
            if now["cursor"] is None:
                break
            works, after = self._page(now["cursor"])
            rows += self._rows(works, now["at"])
            now = {"cursor": after, "at": now["at"] + len(works)}
        return iter(rows), now

    def readBetweenOffsets(self, start: dict, end: dict):
        now = start
        while now["cursor"] is not None and now["cursor"] != end["cursor"]:
            works, after = self._page(now["cursor"])
            yield from self._rows(works, now["at"])
            now = {"cursor": after, "at": now["at"] + len(works)}


def parse_works(lines: DataFrame, column: str = "work") -> DataFrame:
    """JSON strings to work columns."""
    return lines.select("_pos", F.from_json(column, WORK_DDL).alias("w")).select("_pos", "w.*")
