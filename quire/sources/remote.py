"""The works service over HTTP: result pages by cursor, one work by DOI, and answers kept as files."""

from __future__ import annotations

import hashlib
import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.control.pool import MailtoPool
from quire.control.requests import NotFound, Response, SourceError, rotating
from quire.functions.text import strip
from quire.sources.landing import FRESH_SECONDS, Landing
from quire.sources.works import WORK_FIELDS, Scan, WorksDataSource, normalize_work, parse_works
from quire.tables import materialise

#: Fixed value: the public service.
BASE_URL = "https://api.openalex.org"
#: Fixed value: how a DOI is named in a path of the service.
DOI_PATH = "/works/https://doi.org/"


@dataclass
class FileCache:
    """Answers as JSON files, one a request; ``folder`` must be reachable by all executors that fetch.

    Answers older than ``ttl`` seconds are asked for again; if the service then
    fails, the old answer stands in. Files appear whole, by renaming.
    """

    folder: str
    ttl: float = FRESH_SECONDS
    clock: Callable[[], float] = time.time

    def _path(self, key: str) -> Path:
        return Path(self.folder) / f"{hashlib.sha256(key.encode()).hexdigest()}.json"

    def get(self, key: str, stale: bool = False) -> Any:
        """The answer, or None; ``stale`` accepts any age. Unreadable files count as absent."""
        try:
            held = json.loads(self._path(key).read_text(encoding="utf-8"))
        except (OSError, ValueError):
            return None
        return held["body"] if stale or self.clock() - held["at"] < self.ttl else None

    def put(self, key: str, body: Any) -> None:
        path = self._path(key)
        path.parent.mkdir(parents=True, exist_ok=True)
        part = path.with_suffix(f".{uuid.uuid4().hex}.part")
        part.write_text(json.dumps({"at": self.clock(), "body": body}), encoding="utf-8")
        os.replace(part, path)

    def _files(self) -> list[Path]:
        return sorted(Path(self.folder).glob("*.json")) if Path(self.folder).is_dir() else []

    def stats(self) -> dict[str, int]:
        files = self._files()
        return {"entries": len(files), "bytes": sum(f.stat().st_size for f in files)}

    def clear(self) -> int:
        files = self._files()
        for f in files:
            f.unlink(missing_ok=True)
        return len(files)


def send(url: str, headers: dict[str, str], timeout: float = 30.0) -> Response:
    """One GET; error statuses are answers, lost connections raise ``OSError``."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers=headers), timeout=timeout) as got:
            raw = got.read()
            status = got.status
    except HTTPError as e:
        wait = (e.headers or {}).get("Retry-After", "")
        return Response(e.code, None, float(wait) if wait and wait.isdecimal() else None)
    try:
        return Response(status, json.loads(raw))
    except ValueError as e:
        raise SourceError(f"no JSON from the service: {e}") from e


@dataclass
class WorksClient:
    """Asks the service, under the pool's addresses in turn; ``send`` and ``pause`` are replaceable.

    ``spacing`` seconds pass between two result pages.
    """

    base_url: str = BASE_URL
    pool: MailtoPool = field(default_factory=MailtoPool)
    cache: FileCache | None = None
    spacing: float = 0.1
    send: Callable[[str, dict[str, str]], Response] = send
    pause: Callable[[float], None] = time.sleep

    def get(self, path: str, params: dict[str, str] | None = None) -> dict:
        from urllib.parse import urlencode

        key = f"{path}?{urlencode(sorted((params or {}).items()))}"
        if self.cache and (held := self.cache.get(key)) is not None:
            return held

        def one(mailto: str | None) -> Response:
            own = (params or {}) | ({"mailto": mailto} if mailto else {})
            agent = "quire" + (f" (mailto:{mailto})" if mailto else "")
            return self.send(self.base_url + path + (f"?{urlencode(own)}" if own else ""), {"User-Agent": agent, "Accept": "application/json"})

        try:
            body = rotating(self.pool, one, pause=self.pause)
        except NotFound:
            raise
        except SourceError:
            if self.cache and (held := self.cache.get(key, stale=True)) is not None:
                return held
            raise
        if self.cache:
            self.cache.put(key, body)
        return body

    def page(self, filters: list[str], cursor: str, per_page: int, search: str = "") -> tuple[list[str], str | None]:
        """One result page as JSON strings, and the cursor of the next one."""
        if cursor != "*":
            self.pause(self.spacing)
        whole = {"search": search} if search else {}
        got = self.get("/works", whole | {"filter": ",".join(filters), "per-page": str(per_page), "cursor": cursor, "select": ",".join(WORK_FIELDS)})
        return [json.dumps(w) for w in got.get("results") or []], (got.get("meta") or {}).get("next_cursor")

    def count(self, filters: list[str], search: str = "") -> int:
        """How many works the service has under these filters."""
        whole = {"search": search} if search else {}
        got = self.get("/works", whole | {"filter": ",".join(filters), "per-page": "1", "select": "id"})
        return int((got.get("meta") or {}).get("count") or 0)

    def work(self, doi: str) -> dict | None:
        """The work of a DOI, or None where there is none."""
        from urllib.parse import quote

        asked = doi.lower().strip()
        if not asked.startswith("10."):
            return None
        try:
            return self.get(DOI_PATH + quote(asked, safe="/"))
        except NotFound:
            return None


def _registered(spark: SparkSession, client: WorksClient, scan: Scan, accept: frozenset[str] | None = None) -> dict[str, str]:
    """Options of a scan through this client; every scan has a name of its own."""
    name = f"http-{uuid.uuid4().hex}"
    WorksDataSource.register_fetcher(name, client.page, client.count, accept)
    WorksDataSource.install(spark)
    given = {"query": scan.query, "year_from": scan.year_from or "", "year_to": scan.year_to or "", "language": scan.language, "issns": ",".join(scan.issns), "has_issn": str(scan.has_issn).lower(), "search_field": scan.search_field}
    return {"fetcher": name} | {k: str(v) for k, v in given.items()}


def _papers(read: DataFrame, *more: str) -> DataFrame:
    """Papers of a live read, with some of its own columns."""
    papers = normalize_work(parse_works(read))
    return papers.join(read.select("_pos", *more), "_pos") if more else papers


def live_works(spark: SparkSession, client: WorksClient, scan: Scan, max_scan: int = 0, slice_rows: int = 0) -> DataFrame:
    """Papers of a live scan, at most ``max_scan`` (0: all), written once so that no later step asks again.

    With ``slice_rows`` an unbounded scan is cut by publication date into slices
    of about that many works, which are read side by side; ``_pos`` then follows
    the slices. Works without a date are in no slice.
    """
    options = _registered(spark, client, scan)
    try:
        return materialise(_papers(spark.read.format("works").options(max_scan=str(max_scan), slice_rows=str(slice_rows), **options).load()), "live")
    finally:
        WorksDataSource.fetchers.pop(options["fetcher"], None)


def accepted_works(spark: SparkSession, client: WorksClient, scan: Scan, issns: frozenset[str], limit: int = 0, max_scan: int = 0) -> DataFrame:
    """Scanned papers with ``_accepted``: whether the journal is one of ``issns``; the scan ends with the ``limit``-th accepted or ``max_scan``-th work.

    The set goes to the reader, so no page is asked for beyond the one that
    holds the last work. Written once.
    """
    options = _registered(spark, client, scan, issns)
    try:
        read = materialise(spark.read.format("works").options(max_scan=str(max_scan), limit=str(limit), **options).load(), "scanned")
    finally:
        WorksDataSource.fetchers.pop(options["fetcher"], None)
    return _papers(read.withColumnRenamed("accepted", "_accepted"), "_accepted")


@dataclass
class LiveWorks:
    """A live source for ``pipelines.search``."""

    spark: SparkSession
    client: WorksClient
    slice_rows: int = 0

    def __call__(self, scan: Scan, max_scan: int = 0) -> DataFrame:
        return live_works(self.spark, self.client, scan, max_scan, self.slice_rows)

    def accepted(self, scan: Scan, issns: frozenset[str], limit: int, max_scan: int) -> DataFrame:
        return accepted_works(self.spark, self.client, scan, issns, limit, max_scan)


def works_stream(spark: SparkSession, client: WorksClient, scan: Scan, landing: str, pages: int = 1) -> DataFrame:
    """A stream of papers; ``landing`` is a folder that outlives the query (see ``WorksStreamReader``)."""
    read = spark.readStream.format("works").options(landing=landing, pages=str(pages), **_registered(spark, client, scan)).load()
    return normalize_work(parse_works(read))


def works_by_doi(dois: DataFrame, client: WorksClient, column: str = "doi", tasks: int = 1, landing: Landing | None = None) -> DataFrame:
    """The papers of a table's DOIs, each asked for once, by ``tasks`` tasks at a time; written once.

    Nulls, empty texts and what is no DOI are not asked for; unknown DOIs have no
    row. With ``landing`` only DOIs without a fresh answer are asked for, what is
    answered is added there, and older answers stand in where the service fails;
    it is an error only if there is none. Several tasks should share a
    ``SharedPool``.
    """
    asked = dois.select(F.lower(strip(F.coalesce(F.col(column), F.lit("")))).alias("asked")).where(F.col("asked").startswith("10.")).distinct()
    if landing is None:
        answers = materialise(asked.repartition(tasks, "asked").mapInArrow(_asking(client, False), _ANSWERS), "answers")
        return _answered(answers)
    known = materialise(landing.held(), "held")
    fresh = known.where(F.col("at") > F.lit(landing.clock() - landing.ttl))
    wanted = materialise(asked, "asked")
    answers = materialise(wanted.join(fresh, "asked", "left_anti").repartition(tasks, "asked").mapInArrow(_asking(client, True), _ANSWERS), "answers")
    told = answers.where("error IS NULL")
    if not told.isEmpty():
        landing.add(told)
    failed = answers.where("error IS NOT NULL").select("asked", "error")
    lost = failed.join(known, "asked", "left_anti").limit(1).collect()
    if lost:
        raise SourceError(f"{lost[0]['asked']}: {lost[0]['error']}")
    old = known.join(wanted, "asked", "left_semi").join(told, "asked", "left_anti")
    return _answered(told.select("asked", "work").unionByName(old.select("asked", "work")))


_ANSWERS = "asked string, work string, error string"


def _asking(client: WorksClient, keep_errors: bool):
    """Asks for the DOIs of a batch; a failure is kept as a row or ends the task."""

    def fetch(batches):
        import pyarrow as pa

        for batch in batches:
            rows = []
            for asked in batch.column(0).to_pylist():
                try:
                    found = client.work(asked)
                    rows.append((asked, None if found is None else json.dumps(found), None))
                except SourceError as e:
                    if not keep_errors:
                        raise
                    rows.append((asked, None, str(e) or type(e).__name__))
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["asked", "work", "error"])

    return fetch


def _answered(answers: DataFrame) -> DataFrame:
    """Answers to papers, written out."""
    works = answers.where("work IS NOT NULL").select(F.monotonically_increasing_id().alias("_pos"), "work")
    return materialise(normalize_work(parse_works(works)), "live")
