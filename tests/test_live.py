"""Live scans in slices and with an early end, against a service with filters and counts."""

import json
import threading
from datetime import date, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from pyspark.sql import functions as F

from quire.control.pool import MailtoPool
from quire.plans import pipelines
from quire.sources import remote, works


def _works():
    """900 works over four years, 300 of them on one day; journals of five ISSNs."""
    out = []
    for n in range(900):
        day = date(2020, 6, 1) if n % 3 == 0 else date(2019, 1, 1) + timedelta(days=(n * 37) % 1400)
        issn = f"1234-000{n % 5}"
        out.append({
            "id": f"W{n}", "doi": f"https://doi.org/10.5/{n}", "title": f"work {n}", "publication_date": day.isoformat(), "language": "en", "cited_by_count": n % 50,
            "abstract_inverted_index": {"word": [0]}, "primary_location": {"source": {"display_name": "j", "issn": [issn], "issn_l": issn}},
        })
    return out


class Catalogue(BaseHTTPRequestHandler):
    works, seen, failing = _works(), [], set()

    def log_message(self, *_):
        pass

    @staticmethod
    def _fits(w, term):
        name, _, value = term.partition(":")
        match name:
            case "from_publication_date":
                return w["publication_date"] >= value
            case "to_publication_date":
                return w["publication_date"] <= value
            case "cited_by_count":
                return w["cited_by_count"] > int(value[1:]) if value[0] == ">" else w["cited_by_count"] < int(value[1:])
        return True

    def do_GET(self):
        asked = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
        type(self).seen.append(asked)
        key = (asked["filter"], asked.get("cursor"))
        status = 500 if key in self.failing else 200
        self.failing.discard(key)
        found = [w for w in self.works if all(self._fits(w, t) for t in asked["filter"].split(","))]
        size, at = int(asked["per-page"]), int(asked.get("cursor", "*").strip("*") or 0)
        after = str(at + size) if at + size < len(found) else None
        raw = json.dumps({"results": found[at : at + size], "meta": {"count": len(found), "next_cursor": after}}).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)


@pytest.fixture
def catalogue():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Catalogue)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Catalogue.seen, Catalogue.failing = [], set()
    Catalogue.url = f"http://127.0.0.1:{server.server_port}"
    yield Catalogue
    server.shutdown()
    server.server_close()


def client(service):
    return remote.WorksClient(service.url, MailtoPool(["a@x"]), spacing=0, pause=lambda s: None)


def test_slices_hold_what_one_cursor_holds(spark, catalogue):
    rows = lambda df: sorted(r.doi for r in df.select("doi").collect())
    one = remote.live_works(spark, client(catalogue), works.Scan())
    assert one.count() == 900
    catalogue.seen.clear()
    cut = remote.live_works(spark, client(catalogue), works.Scan(), slice_rows=40)
    assert rows(cut) == rows(one)
    assert cut.select("_pos").distinct().count() == 900
    pages = [s["filter"] for s in catalogue.seen if s["per-page"] != "1"]
    hot = [f for f in pages if "cited_by_count" in f]
    assert len(pages) >= 900 / 40 and len(hot) >= 300 / 40 and all("2020-06-01" in f for f in hot)
    # years stay bounds, and a pushed filter counts in the slices too
    some = remote.live_works(spark, client(catalogue), works.Scan(year_from=2020, year_to=2020), slice_rows=40)
    assert rows(some) == sorted(w["doi"][16:] for w in catalogue.works if w["publication_date"].startswith("2020"))


def test_a_failed_slice_is_asked_again_alone(spark, catalogue):
    reader = works.WorksReader({"slice_rows": "100"}, works.Fetcher(client(catalogue).page, client(catalogue).count))
    parts = reader.partitions()
    assert len(parts) > 8 and len({p.value for p in parts}) == len(parts)
    whole = {p.value: [r[4] for r in reader.read(p)] for p in parts}
    assert sum(map(len, whole.values())) == 900 and max(map(len, whole.values())) <= 100
    catalogue.seen.clear()
    # one slice as another executor would take it up after a loss
    assert [r[4] for r in reader.read(parts[3])] == whole[3]
    terms = {s["filter"] for s in catalogue.seen}
    assert len(terms) == 1
    # the service failing once on one slice repeats that request only
    catalogue.failing.add((next(iter(terms)), "*"))
    catalogue.seen.clear()
    assert remote.live_works(spark, client(catalogue), works.Scan(), slice_rows=100).count() == 900
    pages = [(s["filter"], s["cursor"]) for s in catalogue.seen if s["per-page"] != "1"]
    assert len(pages) == len(set(pages)) + (next(iter(terms)) in dict(pages))


def test_slices_of_odd_ranges():
    days = [date(1850, 1, 1)] * 3 + [date(2020, 1, 1)] * 50 + [date(2150, 1, 1)]

    def count(terms):
        low = max((t[22:] for t in terms if t.startswith("from")), default="")
        high = min((t[20:] for t in terms if t.startswith("to_")), default="9999")
        cited = all(7 > int(t[16:]) if t[15] == ">" else 7 < int(t[16:]) for t in terms if t.startswith("cited"))
        return sum(low <= d.isoformat() <= high for d in days) * cited

    found = works.date_slices(count, None, None, 10)
    # a day that citations cannot part stays one slice
    assert sorted(map(count, found)) == [1, 3, 50]
    assert works.date_slices(lambda t: 0, None, None, 10) == []


@pytest.mark.parametrize("limit, most, pages, stats", [(30, 2000, 1, (147, 30, False)), (50, 2000, 2, (247, 50, False)), (0, 300, 2, (300, 60, True)), (500, 0, 5, (900, 180, False))])
def test_scan_ends_with_the_last_work_that_counts(spark, catalogue, limit, most, pages, stats):
    """As many pages as are needed to reach the limit or the cap, counters as of one pass."""
    issns = ["1234-0001", *(f"{n:04d}-9999" for n in range(150))]
    got = pipelines.search(remote.LiveWorks(spark, client(catalogue)), works.Scan(), issns=issns, limit=limit, max_scan=most)
    assert got.mode == "scan"
    assert [r.doi for r in got.papers.orderBy("_pos").collect()] == [f"10.5/{n}" for n in range(900) if n % 5 == 1 and n < (most or 900)][: limit or None]
    assert tuple(got.stats.first()) == stats
    assert len(catalogue.seen) == pages
    assert all("primary_location.source.has_issn:true" in s["filter"] for s in catalogue.seen)


def test_query_without_a_field_searches_everything(spark, catalogue):
    remote.live_works(spark, client(catalogue), works.Scan("deep nets", search_field=""), 3)
    assert catalogue.seen[0]["search"] == "deep nets" and "deep nets" not in catalogue.seen[0]["filter"]
    rows = spark.createDataFrame([(0, "10.1/a", "Deep things", "of nets", "en"), (1, "10.1/b", "Deep", "of sea", "en")], "_pos long, doi string, title string, abstract string, language string")
    assert [r._pos for r in works.scan_works(rows, works.Scan("deep nets", search_field="")).collect()] == [0]
    assert works.scan_works(rows, works.Scan("deep nets")).count() == 0


def test_two_scans_keep_their_own_clients(spark, catalogue):
    a, b = client(catalogue), client(catalogue)
    b.base_url += "/none"
    works.WorksDataSource.fetchers.clear()
    with pytest.raises(Exception, match="expected"):
        b.send = lambda url, headers: (_ for _ in ()).throw(ValueError("expected"))
        remote.live_works(spark, b, works.Scan())
    assert remote.live_works(spark, a, works.Scan(), 5).count() == 5
    assert works.WorksDataSource.fetchers == {}


def test_broken_lines_lose_no_other_line(spark, tmp_path):
    page = lambda *ids: json.dumps({"results": [{"id": i} for i in ids]})
    folder = tmp_path / "pages"
    folder.mkdir()
    (folder / "a.json").write_text("\n".join([page("w1"), '{"results": [{"id": "lost"', page("w2", "w3"), "", "no json", "{}", page("w4")]))
    (folder / "b.json").write_text(json.dumps({"results": [{"id": "w5"}, {"id": "w6"}]}, indent=1))
    (folder / "c.json").write_text("nothing here\nat all")
    (folder / "d.json").write_text('{"results": [\n{"id": "w7"},\n{"id": "w8"}\n]}')
    assert [r.id for r in works.read_works(spark, str(folder)).orderBy("_pos").collect()] == [f"w{n}" for n in range(1, 9)]
    assert [r._pos for r in works.read_works(spark, str(folder)).orderBy("_pos").select(F.col("_pos")).collect()] == list(range(8))
    got = sorted((r.file[-6:], r.line) for r in works.broken_lines(spark, str(folder)).collect())
    assert got == [("a.json", "no json"), ("a.json", '{"results": [{"id": "lost"'), ("c.json", "at all"), ("c.json", "nothing here")]
