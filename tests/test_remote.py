"""The live source against a small service on this machine."""

import json
import pickle
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, unquote, urlparse

import pytest
from pyspark.sql import functions as F
from test_sources_sinks import JOURNALS, WORK

from quire.__main__ import main
from quire.control.pool import MailtoPool, SharedPool
from quire.control.requests import RateLimited, Response, SourceError
from quire.sources import remote, works
from quire.sources.landing import Landing


class Service(BaseHTTPRequestHandler):
    """Three pages of two works; address ``tired@x`` is refused; ``seen`` keeps paths and parameters."""

    seen, broken = [], 0

    def log_message(self, *_):
        pass

    def do_GET(self):
        at = urlparse(self.path)
        asked = {k: v[0] for k, v in parse_qs(at.query).items()}
        type(self).seen.append((unquote(at.path), asked))
        if self.broken:
            return self.answer(self.broken, {})
        if asked.get("mailto") == "tired@x":
            return self.answer(429, {})
        if at.path != "/works":
            known = "10.1/a" in at.path
            return self.answer(200 if known else 404, WORK if known else {})
        page = int(asked["cursor"].strip("*") or 0)
        rows = [WORK | {"id": f"{page}-{k}", "doi": f"https://doi.org/10.5/{page}{k}"} for k in range(2)]
        self.answer(200, {"results": rows, "meta": {"next_cursor": str(page + 1) if page < 2 else None}})

    def answer(self, status, body):
        raw = json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(raw)))
        if status == 429:
            self.send_header("Retry-After", "7")
        self.end_headers()
        self.wfile.write(raw)


@pytest.fixture
def service():
    server = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    Service.seen, Service.broken = [], 0
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()
    server.server_close()


def client(service, *mailtos, cache=None):
    return remote.WorksClient(service, MailtoPool(mailtos), cache, spacing=0, pause=lambda s: None)


def test_live_scan(spark, service):
    got = remote.live_works(spark, client(service, "a@x"), works.Scan("nets", 2019, issns=("1111-1111",)))
    assert [r.doi for r in got.orderBy("_pos").collect()] == [f"10.5/{p}{k}" for p in range(3) for k in range(2)]
    got.count()
    assert len(Service.seen) == 3  # nothing is asked again
    asked = Service.seen[0][1]
    assert asked["filter"].endswith("primary_location.source.issn:1111-1111,abstract.search:nets") and asked["mailto"] == "a@x" and asked["per-page"] == "200"
    assert remote.live_works(spark, client(service), works.Scan("nets"), 3).count() == 3 and len(Service.seen) == 5


def test_rotation_and_errors(service):
    pool = client(service, "tired@x", "b@x")
    assert len(pool.page([], "*", 200)[0]) == 2 and [s[1]["mailto"] for s in Service.seen] == ["tired@x", "b@x"]
    assert pool.pool.stats()["tired@x"]["in_cooldown"] and pickle.loads(pickle.dumps(pool.pool)).mailtos == ["tired@x", "b@x"]
    with pytest.raises(RateLimited) as refused:
        client(service, "tired@x").page([], "*", 200)
    assert refused.value.retry_after == 7
    assert client(service).work("10.9/none") is None and client(service).work("nothing") is None and client(service).work(" 10.1/A ")["doi"] == WORK["doi"]
    text = remote.WorksClient(send=lambda url, headers: Response(200, {"results": None}))
    assert text.page([], "*", 200) == ([], None)


def test_cache(service, tmp_path):
    now = [1000.0]
    cache = remote.FileCache(str(tmp_path / "kept"), 60, lambda: now[0])
    assert cache.stats() == {"entries": 0, "bytes": 0} and cache.clear() == 0
    ask = client(service, "a@x", "b@x", cache=cache)
    first = ask.page([], "*", 200)
    assert ask.page([], "*", 200) == first and len(Service.seen) == 1  # whichever address asks
    now[0] += 61
    assert ask.page([], "*", 200) == first and len(Service.seen) == 2
    now[0] += 61
    Service.broken = 500
    assert ask.page([], "*", 200) == first  # the old answer stands in
    with pytest.raises(SourceError):
        ask.page([], "1", 200)
    Service.broken = 0
    assert ask.work("10.9/none") is None and cache.stats()["entries"] == 1
    next((tmp_path / "kept").glob("*.json")).write_text("{broken")
    assert ask.page([], "*", 200) == first
    assert cache.clear() == 1


def test_works_by_doi(spark, service):
    dois = spark.createDataFrame([(" 10.1/A",), ("10.1/a",), ("10.9/none",), ("x",), ("",), (None,)], "doi string")
    got = remote.works_by_doi(dois, client(service))
    assert [r.doi for r in got.collect()] == ["10.1/A"]
    assert sorted(s[0] for s in Service.seen) == ["/works/https://doi.org/10.1/a", "/works/https://doi.org/10.9/none"]
    assert remote.works_by_doi(dois.limit(0), client(service), tasks=3).count() == 0


def test_commands(spark, service, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    (tmp_path / "j.json").write_text(json.dumps(JOURNALS))
    said = lambda: json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    live = ["--service", service, "--cache", "kept", "--json"]
    assert main(["search", "any words", *live, "--limit", "3", "--journals", "j.json"], spark) == 0
    assert (said()["count"], len(json.loads((tmp_path / "search_results.json").read_text())["results"])) == (3, 3)
    assert main(["validate", "--dois", "10.1/a,10.9/none", *live], spark) == 0 and said()["found"] == 1
    assert main(["cache", "stats", "--cache", "kept", "--json"], spark) == 0 and said()["entries"] == 3
    assert main(["cache", "clear", "--cache", "kept", "--json"], spark) == 0 and said()["removed"] == 3
    Service.broken = 401
    assert main(["search", "any words", *live], spark) == 3


def test_landing_table(spark, service, tmp_path):
    now = [1000.0]
    landing = Landing(spark, str(tmp_path / "landing"), 60, lambda: now[0])
    dois = spark.createDataFrame([("10.1/A",), ("10.1/a",), ("10.9/none",), ("x",), (None,)], "doi string")
    asked = lambda rows=dois, tasks=2: sorted(r.doi for r in remote.works_by_doi(rows, client(service), tasks=tasks, landing=landing).collect())
    assert asked() == ["10.1/A"] and len(Service.seen) == 2
    assert asked() == ["10.1/A"] and len(Service.seen) == 2  # the second run asks nothing, not even for what is unknown
    more = dois.union(spark.createDataFrame([("10.1/a2",)], "doi string"))
    assert asked(more) == ["10.1/A", "10.1/A"] and len(Service.seen) == 3  # only what is new (the service knows one work)
    assert Landing(spark, landing.folder, 60, landing.clock).held().count() == 3
    now[0] += 61
    Service.broken = 500
    assert asked(more) == ["10.1/A", "10.1/A"]  # old answers stand in
    with pytest.raises(SourceError, match="10.1/b"):
        asked(spark.createDataFrame([("10.1/b",)], "doi string"))
    Service.broken = 0
    seen = len(Service.seen)
    assert asked() == ["10.1/A"] and len(Service.seen) == seen + 2
    assert landing.compact() == 3 and landing.batches()[1:] == [] and landing.held().count() == 3 and landing.fresh().count() == 2
    assert asked() == ["10.1/A"] and len(Service.seen) == seen + 2


def test_a_refused_address_rests_for_all_tasks(spark, service, tmp_path):
    pool = SharedPool(["tired@x", "b@x", "c@x"], str(tmp_path / "rests"), cooldown_seconds=30)
    ask = remote.WorksClient(service, pool, None, spacing=0, pause=lambda s: None)
    dois = spark.range(40).select(F.concat(F.lit("10.1/a"), F.col("id").cast("string")).alias("doi"))
    # one task learns of it first
    assert ask.work("10.1/a") is not None
    before = len(Service.seen)
    assert remote.works_by_doi(dois, ask, tasks=4).count() == 40
    used = [s[1].get("mailto") for s in Service.seen[before:]]
    assert len(used) == 40 and "tired@x" not in used and {"b@x", "c@x"} == set(used)


def test_all_addresses_at_rest_are_waited_for(tmp_path):
    now, waited = [100.0], []

    def pause(seconds):
        waited.append(seconds)
        now[0] += seconds

    one, two = (SharedPool(["a@x", "b@x"], str(tmp_path), 50, lambda: now[0], pause) for _ in range(2))
    one.mark_rate_limited("a@x")
    two.mark_rate_limited("b@x", 20)
    assert one.next() == "b@x" and waited == [20] and two.next() == "b@x"
    one.mark_ok("a@x")
    assert one.stats()["a@x"]["in_cooldown"]
    assert SharedPool([], str(tmp_path)).next() is None
    now[0] = 151.0
    assert two.next() == "a@x"
