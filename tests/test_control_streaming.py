import datetime
from pathlib import Path

import pytest

from quire.control import names, requests, settings
from quire.control.pool import MailtoPool
from quire.control.requests import NotFound, RateLimited, Response, SourceError, Unauthorised
from quire.operators.rules import build_engine
from quire.streaming import papers as stream


class Clock:
    now = 100.0

    def __call__(self):
        return self.now


def test_pool_rotates_and_rests():
    clock = Clock()
    pool = MailtoPool(["Alice@x", " bob@x ", "alice@x", "", "carol@x"], clock=clock)
    assert pool.mailtos == ["alice@x", "bob@x", "carol@x"] and len(pool) == 3
    assert [pool.next() for _ in range(4)] == ["alice@x", "bob@x", "carol@x", "alice@x"] and pool.current() == "alice@x"
    pool.mark_rate_limited("BOB@x")
    assert pool.next() == "carol@x"
    pool.mark_rate_limited("alice@x", 10)
    pool.mark_rate_limited("carol@x", 20)
    assert pool.next() == "alice@x" and pool.stats()["bob@x"]["cooldown_remaining"] == 60
    clock.now += 15
    assert pool.next() in ("alice@x",)
    pool.mark_ok("bob@x")
    assert "bob@x" in (pool.next(), pool.next())
    pool.add("dan@x")
    assert pool.remove("alice@x") and not pool.remove("nobody") and pool.mailtos == ["bob@x", "carol@x", "dan@x"]
    assert MailtoPool().next() is None and MailtoPool().is_empty() and MailtoPool().current() is None


def test_requests_retry_and_fail():
    waits, answers = [], [Response(503), Response(502, retry_after=100), Response(200, "ok")]
    assert requests.request(lambda: answers.pop(0), pause=waits.append) == "ok" and waits == [1.0, 60.0]
    for status, kind in ((404, NotFound), (401, Unauthorised), (403, Unauthorised), (400, SourceError), (500, SourceError)):
        with pytest.raises(kind):
            requests.request(lambda s=status: Response(s), pause=waits.append)

    def broken():
        raise ConnectionError("lost")

    with pytest.raises(SourceError, match="lost"):
        requests.request(broken, pause=waits.append)
    assert (NotFound.exit_code, Unauthorised.exit_code, RateLimited.exit_code, SourceError.exit_code) == (2, 3, 4, 6)


def test_requests_rotate():
    pool, used = MailtoPool(["a@x", "b@x"]), []

    def send(mailto):
        used.append(mailto)
        return Response(429) if mailto == "a@x" else Response(200, mailto)

    assert requests.rotating(pool, send, pause=lambda s: None) == "b@x" and used == ["a@x", "b@x"]
    assert pool.stats()["a@x"]["in_cooldown"]
    with pytest.raises(RateLimited):
        requests.rotating(MailtoPool(["c@x"]), lambda m: Response(429), pause=lambda s: None)


def test_settings(tmp_path):
    (tmp_path / "u.toml").write_text('[defaults]\nyear_from = 2010\nissn_quartiles = "Q3"\nauto_name = true\nunknown = 1\n')
    (tmp_path / "p.yaml").write_text("# project\nissn_quartiles: [Q2, 'Q1']\nlanguage: \"fr\"  # comment\nissn_subject_areas:\n  - Medicine\n  - 'Computer Science'\n")
    env = settings.read_environment({"QUIRE_ISSN_QUARTILES": "Q1", "OTHER": "x", "QUIRE_YEAR_TO": ""})
    got = settings.resolve(settings.read_toml(tmp_path / "u.toml"), settings.read_yaml(tmp_path / "p.yaml"), env, {"language": None})
    assert (got.year_from, got.issn_quartiles, got.auto_name, got.language, got.issn_subject_areas, got.year_to) == (2010, "Q1", True, "fr", "Medicine, Computer Science", None)
    assert settings.resolve(project=settings.read_yaml(tmp_path / "p.yaml")).issn_quartiles == "Q2, Q1"
    assert settings.read_toml(tmp_path / "no") == {} and settings.read_yaml(tmp_path / "no") == {}
    assert [settings.to_bool(v) for v in (True, "Yes", "0", "on")] == [True, True, False, True]


def test_accounts():
    accounts = settings.Accounts()
    accounts.add("one", "a@x")
    accounts.add("two", "b@x ")
    accounts.use("two")
    assert accounts.effective(settings.Settings()) == "b@x" and accounts.pool(settings.Settings(mailto_pool="c@x, A@x")) == ["c@x", "a@x", "b@x"]
    assert accounts.remove("two") and accounts.active == "one" and not accounts.remove("two")
    with pytest.raises(KeyError):
        accounts.use("none")


def test_names(tmp_path, monkeypatch):
    now = datetime.datetime(2026, 1, 2, 3, 4, 5)
    assert names.auto_name("search", "Deep Learning!", now=now) == "search_deep-learning_20260102_030405.json"
    assert names.auto_name("filter", input_path=Path("a/in.json"), now=now) == "filter_in_filtered_20260102_030405.json"
    assert names.auto_name("export", input_path=Path("in.json"), format="markdown", now=now) == "export_in_markdown_20260102_030405.md"
    assert names.auto_name("validate", now=now) == "validate_20260102_030405.json"
    assert [names.default_name(k) for k in ("search", "filter", "validate", "export", "x")] == ["search_results.json", "filtered.json", "validated.json", "references.bib", "output.txt"]
    assert names.default_name("export", "ris") == "references.ris" and names.default_name("export", extension=".txt") == "references.txt"
    monkeypatch.chdir(tmp_path)
    assert names.output_dir(environment={}) == tmp_path
    assert names.output_dir("sub", environment={"QUIRE_OUTPUT_DIR": "env"}) == tmp_path / "sub" and (tmp_path / "sub").is_dir()
    assert names.output_dir(environment={"QUIRE_OUTPUT_DIR": "env"}) == tmp_path / "env"
    assert names.output_path("sub/", kind="filter") == tmp_path / "sub" / "filtered.json"
    assert names.output_path("a/b.json") == tmp_path / "a" / "b.json" and (tmp_path / "a").is_dir()
    assert names.auto_naming(True) and not names.auto_naming(False, True) and names.auto_naming(environment={"QUIRE_AUTO_NAME": "yes"}) and names.auto_naming(None, True, {})


def test_streams(spark, tmp_path):
    schema = "_pos long, doi string, year int, scopus_indexed boolean, at timestamp"
    rows = [(0, "10.1/A", 2020, True, datetime.datetime(2026, 1, 1, 0, 5)), (1, " 10.1/a", 2021, False, datetime.datetime(2026, 1, 1, 0, 6)), (2, "", 2021, True, datetime.datetime(2026, 1, 1, 1, 5)), (3, "", 2010, True, datetime.datetime(2026, 1, 1, 1, 6))]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(transform, mode="append"):
        query = transform(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("out").outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.table("out").collect()

    assert sorted(r._pos for r in run(lambda s: stream.filter_stream(s, build_engine(min_year=2015)))) == [0, 1, 2]
    assert len({r._pos for r in run(lambda s: stream.first_dois(s, "at"))} - {2, 3}) == 1
    counts = run(lambda s: stream.arrivals(s, "at"), "complete")
    assert sorted((r.window.start.hour, r.papers, r.scopus_indexed) for r in counts) == [(0, 2, 1), (1, 2, 2)]
