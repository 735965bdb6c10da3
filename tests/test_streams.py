"""Streams of works and of papers, against small services on this machine and against the batch operators."""

import json
import random
from datetime import datetime, timedelta

import pytest
from test_live import catalogue, client  # noqa: F401

from quire.operators import dedup
from quire.sources import remote, works
from quire.streaming import titles


@pytest.mark.parametrize("pages", [1, 2])
def test_stream_of_works_stops_and_goes_on(spark, catalogue, tmp_path, pages):  # noqa: F811
    at = lambda name: str(tmp_path / name)

    def run(batches):
        papers = remote.works_stream(spark, client(catalogue), works.Scan(), at("landing"), pages)
        query = papers.writeStream.format("parquet").option("checkpointLocation", at("ck")).start(at("out"))
        try:
            for _ in range(300):
                query.processAllAvailable() if batches is None else query.awaitTermination(0.1)
                if batches is None or query.lastProgress and query.lastProgress["batchId"] + 1 >= batches:
                    break
        finally:
            query.stop()

    run(1)
    run(None)
    asked = len(catalogue.seen)
    run(None)
    got = [(r._pos, r.doi) for r in spark.read.parquet(at("out")).orderBy("_pos").collect()]
    assert got == [(n, w["doi"].removeprefix("https://doi.org/")) for n, w in enumerate(catalogue.works)]
    # no page twice, nothing after the end
    cursors = [s["cursor"] for s in catalogue.seen if s.get("per-page") != "1"]
    assert len(cursors) == len(set(cursors)) and len(catalogue.seen) == asked


def _papers(n, seed=3):
    """Families of near copies, DOIs in other letters, empty titles."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe") for b in ("ra", "se", "ti", "vo", "wy")]
    bodies = [" ".join(rng.choices(words, k=30)) for _ in range(n // 5)]
    out = []
    for k in range(n):
        title = rng.choice(bodies)
        if rng.random() < 0.6:
            cut = title.split()
            cut[rng.randrange(len(cut))] = rng.choice(words)
            title = " ".join(cut)
        title = rng.choice(["", "ab", title, title, title, title.upper()])
        doi = rng.choice(["", "", f"10.1/{rng.randrange(n)}", f"10.1/A{rng.randrange(9)}", f"10.1/a{rng.randrange(9)}"])
        out.append((k, doi, title, datetime(2024, 1, 1) + timedelta(hours=k)))
    return out


def test_title_dedup_over_a_stream_equals_dedup(spark, tmp_path):
    rows = _papers(90)
    ddl = "_pos bigint, doi string, title string, at timestamp"
    expected = {r._pos for r in dedup.dedup(spark.createDataFrame(rows, ddl))[0].collect()}
    assert 10 < len(expected) < 80
    folder = tmp_path / "in"
    folder.mkdir()
    at = lambda name: str(tmp_path / name)
    said = []
    for part in range(3):
        lines = [json.dumps({"_pos": p, "doi": d, "title": t, "at": w.isoformat()}) for p, d, t, w in rows[part * 30 : part * 30 + 30]]
        (folder / f"{part}.json").write_text("\n".join(lines))
        stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).json(str(folder))
        query = titles.dedup_stream(stream, "at", at("tables"), at("ck"), keep="400 days", then=lambda out, batch: said.append((batch, out.count())), availableNow=True)
        query.awaitTermination()
    got = {r._pos for r in titles.Decider(spark, at("tables")).decided().where("NOT dup").collect()}
    assert got == expected
    assert sum(n for _, n in said) == 90


def test_state_of_titles_goes_with_the_watermark(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    at = lambda name: str(tmp_path / name)
    days = [1, 2, 40, 41, 42]
    for n, day in enumerate(days):
        line = {"_pos": n, "doi": "", "title": "one and the same title of a paper", "at": (datetime(2024, 1, 1) + timedelta(days=day)).isoformat()}
        (folder / f"{n}.json").write_text(json.dumps(line))
        stream = spark.readStream.schema("_pos bigint, doi string, title string, at timestamp").json(str(folder))
        titles.dedup_stream(stream, "at", at("tables"), at("ck"), late="1 hour", keep="3 days", availableNow=True).awaitTermination()
    got = {r._pos: r.dup for r in titles.Decider(spark, at("tables")).decided().collect()}
    # the third is a copy, but the first two were forgotten by then at the latest when the watermark passed them
    assert got[0] is False and got[1] is True and got[4] is True
