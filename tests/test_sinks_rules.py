"""Sinks written by tasks, rules of many keywords, and counters out of one pass."""

import random
import time
import uuid

import pytest
from pyspark.sql import functions as F
from test_sources_sinks import papers  # noqa: F401

from quire.operators import rules
from quire.sinks import formats, source
from quire.sources import works


def _rows(spark, n, parts=7):
    return spark.range(n, numPartitions=parts).select(F.col("id").alias("_pos"), F.concat(F.lit("row é "), F.col("id").cast("string")).alias("text"))


def test_parts_in_order_make_the_single_file(spark, tmp_path):
    folder = str(tmp_path / "parts")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        source.write_text(_rows(spark, 500).orderBy(F.rand(3)), folder, format_name="demo", extension=".demo", head="# head")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part-"))
    assert len(files) > 2 and files[0].read_text() == "# head\n" and all(f.suffix == ".demo" for f in files)
    text = "".join(f.read_text(encoding="utf-8") for f in files)
    assert text == "# head\n" + "".join(f"row é {n}\n" for n in range(500))
    assert source.join_parts(folder, tmp_path / "one").read_text(encoding="utf-8") == text.rstrip("\n")
    # a second write adds files, an overwriting one replaces them
    source.write_text(_rows(spark, 3), folder, format_name="demo", overwrite=True, extension=".demo")
    assert source.join_parts(folder, tmp_path / "two").read_text(encoding="utf-8") == "row é 0\nrow é 1\nrow é 2"
    assert sorted(p.name[:1] for p in (tmp_path / "parts").iterdir()) == ["_"] + ["p"] * (len(list((tmp_path / "parts").iterdir())) - 1)


def test_a_write_that_fails_leaves_no_file(spark, tmp_path):
    folder = tmp_path / "parts"
    rows = _rows(spark, 100).withColumn("text", F.when(F.col("_pos") == 97, F.raise_error(F.lit("expected"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="expected"):
        source.write_text(rows, str(folder), format_name="demo")
    seen = lambda: {p.name: p.read_bytes() for p in folder.iterdir() if not p.name.startswith("_writing")} if folder.exists() else {}
    assert seen() == {}
    source.write_text(_rows(spark, 5), str(folder), format_name="demo")
    before = seen()
    source.install(spark, "demo")
    with pytest.raises(Exception, match="expected"):
        rows.select("text").write.format("demo").mode("overwrite").save(str(folder))
    assert seen() == before and len(before) > 1


def test_single_files_without_a_driver_loop(spark, tmp_path):
    empty = source.write_single(_rows(spark, 0), tmp_path / "e", str(tmp_path / "s1"), head="h", tail="t")
    assert empty.read_text() == "ht" and not (tmp_path / "s1").exists()
    got = source.write_single(_rows(spark, 40), tmp_path / "deep" / "f", str(tmp_path / "s2"), separator=",\n", head="[", tail="]")
    assert got.read_text(encoding="utf-8") == "[" + ",\n".join(f"row é {n}" for n in range(40)) + "]"


@pytest.mark.parametrize("kind", ["bibtex", "ris", "csv", "jsonl", "markdown"])
def test_folder_and_file_say_the_same(papers, tmp_path, kind):  # noqa: F811
    exporter = formats.get_exporter(kind)
    exporter.export_to_folder(papers, str(tmp_path / "parts"))
    joined = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "parts").iterdir()) if p.name.startswith("part-"))
    single = exporter.export_to_file(papers, tmp_path / "one").read_text(encoding="utf-8")
    assert joined == (single if exporter.ends else single + "\n")


def _haystacks(spark, n=300):
    rng = random.Random(5)
    syllables = ["ka", "lo", "mi", "nu", "pe", "ra", "é", " ", " ", "-", "7"]
    rows = [(k, "".join(rng.choices(syllables, k=60)), "".join(rng.choices(syllables, k=200)), ["Kalo", "x y"][: k % 3]) for k in range(n)]
    return rng, spark.createDataFrame([*rows, (n, None, "", None)], "_pos long, title string, abstract string, keywords array<string>")


def test_thousands_of_keywords_equal_the_fold_of_contains(spark, monkeypatch):
    rng, rows = _haystacks(spark)
    words = list(dict.fromkeys("".join(rng.choices(["ka", "lo", "mi", "nu", "pe", "ra", "Zz", "7", " "], k=rng.randrange(4, 9))) for _ in range(10_000)))
    few = words[:100]
    for kind in (rules.KeywordBlacklist, rules.KeywordWhitelist):
        kept = lambda ws: sorted(r._pos for r in rows.where(kind(tuple(ws)).column()).collect())  # noqa: B023, E731
        by_automaton = kept(few)
        monkeypatch.setattr(rules, "CONTAINS", 1000)
        assert kept(few) == by_automaton
        monkeypatch.undo()
        assert 0 < len(by_automaton) < 301
        assert kept([*few, "é"]) == kept(["é"])  # what normalises to nothing is found everywhere
    # against plain Python
    from quire.functions.text import normalize_plain

    plain = [normalize_plain(w.lower()) for w in words]
    got = {r._pos: r.t for r in rows.select("_pos", rules.any_keyword(F.col("abstract"), plain).alias("t")).collect()}
    assert got == {r._pos: any(w in r.abstract for w in plain) for r in rows.collect()}


def test_time_of_keywords_does_not_grow_with_their_number(spark):
    _, rows = _haystacks(spark, 2000)
    many = rows.select(F.repeat("abstract", 20).alias("abstract"))
    took = {}
    for n in (100, 100, 10_000):
        words = [f"q{uuid.UUID(int=k).hex}" for k in range(n)]
        began = time.time()
        assert many.where(rules.any_keyword(F.col("abstract"), words)).count() == 0
        took[n] = time.time() - began
    assert took[10_000] < 5 * took[100] + 5


@pytest.mark.parametrize("limit, cap, accept", [(0, 0, True), (0, 70, True), (5, 70, True), (50, 70, True), (5, 0, True), (500, 0, True), (5, 0, False), (9, 4, False), (0, 0, False), (3, 3, True)])
def test_counters_of_a_scan_against_a_loop(spark, limit, cap, accept):
    rows = [(k * 3, k % 4 == 1) for k in range(100)]
    frame = spark.createDataFrame(rows, "_pos long, good boolean").orderBy(F.rand(1))
    test = F.col("good") if accept else None
    scanned, found, capped = 0, [], False
    for place, good in rows:
        scanned += 1
        if good or not accept:
            found.append(place)
            if limit and len(found) >= limit:
                break
        if cap and scanned >= cap:
            capped = True
            break
    got, stats = works.take_observed(frame, test, limit, cap)
    assert sorted(r._pos for r in got.collect()) == found
    assert tuple(stats.first()) == (scanned, len(found), capped)
    assert tuple(works.search_stats(frame, test, limit, cap).first()) == (scanned, len(found), capped)


def test_result_and_counters_are_one_job(spark):
    frame = spark.range(1000).select(F.col("id").alias("_pos"))
    spark.sparkContext.setJobGroup("one pass", "test")
    try:
        _, stats = works.take_observed(frame, F.col("_pos") % 3 == 0)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("one pass")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) == 1 and tuple(stats.first()) == (1000, 334, False)


def test_output_json_sends_no_rows_to_the_driver(spark, tmp_path, monkeypatch, capsys):
    """Tasks write the rows; the driver copies bytes of the shared folder."""
    import json

    from pyspark.sql.classic.dataframe import DataFrame

    from quire.plans import pipelines

    monkeypatch.setattr(DataFrame, "toLocalIterator", None)
    rows = [(k, f"é{k}" * 30) for k in range(250)]
    pipelines.output_json(spark.createDataFrame(rows, "_pos long, title string").repartition(5), query="q")
    out = json.loads(capsys.readouterr().out)
    assert out == {"query": "q", "results": [{"title": t} for _, t in rows]}
    pipelines.output_json(spark.createDataFrame([], "_pos long, title string"))
    assert json.loads(capsys.readouterr().out) == {"results": []}


def test_parts_stream_in_blocks_of_any_size(tmp_path):
    import io

    from quire.sinks import source

    (tmp_path / "part-1.txt").write_text("aé€\nb\n", encoding="utf-8")
    (tmp_path / "part-2.txt").write_text("c\n", encoding="utf-8")
    for block in (1, 2, 3, 100):
        out = io.StringIO()
        source.stream_parts(str(tmp_path), out, ",\n", block)
        assert out.getvalue() == "aé€\nb,\nc"


def test_texts_are_composed_a_few_at_a_time():
    import unicodedata

    import pyarrow as pa

    from quire.functions import text

    sizes = []
    values = [None if k % 9 == 0 else f"ﬁ{k} é" for k in range(250)]

    class Spied:
        def __len__(self):
            return len(values)

        def slice(self, lo, n):
            sizes.append(n)
            return pa.array(values).slice(lo, n)

    want = [None if v is None else unicodedata.normalize("NFKC", v) for v in values]
    assert text._compose(Spied()).to_pylist() == want and max(sizes) <= 100
    assert text._compose(pa.array([], pa.string())).to_pylist() == []


def test_the_writer_joins_a_few_rows_at_a_time(spark, tmp_path, monkeypatch):
    import pyarrow as pa
    from pyspark import TaskContext

    from quire.sinks import source

    class Task:
        def partitionId(self):
            return 0

    sizes = []

    class Batch:
        num_rows = 250

        def column(self, k):
            return self

        def slice(self, lo, n):
            sizes.append(n)
            return pa.array([f"r{k}" for k in range(250)]).slice(lo, n)

    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: Task()))
    part = source.TextWriter({"path": str(tmp_path)}, 0, False).write(iter([Batch(), Batch()]))
    rows = [f"r{k}" for k in range(250)]
    with open(part.path, encoding="utf-8") as f:
        assert f.read() == "\n".join(rows + rows) + "\n"
    assert part.rows == 500 and max(sizes) <= 100
