"""Files read block by block against the readers of whole files."""

import json
import random
from contextlib import contextmanager

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.sources import doi_lists, documents, splits
from quire.tables import Scratch


@contextmanager
def blocks(spark, size):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", str(size))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _paper(rng, n):
    odd = rng.choice(["plain", 'a "quote"', "br{ace}s ]}", "back\\slash\\", "[{", "é中🙂", "x" * 300, "\n\t", "}\"}", ""])
    return {"doi": f"10.1/{n}", "title": f"{odd} {n}", "authors": ["A}", "B, [C]"][: rng.randrange(3)], "year": rng.choice([None, 2000 + n % 9]), "keywords": [], "extra": {"deep": [{"er": [1, 2, {"x": "}"}]}]}}


DOCUMENTS = {
    "list": lambda ps: ps,
    "results": lambda ps: {"query": "q: [x], {y}", "errors": [{"doi": "10.9/z"}], "meta": {"results": [1, 2]}, "results": ps, "n": 3},
    "kept": lambda ps: {"removed": ps[:3], "kept": ps},
    "groups": lambda ps: {"zeta": ps[:7], "n": 1, "empty": [], "o": {"l": [{"title": "no"}]}, "alpha \"b\"}" * 30: ps[7:], "s": "}{" * 90, "k}" * 90: ps[:2], "t": "[,]"},
    "no results": lambda ps: {"results": [], "kept": ps},
}


@pytest.mark.parametrize("shape, size, indent", [("list", 300, None), ("results", 300, None), ("groups", 300, None), ("kept", 700, 1), ("no results", 700, None), ("groups", 1 << 20, 1)])
def test_papers_of_blocks_equal_those_of_whole_files(spark, tmp_path, shape, size, indent):
    rng = random.Random(size)
    doc = DOCUMENTS[shape]([_paper(rng, n) for n in range(20)])
    path = tmp_path / "doc.json"
    path.write_text(json.dumps(doc, indent=indent, ensure_ascii=rng.random() < 0.5) + rng.choice(["", "\n", " \n\n"]), encoding="utf-8")
    expected = [r.asDict() for r in documents.read_papers(spark, str(path)).orderBy("_pos").collect()]
    with blocks(spark, size):
        n = splits._fragments(spark, str(path)).select("block").distinct().count()
        got = [r.asDict() for r in splits.read_papers_files(spark, str(path)).orderBy("_pos").collect()]
    assert got == expected
    assert n > 5 or size > 1000


def test_one_paper_over_many_blocks_and_several_files(spark, tmp_path):
    long = {"title": "a}" * 3000, "doi": "10.1/long"}
    (tmp_path / "a.json").write_text(json.dumps([{"title": "one"}, long, {"title": "two"}]))
    (tmp_path / "b.json").write_text(json.dumps({"kept": [{"title": "three"}]}))
    (tmp_path / "c.json").write_text("[]")
    with blocks(spark, 200):
        got = [(r._pos, r.title) for r in splits.read_papers_files(spark, str(tmp_path)).orderBy("_pos").collect()]
    assert got == [(0, "one"), (1, long["title"]), (2, "two"), (3, "three")]


@pytest.mark.parametrize("text", ['[{"title":"a"}', '{"results":[{"title":"a"}]', 'no json', '[{"title":"a}]', '[{"title":"a"}]]'])
def test_no_json(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(ValueError, match="not valid JSON"):
        splits.read_papers_files(spark, str(tmp_path / "x.json"))


def _bib(rng, n):
    head = rng.choice(["@article{", "@Book{ ", "@misc (", "@inproceedings\n{"])
    close = ")" if "(" in head else "}"
    note = rng.choice(["{a {nested {deeply}} one}", '"quo {t}ed, = x"', "bare", "{see 10.55/in.text}", "{list a) b) c) (}" if close == "}" else "{plain}", "{at @sign{x} here}"])
    doi = rng.choice([f"doi = {{10.1/{n % 25}}}", f'DOI="10.2/X{n % 9}"', "year = 2001", f"Doi = {{}}, doi = {{10.3/{n}}}"])
    return f"{rng.choice(['', 'junk } text {', '% remark' + chr(10), '@comment{x} ', '@string{a = {b}}' + chr(10)])}{head}key{n}, note = {note}, {doi}\n{close}\n" if rng.random() < 0.9 else f"{head}k{n}{close}"


@pytest.mark.parametrize("seed, size", [(0, 150), (1, 300), (2, 300), (0, 1 << 20)])
def test_dois_of_blocks_equal_those_of_whole_files(spark, tmp_path, size, seed):
    rng = random.Random(seed)
    text = "".join(_bib(rng, n) for n in range(40)) + rng.choice(["", "\n", "tail 10.7/outside"])
    (tmp_path / "a.bib").write_text(text)
    (tmp_path / "b.bib").write_text("@a{x, doi={10.1/b}}")
    expected = doi_lists.read_bib_dois(spark.createDataFrame([(text,)], "text string")).first().dois
    assert len(expected) > 3
    with blocks(spark, size):
        rows = splits.read_bib_files(spark, str(tmp_path)).orderBy("_pos").collect()
    assert [r.doi for r in rows] == [*expected, "10.1/b"] and [r._pos for r in rows] == list(range(len(rows)))


def test_a_task_holds_a_window_of_its_block(monkeypatch):
    """blocks of the file system are cut by bytes, wherever the Arrow batches end."""
    rng = random.Random(3)
    parts = ["x" * rng.randrange(40) for _ in range(500)]
    expected = None
    monkeypatch.setattr(splits, "WINDOW", 100)
    for rows in (500, 7, 1):
        table = pa.table({"file": ["a"] * 300 + ["b"] * 200, "block": [0] * 150 + [9000] * 150 + [0] * 200, "size": [1] * 500, "value": parts})
        got = [(file, block, b"".join(held)) for file, block, _, held in splits._blocks(table.to_batches(rows))]
        assert b"".join(t for _, _, t in got) == b"".join(p.encode() + b"}" for p in parts)
        assert all(len(t) < 100 + 41 for _, _, t in got) and len({g[:2] for g in got}) == len(got) and len(got) > 50
        assert got == sorted(got) and (expected is None or got == expected)
        expected = got


@pytest.mark.parametrize("window", [20, 333])
def test_windows_of_one_task_equal_whole_files(spark, tmp_path, monkeypatch, window):
    rng = random.Random(window)
    text = "".join(_bib(rng, n) for n in range(60))
    (tmp_path / "a.bib").write_text(text)
    papers = [_paper(rng, n) for n in range(30)]
    (tmp_path / "a.json").write_text(json.dumps(DOCUMENTS["groups"](papers)))
    monkeypatch.setattr(splits, "WINDOW", window)
    dois = doi_lists.read_bib_dois(spark.createDataFrame([(text,)], "text string")).first().dois
    assert [r.doi for r in splits.read_bib_files(spark, str(tmp_path / "a.bib")).orderBy("_pos").collect()] == dois
    assert splits.read_papers_files(spark, str(tmp_path / "a.json")).orderBy("_pos").collect() == documents.read_papers(spark, str(tmp_path / "a.json")).orderBy("_pos").collect()


@pytest.mark.parametrize("text", ["@a{x, doi={10.1/a}} @b{y, doi={10.2/b}, ", '@a{x, doi={10.1/a}} @b{y, doi="10.2/b} @c{z, doi = {10.1/A}}', "@a{x, doi={10.1/a}", "", "no entries 10.5/x"])
@pytest.mark.parametrize("size", [20])
def test_bib_files_that_never_end(spark, tmp_path, text, size):
    (tmp_path / "x.bib").write_text(text)
    expected = doi_lists.read_bib_dois(spark.createDataFrame([(text,)], "text string")).first().dois
    with blocks(spark, size):
        assert [r.doi for r in splits.read_bib_files(spark, str(tmp_path / "x.bib")).orderBy("_pos").collect()] == expected


def test_a_large_file_is_read_by_many_tasks(spark, tmp_path):
    """No line breaks, some megabytes, one task a block."""
    rng = random.Random(1)
    papers = [_paper(rng, n) | {"abstract": "w " * 400} for n in range(3000)]
    (tmp_path / "big.json").write_text(json.dumps({"results": papers}))
    with blocks(spark, 200_000):
        pieces = splits._fragments(spark, str(tmp_path / "big.json"))
        assert pieces.rdd.getNumPartitions() >= 10
        got = splits.read_papers_files(spark, str(tmp_path / "big.json"))
        assert got.count() == 3000 and got.agg(F.sum("_pos")).first()[0] == 2999 * 1500
        assert {r.title for r in got.select("title").collect()} == {p["title"] for p in papers}


def test_texts_of_papers_are_written_once(spark, tmp_path, monkeypatch):
    """Papers get their places from the runs of their blocks, whatever else stands between these; one table holds texts."""
    rng = random.Random(7)
    ps = [_paper(rng, n) for n in range(40)]
    others = {f"k{n}": ps[n : n + 2] for n in range(9)}
    (tmp_path / "a.json").write_text(json.dumps(others | {"kept": ps[:17], "n": [1, 2, {}]}))
    (tmp_path / "b.json").write_text(json.dumps({"removed": ps[5:9], "results": ps[17:]} | others))
    monkeypatch.setattr(splits, "WINDOW", 500)
    with Scratch() as scratch:
        papers = splits.read_papers_files(spark, str(tmp_path))
    assert len([p for p in scratch.paths if "text" in spark.read.parquet(p).columns]) == 1
    assert [(r._pos, r.title) for r in papers.orderBy("_pos").collect()] == [(n, p["title"]) for n, p in enumerate(ps)]
