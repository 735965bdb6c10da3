import json

import pytest
from test_sources_sinks import JOURNALS, WORK

from quire.__main__ import main


@pytest.fixture
def files(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    papers = [{"doi": "10.1/a", "title": "alpha beta gamma", "year": 2020, "cited_by_count": 9, "issns": ["1111-1111"]}, {"doi": "10.1/A", "title": "x y z", "year": 2021, "cited_by_count": 9}, {"doi": "10.1/c", "title": "delta", "year": 2001}]
    (tmp_path / "in.json").write_text(json.dumps({"results": papers}))
    (tmp_path / "j.json").write_text(json.dumps(JOURNALS))
    (tmp_path / "works").mkdir()
    (tmp_path / "works" / "p.json").write_text(json.dumps({"results": [WORK, WORK | {"doi": "https://doi.org/10.2/b", "abstract_inverted_index": {"other": [0]}, "primary_location": None}]}))
    return tmp_path


def said(capsys):
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_filter(spark, files, capsys):
    assert main(["filter", "in.json", "--min-year", "2010", "--json", "--journals", "j.json", "--annotate"], spark) == 0
    out = said(capsys)
    assert (out["input_count"], out["kept"], out["removed"], out["dedup_removed"], out["kept_indexed"]) == (3, 1, 2, 1, 1)
    saved = json.loads((files / "filtered.json").read_text())
    assert [p["doi"] for p in saved["kept"]] == ["10.1/a"] and saved["rules"][0]["name"] == "year" and len(saved["removed_preview"]) == 2
    assert main(["filter", "in.json", "--min-year", "2050"], spark) == 2
    assert main(["filter", "in.json", "--journals", "none.json"], spark) == 5
    assert main(["nonsense"], spark) == 1


def test_search(spark, files, capsys):
    assert main(["search", "hello world", "--works", "works", "--json", "--journals", "j.json", "--year-from", "2020"], spark) == 0
    out = said(capsys)
    assert (out["count"], out["mode"], out["scanned"]) == (1, "none", 1)
    got = json.loads((files / "search_results.json").read_text())["results"][0]
    assert got["doi"] == "10.1/A" and got["quartile"] == "Q1" and got["scopus_indexed"]
    assert main(["search", "hello", "--works", "works", "--json", "--issn", "1111-1111"], spark) == 0 and said(capsys)["mode"] == "server"
    assert main(["search", "hello", "--works", "works", "--journals", "j.json", "--subject-areas", "none such"], spark) == 2
    assert main(["search", "hello", "--works", "works", "--issn", "bad"], spark) == 1
    assert main(["search", "absent", "--works", "works"], spark) == 2


def test_validate_export_issn_config(spark, files, capsys, monkeypatch):
    assert main(["validate", "--dois", "10.1/a, 10.9/none", "--works", "works", "--journals", "j.json", "--json"], spark) == 0
    out = said(capsys)
    assert (out["input_count"], out["found"], out["scopus_count"]) == (2, 1, 1)
    assert json.loads((files / "validated.json").read_text())["errors"] == [{"doi": "10.9/none", "error": "not_found"}]
    (files / "l.bib").write_text("@article{a, doi={10.1/A}}")
    assert main(["validate", "--input", "l.bib", "--works", "works", "--json"], spark) == 0 and said(capsys)["found"] == 1
    assert main(["validate", "--works", "works"], spark) == 1
    (files / "l.md").write_text("10.1/a")
    assert main(["validate", "--input", "l.md", "--works", "works"], spark) == 1
    assert main(["export", "in.json", "--format", "ris", "--json"], spark) == 0 and said(capsys)["papers"] == 3
    assert (files / "references.ris").read_text().count("TY  - JOUR") == 3
    assert main(["export", "in.json", "--format", "docx"], spark) == 1
    assert main(["issn", "11111111", "9999-9999", "--journals", "j.json", "--json"], spark) == 0 and said(capsys)["found"] == 1
    assert main(["issn", "9999-9999", "--journals", "j.json"], spark) == 2
    assert main(["issn", "bad", "--journals", "j.json"], spark) == 1
    monkeypatch.setenv("QUIRE_LANGUAGE", "de")
    assert main(["config", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["language"] == "de"
