import csv
import io
import json

import pytest
from pyspark.sql import functions as F

from quire.plans import adapters, pipelines
from quire.plans.queries import QUERIES
from quire.schema import canonical
from quire.sinks import formats
from quire.sources import doi_lists, documents, works

P2 = [
    {"_pos": 0, "doi": "10.1000/paper1", "title": "Deep {Learning} & 50% \"more\"", "authors": ["Smith J.", "Jones A."], "journal": "Journal of ML", "year": 2024, "volume": "10", "issue": "2", "first_page": "100", "last_page": "120", "cited_by_count": 42, "scopus_indexed": True, "quartile": "Q1", "is_open_access": True, "open_access_url": "https://oa", "abstract": "Line one\nline_two ^ ~ \\ end", "keywords": ["deep learning", "neural networks"], "issn_print": "1234-5678", "url": "https://u"},
    {"_pos": 1, "title": "Workshop", "authors": ["Doe R."], "year": 2023, "abstract": "x" * 2100},
]


@pytest.fixture
def papers(spark):
    ddl = "_pos long, doi string, title string, authors array<string>, journal string, year int, volume string, issue string, first_page string, last_page string, cited_by_count long, scopus_indexed boolean, quartile string, is_open_access boolean, open_access_url string, abstract string, keywords array<string>, issn_print string, url string"
    names = [f.split()[0] for f in ddl.split(", ")]
    return canonical(spark.createDataFrame([tuple(r.get(n) for n in names) for r in P2], ddl))


def write(papers, kind, tmp_path):
    return formats.get_exporter(kind).export_to_file(papers, tmp_path / "deep" / "out").read_text(encoding="utf-8")


def test_bibtex(papers, tmp_path):
    text = write(papers, "bib", tmp_path)
    first, second = text.split("@article{")[1:]
    assert first.splitlines()[:3] == ["smith2024_" + first[10:15] + ",", "  author       = {Smith J. and Jones A.},", '  title        = {Deep \\{Learning\\} \\& 50\\% "more"},']
    assert "  pages        = {100--120},\n" in first and "  number       = {2},\n" in first
    assert "abstract     = {Line one\nline\\_two \\^{} \\~{} \\textbackslash{} end}" in first
    assert first.endswith("  scopus_indexed = {true},\n  quartile     = {Q1}\n}\n\n")
    assert second.startswith("doe2023_idx1,\n") and second.endswith("  scopus_indexed = {false}\n}\n")
    assert "x" * 1500 + "..." in second and "x" * 1501 not in second
    assert text.startswith("% Generated by quire\n% Format: BibTeX\n")


def test_ris(papers, tmp_path):
    lines = write(papers, "ris", tmp_path).split("\n")
    assert lines[:4] == ["TY  - JOUR", "AU  - Smith J.", "AU  - Jones A.", 'TI  - Deep {Learning} & 50% "more"']
    assert "AB  - Line one line_two ^ ~ \\ end" in lines and "KW  - neural networks" in lines
    assert "N1  - scopus_indexed=true; quartile=Q1" in lines and "N1  - scopus_indexed=false; quartile=N/A" in lines
    assert lines.count("ER  -") == 2 and lines[-2:] == ["ER  -", ""]


def test_csv_is_the_quoted_form(papers, tmp_path):
    text = write(papers, "csv", tmp_path)
    rows = list(csv.reader(io.StringIO(text)))
    assert rows[0] == list(formats.CSV_COLUMNS) and len(rows) == 3
    assert rows[1] == ["10.1000/paper1", P2[0]["title"], "Smith J.; Jones A.", "Journal of ML", "2024", "", "10", "2", "100--120", "1234-5678", "42", "true", "https://oa", "true", "Q1", "en", "", "https://u", "deep learning; neural networks", P2[0]["abstract"]]
    assert rows[2][-1] == "x" * 200 + "..."
    again = io.StringIO()
    csv.writer(again, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows(rows)
    assert again.getvalue() == text


def test_jsonl(papers, tmp_path):
    rows = [json.loads(line) for line in write(papers, "json", tmp_path).splitlines()]
    assert rows[0]["authors"] == ["Smith J.", "Jones A."] and rows[0]["year"] == 2024 and rows[1]["doi"] == "" and rows[1]["keywords"] == []
    assert len(rows[0]) == 29


def test_markdown(papers, tmp_path):
    text = write(papers, "md", tmp_path)
    assert text.startswith("# References\n\nTotal: 2 entries  \nScopus-indexed: 1  \nNon-Scopus: 1\n\n---\n\n## 1. `10.1000/paper1`  `[Scopus Q1]`\n\n**Title:** Deep")
    assert "**Authors:** Smith and Jones\n" in text and "**Open Access:** yes — https://oa\n" in text and "## 2. _(no DOI)_\n" in text
    assert "\n\n> " + "x" * 500 + "...\n" in text


def test_empty_exports(papers, tmp_path):
    none = papers.limit(0)
    assert write(none, "jsonl", tmp_path) == "" and write(none, "ris", tmp_path) == ""
    assert write(none, "csv", tmp_path).count("\n") == 1
    with pytest.raises(pipelines.NoResult):
        pipelines.export(none, "ris", tmp_path / "x")
    with pytest.raises(ValueError):
        formats.get_exporter("docx")


def test_export_pipeline_counts_and_folder(papers, tmp_path, spark):
    done = pipelines.export(papers, "ris", tmp_path / "x.ris", scopus_only=True)
    assert done["papers"] == 1 and done["scopus_indexed"] == 1 and done["bytes"] == (tmp_path / "x.ris").stat().st_size
    formats.get_exporter("bibtex").export_to_folder(papers, str(tmp_path / "parts"))
    whole = "\n".join(r.value for r in spark.read.text(str(tmp_path / "parts"), wholetext=True).collect())
    assert whole.count("@article{") == 2


def test_save_json_and_read_back(papers, tmp_path, spark):
    path = pipelines.save_json(papers, tmp_path / "r.json", query="q", errors=[])
    data = json.loads(path.read_text())
    assert data["query"] == "q" and [p["title"] for p in data["results"]] == [p["title"] for p in P2]
    again = documents.read_papers(spark, str(path)).orderBy("_pos")
    assert [r.asDict() for r in again.collect()] == [r.asDict() for r in papers.orderBy("_pos").collect()]


@pytest.mark.parametrize(
    "shape, expected",
    [('[{"title":"a"},{"title":"b","x":1}]', ["a", "b"]), ('{"results":[{"title":"a"}],"kept":[{"title":"z"}]}', ["a"]), ('{"kept":[{"title":"k"}],"removed":[{"title":"z"}]}', ["k"]), ('{"g1":[{"title":"a"}],"n":3,"g2":[{"title":"b"}]}', ["a", "b"]), ("[]", []), ("{}", [])],
)
def test_paper_documents(spark, shape, expected):
    got = documents.read_papers_json(spark.createDataFrame([(shape,)], "json string"))
    assert [r.title for r in got.orderBy("_pos").collect()] == expected


def test_group_documents(spark):
    doc = '{"zeta":[{"doi":"10.1/a"},{"doi":"10.1/b","authors":["x"]}],"alpha":[{"doi":"10.1/c"}],"empty":[]}'
    got = documents.read_group_json(spark.createDataFrame([(doc,)], "json string")).orderBy("group_pos", "_pos").collect()
    assert [(r["group"], r._pos, r.doi) for r in got] == [("zeta", 0, "10.1/a"), ("zeta", 1, "10.1/b"), ("alpha", 0, "10.1/c")]


JOURNALS = [
    {"journal": " AI Journal ", "issn_print": "1111-1111, 2222-2222", "issn": ["33333333", "bad"], "Issn": "1111-1111", "quartile": "q1", "subject_area": "CS"},
    {"journal": "", "title": "", "Title": "ML", "Quartile": "Q2", "subject_area": ["CS", " ", "Math "], "sub_category": "AI", "Open_Access": "Yes"},
    {"title": "Med", "best_quartile": "-", "Subject Area": "Medicine", "quartile": None},
    "not a journal",
    {},
]
PARSED = [("AI Journal", ["1111-1111", "2222-2222", "3333-3333"], "Q1", "", ["CS"], []), ("ML", [], "Q2", "Yes", ["CS", "Math"], ["AI"]), ("Med", [], "-", "", ["Medicine"], []), ("", [], "", "", [], [])]


def test_journal_files(spark, tmp_path):
    path = tmp_path / "j.json"
    path.write_text(json.dumps(JOURNALS))
    read = documents.read_journals(spark, str(path))
    assert [tuple(r)[1:] for r in read.orderBy("_pos").collect()] == PARSED
    assert documents.read_journals(spark, str(path)) is read
    path.write_text(json.dumps({"Area": JOURNALS[2:3], "Other": [{"title": "x"}], "n": 1}))
    by_area = documents.read_journals(spark, str(path)).orderBy("_pos").collect()
    assert [(r.title, r.subject_areas) for r in by_area] == [("Med", ["Medicine"]), ("x", ["Other"])]
    path.write_text("{broken")
    with pytest.raises(ValueError):
        documents.read_journals(spark, str(path))
    with pytest.raises(FileNotFoundError):
        documents.read_journals(spark, str(tmp_path / "none.json"))
    (tmp_path / "scimagojr_2025.json").write_text("[]")
    assert documents.default_journal_path([str(tmp_path / "no"), str(tmp_path)]) == str(tmp_path / "scimagojr_2025.json")
    assert documents.default_journal_path([]) is None


WORK = {
    "id": "https://w/1", "doi": "https://doi.org/10.1/A", "title": None, "publication_date": "2021-05-02", "authorships": [{"author": {"display_name": "Ann"}}, {"author": None}, {"author": {"display_name": ""}}],
    "primary_location": {"source": {"display_name": "J", "issn": ["11111111", "2222-222x"], "issn_l": "3333-3333"}}, "abstract_inverted_index": {"world": [1, 3], "hello": [0], "again": [2]},
    "cited_by_count": None, "open_access": {"is_oa": True, "oa_url": None, "oa_status": "gold"}, "topics": [{"display_name": ""}] + [{"display_name": f"t{i}"} for i in range(6)], "keywords": [{"display_name": None}] + [{"display_name": f"k{i}"} for i in range(12)],
}


def test_normalize_work(spark):
    lines = spark.createDataFrame([(0, json.dumps(WORK)), (1, "{}"), (2, json.dumps({"publication_date": "n.d.", "language": "fr", "primary_location": None}))], "_pos long, work string")
    a, b, c = works.normalize_work(works.parse_works(lines)).orderBy("_pos").collect()
    assert (a.doi, a.title, a.authors, a.journal, a.year, a.issns) == ("10.1/A", "", ["Ann"], "J", 2021, ["1111-1111", "2222-222X", "3333-3333"])
    assert (a.issn_electronic, a.issn_print, a.issn_l, a.abstract) == ("1111-1111", "2222-222X", "3333-3333", "hello world again world")
    assert (a.cited_by_count, a.is_open_access, a.open_access_url, a.open_access_status) == (0, True, "", "gold")
    assert a.subjects == ["t0", "t1", "t2", "t3"] and a.keywords == [f"k{i}" for i in range(9)]
    assert (b.doi, b.authors, b.year, b.issns, b.abstract, b.language, b.subjects) == ("", [], None, [], "", "en", [])
    assert c.year is None and c.language == "fr" and c.pub_date == "n.d."


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_works_of_papers_are_made_without_moving_words(spark):
    """each text has its words' places within its row, as normalisation reads them."""
    texts = ["", " ", "a", "a b a", "b  a\nb é a ", "x " * 500 + "y"]
    rows = spark.createDataFrame(list(enumerate(texts)), "_pos long, text string").select("_pos", adapters.inverted_index(F.col("text")).alias("w"))
    for r in rows.collect():
        places = {}
        for i, w in enumerate(texts[r._pos].split(" ")):
            places.setdefault(w, []).append(i)
        assert r.w == places
    assert [r.t for r in rows.select(works.reconstruct_abstract(F.col("w")).alias("t")).collect()] == texts
    assert exchanges(QUERIES["normalize_work"](spark, "/root/testdata/sf0.001")) == 0


def test_scan_puts_an_abstract_together_once(spark):
    """a query of several words reads the same expression once."""
    plan = works.scan_works(works.normalize_work(adapters.works(spark, "/root/testdata/sf0.001")), works.Scan("the er of", 2012)).select("_pos")
    filters = [x for x in plan._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x]
    assert sum(x.count("map_from_entries") for x in filters) == 1


def test_number_of_works_read_does_not_gather_them(spark):
    """F8: the number of all works comes from a sum, not from a window over all titles."""
    plan = QUERIES["read_works"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan


def test_saved_pages(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"page{i}.json").write_text(json.dumps({"results": [WORK | {"id": f"{i}-{k}"} for k in range(2)], "meta": {}}, indent=1))
    got = works.read_works(spark, str(tmp_path)).orderBy("_pos").collect()
    assert [r.id for r in got] == [f"{i}-{k}" for i in range(3) for k in range(2)] and [r._pos for r in got] == list(range(6))


def test_scan_filters():
    assert works.Scan("a,b", 2020, None, issns=("1111-1111", "2222-2222")).filters() == ["from_publication_date:2020-01-01", "to_publication_date:9999-12-31", "language:en", "has_doi:true", "has_abstract:true", "primary_location.source.issn:1111-1111|2222-2222", "abstract.search:a b"]
    assert works.Scan(language="", has_issn=True).filters() == ["has_doi:true", "has_abstract:true", "primary_location.source.has_issn:true"]


def test_live_source(spark):
    def fetch(filters, cursor, per_page):
        assert per_page == 200
        page = int(cursor.strip("*") or 0)
        rows = [json.dumps({"id": f"{page}-{k}", "language": "en", "publication_date": "2020-01-01", "title": ";".join(filters)}) for k in range(2)]
        return rows, str(page + 1) if page < 2 else None

    works.WorksDataSource.register_fetcher("test", fetch)
    works.WorksDataSource.install(spark)
    read = spark.read.format("works").option("fetcher", "test").option("query", "nets").option("year_from", "2019")
    got = works.parse_works(read.load()).orderBy("_pos").collect()
    assert [r.id for r in got] == ["0-0", "0-1", "1-0", "1-1", "2-0", "2-1"]
    assert got[0].title.endswith("abstract.search:nets") and "language:en" in got[0].title
    assert works.parse_works(read.option("max_scan", "3").load()).count() == 3
    reader = works.WorksReader({"language": "en"}, fetch)
    from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual

    kept = list(reader.pushFilters([EqualTo(("language",), "fr"), GreaterThanOrEqual(("publication_date",), "2018-01-01"), GreaterThan(("_pos",), 3)]))
    assert kept == [GreaterThan(("_pos",), 3)] and reader.pushed == ["language:fr", "from_publication_date:2018-01-01"]
    assert next(iter(reader.read(None)))[0] == 0


BIB = """@comment{x} @article{a, title = {A {nested, doi = {10.9/no}} b}, DOI = {10.1/DUP}}
@book{b, doi = "10.1/dup", year = 2020 }
@misc(c, Doi=10.2/bare, note = "x")
@misc{d, doi = {}}
"""


@pytest.mark.parametrize("given, expected", [(BIB, ["10.1/DUP", "10.2/bare"]), ("no entries", []), ("@article{a, doi = {10.1234/x} , title = {never ends 10.5555/y", ["10.1234/x", "10.5555/y"]), (None, [])])
def test_bib(spark, given, expected):
    assert doi_lists.read_bib_dois(spark.createDataFrame([(given,)], "text string")).first().dois == expected


@pytest.mark.parametrize("given, suffix, expected", [("a 10.1234/x. b", ".txt", ["10.1234/x"]), ("# c\n one \n\ntwo", ".csv", ["one", "two"]), ("one", ".log", []), (None, "", [])])
def test_doi_lists(spark, given, suffix, expected):
    assert spark.createDataFrame([(given,)], "t string").select(doi_lists.read_doi_text(F.col("t"), suffix).alias("d")).first().d == expected


def test_doi_arguments(spark):
    assert spark.sql("SELECT ' 10.1/a, ,10.1/b' AS t").select(doi_lists.dois_argument(F.col("t")).alias("d")).first().d == ["10.1/a", "10.1/b"]
    with pytest.raises(ValueError):
        doi_lists.read_doi_text(F.col("t"), ".md")


def test_read_works_by_line_and_by_file(spark, tmp_path):
    """Several documents a file, one document a file over many lines, and blank lines."""
    import json

    page = lambda *names: {"results": [WORK | {"title": n} for n in names], "meta": {}}
    (tmp_path / "a.json").write_text("\n".join([json.dumps(page("a0", "a1")), "", json.dumps(page()), json.dumps(page("a2"))]))
    (tmp_path / "b.json").write_text(json.dumps(page("b0", "b1"), indent=2))
    (tmp_path / "c.json").write_text(json.dumps(page("c0")) + "\n" + json.dumps(page("c1", "c2")) + "\n")
    got = works.read_works(spark, str(tmp_path)).orderBy("_pos").collect()
    assert [(r._pos, r.title) for r in got] == list(enumerate(["a0", "a1", "a2", "b0", "b1", "c0", "c1", "c2"]))


def test_registered_exporter(spark, tmp_path):
    from pyspark.sql import functions as F

    from quire.schema import canonical

    formats.register_exporter(formats.Exporter("titles", ".txt", lambda n: F.concat(n.cast("string"), F.lit(" "), "title"), ("t",), True, lambda papers: ["all titles"], True))
    papers = canonical(spark.createDataFrame([(5, "b"), (2, "a")], "_pos long, title string"))
    assert formats.get_exporter("T").export_to_file(papers, tmp_path / "out.txt").read_text() == "all titles\n1 a\n2 b\n"
    formats.get_exporter(".txt").export_to_folder(papers, str(tmp_path / "parts"))
    parts = sorted(p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part-"))
    assert "".join(p.read_text() for p in parts) == "all titles\n1 a\n2 b\n"
