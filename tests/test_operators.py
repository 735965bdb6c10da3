import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import collections, dedup, journals, rules
from quire.plans import pipelines
from quire.schema import canonical
from quire.sources.works import Scan, search_stats, take_accepted
from quire.tables import Scratch

BASE = {"doi": "10.1000/test", "title": "Test paper", "authors": ["Smith J."], "year": 2023}


def papers(spark, *rows):
    ddl = "_pos long, doi string, title string, authors array<string>, year int, cited_by_count long, quartile string, scopus_indexed boolean, abstract string, keywords array<string>, language string, is_open_access boolean, issn_electronic string, issn_print string, issn_l string, issns array<string>, pub_date string"
    names = [f.split()[0] for f in ddl.split(", ")]
    return canonical(spark.createDataFrame([tuple(({"_pos": i} | BASE | r).get(n) for n in names) for i, r in enumerate(rows)], ddl))


@pytest.mark.parametrize(
    "rule, row, expected",
    [
        (rules.YearRule(min_year=2020), {"year": 2024}, True),
        (rules.YearRule(min_year=2020), {"year": 2019}, False),
        (rules.YearRule(min_year=2020), {"year": None}, False),
        (rules.YearRule(), {"year": None}, False),
        (rules.YearRule(max_year=2025), {"year": 2025}, True),
        (rules.YearRule(max_year=2025), {"year": 2026}, False),
        (rules.CitationRule(10), {"cited_by_count": 15}, True),
        (rules.CitationRule(10), {"cited_by_count": 5}, False),
        (rules.CitationRule(10), {"cited_by_count": None}, False),
        (rules.IndexedRule(), {"scopus_indexed": True}, True),
        (rules.IndexedRule(), {"scopus_indexed": None}, False),
        (rules.QuartileRule(frozenset({"Q1", "Q2"}), False), {"quartile": " q1 "}, True),
        (rules.QuartileRule(frozenset({"Q1", "Q2"}), False), {"quartile": "Q3"}, False),
        (rules.QuartileRule(frozenset({"Q1", "Q2"}), False), {"quartile": "-"}, False),
        (rules.QuartileRule(frozenset({"Q1", "Q2"}), False), {"quartile": ""}, False),
        (rules.QuartileRule(frozenset({"Q1"}), True), {"quartile": "-"}, True),
        (rules.QuartileRule(frozenset({"Q7"}), True), {"quartile": "Q7"}, False),
        (rules.KeywordBlacklist(("preprint", "survey")), {"title": "A preprint on ML"}, False),
        (rules.KeywordBlacklist(("preprint", "survey")), {"abstract": "This is a Survey of..."}, False),
        (rules.KeywordBlacklist(("preprint",)), {"keywords": ["Pre-Print", "x"]}, True),
        (rules.KeywordBlacklist(()), {}, True),
        (rules.KeywordBlacklist(("日本",)), {}, False),
        (rules.KeywordBlacklist(("日本",), ignore_empty=True), {}, True),
        (rules.KeywordWhitelist(("neural network",)), {"title": "Neural-Network approaches"}, True),
        (rules.KeywordWhitelist(("neural network",)), {"title": "Trees"}, False),
        (rules.KeywordWhitelist(("paper smith",)), {"abstract": "smith"}, True),
        (rules.OpenAccessRule(), {"is_open_access": True}, True),
        (rules.OpenAccessRule(), {}, False),
        (rules.LanguageRule(frozenset({"en"})), {"language": "EN"}, True),
        (rules.LanguageRule(frozenset({"EN"})), {"language": "en"}, False),
        (rules.LanguageRule(frozenset({"fr"})), {"language": ""}, True),
        (rules.DoiBlacklist(frozenset({"10.1/a"})), {"doi": " 10.1/A"}, False),
        (rules.DoiBlacklist(frozenset({"10.1/a"})), {"doi": ""}, True),
        (rules.DoiWhitelist(frozenset({"10.1/a"})), {"doi": "10.1/A"}, True),
        (rules.DoiWhitelist(frozenset({"10.1/a"})), {"doi": ""}, False),
        (rules.DoiWhitelist(frozenset()), {"doi": ""}, True),
        (rules.PredicateRule(lambda rows: rows["year"] > 2000, ("year", "doi")), {}, True),
    ],
)
def test_rules(spark, rule, row, expected):
    assert papers(spark, row).select(rule.column().alias("k")).first()["k"] is expected


def test_engine_parts_rows_and_describes(spark):
    engine = rules.build_engine(min_year=2020, min_citations=5, scopus_only=True, quartile="all", language="en,fr", include_dois=[], exclude_keywords=" , ")
    assert [r["name"] for r in engine.describe()] == ["year", "citations", "scopus_only", "language", "exclude_keywords"]
    assert engine.describe()[3]["allowed"] == ["en", "fr"]
    good = {"year": 2024, "cited_by_count": 10, "scopus_indexed": True}
    kept, removed = engine.apply(papers(spark, good, good | {"year": 2019}, good | {"cited_by_count": 1}, good | {"scopus_indexed": False}))
    assert [r._pos for r in kept.collect()] == [0] and sorted(r._pos for r in removed.collect()) == [1, 2, 3]
    assert rules.build_engine(quartile="Q9").rules == [] and rules.build_engine(min_citations=0).rules == []


def test_rules_reach_the_scan(spark, tmp_path):
    papers(spark, {}).write.parquet(str(tmp_path / "p"))
    engine = rules.build_engine(min_year=2011, max_year=2020, min_citations=5, scopus_only=True, open_access_only=True)
    kept = spark.read.parquet(str(tmp_path / "p")).where(engine.column()).select("doi")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan)[1]
    for part in ("GreaterThanOrEqual(year,2011)", "LessThanOrEqual(year,2020)", "GreaterThanOrEqual(cited_by_count,5)", "scopus_indexed", "is_open_access"):
        assert part in pushed
    read = re.search(r"ReadSchema: struct<(.*)>", plan)[1]
    assert {c.split(":")[0] for c in read.split(",")} == {"doi", "year", "cited_by_count", "scopus_indexed", "is_open_access"}


def test_doi_tables(spark):
    rows = papers(spark, {"doi": "10.1/A"}, {"doi": ""}, {"doi": "10.1/b"})
    listed = spark.createDataFrame([("10.1/a ",), (None,)], "d string")
    assert [r._pos for r in rules.include_dois(rows, listed).collect()] == [0]
    assert sorted(r._pos for r in rules.exclude_dois(rows, listed).collect()) == [1, 2]


J5 = [("AI Journal", ["1111-1111"], "Q1", ["Computer Science"]), ("ML Journal", ["2222-2222"], "Q2", ["Computer Science"]), ("Med Journal", ["3333-3333"], "Q1", ["Medicine"]), ("Unranked CS", ["4444-4444"], "-", ["Computer Science"]), ("Q3 CS", ["5555-5555"], "Q3", ["Computer Science"])]
J3 = [("Dual", ["1111-1111", "2222-2222"], "Q1", []), ("Print", ["3333-3333"], "Q2", []), ("Electronic", ["4444-4444"], "Q3", []), ("Late", ["1111-1111", "7777-7777"], "", [])]


def journal_rows(spark, rows):
    return spark.createDataFrame([(i, t, x, q, "", a, []) for i, (t, x, q, a) in enumerate(rows)], "_pos long, title string, issns array<string>, quartile string, open_access string, subject_areas array<string>, sub_categories array<string>")


@pytest.mark.parametrize(
    "subset, expected",
    [
        (journals.IssnFilter(), ["1111-1111", "2222-2222", "3333-3333", "4444-4444", "5555-5555"]),
        (journals.IssnFilter({"computer science"}), ["1111-1111", "2222-2222", "4444-4444", "5555-5555"]),
        (journals.IssnFilter(quartiles={"Q1"}), ["1111-1111", "3333-3333"]),
        (journals.IssnFilter({"Computer Science"}, {"q1"}), ["1111-1111"]),
        (journals.IssnFilter(include_unranked=False), ["1111-1111", "2222-2222", "3333-3333", "5555-5555"]),
        (journals.IssnFilter(quartiles={"Q1", "-"}), ["1111-1111", "3333-3333", "4444-4444"]),
        (journals.IssnFilter({"comput"}), ["1111-1111", "2222-2222", "4444-4444", "5555-5555"]),
        (journals.IssnFilter({"nothing"}), []),
    ],
)
def test_issn_filter(spark, subset, expected):
    rows = journal_rows(spark, J5)
    assert [r.issn for r in subset.build(rows).orderBy("_pos").collect()] == expected
    about = subset.describe(rows)
    assert about["issn_count"] == len(expected) and about["stats"]["total_journals"] == 5


def test_issn_filter_unknown_terms_and_batches(spark):
    rows = journal_rows(spark, J5)
    assert journals.IssnFilter({"Medicine", "comput"}).describe(rows)["stats"]["unmatched_subject_areas"] == ["comput"]
    assert [len(r.issns) for r in journals.batches(journals.IssnFilter().build(rows), 2).orderBy("batch").collect()] == [2, 2, 1]
    twice = journal_rows(spark, [("A", ["1111-1111", "2222-2222"], "Q1", []), ("B", ["1111-1111"], "Q1", [])])
    assert [r.issn for r in journals.IssnFilter().build(twice).orderBy("_pos").collect()] == ["1111-1111", "2222-2222"]
    assert journals.IssnFilter().build(journal_rows(spark, [])).collect() == []


def test_annotate(spark):
    index = journals.issn_index(journal_rows(spark, J3))
    rows = papers(spark, {"issn_print": "33333333"}, {"issns": ["bad", "2222-2222"]}, {"issn_l": "0000-0000", "scopus_indexed": True, "quartile": "zz"}, {"quartile": "q4"}, {"issn_l": "7777-7777", "quartile": "old"}, {"issns": ["4444-4444"], "issn_l": "1111-1111"}, {"quartile": " Q1"})
    marked = journals.annotate(rows, index)
    assert [(r.scopus_indexed, r.quartile) for r in marked.orderBy("_pos").collect()] == [(True, "Q2"), (True, "Q1"), (False, "zz"), (True, "q4"), (True, "old"), (True, "Q3"), (False, " Q1")]
    assert journals.annotate_stats(marked).first().asDict() == {"total": 7, "scopus": 5, "non_scopus": 2, "with_quartile": 4}
    report = {r.requested: (r.found, r.title) for r in journals.issn_report(spark.createDataFrame([("11111111",), ("x",), (None,)], "issn string"), index).collect()}
    assert report == {"11111111": (True, "Dual"), "x": (False, None), None: (False, None)}


def test_annotate_if_needed(spark):
    index = journals.issn_index(journal_rows(spark, J3))
    unmarked, marked = papers(spark, {"issn_l": "1111-1111"}), papers(spark, {"scopus_indexed": True})
    assert journals.annotate_if_needed(unmarked, index, False, True).first().scopus_indexed
    assert not journals.annotate_if_needed(unmarked, index, False, False).first().scopus_indexed
    assert journals.annotate_if_needed(marked, index, False, True).first().scopus_indexed
    assert not journals.annotate_if_needed(marked, index, True, False).first().scopus_indexed


def test_restriction_modes(spark):
    rows = papers(spark, {"issns": ["1111-1111"]}, {"issns": ["9999-9999"]}, {})
    assert [r._pos for r in journals.restrict_by_list(rows, ["11111111"]).collect()] == [0]
    with pytest.raises(ValueError):
        journals.restrict_by_list(rows, [f"{i:04d}-0000" for i in range(101)])
    assert journals.join_mode(0) == "none" and journals.join_mode(100) == "server" and journals.join_mode(101) == "scan"


# ----- dedup -----


def norm(t):
    return re.sub("[^a-z0-9]+", " ", (t or "").lower()).strip()


def similarity(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    x, y = ({s[i : i + 3] for i in range(len(s) - 2)} for s in (a, b))
    return len(x & y) / len(x | y) if x and y else 0.0


def sequential(rows, threshold):
    """Reads (doi, title) in order; True for removed."""
    dois, titles, out = set(), [], []
    for doi, title in rows:
        key = doi.lower().strip()
        if doi and key in dois:
            out.append(True)
            continue
        if doi:
            dois.add(key)
        t = norm(title)
        gone = bool(t) and any(similarity(t, s) >= threshold for s in titles)
        if t and not gone:
            titles.append(t)
        out.append(gone)
    return out


def random_rows(seed, n):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.choice([2, 3, 8, 30, 60, 90]))) for _ in range(n // 6)]
    rows = []
    for _ in range(n):
        t = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            t[rng.randrange(len(t))] = rng.choice("abcde ")
        rows.append((rng.choice(["", "", "", " ", f"10.1/{rng.randrange(n)}", f"10.1/X{rng.randrange(n)}"]), "".join(t)))
    return rows


@pytest.mark.parametrize("seed, threshold", [(1, 0.92), (2, 0.92), (3, 0.8), (4, 1.0), (5, 0.5)])
def test_dedup_equals_the_sequential_pass(spark, seed, threshold):
    rows = random_rows(seed, 240)
    df = papers(spark, *[{"doi": d, "title": t} for d, t in rows])
    marked = {r._pos: r._dup for r in dedup.mark_duplicates(df, ("_pos",), threshold).collect()}
    assert [marked[i] for i in range(len(rows))] == sequential(rows, threshold)
    expected = {}
    for j, (dj, tj) in enumerate(rows):
        for i, (di, ti) in enumerate(rows[:j]):
            s = 1.0 if di and di.lower() == dj.lower() else similarity(norm(ti), norm(tj))
            if s >= threshold:
                expected[i, j] = s
    assert {(r.pos_a, r.pos_b): r.similarity for r in dedup.find_duplicates(df, threshold).collect()} == expected


def test_dedup_cases(spark):
    long = "a study of many things in the natural world and elsewhere beyond the known horizon of human knowledge today"
    near = long.replace("today", "todaz")
    rows = [("10.1/A", "one"), (" 10.1/a ", "two"), ("", "ab"), ("", "ab"), ("", "cd"), ("", "日本"), ("", "日本"), (" ", "x y z"), (" ", "p q r"), ("10.1/k", long), ("10.1/l", near), ("10.1/L", "something else")]
    unique, removed = dedup.dedup(papers(spark, *[{"doi": d, "title": t} for d, t in rows]))
    assert sorted(r._pos for r in removed.collect()) == [1, 3, 8, 10, 11]
    assert unique.count() == 7 and sequential(rows, 0.92) == [i in (1, 3, 8, 10, 11) for i in range(12)]


def test_dedup_groups_first_group_wins(spark):
    df = papers(spark, {"doi": "10.1/a", "title": "t one"}, {"doi": "10.1/b", "title": "t two"}, {"doi": "10.1/A", "title": "t three"}).withColumn("group", F.when(F.col("_pos") == 2, "g0").otherwise("g1")).withColumn("group_pos", F.when(F.col("_pos") == 2, 0).otherwise(1))
    unique, removed = dedup.dedup_groups(df)
    assert [(r.group, r._pos) for r in removed.collect()] == [("g1", 0)] and unique.count() == 2


def test_dedup_empty(spark):
    empty = papers(spark, {}).limit(0)
    assert dedup.mark_duplicates(empty).collect() == [] and dedup.find_duplicates(empty).collect() == []


def test_distinct_first(spark):
    rows = spark.createDataFrame([(0, "A"), (1, "a"), (2, "b")], "_pos long, d string")
    assert sorted((r._pos, r.d) for r in dedup.distinct_first(rows, F.lower("d")).collect()) == [(0, "A"), (2, "b")]


# ----- limits, counts, pipelines -----


def test_scan_limits(spark):
    rows = papers(spark, *[{"cited_by_count": i % 2} for i in range(20)])
    odd = F.col("cited_by_count") == 1
    take = lambda *a: [r._pos for r in take_accepted(rows, odd, *a).collect()]
    stat = lambda *a: tuple(search_stats(rows, odd, *a).first())
    assert take(3, 0) == [1, 3, 5] and stat(3, 0) == (6, 3, False)
    assert take(0, 6) == [1, 3, 5] and stat(0, 6) == (6, 3, True)
    assert take(3, 6) == [1, 3, 5] and stat(3, 6) == (6, 3, False)
    assert take(4, 6) == [1, 3, 5] and stat(4, 6) == (6, 3, True)
    assert stat(0, 0) == (20, 10, False) and stat(0, 30) == (20, 10, False)


def test_groups(spark):
    df = papers(spark, {"doi": "10.1/a"}, {"doi": "10.1/b"}, {"doi": "10.1/c"}).withColumn("group", F.when(F.col("_pos") < 2, "g1").otherwise("g2")).withColumn("group_pos", F.when(F.col("_pos") < 2, 1).otherwise(0))
    assert {r["group"]: r.n for r in collections.group_total(df).collect()} == {"g1": 2, "g2": 1}
    assert [r.doi for r in collections.flatten_groups(df).orderBy("_pos").collect()] == ["10.1/c", "10.1/a", "10.1/b"]
    packed = {r["group"]: r.papers for r in collections.groups_to_json(df, ["doi", "year"]).collect()}
    assert packed["g1"] == '[{"doi":"10.1/a","year":2023},{"doi":"10.1/b","year":2023}]'


def test_filter_pipeline(spark):
    rows = papers(spark, {"doi": "10.1/a", "title": "alpha beta gamma", "cited_by_count": 9}, {"doi": "10.1/A", "cited_by_count": 9}, {"doi": "10.1/b", "cited_by_count": 1}, {"doi": "10.1/c", "title": "quite another title", "cited_by_count": 7, "scopus_indexed": True})
    result = pipelines.filter_papers(rows, rules.build_engine(min_citations=5))
    assert sorted(r._pos for r in result.kept.collect()) == [0, 3]
    assert {(r._pos, r._by) for r in result.removed.collect()} == {(1, "dedup"), (2, "rules")}
    assert result.counts.first().asDict() == {"input_count": 4, "kept": 2, "removed": 2, "dedup_removed": 1, "kept_indexed": 1}
    with pytest.raises(pipelines.NoResult):
        pipelines.filter_papers(rows, rules.build_engine(min_citations=500))


@pytest.mark.parametrize("broadcast", [0, 300_000])
@pytest.mark.parametrize("copies", [1, 9])
def test_filter_pipeline_writes_papers_once(spark, monkeypatch, broadcast, copies):
    """Whole papers are in one table, whichever of kept and removed ones are fewer, and without duplicates being looked for."""
    monkeypatch.setattr(pipelines, "BROADCAST_ROWS", broadcast, raising=False)
    rows = papers(spark, *[{"doi": f"10.1/{i}", "title": f"title {i * 1111111}", "cited_by_count": 9} for i in range(4)], *[{"doi": "10.1/0", "cited_by_count": 9} for _ in range(copies)], {"doi": "10.1/0", "cited_by_count": 1})
    with Scratch() as scratch:
        result = pipelines.filter_papers(rows, rules.build_engine(min_citations=5))
    assert len([p for p in scratch.paths if "abstract" in spark.read.parquet(p).columns]) == 1
    assert sorted(r._pos for r in result.kept.collect()) == [0, 1, 2, 3]
    assert sorted((r._pos, r._by) for r in result.removed.collect()) == [*((4 + i, "dedup") for i in range(copies)), (4 + copies, "rules")]
    assert result.counts.first().asDict() == {"input_count": 5 + copies, "kept": 4, "removed": 1 + copies, "dedup_removed": copies, "kept_indexed": 0}
    whole = pipelines.filter_papers(rows, rules.build_engine(min_citations=5), deduplicate=False)
    assert whole.kept.count() == 4 + copies and whole.removed.count() == 1


def strict(word):
    """A composition that no text with ``word`` may reach."""

    def compose(values):
        import pyarrow as pa

        texts = values.to_pylist()
        if any(word in (t or "") for t in texts):
            raise ValueError(word)
        return pa.array(texts, pa.string())

    compose.__annotations__ = {"values": pa.Array, "return": pa.Array}
    return compose


@pytest.mark.parametrize("n", [1, rules.CONTAINS + 1])
def test_texts_are_searched_where_the_cheap_rules_hold(spark, monkeypatch, n):
    """Python functions are given texts of papers that only the keywords can still remove, on whichever side of the others the rule stands."""
    monkeypatch.setattr(text, "_compose", strict("costly"))
    df = papers(spark, {"abstract": "caf\u00e9 costly", "cited_by_count": 1}, {"abstract": "caf\u00e9 nets", "cited_by_count": 9}, {"abstract": "caf\u00e9 graphs", "cited_by_count": 9}, {"abstract": None, "cited_by_count": 9}, {"abstract": "nets", "cited_by_count": 1})
    words = ("nets", *(f"word{i}" for i in range(n - 1)))
    for engine in (rules.build_engine(min_citations=5, exclude_keywords=",".join(words)), rules.FilterEngine([rules.KeywordBlacklist(words), rules.CitationRule(5)])):
        marked = {r._pos: r._keep for r in engine.mark(df).collect()}
        assert marked == {0: False, 1: False, 2: True, 3: True, 4: False}
    both = rules.build_engine(min_citations=5, exclude_keywords=",".join(words), include_keywords="graphs")
    assert [r._pos for r in both.apply(df)[0].collect()] == [2]


@pytest.mark.parametrize("broadcast", [0, 300_000])
@pytest.mark.parametrize("copies", [1, 9])
def test_titles_are_normalised_where_the_doi_leaves_open(spark, monkeypatch, broadcast, copies):
    monkeypatch.setattr(text, "_compose", strict("costly"))
    monkeypatch.setattr(dedup, "BROADCAST_ROWS", broadcast)
    rows = papers(spark, *[{"doi": f"10.1/{i}", "title": f"\u00e9 {i * 1111111}"} for i in range(3)], {"doi": "", "title": "\u00e9 1111111"}, {"doi": "", "title": "\u00e9"}, {"doi": None, "title": None}, *[{"doi": " 10.1/0", "title": "\u00e9 costly"} for _ in range(copies)])
    unique, removed = dedup.dedup(rows)
    assert sorted(r._pos for r in unique.collect()) == [0, 1, 2, 4, 5]
    assert sorted(r._pos for r in removed.collect()) == [3, *range(6, 6 + copies)]


@pytest.mark.parametrize("columns", [(), ("doi", "title"), ("scopus_indexed", "abstract")])
def test_filter_pipeline_writes_what_is_asked_for(spark, columns):
    """Of the columns not asked for, only titles and DOIs of papers that the rules keep are written; the results are the same."""
    rows = papers(spark, {"doi": "10.1/a", "title": "alpha beta gamma", "cited_by_count": 9, "scopus_indexed": True}, {"doi": "10.1/A", "cited_by_count": 9}, {"doi": "10.1/b", "cited_by_count": 1, "title": "gone by rules"})
    whole = pipelines.filter_papers(rows, rules.build_engine(min_citations=5))
    with Scratch() as scratch:
        result = pipelines.filter_papers(rows, rules.build_engine(min_citations=5), columns=columns)
    first = spark.read.parquet(scratch.paths[0])
    assert set(first.columns) == {"_pos", "doi", "title", "scopus_indexed", "_keep", *columns}
    assert first.where("title = 'gone by rules'").count() == ("title" in columns)
    assert result.kept.columns == ["_pos", *columns] and result.removed.columns == ["_pos", *columns, "_by"]
    assert result.kept.collect() == whole.kept.select("_pos", *columns).collect()
    assert sorted(result.removed.collect()) == sorted(whole.removed.select("_pos", *columns, "_by").collect())
    assert result.counts.collect() == whole.counts.collect()


def test_search_pipeline_modes(spark):
    rows = papers(spark, *[{"doi": f"10.1/{i}", "abstract": "deep nets" if i % 2 else "other", "pub_date": f"20{10 + i}-01-15", "issns": [f"{1000 + i}-0000"]} for i in range(8)])
    plain = pipelines.search(rows, Scan("nets", 2011, 2016))
    assert [r._pos for r in plain.papers.collect()] == [1, 3, 5] and plain.mode == "none"
    listed = pipelines.search(rows, Scan("nets"), issns=["1003-0000", "1004-0000"])
    assert [r._pos for r in listed.papers.collect()] == [3] and listed.mode == "server"
    many = journal_rows(spark, [(f"J{i}", [f"{1000 + i}-0000"], "Q1", ["X"]) for i in range(3, 150)])
    scanned = pipelines.search(rows, Scan("nets"), many, journals.IssnFilter({"x"}), max_scan=3)
    assert scanned.mode == "scan" and [r._pos for r in scanned.papers.collect()] == [3, 5]
    assert scanned.stats.first().asDict() == {"scanned": 3, "matched": 2, "scan_capped": True}
    assert all(r.quartile == "Q1" for r in scanned.papers.collect())
    with pytest.raises(pipelines.NoResult):
        pipelines.search(rows, Scan(), many, journals.IssnFilter({"none such"}))


def test_validate_pipeline(spark):
    rows = papers(spark, {"doi": "10.1/a", "issn_l": "1111-1111"}, {"doi": "10.1/b"})
    asked = spark.createDataFrame([(" 10.1/A",), ("10.1/zz",), ("no doi",)], "doi string")
    result = pipelines.validate(asked, rows, journals.issn_index(journal_rows(spark, J3)))
    assert [r.work.quartile for r in result.found.collect()] == ["Q1"]
    assert sorted((r.doi, r.error) for r in result.errors.collect()) == [("10.1/zz", "not_found"), ("no doi", "not_found")]
    assert result.counts.first().asDict() == {"input_count": 3, "found": 1, "scopus_count": 1}


def test_doi_rules_from_tables_and_long_lists(spark):
    df = papers(spark, {"doi": "10.1/A "}, {"doi": ""}, {"doi": "10.1/b"}, {"doi": "10.1/c"})
    table = spark.createDataFrame([("10.1/a",), ("10.1/a",), (None,), ("10.1/C",)], "d string")
    long = [f"10.9/{i}" for i in range(rules.IN_LIST)] + ["10.1/a", "10.1/c"]
    for listed in (table, long, ["10.1/a", "10.1/c"]):
        kept, removed = rules.build_engine(exclude_dois=listed).apply(df)
        assert sorted(r.doi for r in kept.collect()) == ["", "10.1/b"] and kept.columns == df.columns == removed.columns
        kept, removed = rules.build_engine(include_dois=listed, exclude_dois=["10.1/c"]).apply(df)
        assert [r.doi for r in kept.collect()] == ["10.1/A "] and removed.count() == 3


def test_duplicate_classes_say_what_all_pairs_say(spark):
    titles = ["a long title on many things", "a long title on many things", "a long title on many thing", "other", "", None, "other"]
    df = papers(spark, *[{"doi": d, "title": t} for d, t in zip(["10.1/a", "", "10.1/b", "10.1/B", "10.1/c", "", ""], titles, strict=True)])
    members, links = dedup.duplicate_classes(df, 0.9)
    own = {r._pos: (r.by_doi, r.by_title) for r in members.collect()}
    near = {(r.a, r.b) for r in links.collect()}
    title = lambda x: -1 if own[x][1] is None else own[x][1]
    same = lambda x, y, k: own[x][k] is not None and own[x][k] == own[y][k]
    pairs = {(x, y) for x in own for y in own if x < y and (same(x, y, 0) or same(x, y, 1) or tuple(sorted((title(x), title(y)))) in near)}
    assert pairs == {(r.pos_a, r.pos_b) for r in dedup.find_duplicates(df, 0.9).collect()}


@pytest.mark.parametrize("threshold", [0.5, 0.75, 0.92, 1.0])
def test_size_classes_hold_all_similar_sizes(threshold):
    alone, least, parts = dedup.size_classes(threshold, 300)
    place = lambda n: sum(x <= n for x in least)
    for n in range(1, 250):
        for m in range(n, 250):
            if n >= threshold * m and n != m:
                assert n > alone and place(m) - place(n) in (0, 1)
                # the most elements that two such sets may differ in
                assert (n + m) * (1 - threshold) / (1 + threshold) < parts[place(m) - 1]


def test_scratch_tables_go(spark):
    from quire.tables import Scratch, materialise

    with Scratch() as outer:
        with Scratch() as inner:
            one = materialise(spark.range(5), "one")
        two = materialise(spark.range(3), "two")
    assert inner.feeds(one) and not inner.feeds(two) and outer.feeds(two.where("id > 1"))
    inner.drop(spark)
    assert two.count() == 3 and not inner.paths and len(outer.paths) == 1
    with pytest.raises(Exception):  # noqa: B017
        materialise(one, "none").count()


def _greedy(edges):
    lost = set()
    for node in sorted({x for e in edges for x in e}):
        if node not in lost:
            lost |= {b for a, b in edges if a == node}
    return lost


@pytest.mark.parametrize("most", [1_000_000, 1000, 10])
def test_greedy_pass_over_links(spark, most):
    """Chains, families and random links, settled at once, by component, or round by round."""
    rng = random.Random(most)
    chain = [(k, k + 1) for k in range(1000 if most >= 1000 else 12)]
    family = [(2000 + a, 2000 + b) for a in range(9) for b in range(a + 1, 9)]
    other = [(3000 + a, 3000 + b) for a, b in ((rng.randrange(40), rng.randrange(40)) for _ in range(45)) if a < b]
    edges = sorted({*chain, *family, *other})
    got = dedup.independent(spark.createDataFrame(edges, "early long, late long"), most)
    assert sorted(r.late for r in got.collect()) == sorted(_greedy(edges))
    assert dedup.independent(spark.createDataFrame([], "early long, late long")).count() == 0


def test_a_family_takes_comparisons_in_proportion(spark, monkeypatch):
    """Of near copies every title is compared with the first of its lists, not with all others."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(50)]
    body = " ".join(words)
    rows = [(k, "", f"{body} v{k}") for k in range(400)] + [(400 + k, "", " ".join("".join(rng.choices("klmnop", k=5)) for _ in range(20))) for k in range(30)]
    compared = []
    check = dedup._verified
    monkeypatch.setattr(dedup, "_verified", lambda pairs, sets, t: (compared.append(pairs.count()), check(pairs, sets, t))[1])
    unique, removed = dedup.dedup(spark.createDataFrame(rows, "_pos long, doi string, title string"))
    assert unique.count() == 31 and removed.count() == 399
    assert sum(compared) < 3 * 430


def test_pivots_equal_the_sequential_pass(spark, monkeypatch):
    """Families that overlap in part, where a removed title does not remove in its turn."""
    monkeypatch.setattr(dedup, "SHORT_LIST", 3)
    rng = random.Random(11)
    base = [["".join(rng.choices("abcdefgh", k=4)) for _ in range(40)] for _ in range(4)]
    rows = []
    for k in range(160):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            words[rng.randrange(40)] = "".join(rng.choices("abcdefgh", k=4))
        rows.append((k, "", " ".join(words)))
    kept = []
    sets = {k: {t[i : i + 3] for i in range(len(t) - 2)} for k, _, t in rows}
    for k, _, t in rows:
        if not any(t == rows[j][2] or len(sets[k] & sets[j]) >= 0.92 * len(sets[k] | sets[j]) for j in kept):
            kept.append(k)
    frame = spark.createDataFrame(rows, "_pos long, doi string, title string")
    assert sorted(r._pos for r in dedup.dedup(frame)[0].collect()) == kept and 4 < len(kept) < 160


def test_likeness_of_texts_in_batches(spark):
    """texts beyond ASCII, short, empty and null ones; no array of strings for a text."""
    texts = [None, "", "a", "ab", "abc", "abcabc", "abcd", "é中🙂x", "é中🙂xy", "a\x00b\x00c", "the same words", "the same word"]
    pairs = [(a, b) for a in texts for b in texts] + [("abcdef" * 50, "abcdeg" * 50)] * 150
    rows = spark.createDataFrame([(n, *p) for n, p in enumerate(pairs)], "n long, a string, b string").select("n", dedup.jaccard3(F.col("a"), F.col("b")).alias("v"))
    cut = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}

    def expected(a, b):
        if not a or not b:
            return 0.0
        return 1.0 if a == b else len(cut(a) & cut(b)) / len(cut(a) | cut(b)) if cut(a) & cut(b) else 0.0

    assert [r.v for r in rows.orderBy("n").collect()] == [expected(*p) for p in pairs]
    assert "array_distinct" not in rows._jdf.queryExecution().optimizedPlan().toString()
