import pytest
from pyspark.sql import functions as F

from quire.functions import doi, issn, paper, text
from quire.schema import PAPER_FIELDS, canonical


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("given, expected", [("0007-9235", "0007-9235"), ("00079235", "0007-9235"), (" 1234-567x ", "1234-567X"), ("\t1234-5678\n", "1234-5678"), ("not-an-issn", ""), ("", ""), (None, ""), ("1234-56789", ""), ("12345-678", "")])
def test_normalize_issn(spark, given, expected):
    assert one(spark, issn.normalize_issn(F.col("x")), x=given) == expected


@pytest.mark.parametrize("given, expected", [("1234-5678, garbage, 9876-5432", ["1234-5678", "9876-5432"]), ("1234-5678|12345678;1234-567x/9876-5432", ["1234-5678", "1234-567X", "9876-5432"]), ("", []), (None, [])])
def test_split_issns(spark, given, expected):
    assert one(spark, issn.split_issns(F.col("x")), x=given) == expected
    assert issn.plain_issns(given) == expected
    assert one(spark, issn.split_issn_list(F.col("x")), x=[given, given, "bad"]) == expected


def test_extract_dois(spark):
    free = "See 10.1000/abc123, and 10.1038/nature12373. Also https://doi.org/10.1234/test.5678. Again 10.1000/ABC123"
    assert one(spark, doi.extract_dois(F.col("x")), x=free) == ["10.1000/abc123", "10.1038/nature12373", "10.1234/test.5678"]
    assert one(spark, doi.extract_dois(F.col("x")), x=None) == []
    assert one(spark, doi.extract_dois(F.col("x")), x="10.123/too-short 10.1234567890/too-long") == []


@pytest.mark.parametrize("own, other, expected", [("10.1/A", " 10.1/a ", True), ("", "", False), (None, "10.1/a", False), ("10.1/a", "10.1/b", False)])
def test_matches_doi(spark, own, other, expected):
    assert one(spark, doi.matches_doi(F.col("a"), F.col("b")), a=own, b=other) is expected


@pytest.mark.parametrize(
    "given, expected",
    [("Deep-Learning: A_Survey!", "deep learning a survey"), ("Café", "caf"), ("Ｆｕｌｌ ｗｉｄｔｈ", "full width"), ("ﬁne x²", "fine x2"), ("ét", "t"), ("データ", ""), ("", ""), (None, ""), ("a  b", "a b")],
)
def test_normalize_text(spark, given, expected):
    assert one(spark, text.normalize_text(F.col("x")), x=given) == expected
    assert text.normalize_plain(given) == expected


@pytest.mark.parametrize("given, expected", [("Deep Learning for Finance", "deep-learning-for-finance"), ("LSTM & Bitcoin price!", "lstm-bitcoin-price"), ("", "search"), (None, "search"), ("a" * 50, "a" * 40), ("word " * 20, "word-word-word-word-word-word-word-word"), ("データ", "search")])
def test_slugify(spark, given, expected):
    from quire.control.names import slug

    assert one(spark, text.slugify(F.col("x")), x=given) == expected
    assert slug(given) == expected


def test_shingles_and_csv(spark):
    assert one(spark, text.shingles(F.col("x")), x="aaab") == ["aaa", "aab"]
    assert one(spark, text.shingles(F.col("x")), x="ab") == []
    assert one(spark, text.parse_csv(F.col("x")), x=" a, ,b ,") == ["a", "b"]
    assert one(spark, text.truncate_ellipsis(F.col("x"), 3), x="abcd") == "abc..."
    assert one(spark, text.truncate_ellipsis(F.col("x"), 3), x="abc") == "abc"


@pytest.mark.parametrize("given, expected", [("John Smith", "Smith"), ("Smith, John", "Smith"), ("Smith J.", "Smith"), ("J.", "J"), ("", ""), (None, ""), ("Madonna", "Madonna"), ("  Van  Dyke Q , ", "Dyke"), ("A B", "A")])
def test_last_name(spark, given, expected):
    assert one(spark, paper.last_name(F.col("x")), x=given) == expected


@pytest.mark.parametrize("first, last, expected", [("100", "120", "100--120"), ("100", "100", "100"), ("100", "", "100"), ("", "120", "")])
def test_pages(spark, first, last, expected):
    assert one(spark, paper.pages(F.col("a"), F.col("b")), a=first, b=last) == expected


@pytest.mark.parametrize("authors, expected", [([], "Unknown"), (["Smith J."], "Smith"), (["Smith J.", "Ann Jones"], "Smith and Jones"), (["Smith J.", "b", "c"], "Smith et al.")])
def test_short_authors(spark, authors, expected):
    assert one(spark, paper.short_authors(F.col("a")), a=authors) == expected


def test_citation_key(spark):
    key = lambda **v: one(spark, paper.citation_key(F.col("a"), F.col("y"), F.col("d"), F.col("doi"), F.lit(4)), **v)
    assert key(a=["O'Brien, X"], y=2024, d="", doi=" 10.1/A ") == key(a=["OBrien"], y=2024, d="", doi="10.1/a")
    assert key(a=["O'Brien, X"], y=2024, d="", doi="").startswith("obrien2024_idx4")
    assert key(a=[], y=0, d="2021-05-01", doi="") == "unknown2021_idx4"
    assert key(a=["李"], y=0, d="", doi="") == "unknownnodate_idx4"


def test_canonical_fills_and_drops(spark):
    row = canonical(spark.createDataFrame([(3, None, "x")], "_pos int, title string, other string")).first().asDict()
    assert set(row) == {"_pos", *(n for n, _, _ in PAPER_FIELDS)}
    assert row["title"] == "" and row["authors"] == [] and row["year"] is None and row["language"] == "en" and row["cited_by_count"] == 0
