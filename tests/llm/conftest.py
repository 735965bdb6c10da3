import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, kept string, host string, uid string, fp string"

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns with clashing names."""
    sentence = " ".join(WORDS)
    long = " ".join(f"{w}{i}" for i in range(3000) for w in WORDS[:7])
    near = " ".join(f"w{i}" for i in range(400))
    rows = [
        (1, sentence, "en", "a"),
        (2, sentence.replace(" ", "  \t"), "en", "a"),
        (2, sentence.replace(" ", "  \t"), "en", "a"),
        (3, " " + sentence, "en", "b"),
        (4, "", "en", "b"),
        (5, None, "en", None),
        (None, sentence, None, None),
        (None, None, None, None),
        (6, long, "en", "a"),
        (7, long + " tail", "en", "b"),
        (8, near, "en", "c"),
        (9, near.replace("w200 ", "x200 "), "en", "c"),
        (10, "one two", "en", "c"),
        (11, "One TWO", "en", "c"),
        (12, "café ÉA naïve 中文 <|endoftext|> <|ENDOFTEXT|> don't", "fr", "c"),
        (13, ("red blue green white black " * 30).strip(), "en", "d"),
        (14, "line of a few words here\n" * 5 + "and a last one # $ %", "en", "d"),
        (15, "\x00\x1c\x85  odd spaces", "en", "d"),
    ]
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", "z", "u", "f") for r in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"
