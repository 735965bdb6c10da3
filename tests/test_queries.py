import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from quire.plans import adapters
from quire.plans.queries import ORACLES, QUERIES
from quire.tables import Scratch

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        source = f"{path}/*.parquet" if path.is_dir() else path
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{source}')")
    return connection


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, db, name):
    found = db.sql(ORACLES[name])
    columns = sorted(found.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == columns
    place = [found.columns.index(c) for c in columns]
    expected = sorted(repr([r[i] for i in place]) for r in found.fetchall())
    assert sorted(repr([r[c] for c in columns]) for r in got.collect()) == expected


@pytest.mark.parametrize("name", ["filter_counts", "union_removed"])
def test_filter_queries_write_no_text_of_papers_that_the_rules_remove(spark, name):
    with Scratch() as scratch:
        QUERIES[name](spark, SF)
    tables = [spark.read.parquet(p) for p in scratch.paths]
    assert not any({"abstract", "keywords", "url"} & set(t.columns) for t in tables)
    marked = next(t for t in tables if "_keep" in t.columns)
    assert marked.where("NOT _keep AND (title IS NOT NULL OR doi IS NOT NULL)").isEmpty()
    assert marked.where("_keep AND title IS NULL").isEmpty() and not marked.where("NOT _keep").isEmpty()


@pytest.mark.parametrize("most", [0, adapters.LABELS])
def test_texts_do_not_move_for_their_labels(spark, db, monkeypatch, most):
    """Nor where Spark would not broadcast the labels by itself; with too many of them the result is the same."""
    monkeypatch.setattr(adapters, "LABELS", most)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = adapters.papers(spark, SF).select("_pos", "title", "scopus_indexed")
        plan = rows._jdf.queryExecution().executedPlan().toString()
        got = sorted(map(tuple, rows.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert ("hashpartitioning" in plan) == (most == 0)
    assert got == sorted(db.sql(f"SELECT _pos, title, scopus_indexed FROM ({adapters.PAPERS})").fetchall())


def test_every_paper_is_asked_for(spark, db):
    n = db.sql("SELECT count(*) FROM documents").fetchall()[0][0]
    assert QUERIES["doi_enrich"](spark, SF).count() == n
    assert QUERIES["validate_counts"](spark, SF).first()["input_count"] == n


def test_texts_are_compared_beyond_80_characters(spark, tmp_path):
    """Brute force over texts that agree in their first 80 characters, and near copies that differ early."""
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu") for b in ("ra", "se", "ti", "vo", "wy")]
    body = " ".join(f"{x}{y}" for x in words for y in words[::3])
    texts = [f"{body[:100]} {body[k:]}" for k in (0, 700)] + [body, f"zzz {body}", "other text"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(11 * i, t, "en", "s", len(t)) for i, t in enumerate(texts)], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality long, toxic long").write.parquet(f"{tmp_path}/labels.parquet")
    sets = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    expected = {(11 * i, 11 * j) for i in range(5) for j in range(i + 1, 5) if len(sets[i] & sets[j]) >= 0.92 * len(sets[i] | sets[j])}
    assert (22, 33) in expected and (0, 11) not in expected
    assert {(r.pos_a, r.pos_b) for r in QUERIES["find_duplicates"](spark, str(tmp_path)).collect()} == expected


def test_entry_imports_without_the_training_data_operators(tmp_path):
    """Only what is left counts once that subpackage and the pipeline are gone."""
    import shutil

    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "spark-warehouse", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dedup' in q and not any(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
