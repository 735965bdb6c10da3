import math
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from test_dedup import brute_components, brute_fingerprint
from test_quality_packing import brute_counters, check_pieces

import corpus_pipeline
from quire.llm import mixing, quality
from quire.llm.queries import ORACLE_SQL, QUERIES
from quire.llm.runtime import DOCUMENT_COLUMNS, Scratch, materialise
from quire.tables import shared_dir

INT = "doc_id long, source string"


def check_mix(rows, quota, block=mixing.BLOCK_DOCS):
    """Blocks are full but a source's last, one block a slot, and shares are less than a block off while all sources last."""
    order = sorted(rows, key=lambda r: (r.slot, r.seat))
    assert len({(r.slot, r.seat) for r in rows}) == len(rows)
    sizes = Counter((r.source, r.block) for r in rows)
    for source in {r.source for r in rows}:
        mine = [sizes[source, b] for b in range(sum(s == source for s, _ in sizes))]
        assert all(n == block for n in mine[:-1]) and mine[-1] > 0
    slots = {}
    for r in order:
        assert r.release <= r.slot < r.deadline
        assert slots.setdefault(r.slot, (r.source, r.block)) == (r.source, r.block)
    last = {s: max(t for t, (x, _) in slots.items() if x == s) for s, _ in slots.values()}
    done = Counter()
    for t in range(min(last.values()) + 1):
        if t in slots:
            done[slots[t][0]] += 1
        for s, w in quota.items():
            assert abs(done[s] - w * (t + 1)) < 1, (t, s)


@pytest.mark.parametrize("weights", [{"a": 5, "b": 3, "c": 2}, {"a": 1, "b": 1, "c": 1}, {"a": 97, "b": 2, "c": 1}])
def test_shares_stay_within_a_block(spark, weights):
    rows = [(i, "abc"[i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, INT)
    got = mixing.mix(df, weights, block_docs=8).select("row.doc_id", "source", "block", "slot", "seat", "release", "deadline").collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in rows]
    shares = {r.source: Fraction(r.a, r.q) for r in mixing.lanes(df.groupBy("source").count().withColumnRenamed("count", "n"), weights).collect()}
    assert sum(shares.values()) == 1
    assert shares == {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}
    check_mix(got, shares, 8)


def test_given_weights_are_exact(spark):
    sizes = spark.createDataFrame([("a", 5), ("b", 9), ("c", 1), (None, 4), ("d", 4)], "source string, n long")
    shares = lambda *a, **b: {r.source: Fraction(r.a, r.q) for r in mixing.lanes(sizes, *a, **b).collect()}
    assert shares({"a": 0.0001, "b": 0.4999, "c": 0.25, None: 0.125, "d": 0.125, "absent": 7}) == {"a": Fraction(1, 10000), "b": Fraction(4999, 10000), "c": Fraction(1, 4), None: Fraction(1, 8), "d": Fraction(1, 8)}
    # those without a weight have the smallest one, or what is given for the rest
    assert shares({"a": 2, "b": 3}) == {"a": Fraction(2, 11), "b": Fraction(3, 11), "c": Fraction(2, 11), None: Fraction(2, 11), "d": Fraction(2, 11)}
    assert shares({"a": 2, None: 3}, rest=0.5) == {"a": Fraction(4, 13), "b": Fraction(1, 13), "c": Fraction(1, 13), None: Fraction(6, 13), "d": Fraction(1, 13)}
    # no period is as long as these ask for: rounded to the longest
    odd = shares({"a": 0.123456789, "b": 0.7654321234, "c": 1e-9, None: 0.1, "d": 0.01})
    assert sum(odd.values()) == 1 and odd["c"] <= Fraction(2, mixing.LONGEST) and abs(odd["a"] - Fraction("0.123456789") / Fraction("0.9988889134")) < Fraction(2, mixing.LONGEST)
    with pytest.raises(ValueError, match="above zero"):
        shares({"a": 0, "b": 1})
    # the smallest source has a slot of its own share, not more
    skewed = spark.createDataFrame([("big", 9 * 10**10), ("small", 1)], "source string, n long")
    assert {(r.source, r.a, r.q) for r in mixing.lanes(skewed).collect()} == {("big", 300_000, 300_001), ("small", 1, 300_001)}
    beyond = spark.createDataFrame([("big", 10**14), ("small", 1)], "source string, n long")
    assert {(r.source, r.a) for r in mixing.lanes(beyond).collect()} == {("big", mixing.LONGEST - 1), ("small", 1)}


def test_mix_edges(spark, docs, no_docs):
    assert mixing.mix(no_docs).collect() == []
    got = mixing.mix(docs).collect()
    assert sorted((repr(r.row.doc_id), repr(r.source)) for r in got) == sorted((repr(r.doc_id), repr(r.source)) for r in docs.collect())
    assert mixing.mix(docs, {"a": 0.5, "b": 0.25}).count() == docs.count()
    ordered = mixing.mixed_order(docs, DOCUMENT_COLUMNS)
    assert ordered.columns == list(DOCUMENT_COLUMNS) and ordered.count() == docs.count()


def brute_period(a, q):
    """The lane of each slot: of the blocks that are free, the one with the earliest deadline, then the first lane."""
    import heapq

    free, waiting, out = [], [(0, i, 0) for i in range(len(a))], []
    heapq.heapify(waiting)
    for t in range(q):
        while waiting and waiting[0][0] <= t:
            _, i, n = heapq.heappop(waiting)
            heapq.heappush(free, (-(-(n + 1) * q // a[i]), i, n))
        _, i, n = heapq.heappop(free)
        out.append(i)
        if n + 1 < a[i]:
            heapq.heappush(waiting, (-(-(n + 1) * q // a[i]), i, n + 1))
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 7, 50, 1300])
def test_every_source_has_a_lane_of_its_own(spark, k):
    sizes = spark.createDataFrame([(f"s{i}", 1 + 10**6 // (i + 1)) for i in range(k)], "source string, n long")
    shares = materialise(mixing.lanes(sizes), "shares")
    found = sorted(shares.collect(), key=lambda r: r.lane)
    assert [r.lane for r in found] == list(range(1, k + 1)) and sum(r.a for r in found) == found[0].q
    slots = sorted(mixing.period(shares).collect(), key=lambda r: r.slot)
    assert [r.slot for r in slots] == list(range(found[0].q))
    assert [r.lane - 1 for r in slots] == brute_period([r.a for r in found], found[0].q)


def test_scratch_drops_its_tables(spark):
    with Scratch() as scratch:
        table = materialise(spark.range(3), "test")
    assert table.count() == 3 and scratch.paths[0].startswith(shared_dir(spark))
    path = scratch.paths[0]
    scratch.drop(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(path).count()


def brute_pipeline(rows):
    """The ids that the filtering stages keep, from rows (doc_id, text, source)."""
    import re

    counted = [(i, t, s, *brute_counters(t or "")) for i, t, s in rows]
    failed = defaultdict(Counter)
    for i, t, s, n, chars, symbols, dup, repeat in counted:
        host = failed[s or ""]
        host["n"] += 1
        host["short"] += n < 10
        host["repeats"] += 100 * repeat > 20 * n
        host["symbols"] += 10 * symbols > n
        host["lines"] += 20 * dup > n
        host["words"] += chars > 12 * n or chars < 2 * n
    bad = set()
    for rule in quality.RULES:
        total, n = sum(h[rule] for h in failed.values()), sum(h["n"] for h in failed.values())
        mean, strength = quality._prior(len(failed), n, float(sum(h["n"] ** 2 for h in failed.values())), total, sum(h[rule] ** 2 / h["n"] for h in failed.values()))
        bad |= {name for name, h in failed.items() if (h[rule] + mean * strength) / (h["n"] + strength) > quality.HOST_LIMIT}
    kept = [(i, t) for i, t, s, n, _, _, _, repeat in counted if not (n < 10 or 100 * repeat > 20 * n) and (s or "") not in bad]
    first = {}
    for i, t in sorted(kept):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t), (i, t))
    kept = sorted(first.values())
    labels = brute_components([i for i, _ in kept], [brute_fingerprint(t) for _, t in kept])
    return [(i, t) for (i, t), lab in zip(kept, labels, strict=True) if i == lab]


def test_pipeline_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    pieces = corpus_pipeline.run(spark, sf).collect()
    kept = brute_pipeline(rows)
    assert sorted({p.doc_id for p in pieces}) == sorted(i for i, _ in kept)

    class Piece:
        def __init__(self, p, ids):
            self.__dict__.update(p.asDict())
            self.ids = ids

    import zlib

    import numpy as np

    from quire.llm.packing import WordTokenizer, word_tokenizer_path

    words = WordTokenizer(word_tokenizer_path())
    ids = {i: np.frombuffer(x, words.kind).astype("<u4").tobytes() + (2).to_bytes(4, "little") for (i, _), x in zip(kept, words.many([t.encode() for _, t in kept]), strict=True)}
    full = []
    for p in pieces:
        part = ids[p.doc_id][4 * p.start : 4 * (p.start + p.length)]
        assert zlib.crc32(part) == p.ids_crc32
        full.append(Piece(p, part))
    check_pieces(kept, full)


def test_a_stage_leaves_tables_that_are_still_read(spark, docs):
    """Interleaved runs of STAGES do not drop each other's tables; what nobody holds any more goes."""
    at = materialise(docs.select(*DOCUMENT_COLUMNS), "test")
    pipeline = corpus_pipeline.Pipeline()
    stages = dict(pipeline.stages())
    held = stages["quality"](spark, at, "").where("doc_id IS NOT NULL")
    other = stages["quality"](spark, at, "")
    exact = stages["exact_dedup"](spark, other, "")
    near = stages["near_dedup"](spark, exact, "")
    # run A's result is read only now, by a frame made from it
    assert held.count() > 0 and near.count() <= exact.count() <= other.count()
    paths = [p for left in pipeline.left for p in left.paths]
    del held, other, exact, near
    stages["mix"](spark, at, "").count()
    stages["mix"](spark, at, "").count()
    assert len(pipeline.left) <= 2 and not set(paths) & {p for left in pipeline.left for p in left.paths}


def test_stages_keep_the_columns_and_take_any_rows(spark, docs, no_docs):
    for rows in (docs, no_docs):
        at = rows.select(*DOCUMENT_COLUMNS)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = materialise(stage(spark, at, ""), f"test-{name}")
            assert at.columns == list(DOCUMENT_COLUMNS)
        packed = corpus_pipeline.STAGES[-1][1](spark, at, "")
        assert packed.select("doc_id").distinct().count() == at.select("doc_id").distinct().count()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "mix", "pack"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_queries_equal_their_oracles(spark, sf, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "pages", "conversations", "benchmark"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    found = db.sql(ORACLE_SQL[name])
    columns = sorted(found.columns)
    got = QUERIES[name](spark, sf)
    assert sorted(got.columns) == columns
    expected = [tuple(dict(zip(found.columns, r, strict=True))[c] for c in columns) for r in found.fetchall()]
    assert sorted(map(repr, ([r[c] for c in columns] for r in got.collect()))) == sorted(map(repr, map(list, expected)))


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert math.isfinite(len(ORACLE_SQL))
