"""Duplicates among long titles: compared by prints, block by block."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.operators import blocks, dedup


def _families(seed: int, rows: int, words: int, base: int, edits: int) -> list[tuple[int, str, str]]:
    """Titles of a few families that overlap in part, some of them equal."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randrange(2, 6)))
    heads = [[word() for _ in range(rng.randrange(words // 2, words))] for _ in range(base)]
    out = []
    for k in range(rows):
        title = list(rng.choice(heads))
        for _ in range(rng.randrange(edits)):
            title[rng.randrange(len(title))] = word()
        out.append((k, f"10.1/{k % 40}" if k % 3 == 0 else "", " ".join(title)))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "_pos long, doi string, title string")


def _similar(a: str, b: str) -> float:
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("threshold, large, block", [(0.92, 30, 4000), (0.92, 100, 400), (0.7, 60, 2000), (1.0, 10, 1000)])
def test_links_of_large_sets_equal_brute_force(spark, monkeypatch, threshold, large, block):
    monkeypatch.setattr(dedup, "LARGE", large)
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(blocks, "STRIP", (3, 7))
    rows = _families(int(100 * threshold) + large, 150, 60, 6, 7)
    first = {}
    for k, _, t in rows:
        first.setdefault(t, k)
    heads = sorted((k, t) for t, k in first.items())
    near = sorted((a, b, s) for n, (a, t) in enumerate(heads) for b, u in heads[n + 1 :] if (s := _similar(t, u)) >= threshold)
    got = sorted(map(tuple, dedup.duplicate_links(_frame(spark, rows), threshold).collect()))
    assert got == near and (threshold == 1.0 or len(near) > 50)


def test_large_sets_have_no_index_keys(spark):
    """Long texts agree on many parts by chance; their keys made nearly all pairs candidates, once for each shared part."""
    rows = _families(3, 40, 300, 3, 4)
    sets = dedup.indexed(_frame(spark, rows).selectExpr("title AS _t"), 0.92)
    assert sets.where("size(s) >= 300 AND (size(own) > 0 OR size(guest) > 0 OR packed IS NULL)").isEmpty()
    assert sets.where("size(s) >= 300").count() > 20


def test_members_compare_no_titles(spark, monkeypatch):
    monkeypatch.setattr(dedup, "_similar_sets", None)
    members = dedup.duplicate_members(_frame(spark, [(0, "10.1/a", "One title"), (1, "10.1/A", "another"), (2, "", "one  TITLE"), (3, None, None)]))
    assert sorted(map(tuple, members.collect())) == [(0, 0, 0), (1, 0, 1), (2, None, 0), (3, None, None)]


def test_pairs_of_duplicates_come_without_a_further_grouping(spark):
    rows = _families(5, 90, 40, 4, 4)
    found = dedup.find_duplicates(_frame(spark, rows))
    assert "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = [tuple(r) for r in found.collect()]
    want = []
    for a, d, t in rows:
        for b, e, u in rows[a + 1 :]:
            s = 1.0 if d and d == e or t == u else _similar(t, u)
            if s >= 0.92:
                want.append((a, b, s))
    assert sorted(got) == want and len(want) > 100


@pytest.mark.parametrize("large", [30, 80])
def test_dedup_of_large_sets_equals_the_sequential_pass(spark, monkeypatch, large):
    monkeypatch.setattr(dedup, "LARGE", large)
    monkeypatch.setattr(dedup, "LEAST_LARGE", 2)
    monkeypatch.setattr(dedup, "SHORT_LIST", 3)
    monkeypatch.setattr(blocks, "BLOCK", 3000)
    rows = [(k, "", t) for k, _, t in _families(large, 220, 60, 5, 6)]
    kept = []
    for k, _, t in rows:
        if not any(t == rows[j][2] or _similar(t, rows[j][2]) >= 0.92 for j in kept):
            kept.append(k)
    assert sorted(r._pos for r in dedup.dedup(_frame(spark, rows))[0].collect()) == kept and 5 < len(kept) < 200


def _sets(seed: int, families: int, sets: int, words: int) -> list:
    """Sets of numbers: of each family some that hold nearly all of its numbers, families apart."""
    rng = np.random.default_rng(seed)
    return [np.sort(rng.choice(np.arange(f * words, (f + 1) * words), words - int(rng.integers(0, words // 8)), replace=False)) + 5 for f in range(families) for _ in range(sets)]


def _side(sets) -> blocks._Side:
    return blocks._Side(pa.table({"i": pa.array(range(len(sets)), pa.int64()), "n": pa.array([len(s) for s in sets]), "packed": pa.array([blocks.packed(s) for s in sets], pa.binary())}))


@pytest.mark.parametrize("beside, room", [(400, 128), (3, 128), (2, 64)])
def test_a_crowded_block_comes_in_small_batches(monkeypatch, beside, room):
    """All pairs of a block were held at once, several times over."""
    monkeypatch.setattr(blocks, "PAIRS", 100)
    monkeypatch.setattr(blocks, "STRIP", (4, 16))
    monkeypatch.setattr(blocks, "BESIDE", beside)
    monkeypatch.setattr(blocks, "HINT", room)
    sets = _sets(1, 3, 60, 300)
    side = _side(sets)
    blocks._landmarks(side, side)
    blocks._facing(side, side)
    found = list(blocks._compare(side, side, Fraction("0.92"), True, 0))
    likeness = lambda a, b: len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    want = {(a, b): s for b in range(len(sets)) for a in range(b) if (s := likeness(sets[a], sets[b])) >= 0.92}
    got = {(min(a, b), max(a, b)): s for ia, ib, like in found for a, b, s in zip(ia.tolist(), ib.tolist(), like.tolist(), strict=True)}
    assert got == want and sum(len(f[0]) for f in found) == len(want) > 500
    assert max(len(f[0]) for f in found) <= 100


def test_sets_of_two_languages_are_not_compared():
    """Every two sets of fitting size had their prints compared."""
    side = _side(_sets(2, 4, 64, 300))
    blocks._landmarks(side, side)
    pairs = [np.stack(p, 1) for p in blocks._strips(side, side, Fraction("0.92"), True)]
    assert len(side.far) == 4 and {(a // 64, b // 64) for a, b in side.i[np.concatenate(pairs)].tolist()} == {(f, f) for f in range(4)}
    assert all(len(set((side.i[side.order[lo : lo + 32]] // 64).tolist())) == 1 for lo in range(0, 256, 32))


def test_groups_have_a_partition_each(spark):
    """Groups were dealt by the hash of their number, up to five to a task."""
    for n in (2, 7, 40):
        numbers = blocks._apart(spark, n)
        rows = spark.createDataFrame([(g,) for g in numbers], "g int").repartition(n, "g")
        assert rows.select(F.spark_partition_id()).distinct().count() == n


def test_pairs_of_one_doi_are_listed_by_many_tasks(spark, monkeypatch):
    """All pairs of all DOIs were left to as few tasks as their rows have bytes for, those of one DOI to one."""
    monkeypatch.setattr(dedup, "RUN", 12)
    monkeypatch.setattr(dedup, "TASK_PAIRS", 100)
    rows = [(k, "10.1/A" if k % 2 else "10.1/a" if k % 5 else "", f"title {k} of {k * k}" if k % 3 else "") for k in range(100)]
    found = dedup.find_duplicates(_frame(spark, rows)).where("similarity = 1").withColumn("part", F.spark_partition_id()).collect()
    doi = [k for k, d, _ in rows if d]
    assert sorted((r.pos_a, r.pos_b) for r in found) == [(a, b) for a in doi for b in doi if a < b]
    parts = [r.part for r in found]
    assert max(parts.count(k) for k in set(parts)) * 2 < len(parts)
