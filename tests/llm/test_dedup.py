import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import exact_dedup, simhash
from quire.llm.exact_dedup import PatriciaTrie
from quire.operators import components

SPACE = re.compile("[\x20\x09-\x0d]+")


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    out = []
    for t, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(t.encode()).hexdigest()
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out.append((i, keep, len(ids), kept, sha))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk, trie", [(16 << 20, 64 << 20), (1, 64 << 20), (2000, 500)])
def test_exact_groups(docs, chunk, trie):
    got = exact_dedup.exact_groups(docs, chunk_bytes=chunk, trie_bytes=trie).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=repr) == brute_exact(rows_of(docs))


def test_a_text_in_very_many_chunks(spark):
    """Every row a representative of its own: hot texts meet by way of several tries, others directly."""
    rng = random.Random(2)
    texts = ["", "hot text", "hot  text ", *(f"rare {i}" for i in range(20))]
    rows = [(rng.randrange(10**6), rng.choice(texts[:3]) if rng.random() < 0.8 else rng.choice(texts)) for _ in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (exact_dedup.TRIE_BYTES, 500):
        got = exact_dedup.exact_groups(df, chunk_bytes=1, trie_bytes=limit, hot=10).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=repr) == brute_exact(rows)


def test_trie_with_many_keys_of_one_text_stays_fast(tmp_path):
    trie = PatriciaTrie(1000, str(tmp_path))
    for key in range(20_000):
        trie.insert(b"same", key, key, 1)
    assert [(o[0], o[2], len(o[3])) for o in trie.owners()] == [(0, 20_000, 20_000)]


def test_exact_empty(no_docs):
    assert exact_dedup.exact_groups(no_docs).collect() == []


def test_keep_exact(docs):
    columns = ("doc_id", "text", "lang", "source", "n_chars")
    kept = exact_dedup.keep_exact(docs, columns)
    assert tuple(kept.columns) == columns
    expected = {(k, s) for _, k, _, _, s in brute_exact(rows_of(docs))}
    got = [(r.doc_id, hashlib.sha256(SPACE.sub(" ", r.text or "").encode()).hexdigest()) for r in kept.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, expected))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 + 97 for x in b)), max_size=60), st.sampled_from([4, 20, 1 << 20]))
def test_trie(tmp_path_factory, texts, limit):
    trie = PatriciaTrie(limit, str(tmp_path_factory.mktemp("trie")))
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    for key, (t, i) in enumerate(zip(texts, ids, strict=True)):
        trie.insert(t, i, key, 1)
    expected = {}
    for key, (t, i) in enumerate(zip(texts, ids, strict=True)):
        expected.setdefault(t, []).append((i, key))
    got = sorted((o[0], o[2], sorted(o[3])) for o in trie.owners())
    assert got == sorted((min(v)[0], len(v), sorted(k for _, k in v)) for v in expected.values())


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in SPACE.split(lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    """Labels by flooding over all pairs."""
    label = list(range(len(fps)))
    values = np.array(fps, np.uint64)
    changed = True
    while changed:
        changed = False
        for i in range(len(fps)):
            near = np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 3)
            low = min(label[j] for j in near)
            for j in near:
                if label[j] != low:
                    label[j], changed = low, True
    least = {}
    for lab, i in zip(label, ids, strict=True):
        if i is not None:
            least[lab] = min(least.get(lab, i), i)
    return [least.get(lab) for lab in label]


def test_near_groups(docs):
    rows = rows_of(docs)
    fps = [brute_fingerprint(t) for _, t in rows]
    expected = sorted(zip([i for i, _ in rows], [f"{f:016x}" for f in fps], brute_components([i for i, _ in rows], fps), strict=True), key=repr)
    got = simhash.near_groups(docs).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == expected


def test_near_empty(no_docs):
    assert simhash.near_groups(no_docs).collect() == []
    assert simhash.keep_near(no_docs, ("doc_id", "text")).collect() == []


def test_keep_near(docs):
    rows = rows_of(docs)
    labels = brute_components([i for i, _ in rows], [brute_fingerprint(t) for _, t in rows])
    kept = simhash.keep_near(docs, ("doc_id", "text", "source")).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == sorted(set(labels), key=repr)


@pytest.mark.parametrize("hot", [simhash.HOT, 5])
@pytest.mark.parametrize("size", [300, 6000])
def test_links_connect_all_near_fingerprints(spark, size, hot):
    """A dense cluster, chains, and strangers: components equal those of all pairs."""
    rng = random.Random(size)
    centre = rng.getrandbits(64)
    values = {centre}
    while len(values) < size // 2:
        x = rng.choice(tuple(values)) if len(values) < 50 else centre
        for _ in range(rng.randint(1, 3)):
            x ^= 1 << rng.randrange(64)
        values.add(x)
    while len(values) < size:
        values.add(rng.getrandbits(64))
    values = sorted(values)
    fps = spark.createDataFrame([(v - (1 << 64) if v >= 1 << 63 else v,) for v in values], "fp long")
    links = simhash.links(fps, hot)
    assert links.count() < 60 * size
    nodes = {r.node: r.root for r in components.components(links).collect()}
    expected = brute_components(values, values)
    groups = {}
    for v, e in zip(values, expected, strict=True):
        groups.setdefault(e, set()).add(nodes.get(v - (1 << 64) if v >= 1 << 63 else v, ("alone", v)))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_linked_tallies_bytes_and_then_bits():
    rng = random.Random(9)
    xs = np.array([rng.getrandbits(64) for _ in range(3000)], np.uint64)
    ys = np.array([int(x) ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 6))}) for x in xs], np.uint64)
    expected = [sum(a == b for a, b in zip(int(x).to_bytes(8), int(y).to_bytes(8), strict=True)) >= 5 and (int(x) ^ int(y)).bit_count() <= 3 for x, y in zip(xs, ys, strict=True)]
    assert simhash.linked(xs, ys).tolist() == expected and any(expected) and not all(expected)


@pytest.mark.parametrize("batch", [40])
def test_lists_over_batches(spark, batch):
    """Lists that end in a batch, fill it, or run over several, put off or not."""
    rng = random.Random(batch)
    base = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({b ^ (1 << k) for b in base for k in range(0, 64, 9)})
    fps = spark.createDataFrame([(v - (1 << 64) if v >= 1 << 63 else v,) for v in values], "fp long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = [{frozenset((r.node, r.root)) for r in components.components(simhash.links(fps, hot)).collect()} for hot in (1 << 14, 4)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and len({min(x) for x in found[0]}) >= 1


def test_spanning_by_lookup_and_by_scan_agree():
    rng = random.Random(3)
    positions = (0, 1, 2, 3, 4)
    base = rng.getrandbits(40)
    members = np.array(sorted({base | rng.getrandbits(24) << 40 for _ in range(900)}), np.uint64)

    def groups(pairs):
        up = {}
        def root(x):
            while up.get(x, x) != x:
                x = up[x]
            return x
        for a, b in pairs:
            up[root(a)] = root(b)
        found = {}
        for m in members.view(np.int64).tolist():
            found.setdefault(root(m), set()).add(m)
        return sorted(map(sorted, found.values()))

    scanned, looked = simhash.spanning(members, positions), simhash.spanning(members, positions, scan=0)
    assert groups(scanned) == groups(looked)
    assert len(scanned) < len(members) and len(looked) < len(members)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(200)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
