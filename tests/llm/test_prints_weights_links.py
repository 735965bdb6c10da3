"""Fingerprints, importance resampling and tokenizer alignment against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quire.llm import alignment, fingerprints, importance

# ----- fingerprints -----


def brute_print(text):
    votes = np.zeros(64, np.int64)
    for w in re.split(r"[\x20\x09-\x0D]+", text.lower()):
        bits = np.unpackbits(np.array([xxh64_intdigest(w.encode(), 42)], "<u8").view(np.uint8), bitorder="little")
        votes += min(len(w), 16) ** 2 * (2 * bits.astype(np.int64) - 1)
    return int(np.packbits(votes > 0, bitorder="little").view("<u8")[0])


def brute_documents(rows, radius=3):
    """Rows (id, text) to what the operator returns; equal rows are one document."""
    copies = Counter((i, t or "") for i, t in rows)
    prints = {k: brute_print(k[1]) for k in copies}
    ids = sorted({i for i, _ in copies if i is not None})
    out = []
    for (i, text), n in copies.items():
        after = [k for k in copies if k[0] is not None and i is not None and k[0] > i]
        nexts = [k for k in after if k[0] == min(a[0] for a in after)] or [k for k in copies if ids and k[0] == ids[0]]
        near = sum(c for k, c in copies.items() if (prints[k] ^ prints[i, text]).bit_count() <= radius) - 1
        least = min((k[0] for k in copies if k[0] is not None and prints[k] == prints[i, text]), default=None)
        out.append((i, text, n, nexts, prints, near, least))
    return out


def like(a, b):
    return max(0.0, math.cos(math.pi * (a ^ b).bit_count() / 64))


def check_prints(got, rows):
    by_key = defaultdict(list)
    for r in got:
        by_key[r.doc_id].append(r)
    assert len(got) == len(rows)
    for i, text, n, nexts, prints, near, least in brute_documents(rows):
        k = len(text) // 4
        mine = [r for r in by_key[i] if r.fingerprint == f"{prints[i, text]:016x}" and r.n_chars == len(text)]
        assert len(mine) >= n
        if i is None or len({x for x, _ in rows if x == i}) != 1 or sum(x == i for x, _ in set(rows)) > 1 or len(nexts) != 1 or any(x is None for x, _ in rows):
            continue
        edited = text[: len(text) - k] + nexts[0][1][:k]
        for r in mine:
            assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert r.edited_fingerprint == f"{brute_print(edited):016x}"
            assert r.near_edited == pytest.approx(like(prints[i, text], brute_print(edited)), abs=1e-9)
            assert r.near_next == pytest.approx(like(prints[i, text], prints[nexts[0]]), abs=1e-9)
            assert r.n_near == (near if i % 50 == 0 else None) and r.class_id == least


def test_fingerprints_of_documents_against_brute_force(spark, sf, docs, no_docs):
    table = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text or "") for r in table.collect()]
    check_prints(fingerprints.op11_document_fingerprints(spark, sf).collect(), rows)
    odd = docs.select("doc_id", "text", F.lit("x").alias("fp"), F.lit(1).alias("copies"), F.lit("k").alias("_h"))
    check_prints(fingerprints.document_fingerprints(odd).collect(), [(r.doc_id, r.text or "") for r in docs.collect()])
    known = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["doc_id"])
    check_prints(fingerprints.document_fingerprints(known).collect(), [(r.doc_id, r.text) for r in known.collect()])
    assert fingerprints.document_fingerprints(no_docs).count() == 0
    one = fingerprints.document_fingerprints(known.where("doc_id = 1")).first()
    assert one.near_next == 1.0 and one.class_id == 1


def test_likeness_tells_edited_texts_from_others(spark, sf):
    got = fingerprints.op11_document_fingerprints(spark, sf).where("n_chars > 200").collect()
    near, far = (sorted(getattr(r, c) for r in got) for c in ("near_edited", "near_next"))
    # three quarters of an edited text stay
    assert 0.65 < near[len(near) // 2] < 0.9 and far[len(far) // 2] < 0.25


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_block_tables_find_all_within_the_radius(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(8))) for b in base for _ in range(6)]
    every = sorted({x - (1 << 64) if x >= 1 << 63 else x for x in [*base, *near, 0, (1 << 64) - 1]})
    asked = every[::5]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "fp long")
    got = [tuple(r) for r in fingerprints.search(frame([*asked, asked[0]]), frame(every), radius).collect()]
    bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert sorted(got) == sorted((q, x, bits(q, x)) for q in asked for x in every if bits(q, x) <= radius)


def test_a_vote_is_the_square_of_the_length(spark):
    rows = spark.createDataFrame([(1, "a a a bb longer " + "z" * 40), (2, ""), (3, " \t"), (4, "É"), (5, "word " * 5000 + "x")], "k long, t string")
    got = {r.k: r.fp & ((1 << 64) - 1) for r in fingerprints.fingerprints(rows, ("k",), "t").collect()}
    assert got == {r.k: brute_print(r.t) for r in rows.collect()} and got[2] == got[3] == 0


# ----- importance -----


def brute_weights(docs, target, orders, buckets=10_000):
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})))
    grams = lambda ws: [" ".join(ws[i : i + n]) for n in range(1, orders + 1) for i in range(len(ws) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (Counter(bucket(g) for x in rows for g in grams(words(x))) for rows in ([x for _, x in docs], target))
    all_s, all_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, x in docs:
        ws = words(x)
        gs = [gain[bucket(g)] for g in grams(ws)]
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gs) // len(gs) if gs else 0
        out.append([i, len(gs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(ws)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0]))
    for k, r in enumerate(able[: 10 * len(able) // 100], 1):
        r[4] = k
    return sorted(repr(tuple(r[:5])) for r in out)


@pytest.mark.parametrize("orders", [1, 2, 3])
def test_resampling_against_brute_force(spark, sf, docs, orders):
    table, target = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    every = table.select("doc_id", "text").union(docs.select("doc_id", "text")).withColumn("word", F.lit(1)).withColumn("pos", F.lit("p"))
    got = importance.drawn(importance.weighted(every, target, orders=orders)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    rows = [(r.doc_id, r.text) for r in every.collect()]
    assert sorted(repr(tuple(r)) for r in got) == brute_weights(rows, [r.text for r in target.collect()], orders)


def test_resampling_of_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], "text string")
    assert importance.drawn(importance.weighted(no_docs, none)).count() == 0
    got = importance.drawn(importance.weighted(docs, none)).collect()
    assert len(got) == docs.count() and all(r.weight == 0 for r in got if not r.n_features)
    assert importance.resample(docs, none).columns == ["doc_id", "weight", "score", "rank"]


# ----- alignment -----


def _token_bytes(tokenizer, pieces):
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
    of_piece = lambda p: bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
    return lambda tokens: [bytes(table[c] for c in t) for t in tokens], lambda ids: [of_piece(pieces.id_to_piece(i)) for i in ids]


def brute_alignment(docs):
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.tokenizer_paths()
    a_side, b_side = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a_side.encode_special_tokens = True
    a_bytes, b_bytes = _token_bytes(a_side, b_side)
    found, count = [], Counter()
    for i, text in docs:
        groups = []
        if text:
            e = a_side.encode(" " + text, add_special_tokens=False)
            b = b_side.encode(text)
            at, bt = a_bytes(e.tokens), b_bytes(b)
            if b"".join(at) == (" " + text).encode() == b"".join(bt):
                a_end, b_end = (np.cumsum([len(x) for x in t]).tolist() for t in (at, bt))
                low = 0
                for cut in sorted(set(a_end) & set(b_end)):
                    groups.append(tuple([x for x, p in zip(ids, end, strict=True) if low < p <= cut] for ids, end in ((e.ids, a_end), (b, b_end))))
                    low = cut
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        count.update(links.keys())
        found.append((i, groups, links))
    top = defaultdict(int)
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = []
    for i, g, links in found:
        name = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        out.append((i, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), links.total(), sum(n for p, n in links.items() if count[p] == top[p[0]]), sum(n * count[p] for p, n in links.items()), hashlib.sha256(name.encode()).hexdigest() if g else ""))
    return sorted(map(repr, out))


ODD_TEXTS = [None, "", " ", "  ", "\n", " a", "a ", "a  b", "\ta b\n c", "a b c d", "x▁y z", "café café ﬁ 中文字 🙂🙂 a🙂b", "<|endoftext|> <s> </s><unk> <0x41>", "don't we'll I'M", "a" * 3000, " " * 300 + "x", "b" * 70 + " c\n\n\nd  e", "1234567 8,9.10", "\x00\x1c\x85", "naïve\r\nline\rtwo"]


@pytest.mark.parametrize("size", [1_500_000, 200])
def test_alignment_against_brute_force(spark, sf, docs, size):
    odd = spark.createDataFrame([(1000 + n, t) for n, t in enumerate(ODD_TEXTS)], "doc_id long, text string")
    short = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) < 900").select("doc_id", "text")
    every = docs.where("doc_id <> 6 AND doc_id <> 7 OR doc_id IS NULL").select("doc_id", "text").union(odd).union(odd.limit(13)).union(short).withColumn("name", F.lit("n")).withColumn("at", F.lit(1))
    got = alignment.align(every, *alignment.tokenizer_paths(), size=size).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute_alignment([(r.doc_id, r.text) for r in every.collect()])


def test_alignment_of_an_empty_table_and_of_texts_without_tokens(spark, no_docs):
    assert alignment.align(no_docs, *alignment.tokenizer_paths()).count() == 0
    none = spark.createDataFrame([(1, None), (None, "▁"), (1, "")], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, alignment.align(none, *alignment.tokenizer_paths()).collect()))) == sorted(repr((i, 0, 0, 0, 0, 0, 0, "")) for i in (1, None, 1))


def test_a_task_that_forgets_its_words_finds_the_same(spark, sf, monkeypatch):
    table = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    whole = sorted(map(repr, alignment.align(table, *alignment.tokenizer_paths()).collect()))
    monkeypatch.setattr(alignment, "REMEMBERED", 300)
    assert sorted(map(repr, alignment.align(table, *alignment.tokenizer_paths()).collect())) == whole
