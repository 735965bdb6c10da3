import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quire.llm import packing, quality

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute_counters(text):
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = text.split("\n")
    dup = sum(1 for i, line in enumerate(lines) if WORD.search(line) and line in lines[:i])
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t#é ", max_size=80))
def test_counters(text):
    assert quality.text_counters(text.encode()) == brute_counters(text)


def test_judged(docs):
    got = quality.judged(docs).collect()
    expected = sorted(((r.doc_id, *brute_counters(r.text or "")) for r in docs.collect()), key=repr)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=repr) == expected
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_bad_host_is_rejected_and_small_host_is_not(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 20 else "short", "clean") for i in range(200)] + [(1000 + i, "short" if i % 10 else good, "junk") for i in range(100)] + [(2000, "short", "tiny"), (2001, good, "tiny")]
    rows += [(3000 + i, good, f"h{i % 9}") for i in range(300)]
    kept = {r.doc_id for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("kept").collect()}
    assert not any(1000 <= i < 1100 for i in kept)
    assert 2001 in kept and 1 in kept and 3000 in kept


def test_quality_empty(no_docs):
    assert quality.judged(no_docs).collect() == []
    assert quality.keep_quality(no_docs, ("doc_id", "text", "source")).collect() == []


def check_pieces(rows, pieces, length=packing.LENGTH):
    tokenizer = Tokenizer.from_file(packing.word_tokenizer_path())
    expected = Counter()
    for ident, text in rows:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        expected[ident, len(ids), zlib.crc32(ids.tobytes())] += 1
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
    short = 0
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length == len(p.ids) // 4
            at += p.length
        assert at <= length
        short += at < length
    assert short <= 1
    # pieces follow each other in the stream, so documents come back by walking it
    found = Counter()
    held = None
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        held = bytes(p.ids) if p.start == 0 else held + bytes(p.ids)
        assert p.start * 4 + len(p.ids) == len(held)
        if len(held) == 4 * p.doc_tokens:
            found[p.doc_id, p.doc_tokens, zlib.crc32(held)] += 1
    assert found == expected


def test_pack(docs):
    pieces = packing.pack(docs, packing.word_tokenizer_path()).collect()
    check_pieces([(r.doc_id, r.text) for r in docs.collect()], pieces)


def test_pack_by_window(docs):
    pieces = packing.pack(docs.selectExpr("*", "coalesce(doc_id, 0) % 3 as w"), packing.word_tokenizer_path(), window="w").collect()
    check_pieces([(r.doc_id, r.text) for r in docs.collect()], pieces)
    order = [(p.doc_id or 0) % 3 for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    assert order == sorted(order)


def test_pack_empty(no_docs):
    assert packing.digest(packing.pack(no_docs, packing.word_tokenizer_path())).collect() == []


def test_digest_is_unsigned_crc(docs):
    pieces = packing.pack(docs, packing.word_tokenizer_path())
    for a, b in zip(sorted(pieces.collect(), key=repr), sorted(packing.digest(pieces).collect(), key=repr), strict=True):
        assert a.sequence_id >= 0 and b.ids_crc32 >= 0
    assert {zlib.crc32(p.ids) for p in pieces.collect()} == {p.ids_crc32 for p in packing.digest(pieces).collect()}


@pytest.mark.parametrize("dims, bits", [(2, 4), (3, 3), (4, 2)])
def test_hilbert_visits_every_cell_by_single_steps(dims, bits):
    grid = np.indices([1 << bits] * dims).reshape(dims, -1).T
    keys = packing.hilbert(grid, bits)
    assert sorted(keys) == list(range(len(grid)))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1)
    assert set(steps.tolist()) == {1}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["a", "B", "é", "É", " ", "\n", "'s", ".", ",", "<|endoftext|>", "<|", "1", "***", "İ", "　", "́", "中", "don't", "\x85", "Σ"]), max_size=20).map("".join), max_size=4))
def test_word_tokenizer_equals_the_tokenizer(texts):
    words = packing.WordTokenizer(packing.word_tokenizer_path(), limit=20) if not hasattr(test_word_tokenizer_equals_the_tokenizer, "w") else test_word_tokenizer_equals_the_tokenizer.w
    test_word_tokenizer_equals_the_tokenizer.w = words
    for text, ids in zip(texts, words.many([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, words.kind).tolist() == words.tokenizer.encode(text, add_special_tokens=False).ids


def test_tokenizers_that_join_words_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["two words", "  odd \n space, it's 12 345 ", "", "é " * 50]
    words = packing.WordTokenizer(path)
    plain = Tokenizer.from_file(path)
    assert not words.by_word and packing.WordTokenizer(packing.word_tokenizer_path()).by_word
    assert [np.frombuffer(x, words.kind).tolist() for x in words.many([t.encode() for t in texts])] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_slices_by_bytes():
    import pyarrow as pa

    from quire.llm.runtime import by_bytes

    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, None, "b" * 50, "c", "d", "", "e" * 9]})
    parts = [p.column(0).to_pylist() for p in by_bytes(batch, 0, most=12, rows=3)]
    assert sum(parts, []) == batch.column(0).to_pylist()
    assert all(len(p) <= 3 and (len(p) == 1 or sum(len(x or "") for x in p) <= 12) for p in parts)
    assert list(by_bytes(batch.slice(0, 0), 0)) == []
