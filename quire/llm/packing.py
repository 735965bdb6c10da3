"""Packing along a space-filling curve.

Documents are tokenised once; a document's vector is the mean of fixed random
vectors of its token ids (a hashed projection to ``DIMENSIONS`` numbers), and
its place on the Hilbert curve through that space is its sort key. A range sort
by (key, id, row) puts neighbours side by side; running token counts per range
and one offset a range give every document its place in the stream, which is
cut every ``length`` tokens. Only the last sequence can need padding.

A key that very many documents share (copies) is split by the id and row that
follow it in the sort key. Only the token counts are sorted; token ids move
once, to meet their offsets. The driver sees one number a range partition.

Defined cases: null text is empty and yields the end id alone; null ids sort
first and stay null; repeated rows are packed each; an empty table gives an
empty result; unnamed columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.runtime import bounded_batches, by_bytes, materialise, raw_bytes

LENGTH, END_ID = 4096, 2
DIMENSIONS, BITS = 4, 12
#: Words remembered with their ids by each task, in either of two generations.
REMEMBERED = 600_000
#: Texts whose ids tell whether a tokenizer works word by word.
PROBES = ("Words, and  more\nwords:\tone (two) three.", "  in front, 12 345 behind  ", "don't stop - ever \r\n l'été à 9.5 %")

#: Words beyond ASCII that tell how a tokenizer shows bytes to its model.
FOREIGN = ("été", "ñandú", "øre", "привет", "λόγος", "naïve", "čaj", "中文")


def _lower_letters(word: bytes) -> bool:
    """Only letters, in lower case and composed."""
    if word.isascii():
        return word.isalpha() and word.islower()
    text = word.decode("utf-8", "replace")
    return text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text)


def _trim() -> None:
    """Gives freed memory back to the system, where the C library can."""
    import ctypes

    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


class WordTokenizer:
    """Ids of whole texts, remembering each white-space-delimited word.

    Holds for tokenizers whose pre-tokens never span white space, so that the
    ids of a text are the ids of its words in order; a probe tells them from
    others, which encode whole texts. Where the tokenizer lower-
    cases and marks word ends, words are looked up in lower case, a word with
    punctuation behind it is put together from its two pre-tokens, and unknown
    words made of letters go straight to the model. Two generations of about ``limit`` words are kept.
    """

    def __init__(self, path: str, limit: int = REMEMBERED):
        import json
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.young, self.old = Tokenizer.from_file(path), limit, {}, {}
        self.by_word = all(self.tokenizer.encode(p, add_special_tokens=False).ids == [i for w in p.split() for i in self.tokenizer.encode(w, add_special_tokens=False).ids] for p in PROBES)
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.model, self.packed = self.tokenizer.model, [i.to_bytes(self.kind.itemsize, "little") for i in range(self.size)]
        # the model sees bytes as printable characters: those that are printable stand for themselves, the others follow from 256 on
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = (b for b in range(256) if b not in shown)
        self.shown = {b: chr(256 + n) for n, b in enumerate(hidden)}
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        probe = sorted(t.removesuffix(suffix) for t in vocabulary if suffix and re.fullmatch("[a-z]+" + re.escape(suffix), t))
        #: whether words of lower-case letters are one pre-token each, and letter case does not count
        self.lowers = bool(probe) and all(self._ids(" ".join(ws).title()) == b"".join(self._letters(w.encode()) for w in ws) for ws in (probe, FOREIGN))
        #: letters, then punctuation that starts neither a contraction nor a special token
        self.parts = re.compile(rb"([a-z\x80-\xff]+)([!-&(-/:;=>?@\[-`{}~]+)").fullmatch

    def _encode(self, words: list[bytes]) -> None:
        """Ids of words not known yet."""
        rest = words
        if self.lowers:
            rest = []
            for w in words:
                if _lower_letters(w):
                    self.young[w] = self._letters(w)
                else:
                    rest.append(w)
        if rest:
            for w, e in zip(rest, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False), strict=True):
                self.young[w] = b"".join(map(self.packed.__getitem__, e.ids))

    def _ids(self, text: str) -> bytes:
        return b"".join(map(self.packed.__getitem__, self.tokenizer.encode(text, add_special_tokens=False).ids))

    def _letters(self, word: bytes) -> bytes:
        """The ids of a word that the normaliser and the pre-tokenizer would leave as it is."""
        seen = word.decode() if word.isascii() else word.decode("latin-1").translate(self.shown)
        return b"".join([self.packed[t.id] for t in self.model.tokenize(seen)])

    def _parts(self, word: bytes) -> tuple[bytes, ...] | None:
        """Letters and the punctuation behind them, where the tokenizer is sure to part them."""
        m = self.parts(word)
        return m.groups() if m and _lower_letters(m[1]) else None

    def many(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text, little-endian."""
        if not self.by_word:
            import numpy as np

            return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]
        split = [(text.lower() if self.lowers and b"<|" not in text else text).split() for text in texts]
        young, old = self.young, self.old
        new = set().union(*split).difference(young)
        if new and old:
            young.update({w: old[w] for w in new if w in old})
            new.difference_update(old.keys() & new)
        if new:
            joint = {w: p for w in new if w[-1] < 128 and not w[-1:].isalnum() and (p := self._parts(w))} if self.lowers else {}
            self._encode(list(new.difference(joint).union(p for ps in joint.values() for p in ps if p not in young)))
            for word, (letters, marks) in joint.items():
                young[word] = young[letters] + young[marks]
        ids = [b"".join(map(young.__getitem__, words)) for words in split]
        if len(young) > self.limit:
            self.young, self.old = {}, young
        return ids

    def forget(self) -> None:
        """Gives the words' memory back."""
        self.young, self.old = {}, {}
        _trim()


def hilbert(points, bits: int):
    """Hilbert index (int64) of rows of unsigned integers below 2**bits, for dimensions * bits <= 62.

    Works down from the highest bit: each level undoes the reflection and
    exchange of axes that the curve applied there, then the Gray code of the
    transposed bits is decoded and the bits are interleaved.
    """
    import numpy as np

    x = [np.ascontiguousarray(c).astype(np.int64) for c in np.asarray(points).T]
    dims = len(x)
    for level in range(bits - 1, 0, -1):
        q, low = 1 << level, (1 << level) - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
    for i in range(1, dims):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn = np.where(x[-1] & (1 << level), turn ^ ((1 << level) - 1), turn)
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | (((x[i] ^ turn) >> level) & 1)
    return key


def _kept_in_worker(path: str) -> WordTokenizer:
    """The tokenizer, kept by the Python worker from task to task (it takes long to read).

    Its words go at the end of a task: a task meets most words anew anyway, and
    an executor may have more workers than busy ones.
    """
    import sys
    import types

    state = sys.modules.setdefault("quire_worker_state", types.ModuleType("quire_worker_state")).__dict__
    if state.get("path") != path:
        state |= {"path": path, "words": WordTokenizer(path)}
    return state["words"]


def _projection(size: int):
    """Fixed random numbers of token ids, a row a dimension."""
    import numpy as np

    return np.random.default_rng(20_480).standard_normal((DIMENSIONS, size), dtype=np.float32)


def tokenised(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: str | None = None, end_id: int = END_ID) -> DataFrame:
    """row (unique once written), doc_id, window, key, n, ids (little-endian, in the tokenizer's width) and that width."""
    inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.col(window) if window else F.lit(0)).cast("long").alias("window"), F.col(text_col).alias("_text"))

    def measure(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        words = _kept_in_worker(tokenizer)
        table = _projection(words.size)
        end = np.array([end_id], words.kind).tobytes()
        row = TaskContext.get().partitionId() << 36
        try:
            for batch in batches:
                for part in by_bytes(batch, 2, rows=100):
                    ids = [x + end for x in words.many(raw_bytes(part.column(2)))]
                    n = [len(x) // words.kind.itemsize for x in ids]
                    flat, starts = np.frombuffer(b"".join(ids), words.kind), np.concatenate([[0], np.cumsum(n)[:-1]])
                    mean = np.stack([np.add.reduceat(t[flat], starts) / n for t in table], axis=1)
                    cell = np.minimum((0.5 + np.arctan(4 * mean) / np.pi) * (1 << BITS), (1 << BITS) - 1).astype(np.int64)
                    key = hilbert(cell, BITS)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(range(row, row + len(ids)), pa.int64()), part.column(0), part.column(1), pa.array(key), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array([words.kind.itemsize] * len(ids), pa.int32())],
                        names=["row", "doc_id", "window", "key", "n", "ids", "width"],
                    )
                    row += len(ids)
        finally:
            words.forget()

    return inputs.mapInArrow(measure, "row long, doc_id long, window long, key long, n long, ids binary, width int")


def offsets(tokens: DataFrame) -> DataFrame:
    """(row, at): the place of each document's first token in the stream."""
    order = ["window", "key", "doc_id", "row"]

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            ends = at + np.cumsum(n)
            if len(n):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), part, np.int64)), pa.array(ends - n), pa.array(n)], names=["row", "part", "local", "n"])
                at = int(ends[-1])

    placed = materialise(tokens.select(*order, "n").repartitionByRange(*order).sortWithinPartitions(*order).select("row", "n").mapInArrow(run, "row long, part long, local long, n long"), "offsets")
    base, starts = 0, []
    for r in sorted(placed.groupBy("part").agg(F.sum("n").alias("n")).collect(), key=lambda r: r["part"]):
        starts.append((r["part"], base))
        base += r["n"]
    table = tokens.sparkSession.createDataFrame(starts, "part long, base long")
    return placed.join(F.broadcast(table), "part").select("row", (F.col("base") + F.col("local")).alias("at"))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: str | None = None, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    ``window`` names an integer column; the curve then runs through one window
    after the other, so documents only neighbour documents of their own window.
    """
    with bounded_batches(docs.sparkSession):
        tokens = materialise(tokenised(docs, tokenizer, id_col, text_col, window, end_id), "tokens")
    placed = tokens.select("row", "doc_id", "n", "ids", "width").join(offsets(tokens).hint("shuffle_hash"), "row")

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]

        def packed(rows: Iterable):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            rows, held = [], 0
            for doc, n, raw, width, at in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                ids = np.frombuffer(raw, f"<u{width}").astype("<u4")
                start = 0
                while start < n:
                    size = min(n - start, length - (at + start) % length)
                    rows.append((doc, start, size, ids[start : start + size].tobytes(), n, (at + start) // length, (at + start) % length))
                    start += size
                    held += 4 * size
                if held > 8 << 20:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    return placed.select("doc_id", "n", "ids", "width", "at").mapInArrow(cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def word_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark, sf_dir):
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), word_tokenizer_path()))
