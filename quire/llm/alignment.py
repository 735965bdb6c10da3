"""Alignment of two tokenizers' tokens through a dictionary of groups.

A text is encoded by a byte-level BPE (A) and a piece model (B). Byte offsets
where tokens of both end cut the text into groups; a group is its A ids and B
ids, and all its A-B pairs are links. A text has far fewer distinct groups than
tokens, and a corpus fewer still, so:

* each task interns the groups it meets: texts become lists of numbers, and
  words met before are looked up with the numbers of their groups;
* a task's documents are dealt into blocks of about ``BLOCK`` distinct groups a
  document summed up. For each block one dictionary row a distinct group is
  written, and one row an id pair with the number of the block's documents that
  hold it, worked out over the dictionary: links are expanded once a group;
* over the whole corpus the groups meet as one dictionary again, are expanded
  once more and joined with the pairs' counts; what a group's links add up to
  goes back to every block that has the group, by its key;
* a block's documents and its dictionary meet in one group of bounded size,
  where each document sums over its groups times their frequencies.

A's vocabulary is also loaded into an encoder of ranked merges, which is faster
and checked against the tokenizer on the first words of each worker; long
stretches without a blank go to the tokenizer itself. Words are encoded apart from their text where that is exact: a blank between two
characters that are no white space starts a token in either tokenizer (a probe
of B's pieces makes sure that none spans such a place). Other texts are cut at
these blanks only, so a stretch with other white space is encoded whole.

Rows are numbered by where they are read; all that a task finds is written at
once, so the numbers are settled then.

Defined cases: a null or empty text, and one whose tokens do not spell it, has
no tokens, zeros and an empty hash; null ids and repeated rows stay and count
as documents; an empty table gives an empty result; unnamed columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.runtime import BATCH_BYTES, bounded_batches, by_bytes, counted, materialise

#: Distinct groups, summed over documents, from which a block is closed.
BLOCK = 1_500_000
#: Words and groups that a task remembers before it starts anew.
REMEMBERED = 300_000
#: Bytes up to which a word is remembered.
WORD_BYTES = 64

ODD = re.compile(r"\s\s|[^\S ]")
CUT = re.compile(r"(?<=\S) (?=\S)")


class Aligner:
    """Texts to numbers of groups; groups are numbered as they are met."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        hidden = (b for b in range(256) if b not in shown)
        byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        a_bytes = {i: bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.a_bytes = [a_bytes.get(i, b"") for i in range(max(a_bytes) + 1)]
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, piece(i)) for i in range(self.b.get_piece_size()))]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.quick = self._ranked(byte)
        self.probed = False
        #: whether B's words can be encoded apart
        self.apart = not any(re.search("[^▁]▁", piece(i)) for i in range(self.b.get_piece_size()))
        self.reset()

    def _ranked(self, byte: dict[str, int]):
        """The same vocabulary for an encoder of ranked merges, which is several times as fast; None where A is of another kind."""
        import json

        import tiktoken
        from tiktoken_ext.openai_public import r50k_pat_str

        about = json.loads(self.a.to_str())
        model, before = about["model"], about["pre_tokenizer"] or {}
        if model["type"] != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space") or about["normalizer"] or len(byte) != 256:
            return None
        vocabulary = model["vocab"]
        merged = [vocabulary.get("".join(m) if isinstance(m, list) else m.replace(" ", "")) for m in model["merges"]]
        # merges must come in the order of their ids
        if None in merged or merged != sorted(set(merged)):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.items() if all(c in byte for c in t)}
        return tiktoken.Encoding("a", pat_str=r50k_pat_str, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def reset(self) -> None:
        self.words: dict[str, bytes | None] = {}
        self.numbers: dict[bytes, int] = {}
        self.names: list[bytes] = []
        self.ids: list[tuple[list[int], list[int]]] = []

    def _pieces(self, text: str, short: bool = False) -> tuple[list[int], list[int], bool]:
        """Ids of both for a blank and ``text``, and whether both spell that; ``short`` tells that no word is long."""
        a = self.quick(" " + text) if short and self.quick else None
        if a is None or not self.probed:
            slow = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
            # the first words of a worker are encoded both ways; if they differ, the tokenizer itself does all
            if a is not None and a != slow:
                self.quick = None
            self.probed |= a is not None
            a = slow
        b = self.b.encode(text)
        want = (" " + text).encode()
        return a, b, b"".join(map(self.a_bytes.__getitem__, a)) == want == b"".join(map(self.b_bytes.__getitem__, b))

    def _groups(self, a: list[int], b: list[int], starts: list[int]) -> list[bytes]:
        """Numbers of the groups, as bytes, of stretches that start at these offsets (both tokenizers cut there)."""
        import numpy as np

        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_end, b_end = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        ends = np.zeros(int(a_end[-1]) + 1 if len(a_end) else 1, bool)
        ends[a_end] = True
        cuts = b_end[ends[b_end]]
        if len(cuts) and not np.all(cuts[1:] > cuts[:-1]):
            # tokens without bytes go with the token before
            cuts = np.unique(cuts)
        a_cut, b_cut = np.searchsorted(a_end, cuts, "right"), np.searchsorted(b_end, cuts, "right")
        a_from, b_from = np.concatenate([[0], a_cut[:-1]]), np.concatenate([[0], b_cut[:-1]])
        numbers = np.empty(len(cuts), "<i4")
        # most groups are one token of either side: a number for each distinct pair
        single = (a_cut - a_from == 1) & (b_cut - b_from == 1)
        pairs, place = np.unique((a_ids[a_from[single]] << 32) | b_ids[b_from[single]], return_inverse=True)
        numbers[single] = np.array([self._number(b"%d|%d" % (p >> 32, p & 0xFFFFFFFF), [p >> 32], [p & 0xFFFFFFFF]) for p in pairs.tolist()], "<i4")[place]
        rest = np.flatnonzero(~single)
        for k, la, ha, lb, hb in zip(rest.tolist(), *(x[rest].tolist() for x in (a_from, a_cut, b_from, b_cut)), strict=True):
            own_a, own_b = a[la:ha], b[lb:hb]
            numbers[k] = self._number((",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b))).encode(), own_a, own_b)
        edges = [*np.searchsorted(cuts, starts, "right").tolist(), len(cuts)]
        return [numbers[lo:hi].tobytes() for lo, hi in zip(edges, edges[1:], strict=False)]

    def _number(self, name: bytes, a: list[int], b: list[int]) -> int:
        n = self.numbers.get(name)
        if n is None:
            n = self.numbers[name] = len(self.names)
            self.names.append(name)
            self.ids.append((a, b))
        return n

    def _alone(self, text: str) -> bytes | None:
        a, b, spelt = self._pieces(text)
        return self._groups(a, b, [0])[0] if spelt else None

    def _learn(self, words: list[str]) -> None:
        """Remembers words that stand between single blanks."""
        for lo in range(0, len(words), 4096):
            some = words[lo : lo + 4096]
            a, b, spelt = self._pieces(" ".join(some), True)
            if spelt:
                at, starts = 0, []
                for w in some:
                    starts.append(at)
                    at += len(w.encode()) + 1
                self.words.update(zip(some, self._groups(a, b, starts), strict=True))
            else:
                self.words.update((w, self._alone(w)) for w in some)

    def many(self, texts: list[str | None]) -> list[bytes | None]:
        """The numbers of each text's groups in order, as bytes (32 bits each); None for a text without tokens."""
        split = []
        for text in texts:
            if not text:
                split.append(None)
            elif not self.apart:
                split.append([text])
            elif ODD.search(text) or text[0] == " " or text[-1] == " ":
                split.append(CUT.split(text))
            else:
                split.append(text.split(" "))
        met = set().union(*filter(None, split))
        met.difference_update(self.words)
        plain, other = [], {}
        for w in met:
            if len(w) > WORD_BYTES or w[0].isspace() or w[-1].isspace():
                other[w] = self._alone(w)
            else:
                plain.append(w)
        self._learn(plain)
        known = self.words
        out = []
        for stretches in split:
            if stretches is None:
                out.append(None)
                continue
            found = [known[w] if w in known else other[w] for w in stretches] if other else [known[w] for w in stretches]
            out.append(None if None in found else b"".join(found))
        return out


def _pair_counts(ids: list[tuple[list[int], list[int]]], held, docs):
    """(a, b, documents) of a block: ``ids`` of its groups, and which group each document holds (two arrays)."""
    import numpy as np

    n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
    flat_a, flat_b = (np.array([i for x in ids for i in x[k]], np.int64) for k in (0, 1))
    base_a, base_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
    links = n_a * n_b
    group = np.repeat(np.arange(len(ids)), links)
    at = np.arange(len(group)) - np.repeat(np.cumsum(links) - links, links)
    pair = (flat_a[base_a[group] + at // n_b[group]] << 32) | flat_b[base_b[group] + at % n_b[group]]
    if not len(pair):
        return pair, pair, pair
    order = np.lexsort((group, pair))
    pair, group = pair[order], group[order]
    new = np.concatenate([[True], (pair[1:] != pair[:-1]) | (group[1:] != group[:-1])])
    pair, group = pair[new], group[new]
    pairs, first, groups = np.unique(pair, return_index=True, return_counts=True)
    sizes = np.bincount(held, minlength=len(ids))
    n = sizes[group[first]]
    # pairs of several groups: each of their documents once
    several = np.flatnonzero(groups > 1)
    if len(several):
        by_group = np.argsort(held, kind="stable")
        held_docs, start = docs[by_group], np.cumsum(sizes) - sizes
        for k in several.tolist():
            own = group[first[k] : first[k] + groups[k]]
            n[k] = len(np.unique(np.concatenate([held_docs[start[g] : start[g] + sizes[g]] for g in own.tolist()])))
    return pairs >> 32, pairs & 0xFFFFFFFF, n


def _kept_in_worker(a_path: str, b_path: str) -> Aligner:
    """The tokenizers, kept by the Python worker from task to task."""
    import sys
    import types

    state = sys.modules.setdefault("quire_worker_aligner", types.ModuleType("quire_worker_aligner")).__dict__
    if state.get("paths") != (a_path, b_path):
        state |= {"paths": (a_path, b_path), "aligner": Aligner(a_path, b_path)}
    return state["aligner"]


#: What a task writes: documents, dictionary rows of a block, pairs of a block.
DOC, GROUP, PAIR = 0, 1, 2
BLOCKS_DDL = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, sha string, held array<int>, times array<int>, at int, name string, a_ids array<int>, b_ids array<int>, a int, b int, n long"


def blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """Documents, dictionaries and pair counts by block (``BLOCKS_DDL``), not written yet."""
    inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"))

    def rows(kind: int, many: int, /, **columns):
        import pyarrow as pa

        kinds = {"kind": pa.int32(), "sha": pa.string(), "name": pa.string(), "at": pa.int32(), "a": pa.int32(), "b": pa.int32()} | dict.fromkeys(("held", "times", "a_ids", "b_ids"), pa.list_(pa.int32()))
        names = [x.split()[0] for x in BLOCKS_DDL.split(", ")]
        full = {"kind": [kind] * many} | columns
        return pa.RecordBatch.from_arrays([(full[c] if isinstance(full[c], pa.Array) else pa.array(full[c], kinds.get(c, pa.int64()))) if c in full else pa.nulls(many, kinds.get(c, pa.int64())) for c in names], names=names)

    def lists(parts):
        import numpy as np
        import pyarrow as pa

        offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts).astype(np.int32) if parts else [], pa.int32()))

    def align(batches):
        import hashlib

        import numpy as np
        from pyspark import TaskContext

        aligner = _kept_in_worker(a_path, b_path)
        aligner.reset()
        block, ids_of, found, total = TaskContext.get().partitionId() << 32, [], [], 0

        def close():
            nonlocal block, ids_of, found, total
            used = np.unique(np.concatenate([f[0] for f in found])) if found else np.empty(0, np.int32)
            ids = [aligner.ids[g] for g in used.tolist()]
            n_a, n_b = (np.array([len(x[k]) for x in ids], np.int64) for k in (0, 1))
            held = [np.searchsorted(used, f[0]) for f in found]
            for lo in range(0, len(found), 1000):
                some, own = found[lo : lo + 1000], held[lo : lo + 1000]
                tell = lambda each: [int((each[h] * f[1]).sum()) for f, h in zip(some, own, strict=True)]
                yield rows(DOC, len(some), block=[block] * len(some), doc_id=ids_of[lo : lo + 1000], n_a=tell(n_a), n_b=tell(n_b), n_groups=[int(f[1].sum()) for f in some], n_links=tell(n_a * n_b), sha=[f[2] for f in some], held=lists(own), times=lists([f[1] for f in some]))
            for lo in range(0, len(ids), 20_000):
                some = ids[lo : lo + 20_000]
                yield rows(GROUP, len(some), block=[block] * len(some), at=range(lo, lo + len(some)), name=[aligner.names[g].decode() for g in used[lo : lo + 20_000].tolist()], a_ids=[x[0] for x in some], b_ids=[x[1] for x in some])
            if len(ids):
                a, b, n = _pair_counts(ids, np.concatenate(held), np.repeat(np.arange(len(found)), [len(h) for h in held]))
                for lo in range(0, len(a), 50_000):
                    yield rows(PAIR, len(a[lo : lo + 50_000]), block=[block] * len(a[lo : lo + 50_000]), a=a[lo : lo + 50_000].astype(np.int32), b=b[lo : lo + 50_000].astype(np.int32), n=n[lo : lo + 50_000])
            block, ids_of, found, total = block + 1, [], [], 0

        for whole in batches:
            for batch in by_bytes(whole, 1, BATCH_BYTES, 200):
                if len(aligner.words) > REMEMBERED or len(aligner.names) > REMEMBERED:
                    # numbers begin anew, so the block ends
                    yield from close()
                    aligner.reset()
                for doc, numbers in zip(batch.column(0).to_pylist(), aligner.many(batch.column(1).to_pylist()), strict=True):
                    if numbers is None:
                        entry = np.empty(0, np.int32), np.empty(0, np.int64), ""
                    else:
                        at = np.frombuffer(numbers, "<i4")
                        held, times = np.unique(at, return_counts=True)
                        entry = held, times, hashlib.sha256(b";".join(map(aligner.names.__getitem__, at.tolist()))).hexdigest()
                    ids_of.append(doc)
                    found.append(entry)
                    total += len(entry[0]) + 1
                if total >= size:
                    yield from close()
        yield from close()
        aligner.reset()

    return inputs.mapInArrow(align, BLOCKS_DDL)


def pair_counts(parts: DataFrame) -> DataFrame:
    """(a, b, n, best): documents that hold an id pair, and whether no other pair of the A id is in more."""
    pairs = parts.where(F.col("kind") == PAIR).groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = materialise(pairs, "pairs")
    top = pairs.groupBy("a").agg(F.max("n").alias("top"))
    return pairs.join(top, "a").select("a", "b", "n", (F.col("n") == F.col("top")).alias("best"))


def group_values(parts: DataFrame) -> DataFrame:
    """(name, best, counts): over the links of each distinct group, how many are their A id's best and what their counts add up to."""
    groups = parts.where(F.col("kind") == GROUP).groupBy("name").agg(F.any_value("a_ids").alias("a_ids"), F.any_value("b_ids").alias("b_ids"))
    links = groups.select("name", F.explode("a_ids").alias("a"), "b_ids").select("name", "a", F.explode("b_ids").alias("b"))
    return links.join(pair_counts(parts), ["a", "b"]).groupBy("name").agg(F.count_if("best").alias("best"), F.sum("n").alias("counts"))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """One row a document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    with bounded_batches(docs.sparkSession):
        parts = materialise(blocks(docs, a_path, b_path, id_col, text_col, size), "blocks")
    values = counted(group_values(parts), "groups", 100_000)
    local = parts.where(F.col("kind") == GROUP).select("block", "at", "name").join(values, "name").select(F.col("block").alias("of"), "at", "best", "counts")
    rows = parts.where(F.col("kind") == DOC).select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "sha", "held", "times")

    def summed(left, right):
        """The documents of a block with the sums over their groups."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        at, width = right.column("at").to_numpy(), len(right)
        best, counts = np.zeros(width, np.int64), np.zeros(width, np.int64)
        best[at], counts[at] = right.column("best").to_numpy(), right.column("counts").to_numpy()
        lengths = pc.list_value_length(left.column("held")).to_numpy()
        edges = np.concatenate([[0], np.cumsum(lengths)])
        held, times = (pc.list_flatten(left.column(c)).to_numpy() for c in ("held", "times"))

        def total(each):
            so_far = np.concatenate([[0], np.cumsum(each[held] * times.astype(np.int64))])
            return pa.array(so_far[edges[1:]] - so_far[edges[:-1]])

        keep = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return pa.table([*[left.column(c) for c in keep], total(best), total(counts), left.column("sha")], names=[*keep, "n_best", "count_sum", "groups_sha256"])

    out = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("block").cogroup(local.groupBy("of")).applyInArrow(summed, out)


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13_tokenizer_alignment(spark, sf_dir):
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"), *tokenizer_paths())
