"""Exact dedup with Patricia-trie owners.

Three steps, each bounded in memory whatever the size of a group of copies:

1. Map side: every input task folds copies it meets within a chunk of
   ``chunk_bytes`` into one *representative* (smallest id first, the ids of the
   chunk's copies beside it). The table of representatives is written once.
2. Representatives travel by (length, content hash) of the normalised text.
   Each task inserts the full byte strings into a compressed radix trie whose
   terminals keep the smallest id, and spills whole subtrees to scratch files
   when labels and keys pass ``trie_bytes``. A text with more than ``hot``
   representatives is dealt into ``SALTS`` tries first, and only the owners of
   those meet in one.
3. Owners come back to the representatives by their unique key, so a group with
   a third of all rows joins as evenly as any other.

Defined cases: null text is the empty text; null ids lose to any id and a group
of null ids has a null ``keep_id``; of repeated rows (same id, same text)
exactly one is kept; an empty table gives an empty result; columns that are
not named are ignored or, where carried, pass through unread.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.runtime import by_bytes, counted, materialise, raw_bytes, squeeze

CHUNK_BYTES = 16 << 20
TRIE_BYTES = 64 << 20
#: Representatives of one length and hash from which they are dealt into several tries, and how many.
HOT, SALTS = 200, 64
#: What a key at a terminal counts for in memory.
KEY_BYTES = 40
#: Hot texts are broadcast up to this many (two numbers each).
BROADCAST_TEXTS = 100_000


class _Node:
    __slots__ = ("label", "kids", "owner", "spill")

    def __init__(self, label: bytes):
        self.label, self.kids, self.owner, self.spill = label, {}, None, None


def _shared(a: bytes, b: bytes, start: int) -> int:
    """How many leading bytes ``a`` shares with ``b[start:]``."""
    low, high = 0, min(len(a), len(b) - start)
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[start : start + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class PatriciaTrie:
    """Full byte strings to owners: [smallest id, its key, rows, keys].

    When labels and keys hold more than ``limit`` bytes, the largest subtrees
    below the first branching node move to scratch files until half of that is
    left; later strings for them are appended there, and ``owners()`` rebuilds
    such subtrees one at a time.
    """

    def __init__(self, limit: int, scratch: str):
        self.root, self.limit, self.scratch, self.held, self.files = _Node(b""), limit, scratch, 0, []
        self.full = limit

    def insert(self, text: bytes, ident, key: int, rows: int, keys: list[int] | None = None) -> None:
        """``key`` is the row of ``ident``; ``keys`` are all of its rows, if more than that one."""
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((text, ident, key, rows, keys), node.spill, protocol=5)
                return
            if at == len(text):
                break
            kid = node.kids.get(text[at])
            if kid is None:
                kid = node.kids[text[at]] = _Node(text[at:])
                self.held += len(kid.label)
                node = kid
                break
            if text.startswith(kid.label, at):
                node, at = kid, at + len(kid.label)
                continue
            n = _shared(kid.label, text, at)
            fork = _Node(kid.label[:n])
            kid.label = kid.label[n:]
            fork.kids[kid.label[0]] = kid
            node.kids[text[at]] = fork
            node, at = fork, at + n
        keys = [key] if keys is None else keys
        own = node.owner
        if own is None:
            node.owner = [ident, key, rows, list(keys)]
        else:
            if _before(ident, key, own):
                own[0], own[1] = ident, key
            own[2] += rows
            own[3] += keys
        self.held += KEY_BYTES * len(keys)
        if self.held > self.full:
            self._spill()
            # where nothing more can go, the next try waits until twice as much is held
            self.full = max(self.limit, 2 * self.held)

    def _spill(self) -> None:
        node, prefix = self.root, b""
        while node.spill is None and len(node.kids) == 1 and node.owner is None:
            node = next(iter(node.kids.values()))
            prefix += node.label
        if node.spill is not None or (len(node.kids) == 1 and node.owner is None):
            return
        sizes = [(sum(len(x.label) + (KEY_BYTES * len(x.owner[3]) if x.owner else 0) for x, _ in _walk(k, b"")), k) for k in node.kids.values() if k.spill is None]
        for freed, victim in sorted(sizes, key=lambda x: -x[0]):
            if self.held <= self.limit // 2:
                break
            self._move(victim, prefix)
            self.held -= freed - len(victim.label)

    def _move(self, victim: _Node, prefix: bytes) -> None:
        handle, name = tempfile.mkstemp(dir=self.scratch)
        out = os.fdopen(handle, "wb")
        for x, path in _walk(victim, prefix):
            if x.owner is not None:
                pickle.dump((path, *x.owner), out, protocol=5)
            if x.spill is not None:
                x.spill.flush()
                with open(x.spill.name_, "rb") as old:
                    for record in _records(old):
                        pickle.dump(record, out, protocol=5)
                x.spill.close()
                os.unlink(x.spill.name_)
                self.files.remove(x.spill)
        victim.kids, victim.owner, victim.spill = {}, None, _Spill(out, name)
        self.files.append(victim.spill)

    def owners(self) -> Iterator[list]:
        for x, _ in _walk(self.root, b""):
            if x.owner is not None:
                yield x.owner
        self.root = _Node(b"")
        for spill in self.files:
            spill.close()
            part = PatriciaTrie(self.limit, self.scratch)
            with open(spill.name_, "rb") as old:
                for record in _records(old):
                    part.insert(*record)
            os.unlink(spill.name_)
            yield from part.owners()


class _Spill:
    def __init__(self, out, name: str):
        self.out, self.name_ = out, name
        self.write, self.flush, self.close = out.write, out.flush, out.close


def _records(handle) -> Iterator[tuple]:
    while True:
        try:
            yield pickle.load(handle)
        except EOFError:
            return


def _walk(node: _Node, prefix: bytes) -> Iterator[tuple[_Node, bytes]]:
    todo = [(node, prefix + node.label)]
    while todo:
        x, path = todo.pop()
        yield x, path
        todo += [(k, path + k.label) for k in x.kids.values()]


def _before(ident, key: int, own: list) -> bool:
    """Smaller ids first, nulls last, then the smaller key."""
    if ident is None or own[0] is None:
        return ident is not None if (ident is None) != (own[0] is None) else key < own[1]
    return (ident, key) < (own[0], own[1])


_REP = "uid long, n_bytes int, chash long, sha256 string, members array<long>"


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Step 1: one row per distinct text and chunk, with the row of its smallest id.

    Columns: uid (unique), n_bytes, chash, sha256, members (ids, smallest first),
    ``doc_text`` (that row's own text) and the carried columns.
    """
    inputs = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    schema = T.StructType(T._parse_datatype_string(_REP).fields + [T.StructField("doc_text", T.StringType())] + [T.StructField(f"_c{i}", docs.schema[c].dataType) for i, c in enumerate(carry)])

    def fold(batches):
        import hashlib

        import pyarrow as pa
        from pyspark import TaskContext

        base, count = TaskContext.get().partitionId() << 36, 0
        arrow = None
        found: dict[bytes, list] = {}
        held = 0

        def flush():
            nonlocal count
            rows = list(found.items())
            rows_out = {k: [] for k in arrow.names}
            for text, (ids, _, row) in rows:
                digest = hashlib.sha256(text)
                ids.sort(key=lambda x: (x is None, x))
                for name, value in zip(arrow.names, (base + count, len(text), int.from_bytes(digest.digest()[:8], "big", signed=True), digest.hexdigest(), ids, *row), strict=True):
                    rows_out[name].append(value)
                count += 1
            found.clear()
            for lo in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(rows_out[f.name][lo : lo + 1000], f.type) for f in arrow], schema=arrow)

        for batch in batches:
            if arrow is None:
                arrow = pa.schema([("uid", pa.int64()), ("n_bytes", pa.int32()), ("chash", pa.int64()), ("sha256", pa.string()), ("members", pa.list_(pa.int64())), ("doc_text", pa.string()), *[(f"_c{i}", batch.schema.field(i + 2).type) for i in range(len(carry))]])
            ids, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            extras = list(zip(*[batch.column(i + 2).to_pylist() for i in range(len(carry))], strict=True)) if carry else [()] * len(ids)
            for ident, text, extra in zip(ids, texts, extras, strict=True):
                norm = squeeze(text or b"")
                seen = found.get(norm)
                if seen is None:
                    found[norm] = [[ident], ident, (text, *extra)]
                    held += 2 * len(norm) + 300
                else:
                    seen[0].append(ident)
                    held += 16
                    if ident is not None and (seen[1] is None or ident < seen[1]):
                        seen[1], seen[2] = ident, (text, *extra)
                if held > chunk_bytes:
                    yield from flush()
                    held = 0
        if found:
            yield from flush()

    return inputs.mapInArrow(fold, schema)


def _claimed(rows: DataFrame, trie_bytes: int, *salt: Column) -> DataFrame:
    """(uid, keep_id, group_size, head): rows (uid, ident, n, doc_text, n_bytes, chash) and the owners of their texts.

    ``head`` is the owner's uid. With a salt, owners are those among the rows of the same salt.
    """

    def claim(batches):
        import pyarrow as pa

        names = ["uid", "keep_id", "group_size", "head"]

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)

        with tempfile.TemporaryDirectory() as scratch:
            trie = PatriciaTrie(trie_bytes, scratch)
            for batch in batches:
                for part in by_bytes(batch, 3):
                    for uid, ident, rows, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).to_pylist(), raw_bytes(part.column(3)), strict=True):
                        trie.insert(squeeze(text), ident, uid, rows)
            rows = []
            for keep, first, size, keys in trie.owners():
                for key in keys:
                    rows.append((key, keep, size, first))
                    if len(rows) >= 10_000:
                        yield pack(rows)
                        rows = []
            if rows:
                yield pack(rows)

    return rows.select("uid", "ident", "n", "doc_text", "n_bytes", "chash", *salt).repartition("n_bytes", "chash", *salt).mapInArrow(claim, "uid long, keep_id long, group_size long, head long")


def owners(reps: DataFrame, trie_bytes: int = TRIE_BYTES, hot: int = HOT) -> DataFrame:
    """Step 2: (uid, keep_id, group_size, owner) for every representative."""
    rows = reps.select("uid", F.get("members", F.lit(0)).alias("ident"), F.size("members").cast("long").alias("n"), "doc_text", "n_bytes", "chash")
    many = materialise(reps.groupBy("n_bytes", "chash").agg(F.count("*").alias("copies")).where(F.col("copies") > hot).select("n_bytes", "chash"), "hot-texts")
    texts = many.count()
    final = lambda claimed: claimed.select("uid", "keep_id", "group_size", (F.col("uid") == F.col("head")).alias("owner"))
    if not texts:
        return final(_claimed(rows, trie_bytes))
    many = F.broadcast(many) if texts <= BROADCAST_TEXTS else many
    first = materialise(_claimed(rows.join(many, ["n_bytes", "chash"], "left_semi"), trie_bytes, F.pmod(F.xxhash64("uid"), F.lit(SALTS)).alias("salt")), "hot-first")
    heads = first.where("uid = head").select("uid", F.col("keep_id").alias("ident"), F.col("group_size").alias("n")).join(rows.select("uid", "doc_text", "n_bytes", "chash"), "uid")
    second = _claimed(heads, trie_bytes).select(F.col("uid").alias("head"), "keep_id", "group_size", F.col("head").alias("last"))
    settled = first.select("uid", "head").join(second, "head").select("uid", "keep_id", "group_size", (F.col("uid") == F.col("last")).alias("owner"))
    return final(_claimed(rows.join(many, ["n_bytes", "chash"], "left_anti"), trie_bytes)).unionByName(settled)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, trie_bytes: int = TRIE_BYTES, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    reps = materialise(representatives(docs, id_col, text_col, (), chunk_bytes), "exact-reps")
    found = owners(reps, trie_bytes, hot)
    return (
        reps.select("uid", "sha256", "members")
        .join(found, "uid")
        .select("keep_id", "group_size", "owner", "sha256", F.posexplode("members").alias("pos", "doc_id"))
        .select("doc_id", "keep_id", "group_size", (F.col("owner") & (F.col("pos") == 0)).alias("kept"), F.col("sha256").alias("text_sha256"))
    )


def keep_exact(docs: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with ``columns`` only."""
    carry = tuple(c for c in columns if c != text_col)
    reps = materialise(representatives(docs, id_col, text_col, carry), "exact-reps")
    losers = counted(owners(reps).where(~F.col("owner")).select("uid"), "exact-losers")
    kept = reps.join(losers, "uid", "left_anti")
    return kept.select(*[F.col("doc_text" if c == text_col else f"_c{carry.index(c)}").alias(c) for c in columns])


ORACLE_SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""


def op1_exact_dedup(spark, sf_dir):
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
