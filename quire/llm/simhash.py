"""SimHash near-dedup over a byte-position inverted index with count filtering.

A fingerprint has 8 entries (position, byte). Two fingerprints that differ in at
most 3 of 64 bits differ in at most 3 bytes, so they share at least 5 entries
(``MIN_MATCHES``).

Posting lists of single entries would hold a 256th of all fingerprints each, so
the index is cut to prefixes: entries are ordered from rare to frequent over the
corpus (2,048 counts), and as two fingerprints share 5 of 8 entries, they share
``MEET`` = 4 of their 7 rarest. The lists are those of 4 entries at once: 35 a
fingerprint, for each 4 of all but its most frequent entry. Within a list the
shared positional bytes of a pair are tallied, pairs that reach 5 are retained
and then verified by counting differing bits.

A list with more than ``HOT`` fingerprints is split: as a retained pair shares a
fifth entry, its members are dealt once more to the lists of 5 entries, whoever
is in the same one.

Exact copies of a fingerprint collapse before indexing. The members of a list of
5 entries differ only in 3 bytes, so it holds at most 2^24 fingerprints (128 MiB)
whatever the corpus. Inside a list, links are walked breadth first
over the fingerprints not reached yet, which gives a spanning forest of the
list instead of all its pairs: no link between groups is lost and a list of m
members emits at most m - 1 rows.

Defined cases: null text is empty, and texts without a word share fingerprint
zero; null ids take part, and a component whose ids are all null has a null
``component_id``; repeated rows keep a row each in ``near_groups``, while
``keep_near`` keeps one row of each component; an empty table gives an empty
result; unnamed columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.operators.components import components
from quire.llm.runtime import by_bytes, counted, materialise, raw_bytes

SHINGLE_WORDS, SEED, MAX_BITS, POSITIONS = 3, 42, 3, 8
#: Positional bytes that any two linked fingerprints share.
MIN_MATCHES = POSITIONS - MAX_BITS

#: Entries that a posting list is keyed by, and the length from which a list is split by one more.
MEET, HOT = MIN_MATCHES - 1, 1 << 14

_SETS = {n: list(combinations(range(POSITIONS), n)) for n in (MEET, MIN_MATCHES)}


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


#: For each set of positions, the mask that keeps its bytes.
MASKS = {n: [_signed(sum(0xFF << (8 * p) for p in s)) for s in sets] for n, sets in _SETS.items()}


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of the 3-word shingles of a whole text."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE_WORDS:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = (ends - lengths)[: 1 - SHINGLE_WORDS].tolist()
        ends = ends[SHINGLE_WORDS - 1 :].tolist()
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)]
    values = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(values), 1 << 15):
        bits = np.unpackbits(values[lo : lo + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """uid (unique once written), doc_id, fp (signed long) and the carried columns as ``_c0, ...``."""
    inputs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("_text"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    schema = T.StructType([T.StructField("uid", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("fp", T.LongType()), *inputs.schema.fields[2:]])

    def measure(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        for whole in batches:
            for batch in by_bytes(whole, 1):
                found = np.array([fingerprint(x) for x in raw_bytes(batch.column(1))], np.uint64).view(np.int64)
                uid = np.arange(base, base + len(found), dtype=np.int64)
                base += len(found)
                yield pa.RecordBatch.from_arrays([pa.array(uid), batch.column(0), pa.array(found), *batch.columns[2:]], names=["uid", "doc_id", "fp", *batch.schema.names[2:]])

    return inputs.mapInArrow(measure, schema)


def _byte(p: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(0xFF)).cast("int")


def _most_frequent(fps: DataFrame) -> Column:
    """The position of a fingerprint's most frequent entry over all of ``fps``."""
    entry = fps.select(F.posexplode(F.array(*[_byte(p) for p in range(POSITIONS)])).alias("p", "b"))
    # at most 2,048 rows
    counts = {(r["p"], r["b"]): r["count"] for r in entry.groupBy("p", "b").count().collect()}
    tables = [F.array(*[F.lit(counts.get((p, b), 0)).cast("long") for b in range(256)]) for p in range(POSITIONS)]
    return F.array_max(F.array(*[F.struct(F.get(t, _byte(p)).alias("n"), F.lit(p).alias("p")) for p, t in enumerate(tables)]))["p"]


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Distinct fingerprints (column ``fp``) to links (a, b) that connect all within 3 bits."""
    lists = lambda chosen: F.array(*[F.array(*map(F.lit, x)) for x in chosen])
    keyed = lambda rows, n: rows.select("c", F.col("fp").bitwiseAND(F.get(F.array(*map(F.lit, MASKS[n])), F.col("c"))).alias("v"), "fp")
    prefix = lists([c for c, s in enumerate(_SETS[MEET]) if top not in s] for top in range(POSITIONS))
    postings = keyed(fps.select("fp", F.explode(F.get(prefix, _most_frequent(fps))).alias("c")), MEET)
    met = materialise(_walked(postings, MEET, hot), "links")
    # members of lists that were too long: once more, with each of the other entries
    finer = lists([k for k, s in enumerate(_SETS[MIN_MATCHES]) if set(s) >= set(own)] for own in _SETS[MEET])
    longer = keyed(met.where("b IS NULL").select(F.col("a").alias("fp"), F.explode(F.get(finer, F.col("c"))).alias("c")).distinct(), MIN_MATCHES)
    return met.where("b IS NOT NULL").select("a", "b").union(_walked(longer, MIN_MATCHES, None).select("a", "b"))


def _walked(postings: DataFrame, entries: int, hot: int | None) -> DataFrame:
    """Posting lists (c, v, fp) to links (a, b, null); members of lists longer than ``hot`` come as (fp, null, c)."""
    import numpy as np
    import pyarrow as pa

    def walk(batches):
        parts, joined, key = [], _Joined(), None
        for batch in batches:
            c, v, fp = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((c[1:] != c[:-1]) | (v[1:] != v[:-1])) + 1
            edges = [0, *cuts[:1].tolist(), *cuts[-1:].tolist(), len(c)]
            # the end of the list at hand, whole lists, and the begin of the next one
            for lo, hi in zip(edges, edges[1:], strict=False):
                if lo == hi:
                    continue
                own = (c[lo], v[lo])
                if key is not None and own != key:
                    yield from listed(parts, joined)
                    parts = []
                elif key is not None and not parts:
                    # a list that has been put off goes on
                    yield from put_off(c[lo:hi], fp[lo:hi])
                    continue
                parts.append([x[lo:hi] for x in (c, v, fp)])
                key = (c[hi - 1], v[hi - 1])
                if own == key and hot is not None and sum(len(p[0]) for p in parts) > hot:
                    for p in parts:
                        yield from put_off(p[0], p[2])
                    parts = []
                elif own != key:
                    yield from listed(parts, joined)
                    parts, key = [], None
        yield from listed(parts, joined)

    def put_off(c, fp):
        for lo in range(0, len(fp), 100_000):
            n = len(fp[lo : lo + 100_000])
            yield pa.RecordBatch.from_arrays([pa.array(fp[lo : lo + n]), pa.nulls(n, pa.int64()), pa.array(c[lo : lo + n], pa.int32())], names=["a", "b", "c"])

    def listed(parts, joined):
        if not parts:
            return
        c, v, fp = [np.concatenate([p[i] for p in parts]) for i in range(3)]
        cuts = np.flatnonzero((c[1:] != c[:-1]) | (v[1:] != v[:-1])) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(c)]])
        size = ends - starts
        out = []
        two = starts[size == 2]
        near = linked(fp[two].view(np.uint64), fp[two + 1].view(np.uint64))
        out += zip(fp[two][near].tolist(), fp[two + 1][near].tolist(), strict=True)
        for s, e in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            if hot is not None and e - s > hot:
                yield from put_off(c[s:e], fp[s:e])
                continue
            out += spanning(fp[s:e].view(np.uint64), _SETS[entries][c[s]])
        out = [p for p in out if joined.add(*p)]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in out], pa.int64()) for i in (0, 1)] + [pa.nulls(len(out), pa.int32())], names=["a", "b", "c"])

    return postings.select("c", "v", "fp").repartition("c", "v").sortWithinPartitions("c", "v", "fp").mapInArrow(walk, "a long, b long, c int")


def linked(x, y):
    """Whether fingerprints share enough positional bytes and, those that do, differ in few enough bits."""
    import numpy as np

    apart = x ^ y
    shared = np.zeros(np.shape(apart), np.uint8)
    for p in range(POSITIONS):
        shared += (apart >> np.uint64(8 * p)) & np.uint64(0xFF) == 0
    retained = shared >= MIN_MATCHES
    return retained & (np.bitwise_count(apart) <= MAX_BITS)


class _Joined:
    """Forgetful union-find: tells whether a link joins two sets not joined before in this task."""

    def __init__(self, limit: int = 1_000_000):
        self.up, self.limit = {}, limit

    def _root(self, x):
        up = self.up
        while (p := up.get(x, x)) != x:
            up[x] = up.get(p, p)
            x = up[x]
        return x

    def add(self, a: int, b: int) -> bool:
        if len(self.up) > self.limit:
            self.up = {}
        a, b = self._root(a), self._root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning(members, positions: tuple[int, ...], scan: int = 4096) -> list[tuple[int, int]]:
    """A spanning forest of the links (at most 3 bits) among distinct sorted fingerprints.

    ``members`` agree on the bytes at ``positions``. Up to ``scan`` members not
    reached yet are compared directly; above that, the ways to flip up to 3 of the
    free bits (2,324 of 24 bits, 5,488 of 32) are looked up.
    """
    import numpy as np

    out: list[tuple[int, int]] = []
    if len(members) > scan:
        free = [np.uint64(1) << np.uint64(8 * p + k) for p in range(POSITIONS) if p not in positions for k in range(8)]
        flips = np.array([sum(map(int, s)) for n in range(1, MAX_BITS + 1) for s in combinations(free, n)], np.uint64)
        order = np.sort(members)
        alive = np.ones(len(order), bool)
        for i in range(len(order)):
            if not alive[i]:
                continue
            alive[i] = False
            todo = [order[i]]
            while todo:
                x = todo.pop()
                probe = flips ^ x
                at = np.minimum(np.searchsorted(order, probe), len(order) - 1)
                hit = at[(order[at] == probe) & alive[at]]
                alive[hit] = False
                todo += list(order[hit])
                out += [(int(x.view(np.int64)), y) for y in order[hit].view(np.int64).tolist()]
        return out
    rest = members
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            x = todo.pop()
            near = linked(rest, x)
            if near.any():
                found = rest[near]
                rest = rest[~near]
                todo += list(found)
                out += [(int(x.view(np.int64)), y) for y in found.view(np.int64).tolist()]
    return out


def _best() -> Column:
    """The least (id, uid) of a group, null ids last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("uid"))).alias("best")


def owners(rows: DataFrame) -> DataFrame:
    """(fp, best): for every fingerprint, the least (id, uid) of its component, written out."""
    distinct = materialise(rows.groupBy("fp").agg(_best()), "fps")
    nodes = materialise(components(links(distinct.select("fp"))), "nodes")
    linked = nodes.join(distinct, nodes["node"] == distinct["fp"]).select("node", "root", "best")
    least = counted(linked.groupBy("root").agg(F.min("best").alias("best")), "roots", 100_000)
    moved = counted(nodes.join(least, "root").select(F.col("node").alias("fp"), F.col("best").alias("least")), "moved", 100_000)
    return materialise(distinct.join(moved, "fp", "left").select("fp", F.coalesce("least", "best").alias("best")), "owners")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = materialise(fingerprints(docs, id_col, text_col), "simhash")
    found = owners(rows)
    return rows.select("doc_id", "fp").join(found, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def keep_near(docs: DataFrame, columns: tuple[str, ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, with ``columns`` only."""
    rows = materialise(fingerprints(docs, id_col, text_col, columns), "simhash")
    found = owners(rows.select("uid", "doc_id", "fp"))
    losers = counted(rows.select("uid", "fp").join(found, "fp").where("uid <> best.uid").select("uid"), "losers")
    return rows.join(losers, "uid", "left_anti").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)])


def op8_simhash_near_dedup(spark, sf_dir):
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
