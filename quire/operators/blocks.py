"""Similar pairs among large sets of numbers, compared block by block.

Long texts of one language hold nearly the same shingles, so an index by parts
makes nearly all of them candidates, many times over. Here sets are cut by size
into blocks, and every two blocks whose sizes fit meet in one group:

* sets that are not about as far from a few landmarks are not compared, as texts
  of two languages;
* a set has a print of 512 bits, the parities of its numbers by hash. Two prints
  differ in at most as many bits as the sets in elements, so pairs beyond the
  bound of the threshold fall out at some nanoseconds each, and none is lost;
* what is left is counted exactly in the same group, by maps of a bit for each
  number that is frequent in the two blocks, and the few others one by one.

Sets travel as packed bytes, once for each block that theirs meets; a group
holds two blocks of a bounded number of elements and hands on its pairs in
batches. The comparisons grow with the square of the number of sets; there is
one group for two blocks, and one partition for a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.tables import materialise

#: Elements that a block may hold (two bytes each), and blocks at least where there are as many sets.
BLOCK = 20_000_000
BLOCKS = 12
#: Bits of a print.
BITS = 512
#: Numbers lie below this.
LIMIT = 1 << 16
#: Pairs of prints compared at once; further words are looked at while more than one of ``MANY`` is left.
STRIP, MANY = (32, 2048), 12
#: Pairs counted at once, and pairs of a batch of the result at least.
PAIRS, FOUND = 4096, 50_000
#: Landmarks of two blocks at most, and the share of their numbers that two of them do not have in common at least.
LANDMARKS, UNLIKE = 6, 0.75
#: One of so many elements may lie beside the maps of two blocks; bits that tell where such elements can be common.
BESIDE, HINT = 400, 128


def packed(numbers) -> bytes:
    """Sorted numbers below ``LIMIT`` as their differences, low bytes before high ones, which compress well."""
    import numpy as np

    steps = np.diff(numbers, prepend=0).astype("<u2")
    return steps.view(np.uint8).reshape(-1, 2).T.tobytes()


def _unpacked(column):
    """(elements of all sets, their bounds) of a column of packed sets."""
    import numpy as np

    rows = column.to_pylist()
    bounds = np.zeros(len(rows) + 1, np.int64)
    np.cumsum([len(r) // 2 for r in rows], out=bounds[1:])
    out = np.empty(int(bounds[-1]), np.uint16)
    for k, raw in enumerate(rows):
        halves = np.frombuffer(raw, np.uint8).reshape(2, -1)
        out[bounds[k] : bounds[k + 1]] = np.cumsum(halves[0] + (halves[1].astype(np.uint32) << 8))
    return out, bounds


def _prints(elements, bounds):
    """Eight words a set."""
    import numpy as np

    x = (np.arange(1, LIMIT + 1, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    places = ((x ^ (x >> np.uint64(27))) >> np.uint64(20)).astype(np.int64) % BITS
    out = np.empty((len(bounds) - 1, BITS // 64), np.uint64)
    for lo in range(0, len(out), 2000):
        hi = min(lo + 2000, len(out))
        owner = np.repeat(np.arange(hi - lo), np.diff(bounds[lo : hi + 1]))
        held = np.bincount(owner * BITS + places[elements[bounds[lo] : bounds[hi]]], minlength=(hi - lo) * BITS)
        out[lo:hi] = np.packbits((held & 1).astype(np.uint8).reshape(hi - lo, BITS), axis=1).view(np.uint64)
    return out


class _Side:
    """The sets of a block in order of size."""

    def __init__(self, table):
        import numpy as np

        table = table.sort_by("n")
        self.i = table.column("i").to_numpy()
        self.elements, self.bounds = _unpacked(table.column("packed"))
        self.n = np.diff(self.bounds)
        self.prints = _prints(self.elements, self.bounds)
        self.words = np.ascontiguousarray(self.prints.T)

    def at(self, k: int):
        return self.elements[self.bounds[k] : self.bounds[k + 1]]

    def mapped(self, place, width: int) -> None:
        """Turns the elements into ``maps``, a bit for each that has a place below ``width``, and ``rest``, the others."""
        import numpy as np

        m = len(self.n)
        self.maps = np.empty((m, width // 64), np.uint64)
        rest, counts = [], np.zeros(m + 1, np.int64)
        self.hints = np.empty((m, HINT // 64), np.uint64)
        step = max(1, (1 << 23) // width)
        for lo in range(0, m, step):
            hi = min(lo + step, m)
            part = self.elements[self.bounds[lo] : self.bounds[hi]]
            owner, at = np.repeat(np.arange(hi - lo), self.n[lo:hi]), place[part]
            inside = at < width
            held = np.zeros((hi - lo, width), np.uint8)
            held[owner[inside], at[inside]] = 1
            self.maps[lo:hi] = np.packbits(held, axis=1).view(np.uint64)
            left = part[~inside]
            hint = np.zeros((hi - lo, HINT), np.uint8)
            hint[owner[~inside], left % HINT] = 1
            self.hints[lo:hi] = np.packbits(hint, axis=1).view(np.uint64)
            rest.append(left)
            counts[lo + 1 : hi + 1] = np.bincount(owner[~inside], minlength=hi - lo)
        self.rest, self.starts = np.concatenate(rest) if rest else self.elements[:0], np.cumsum(counts)
        self.beside = np.diff(self.starts)
        del self.elements


def _facing(x: _Side, y: _Side) -> None:
    """Maps two sides by the numbers that are frequent in them: all but one of ``BESIDE`` elements, in twice the room of the elements at most."""
    import numpy as np

    sides = [x] if x is y else [x, y]
    held = sum(np.bincount(s.elements, minlength=LIMIT) for s in sides)
    order = np.argsort(-held, kind="stable")
    covered = np.cumsum(held[order])
    wanted = int(np.searchsorted(covered, covered[-1] - covered[-1] // BESIDE)) + 1
    room = 32 * int(covered[-1]) // max(1, sum(len(s.n) for s in sides))
    width = 64 * max(1, -(-min(wanted, room) // 64))
    place = np.empty(LIMIT, np.int32)
    place[order] = np.arange(LIMIT)
    for s in sides:
        s.mapped(place, width)


def _landmarks(x: _Side, y: _Side) -> None:
    """Gives both sides ``far``, how many numbers each set and a few landmarks do not share, and ``x`` an order in which sets by one landmark stand together.

    Landmarks are sets that have little in common, as texts of two languages; of
    texts alike there is one. They save comparisons and lose no pair.
    """
    import numpy as np

    sides = [x] if x is y else [x, y]
    some = [s.at(k) for s in sides for k in np.unique(np.linspace(0, len(s.n) - 1, 32).astype(np.int64)).tolist()]
    unlike = lambda a, b: 1 - 2 * len(np.intersect1d(a, b, assume_unique=True)) / (len(a) + len(b))
    chosen, apart = [some[0]], np.array([unlike(some[0], b) for b in some])
    while len(chosen) < LANDMARKS and apart.max() >= UNLIKE:
        chosen.append(some[int(apart.argmax())])
        apart = np.minimum(apart, [unlike(chosen[-1], b) for b in some])
    seen = np.zeros(LIMIT, bool)
    for s in sides:
        s.far = np.empty((len(chosen), len(s.n)), np.int32)
        for k, landmark in enumerate(chosen):
            seen[landmark] = True
            s.far[k] = len(landmark) + s.n - 2 * np.add.reduceat(seen[s.elements], s.bounds[:-1], dtype=np.int32)
            seen[landmark] = False
    by = np.argmin(x.far / (x.n + np.array([[len(c)] for c in chosen])), axis=0)
    x.order = np.lexsort((x.n, by))


def _words(bound: int) -> int:
    """Words of a print that are looked at first: as many as tell unlike sets, which differ in half of the bits, from the bound."""
    return next((w for w in range(1, BITS // 64) if 32 * w - 16 * w**0.5 >= 1.2 * bound), BITS // 64)


def _near(x: _Side, y: _Side, threshold: Fraction, same: bool):
    """(places in x, places in y) of sets whose sizes and prints allow the threshold; of one block, pairs of different places once.

    A strip of pairs is held against the bound of its largest sets first, by some
    words of the prints, or by all where these leave many pairs; what is left is
    held against its own bound.
    """
    import numpy as np

    p, q = threshold.numerator, threshold.denominator
    for a, b in _gathered(_strips(x, y, threshold, same), PAIRS):
        na, nb = x.n[a], y.n[b]
        ok = (na * q >= nb * p) & (nb * q >= na * p)
        a, b = a[ok], b[ok]
        ok = np.bitwise_count(x.prints[a] ^ y.prints[b]).sum(1, dtype=np.int64) * (q + p) <= (x.n[a] + y.n[b]) * (q - p)
        if ok.any():
            yield a[ok], b[ok]


def _strips(x: _Side, y: _Side, threshold: Fraction, same: bool):
    """The pairs of places that the strips leave."""
    import numpy as np

    p, q = threshold.numerator, threshold.denominator
    rows, columns = STRIP
    room, bits = np.empty(rows * columns, np.uint64), np.empty(rows * columns, np.uint8)
    counts, near = np.empty(rows * columns, np.uint16), np.empty(-(-rows * columns // 8) * 8, bool)
    for lo in range(0, len(x.n), rows):
        row = x.order[lo : lo + rows]
        least, largest = int(x.n[row].min()), int(x.n[row].max())
        first = int(np.searchsorted(y.n * q, least * p, "left"))
        last = int(np.searchsorted(y.n * p, largest * q, "right"))
        if same:
            first = max(first, int(row.min()) + 1)
        if first >= last:
            continue
        # similar sets are as far from a landmark, but for the bound
        most = (largest + int(y.n[last - 1])) * (q - p) // (q + p)
        fits = np.ones(last - first, bool)
        for of_x, of_y in zip(x.far, y.far, strict=True):
            fits &= (of_y[first:last] >= of_x[row].min() - most) & (of_y[first:last] <= of_x[row].max() + most)
        column = np.flatnonzero(fits) + first
        for at in range(0, len(column), columns):
            there = column[at : at + columns]
            shape, size = (len(row), len(there)), len(row) * len(there)
            apart, differ, ones = (c[:size].reshape(shape) for c in (counts, room, bits))
            most = (largest + int(y.n[there[-1]])) * (q - p) // (q + p)
            few = _words(most)
            near[size:] = False
            for w in range(BITS // 64):
                np.bitwise_xor(x.words[w][row, None], y.words[w][there], out=differ)
                np.bitwise_count(differ, out=ones)
                if w:
                    np.add(apart, ones, out=apart)
                else:
                    apart[:] = ones
                if w + 1 >= few:
                    np.less_equal(apart, most, out=near[:size].reshape(shape))
                    if np.count_nonzero(near) * MANY <= size:
                        break
            # eight pairs at a time, as few are left
            eight = np.flatnonzero(near.view(np.uint64))
            left = np.flatnonzero(near.reshape(-1, 8)[eight])
            left = eight[left >> 3] * 8 + (left & 7)
            if len(left):
                a, b = np.divmod(left, len(there))
                a, b = row[a], there[b]
                yield (a[a < b], b[a < b]) if same else (a, b)


def _gathered(pairs, least: int):
    """Pairs of arrays, put together to ``least`` numbers at least."""
    import numpy as np

    held, n = [], 0
    for pair in pairs:
        held.append(pair)
        n += len(pair[0])
        if n >= least:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def _beside(x: _Side, y: _Side, a, b):
    """How many numbers of ``rest`` the sets at the places have in common."""
    import numpy as np

    def keys(side, at):
        n = side.beside[at]
        ends = np.cumsum(n)
        return np.repeat(np.arange(len(at)) * LIMIT, n) + side.rest[np.arange(int(n.sum())) + np.repeat(side.starts[at] - ends + n, n)]

    out = np.zeros(len(a), np.int64)
    ends = np.cumsum(x.beside[a] + y.beside[b])
    lo = 0
    while lo < len(a):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 2_000_000, "right")))
        met = np.sort(np.concatenate([keys(x, a[lo:hi]), keys(y, b[lo:hi])]), kind="stable")
        out[lo:hi] = np.bincount(met[1:][met[1:] == met[:-1]] // LIMIT, minlength=hi - lo)
        lo = hi
    return out


def _compare(x: _Side, y: _Side, threshold: Fraction, same: bool, known: int):
    """Batches (ia, ib, similarity) of the pairs at or above the threshold, of two sides that are ``_facing``; pairs of two sets below ``known`` are left out."""
    import numpy as np

    p, q = threshold.numerator, threshold.denominator
    for near_a, near_b in _gathered(_near(x, y, threshold, same), PAIRS):
        for lo in range(0, len(near_a), PAIRS):
            a, b = near_a[lo : lo + PAIRS], near_b[lo : lo + PAIRS]
            if known:
                ok = (x.n[a] >= known) | (y.n[b] >= known)
                a, b = a[ok], b[ok]
            both = np.bitwise_count(x.maps[a] & y.maps[b]).sum(1, dtype=np.uint32).astype(np.int64)
            n = x.n[a] + y.n[b]
            # what the maps leave open can be common at most
            ok = (both + np.minimum(x.beside[a], y.beside[b])) * (p + q) >= n * p
            a, b, both, n = a[ok], b[ok], both[ok], n[ok]
            # rests without a hint in common have no number in common
            open_ = np.flatnonzero((x.hints[a] & y.hints[b]).any(1))
            if len(open_):
                both[open_] += _beside(x, y, a[open_], b[open_])
            ok = both * (p + q) >= n * p
            if ok.any():
                yield x.i[a[ok]], y.i[b[ok]], both[ok] / (n[ok] - both[ok])


def _cut(sizes: list[tuple[int, int]], block: int) -> list[tuple[int, int, int, int]]:
    """(size, first block, number of blocks over which its sets are dealt) of (size, sets): blocks of sizes side by side, with ``block`` elements at most but for one size's overhang."""
    out, at, held = [], 0, 0
    for n, m in sizes:
        if held and held + n * m > block:
            at, held = at + 1, 0
        parts = -(-n * m // block)
        out.append((n, at, parts))
        at, held = (at, held + n * m) if parts == 1 else (at + parts, 0)
    return out


def _spread(of_x: list, of_y: list | None, threshold: Fraction) -> list[tuple[int, int]]:
    """The pairs of blocks that have sizes which fit."""

    def ranges(cut):
        out: dict[int, list[int]] = {}
        for n, at, parts in cut:
            for b in range(at, at + parts):
                out.setdefault(b, []).append(n)
        return {b: (min(n), max(n)) for b, n in out.items()}

    x, y = ranges(of_x), ranges(of_x if of_y is None else of_y)
    p, q = threshold.numerator, threshold.denominator
    return [(a, b) for a, (a0, a1) in x.items() for b, (b0, b1) in y.items() if (of_y is not None or a <= b) and a1 * q >= b0 * p and b1 * q >= a0 * p]


def _apart(spark: SparkSession, n: int) -> list[int]:
    """Numbers that a shuffle to ``n`` partitions deals out one to each, so that no task waits behind several groups."""
    if n < 2:
        return list(range(n))
    tried = spark.range(n * 40).select(F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).alias("part"), F.col("id").cast("int").alias("g"))
    free = dict(tried.groupBy("part").agg(F.min("g")).collect())
    # a partition that none of them meets gets none: its group goes beside another
    return [free.get(k, n * 40 + k) for k in range(n)]


def similar_large(x: DataFrame, threshold: Fraction, known: int = 0, y: DataFrame | None = None, label: str = "dense") -> DataFrame:
    """Pairs (ia, ib, similarity) at or above the threshold of sets (i, n, packed), written out; with ``y``, of one in ``x`` and one in ``y``.

    Pairs of two sets smaller than ``known`` are left out. Within ``x``, ia < ib.
    """
    spark = x.sparkSession
    tables = [x] if y is None else [x, y]
    # one row a size
    sizes = [sorted((r["n"], r["m"]) for r in t.groupBy("n").agg(F.count("*").alias("m")).collect()) for t in tables]
    found = T._parse_datatype_string("ia long, ib long, similarity double")
    if not all(sizes):
        return spark.createDataFrame([], found)
    cuts = [_cut(s, min(BLOCK, max(1, sum(n * m for n, m in s) // BLOCKS))) for s in sizes]
    pairs = _spread(cuts[0], cuts[1] if y is not None else None, threshold)
    meets: list[dict[int, list[tuple[int, int]]]] = [{}, {}]
    numbers = _apart(spark, len(pairs))
    for g, (a, b) in zip(numbers, pairs, strict=True):
        meets[0].setdefault(a, []).append((g, 0))
        if y is not None or a != b:
            meets[-1 if y is not None else 0].setdefault(b, []).append((g, 1))
    sides = []
    for t, cut, met in zip(tables, cuts, meets, strict=False):
        # one row a size, and one a block: bounded by the numbers there can be
        place = F.broadcast(spark.createDataFrame(cut, "n int, _at int, _parts int"))
        groups = F.broadcast(spark.createDataFrame(list(met.items()), "_block int, _meets array<struct<g:int,side:int>>"))
        dealt = t.join(place, "n").withColumn("_block", F.col("_at") + F.pmod(F.xxhash64("i"), F.col("_parts")).cast("int"))
        sides.append(dealt.join(groups, "_block").select("i", "n", "packed", F.explode("_meets").alias("_m")).select("_m.g", "_m.side", "i", "n", "packed"))
    rows = sides[0] if y is None else sides[0].unionByName(sides[1])
    own = {g for g, (a, b) in zip(numbers, pairs, strict=True) if y is None and a == b}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import pyarrow.compute as pc

        table = pa.Table.from_batches(list(batches))
        one, other = (table.filter(pc.equal(table.column("side"), k)) for k in (0, 1))
        left = _Side(one)
        # a block that meets itself comes once; one dealt out by hash can be empty
        same = table.column("g")[0].as_py() in own
        right = left if same else _Side(other)
        del table, one, other
        if not (len(left.n) and len(right.n)):
            return
        _landmarks(left, right)
        _facing(left, right)
        for a, b, s in _gathered(_compare(left, right, threshold, same, known), FOUND):
            if y_is_none:
                a, b = np.minimum(a, b), np.maximum(a, b)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(s, pa.float64())], names=["ia", "ib", "similarity"])

    y_is_none = y is None
    return materialise(rows.repartition(len(numbers), "g").groupBy("g").applyInArrow(compare, found), label)
