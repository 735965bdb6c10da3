"""Duplicate papers by DOI and by near-identical title.

The title test is the Jaccard similarity of 3-character shingle sets. Pairs are
found by a lossless partition join, never by comparing all titles:

* identical normalised titles collapse first;
* sets of similarity t or more differ in at most ``2 m (1 - t) / (1 + t)``
  elements, m being the larger size. Sets fall into classes of sizes that t
  allows beside each other; the shingles of a set are dealt by hash into one
  part more than that bound, so at least one part of two similar sets is equal.
  A set has about one index key for every six of its shingles, however long its
  text, and unrelated titles hardly ever agree on a part;
* a set belongs to the partition of its own class and to that of the next one,
  where it meets the sets of that class only. Sets so small that one differing
  shingle breaks the threshold are indexed whole;
* sets of ``LARGE`` shingles and more are not indexed: long texts of a language
  agree on many parts whether they are similar or not. They are compared by
  prints, block by block (``blocks``).

Shingles are numbered and dealt in Arrow batches, which is much faster than
higher-order functions over a character at a time; candidates are verified exactly, in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.doi import doi_key
from quire.functions.text import normalize_text
from quire.operators.blocks import packed, similar_large
from quire.operators.components import components
from quire.tables import BROADCAST_ROWS, counted, materialise, number_rows

THRESHOLD = 0.92
#: Shingles there can be: three characters of 37.
SHINGLES = 37**3
#: Size of the sets from which on all are compared by prints.
LARGE = 256
#: Rows of a group that one task holds against the whole group, pairs that a task lists, and tasks at most.
RUN, TASK_PAIRS, MOST_TASKS = 10_000, 500_000, 2000


def _likenesses(a: pa.Array, b: pa.Array) -> pa.Array:
    """Jaccard similarity of the sets of three code points, 0 for null; a hundred texts at a time."""
    import numpy as np
    import pyarrow as pa

    def codes(raw: bytes):
        x = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)
        return np.unique((x[:-2] << np.uint64(42)) | (x[1:-1] << np.uint64(21)) | x[2:]) if len(x) > 2 else x[:0]

    parts = []
    for lo in range(0, len(a), 100):
        values = []
        for x, y in zip(*(c.slice(lo, 100).cast(pa.binary()).to_pylist() for c in (a, b)), strict=True):
            s, t = codes(x or b""), codes(y or b"")
            both = len(np.intersect1d(s, t, assume_unique=True)) if len(s) and len(t) else 0
            values.append(both / (len(s) + len(t) - both) if both else 0.0)
        parts.append(pa.array(values, pa.float64()))
    return pa.concat_arrays(parts) if parts else pa.array([], pa.float64())


def jaccard3(a: Column, b: Column) -> Column:
    """0 if either is empty, 1 if equal, else the Jaccard similarity of 3-character shingles (0 without any).

    The sets are compared in Arrow batches: as arrays of strings they take a
    hash and an object for each character.
    """
    other = (a != "") & (b != "") & (a != b)
    value = F.arrow_udf(_likenesses, "double")(F.when(other, a), F.when(other, b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(value)


def _share(threshold: float) -> Fraction:
    return Fraction(str(threshold))


def size_classes(threshold: float, largest: int = SHINGLES) -> tuple[int, list[int], list[int]]:
    """Up to which size only equal sets are similar; beyond, the least size of each class and its number of parts."""
    t = _share(threshold)
    if t >= 1:
        return 1 << 30, [], []
    alone = -(-t.numerator // (t.denominator - t.numerator)) - 1  # n / (n + 1) < t
    least, parts, low = [], [], alone + 1
    while not least or least[-1] <= largest:
        most = low * t.denominator // t.numerator
        least.append(low)
        parts.append(2 * most * (t.denominator - t.numerator) // (t.denominator + t.numerator) + 1)
        low = most + 1
    return alone, least, parts


def _large(threshold: float) -> tuple[int, int]:
    """The least sizes of the sets that ``blocks`` compares and of those that have no index key: the class before these may be similar to them."""
    alone, least, _ = size_classes(threshold)
    if not least:
        return SHINGLES + 1, SHINGLES + 1
    c = next(c for c, n in enumerate(least) if n >= LARGE or n > SHINGLES)
    return least[max(c - 1, 0)], least[c]


def _hashes(seed: int, n: int = SHINGLES):
    """Fixed 64-bit hashes of the first ``n`` numbers (the splitmix64 finaliser)."""
    import numpy as np

    x = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def indexed(titles: DataFrame, threshold: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """Normalised titles (``_t``) with shingles: i (unique once written), _t, s (their numbers, sorted), own and guest (index keys, none for large sets), packed (of sets that ``blocks`` compares), and the carried columns."""
    alone, least, parts = size_classes(threshold)
    compared, unkeyed = _large(threshold)

    def index(batches):
        from bisect import bisect_right

        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        places, values, salts = _hashes(0), _hashes(1 << 20), _hashes(1 << 21, 1 << 17)
        letter = np.zeros(256, np.int32)
        for k, c in enumerate(b" abcdefghijklmnopqrstuvwxyz0123456789"):
            letter[c] = k

        def keys(s, c: int):
            """One key a part of the partition of class ``c``, empty parts too."""
            m = parts[c]
            held = np.zeros(m, np.uint64)
            np.bitwise_xor.at(held, (places[s] % np.uint64(m)).astype(np.int64), values[s])
            return ((held ^ salts[:m]) * np.uint64(2 * c + 1) + salts[m]).view(np.int64)

        i = TaskContext.get().partitionId() << 36
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                texts = batch.column(0).slice(lo, 500)
                rows = []
                for raw in texts.cast(pa.binary()).to_pylist():
                    x = letter[np.frombuffer(raw, np.uint8)]
                    s = np.unique((x[:-2] * 37 + x[1:-1]) * 37 + x[2:]) if len(x) > 2 else x[:0]
                    own = guest = np.zeros(0, np.int64)
                    if 0 < len(s) <= alone:
                        own = (np.bitwise_xor.reduce(values[s], keepdims=True) * np.uint64(2)).view(np.int64)
                    elif 0 < len(s) < unkeyed:
                        c = bisect_right(least, len(s)) - 1
                        own = keys(s, c)
                        guest = keys(s, c + 1) if c + 1 < len(parts) and least[c + 1] < unkeyed else guest
                    rows.append((s, own, guest, packed(s) if len(s) >= compared else None))
                ids = pa.array(range(i, i + len(rows)), pa.int64())
                more = [c.slice(lo, 500) for c in batch.columns[1:]]
                lists = [pa.array([r[k] for r in rows], pa.list_(kind)) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([ids, texts, *lists, pa.array([r[3] for r in rows], pa.binary()), *more], names=["i", "_t", "s", "own", "guest", "packed", *carry])
                i += len(rows)

    inputs = titles.select("_t", *carry)
    found = T._parse_datatype_string("i long, _t string, s array<int>, own array<long>, guest array<long>, packed binary")
    return inputs.mapInArrow(index, T.StructType([*found.fields, *inputs.schema.fields[1:]]))


def _title_sets(titles: DataFrame, threshold: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """``indexed`` titles with shingles, written out."""
    return materialise(indexed(titles, threshold, carry).where(F.size("s") > 0), "shingles")


def _fitting(threshold: float, a: str, b: str) -> Column:
    """Whether the sizes of two sets allow the similarity."""
    t = _share(threshold)
    return F.expr(f"{a} * {t.denominator} >= {b} * {t.numerator} AND {b} * {t.denominator} >= {a} * {t.numerator}")


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Pairs (ia, ib) at or above the threshold, with similarity; arrays move for titles in a pair only."""
    met = counted(pairs.select(F.col("ia").alias("i")).union(pairs.select("ib")).distinct(), "met")
    known = sets.join(met, "i", "left_semi")
    left, right = (known.select(F.col("i").alias(f"i{c}"), F.col("s").alias(f"s{c}")) for c in "ab")
    common = pairs.join(left, "ia").join(right, "ib").select("ia", "ib", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    ratio = F.col("both").cast("double") / (F.col("na") + F.col("nb") - F.col("both"))
    return common.where(ratio >= F.lit(float(threshold))).select("ia", "ib", ratio.alias("similarity"))


def _similar_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs (ia, ib, similarity) of ``_title_sets`` at or above the threshold."""
    index = sets.select("i", F.size("s").alias("n"), F.explode("own").alias("k"), F.lit(False).alias("guest")).unionByName(sets.select("i", F.size("s").alias("n"), F.explode("guest").alias("k"), F.lit(True).alias("guest")))
    x, y = index.alias("x"), index.alias("y")
    pairs = materialise(x.join(y, F.expr("x.k = y.k AND x.i < y.i AND NOT (x.guest AND y.guest)") & _fitting(threshold, "x.n", "y.n")).select(F.col("x.i").alias("ia"), F.col("y.i").alias("ib")).distinct(), "pairs")
    compared, unkeyed = _large(threshold)
    large = similar_large(_compared(sets), _share(threshold), unkeyed if unkeyed > compared else 0)
    return _verified(pairs, sets, threshold).unionByName(large)


def _compared(sets: DataFrame) -> DataFrame:
    """The sets that ``blocks`` compares."""
    return sets.where("packed IS NOT NULL").select("i", F.size("s").alias("n"), "packed")


def similar_titles(titles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Distinct normalised titles (``_t``, and a number ``p`` each) to the pairs (ia, ib, similarity) of numbers, ia < ib, of different titles at or above the threshold.

    Only numbers move; of the shingles only those of titles in a candidate pair,
    and of large sets once for each block they meet.
    """
    return _similar_sets(_title_sets(titles, threshold, ("p",)).withColumn("i", F.col("p")), threshold)


def _prepared(papers: DataFrame, order: tuple[str, ...], compose: bool) -> DataFrame:
    place = F.struct(*order)
    return papers.select(place.alias("_at"), F.coalesce("doi", F.lit("")).alias("doi"), normalize_text(F.col("title"), compose).alias("_t"))


def find_duplicates(papers: DataFrame, threshold: float = THRESHOLD, compose: bool = True) -> DataFrame:
    """All pairs (pos_a < pos_b, similarity): equal DOIs (letter case aside) score 1, else titles at or above the threshold.

    The result itself lists every pair of every group of duplicates;
    ``duplicate_classes`` says the same in one row a paper.
    """
    rows = _with_heads(papers, compose)
    x, y = rows.alias("x"), rows.alias("y")
    one = F.lit(1.0).alias("similarity")
    # the three kinds have no pair in common, so the pairs need not meet again
    other_doi = "(x.d = '' OR x.d <> y.d)"
    by_doi = _pairs_within(rows.where("d <> ''").select("p", "d"), "d").select(F.col("x.p").alias("pos_a"), F.col("y.p").alias("pos_b"), one)
    same_title = _pairs_within(rows.where("h IS NOT NULL").select("p", "d", "h"), "h").where(other_doi).select(F.col("x.p").alias("pos_a"), F.col("y.p").alias("pos_b"), one)
    near = materialise(similar_titles(_heads(rows), threshold), "near")
    by_near = near.join(x, F.col("ia") == F.col("x.h")).join(y, F.expr(f"ib = y.h AND {other_doi}")).select(F.least("x.p", "y.p").alias("pos_a"), F.greatest("x.p", "y.p").alias("pos_b"), "similarity")
    return reduce(DataFrame.union, [by_doi, same_title, by_near])


def _pairs_within(rows: DataFrame, key: str) -> DataFrame:
    """All pairs (x, y) of rows with one key, x.p < y.p, dealt out by the number of pairs.

    Rows are few beside their pairs, so their bytes would leave them to few tasks.
    A group beyond ``RUN`` rows is cut into runs, each of which meets the whole group.
    """
    sizes = materialise(rows.groupBy(key).agg(F.count("*").alias("m")).where("m > 1"), "sizes")
    pairs = sizes.agg(F.sum(F.col("m").cast("double") * F.col("m") / 2)).first()[0] or 0
    tasks = int(min(1 + pairs // TASK_PAIRS, MOST_TASKS))
    # of so many rows in all, few groups are that large
    large = sizes.where(F.col("m") > RUN).select(key, F.ceil(F.col("m") / RUN).cast("int").alias("_runs"))
    known = rows.join(F.broadcast(large), key, "left").withColumn("_runs", F.coalesce("_runs", F.lit(1)))
    x = known.withColumn("_run", F.pmod(F.xxhash64("p"), F.col("_runs")).cast("int")).drop("_runs").repartition(tasks, key, "_run")
    y = known.withColumn("_run", F.explode(F.sequence(F.lit(0), F.col("_runs") - 1))).drop("_runs").repartition(tasks, key, "_run")
    return x.alias("x").join(y.alias("y"), F.expr(f"x.{key} = y.{key} AND x._run = y._run AND x.p < y.p"))


def _with_heads(papers: DataFrame, compose: bool) -> DataFrame:
    """p, d (lower-case DOI), h (the first paper with the same normalised title, null without one) and, at that paper, _t; written out."""
    rows = materialise(_prepared(papers, ("_pos",), compose).select(F.col("_at._pos").alias("p"), F.lower("doi").alias("d"), "_t"), "papers")
    heads = rows.where("_t <> ''").groupBy(F.sha2("_t", 256).alias("k")).agg(F.min("p").alias("h"))
    found = rows.withColumn("k", F.when(F.col("_t") != "", F.sha2("_t", 256))).join(heads, "k", "left")
    return materialise(found.select("p", "d", "h", F.when(F.col("p") == F.col("h"), F.col("_t")).alias("_t")), "heads")


def _heads(rows: DataFrame) -> DataFrame:
    return rows.where("p = h").select("_t", "p")


def duplicate_classes(papers: DataFrame, threshold: float = THRESHOLD, compose: bool = True) -> tuple[DataFrame, DataFrame]:
    """The duplicates of ``find_duplicates`` without writing out all pairs of copies: (members, links).

    ``members`` has one row a paper: _pos, by_doi and by_title, the first paper
    with the same DOI and with the same normalised title (null without one).
    ``links`` has the similar pairs (a, b, similarity) among the ``by_title``
    papers. Two papers are duplicates where they share ``by_doi`` or
    ``by_title``, or where a link joins their titles.
    """
    return duplicate_members(papers, compose), duplicate_links(papers, threshold, compose)


def duplicate_members(papers: DataFrame, compose: bool = True) -> DataFrame:
    """The members of ``duplicate_classes``: of a title only its digest moves."""
    rows = materialise(papers.select(F.col("_pos"), F.lower(F.coalesce("doi", F.lit(""))).alias("d"), normalize_text(F.col("title"), compose).alias("_t")).select("_pos", F.when(F.col("d") != "", F.col("d")).alias("d"), F.when(F.col("_t") != "", F.sha2("_t", 256)).alias("k")), "papers")
    dois = rows.where("d IS NOT NULL").groupBy("d").agg(F.min("_pos").alias("by_doi"))
    titles = rows.where("k IS NOT NULL").groupBy("k").agg(F.min("_pos").alias("by_title"))
    return rows.join(dois, "d", "left").join(titles, "k", "left").select("_pos", "by_doi", "by_title")


def duplicate_links(papers: DataFrame, threshold: float = THRESHOLD, compose: bool = True) -> DataFrame:
    """The links of ``duplicate_classes``."""
    return similar_titles(_heads(_with_heads(papers, compose)), threshold).select(F.col("ia").alias("a"), F.col("ib").alias("b"), "similarity")


def _decide(papers: DataFrame, order: tuple[str, ...], threshold: float, compose: bool) -> DataFrame:
    """(_at, dup): whether a paper is removed, reading papers in order.

    1. A DOI seen before removes a paper, even if its first holder goes for its title.
    2. Of the others, a title at or above the threshold with a *kept* earlier one
       removes a paper. Titles collapse to their first paper (a later copy meets
       either its kept twin or what removed the twin); ``_lost_titles`` decides
       among these.
    """
    rows = papers.select(F.struct(*order).alias("_at"), F.coalesce("doi", F.lit("")).alias("doi"), "title")
    by_doi = Window.partitionBy("_key").orderBy("_at")
    keyed = rows.select("_at", F.when(F.col("doi") != "", doi_key(F.col("doi"))).alias("_key"))
    seen = keyed.where("_key IS NOT NULL").select("_at", (F.row_number().over(by_doi) > 1).alias("doi_dup"))
    first = materialise(seen.union(keyed.where("_key IS NULL").select("_at", F.lit(False))), "doi-step")
    # titles are normalised where the DOI has not decided; the fewer of both sides travel
    again, rest = first.agg(F.count_if("doi_dup"), F.count_if(~F.col("doi_dup"))).first()
    few = first.where("doi_dup" if again <= rest else "NOT doi_dup").select("_at")
    open_ = rows.join(F.broadcast(few) if min(again, rest) <= BROADCAST_ROWS else few, "_at", "left_anti" if again <= rest else "left_semi")
    titles = materialise(open_.select("_at", normalize_text(F.col("title"), compose).alias("_t")), "normalised")
    alive = titles.where("_t <> ''")
    heads = materialise(alive.groupBy("_t").agg(F.min("_at").alias("_at")), "titles")
    lost = _lost_titles(heads, threshold)
    out = alive.join(heads.select("_t", F.col("_at").alias("_head")), "_t").join(lost.select(F.col("_at").alias("_lost")), F.col("_head") == F.col("_lost"), "left")
    titled = out.select("_at", ((F.col("_at") != F.col("_head")) | F.col("_lost").isNotNull()).alias("dup"))
    return titled.union(titles.where("_t = ''").select("_at", F.lit(False))).union(first.where("doi_dup").select("_at", "doi_dup"))


#: Rounds in which the first titles of the index lists settle what is like them, before all other pairs are looked at.
PIVOT_ROUNDS = 3
#: Lists up to this length are compared pair by pair at once.
SHORT_LIST = 256
#: Shares of the large sets that are settled before the others, and how many there must be.
LARGE_SHARES = 64, 8
LEAST_LARGE = 200
#: Links of a component that one task settles.
COMPONENT = 500_000


def _lost_titles(heads: DataFrame, threshold: float) -> DataFrame:
    """(_at): the titles (_t, _at) that go because of an earlier kept one.

    Where the index has long lists, a title that comes first in all of its lists
    is kept, as no earlier one can be like it; what is like it goes. Each list
    names its first title only, so a family of m near copies takes about m
    comparisons, and its losers are out of the lists before the next round. What
    is left after some rounds is compared pair by pair and settled by component.
    """
    # titles are numbered by place, so that numbers compare as places do
    numbered = number_rows(heads.select("_t", F.col("_at").alias("_pos")))
    found = _title_sets(numbered, threshold, ("_n", "_pos"))
    sets = found.select(F.col("_n").cast("long").alias("i"), F.col("_pos").alias("_at"), "s", "own", "guest", "packed")
    index = sets.select("i", F.size("s").alias("n"), F.explode(F.concat("own", "guest")).alias("k"))
    out = sets.select("i").limit(0)
    left = sets
    for gone in _lost_large(sets, threshold):
        out = out.union(gone)
        left = left.join(gone, "i", "left_anti")
    index = index.join(out, "i", "left_anti")
    # only the index knows what is like a title, but for large sets
    large = sets.where("packed IS NOT NULL").select(F.col("i").alias("ia"))
    for _ in range(PIVOT_ROUNDS):
        firsts = materialise(index.groupBy("k").agg(F.min(F.struct("i", "n")).alias("first"), F.count("*").alias("m")).where("m > 1"), "firsts")
        if (firsts.agg(F.max("m")).first()[0] or 0) <= SHORT_LIST:
            break
        listed = index.join(firsts, "k")
        ahead = materialise(listed.where("first.i < i").select("i", F.col("first.i").alias("ia"), _fitting(threshold, "n", "first.n").alias("fits")).distinct(), "ahead")
        # a pivot has nobody ahead
        waiting = counted(ahead.select(F.col("i").alias("ia")).union(large).distinct(), "waiting")
        pairs = materialise(ahead.where("fits").join(waiting, "ia", "left_anti").select("ia", F.col("i").alias("ib")), "pairs")
        gone = materialise(_verified(pairs, sets, threshold).select(F.col("ib").alias("i")).distinct(), "gone")
        if gone.isEmpty():
            break
        out = out.union(gone)
        # titles with nobody ahead are kept, and what is like them is gone: both leave the lists
        open_ = counted(waiting.select(F.col("ia").alias("i")).join(gone, "i", "left_anti"), "open")
        index = materialise(index.join(open_, "i", "left_semi"), "index")
        left = left.join(open_, "i", "left_semi")
    edges = _similar_sets(left, threshold).select(F.col("ia").alias("early"), F.col("ib").alias("late"))
    lost = materialise(out.union(independent(materialise(edges, "edges")).select(F.col("late").alias("i"))).distinct(), "lost")
    return sets.select("i", "_at").join(lost, "i", "left_semi").select("_at")


def _lost_large(sets: DataFrame, threshold: float) -> Iterator[DataFrame]:
    """(i): titles that go, from a first few of all titles to more, where there are many large sets.

    The titles up to some number are settled among themselves, which no later
    one changes; what is like a kept large set of them goes. Long texts of a
    language are much alike, so few of them are left to be linked to each other.
    """
    n = sets.where("packed IS NOT NULL").count()
    left = sets
    for share in LARGE_SHARES:
        if n // share < LEAST_LARGE:
            continue
        place = left.where("packed IS NOT NULL").agg(F.expr(f"approx_percentile(i, {1 / share})")).first()[0]
        if place is None:
            return
        ahead = left.where(F.col("i") <= place)
        edges = materialise(_similar_sets(ahead, threshold).select(F.col("ia").alias("early"), F.col("ib").alias("late")), "edges")
        lost = materialise(independent(edges).select(F.col("late").alias("i")), "lost")
        yield lost
        kept = _compared(ahead.join(lost, "i", "left_anti"))
        like = materialise(similar_large(kept, _share(threshold), 0, _compared(left.where(F.col("i") > place)), "like").select(F.col("ib").alias("i")).distinct(), "gone")
        yield like
        left = left.join(lost.union(like), "i", "left_anti")


def _settled(links):
    """The greedy pass over the links of one task."""
    import pyarrow as pa

    waits: dict[int, int] = {}
    after: dict[int, list[int]] = {}
    for a, b in zip(links.column("early").to_pylist(), links.column("late").to_pylist(), strict=True):
        after.setdefault(a, []).append(b)
        waits[b] = waits.get(b, 0) + 1
    lost: set[int] = set()
    todo = [a for a in after if a not in waits]
    while todo:
        node = todo.pop()
        for late in after.get(node, ()):
            if node not in lost:
                lost.add(late)
            waits[late] -= 1
            if not waits[late]:
                todo.append(late)
    return pa.table({"late": pa.array(sorted(lost), pa.int64())})


def independent(edges: DataFrame, most: int = COMPONENT) -> DataFrame:
    """Nodes (``late``) removed by the greedy pass over edges (early, late) between numbers.

    Components are found in a number of rounds about logarithmic in their size;
    one of at most ``most`` links is settled by one task, so a chain does not
    take a round a link. Larger ones are settled round by round.
    """
    n = edges.count()
    if not n:
        return edges.select("late")
    if n <= most:
        return edges.select("early", "late", F.lit(0).alias("root")).groupBy("root").applyInArrow(_settled, "late long")
    nodes = components(edges.select(F.col("early").alias("a"), F.col("late").alias("b")))
    rooted = edges.join(nodes, F.col("early") == F.col("node")).select("early", "late", "root")
    sizes = materialise(rooted.groupBy("root").agg(F.count("*").alias("n")), "sizes")
    large = sizes.where(F.col("n") > most)

    small = rooted.join(large, "root", "left_anti").groupBy("root").applyInArrow(_settled, "late long")
    if large.isEmpty():
        return small
    return small.union(_by_rounds(materialise(rooted.join(large, "root", "left_semi").select("early", "late"), "large")))


def _by_rounds(edges: DataFrame) -> DataFrame:
    """The same, round by round.

    Every round settles all edges whose early end has no open edge to an earlier
    title, the earliest of all among them, so the rounds come to an end.
    """
    lost = edges.select("late").limit(0)
    while not edges.isEmpty():
        # an early end that is no late end of an open edge is kept: its late ends go
        waiting = edges.select(F.col("late").alias("early")).distinct()
        gone = counted(edges.join(waiting, "early", "left_anti").select("late").distinct(), "gone")
        lost = materialise(lost.union(gone), "lost")
        # edges of removed nodes are settled at either end
        edges = materialise(edges.join(gone, "late", "left_anti").join(gone.select(F.col("late").alias("early")), "early", "left_anti"), "edges")
    return lost


def dedup(papers: DataFrame, threshold: float = THRESHOLD, compose: bool = True) -> tuple[DataFrame, DataFrame]:
    """(unique, removed): the first of each group of duplicates stays."""
    marked = mark_duplicates(papers, ("_pos",), threshold, compose)
    return marked.where("NOT _dup").drop("_dup"), marked.where("_dup").drop("_dup")


def dedup_groups(papers: DataFrame, threshold: float = THRESHOLD, compose: bool = True) -> tuple[DataFrame, DataFrame]:
    """The same across groups: the first group, in order of ``group_pos``, keeps a paper."""
    marked = mark_duplicates(papers, ("group_pos", "_pos"), threshold, compose)
    return marked.where("NOT _dup").drop("_dup"), marked.where("_dup").drop("_dup")


def mark_duplicates(papers: DataFrame, order: tuple[str, ...] = ("_pos",), threshold: float = THRESHOLD, compose: bool = True) -> DataFrame:
    """``papers`` with ``_dup``; ``order`` must name each paper uniquely."""
    return papers.join(duplicate_flags(papers, order, threshold, compose), F.struct(*order) == F.col("_at")).drop("_at")


def duplicate_flags(papers: DataFrame, order: tuple[str, ...] = ("_pos",), threshold: float = THRESHOLD, compose: bool = True) -> DataFrame:
    """(_at, _dup), one row a paper, written out: its ``order`` and whether it is removed."""
    return materialise(_decide(papers, order, threshold, compose).select("_at", F.col("dup").alias("_dup")), "dups")


def distinct_first(values: DataFrame, key: Column, place: str = "_pos") -> DataFrame:
    """The first row of each key, in order of ``place``."""
    row = F.struct(*values.columns)
    return values.groupBy(key.alias("_key")).agg(F.min_by(row, F.col(place)).alias("_row")).select("_row.*")
