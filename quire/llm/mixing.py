"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks of ``block_docs``. Weights are shares
``a / q`` of a period of q slots. Given weights are taken as the decimals they
are written as, and their shares are exact where that makes a period of at most
``LONGEST`` slots. Others (and the default weights, which are no fractions) are
rounded by largest remainders to a period of at least ``PERIOD`` slots, ten a
source, and as many as give the smallest source a slot, ``LONGEST`` at most; a
source then differs from its weight by less than one slot a period, unless the
longest period is too short for the smallest: then each has a slot beforehand. Block i of a source
may be placed from slot ``floor(i q / a)`` on and must be placed before slot
``ceil((i + 1) q / a)``; in every slot the eligible block with the earliest
deadline goes next. One processor and weights that sum to 1 make that rule
feasible, so at every slot each source is less than one block away from its
target. The schedule repeats every q slots, so one period is computed, and a
block's slot follows from its number by arithmetic.

When a source runs out its slots stay empty: the order of the others, and so
their shares relative to each other, is kept. No document is dropped or
repeated.

Built from DataFrame functions alone. Documents are numbered inside their
source without gathering a source in one place: by (source, hash bucket), with
the buckets' running counts added. Every source has a lane of its own, however
many there are. The period is folded from the one-row list of lanes, in groups
of about the root of their number: a slot reads the first block of each group
and works out anew only groups that a block was taken from or came free in.

Defined cases: sources that ``weights`` does not name have ``rest``, the smallest
of its weights where none is given; documents without a source form a source of
their own (named None in ``weights``, or among the rest); null ids
come first in their source; repeated rows are placed each; an empty table gives
an empty result; unnamed columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.runtime import counted, materialise

BLOCK_DOCS = 32
#: Target weight of a source when none are given: its size to this power.
TEMPERATURE = 0.5
PERIOD, LONGEST = 1000, 1_000_000
#: Documents numbered in one place, about, and the most hash digits that name a place.
PLACE_ROWS, MAX_DIGITS = 2000, 5


def _draw(ident: Column) -> Column:
    return F.md5(F.coalesce(ident.cast("string"), F.lit("")))


def exact_shares(present: dict[str | None, int], weights: dict[str | None, float], rest: float | None = None) -> tuple[dict[str | None, int], int, int]:
    """Slots of each named source, of any other one, and of the period, without a common divisor.

    ``present`` counts sources by name; weights count as the decimals they print as.
    """
    named = {s: Fraction(str(weights[s])) for s in present if s in weights}
    other = Fraction(str(min(weights.values()) if rest is None else rest))
    others = sum(n for s, n in present.items() if s not in weights)
    if any(w <= 0 for w in named.values()) or others and other <= 0:
        raise ValueError("weights are above zero")
    every = [*named.values(), *([other] if others else [])]
    scale = math.lcm(*(w.denominator for w in every))
    whole = [int(w * scale) for w in every]
    by = math.gcd(*whole) or 1
    slots = {s: int(w * scale) // by for s, w in named.items()}
    rests = int(other * scale) // by if others else 1
    return slots, rests, sum(slots.values()) + rests * others


def lanes(sizes: DataFrame, weights: dict[str | None, float] | None = None, period: int = PERIOD, rest: float | None = None) -> DataFrame:
    """(source, lane, a, q): each source's lane and its share of the period."""
    sources = sizes.groupBy("source").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.orderBy(F.desc("n"), "source"))
    ranked = sources.select("source", "n", place.alias("lane"))
    if weights is not None:
        names = [s for s in weights if s is not None]
        # as many rows as there are weights, and a count
        known = F.col("source").isin(*names) | (F.col("source").isNull() if None in weights else F.lit(False))
        known = F.coalesce(known, F.lit(False))
        present = {r["source"]: 1 for r in sources.where(known).select("source").collect()}
        slots, others, q = exact_shares(present | {_OTHERS: sources.where(~known).count()}, weights, rest)
        if q <= LONGEST:
            return ranked.select("source", "lane", _by_source(slots, others).cast("long").alias("a"), F.lit(q).cast("long").alias("q"))
        goal = F.sum(_by_source({s: float(weights[s]) for s in slots}, float(min(weights.values()) if rest is None else rest)))
    else:
        goal = F.pow(F.sum(F.col("n").cast("double")), F.lit(TEMPERATURE))
    byl = ranked.groupBy("lane").agg(goal.alias("w"))
    whole = Window.partitionBy()
    total = F.sum("w").over(Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    q = F.least(F.lit(LONGEST), F.greatest(F.lit(period), 10 * F.count("*").over(whole), F.ceil(F.round(total / F.min("w").over(whole), 6)))).cast("long")
    # where the smallest share has no slot of the period, every lane has one to begin with
    sized = byl.select("lane", "w", q.alias("q"), total.alias("total"), F.count("*").over(whole).alias("k"), F.when(F.round(total / F.min("w").over(whole), 6) > LONGEST, 1).otherwise(0).alias("first"))
    parts = sized.select("lane", "q", "k", "first", ((F.col("q") - F.col("k") * F.col("first")) * F.col("w") / F.col("total")).alias("x"))
    floors = parts.select("lane", "q", "k", "first", F.floor("x").alias("f"), (F.col("x") - F.floor("x")).alias("rest"))
    spare = F.col("q") - F.col("k") * F.col("first") - F.sum("f").over(whole)
    shares = floors.select("lane", "q", (F.col("first") + F.col("f") + F.when(F.row_number().over(Window.orderBy(F.desc(F.round("rest", 9)), "lane")) <= spare, 1).otherwise(0)).alias("a"))
    return ranked.join(shares, "lane").select("source", "lane", F.col("a").cast("long").alias("a"), F.col("q").cast("long").alias("q"))


#: Stands for the sources that weights do not name.
_OTHERS = "\0others"


def _by_source(values: dict[str | None, float], other: float) -> Column:
    """The value of a row's source."""
    named = [F.lit(x) for s, v in values.items() if s is not None for x in (s, v)]
    found = F.try_element_at(F.create_map(*named), F.col("source")) if named else F.lit(None)
    none = F.lit(values[None]) if None in values else F.lit(other)
    return F.when(F.col("source").isNull(), none).otherwise(F.coalesce(found, F.lit(other)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def period(shares: DataFrame) -> DataFrame:
    """(lane, turn, slot): earliest deadline first over one period, for every block in it."""
    one = shares.select("lane", "a", "q").distinct().agg(F.sort_array(F.collect_list(F.struct("lane", "a", "q"))).alias("lanes"))
    sized = one.where("size(lanes) > 0").select("lanes", F.get("lanes", F.lit(0))["q"].alias("q"), F.ceil(F.sqrt(F.size("lanes"))).cast("int").alias("width"), F.ceil(F.sqrt(F.get("lanes", F.lit(0))["q"])).alias("stride"))
    q, width, stride = F.col("q"), F.col("width"), F.col("stride")

    def group(lanes: Column, g: Column, slot: Column) -> Column:
        """The lanes (a, blocks done) of group g with the first eligible block, and the slot in which another comes free."""
        free = lambda x: x["n"] * q <= slot * x["a"]
        offer = lambda x, i: F.when((x["n"] < x["a"]) & free(x), F.struct(F.ceil((x["n"] + 1) * q / x["a"]).alias("deadline"), (g * width + i).cast("int").alias("i")))
        later = lambda x: F.when((x["n"] < x["a"]) & ~free(x), F.ceil(x["n"] * q / x["a"]))
        return _let(lanes, lambda own: F.struct(own.alias("own"), F.array_min(F.transform(own, offer)).alias("head"), F.array_min(F.transform(own, later)).alias("next")))

    def step(acc: Column, slot: Column) -> Column:
        def take(pick: Column) -> Column:
            def after(x, g):
                served = F.transform(x["own"], lambda y, i: F.when(g * width + i == pick["i"], F.struct(y["a"].alias("a"), (y["n"] + 1).alias("n"))).otherwise(y))
                mine = (pick["i"] >= g * width) & (pick["i"] < (g + 1) * width)
                return F.when(mine, group(served, g, slot + 1)).when(x["next"] <= slot + 1, group(x["own"], g, slot + 1)).otherwise(x)

            return F.struct(F.transform(acc["groups"], after).alias("groups"), F.array_append(acc["picks"], pick["i"]).alias("picks"))

        return _let(F.array_min(F.transform(acc["groups"], lambda x: x["head"])), take)

    def run(acc: Column, n: Column) -> Column:
        """A run of slots, so that picks are appended to short lists."""
        slots = F.sequence(n * stride, F.least((n + 1) * stride, q) - 1)
        begun = F.struct(acc["groups"].alias("groups"), F.array().cast("array<int>").alias("picks"))
        return _let(F.aggregate(slots, begun, step), lambda done: F.struct(done["groups"].alias("groups"), F.array_append(acc["runs"], done["picks"]).alias("runs")))

    fresh = lambda g: F.transform(F.slice("lanes", g * width + 1, width), lambda x: F.struct(x["a"].alias("a"), F.lit(0).cast("long").alias("n")))
    groups = F.transform(F.sequence(F.lit(0), F.ceil(F.size("lanes") / width).cast("int") - 1), lambda g: group(fresh(g), g, F.lit(0).cast("long")))
    start = F.struct(groups.alias("groups"), F.array().cast("array<array<int>>").alias("runs"))
    runs = F.sequence(F.lit(0).cast("long"), F.ceil(q / stride) - 1)
    picks = sized.select("lanes", F.aggregate(runs, start, run, lambda acc: F.flatten(acc["runs"])).alias("picks"))
    placed = picks.select("lanes", F.posexplode("picks").alias("slot", "i")).select(F.element_at("lanes", F.col("i") + 1)["lane"].alias("lane"), F.col("slot").cast("long").alias("slot"))
    return placed.select("lane", "slot", (F.row_number().over(Window.partitionBy("lane").orderBy("slot")) - 1).cast("long").alias("turn"))


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int = BLOCK_DOCS, period_slots: int = PERIOD, rest: float | None = None) -> DataFrame:
    """All columns of ``docs`` in ``row`` (a struct), with source, block, slot, seat, release and deadline.

    (slot, seat) is the order of the mix; ``seat`` is the place within the block.
    """
    drawn = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("source"), _draw(F.col(id_col)).alias("draw"))
    total = docs.count()
    digits = min(MAX_DIGITS, max(1, math.ceil(math.log(max(1, total / PLACE_ROWS), 16))))
    drawn = drawn.withColumn("place", F.substring("draw", 1, digits))
    sizes = materialise(drawn.groupBy("source", "place").agg(F.count("*").alias("n")), "places")
    shares = materialise(lanes(sizes, weights, period_slots, rest=rest), "lanes")
    order = Window.partitionBy("lane").orderBy("_place", "_source").rowsBetween(Window.unboundedPreceding, -1)
    joined = sizes.join(F.broadcast(shares) if shares.count() <= 100_000 else shares, sizes["source"].eqNullSafe(shares["source"])).select(sizes["source"].alias("_source"), F.col("place").alias("_place"), "lane", "a", "q", "n")
    bases = counted(joined.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))).drop("n"), "bases", 100_000)
    within = Window.partitionBy("source", "place").orderBy("draw", "_id")
    numbered = drawn.join(bases, F.col("source").eqNullSafe(F.col("_source")) & (F.col("place") == F.col("_place"))).select("row", "source", "lane", "a", "q", (F.col("base") + F.row_number().over(within) - 1).alias("at"))
    blocks = numbered.select("row", "source", "lane", "a", "q", F.expr(f"at div {block_docs}").alias("block"), (F.col("at") % block_docs).alias("seat"))
    # a row a slot of the period
    slots = counted(period(shares).withColumnsRenamed({"lane": "_lane", "slot": "_slot"}), "period")
    placed = blocks.join(slots, (F.col("lane") == F.col("_lane")) & (F.col("block") % F.col("a") == F.col("turn")))
    return placed.select(
        "row",
        "source",
        "block",
        (F.expr("block div a") * F.col("q") + F.col("_slot")).alias("slot"),
        "seat",
        F.expr("(block * q) div a").alias("release"),
        F.expr("((block + 1) * q + a - 1) div a").alias("deadline"),
    )


def mixed_order(docs: DataFrame, columns: tuple[str, ...], weights: dict[str | None, float] | None = None) -> DataFrame:
    """``columns`` of all documents, in the order of the mix (range partitions, sorted)."""
    placed = mix(docs.select(*columns), weights)
    return placed.repartitionByRange("slot", "seat").sortWithinPartitions("slot", "seat").select(*[F.col(f"row.{c}").alias(c) for c in columns])


def op6_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs).select(F.col("row.doc_id").alias("doc_id"), "source", "block", "slot", "seat", "release", "deadline")


ORACLE_SQL = f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
l AS (SELECT source, n, row_number() OVER (ORDER BY n DESC, source NULLS FIRST) AS lane FROM n),
t AS (SELECT count(*) AS k, sum(pow(n::DOUBLE, {TEMPERATURE})) AS w, round(sum(pow(n::DOUBLE, {TEMPERATURE})) / min(pow(n::DOUBLE, {TEMPERATURE})), 6) AS least FROM l),
y AS (SELECT *, least({LONGEST}, greatest({PERIOD}, 10 * k, ceil(least)))::BIGINT AS q, CASE WHEN least > {LONGEST} THEN 1 ELSE 0 END AS first FROM t),
x AS (SELECT l.*, k, q, first, (q - k * first) * pow(n::DOUBLE, {TEMPERATURE}) / w AS x FROM l, y),
f AS (SELECT *, floor(x)::BIGINT AS f, q - k * first - sum(floor(x)::BIGINT) OVER () AS spare, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, lane) AS r FROM x),
s AS (SELECT source, lane, q, first + f + CASE WHEN r <= spare THEN 1 ELSE 0 END AS a FROM f),
c AS (SELECT max(q) AS q, list(a ORDER BY lane) AS a, range(1, count(*) + 1) AS i FROM s),
e(t, done, pick) AS (SELECT -1::BIGINT, list_transform(i, lambda j: 0::BIGINT), 0::BIGINT FROM c UNION ALL
  SELECT t + 1, list_transform(i, lambda j: done[j] + CASE WHEN j = p THEN 1 ELSE 0 END), p FROM (
    SELECT e.t, e.done, c.i, list_sort(list_filter(list_transform(c.i, lambda j: CASE WHEN done[j] < a[j] AND done[j] * q <= (e.t + 1) * a[j] THEN {{'d': ((done[j] + 1) * q + a[j] - 1) // a[j], 'i': j}} END), lambda y: y IS NOT NULL))[1].i AS p
    FROM e, c WHERE e.t + 1 < c.q)),
z AS (SELECT pick AS lane, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS turn FROM e WHERE t >= 0),
d AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(doc_id::VARCHAR, '')), doc_id) - 1 AS place FROM documents),
b AS (SELECT doc_id, d.source, lane, a, q, place // {BLOCK_DOCS} AS block, place % {BLOCK_DOCS} AS seat FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, block, block // a * q + slot AS slot, seat, block * q // a AS release, ((block + 1) * q + a - 1) // a AS deadline
FROM b JOIN z ON b.lane = z.lane AND b.block % b.a = z.turn
"""
