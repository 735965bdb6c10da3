"""Document fingerprints: SimHash of weighted terms, searched through permuted block tables.

Terms are the lower-cased words (``[^\\x20\\x09-\\x0D]+``) of a whole text. Each
occurrence votes with the weight of its word, the square of its length (long
words are rare ones; lengths beyond ``LONGEST`` count as that): with the bits of
its hash for one, against them for zero. A bit of the fingerprint is one if the
ones outweigh the zeros. The votes of two bits share a long (32 sums of two
lanes), so a vote is a few machine instructions inside generated code.

A table of permuted blocks: 64 bits are cut into ``radius + KEPT`` blocks. Two
fingerprints that differ in at most ``radius`` bits agree on at least ``KEPT``
blocks, so for each choice of ``KEPT`` blocks one table is keyed by these bits
alone, and a query finds all fingerprints within the radius in the lists of its
own keys; candidates are verified by counting differing bits. Equal fingerprints
collapse first. The tables of the queries are broadcast where they are counted
small; otherwise the join shuffles and adaptive execution splits long lists.

Everything is DataFrame functions; nothing of a text or fingerprint reaches the
driver but one pair of numbers a range of ids.

Likeness of two fingerprints is the cosine that their differing bits estimate,
``max(0, cos(pi * bits / 64))``: 1 for equal ones, about 0 for unrelated texts.

Defined cases: null text counts as empty; a text without words has fingerprint
zero; null ids come last in their order; rows equal in id and text are one
document that is returned as often as it is there; rows of one id and several
texts follow in order of their texts' hashes; an only document is its own next
one; an empty table gives an empty result; unnamed columns are ignored. A text
may have up to 2^28 code points (beyond, votes would overflow their lanes).
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.runtime import counted, materialise

BITS, HALF, RADIUS = 64, 32, 3
#: Blocks that a table is keyed by.
KEPT = 3
#: Length from which a word's weight grows no more.
LONGEST = 16
#: Queries of a search: rows whose id this divides.
EVERY = 50

PARTING = r"[\x20\x09-\x0D]+"
#: The lowest bit of either lane.
_LANES = (1 << HALF) | 1
_LOW = (1 << HALF) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprints(rows: DataFrame, keys: tuple[str, ...], text_col: str) -> DataFrame:
    """``keys`` and fp (signed long). Rows of equal keys are one document; no exchange where ``rows`` are dealt by some of the keys."""
    words = rows.select(*keys, F.explode(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), PARTING)).alias("_word"))
    length = F.least(F.char_length("_word"), F.lit(LONGEST)).cast("long")
    votes = words.select(*keys, F.xxhash64("_word").alias("_hash"), (length * length).alias("_weight"))
    lanes = [F.sum(F.shiftrightunsigned("_hash", j).bitwiseAND(F.lit(_LANES)) * F.col("_weight")).alias(f"_v{j}") for j in range(HALF)]
    tally = votes.groupBy(*keys).agg(F.sum("_weight").alias("_all"), *lanes)
    fp = F.lit(0).cast("long")
    for j in range(HALF):
        low, high = F.col(f"_v{j}").bitwiseAND(F.lit(_LOW)), F.shiftrightunsigned(f"_v{j}", HALF)
        for bit, ones in ((j, low), (j + HALF, high)):
            fp = fp.bitwiseOR(F.when(2 * ones > F.col("_all"), F.lit(_signed(1 << bit))).otherwise(F.lit(0).cast("long")))
    return tally.select(*keys, fp.alias("fp"))


def differing(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def likeness(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(0.0), F.cos(F.pi() * differing(a, b) / F.lit(float(BITS))))


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def masks(radius: int = RADIUS) -> list[int]:
    """For each choice of ``KEPT`` of the ``radius + KEPT`` blocks, the mask of its bits (signed)."""
    n = radius + KEPT
    edges = [BITS * k // n for k in range(n + 1)]
    block = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(chosen)) for chosen in combinations(block, KEPT)]


def block_tables(fps: DataFrame, radius: int = RADIUS, fp_col: str = "fp") -> DataFrame:
    """Every row once a table, with the table's number and its key."""
    found = F.array(*[F.struct(F.lit(t).alias("table"), F.col(fp_col).bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks(radius))])
    return fps.select("*", F.inline(found))


def search(queries: DataFrame, fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(query, fp, bits): for each distinct query fingerprint (column ``fp``) all distinct ``fps`` within ``radius`` bits."""
    asked = counted(block_tables(queries.select(F.col("fp").alias("query")).distinct(), radius, "query"), "queries")
    met = block_tables(fps.select("fp").distinct(), radius).join(asked, ["table", "key"])
    apart = F.col("query").bitwiseXOR(F.col("fp"))
    # a pair counts in the first table in which it meets
    first = F.coalesce(*[F.when(apart.bitwiseAND(F.lit(m)) == 0, F.lit(t)) for t, m in enumerate(masks(radius))])
    return met.where((F.bit_count(apart) <= radius) & (F.col("table") == first)).select("query", "fp", F.bit_count(apart).alias("bits"))


def with_next(keyed: DataFrame) -> DataFrame:
    """Distinct documents (doc_id, _i, _h, ...) with ``next_i`` and ``next_h``, the document after in order of id; the first comes after the last."""
    order = [F.col("doc_id").asc_nulls_last(), F.col("_i"), F.col("_h")]
    parts = materialise(keyed.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    # one row a range
    firsts = sorted((r["_part"], r["k"]["_i"], r["k"]["_h"]) for r in parts.groupBy("_part").agg(F.min_by(F.struct("_i", "_h"), F.struct(F.col("doc_id").isNull(), "doc_id", "_i", "_h")).alias("k")).collect())
    after = [(p, *firsts[(n + 1) % len(firsts)][1:]) for n, (p, *_) in enumerate(firsts)]
    table = keyed.sparkSession.createDataFrame(after, "_part int, _fi long, _fh long")
    within = Window.partitionBy("_part").orderBy(*order)
    led = parts.select("*", F.lead(F.struct("_i", "_h")).over(within).alias("_led")).join(F.broadcast(table), "_part")
    return led.select(*keyed.columns, F.coalesce("_led._i", "_fi").alias("next_i"), F.coalesce("_led._h", "_fh").alias("next_h"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct documents (doc_id, _i, _h, n_chars, copies, next_i, next_h), and their _i, _h, text and edited text.

    In the edited text the last quarter of the code points gives way to the
    first as many of the next document. Whole texts move once, the quarters a
    second time.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("_i"), F.xxhash64(F.col("doc_id").isNull(), "text").alias("_h")]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).select("doc_id", "text", *key)
    ids = rows.select("doc_id", "_i", "_h", F.char_length("text").cast("long").alias("n")).groupBy("doc_id", "_i", "_h").agg(F.max("n").alias("n_chars"), F.count("*").alias("copies"))
    order = materialise(with_next(ids), "order")
    texts = rows.groupBy("_i", "_h").agg(F.max("text").alias("text"))
    asked = counted(order.select(F.col("_i").alias("for_i"), F.col("_h").alias("for_h"), F.floor(F.col("n_chars") / 4).cast("int").alias("need"), F.col("next_i").alias("_i"), F.col("next_h").alias("_h")), "asked")
    heads = texts.join(asked, ["_i", "_h"]).select(F.col("for_i").alias("_i"), F.col("for_h").alias("_h"), F.col("need"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head"))
    kept = F.substring(F.col("text"), F.lit(1), F.char_length("text") - F.col("need"))
    return order, texts.join(heads, ["_i", "_h"]).select("_i", "_h", "text", F.concat(kept, "head").alias("edited"))


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, every: int = EVERY) -> DataFrame:
    """One row a document: its fingerprint, that of its edited text, likenesses, and what a search finds.

    ``class_id`` is the smallest id of an equal fingerprint. Documents whose id
    ``every`` divides are searched among all: ``n_near`` other documents lie
    within ``radius`` bits (null for the others).
    """
    order, texts = edited(docs, id_col, text_col)
    each = texts.select("_i", "_h", F.posexplode(F.array("text", "edited")).alias("_which", "_text"))
    digested = each.select("_i", "_h", "_which", F.when(F.col("_which") == 1, F.sha2("_text", 256)).alias("_sha"), "_text")
    both = fingerprints(digested, ("_i", "_h", "_which", "_sha"), "_text")
    side = lambda c, k: F.max(F.when(F.col("_which") == k, F.col(c)))
    prints = both.groupBy("_i", "_h").agg(side("fp", 0).alias("fp"), side("fp", 1).alias("edited_fp"), side("_sha", 1).alias("edited_sha256"))
    found = materialise(prints.join(order, ["_i", "_h"]), "prints")
    nearest = counted(found.select(F.col("_i").alias("next_i"), F.col("_h").alias("next_h"), F.col("fp").alias("next_fp")), "next")
    classes = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("class_id"), F.sum("copies").alias("n")), "classes")
    queries = found.where(F.col("doc_id") % every == 0).select("fp")
    reached = search(queries, classes, radius).join(classes, "fp").groupBy("query").agg(F.sum("n").alias("n"))
    near = counted(reached.select(F.col("query").alias("fp"), F.col("n").alias("_near")), "near")
    rows = found.join(nearest, ["next_i", "next_h"]).join(classes.select("fp", "class_id"), "fp").join(near, "fp", "left")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        hexadecimal(F.col("fp")).alias("fingerprint"),
        hexadecimal(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
        "class_id",
        F.when(F.col("doc_id") % every == 0, F.col("_near") - 1).alias("n_near"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("_copy"),
    ).drop("_copy")


def op11_document_fingerprints(spark, sf_dir):
    return document_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
