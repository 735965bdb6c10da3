"""Resampling towards a target: weights from a position table of n-grams.

Words of a text are exploded with their positions; per document, window
``lead()`` puts the following words beside each word, one for every further
order, and their concatenations are the features. A feature's bucket is the
CRC-32 of its bytes modulo ``buckets``. Buckets are counted over all of both
tables; a bucket's gain compares the target's share with the corpus's. Gains
(``buckets`` rows, so bounded) are joined back to the occurrences, which are
grouped by document, and the documents with the highest perturbed weights are
drawn (the Gumbel top-k form of drawing without replacement).

Grouping is by row within the task that reads it, so the exchange moves one row
of numbers a document and ``buckets`` rows a task; ranks come from a range sort
of the scores, with one number a range on the driver. Orders above one sort a
document's words in one place, a document being one row to begin with.

Rows are numbered as they are read: the input must come in a stable order
within its partitions, as files and tables do; write a shuffled frame first.

Defined cases: null text has no words; a document without a feature weighs 0;
null ids count as the empty text in the hash and rank behind equal scores;
repeated rows are counted and drawn each; an empty table gives an empty result
(its counts are zero); unnamed columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.runtime import materialise

ORDERS, BUCKETS, SCALE = 1, 10_000, 1000
#: Documents with fewer words are not drawn.
MIN_WORDS, PERCENT, SEED = 20, 10, "2024"
#: What parts words once A-Z are lower-cased.
PARTING = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def position_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, doc_id, pos, word: every word; a text without words has one row with an empty word."""
    words = F.split(F.translate(F.coalesce(F.col(text_col), F.lit("")), _UPPER, _LOWER), PARTING)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), words.alias("words"))
    return rows.select("row", "doc_id", F.posexplode("words").alias("pos", "word"))


def features(table: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, first (whether the feature is one word), bucket (null for no feature) of all runs of 1 to ``orders`` words."""
    bucket = lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(buckets)).cast("int")
    if orders == 1:
        return table.select("row", "doc_id", F.lit(True).alias("first"), F.when(F.col("word") != "", bucket(F.col("word"))).alias("bucket"))
    # empty words stand before the first or after the last word only
    following = Window.partitionBy("row").orderBy("pos")
    near = table.select("row", "doc_id", F.nullif("word", F.lit("")).alias("_w1"), *[F.nullif(F.lead("word", k - 1).over(following), F.lit("")).alias(f"_w{k}") for k in range(2, orders + 1)])
    runs = [F.concat_ws(" ", *[f"_w{j}" for j in range(1, k + 1)]) for k in range(1, orders + 1)]
    whole = [F.concat(*[F.col(f"_w{j}") for j in range(1, k + 1)]).isNotNull() for k in range(1, orders + 1)]
    found = F.array(*[F.struct(F.lit(k == 0).alias("first"), F.when(w, bucket(r)).alias("bucket")) for k, (r, w) in enumerate(zip(runs, whole, strict=True))])
    return near.select("row", "doc_id", F.inline(found))


def bucket_counts(found: DataFrame) -> DataFrame:
    """(bucket, n): occurrences of features by bucket."""
    return found.where("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) for all buckets, from the counts of both sides."""
    # two numbers
    all_s, all_t = (float(c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"] + buckets) for c in (corpus, target))
    every = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    sides = every.join(F.broadcast(corpus.withColumnRenamed("n", "s")), "bucket", "left").join(F.broadcast(target.withColumnRenamed("n", "t")), "bucket", "left")
    number = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("double") + F.lit(1.0)
    ratio = number("t") * F.lit(all_s) / (number("s") * F.lit(all_t))
    return sides.select("bucket", F.floor(F.lit(float(SCALE)) * F.log(ratio)).cast("long").alias("gain"))


def _floor_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a - F.pmod(a, b), b)


def noise(id_col: str = "doc_id", seed: str = SEED) -> Column:
    """The scaled Gumbel number of a document, from the hash of its id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def weighted(docs: DataFrame, target: DataFrame, orders: int = ORDERS, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text") -> DataFrame:
    """row, doc_id, n_words, n_features, weight of every document."""
    named = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text).alias("text"))
    counts = [materialise(bucket_counts(features(position_table(*x), orders, buckets)), "buckets") for x in ((docs, id_col, text_col), (named,))]
    gains = materialise(bucket_gains(*counts, buckets), "gains")
    joined = features(position_table(docs, id_col, text_col), orders, buckets).join(F.broadcast(gains), "bucket", "left")
    # a document without features has its one row without a bucket
    sums = joined.groupBy("row", "doc_id").agg(F.count_if(F.col("first") & F.col("bucket").isNotNull()).alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gains"))
    weight = F.when(F.col("n_features") > 0, _floor_div(F.col("gains"), F.greatest("n_features", F.lit(1)))).otherwise(F.lit(0).cast("long"))
    return sums.select("row", "doc_id", "n_words", "n_features", weight.alias("weight"))


def drawn(weights: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED) -> DataFrame:
    """``weighted`` rows with score, and rank where the document is among the drawn."""
    rows = weights.select("*", (F.col("weight") + noise("doc_id", seed)).alias("score"), (F.col("n_words") < min_words).alias("_short"))
    order = [F.col("_short"), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    parts = materialise(materialise(rows, "scores").repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    base, starts, able = 0, [], 0
    # one row a range
    for r in sorted(parts.groupBy("_part").agg(F.count("*").alias("n"), F.count_if(~F.col("_short")).alias("able")).collect(), key=lambda r: r["_part"]):
        starts.append((r["_part"], base))
        base, able = base + r["n"], able + r["able"]
    bases = weights.sparkSession.createDataFrame(starts, "_part int, _base long")
    at = F.col("_base") + F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    placed = parts.join(F.broadcast(bases), "_part").withColumn("_at", at)
    return placed.withColumn("rank", F.when(~F.col("_short") & (F.col("_at") <= percent * able // 100), F.col("_at"))).drop("_short", "_part", "_base", "_at")


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents' doc_id, weight, score and rank."""
    return drawn(weighted(docs, target, **options)).where("rank IS NOT NULL").select("doc_id", "weight", "score", "rank")


def op12_importance_resampling(spark, sf_dir):
    docs, target = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return drawn(weighted(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: CRC-32 is a fold over the bytes of the distinct words, by the usual table of 256 numbers (made by its rule).
ORACLE_SQL = f"""
WITH RECURSIVE steps(b, k, c) AS (
  SELECT b, 0, b FROM range(256) r(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY b) AS cs FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS ws FROM documents),
occ AS (SELECT r, unnest(ws) AS w FROM d),
tocc AS (SELECT unnest(ws) AS w FROM (SELECT {_WORDS_SQL} AS ws FROM benchmark)),
vocab AS (SELECT w, hex(encode(w)) AS hx FROM (SELECT w FROM occ UNION SELECT w FROM tocc)),
crc(w, hx, i, c) AS (
  SELECT w, hx, 0, 4294967295 FROM vocab
  UNION ALL
  SELECT w, hx, i + 1, xor(cs[xor(c % 256, ('0x' || substr(hx, 2 * i + 1, 2))::BIGINT) + 1], c // 256) FROM crc, crc_table WHERE 2 * i < length(hx)
),
buckets AS (SELECT w, xor(c, 4294967295) % 10000 AS bucket FROM crc WHERE 2 * i = length(hx)),
s AS (SELECT bucket, count(*) AS s FROM occ JOIN buckets USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM tocc JOIN buckets USING (w) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)
),
sums AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS g FROM occ JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY r),
weights AS (
  SELECT r, doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (g - ((g % n) + n) % n) // n ELSE 0 END AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM d LEFT JOIN sums USING (r)
),
scores AS (SELECT *, weight + floor(-1000.0::DOUBLE * ln(-ln((h::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM weights),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, r) AS k, count(*) OVER () AS total FROM scores WHERE n_features >= 20)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score, CASE WHEN k <= 10 * total // 100 THEN k END::BIGINT AS rank
FROM scores LEFT JOIN ranked USING (r)
"""
