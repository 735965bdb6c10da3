"""Quality rules judged per document and per host.

Every document gets the counters of five rules. Rule failures are summed by
host (the ``source`` column); each host's failure rate is shrunk towards the
corpus by a beta prior fitted to all hosts (method of moments with the
sampling variance taken out), so that a host with three documents is not
condemned for two bad ones. Hosts whose shrunken rate for any rule passes
``host_limit`` are rejected, and that verdict joins back to their documents.

Only sums per host move; the prior is five numbers a rule. The list of
rejected hosts is counted before it is broadcast and joined by shuffle beyond
``BROADCAST_HOSTS`` rows.

Defined cases: null text has no words and fails the base rule; documents
without a source share one unnamed host; repeated rows count each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.runtime import beside, materialise, raw_bytes

#: Base rule of a document.
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: A host is rejected when a shrunken failure rate passes this.
HOST_LIMIT = 0.5
#: Rejected hosts are broadcast up to this many rows (about 100 bytes each).
BROADCAST_HOSTS = 100_000

#: Host evidence: one SQL predicate a rule, over the counters.
RULES = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "20 * n_dup_lines > n_words",
    "words": "word_chars > 12 * n_words OR word_chars < 2 * n_words",
}

_COUNTERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def text_counters(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one whole text."""
    words = text.split()
    n = len(words)
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = text.split(b"\n")
    dup = 0
    if len(lines) > 1 and len(set(lines)) < len(lines):
        seen = set()
        for line in lines:
            if line in seen:
                dup += bool(line.strip())
            else:
                seen.add(line)
    repeat = 0
    windows = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(windows)) < len(windows):
        counted, end = Counter(windows), 0
        for i, w in enumerate(windows):
            if counted[w] > 1:
                repeat += i + 5 - max(i, end)
                end = i + 5
    return n, chars, symbols, dup, repeat


def counters(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), source_col: str = "source") -> DataFrame:
    """The carried columns as ``_c0, _c1, ...``, the host and the five counters."""
    inputs = docs.select(F.col(text_col).alias("_text"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("host"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)])
    schema = T.StructType([inputs.schema["host"], *inputs.schema.fields[2:], *[T.StructField(c, T.LongType()) for c in _COUNTERS]])

    def measure(batches):
        import pyarrow as pa

        for batch in batches:
            found = [text_counters(x) for x in raw_bytes(batch.column(0))]
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *[pa.array(c, pa.int64()) for c in columns]], names=[*batch.schema.names[1:], *_COUNTERS])

    return inputs.mapInArrow(measure, schema)


def host_rates(measured: DataFrame) -> DataFrame:
    """host, n and one shrunken failure rate a rule (``rate_<rule>``)."""
    sums = measured.groupBy("host").agg(F.count("*").alias("n"), *[F.count_if(F.expr(rule)).alias(f"f_{k}") for k, rule in RULES.items()])
    total = sums.agg(F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), *[x for k in RULES for x in (F.sum(f"f_{k}").alias(f"f_{k}"), F.sum(F.col(f"f_{k}").cast("double") * F.col(f"f_{k}") / F.col("n")).alias(f"q_{k}"))]).first()
    rates = []
    for k in RULES:
        mean, strength = _prior(total["hosts"], total["n"] or 0, total["nn"] or 0.0, total[f"f_{k}"] or 0, total[f"q_{k}"] or 0.0)
        rates.append(((F.col(f"f_{k}") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))).alias(f"rate_{k}"))
    return sums.select("host", "n", *rates)


def _prior(hosts: int, n: int, nn: float, failed: int, q: float) -> tuple[float, float]:
    """Mean and strength (a + b) of the beta prior, from sums over all hosts."""
    if not n:
        return 0.0, 1.0
    mean = failed / n
    spread, free = mean * (1 - mean), n - nn / n - (hosts - 1)
    if spread <= 0 or free <= 0:
        return mean, 10.0
    rho = ((q - n * mean * mean) / spread - (hosts - 1)) / free
    rho = min(max(rho, 1e-4), 0.9)
    return mean, 1 / rho - 1


def base_failed() -> Column:
    return F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")


def judged(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), source_col: str = "source", host_limit: float = HOST_LIMIT) -> DataFrame:
    """The carried columns with the counters, ``base_failed`` and ``kept``; a carried column of such a name is returned as ``<name>_in``."""
    measured = materialise(counters(docs, text_col, carry, source_col), "quality")
    over = None
    for k in RULES:
        hit = F.col(f"rate_{k}") > host_limit
        over = hit if over is None else over | hit
    rejected = materialise(host_rates(measured).where(over).select("host", F.lit(True).alias("_rejected")), "hosts")
    if rejected.count() <= BROADCAST_HOSTS:
        rejected = F.broadcast(rejected)
    out = measured.join(rejected, "host", "left").withColumn("_failed", base_failed())
    own = (*_COUNTERS, "base_failed", "kept")
    return out.select(*[F.col(f"_c{i}").alias(beside(c, own)) for i, c in enumerate(carry)], *_COUNTERS, F.col("_failed").alias("base_failed"), (~F.col("_failed") & F.col("_rejected").isNull()).alias("kept"))


def keep_quality(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The documents that stay, with ``columns`` only."""
    own = (*_COUNTERS, "base_failed", "kept")
    return judged(docs.select(*columns), carry=columns).where("kept").select(*[F.col(beside(c, own)).alias(c) for c in columns])


def op2_quality_rules(spark, sf_dir):
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    sums = ", ".join(f"count(*) FILTER (WHERE {r}) AS f_{k}" for k, r in RULES.items())
    total = ", ".join(f"sum(f_{k}) AS t_{k}, sum(f_{k}::DOUBLE * f_{k} / n) AS q_{k}" for k in RULES)
    prior = ", ".join(
        f"t_{k} / tn AS m_{k}, CASE WHEN t_{k} = 0 OR t_{k} = tn OR tn - nn / tn - (hosts - 1) <= 0 THEN 10.0 ELSE 1 / least(greatest(((q_{k} - tn * (t_{k} / tn) * (t_{k} / tn)) / (t_{k} / tn * (1 - t_{k} / tn)) - (hosts - 1)) / (tn - nn / tn - (hosts - 1)), 1e-4), 0.9) - 1 END AS s_{k}"
        for k in RULES
    )
    over = " OR ".join(f"(f_{k} + m_{k} * s_{k}) / (n + s_{k}) > {HOST_LIMIT}" for k in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
p AS (SELECT r, i, list_slice(ws, i, i + 4) AS win FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM p) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY r),
l AS (SELECT r, line, row_number() OVER (PARTITION BY r, line) AS k FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d)),
dup AS (SELECT r, count(*) AS n_dup_lines FROM l WHERE k > 1 AND regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT d.r, doc_id, host, len(ws)::BIGINT AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM d JOIN w USING (r) LEFT JOIN cov USING (r) LEFT JOIN dup USING (r)),
h AS (SELECT host, count(*)::DOUBLE AS n, {sums} FROM c GROUP BY host),
t AS (SELECT count(*)::DOUBLE AS hosts, sum(n) AS tn, sum(n * n) AS nn, {total} FROM h),
pr AS (SELECT {prior} FROM t),
bad AS (SELECT host FROM h, pr WHERE {over})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND host NOT IN (SELECT host FROM bad) AS kept
FROM c
"""


ORACLE_SQL = _oracle()
