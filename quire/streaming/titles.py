"""Deduplication of an endless stream of papers by DOI and near title.

Two steps, as a paper goes only if an earlier one that is *kept* is like it:

* ``meetings`` keeps, per signature (a DOI, a whole title, or a key of the near
  title index), the places of the papers that had it, in keyed state; each
  arrival is told which earlier papers it meets. State leaves by event time: an
  entry has a timer, and goes once the watermark has passed it by ``keep``;
* ``Decider`` decides a batch: meetings are verified on the whole titles, which
  lie in a table by batch, and papers are settled in order of arrival against
  what earlier batches kept. Its tables are written a folder a batch, so a batch
  that runs again overwrites what it wrote.

For one order of arrival the kept papers are those of ``dedup`` over all papers
in that order, as long as like papers arrive within ``keep`` of each other.
``_pos`` must rise from batch to batch. The state store must be the RocksDB
provider (``use_rocksdb``).

Defined cases: papers without DOI and title are kept; nulls count as empty; a
paper behind the watermark meets nobody; a paper without a time is never
forgotten and meets nobody that comes later without its signature being kept.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from quire.functions.doi import doi_key
from quire.functions.text import normalize_text
from quire.operators.dedup import THRESHOLD, independent, indexed
from quire.tables import materialise

PAPER, MEETING = "paper", "meeting"
_ROWS = "kind string, early bigint, _pos bigint, doi string, _t string"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Meetings(StatefulProcessor):
    """Per signature: the places seen, each until its time has passed; emits (kind, early, late)."""

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "place bigint, guest boolean, until bigint")

    def handleInputRows(self, key, rows, timerValues):
        from pyspark.sql import Row

        held = [tuple(r) for r in self.seen.get()] if self.seen.exists() else []
        new = sorted((r["_pos"], r["guest"], int(r["_time"].timestamp() * 1000) + self.keep_ms) for r in rows)
        doi = key[0].startswith("d")
        for place, guest, until in new:
            # of a DOI its first holder is enough
            for other, theirs, _ in held[:1] if doi else held:
                if other != place and not (guest and theirs):
                    yield Row(kind=MEETING, early=min(other, place), _pos=max(other, place), doi="d" if doi else "", _t="")
            held.append((place, guest, until))
            self.handle.registerTimer(until)
        self.seen.put(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = expiredTimerInfo.getExpiryTimeInMs()
        left = [tuple(r) for r in self.seen.get() if r[2] > now] if self.seen.exists() else []
        if left:
            self.seen.put(left)
        else:
            self.seen.clear()
        yield from ()

    def close(self) -> None:
        pass


def signatures(papers: DataFrame, time: str, threshold: float = THRESHOLD, compose: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, keyed): papers as (_pos, doi, _t, _time), and a row a signature (_key, _pos, guest, _time)."""
    title = normalize_text(F.col("title"), compose)
    rows = papers.select("_pos", F.coalesce("doi", F.lit("")).alias("doi"), title.alias("_t"), F.col(time).alias("_time"))
    by_doi = rows.where("doi <> ''").select(F.concat(F.lit("d"), doi_key(F.col("doi"))).alias("_key"), "_pos", F.lit(False).alias("guest"), "_time")
    titled = rows.where("_t <> ''")
    whole = titled.select(F.concat(F.lit("t"), F.sha2("_t", 256)).alias("_key"), "_pos", F.lit(False).alias("guest"), "_time")
    near = indexed(titled, threshold, ("_pos", "_time"))
    side = lambda column, guest: F.transform(column, lambda k: F.struct(F.concat(F.lit("s"), k.cast("string")).alias("_key"), F.lit(guest).alias("guest")))
    keys = near.select("_pos", "_time", F.inline(F.concat(side("own", False), side("guest", True)))).select("_key", "_pos", "guest", "_time")
    return rows, by_doi.unionByName(whole).unionByName(keys)


def meetings(papers: DataFrame, time: str, late: str = "1 day", keep: str = "30 days", threshold: float = THRESHOLD, compose: bool = True) -> DataFrame:
    """A stream of papers to rows of two kinds: each paper, and each meeting of a paper (``_pos``) with an earlier one."""
    spark = papers.sparkSession
    ms = int(spark.range(1).select(F.expr(f"unix_millis(timestamp'1970-01-01' + interval {keep}) - unix_millis(timestamp'1970-01-01')")).first()[0])
    rows, keyed = signatures(papers.withWatermark(time, late), time, threshold, compose)
    met = keyed.where("_time IS NOT NULL").groupBy("_key").transformWithState(Meetings(ms), _ROWS, "append", "eventTime")
    return rows.select(F.lit(PAPER).alias("kind"), F.lit(None).cast("bigint").alias("early"), "_pos", "doi", "_t").unionByName(met)


@dataclass
class Decider:
    """Decides batches of ``meetings``; ``folder`` holds the tables of what was decided.

    ``decided()`` reads them back: ``_pos``, and ``dup``, whether the paper went.
    """

    spark: SparkSession
    folder: str
    threshold: float = THRESHOLD
    then: Callable[[DataFrame, int], None] | None = None

    def _table(self, name: str, batch: int, rows: DataFrame) -> DataFrame:
        path = f"{self.folder}/{name}/batch={batch}"
        rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def _before(self, name: str, batch: int, ddl: str) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(f"{ddl}, batch int").parquet(f"{self.folder}/{name}").where(F.col("batch") < batch).drop("batch")

    def decided(self) -> DataFrame:
        return self._before("decided", 1 << 30, "_pos bigint, dup boolean")

    def __call__(self, rows: DataFrame, batch: int) -> None:
        ddl = "_pos bigint, _t string"
        got = materialise(rows, "arrived")
        papers = self._table("titles", batch, got.where(F.col("kind") == PAPER).select("_pos", "_t"))
        titles = self._before("titles", batch, ddl).unionByName(papers)
        met = materialise(got.where(F.col("kind") == MEETING).select("early", F.col("_pos").alias("late"), (F.col("doi") != "").alias("by_doi")).distinct(), "met")
        by_doi = materialise(met.where("by_doi").select("late").distinct(), "by-doi")
        near = met.where("NOT by_doi").select("early", "late").join(by_doi, "late", "left_anti")
        asked = materialise(near.select(F.col("early").alias("_pos")).union(near.select("late")).distinct(), "asked")
        known = materialise(indexed(titles.join(asked, "_pos", "left_semi"), self.threshold, ("_pos",)).select("_pos", "_t", "s"), "known")
        a, b = (known.select(F.col("_pos").alias(p), F.col("_t").alias(f"t{p}"), F.col("s").alias(f"s{p}")) for p in ("early", "late"))
        both = F.size(F.array_intersect("searly", "slate"))
        ratio = both.cast("double") / (F.size("searly") + F.size("slate") - both)
        like = (F.col("tearly") == F.col("tlate")) | (both > 0) & (ratio >= F.lit(float(self.threshold)))
        edges = materialise(near.join(a, "early").join(b, "late").where(like).select("early", "late"), "edges")
        # what earlier batches and the DOIs of this one have settled
        before = self._before("decided", batch, "_pos bigint, dup boolean").select(F.col("_pos").alias("early"), "dup")
        held = edges.join(before.unionByName(by_doi.select(F.col("late").alias("early"), F.lit(True).alias("dup"))), "early", "left")
        held = materialise(held.where("dup IS NULL OR NOT dup").select("early", "late", F.col("dup").isNotNull().alias("old")), "open")
        gone = materialise(held.where("old").select("late").distinct(), "gone")
        rest = held.where("NOT old").join(gone, "late", "left_anti").join(gone.select(F.col("late").alias("early")), "early", "left_anti")
        lost = by_doi.union(gone).union(independent(materialise(rest.select("early", "late"), "rest"))).distinct()
        out = self._table("decided", batch, papers.select("_pos").join(lost.select(F.col("late").alias("_pos"), F.lit(True).alias("dup")), "_pos", "left").select("_pos", F.coalesce("dup", F.lit(False)).alias("dup")))
        if self.then is not None:
            self.then(out, batch)


def dedup_stream(papers: DataFrame, time: str, folder: str, checkpoint: str, late: str = "1 day", keep: str = "30 days", threshold: float = THRESHOLD, compose: bool = True, then: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Starts the query; ``Decider(spark, folder).decided()`` has its results, and ``then`` gets those of each batch."""
    use_rocksdb(papers.sparkSession)
    decide = Decider(papers.sparkSession, folder, threshold, then)
    writer = meetings(papers, time, late, keep, threshold, compose).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).foreachBatch(decide).start()
