"""A training corpus in five stages, each over all that the one before kept.

quality -> exact dedup -> near dedup -> mix -> pack. Every stage but the last
returns the columns of ``documents``; between stages the rows are written as
Parquet and read again. The mix decides the order of the files' rows: each file
is one stretch of the mix, and packing runs along its curve within one file
after the other, so every stretch keeps the target weights.

A stage drops the intermediate tables that earlier calls of the same
``Pipeline`` left in the shared folder, once no frame of the driver reads them:
a result that somebody still holds can be read whatever else has run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import exact_dedup, mixing, packing, quality, simhash
from quire.llm.runtime import DOCUMENT_COLUMNS, Scratch, materialise


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents by the base rule and by their host's failure rates."""
    return quality.keep_quality(docs, DOCUMENT_COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside), keeps the row with the smallest id."""
    return exact_dedup.keep_exact(docs, DOCUMENT_COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by SimHash, keeps the row with the smallest id."""
    return simhash.keep_near(docs, DOCUMENT_COLUMNS)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts all rows in the order of the Pfair schedule of their sources."""
    return mixing.mixed_order(docs, DOCUMENT_COLUMNS)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str, by_file: bool = True) -> DataFrame:
    """Packs all rows along the Hilbert curve, file by file of the mix; with ``by_file`` off in one run (rows that come from no files)."""
    part = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).try_cast("long") if by_file else F.lit(0)
    return packing.digest(packing.pack(docs.select("doc_id", "text", part.alias("part")), packing.word_tokenizer_path(), window="part"))


class Pipeline:
    """The stages, and the tables they leave."""

    def __init__(self):
        self.left: list[Scratch] = []

    def stages(self) -> list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]]:
        every = {"quality": quality_stage, "exact_dedup": exact_stage, "near_dedup": near_stage, "mix": mix_stage, "pack": pack_stage}
        return [(name, self._cleaning(stage)) for name, stage in every.items()]

    def _cleaning(self, stage):
        """``stage`` with idle tables of earlier calls dropped first."""

        @wraps(stage)
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for left in [x for x in self.left if x.idle(spark)]:
                left.drop(spark)
                self.left.remove(left)
            with Scratch() as scratch:
                out = stage(spark, docs, sf_dir)
            self.left.append(scratch)
            return out

        return run_stage


STAGES = Pipeline().stages()

#: Tokens and fingerprints are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; one row per packed piece."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    *first, (_, last) = Pipeline().stages()
    for name, stage in first:
        with Scratch() as written:
            docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            before.drop(spark)
        before = written
    return last(spark, docs, sf_dir)
