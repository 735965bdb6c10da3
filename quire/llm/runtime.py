"""Shared plumbing: the core's intermediate tables, and helpers for texts as bytes."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

from quire.tables import Scratch, counted, materialise

__all__ = ["DOCUMENT_COLUMNS", "Scratch", "beside", "bounded_batches", "by_bytes", "counted", "materialise", "raw_bytes", "squeeze"]

#: Columns of the ``documents`` table, in order.
DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def beside(name: str, own) -> str:
    """What a carried column is called: ``<name>_in`` where an operator returns a column of that name itself."""
    return f"{name}_in" if name.lower() in own else name


#: Bytes of text that a Python worker turns into objects at once; a longer text goes alone.
BATCH_BYTES = 4 << 20


def by_bytes(batch, column: int, most: int = BATCH_BYTES, rows: int = 1000):
    """Slices of an Arrow batch with at most ``rows`` rows and, but for single rows, ``most`` bytes in a string column."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    lo = held = 0
    for i, size in enumerate(sizes):
        if i > lo and (held + size > most or i - lo >= rows):
            yield batch.slice(lo, i - lo)
            lo, held = i, 0
        held += size
    if lo < batch.num_rows:
        yield batch.slice(lo)


@contextmanager
def bounded_batches(spark: SparkSession, most: int = BATCH_BYTES):
    """Arrow batches of about ``most`` bytes at most for what is written inside the block.

    By default a batch holds 10,000 rows however long their texts are. A
    smaller limit of the session stands; the session's setting comes back after.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    if before is None or not before.isdecimal() or int(before) > most:
        spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def raw_bytes(column) -> list:
    """An Arrow string column as Python ``bytes``; nulls become empty."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


#: The characters [\x20\x09-\x0D]; ``bytes.split()`` without arguments splits on exactly these.
WHITE = b" \t\n\x0b\x0c\r"


def squeeze(text: bytes) -> bytes:
    """Replace each run of ``[\\x20\\x09-\\x0D]`` by one space (leading and trailing runs too)."""
    if not text:
        return text
    body = b" ".join(text.split())
    if not body:
        return b" "
    if text[0] in WHITE:
        body = b" " + body
    return body + b" " if text[-1] in WHITE else body
