"""Text formats as data sources: ``rows.write.format("papers-bibtex").save(folder)``.

Tasks write their rows to files of a hidden folder; the driver moves them to
their places once all tasks are done, so a write that fails leaves no part and
what was there before. What a task writes that still runs when the job is given
up stays in the hidden folder, which no reader sees.
Files are numbered by partition: of rows sorted by range, one file after the
other is the whole text. ``join_parts`` puts them into one file, as bytes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from pathlib import Path
from typing import TextIO

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Suffix of a part where the option ``extension`` is not given.
EXTENSION = ".txt"
#: Rows that a task joins at once.
ROWS = 100


@dataclass
class Part(WriterCommitMessage):
    """A file that a task has written."""

    number: int
    path: str
    rows: int


def _where(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class TextWriter(DataSourceArrowWriter):
    """Writes a column ``text``; options: path, extension, head (before the first row), separator (between rows of a file)."""

    def __init__(self, options, column: int, overwrite: bool):
        self.folder, self.column, self.overwrite = options["path"].rstrip("/"), column, overwrite
        self.extension, self.head, self.separator = options.get("extension", EXTENSION), options.get("head", ""), options.get("separator", "\n")
        self.hidden = f"_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Part:
        import pyarrow as pa
        from pyspark import TaskContext

        number, rows = TaskContext.get().partitionId(), 0
        where, folder = _where(self.folder)
        where.create_dir(f"{folder}/{self.hidden}", recursive=True)
        path = f"{folder}/{self.hidden}/{number}-{uuid.uuid4().hex}"
        between = self.separator.encode()
        with where.open_output_stream(path) as out:
            for batch in iterator:
                # a few rows at a time, as a batch may hold thousands of long texts
                for lo in range(0, batch.num_rows, ROWS):
                    texts = [t or b"" for t in batch.column(self.column).slice(lo, ROWS).cast(pa.binary()).to_pylist()]
                    out.write((between if rows else b"") + between.join(texts))
                    rows += len(texts)
            if rows:
                out.write(b"\n")
        return Part(number, path, rows)

    def commit(self, messages: list[Part | None]) -> None:
        where, folder = _where(self.folder)
        where.create_dir(folder, recursive=True)
        if self.overwrite:
            for old in _parts(self.folder):
                where.delete_file(old)
        done = [m for m in sorted((m for m in messages if m is not None), key=lambda m: m.number) if m.rows]
        run = uuid.uuid4().hex[:8]
        if self.head:
            with where.open_output_stream(f"{folder}/part-00000-head-{run}{self.extension}") as out:
                out.write(self.head.encode() + b"\n")
        for n, part in enumerate(done, 1):
            where.move(part.path, f"{folder}/part-{n:05d}-{run}{self.extension}")
        where.delete_dir(f"{folder}/{self.hidden}") if messages else None
        with where.open_output_stream(f"{folder}/_SUCCESS") as out:
            out.write(json.dumps({"parts": len(done), "rows": sum(p.rows for p in done)}).encode())

    def abort(self, messages: list[Part | None]) -> None:
        from pyarrow import fs

        where, folder = _where(self.folder)
        if where.get_file_info(f"{folder}/{self.hidden}").type == fs.FileType.Directory:
            where.delete_dir(f"{folder}/{self.hidden}")
            # a folder that this write has made goes too
            if not where.get_file_info(fs.FileSelector(folder)):
                where.delete_dir(folder)


def _parts(folder: str) -> list[str]:
    from pyarrow import fs

    where, path = _where(folder.rstrip("/"))
    found = where.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.startswith("part-"))


def text_format(format_name: str) -> type[DataSource]:
    """The data source of a format."""

    class TextFormat(DataSource):
        @classmethod
        def name(cls) -> str:
            return format_name

        def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
            return TextWriter(self.options, schema.names.index("text"), overwrite)

    return TextFormat


def install(spark: SparkSession, *names: str) -> None:
    for name in names:
        spark.dataSource.register(text_format(name))


def write_text(rows: DataFrame, folder: str, order: tuple[str, ...] = ("_pos",), format_name: str = "papers-text", overwrite: bool = False, **options: str) -> None:
    """Writes column ``text`` of ``rows`` in order, as part files."""
    install(rows.sparkSession, format_name)
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("text"))
    ordered.write.format(format_name).mode("overwrite" if overwrite else "append").options(**options).save(folder)


def stream_parts(folder: str, out: TextIO, separator: str = "\n", block: int = 1 << 20) -> None:
    """The text of the parts one after the other, read from the shared folder block by block; the line end that closes each part gives way to the separator."""
    from codecs import getincrementaldecoder

    where, _ = _where(folder)
    for n, path in enumerate(_parts(folder)):
        out.write(separator if n else "")
        decode, held = getincrementaldecoder("utf-8")().decode, ""
        with where.open_input_stream(path) as part:
            while raw := part.read(block):
                # the last character read is held back, as it may be the line end
                text = held + decode(raw)
                out.write(text[:-1])
                held = text[-1:]


def join_parts(folder: str, target: Path, separator: str = "\n", head: str = "", tail: str = "") -> Path:
    """The parts one after the other as one file, as bytes; the line end that closes each part gives way to the separator."""
    import shutil

    where, _ = _where(folder)
    target.parent.mkdir(parents=True, exist_ok=True)
    partial = target.with_name(f"{target.name}.{uuid.uuid4().hex}.part")
    with partial.open("wb") as out:
        out.write(head.encode())
        for n, path in enumerate(_parts(folder)):
            out.write(separator.encode() if n else b"")
            with where.open_input_stream(path) as part:
                shutil.copyfileobj(part, out, 1 << 20)
            out.truncate(out.seek(-1, 2))
        out.write(tail.encode())
    partial.replace(target)
    return target


def write_single(rows: DataFrame, target: Path, scratch: str, order: tuple[str, ...] = ("_pos",), separator: str = "\n", head: Callable[[], str] | str = "", tail: str = "") -> Path:
    """``rows`` as one file on the driver's disk: tasks write parts into ``scratch``, which all of them reach, and the parts are joined."""
    write_text(rows, scratch, order, separator=separator)
    where, path = _where(scratch)
    try:
        return join_parts(scratch, target, separator, head() if callable(head) else head, tail)
    finally:
        where.delete_dir(path)
