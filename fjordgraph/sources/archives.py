"""Text members of zip archives as lines.

Archives are dealt over tasks as whole files, as their index is at the end; members are
unpacked as a stream, so a task holds an archive's packed bytes and one batch of lines.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Lines of a batch.
BATCH = 10_000
LINES = "archive string, member string, line_no long, value string"


def read_zip_lines(spark: SparkSession, path: str, member: str = r".*") -> DataFrame:
    """``archive, member, line_no, value``: the lines of all members whose name the
    pattern matches as a whole, numbered from 0 within each; line ends are left out and
    bytes that are no UTF-8 replaced. What is no zip archive is an error."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = re.compile(member)
        for batch in batches:
            for archive, content in zip(batch.column("path"), batch.column("content"), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as packed:
                    for info in packed.infolist():
                        if not info.is_dir() and wanted.fullmatch(info.filename):
                            with packed.open(info) as raw:
                                yield from _batches(archive.as_py(), info.filename, io.TextIOWrapper(raw, "utf-8", "replace"))

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "content").mapInArrow(unpack, LINES)


def _batches(archive: str, member: str, lines: io.TextIOBase) -> Iterator[pa.RecordBatch]:
    first, held = 0, []

    def batch() -> pa.RecordBatch:
        n = len(held)
        columns = [pa.array([archive] * n), pa.array([member] * n), pa.array(range(first, first + n), pa.int64()), pa.array(held, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["archive", "member", "line_no", "value"])

    for line in lines:
        held.append(line.rstrip("\n"))
        if len(held) == BATCH:
            yield batch()
            first, held = first + BATCH, []
    if held:
        yield batch()
