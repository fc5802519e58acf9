"""Run records and logs: nested JSON, file names, and lines scraped from output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RUN = "algorithm STRING, backend STRING, nodes BIGINT, threads INT, ranks INT, rep INT, status STRING, result STRUCT<raw: STRUCT<execution_time_ms: DOUBLE, total_time_ms: DOUBLE, load_time_ms: DOUBLE>>"
TRACE = "ARRAY<STRUCT<worker_id: INT, timestamps: ARRAY<STRUCT<key: STRING, value: STRING>>>>"


def read_runs(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Run records of a folder with what their file names, or folders', say.

    Names look like ``<algorithm>_<backend>_n<nodes>[_t<threads>][_r<ranks>]_rep<k>.json``;
    fields in the record win over those of the name. Unreadable files give nulls.
    """
    rows = spark.read.schema(RUN).option("multiLine", multi_line).option("recursiveFileLookup", True).json(path).withColumn("file", F.input_file_name())
    part = lambda pattern: F.nullif(F.regexp_extract("file", pattern, 1), F.lit(""))
    return rows.withColumns({
        "nodes": F.coalesce("nodes", part(r"_n(\d+)").cast("long")),
        "threads": F.coalesce("threads", part(r"_t(\d+)").cast("int")),
        "ranks": F.coalesce("ranks", part(r"_r(\d+)_").cast("int")),
        "rep": F.coalesce("rep", part(r"_rep(\d+)").cast("int")),
    })


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """``file, at, value``: the lines of log files, with their order.

    ``at`` (a struct) orders the lines of one file: by where their split begins, then by
    the row within its task, as a task reads a split from its start to its end. Splits
    are read by different tasks, and nothing is shuffled.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select(F.col("_metadata.file_path").alias("file"), at.alias("at"), "value")


def last_json_lines(log: DataFrame, schema: str, prefix: str = "") -> DataFrame:
    """``file`` and the fields of its last line that is a JSON object after ``prefix``;
    files without one have no row."""
    best = _json_bodies(log, prefix, "file", "at").groupBy("file").agg(F.max_by("body", "at").alias("body"))
    return best.select("file", F.from_json("body", schema).alias("r")).select("file", "r.*")


def longest_durations(log: DataFrame) -> DataFrame:
    """``file, duration``: the greatest of :func:`longest_duration` in each file."""
    return log.groupBy("file").agg(F.max(longest_duration(F.col("value"))).alias("duration"))


def _json_bodies(lines: DataFrame, prefix: str, *keep: str, text: str = "value") -> DataFrame:
    body = F.trim(F.substring(text, F.lit(len(prefix) + 1), F.length(text)))
    return lines.where(F.col(text).startswith(prefix)).select(*keep, body.alias("body")).where("startswith(body, '{') and endswith(body, '}')")


def longest_duration(text: Column) -> Column:
    """Greatest ``'duration': N`` that is followed by an ``'end'``, else null."""
    return F.array_max(F.transform(F.regexp_extract_all(text, F.lit(r"'duration': (\d+), 'end': \d+"), F.lit(1)), lambda x: x.cast("long")))


def last_json_line(lines: DataFrame, schema: str, prefix: str = "", order: str = "line_no", text: str = "value") -> DataFrame:
    """The record of the last line that is a JSON object after ``prefix``."""
    best = _json_bodies(lines, prefix, order, text=text).agg(F.max_by("body", order).alias("body"))
    return best.select(F.from_json("body", schema).alias("r")).select("r.*")


def memory_mb(text: Column) -> Column:
    """``512``, ``512m``, ``2g`` ... in MB; null where it is none of these."""
    t = F.lower(F.trim(text))
    n = F.regexp_extract(t, r"^(\d+)([a-z]*)$", 1).try_cast("long")
    unit = F.regexp_extract(t, r"^(\d+)([a-z]*)$", 2)
    return F.when(unit.isin("", "m", "mb", "mi", "mib"), n).when(unit.isin("g", "gb", "gi", "gib"), n * 1024)
