"""Lineage cuts as Parquet tables in the folder that all executors share.

A table written there survives lost executors, carries exact sizes for the
planner, and is computed once (a reliable ``checkpoint()`` runs its last stage
twice). The folder is ``spark.checkpoint.dir``; only a local master, as in tests,
may go without one and gets a temporary folder.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables, per application."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="fjordgraph-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/fjordgraph-{app}"


def write_table(df: DataFrame, name: str = "t", by: str | None = None) -> str:
    """Write ``df`` as Parquet in the shared folder and return its path; with
    ``by``, in a folder for each value of that column."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    (df.write if by is None else df.write.partitionBy(by)).parquet(path)
    return path


def cut(df: DataFrame, name: str = "t", by: str | None = None, buckets: tuple[int, str] | None = None, path: str | None = None, **metrics) -> DataFrame | tuple[DataFrame, dict]:
    """Write ``df`` and read it back: lineage ends here.

    With ``buckets`` (number, column) the table is bucketed: joins and groupings by
    that column then need no exchange of it. ``df`` should lie in as many partitions
    by that column already, as each task writes a file for every bucket it has. ``path``
    is a folder of the caller's. With ``metrics`` (name -> aggregate Column) these are observed in the same job and
    returned beside the table.
    """
    spark = df.sparkSession
    seen = Observation(f"{name}-{uuid.uuid4().hex}") if metrics else None
    if seen is not None:
        df = df.observe(seen, *[c.alias(k) for k, c in metrics.items()])
    if buckets is None:
        schema = df.schema
        if path is None:
            path = write_table(df, name, by)
        else:
            df.write.parquet(path)
        table = spark.read.schema(schema).parquet(path)
    else:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        known = f"fjord_{uuid.uuid4().hex}"
        df.write.bucketBy(buckets[0], buckets[1]).format("parquet").option("path", path).saveAsTable(known)
        table = spark.table(known)
        table._fjord_table = known
    table._fjord_path = path
    return (table, seen.get) if seen is not None else table


def drop(*tables: DataFrame | None) -> None:
    """Delete tables made by :func:`cut`; others are left alone."""
    for t in tables:
        path = getattr(t, "_fjord_path", None)
        if path:
            spark = t.sparkSession
            if getattr(t, "_fjord_table", None):
                spark.sql(f"drop table if exists {t._fjord_table}")
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
            t._fjord_path = None
