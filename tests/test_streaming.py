"""Fixpoints over batches of edges equal those over all edges at once."""

import random

import pytest
from pyspark.sql import functions as F

from fjordgraph.streaming.incremental import Incremental

from . import plain


def values(df):
    return {r.id: r.value for r in df.collect()}


def batches(spark, kind):
    rng = random.Random(5)
    rows = [(rng.randrange(25), rng.randrange(25), float(rng.randrange(1, 5))) for _ in range(40)] + [(i, i + 1, 1.0) for i in range(8)]
    rng.shuffle(rows)
    return rows, [rows[:3], rows[3:20], [], rows[20:]]


def right(kind, rows):
    if kind == "components":
        return plain.components([r[:2] for r in rows])
    if kind == "levels":
        found = plain.bfs([r[:2] for r in rows], 30, 0)
    else:
        found = plain.dijkstra(rows, 30, 0)
        found = dict(found if isinstance(found, dict) else enumerate(found))
    return {k: v for k, v in found.items() if v is not None and v != float("inf")}


@pytest.mark.parametrize("kind", ["levels", "distances", "components"])
def test_batches_equal_a_run_from_scratch(spark, tmp_path, kind):
    rows, parts = batches(spark, kind)
    source = None if kind == "components" else 0
    seen = []
    for k, part in enumerate(parts):
        # a new object each time: all that is known lies in the folder
        inc = Incremental(spark, str(tmp_path / "s"), kind, source)
        inc.update(spark.createDataFrame(part, "src long, dst long, weight double"), k)
        seen += part
        assert values(inc.result()) == right(kind, seen), k
    assert inc.versions() == [2, 3] and values(inc.result(2)) == right(kind, rows[:20])
    before = values(inc.result())
    inc.update(spark.createDataFrame([(0, 29, 1.0)], "src long, dst long, weight double"), 3)  # given again: done already
    assert values(inc.result()) == before


def test_a_stream_goes_on_after_a_failure(spark, tmp_path):
    """A batch that fails half-way is made again from the checkpoint, with the same result."""
    rows, parts = batches(spark, "levels")
    for k, part in enumerate(p for p in parts if p):
        spark.createDataFrame(part, "src long, dst long, weight double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    failures = [1, 2]

    class Broken(Incremental):
        def _write(self, df, table, version):
            if table == "values" and failures and version == failures[0]:
                failures.pop(0)
                raise RuntimeError("lost")
            super()._write(df, table, version)

    def run():
        inc = Broken(spark, str(tmp_path / "state"), "levels", 0)
        stream = spark.readStream.schema("src long, dst long, weight double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = stream.writeStream.foreachBatch(inc.update).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        return inc

    for _ in range(2):
        with pytest.raises(Exception, match="lost"):
            run()
    inc = run()
    assert not failures and values(inc.result()) == right("levels", rows) and inc.versions()[-1] == 2


def test_odd_edges(spark, tmp_path):
    inc = Incremental(spark, str(tmp_path / "s"), "components")
    assert inc.result().collect() == [] and inc.versions() == []
    inc.update(spark.createDataFrame([(3, 3), (None, 1), (5, 4), (5, 4)], "src long, dst long"), 0)
    assert values(inc.result()) == {3: 3, 4: 4, 5: 4}
    inc.update(spark.createDataFrame([(4, 3)], "src long, dst long").withColumn("weight", F.lit(None).cast("double")), 7)
    assert values(inc.result()) == {3: 3, 4: 3, 5: 3}
    with pytest.raises(Exception, match="finite"):
        inc.update(spark.createDataFrame([(1, 2, -1.0)], "src long, dst long, weight double"), 8)
    for bad in (("levels", None), ("components", 1), ("ranks", None)):
        with pytest.raises(ValueError):
            Incremental(spark, str(tmp_path), *bad)
