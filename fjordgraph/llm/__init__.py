"""Operators for preparing large training corpora.

Python stages take Arrow batches as Spark deals them, bounded in rows and bytes
(``spark.sql.execution.arrow.maxRecordsPerBatch`` and ``maxBytesPerBatch``).
"""
