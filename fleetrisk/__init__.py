"""fleetrisk — failure-risk analytics for fleets of power inverters on PySpark.

Every operator is a ``DataFrame -> DataFrame`` function that composes with
``DataFrame.transform``; nothing collects rows to the driver in the middle of
a plan. Subpackages:

* ``sources``   — telemetry readers (wide CSV, parquet tables, the events fixture), sinks
* ``functions`` — column expressions (coercion, time, KPI, formatting)
* ``operators`` — hourly aggregation, windows, labels, matrix, metrics, reports, text
* ``models``    — boosted trees, isolation forest, tree attribution as Spark jobs
* ``plans``     — composed pipelines (featurize, train, score, risk board)
* ``streaming`` — Structured Streaming variants of hourly aggregation and scoring
"""

__version__ = "0.1.0"
