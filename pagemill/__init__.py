"""pagemill: analytics over page-structured documents on Spark.

The package is split by role: ``functions`` (column expressions), ``operators``
(DataFrame to DataFrame transformations), ``sources`` (readers and writers),
``plans`` (end-to-end pipelines and the query catalogue) and ``streaming``.
"""

__version__ = "0.1.0"
