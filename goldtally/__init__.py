"""goldtally: structured-extraction scoring on Spark.

Sub-packages: ``sources`` (readers/writers), ``functions`` (comparison
rules as Column expressions), ``plans`` (schemas and comparison plans of the
four tasks), ``operators`` (keys, shape, match, align, score, bundle
flattening, extraction, validation), ``streaming`` (incremental scoring),
``suite`` (queries over the driver tables with their DuckDB oracles).
"""

__version__ = "0.1.0"
