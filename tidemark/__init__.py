"""tidemark — curated-table toolkit on Spark.

Every operator is a lazy ``DataFrame -> DataFrame`` (or ``Column -> Column``)
built from Spark SQL expressions so Catalyst can prune, push down and codegen
the whole plan.  Sub-packages:

* ``functions``  scalar column functions (cleaning, parsing, masking)
* ``operators``  schema, filter, expansion, join, aggregate, window, merge,
                 quality and enrichment operators
* ``sources``    landing / curated / JDBC readers and the atomic publisher
* ``streaming``  incremental file ingestion (Structured Streaming)
* ``plans``      adapter views over the driver tables, named pipelines and
                 the registered queries with their DuckDB oracles
"""

__version__ = "0.1.0"
