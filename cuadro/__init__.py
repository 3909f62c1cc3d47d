"""cuadro: turn a flat table and plain-language questions into computed results on Spark.

Sub-packages:

* ``sources``   – CSV scan, table loading, the chunk/vector store (partitioned Parquet).
* ``functions`` – column expressions and driver-side resolvers that only need the schema
                  or the question text (chart intent, column roles, text helpers).
* ``operators`` – DataFrame operators: cleaning, row index, profile, corpus, charts,
                  vector search, retrieval context, advertised insights.
* ``plans``     – composed jobs: chart dispatch, batch question answering, ingest.
* ``streaming`` – the question loop as a Structured Streaming query.
"""

__version__ = "0.1.0"
