"""polyeval: a Spark-native engine for building, repairing and scoring
multilingual question-answering benchmarks.

Layout
------
- ``sources``    readers, sinks and the dataset schema registry
- ``functions``  Column builders (prompt rendering, text cleanup, parsing)
- ``operators``  DataFrame -> DataFrame operators (scoring, analysis, joins,
                 repair, tokenizer statistics, model runners, packing)
- ``streaming``  Structured Streaming jobs (incremental results and scores)
- ``plans``      the fixture views over the driver tables and the registered
                 query catalogue used by ``__spark_entry__``
"""

__all__ = ["session"]
