"""scorelab: evaluate, compare and explain binary scoring models as Spark DataFrame plans.

Layout
------
``sources``    readers, writers, result tables and the test bindings onto the star schema
``functions``  column-level helpers (bucket labels, name cleaning, model families, ...)
``operators``  DataFrame -> DataFrame operators (profiling, prep, resampling, metrics, tests,
               learning, explanation, reliability)
``plans``      shared plan shapes (bucketed running totals, exact ranks) and the query catalog
``streaming``  Structured Streaming versions of the running counters
"""

DEFAULT_GROUP = ("dataset", "model_group", "model")
