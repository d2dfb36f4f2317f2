"""Fiscalith: a Spark-native engine for budget tables and policy prose.

Layout
------
``functions``  column expressions (JVM side)
``operators``  DataFrame -> DataFrame building blocks
``plans``      composed analytics, entity linking, ingest
``sources``    readers, writers and path/URL inference
``streaming``  Structured Streaming ingest
``llm``        operators for training-data preparation (optional subpackage)
"""

__version__ = "0.1.0"
