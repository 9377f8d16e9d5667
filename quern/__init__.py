"""quern: a PySpark-native engine for corpus and code analytics.

Sub-packages: ``sources`` (readers, adapters, sinks), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame), ``plans`` (compositions),
``streaming`` (incremental maintenance), ``llm`` (training-data operators).
"""
