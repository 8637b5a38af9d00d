"""plenaria: a Spark-native analytics engine for parliamentary debate archives.

Sub-packages
------------
``sources``    scans and sinks (Parquet, XML, JSON, ZIP, CSV, XLSX, text)
``functions``  column expressions and Arrow-batched UDFs on text, dates, numbers
``operators``  relational, ranking, statistical and interval operators
``plans``      composite queries (views) built from the operators
``streaming``  stateful counters and windows on Structured Streaming
``llm``        training-data operators; nothing outside that package imports it
"""

__version__ = "0.1.0"
