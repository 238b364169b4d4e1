"""qcorpus: question/SQL corpus curation on Spark DataFrames.

Sub-packages:
  sources    readers and writers (JSON/JSONL/CSV/catalog/vectors)
  functions  Column -> Column builders (scoring, text, prompts, vectors, status)
  operators  DataFrame -> DataFrame operators (joins, aggregations, windows)
  plans      derived fixtures and the registered queries
  streaming  Structured Streaming versions of the event-log operators
"""

__version__ = "0.1.0"
