"""corpusloom: a PySpark-native engine for conversational and text corpora.

The package holds column functions (`functions`), DataFrame operators
(`operators`), readers and writers (`sources`), whole pipelines (`plans`) and
Structured Streaming twins (`streaming`).  Every operator takes and returns
DataFrames; nothing is collected to the driver unless its size is bounded by a
configuration value and the docstring says so.
"""

__version__ = "0.1.0"
