"""Spark-native oligonucleotide probe design and sequence analytics.

Every operator takes and returns DataFrames.  Plans are declared with built-in
column functions wherever they can express the semantics; Arrow batches of
numpy work (``mapInArrow``) are used where they cannot.
"""

__version__ = "0.1.0"
