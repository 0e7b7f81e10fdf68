"""tripletframe: contrastive-text data building and evaluation as Spark DataFrame jobs.

Subpackages
-----------
functions  column expressions (hash keys, cosine, tokenising, label maps, formatting)
sources    readers / writers and the test views built from the driver tables
operators  triplet construction, negative sampling, mixing, scoring, statistics
plans      the registered queries and their DuckDB oracle SQL
streaming  Structured Streaming ingest and monitoring
"""

from tripletframe.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
