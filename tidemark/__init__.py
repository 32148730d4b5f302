"""tidemark: documents, places, series, rasters and change logs as Spark DataFrames.

Every operator takes DataFrames (and literals) and returns a DataFrame built
from native expressions, so Catalyst sees the whole query. Nothing is cached
behind the caller's back; where an operator must cut its lineage it writes a
table to the shared folder named by ``spark.checkpoint.dir``.
"""

__version__ = "0.1.0"
