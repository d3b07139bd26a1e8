"""Memory-lifecycle and text-corpus jobs expressed as PySpark DataFrames."""
