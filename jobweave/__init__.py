"""jobweave: a PySpark-native engine for incremental feeds of job postings.

Everything is a ``DataFrame -> DataFrame`` transform; the clock is always a parameter.
"""

__version__ = "0.1.0"
