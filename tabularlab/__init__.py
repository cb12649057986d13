"""tabularlab: Spark-native analytics for tables, series and text.

Every operator is a function ``DataFrame -> DataFrame`` (or a small driver-side
summary computed by one Spark job) with explicit keys and ordering.  The heavy
lifting is always expressed with the DataFrame API so that Catalyst can prune
columns, push filters into the parquet scan and pick join strategies, and AQE
can coalesce partitions and split skewed ones at runtime.
"""

__version__ = "0.1.0"
