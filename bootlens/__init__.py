"""bootlens: fleet and boot-timeline analytics on Spark.

Every operator is a plain function from DataFrames (plus column names and
settings) to a DataFrame.  Nothing is collected to the driver; hot keys are
split by range partitioning or handled by partial aggregation (see
``bootlens.operators.sequence``).
"""

__version__ = "0.1.0"
