"""skein: program graphs and relational data as DataFrames, queried with Spark."""

__version__ = "0.1.0"
