"""culvert: a PySpark-native analytics engine for nested, overlapping drawing observations.

Every operator is a function from DataFrames to a DataFrame and is planned lazily;
only the few documented places that must look at a bounded statistic (heavy keys,
fixed-size registers) run a job while the plan is being built.
"""

__version__ = "0.1.0"
