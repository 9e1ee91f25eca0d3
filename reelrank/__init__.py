"""reelrank: Spark-native rating prediction and script similarity.

Every operator is a function from DataFrames to DataFrames.  The heavy
lifting (joins, aggregations, windows) is declared with the DataFrame API
so that Catalyst/AQE choose the physical plan.
"""

__version__ = "0.1.0"
