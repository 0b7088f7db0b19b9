"""cartwise: Spark-native retail basket analytics and cross-sell recommendation.

Every operator is a function from DataFrames to a DataFrame.  Nothing is
collected to the driver except scalars used for iteration control.
"""

__version__ = "0.1.0"
