"""tubeql: spatio-temporal tube analytics on Spark DataFrames."""
