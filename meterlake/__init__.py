"""Document-store algebra, request checks, metrics and metering for a model-serving API, on Spark DataFrames."""
