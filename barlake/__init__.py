"""Point-in-time analytics over market and event time series, on PySpark."""
