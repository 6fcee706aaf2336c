"""Spark operators for station time series, area warnings and forecast verification."""
