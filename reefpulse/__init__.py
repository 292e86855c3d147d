"""Tag-detection telemetry analytics on Spark DataFrames.

``sources``    typed readers and per-tag writers
``functions``  column expressions (clock, geometry, null rules, p-values)
``operators``  DataFrame -> DataFrame operators
``plans``      operators put together, and the registered queries
"""
