"""Workforce and payroll analytics as PySpark DataFrame jobs.

``functions``  column expressions (no shuffle, no Python workers)
``sources``    CSV / Parquet readers, append sinks, saved models
``operators``  DataFrame -> DataFrame building blocks
``plans``      the composed jobs a user runs (dashboard, listing, backtest, prediction, training)
``catalog``    domain views over the bundled test tables plus one registered query per operator
"""
