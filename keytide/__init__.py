"""Keytide: keyed state and event logs as Spark DataFrames."""
