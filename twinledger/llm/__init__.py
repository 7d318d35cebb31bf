"""Operators of a training-data pipeline, built on Spark DataFrames.

Each module holds one operator with its own general interface.  ``queries``
derives the registered result tables from them.  Nothing outside this package
imports it.
"""
