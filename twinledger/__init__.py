"""Reconciliation of two versions of the same data as Spark DataFrames.

Tables of records carry ``pair_id`` (which pair of files), ``seq`` (a long that orders the records of one
file) and ``cols`` (an array of strings, of any width).  All operators work on many pairs at
once, and none brings records to the driver.
"""
