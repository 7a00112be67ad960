"""Operators of a training-data pipeline over text tables.

Nothing outside this folder (but the guarded registration in the entry module)
imports it.  Every operator takes and returns DataFrames; intermediate tables
go to the shared folder named by ``spark.checkpoint.dir``.
"""
