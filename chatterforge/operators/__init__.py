"""Operators on conversation tables; all take and return DataFrames.

A message or turn table has ``transcript_id`` and ``pos``: the order inside a
transcript carries meaning, and Spark tables have none of their own.
"""
