"""Spark jobs for the data work behind a geospatial data catalogue.

Every operator takes and returns DataFrames or Columns made of built-in Spark
expressions. The current time is always an argument, never read inside.
"""
