"""Bulk data work behind agent memory, as Spark jobs over DataFrames."""
