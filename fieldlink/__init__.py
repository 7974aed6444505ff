"""Finds which columns of one table carry the same business field as which columns of another, on Spark."""
