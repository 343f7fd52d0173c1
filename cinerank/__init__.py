"""cinerank: recommendation analytics as Spark DataFrame jobs.

Every public operator takes DataFrames (and plain parameters) and returns a
lazy DataFrame; nothing is collected except results with a proven size bound.
"""

__version__ = "0.1.0"
