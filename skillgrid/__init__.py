"""skillgrid: posting-demand analytics expressed as Spark DataFrame jobs.

Every operator is a plain function ``DataFrame -> DataFrame`` built from
Spark's own joins, aggregates, windows and Structured Streaming.
"""

__version__ = "0.1.0"
