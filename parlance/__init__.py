"""Analytics on two-party call recordings, written as Spark DataFrame operators."""

__version__ = "0.1.0"
