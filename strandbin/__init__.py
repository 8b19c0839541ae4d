"""Spark operators for grouping DNA contigs into genome bins."""

__version__ = "0.1.0"
